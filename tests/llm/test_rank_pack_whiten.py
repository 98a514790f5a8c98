"""Block ranking, configuration packing and whitening against plain forms."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconry.llm import blockrank, configpack, whitening

FILE = public_tokenizers.path("word_bpe_49k.json")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------------------------ ranking


def plain_terms(text):
    return _TERM.findall(text.translate(_FALL)) if text else []


def plain_rank(docs, items, k=20):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, every = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), n in zip(counted, sizes):
            m = 75 + (25 * n * n_docs) // every if every else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                (10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(plain_terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **kwargs):
    return sorted(map(tuple, blockrank.rank(docs, items, **kwargs).collect()), key=str)


@pytest.fixture()
def items(spark, tmp_path):
    made = [0]

    def make(*rows):
        made[0] += 1
        path = str(tmp_path / f"i{made[0]}")
        spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string").write.parquet(path)
        return spark.read.parquet(path)

    return make


def test_ranking_equals_plain_loops(docs, items):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma9", "ÄÖ", "東京", "don't", "x_y", "Δelta", "a", "zz"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "... \x7f\x00!"), (None, "alpha Beta"), (None, "alpha beta"), (7, rows[7][1]),
             (500, "gamma9 " * 30_000), *((600 + i, "tie tie w1") for i in range(60))]
    asked = [(1, "alpha beta, w1 w1 w1 tie"), (2, None), (3, ""), (4, "nowhere"), (5, " ".join(words)), (5, "東京 äö ÄÖ"), (None, "gamma9 w3")]
    assert ranked(docs(*rows), items(*asked)) == plain_rank(rows, asked)


def test_small_tiles_and_item_blocks_change_nothing(docs, items, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 17 + 1))) for i in range(200)]
    asked = [(i, " ".join(f"w{(i + j) % 23}" for j in range(5))) for i in range(30)]
    assert ranked(docs(*rows), items(*asked), items_per_block=7) == plain_rank(rows, asked)


def test_counts_beyond_the_exact_limit_take_layers(monkeypatch):
    voc = blockrank.Vocabulary([b"a " * 1000 + b"b", b"b c"])
    heaviest = blockrank.EXACT // 300
    total = np.zeros((2, 3))
    for used, tile in voc.tiles(heaviest, width=2):
        assert (tile.sum(axis=1) * heaviest < blockrank.EXACT).all()
        total[:, used] += tile
    assert total.tolist() == [[1000, 1, 0], [0, 1, 1]]


@given(st.lists(st.lists(st.integers(0, 5), min_size=7, max_size=7), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_ties_are_settled_by_id_whatever_the_tiles(tiles, k):
    best, rows = blockrank.Best(1, k), []
    rng = np.random.default_rng(len(tiles))
    for tile in tiles:
        ids = rng.integers(0, 50, len(tile))
        best.add(np.array([tile]), np.zeros(len(tile), np.int64), ids, np.arange(len(tile)))
        rows += [(-s, i) for s, i in zip(tile, ids.tolist()) if s > 0]
    assert [(-a, b) for a, b in zip(best.kept[0][0].tolist(), best.kept[0][2].tolist())] == sorted(rows)[:k]


def test_ranking_of_empty_tables(docs, items):
    assert ranked(docs(), items((1, "a"))) == []
    assert ranked(docs((1, "a")), items()) == []
    assert ranked(docs((1, None)), items((1, "a"))) == []


# ------------------------------------------------------------------------------------ packing


def check_plan(histogram, capacity):
    plan, got = configpack.solve(histogram, capacity), Counter()
    for config, times in plan:
        assert times > 0 and sum(a * b for a, b in config) <= capacity
        for length, copies in config:
            got[length] += copies * times
    assert got == Counter({k: v for k, v in histogram.items() if v})
    return sum(t for _, t in plan)


@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=20))
@settings(max_examples=40, deadline=None, phases=[Phase.explicit, Phase.generate])
def test_every_piece_is_in_the_plan_once(histogram):
    used = check_plan(histogram, 40)
    assert used >= -(-sum(k * v for k, v in histogram.items()) // 40)
    assert used <= sum(configpack.best_fit({k: v for k, v in histogram.items() if v}, 40).values()) + 2  # whole numbers of few pieces


@given(st.integers(0, 10**6))
@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
def test_cut_sequences_are_packed_again_without_a_gap(seed):
    """Pieces made by cutting full sequences: their number is the optimum."""
    rng, histogram, n = np.random.default_rng(seed), Counter(), 300
    for _ in range(n):
        cuts = np.sort(rng.choice(np.arange(1, 400), rng.integers(0, 6), replace=False))
        histogram.update(np.diff([0, *cuts, 400]).tolist())
    assert check_plan(dict(histogram), 400) <= n * 1.01


def test_program_beats_longest_first():
    # thirds and a bit: 2 x 1000 + 1 x 2096 fill a sequence; longest-first puts the long ones together with nothing else
    histogram = {2096: 50, 1000: 100, 1365: 90, 1366: 90, 1300: 60, 1431: 30}
    fitted = sum(configpack.best_fit(dict(histogram), 4096).values())
    assert check_plan(histogram, 4096) <= fitted


def test_knapsack_equals_brute_force():
    lengths, left, prices = np.array([7, 5, 3]), np.array([2, 1, 3]), np.array([7.5, 4.9, 3.2])
    knapsack = configpack.Knapsack(lengths, left, prices, 20)
    contents = knapsack.contents(np.arange(21))
    for room in range(21):
        best = max(a * 7.5 + b * 4.9 + c * 3.2 for a in range(3) for b in range(2) for c in range(4) if 7 * a + 5 * b + 3 * c <= room)
        assert knapsack.best[room] == pytest.approx(best)
        assert contents[room] @ prices == pytest.approx(best) and contents[room] @ lengths <= room


def plain_pieces(rows, capacity):
    tok, out = Tokenizer.from_file(FILE), []
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for number, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at: at + capacity]
            out.append((doc, number, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(got, rows, capacity):
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces(rows, capacity)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents_are_whole_and_gapless(docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["house", "tree", "Straße", "xylophone", "東京"], rng.integers(0, 60)))) for i in range(300)]
    rows += [(None, None), (None, "same"), (5, "same"), (5, "same"), (900, ""), (901, "word " * 20_000), (902, "x" * 5000)]
    for capacity in (64, 4096):
        got = configpack.pack(docs(*rows), FILE, 1, capacity).collect()
        used = check_packed(got, rows, capacity)
        assert used <= -(-sum(r.length for r in got) // capacity) * 1.02 + 1


def test_packing_of_an_empty_table(docs):
    assert configpack.pack(docs(), FILE, 1).collect() == []


# ---------------------------------------------------------------------------------- whitening


@pytest.fixture()
def vectors(spark):
    def make(*rows, kind="float"):
        full = [(i, None if v is None else list(v), "a", "b") for i, v in rows]
        return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, v string, n string").repartition(3)

    return make


def plain_whitening(rows):
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return centred @ axes / np.sqrt(np.where(values > 0, values, 1)), values, deviation


def test_whitening_equals_eigenvectors(vectors):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((400, 40)) * np.geomspace(30, 0.3, 40)) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    x = x.astype(np.float32)
    odd = [(1000, None), (1001, [1.0] * 39 + [None]), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (1004, [])]
    got = whitening.whiten(vectors(*enumerate(x.tolist()), *odd)).collect()
    white, values, deviation = plain_whitening(x)
    assert len(got) == 400 * 32
    assert {r.identity_error < 1e-9 for r in got} == {True} and len({r.identity_error for r in got}) == 1
    made = np.zeros((400, 32))
    for r in got:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 400 and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    signs = np.sign((made * white[:, :32]).sum(axis=0))
    assert np.abs(made * signs - white[:, :32]).max() < 1e-7


def test_dependent_columns_lengths_and_huge_entries(vectors):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((50, 3)) * 5
    same = np.concatenate([base, base[:, :1], np.ones((50, 1))], axis=1)  # rank 3 of 5
    got = whitening.whiten(vectors(*enumerate(same.tolist()), (None, [1.0, 2.0]), (90, [3.0, 5.0]), (91, [7.0]), kind="double")).collect()
    five = [r for r in got if r.n == 50]
    assert {(r.component, r.whitened is None) for r in five} == {(c, c > 3) for c in range(1, 6)}
    assert sum({r.component: r.explained for r in five}.values()) == pytest.approx(1)
    assert all(r.identity_error < 1e-9 for r in five)
    two = [r for r in got if r.n == 2]
    assert sorted((str(r.vec_id), r.component, r.whitened is None) for r in two) == [
        ("90", 1, False), ("90", 2, True), ("None", 1, False), ("None", 2, True)]
    assert [(r.vec_id, r.whitened, r.explained, r.deviation) for r in got if r.n == 1] == [(91, None, None, 0)]
    huge = whitening.whiten(vectors((1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), kind="double")).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_rows_solved_through_a_factor():
    rng = np.random.default_rng(4)
    r = np.triu(rng.standard_normal((70, 70))) + 5 * np.eye(70)
    z = rng.standard_normal((11, 70))
    assert np.abs(whitening.solve_right(z, r) @ r - z).max() < 1e-10


def test_whitening_of_an_empty_table(vectors):
    got = whitening.whiten(vectors((1, None)))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
