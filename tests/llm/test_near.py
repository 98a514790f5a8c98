"""Jaccard join, vector codes and chunk dedup against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from beaconry.llm import binarycodes, chunkdedup, paritysketch
from beaconry.llm.common import components
from beaconry.llm.tiles import tile_labels, tiled


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def union(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = union(len(rows), pairs)
    low = {}
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, len(s), low.get(r)) for (i, _), s, r in zip(rows, sets, roots)]


def corpus(seed, groups=14, copies=8):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    common = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 20, 60, 200, 700]))]
        if rnd.random() < 0.5:
            base = base[:20] + common + base[20:]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, len(w) // 30, len(w) // 12])):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w[: len(w) - rnd.choice([0, 0, len(w) // 10, len(w) // 5])]))
    rnd.shuffle(texts)
    return texts


EDGE = ["", None, "one two", "ONE  two", "one two three", "\t\n", "É é x y z w", "é é x y z w", "same words again and again here",
        "same words again and again here", "long " * 20_000 + "end", "long " * 20_000 + "end"]


def near_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"FREQUENT": 3, "GROUP_UP_TO": 2, "TILE": 4}, {"FREQUENT": 2, "TILE": 16},
                                      {"GROUP_UP_TO": 3}])
def test_jaccard_equals_brute_force(docs, settings, monkeypatch):
    """Also with hardly anything counted as rare, so that every path of the join is taken."""
    for name, value in settings.items():
        monkeypatch.setattr(paritysketch, name, value)
    rows = [(3 * i, t) for i, t in enumerate(corpus(len(settings)) + EDGE)] + [(None, "one two"), (7, "nul id text only here now"), (7, "nul id text only here now")]
    assert near_rows(paritysketch.jaccard_components(docs(*rows))) == sorted(brute(rows), key=repr)


def test_jaccard_empty_table_and_filter(docs):
    assert paritysketch.jaccard_components(docs()).count() == 0
    rows = [(i, t) for i, t in enumerate(corpus(5, 8, 5) + EDGE)] + [(0, corpus(5, 8, 5)[0])]
    df = docs(*rows)
    kept = paritysketch.drop_near_duplicates(df)
    assert kept.columns == df.columns
    truth = {i: c for i, n, c in brute(rows) if n}
    want = sorted([i for i, c in truth.items() if i == c] + [i for i, n, _ in brute(rows) if not n])
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_filter_tells_components_apart_without_ids(docs):
    """Null and repeated ids do not join texts that are not linked, and a null id goes before a known one does."""
    texts = corpus(9, 7, 1)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (5, texts[4]), (4, texts[5]), (None, None), (None, "")]
    rows += [(None, "two equal texts without any id at all"), (None, "two equal texts without any id at all")]
    kept = [(r.doc_id, r.text) for r in paritysketch.drop_near_duplicates(docs(*rows)).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows[:-1] if r != (None, texts[4])], key=repr)


def test_sketch_bounds():
    """Dense distance never exceeds the symmetric difference, and few words differ."""
    rng = np.random.default_rng(1)
    for n in (3, 40, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[n // 9:], rng.integers(0, 2**63, n // 9, dtype=np.uint64)]))
        diff = len(np.setxor1d(a, b))
        size = min(paritysketch.dense_bits(len(a)), paritysketch.dense_bits(len(b)))
        bits = [np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(paritysketch.dense_sketch(s), np.uint8)).reshape(-1, size)) for s in (a, b)]
        assert (bits[0] ^ bits[1]).sum() <= diff
        band = paritysketch.bands(max(len(a), len(b)))[0]
        keys = [set(paritysketch.sketch_keys(s, band).tolist()) for s in (a, b)]
        assert len(keys[0] - keys[1]) <= diff


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [
        (500, i) for i in range(501, 600)] + [(None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = union(600, [p for p in pairs if p[0] is not None])
    for i in range(600):
        assert got.get(i, i) == roots[i]


def test_tile_labels():
    rng = np.random.default_rng(2)
    m = rng.random((60, 60)) < 0.02
    m |= m.T
    roots = union(60, list(zip(*np.nonzero(m))))
    assert tile_labels(m).tolist() == roots


def vectors(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row_key string, good string, v string").write.parquet(path)
    return spark.read.parquet(path)


def brute_vectors(rows):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = [np.array(v, np.float32).astype(np.float64) if o else None for (_, v), o in zip(rows, ok)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and len(x[i]) == len(x[j])
             and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9]
    roots = union(len(rows), pairs)
    low, n = {}, [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, k, low.get(r), low.get(r) == i) for (i, _), k, r in zip(rows, n, roots)), key=repr), len(pairs)


def clustered(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        x[i] = x[rng.integers(0, max(1, i // 2 + 1))] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.4, 0.46, 0.6])
    return [[float(c) for c in v] for v in x]


def test_vectors_equal_brute_force_in_one_bucket(spark, tmp_path):
    rows = [(5 * i, v) for i, v in enumerate(clustered(1, 250))]
    rows += [(1, None), (2, [0.0] * 64), (3, [1.0, None]), (4, [float("nan")] * 64), (6, [float("inf")] * 64), (7, []), (8, [1.0, 2.0]),
             (9, [2.0, 4.0]), (9, [2.0, 4.0]), (None, [2.0, 4.0]), (None, None), (11, [1e30] * 64), (12, [1e-30] * 64)]
    df = vectors(spark, str(tmp_path / "v"), [(i, v, 1, None, None, None) for i, v in rows])
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in binarycodes.near_vectors(df, tile=40).collect()), key=repr)
    assert got == brute_vectors(rows)[0]
    empty = vectors(spark, str(tmp_path / "e"), [])
    assert binarycodes.near_vectors(empty).count() == 0


@pytest.mark.parametrize("bucket, tables", [(40, 7), (12, 10)])
def test_vectors_recall_over_tables(spark, tmp_path, bucket, tables):
    assert binarycodes.table_plan(1500, bucket=bucket)[1] >= tables
    rows = [(i, v) for i, v in enumerate(clustered(2, 1500))]
    df = vectors(spark, str(tmp_path / "v"), [(i, v, 1, None, None, None) for i, v in rows])
    got = {r.vec_id: r.n_links for r in binarycodes.near_vectors(df, bucket=bucket, tile=64).collect()}
    truth, n_pairs = brute_vectors(rows)
    assert all(got[i] <= n for i, n, _, _ in truth)  # nothing below the threshold, nothing twice
    assert sum(got.values()) >= 0.97 * 2 * n_pairs


def test_equal_vectors_are_compared_once(spark, tmp_path, monkeypatch):
    """A group of copies takes part as one row, and its links and component are those of all copies."""
    near = clustered(3, 60, 16)
    rows = [(i, v) for i, v in enumerate(near)] + [(None if i % 50 == 0 else 1000 - i, near[i % 2]) for i in range(300)]
    rows += [(None, [9.0, -1.0])] * 3 + [(2000, [9.0, -1.0, 5.0])]
    df = vectors(spark, str(tmp_path / "v"), [(i, v, 1, None, None, None) for i, v in rows])
    compared = []
    monkeypatch.setattr(binarycodes, "tiled", lambda members, *a: compared.append(members.count()) or tiled(members, *a))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in binarycodes.near_vectors(df, tile=40).collect()), key=repr)
    assert got == brute_vectors(rows)[0]
    assert compared == [62]


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x = np.concatenate([x, x + rng.standard_normal((400, 64)) * 0.3, x + rng.standard_normal((400, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = binarycodes.encode(x)
    assert codes.dtype == np.uint8 and codes.shape == (1200, 32) and factors.shape == (1200, 4)  # 4 bits a dimension
    true = x @ x.T
    for low, high in ((-1, 0.3), (0.6, 0.8), (0.9, 0.99)):
        at = (true >= low) & (true < high)
        guess, error = binarycodes.estimate(codes, factors, 64, max(low, 0))
        off = (guess - true)[at]
        assert abs(off.mean()) < 0.02
        assert (np.abs(off) <= binarycodes.SIGMAS * error[at]).mean() > 0.999


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 64, 300])
def test_open_pairs_hold_all_links_of_their_table(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim))
    x[::2] = x[1::2] + rng.standard_normal((150, dim)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = rng.integers(0, 2, 300)
    keys = binarycodes.bucket_keys(x, 3, 4)
    links = np.triu(x @ x.T >= 0.9, 1)
    met = (keys[:, None, :2] == keys[None, :, :2]).any(axis=2)
    codes, factors = binarycodes.encode(x)
    for one in (True, False):
        i, j = binarycodes.open_pairs(codes, factors, dim, keys, 2, block, one, 0.9)
        asked = links & ~met & (one | (block[:, None] != block[None, :]))
        got = np.zeros_like(links)
        right = binarycodes.exact_links(x, i, j, 0.9)
        got[i[right], j[right]] = True
        assert (got == asked).all()
        if dim == 64:
            assert len(i) < 400  # of 44,850 pairs


def test_only_rows_with_open_pairs_fetch_their_vectors(spark, tmp_path, monkeypatch):
    """Tables move codes, not vectors; of 800 vectors without a near one and 40 copies with a slight change only the latter are fetched."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, 64))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*x, *(x[:40] + rng.standard_normal((40, 64)) * 0.1)])]
    df = vectors(spark, str(tmp_path / "v"), [(i, v, 1, None, None, None) for i, v in rows])
    steps = []
    inner = binarycodes.by_group
    monkeypatch.setattr(binarycodes, "by_group", lambda d, *a: steps.append((d.columns, d.count())) or inner(d, *a))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in binarycodes.near_vectors(df, tile=200).collect()), key=repr)
    assert got == brute_vectors(rows)[0]
    assert "v" not in steps[0][0] and steps[0][1] >= 840
    assert "v" in steps[1][0] and steps[1][1] <= 100


def test_chunks_follow_content():
    rnd = random.Random(5)
    raw = "".join(rnd.choices("abc déf.ß ", k=5000)).encode()
    ends = chunkdedup.chunk_ends(raw)
    assert ends[-1] == len(raw) and all(raw[a:b].decode() is not None for a, b in zip([0, *ends], ends))
    assert max(np.diff([0, *ends])) <= chunkdedup.MAX_BYTES and min(np.diff([0, *ends])[:-1]) >= chunkdedup.MIN_BYTES - 3
    pieces = {raw[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"inserted " + raw
    again = {moved[a:b] for a, b in zip([0, *chunkdedup.chunk_ends(moved)], chunkdedup.chunk_ends(moved))}
    assert len(pieces & again) > 0.9 * len(pieces)
    assert chunkdedup.chunk_ends("é".encode() * 500)[-1] == 1000
    slow = 0
    data = np.frombuffer(raw[:300], np.uint8)
    for i, b in enumerate(data):
        slow = ((slow << 1) + int(chunkdedup._GEAR[b])) & 0xFFFF
        assert int(chunkdedup.gear_hash(data)[i]) == slow


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмноп", "天地玄黄宇宙洪荒日月盈昃"])
def test_passages_of_51_words_are_found(letters):
    """Each of hundreds of passages, set into different texts, leaves a run of MIN_RUN repeated bytes."""
    rnd = random.Random(8)
    fill = lambda n: " ".join("".join(rnd.choices(letters, k=rnd.randrange(2, 7))) for _ in range(n))
    for _ in range(600):
        passage = fill(51)
        chunks = []
        for _ in range(2):
            raw = f"{fill(rnd.randrange(20, 90))} {passage} {fill(rnd.randrange(20, 90))}".encode()
            ends = chunkdedup.chunk_ends(raw)
            chunks.append([raw[a:b] for a, b in zip([0, *ends], ends)])
        run = longest = 0
        for c in chunks[1]:
            run = run + len(c) if c in chunks[0] else 0
            longest = max(longest, run)
        assert longest >= chunkdedup.MIN_RUN


def test_repeated_passages(docs):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=rnd.randrange(2, 9)))
    fill = lambda n: " ".join(word() for _ in range(n))
    passages = [fill(60) for _ in range(12)]
    notice = fill(8)
    rows, holders = [], {}
    for i in range(90):
        if i % 3 == 0:
            p = (i // 3) % 12
            holders.setdefault(p, []).append(i)
            rows.append((i, f"{fill(40)} {passages[p]} {fill(30)}"))
        else:
            rows.append((i, f"{fill(80)} {notice} {fill(20)}"))
    rows += [(200, None), (201, ""), (202, "x"), (203, rows[1][1]), (None, rows[2][1]), (204, fill(30_000))]
    found = {r.doc_id: r for r in chunkdedup.repeated_passages(docs(*rows)).collect()}
    assert set(found) == {i for ids in holders.values() for i in ids[1:]} | {203, None}
    texts = dict(rows)
    for i, r in found.items():
        text = texts[i]
        cut = "".join(text[a:b] for a, b in zip([0, *[s.end for s in r.spans]], [*[s.start for s in r.spans], len(text)]))
        assert cut == r.text and len(text.encode()) - len(r.text.encode()) == r.removed_bytes
        for p, ids in holders.items():
            if i in ids:
                gone = sum(max(0, min(s.end, text.index(passages[p]) + len(passages[p])) - max(s.start, text.index(passages[p]))) for s in r.spans)
                assert gone > 0.5 * len(passages[p])
    # chunks before and after equal those of a plain pass over all documents in order
    seen = set()
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw, start, removed, run = (text or "").encode(), 0, 0, 0
        for end in [*chunkdedup.chunk_ends(raw)]:
            run, removed = (run + end - start, removed) if raw[start:end] in seen else (0, removed + (run if run >= chunkdedup.MIN_RUN else 0))
            seen.add(raw[start:end])
            start = end
        removed += run if run >= chunkdedup.MIN_RUN else 0
        assert removed == (found[i].removed_bytes if i in found else 0)
    assert chunkdedup.repeated_passages(docs()).count() == 0
    assert isinstance(found[203].spans, list) and pa is not None


def _near_texts(n=24):
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(words[i // 4 * 50:][:60 + i % 4])) for i in range(n)]


def test_join_keys_travel_in_ten_bytes(spark, docs):
    rows = _near_texts()
    none = np.zeros(0, np.uint64)
    packed = paritysketch.join_keys(docs(*rows), none).collect()
    n = sum(len(paritysketch._chosen(paritysketch.shingles(t), none)[0]) for t in {t for _, t in rows})
    assert sum(len(r["keys"]) for r in packed) == 4 * n and sum(len(r["classes"]) for r in packed) == 6 * n
    assert {len(r["keys"]) // 4 - len(r["classes"]) // 6 for r in packed} == {0}


def test_cut_keys_and_classes_give_the_same_links(spark, docs, monkeypatch):
    """With a few bits only, most keys fall together and some classes have one name: candidates more, links the same."""
    rows = _near_texts()
    for name, value in (("BUCKET_BITS", 3), ("KEY_BYTES", 1), ("CLASS_BYTES", 2)):
        monkeypatch.setattr(paritysketch, name, value)
    assert near_rows(paritysketch.jaccard_components(docs(*rows))) == sorted(brute(rows), key=repr)
