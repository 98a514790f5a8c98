"""Exact dedup and mixing against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from beaconry.llm import common, exactdedup, mixing, paritysketch


def exact_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


EDGE = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b " * 50_000), (6, "b " * 50_000), (7, "A"), (None, "a"), (2, "a"), (8, "a ")]


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids), len(groups[t or ""]), None, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")])
def test_exact_groups_even_when_digests_collide(docs, digest):
    got = exact_rows(exactdedup.exact_duplicates(docs(*EDGE), digest=digest))
    assert [(*r[:3], None, r[4]) for r in got] == sorted(expected_exact(EDGE), key=lambda r: repr((*r[:3], 0, r[4]))) or \
        sorted(map(repr, [(*r[:3], None, r[4]) for r in got])) == sorted(map(repr, expected_exact(EDGE)))
    stays = defaultdict(int)
    for r in got:
        stays[r[4]] += r[3]
        assert not r[3] or r[0] == r[1]
    assert set(stays.values()) == {1}  # one row stays of each text, repeated rows included


def test_exact_dedup_keeps_columns_and_one_row(docs):
    df = docs(*EDGE)
    kept = exactdedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 8]


def test_exact_dedup_empty(docs):
    assert exactdedup.exact_duplicates(docs()).count() == 0
    assert exactdedup.drop_exact_duplicates(docs()).count() == 0


def test_stream_state_survives_restart(spark, tmp_path):
    """Files that come later meet digests of files read before: the state is kept between runs, without expiry."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    prints = rows.select("doc_id", exactdedup.sha256(F.col("text")).alias("digest"), F.col("doc_id").alias("row_key"))
    prints.write.parquet(folder)
    exactdedup.run_stream(spark, folder, out, check)
    prints.withColumn("doc_id", F.col("doc_id") + 10).withColumn("row_key", F.col("doc_id")).write.mode("append").parquet(folder)
    exactdedup.run_stream(spark, folder, out, check, max_files=1)
    got = sorted((r.keep_id, r.keep_row, r.group_size) for r in exactdedup.latest_state(spark, out).collect())
    assert got == [(11, 11, 2), (12, 12, 2)]


def brute_mix(rows, quality, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    per = defaultdict(list)
    for i, _, _, s in rows:
        per[s].append(i)
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + ([None] if None in per else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in per[s]) for s in names}
    left, open_, target = share * sum(total.values()), set(names), {}
    while True:  # deal, cap, deal the excess again
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * total[s]]
        if not over:
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * w[s] for s in open_}
    taken = {}
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget = round(target[s]) - epochs * total[s]

        def key(i):
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / quality

        for i in sorted(per[s], key=key):
            draw = max(0, min(size[i], budget))
            budget -= draw
            taken[i] = epochs * size[i] + draw
    return {i: (size[i], total[s], round(target[s], 6), taken[i]) for i, _, _, s in rows}


def mix_rows(n=120):
    rows = [(i, " ".join(["w"] * (i % 17)), None, ("b", "a", "hot", "hot", "hot", None)[i % 6]) for i in range(n)]
    return rows + [(n, None, None, "a"), (n + 1, "x " * 30_000, None, "big"), (n + 2, "", None, "empty")]


def test_mix_equals_brute_force(docs):
    rows = mix_rows()
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken)
           for r in mixing.mix(docs(*rows), quality=F.lit(0.5)).collect()}
    assert got == brute_mix(rows, 0.5)
    again = {r.doc_id: r.taken for r in mixing.mix(docs(*rows), quality=F.lit(0.5)).collect()}
    assert again == {i: v[3] for i, v in got.items()}
    per = defaultdict(int)
    for i, _, _, s in rows:
        per[s] += got[i][3]
        assert got[i][3] <= 2 * got[i][0]
    for i, _, _, s in rows:
        assert abs(per[s] - got[i][2]) <= 1


def test_mix_repeated_rows_and_empty(docs):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", None, None), (None, None, None, None)]
    got = mixing.mix(docs(*rows)).collect()
    assert len(got) == 4 and sum(r.taken for r in got if r.source == "s") == round(got[0].target if got[0].source == "s" else [r for r in got if r.source == "s"][0].target)
    assert mixing.mix(docs()).count() == 0
    assert mixing.mixed(docs()).count() == 0


def test_mixed_repeats_and_drops(docs):
    rows = mix_rows()
    df = docs(*rows)
    plan = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    for i, (size, taken) in plan.items():
        assert seen[i] == (1 if not size else math.ceil(taken / size))


def test_better_documents_are_drawn_more_often(docs):
    rows = [(i, "w " * 10, None, "s" if i < 4000 else "t") for i in range(5000)]
    df = docs(*rows).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    # source t is weighed up, so that s is drawn in part
    got = mixing.mix(df, weights=(1.0, 20.0), share=0.5, quality=F.col("good")).where("source = 's'")
    n = {r.even: r.n for r in got.where("taken > 0").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(
        F.count("*").alias("n")).collect()}
    assert n[True] > 1.5 * n[False]


def test_rows_multiplied_joined_or_shuffled_after_the_scan_are_told_apart(spark, tmp_path):
    """Three rows of a file made six, joined, or dealt anew: each filter keeps one row of a text, the mix all draws."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "some other words that stand alone here"]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    assert common.scanned(scan) is scan
    thin = scan.where("doc_id >= 0").select("doc_id", "text", "source")
    assert common.scanned(thin) is thin
    twice = scan.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    joined = scan.join(spark.range(2).withColumnRenamed("id", "copy"))
    for frame in (twice, joined, twice.repartition(3), scan.union(scan), scan.withColumn("copy", F.lit(1)).union(twice)):
        n = frame.count()
        again = common.scanned(frame)
        assert again is not frame and again.count() == n and again.columns == frame.columns
        for kept in (exactdedup.drop_exact_duplicates(frame), paritysketch.drop_near_duplicates(frame)):
            assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
        assert exactdedup.exact_duplicates(frame).where("kept").count() == 3
        assert mixing.mix(frame).select("row_key").distinct().count() == n
        drawn = mixing.mixed(frame, share=2.0)
        assert drawn.count() == 2 * n
