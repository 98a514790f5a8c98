"""The stages of the pipeline against plain Python, and the registration of the queries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beaconry.llm import mixing
from beaconry.llm.queries import QUERIES
from tests.llm.test_near import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, copied and nearly copied documents of three sources and none, with nulls and empty texts."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("bcdfghaeiou", k=rnd.randrange(3, 8)))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rnd.choice([8, 40, 120]))]
        if i % 6 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["zorkface", "zorkling"])
        text = " ".join(w)
        if i % 10 == 3:
            text = rows[-1][1]  # a copy
        elif i % 10 == 5 and len(rows[-2][1].split()) >= 40:
            again = rows[-2][1].split()
            again[3] = word()
            text = " ".join(again)  # a near copy
        rows.append((i, text, "en", (None, "a", "b", "hot", "hot", "hot")[i % 6]))
        labels.append((i, 1, int("zork" in text)))
    rows += [(240, None, None, None), (241, "", "en", "a"), (None, "clean words without an id", "en", "b")]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_equal_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "pieces"]
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(out)
        after = [tuple(r) for r in docs.collect()]
        results.append((before, after))
        if k < 4:
            assert docs.columns == COLUMNS

    before, after = results[0]
    assert Counter(after) == Counter(r for r in before if "zork" not in (r[1] or ""))

    before, after = results[1]
    largest = defaultdict(list)
    for r in before:
        largest[r[1] or ""].append(r)
    want = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in largest.values()]
    assert Counter(after) == Counter(want)

    before, after = results[2]
    part = {i: c for i, n, c in brute([(r[0], r[1]) for r in before]) if n}
    assert sorted((r[0] for r in after), key=repr) == sorted((r[0] for r in before if r[0] not in part or part[r[0]] == r[0]), key=repr)
    assert len(after) < len(before)

    before, after = results[3]
    plan = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    seen = Counter(r[0] for r in after)
    for r in before:
        size, taken = plan[r[0]]
        assert seen[r[0]] == (1 if not size else math.ceil(taken / size))
    assert set(after) <= set(before)

    before, after = results[4]
    assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
    assert all(docs.select(F.col("round_trip")).distinct().first())


def test_run_gives_what_the_stages_give(spark, folder):
    """Two runs agree, and the columns are those of the last stage."""
    first = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_pieces", "scores", "ids"} <= set(first.columns)
    rows = sorted(((r.doc_id, r.n_pieces) for r in first.collect()), key=repr)
    assert rows == sorted(((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    numbers = {n.split("_")[0] for n in QUERIES}
    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} == numbers
