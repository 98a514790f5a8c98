"""Hot keys, forced block paths and edge tables, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.functions import histograms, ordered, sequences
from beaconry.operators import chains, drift, finance, history, outlier_forest, profile, retrieval, search, tenants, training


def test_previous_row_and_last_known_over_blocks(frame):
    rows = [("hot", i, None if i % 3 else i) for i in range(300)] + [("b", 5, 1), ("b", 250, None)]
    df = frame("k string, o int, v int", *rows)
    block = F.floor(F.col("o") / 10)
    got = {(r["k"], r["o"]): (r["prev_o"], r["seen"]) for r in sequences.last_known(
        sequences.previous_row(df, ["k"], "o", block, ["o"]), ["k"], "o", block, "v", "seen").collect()}
    last: dict[str, tuple] = {}
    for k, o, v in sorted(rows):
        before, seen = last.get(k, (None, None))
        assert got[(k, o)] == (before, seen)
        last[k] = (o, v if v is not None else seen)


def test_lookup_keeps_every_row(frame):
    facts = frame("id int, k string", *[(i, "hot" if i % 3 else f"k{i}") for i in range(300)])
    dim = frame("k string, name string", ("hot", "h"), ("k3", "three"))
    got = sequences.lookup(facts, dim, ["k"])
    assert got.count() == 300 and got.where("name = 'h'").count() == facts.where("k = 'hot'").count()


@pytest.mark.parametrize("direct", [1, 20_000])
def test_quantiles_equal_numpy(spark, monkeypatch, direct):
    monkeypatch.setattr(histograms, "DIRECT_ROWS", direct)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 4, 3000), np.full(2000, 7.0), [-1e12, 1e15]])
    df = spark.createDataFrame([(float(v), float("nan") if i % 5 == 0 else float(i), None) for i, v in enumerate(x)],
                               "a double, b double, c double")
    got = histograms.exact_quantiles(df, ["a", "b", "c"], {"median": 0.5, "high": 0.95})
    assert "c" not in got
    b = np.array([i for i in range(len(x)) if i % 5])
    for name, values in (("a", x), ("b", b)):
        assert got[name]["median"] == pytest.approx(np.percentile(values, 50), rel=1e-12)
        assert got[name]["high"] == pytest.approx(np.percentile(values, 95), rel=1e-12)


def test_infinite_values_do_not_break_quantiles(frame):
    df = frame("a double", (float("-inf"),), (1.0,), (2.0,), (3.0,), (float("inf"),))
    assert histograms.exact_quantiles(df, ["a"], {"m": 0.5, "top": 1.0}) == {"a": {"m": 2.0, "top": float("inf")}}


def brute_ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    return float(np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b))))


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_ks_with_a_hot_value_and_heavy_tail(spark, rows_per_task):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.lognormal(0, 3, 1500), np.full(900, 2.0)])
    b = np.concatenate([rng.lognormal(0.2, 3, 1700), np.full(700, 2.0)])
    rows = [(float(v), "baseline") for v in a] + [(float(v), "current") for v in b] + [(None, "current"), (float("nan"), "baseline")]
    got = drift.ks_drift_sides(spark.createDataFrame(rows, "x double, side string"), "side", "baseline", ["x"],
                               rows_per_task=rows_per_task).first()
    assert got["ks_statistic"] == pytest.approx(round(brute_ks(a, b), 6), abs=1e-9)


def test_running_totals_blocks_equal_one_block(spark):
    df = spark.range(3000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"), F.col("id").alias("n"))
    one = ordered.running_totals(df, "g", "v", ["n"], ordered.Cuts({"all": []}))
    cuts = ordered.Cuts({"all": ordered.find_cuts(df, ["v"], 10).points["v"]})
    many = ordered.running_totals(df, "g", "v", ["n"], cuts)
    assert not cuts.single_block and one.exceptAll(many.select(*one.columns)).isEmpty()
    placed = ordered.positions(df.select("v"), "v", 10).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(3000))
    assert [r["v"] for r in placed] == sorted(r["v"] for r in placed)


def brute_top(questions, items, k):
    out = {}
    for q, qv in questions.items():
        scored = sorted((-len(qv & v) / math.sqrt(len(qv) * len(v)) if qv and v else 0.0, key) for key, v in items.items())
        out[q] = [key for _, key in scored[:k]]
    return out


def made_sets(n_items, n_questions, seed=1, buckets=40):
    rng = np.random.default_rng(seed)
    items = {(i, 0): ({1, 2, 3} if i % 3 == 0 else set(map(int, rng.choice(buckets, rng.integers(0, 9), False)))) for i in range(n_items)}
    questions = {str(i): set(map(int, rng.choice(buckets, rng.integers(0, 7), False))) for i in range(n_questions)}
    return items, questions


def framed(spark, items, questions):
    queries = spark.createDataFrame([(q, sorted(v)) for q, v in questions.items()], "query_key string, vector array<int>")
    table = spark.createDataFrame([(*k, sorted(v)) for k, v in items.items()], "doc_id bigint, chunk_index bigint, vector array<int>")
    return queries, table


def top_of(found):
    got: dict = {}
    for r in found.orderBy("query_key", "place").collect():
        got.setdefault(r["query_key"], []).append((r["doc_id"], r["chunk_index"]))
    return got


@pytest.mark.parametrize("shipped", [0, 1 << 30])
def test_search_equals_brute_force_with_copies(spark, monkeypatch, shipped):
    for name, value in (("QUERIES_PER_BLOCK", 7), ("ITEMS_PER_BLOCK", 40), ("TILE", 16), ("SEED_ITEMS", 30), ("BANDS", 6), ("SHIPPED_BYTES", shipped)):
        monkeypatch.setattr(search, name, value)
    items, questions = made_sets(240, 20)
    queries, table = framed(spark, items, questions)
    assert top_of(search.search(queries, table.repartition(3), 5)) == brute_top(questions, items, 5)


@pytest.mark.parametrize("shipped", [0, 1 << 30])
def test_a_scope_hides_other_items(spark, monkeypatch, shipped):
    monkeypatch.setattr(search, "SHIPPED_BYTES", shipped)
    items, questions = made_sets(90, 6, seed=4)
    queries, table = framed(spark, items, questions)
    table = table.withColumn("scope", F.when(F.col("doc_id") % 4 == 0, "x").otherwise("y"))
    got = top_of(search.search(queries.withColumn("scope", F.when(F.col("query_key") < "3", "x")), table, 4))
    inside = {k: v for k, v in items.items() if k[0] % 4 == 0}
    want = brute_top({q: v for q, v in questions.items() if q < "3"}, inside, 4) | brute_top(
        {q: v for q, v in questions.items() if q >= "3"}, items, 4)
    assert got == want


def test_dense_search_on_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v, q = rng.standard_normal((150, 8)), rng.standard_normal((9, 8))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, vector array<double>")
    queries = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(q)], "query_key string, vector array<double>")
    score = (q @ v.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
    want = {(str(i), int(j)) for i in range(9) for j in np.argsort(-score[i])[:4]}
    for shipped in (0, 1 << 30):
        monkeypatch.setattr(search, "SHIPPED_BYTES", shipped)
        got = search.search(queries, table, 4, -1.0, ("vec_id",), dense=True).collect()
        assert {(r["query_key"], r["vec_id"]) for r in got} == want


def test_few_items_are_copied_and_few_pairs_multiplied(spark, monkeypatch):
    """Every question has items like it, most items are larger: these are neither copied in the second round nor multiplied."""
    rng = np.random.default_rng(6)
    asked = [sorted(map(int, rng.choice(256, 8, False))) for _ in range(300)]
    sets = [sorted({*q, *map(int, rng.choice(256, 2))}) for q in asked for _ in range(5)]
    sets += [sorted(map(int, rng.choice(256, rng.integers(40, 200), False))) for _ in range(2500)]
    table = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sets)], "doc_id bigint, chunk_index bigint, vector array<int>")
    queries = spark.createDataFrame([(str(i), s) for i, s in enumerate(asked)], "query_key string, vector array<int>")
    for name, value in (("QUERIES_PER_BLOCK", 50), ("SEED_ITEMS", 500), ("SHIPPED_BYTES", 0)):
        monkeypatch.setattr(search, name, value)
    copies, plain = [], search.deal

    def counting(*args):
        left, right = plain(*args)
        copies.append(right.count())
        return left, right

    monkeypatch.setattr(search, "deal", counting)
    got = top_of(search.search(queries, table, 5))
    blocks = -(-300 // 50)
    assert got == brute_top({str(i): set(s) for i, s in enumerate(asked)}, {(i, 0): set(s) for i, s in enumerate(sets)}, 5)
    assert len(copies) == 2 and sum(copies) < 0.5 * blocks * 4000  # without the bound: every item for every block of questions
    kernel = search.Kernel(queries.withColumn("scope", F.lit(None).cast("string")).toArrow(), 5, 0.0, False, 2)
    whole = table.withColumn("scope", F.lit(None).cast("string")).toArrow()
    kernel.meet(*search._items(whole, ("doc_id", "chunk_index"), False))
    assert kernel.multiplied < 0.6 * 300 * 4000  # a tile has 1,024 items, so the first ones are not only the nearest


def test_a_question_with_a_scope_meets_only_items_of_it():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    sets = [sorted(map(int, rng.choice(256, 20, False))) for _ in range(3000)]
    scopes = ["x" if i % 50 == 0 else "y" for i in range(3000)]
    asked = pa.table({"query_key": pa.array([0, 1]), "vector": pa.array(sets[:2], pa.list_(pa.int32())), "scope": pa.array(["x", "x"])})
    kernel = search.Kernel(asked, 3, 0.0, False, 1)
    kernel.meet(search.Vectors(pa.array(sets, pa.list_(pa.int32())), False), [np.arange(3000)], np.array(scopes, object))
    got = kernel.found(["i"]).to_pydict()
    for q in (0, 1):
        inside = sorted((-len(set(sets[q]) & set(sets[i])) / 20, i) for i in range(0, 3000, 50))
        assert [i for k, i in zip(got["query_key"], got["i"], strict=True) if k == q] == [i for _, i in inside[:3]]
    assert kernel.multiplied == 2 * 60


def test_counts_by_columns_of_bits_equal_sums():
    """Sets of all sizes, empty ones too, against items that fill no whole segment; ties and a lifted floor."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    sets = [sorted(map(int, rng.choice(256, rng.integers(0, 257), False))) for _ in range(1500)]
    vectors = search.Vectors(pa.array(sets, pa.list_(pa.int32())), False)
    member = np.zeros((1500, 256), np.int64)
    for i, s in enumerate(sets):
        member[i, s] = 1
    asked = np.array([i for i, s in enumerate(sets) if len(s) in (0, 1, 2, 3, 7, 40, 41, 255, 256)] + [5, 6, 7])
    bits = vectors.bits(np.arange(1500))
    planes = search.add_up(bits[b] for b in vectors.padded(asked).T)
    want = member[asked] @ member.T
    need = rng.integers(0, 60, (len(asked), 2))
    near = np.zeros((len(asked), 2048), bool)
    row, item, count = search.decoded(search.at_least(planes, need), planes)
    near[row, item] = True
    inside = item < 1500
    assert (count[inside] == want[row[inside], item[inside]]).all()
    assert (near[:, :1500] == (want >= need[:, np.arange(1500) // search.SEGMENT])).all()
    questions = pa.table({"query_key": pa.array(asked), "vector": pa.array([sets[i] for i in asked], pa.list_(pa.int32())),
                          "scope": pa.array([None] * len(asked), pa.string())})
    kernel = search.Kernel(questions, 4, 0.0, False, 1)
    kernel.meet(vectors, [np.arange(1500)], np.array([None] * 1500, object))
    got = kernel.found(["i"]).to_pydict()
    size = member.sum(axis=1)
    for n, q in enumerate(asked.tolist()):
        score = want[n] / np.sqrt(np.maximum(size[q] * size, 1))
        best = sorted(range(1500), key=lambda i: (-score[i], i))[:4]
        assert [i for k, i in zip(got["query_key"], got["i"], strict=True) if k == q] == best


def test_chunks_equal_a_fold(spark, tables):
    import re

    def fold(text, size=800, overlap=150):
        out, cur = [], ""
        for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\n{3,}", "\n\n", text.strip())):
            if len(cur) + len(s) + 1 <= size:
                cur = (cur + " " + s).strip()
            elif cur:
                out.append(cur)
                cur = (cur[max(0, len(cur) - overlap):].strip() + " " + s).strip()
            else:
                cur = s
        return out + [cur] if cur else out

    docs = tables.documents.select("doc_id", "text", retrieval.chunk_array(F.col("text")).alias("parts")).collect()
    for d in docs:
        assert d["parts"] == fold(d["text"])


def test_edge_tables(spark, frame):
    empty = frame("a double, s string")
    assert {r["missing_cells"] for r in profile.missing(empty).collect()} == {0}
    assert profile.numeric_summary(empty).first()["mean"] is None
    single = frame("a double, s string", (2.5, "x"))
    r = profile.numeric_summary(single).first()
    assert (r["mean"], r["median"], r["std"], r["skew"]) == (2.5, 2.5, None, None)
    holes = frame("a double, s string", (float("nan"), None), (None, None))
    assert {r["missing_cells"] for r in profile.missing(holes).collect()} == {2}
    assert profile.categorical_top(holes).count() == 0
    assert finance.exponential_smoothing(frame("series string, t int, y double, idx int")).count() == 0


def test_profile_holds_no_raw_rows(tables):
    text = profile.profile_json(tables.customer).first()["profile"]
    assert "sample" not in text and '"shape"' in text and '"numeric_summary"' in text


def test_fingerprint_ignores_order(tables):
    a = profile.fingerprint(tables.nation).first()
    b = profile.fingerprint(tables.nation.orderBy(F.desc("n_nationkey"))).first()
    assert a == b and a != profile.fingerprint(tables.region).first()


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    parts = training.stratified_split(df, "label", ["id"]).groupBy("label").agg(F.count_if("in_train").alias("n")).collect()
    assert {r["label"]: r["n"] for r in parts} == {0: 720, 1: 80}


def test_outlier_forest_finds_the_far_values(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 100 == 0, 50.0 + F.col("id") / 10).otherwise(1 + (F.col("id") % 17) / 50).alias("price_ratio"))
    hits = outlier_forest.detect(df, ["price_ratio"], ["id"], contamination=0.02, trees=30)
    found = hits.select("id", "price_ratio").collect()
    assert 1 <= len(found) <= 40 and all(r["price_ratio"] > 10 for r in found)
    assert hits.select("id").exceptAll(df.select("id")).isEmpty()


def test_registry_changes(frame):
    log = frame("tenant_id string, change_id int, changed_at string, action string, stable_model string, canary_model string, canary_weight double",
                ("a", 1, "2024-01-01", "register", "m1", None, 0.0), ("a", 2, "2024-01-02", "register", "m2", None, 1.5),
                ("b", 3, "2024-01-01", "deregister", None, None, None), ("b", 4, "2024-01-02", "register", "m", None, 0.1),
                ("b", 5, "2024-03-03", "deregister", None, None, None))
    assert [tuple(r) for r in tenants.current_registry(log).collect()] == [("a", "m1", None, 0.0)]
    assert {(r["change_id"], r["outcome"]) for r in tenants.deregistrations(log).collect()} == {(3, "not_found"), (5, "removed")}
    assert [r["change_id"] for r in tenants.rejected_changes(log).collect()] == [2]


def test_one_feature_scores_equal_the_tree_walk(spark):
    rows = [(i, float((i * 37) % 101) / 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, x double")
    nodes = outlier_forest.fit(df, ["x"], ["id"], trees=10, sample=64)
    trees: dict = {}
    for r in nodes.collect():
        trees.setdefault(r["tree_id"], {})[r["node"]] = r

    def walk(tree, x):
        at = tree[0]
        while at["feature"] >= 0:
            at = tree[at["left"] if x < at["cut"] else at["right"]]
        return at["path"]

    norm = float(outlier_forest.average_path(float(np.mean([next(iter(t.values()))["sample_size"] for t in trees.values()]))))
    for r in outlier_forest.score(df, ["x"], nodes).collect():
        want = 2 ** (-np.mean([walk(t, r["x"]) for t in trees.values()]) / norm)
        assert r["anomaly_score"] == pytest.approx(want, rel=1e-12)


def plain_chain(times, pause, start=None):
    out, last = [], None if start is None else start - pause
    for t in sorted(set(times)):
        if last is None or t - last >= pause:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("pause,block,per_span", [(7, 20, 3), (50, 50, 2), (3600, 86_400, 64)])
def test_triggers_equal_a_loop(spark, pause, block, per_span):
    rng = np.random.default_rng(pause)
    series = {"dense": list(range(-300, 900)), "sparse": sorted(map(int, rng.integers(0, 100_000, 60))),
              "one": [5], "edges": [0, 6, 7, 8, 20, 26, 27, 40, 59, 60, 66, 67, 119, 120, 127]}
    rows = [(k, t) for k, v in series.items() for t in v for _ in range(1 + t % 2)] + [(None, 3), ("one", None)]
    hits = spark.createDataFrame(rows, "m string, at bigint")
    got: dict = {}
    for r in chains.triggers(hits, "m", "at", pause, block_seconds=block, blocks_per_span=per_span).collect():
        got.setdefault(r["m"], []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_chain(v, pause) for k, v in series.items()}
    held = spark.createDataFrame([("dense", 100)], "m string, at bigint")
    late = chains.triggers(hits, "m", "at", pause, held, block, per_span).where("m = 'dense'").collect()
    assert sorted(r["at"] for r in late) == plain_chain([t for t in series["dense"] if t >= 100], pause)


def test_a_million_hits_without_a_pause(spark):
    """One model, a hit every second for eleven days and a half; no group holds more than a day."""
    hits = spark.range(1_000_000).select(F.lit("hot").alias("m"), (F.col("id") + 17).alias("at"))
    got = sorted(r["at"] for r in chains.triggers(hits, "m", "at", 3600).collect())
    assert got == plain_chain(range(17, 1_000_017), 3600)


def test_failed_tries_do_not_start_the_pause(spark):
    rng = np.random.default_rng(9)
    rows = [(m, int(t), bool(rng.random() < 0.7), bool(rng.random() < 0.4)) for m in ("a", "b") for t in rng.choice(5000, 400, False)]
    got = {(r["model_id"], r["at"]): r["decision"] for r in history.retrain_decisions(
        spark.createDataFrame(rows, "model_id string, at bigint, any_drift boolean, failed boolean"), 90).collect()}
    last: dict = {}
    for m, t, drift_, failed in sorted(rows):
        due = m not in last or t - last[m] >= 90
        want = "model_stable" if not drift_ else "cool_down_active" if not due else (
            "error:retraining failed" if failed else "retraining_triggered")
        if want == "retraining_triggered":
            last[m] = t
        assert got[m, t] == want
