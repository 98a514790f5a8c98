"""Mixing sources to target weights by Efraimidis-Spirakis sampling (built-in operators only).

A source's target is its share of the mix by weight, at most ``cap`` times its own size. A target of
e.g. 1.4 times the source takes one complete epoch of every document; the remaining 0.4 is drawn
without replacement: documents are ordered by -ln(u)/quality, with u a hash of the id, and taken until
the budget of words is used up; the document at the edge gives its first words only.

No source is sorted whole: keys fall into buckets of their logarithm, bucket sums give the one bucket
per source in which the budget ends, and only that bucket is ordered.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null id is
hashed as the empty text; equal keys are ordered by id; a source of size 0 has target 0; an empty table
gives an empty result. A quality that is null or not positive counts as the lowest, 0.01.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import WORD_PATTERN, free_name, scanned, with_row_key
from beaconry.session import stored

#: Key buckets per doubling of the key: one bucket holds at most about 0.03 % of a source's rows.
BUCKETS_PER_OCTAVE = 1024


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def plausible_word_length(text: Column, size: Column) -> Column:
    """Quality weight: 1 where characters per word (with its space) are 7, less the further off, at least 0.1."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) / (1.0 + F.abs(F.coalesce(mean, F.lit(0.0)) - 7.0) / 7.0))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> target; weights repeat over the sources in order of code points, null last.

    Sources whose cap lies below their share are filled first: in order of cap / weight, a source is
    capped if the words left over, dealt by the weights left over, would lift it above its cap.
    One row per source is all that is ordered here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("_n", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(pick, (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int")))
    whole = Window.partitionBy(F.lit(1))
    up_to = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = (w.withColumn("_cap", cap * F.col("source_size").cast("double"))
         .withColumn("_ratio", F.col("_cap") / F.col("weight"))
         .withColumn("_total", share * F.sum(F.col("source_size").cast("double")).over(whole))
         .withColumn("_weights", F.sum("weight").over(whole))
         .withColumn("_caps_before", F.sum("_cap").over(up_to) - F.col("_cap"))
         .withColumn("_weights_before", F.sum("weight").over(up_to) - F.col("weight"))
         .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
         .withColumn("_capped", F.col("_level") >= F.col("_ratio"))
         .withColumn("_open_level", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_n", "_level"))).over(whole)))
    return w.select("source", "source_size", "weight", F.when(
        F.col("_capped"), F.col("_cap")).otherwise(F.col("_open_level._level") * F.col("weight")).alias("target"))


def es_key(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality with u in (0, 1) from 52 bits of md5(seed:id)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.ln(u) / F.greatest(F.coalesce(quality, F.lit(0.01)), F.lit(0.01))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0,
    seed: str = "mix", quality: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, row_key, source, size, source_size, target, taken.

    ``quality``: a column of ``docs`` or an expression over it; by default plausible_word_length(text).
    """
    size = words(F.col("text"))
    thin = with_row_key(scanned(docs), "_row_key").select(
        F.col("doc_id"), F.col("_row_key").alias("row_key"), F.col("source"), size.alias("size"),
        (plausible_word_length(F.col("text"), size) if quality is None else quality).alias("_quality"))
    thin = stored(thin.select("doc_id", "row_key", "source", "size", es_key(
        F.col("doc_id"), F.col("_quality"), seed).alias("key")), "mix")
    # the bucket never falls as the key rises; a key of 0 cannot occur since u < 1
    thin = thin.withColumn("bucket", F.floor(F.log2("key") * BUCKETS_PER_OCTAVE).cast("bigint"))

    sums = stored(thin.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mixsums")
    per_source = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(per_source, weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")).withColumn(
        "budget", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("bucket_size").over(run) - F.col("bucket_size"))
    same = goal["source"].eqNullSafe(sums["source"])
    # the last bucket that starts below the budget is the one the budget may end in
    edge = goal.join(sums, same, "left").where((F.col("before") < F.col("budget")) | (F.col("budget") <= 0)).groupBy(
        goal["source"].alias("s"), "source_size", "target", "epochs", "budget").agg(
        F.max(F.struct("bucket", "before")).alias("e"))
    edge = stored(edge.select("s", "source_size", "target", "epochs", "budget",
                              F.col("e.bucket").alias("edge"), F.col("e.before").alias("edge_before")), "mixedge")
    rows = thin.join(edge, thin["source"].eqNullSafe(edge["s"])).drop("s")
    cols = ["doc_id", "row_key", "source", "size", "source_size", "target"]
    open_ = F.col("budget") > 0
    clear = rows.where(~open_ | (F.col("bucket") != F.col("edge"))).select(
        *cols, (F.col("epochs") * F.col("size") + F.when(
            open_ & (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(0)).alias("taken"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "row_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tight = rows.where(open_ & (F.col("bucket") == F.col("edge"))).withColumn(
        "left", F.col("budget") - F.col("edge_before") - F.sum("size").over(inside) + F.col("size"))
    tight = tight.select(*cols, (F.col("epochs") * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("left")))).alias("taken"))
    return clear.union(tight)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each time that words of it are taken.

    A draw of part of a document counts as a draw of the document, so texts stay whole; documents
    of which nothing is taken go, and documents without any word, which no draw can choose, stay once.
    """
    docs = scanned(docs)
    key, n = free_name(docs, "_row_key"), free_name(docs, "_draws")
    draws = mix(docs, **settings).select(F.col("row_key").alias(key), F.when(F.col("size") == 0, 1).otherwise(
        F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int").alias(n)).where(F.col(n) != 1)
    joined = with_row_key(docs, key).join(draws, key, "left").drop(key)
    times = F.coalesce(n, F.lit(1))
    return joined.where(times > 0).withColumn(n, F.explode(F.sequence(F.lit(1), times))).drop(n)
