"""Exact duplicates by a stateful stream (built-in operators only).

Fingerprints (digest, id, row locator) stream into an aggregation keyed by digest. Its state lives in
the RocksDB state store on the executors' disks, has no watermark and so never expires, and keeps per
digest the identifier that stays, where its row is, and how many rows came. A hit, i.e. a digest
with more than one row, is believed only after the full texts were grouped by their bytes.

Defined cases: a null text counts as empty; a null id sorts below all ids; rows with the same id and
the same text are told apart by their locator, one of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import only_listed, scanned, with_row_key, without_rows
from beaconry.session import work_path

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes megabytes before its first row
}
_LOWEST = -(2**63)


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def run_stream(
    spark: SparkSession, fingerprints: str, state_out: str, checkpoint: str, max_files: int | None = None
) -> None:
    """Feed all new fingerprint files of a folder through the keyed state, then stop.

    Called again with the same checkpoint it goes on where it ended: only new files are read, old
    digests are still known. Each micro-batch replaces its own folder, so a replayed one counts once.
    """
    stream = spark.readStream.schema("doc_id bigint, digest binary, row_key bigint")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    state = stream.parquet(fingerprints).groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row_key", F.coalesce("doc_id", F.lit(_LOWEST))).alias("keep_row"),
        F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_out}/batch={number}")

    with _settings(spark, _STATE_CONF):
        query = (state.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def latest_state(spark: SparkSession, state_out: str) -> DataFrame:
    """The newest row of every digest; counts and kept ids only grow, so the largest count is the newest."""
    rows = spark.read.schema(
        "digest binary, keep_id bigint, keep_row bigint, group_size bigint, batch int").parquet(state_out)
    return rows.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max_by("keep_row", "group_size").alias("keep_row"),
        F.max("group_size").alias("group_size"))


def exact_duplicates(
    docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text", max_files: int | None = None
) -> DataFrame:
    """One row per document: doc_id, row_key, keep_id, group_size, kept, text_sha256.

    ``digest`` maps a text column to a binary column; texts that share a digest but not their bytes
    are separated by the byte check.
    """
    spark = docs.sparkSession
    base = work_path(spark, "exactdedup")
    source = with_row_key(scanned(docs), "_row_key").select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col("_row_key").alias("row_key"))
    keyed = source.withColumn("digest", digest(F.col("text")))
    prints = keyed.select("doc_id", "digest", "row_key", *([] if digest is sha256 else [
        sha256(F.col("text")).alias("sha")]))
    prints.write.parquet(f"{base}/prints")
    run_stream(spark, f"{base}/prints", f"{base}/state", f"{base}/checkpoint", max_files)
    if not prints.sparkSession.read.schema(prints.schema).parquet(f"{base}/prints").limit(1).count():
        return spark.createDataFrame(
            [], "doc_id bigint, row_key bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    rows = spark.read.schema(prints.schema).parquet(f"{base}/prints")
    latest_state(spark, f"{base}/state").where("group_size > 1").write.parquet(f"{base}/groups")
    groups = spark.read.parquet(f"{base}/groups")

    # full bytes of every hit: equal texts meet before the shuffle, so a hot text travels once per task
    classes = only_listed(keyed, groups, "digest", groups.count()).groupBy("digest", "text").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row_key", F.coalesce("doc_id", F.lit(_LOWEST))).alias("keep_row"),
        F.count("*").alias("group_size"))
    collided = classes.groupBy("digest").count().where("count > 1").select("digest")
    collided.write.parquet(f"{base}/collided")
    collided = spark.read.parquet(f"{base}/collided")
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    cols = ["doc_id", "row_key", "keep_id", "keep_row", "group_size", "text_sha256"]
    n_collided = collided.count()
    plain = rows if not n_collided else rows.join(collided, "digest", "left_anti")
    found = plain.withColumn("text_sha256", F.lower(F.hex(sha))).join(groups, "digest", "left").select(
        "doc_id", "row_key", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        .alias("keep_id"), F.coalesce("keep_row", "row_key").alias("keep_row"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256")
    if n_collided:
        mixed = only_listed(keyed, collided, "digest", n_collided).join(
            classes.join(collided, "digest", "left_semi"), ["digest", "text"])
        mixed = mixed.select(keyed["doc_id"], keyed["row_key"], classes["keep_id"], classes["keep_row"],
                             classes["group_size"], F.lower(F.hex(sha256(F.col("text")))).alias("text_sha256"))
        found = found.select(*cols).union(mixed.select(*cols))
    return found.select("doc_id", "row_key", "keep_id", "group_size",
                        (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of equal texts the one with the largest doc_id."""
    docs = scanned(docs)
    return without_rows(docs, exact_duplicates(docs).where("not kept"))
