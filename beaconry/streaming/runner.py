"""Running a stream to the end of the available input, with replay-safe output."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from beaconry.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def utc_instant(ts: Column) -> Column:
    """A zone-free timestamp as the instant it names in UTC, whatever the session's zone is.

    Watermarks refuse zone-free timestamps, so every stream passes through here.
    """
    seconds = (F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
               + F.hour(ts) * 3600 + F.minute(ts) * 60)
    return F.timestamp_seconds(seconds.cast("decimal(20,6)") + F.extract(F.lit("SECOND"), ts))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream over a Parquet table, be it a folder or one file; the schema comes from the table.

    The last letter is written as a pattern, since the file source takes one file only that way.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


@contextmanager
def rocksdb_state(spark: SparkSession, expiring: bool = False):
    """Custom state needs the RocksDB store; the session gets its own settings back afterwards.

    State that expires by the clock would ask for empty batches for ever; with ``expiring`` there are none, and
    expiry happens with the batches that bring data.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if expiring:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@dataclass
class Dropped(StreamingQueryListener):
    """What stateful operators dropped as late, told by the progress of every batch; one entry per batch and operator."""

    rows: list[tuple[int, str, int]] = field(default_factory=list)
    ended: threading.Event = field(default_factory=threading.Event)
    query: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if self.query in (None, str(event.progress.runId)):
            self.rows += [(event.progress.batchId, op.operatorName, op.numRowsDroppedByWatermark)
                          for op in event.progress.stateOperators]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.query in (None, str(event.runId)):
            self.ended.set()


def run(
    stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None,
    out: str | None = None, checkpoint: str | None = None,
    carry: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] | None = None, late: str | None = None,
) -> DataFrame:
    """Process everything available and return what was written, with the number of its batch.

    Every batch owns one folder and overwrites it, so a batch that is replayed after a failure is
    not counted twice. ``each`` may turn a batch into the rows to write. With the ``out`` and ``checkpoint`` of an
    earlier run the stream goes on where that run ended, and its output is part of the result; without them both are new.

    ``carry`` is for state that is a table: it gets a batch and the table that the batch before left (none at first), and returns the
    rows to write and the table for the batch after. Tables have a folder per batch beside the checkpoint, so a replay
    starts from the same one.

    ``late`` is a folder that gets rows (batch_id, operator, dropped): how many rows each operator dropped past the watermark.
    """
    if (out is None) != (checkpoint is None):
        raise ValueError("output and checkpoint belong together")
    spark = stream.sparkSession
    out, checkpoint = out or work_path(spark, name), checkpoint or work_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        if carry:
            tables = f"{checkpoint.rstrip('/')}-tables"
            rows, after = carry(batch, batch.sparkSession.read.parquet(f"{tables}/{number - 1}") if number else None)
            after.write.mode("overwrite").parquet(f"{tables}/{number}")
        else:
            rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    dropped = Dropped()
    if late:
        spark.streams.addListener(dropped)
    try:
        query = (stream.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        dropped.query = str(query.runId)
        query.awaitTermination()
        if late:
            dropped.ended.wait(60)  # events reach listeners after the query has ended
            spark.createDataFrame(dropped.rows, "batch_id bigint, operator string, dropped bigint").write.mode("append").parquet(late)
    finally:
        if late:
            spark.streams.removeListener(dropped)
    return spark.read.parquet(out)


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last version of every key after update-mode output."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_r")).select(*keys, "_r.*")
