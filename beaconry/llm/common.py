"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import io
import re
from collections.abc import Callable, Hashable, Iterator
from contextlib import redirect_stdout, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.session import stored

#: Words are maximal runs of anything but these six characters (fixed by the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows a broadcast key list may hold (16 bytes each or a little more); beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a task works on at once (one longer text is a part of its own).
PART_BYTES = 4_000_000
#: Longer words are not remembered by a worker, so that what it remembers is bounded in bytes.
MEMO_CHARS = 100


_held: dict[Hashable, object] = {}


def worker_model(key: Hashable, make: Callable[[], object]):
    """The model ``key`` of this Python worker, made where it is not there; a worker keeps one model of all operators together."""
    if key not in _held:
        release_models()
        _held[key] = make()
    return _held[key]


def release_models() -> None:
    """Give the memory of the worker's model back before work that needs none."""
    if _held:
        _held.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # other systems give it back by themselves
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def freed(*tables: DataFrame) -> None:
    """Delete the folders of stored intermediate tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shuffles_dropped(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are stored by now: it does so when the driver collects its garbage, which
    on a large heap may be after the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True for rows kept away from learning: crc32 of the id as text, modulo 5, is 0 (null id: True)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a file scan, projected or filtered at most; anything else is written once and read back.

    Only then do file and position tell its rows apart: rows multiplied or moved after the scan would share a position, or be
    numbered anew by a repeated task.
    """
    plan = io.StringIO()
    with redirect_stdout(plan):
        df.explain("extended")
    analysed = plan.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    nodes = re.findall(r"^[\s:|+-]*([A-Z]\w+)", analysed.split("\n", 2)[2], re.MULTILINE)  # after the line of columns
    if set(nodes) <= {"Relation", "Project", "Filter", "SubqueryAlias", "View"} and nodes.count("Relation") == 1:
        return df
    return stored(df, "scanned")


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add a long that tells rows apart: file and row position where the scan knows them (see ``scanned``).

    A frame that is no file scan gets Spark's row number by partition instead.
    """
    try:
        return df.withColumn(name, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


def text_parts(texts: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of an array of texts, cut by bytes so that work on a slice needs little memory; null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        limit = (int(ends[start - 1]) if start else 0) + part_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def coded_words(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some lists, the number of each word in turn, and where each list starts (and the last ends)."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values (of rows, if two-dimensional); empty stretches give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` whose key (see with_row_key) is not in ``lost.row_key``."""
    key = free_name(docs, "_row_key")
    return with_row_key(docs, key).join(lost.select(F.col("row_key").alias(key)), key, "left_anti").drop(key)


def only_listed(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys``; the list is broadcast up to BROADCAST_ROWS only."""
    keys = keys.select(on).distinct()
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, "left_semi")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component = smallest node.

    Alternates the large-star and small-star steps; every step's edges are written to the shared
    folder, so no lineage grows and lost executors only repeat one step; what a step has read is deleted. Minimums are aggregated
    before the shuffle, and hubs are split by the skewed-join rule since both join sides are scans.
    Nodes without an edge to another node are not in the result. Null ends are ignored.
    """
    now = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    spark = edges.sparkSession
    if now.isEmpty():
        return spark.createDataFrame([], "node bigint, component bigint")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        lows = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lows")
        out = pairs.join(lows, "u")
        out = out.where("v > u") if larger_only else out
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger_only:
            moved = moved.union(lows.select("u", F.col("m").alias("v")))
        moved = stored(moved.where("u != v").distinct(), "edges")
        freed(lows)
        return moved

    before = mark(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True)
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        last, now = now, star(ordered, False)
        freed(last, large)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
