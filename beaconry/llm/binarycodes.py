"""Near duplicates of vectors by randomised-rotation binary codes.

A unit vector x is turned by R random rotations; its codes are the signs of the turned vectors (R bits a dimension) and
are stored with a correction factor each, f = <sign(Px), Px> / sqrt(D), the inner product of x and its code. For codes of
two vectors by *different* rotations P and Q, sign(Px) (P Q') sign(Qy) / (D f_x f_y) estimates <x, y> without bias from
nothing but bits and factors (P Q' is a fixed matrix). The mean over all such P and Q is taken; with a = (1 - f^2) / f^2
its variance is at most 2 (1 - <x, y>^2) (sum a_x + sum a_y) / R^2 plus 2 (sum over P, Q of a_x a_y) / (R (R - 1))^2,
both divided by D - 1.

Pairs are looked for in tables: the first bits of further rotations are the bucket of a vector. The number of bits
grows with the logarithm of the number of vectors, so buckets keep their size, and the number of tables is chosen
so that a pair right at the threshold meets in at least one with probability RECALL (closer pairs more often).
Tables shuffle codes, factors and buckets, D/2 bytes and some numbers for each row, never vectors. A bucket is
worked on in tiles of bounded size. A pair that met in an earlier table is left to it; any other whose upper
confidence bound reaches the threshold is open. Rows with an open pair in a tile, and only they, then fetch their
vectors, and the open pairs are recomputed exactly, in double precision. No pair is linked by its estimate alone: the
interval is too wide for a lower bound to pass a threshold near 1. A tile returns one row per vector (its links there,
and the smallest vector of its component there), never pairs.
Equal vectors (by a 128-bit hash) are one class: one of them is compared, and its links count with the size of the class.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing;
vectors of different length do not link; null ids take part, the component is the smallest id reachable (null if
there is none); equal vectors and repeated rows link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import components, freed, scanned, with_row_key
from beaconry.llm.tiles import by_group, tile_labels, tiled
from beaconry.session import stored

THRESHOLD = 0.9
RECALL = 0.98
BUCKET = 1024
TILE = 1024
#: Rotations of the codes (the estimate crosses them), and the width of its confidence interval in standard errors.
ROTATIONS = 4
SIGMAS = 4.0
_SEED = 20_407


@lru_cache(16)
def rotation(dim: int, number: int) -> np.ndarray:
    """The same random rotation of ``dim`` dimensions wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits per table, number of tables) for n vectors; without bits one table holds all pairs."""
    bits = max(0, round(math.log2(max(n, 1) / bucket)))
    if not bits:
        return 0, 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of every vector in every table: signs of rotations that the estimate does not use."""
    if not bits:
        return np.zeros((len(x), tables), np.int64)
    dim = x.shape[1]
    signs, number = [], ROTATIONS
    while sum(s.shape[1] for s in signs) < bits * tables:
        signs.append(x @ rotation(dim, number).T > 0)
        number += 1
    every = np.concatenate(signs, axis=1)[:, : bits * tables].reshape(len(x), tables, bits)
    return every @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of unit vectors (one row of bytes each) and their correction factors, one for each rotation."""
    turned = [x @ rotation(x.shape[1], number).T for number in range(ROTATIONS)]
    factors = np.stack([np.abs(t).sum(axis=1) / math.sqrt(x.shape[1]) for t in turned], axis=1)
    return np.concatenate([np.packbits(t > 0, axis=1) for t in turned], axis=1), factors


def estimate(codes: np.ndarray, factors: np.ndarray, dim: int, at_least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all coded vectors with each other, estimated from their codes, and the standard errors.

    The errors hold for pairs whose inner product is ``at_least`` this (0 or more) in absolute value.
    """
    factors = np.maximum(factors, 1e-6)
    signs = [
        (np.unpackbits(part, axis=1, count=dim).astype(np.float32) * 2 - 1) / factors[:, [number]].astype(np.float32)
        for number, part in enumerate(np.split(codes, ROTATIONS, axis=1))]
    back = sum(s @ rotation(dim, number).astype(np.float32) for number, s in enumerate(signs))  # all codes, turned back
    pairs = ROTATIONS * (ROTATIONS - 1)
    guess = back @ back.T
    for s in signs:  # a rotation with itself is biased
        guess -= s @ s.T
    guess /= dim * pairs
    a = (1 - np.minimum(factors, 1) ** 2) / factors**2
    total = a.sum(axis=1)
    var = 2 * max(1 - at_least**2, 0.0) * (total[:, None] + total[None, :]) / ROTATIONS**2
    var += 2 * (np.outer(total, total) - a @ a.T) / pairs**2
    return guess, np.sqrt(var / max(dim - 1, 1))


def open_pairs(
    codes: np.ndarray, factors: np.ndarray, dim: int, keys: np.ndarray, number: int, block: np.ndarray, one: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a tile that table ``number`` has to recompute: the bound allows a link, and no earlier table held both.

    A tile of two blocks holds only pairs of one row from each.
    """
    guess, error = estimate(codes, factors, dim, max(threshold, 0.0))
    i, j = np.nonzero(np.triu(guess + SIGMAS * error >= threshold, 1))
    if not one:
        apart = block[i] != block[j]
        i, j = i[apart], j[apart]
    new = np.ones(len(i), bool)
    for t in range(number):
        new &= keys[i, t] != keys[j, t]
    return i[new], j[new]


def exact_links(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of unit vectors reach the threshold, by products of pairs in double precision."""
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), 1 << 16):
        a, b = i[start: start + (1 << 16)], j[start: start + (1 << 16)]
        out[start: start + (1 << 16)] = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
    return out


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, tile: int = TILE
) -> DataFrame:
    """One row per vector: vec_id, row_key, n_links, component_id, kept."""
    source = with_row_key(scanned(vectors), "_row_key").select(
        "vec_id", F.col("_row_key").alias("row_key"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (
        F.exists("v", lambda c: c != 0))
    source = source.withColumn("good", good).select(
        "*", F.when(good, F.xxhash64("v")).alias("hi"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("lo"))
    source = stored(source, "vectors")
    classes = stored(source.where("good").groupBy("hi", "lo").agg(
        F.min("row_key").alias("row_key"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    valid = source.select("row_key", "v").join(classes.select("row_key", "copies"), "row_key")
    bits, tables = table_plan(classes.count(), threshold, recall, bucket)

    def unit(raw: list) -> np.ndarray:
        x = np.array(raw, np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            dims = np.array([len(r) for r in rows], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit([rows[i] for i in at])
                codes, factors = encode(x)
                part = batch.take(pa.array(at))
                yield pa.record_batch(
                    [part.column("row_key"), part.column("copies"), pa.array(dims[at]),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(factors), pa.list_(pa.float64())),
                     pa.array(list(bucket_keys(x, bits, tables)), pa.list_(pa.int64())), part.column("v")],
                    names=["row_key", "copies", "dim", "code", "factors", "buckets", "v"])

    def tile_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Open pairs of a tile, by position."""
        dim, number = table.column("dim")[0].as_py(), table.column("number")[0].as_py()
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        factors = np.array(table.column("factors").to_pylist())
        met = np.array(table.column("met").to_pylist(), np.int64).reshape(table.num_rows, -1)
        one = table.column("tile_a")[0] == table.column("tile_b")[0]
        return open_pairs(codes, factors, dim, met, number, table.column("block").to_numpy(), one, threshold)

    def screen(table: pa.Table) -> pa.RecordBatch | None:
        """The rows of a tile that have an open pair."""
        if table.num_rows < 2:
            return None
        told = np.unique(np.concatenate(tile_pairs(table)))
        if not len(told):
            return None
        kept = table.select(open_columns).take(pa.array(told)).combine_chunks()
        return kept.to_batches()[0]

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        """Exact links among the open pairs of a tile."""
        table = table.take(pa.array(np.argsort(table.column("row_key").to_numpy(), kind="stable")))
        i, j = tile_pairs(table)
        key, copies = table.column("row_key").to_numpy(), table.column("copies").to_numpy()
        linked = exact_links(unit(table.column("v").to_pylist()), i, j, threshold)
        i, j = i[linked], j[linked]
        if not len(i):
            return None
        links = np.zeros((len(key), len(key)), bool)
        links[i, j] = links[j, i] = True
        label = tile_labels(links)
        counts = np.bincount(i, copies[j], len(key)) + np.bincount(j, copies[i], len(key))
        told = np.flatnonzero(counts)
        return pa.record_batch([pa.array(key[told]), pa.array(counts[told].astype(np.int64)), pa.array(key[label[told]])],
                               names=["row_key", "n", "lowest"])

    coded = stored(valid.mapInArrow(
        code, "row_key bigint, copies bigint, dim bigint, code binary, factors array<double>, buckets array<bigint>, v array<double>"),
        "codes")
    groups = ["dim", "number", "bucket"]
    tile_keys = [*groups, "tile_a", "tile_b"]
    open_columns = [*tile_keys, "row_key", "block"]
    met = F.slice("buckets", 1, F.col("number"))  # of the tables before
    placed = coded.select("dim", "row_key", "code", "factors", "buckets", F.posexplode("buckets").alias("number", "bucket"))
    placed = placed.select("dim", F.col("number").cast("bigint").alias("number"), "bucket", "row_key", "code", "factors", met.alias("met"))
    work = tiled(placed, groups, "row_key", tile).select(*tile_keys, "row_key", "block", "code", "factors", "met")
    types = dict(work.dtypes)
    opened = stored(by_group(work, tile_keys, screen, ", ".join(f"{c} {types[c]}" for c in open_columns)), "open")
    fetched = opened.join(coded.drop("dim"), "row_key").withColumn("met", met).select(
        *open_columns, "copies", "code", "factors", "met", "v")
    found = stored(by_group(fetched, tile_keys, compare, "row_key bigint, n bigint, lowest bigint"), "links")
    freed(opened, coded)
    counts = found.groupBy("row_key").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("row_key").alias("a"), F.col("lowest").alias("b")))
    named = joined.join(classes, joined["node"] == F.col("row_key")).select("row_key", "component", "first_id")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = named.join(lowest, "component").select("row_key", "component_id", F.lit(True).alias("linked"))
    told = stored(classes.join(counts, "row_key", "left").join(whole, "row_key", "left").select(
        "hi", "lo", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")), "vectorids")
    out = source.select("vec_id", "row_key", "good", "hi", "lo").join(told, ["hi", "lo"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", "row_key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
