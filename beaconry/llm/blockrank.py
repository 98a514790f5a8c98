"""Ranked lexical search by dense blocked multiplication.

The items' terms are the vocabulary. A document becomes the counts of its vocabulary terms, stored once; document
frequencies and totals are summed from these counts. Scoring multiplies dense tiles in float64: a vocabulary tile of
item counts (items x terms) times an impact tile (terms x documents), where an impact is a term's weight times its
saturated count, a whole number. Counts in a vocabulary tile are limited so that no partial sum reaches 2^53: every
product is exact, and tiles are added as 64-bit integers. A term that an item holds more often than the limit goes on
in a further layer of tiles.

Each task keeps the best K documents of every item, each tile held against the K-th score so far: all documents above
it or equal to it are looked at, so ties are settled by the document's id and not by the tile. Items are taken in
blocks of bounded size (sent to the tasks), each block against all documents, so neither side is ever held whole.

Defined cases: null or empty text, of a document or an item, has no terms: it is not counted in N, and gives no rows; ids of
documents are numbers, null ids rank after all others among equal scores, rows of equal id and score are told apart by their
row key; items of the same or of null id are ranked each by itself; an item without scored documents gives no rows; empty
tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import text_parts, with_row_key
from beaconry.session import stored

TOP = 20
#: Most items, and about the most bytes of item text, that are sent to the tasks at once.
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 2048, 8_000_000
#: Terms and documents of a tile; items x documents of a score matrix.
TERMS, DOCS, CELLS = 2048, 1024, 1 << 21
EXACT = 1 << 53
# Fixed values of the scoring formula: parts of a hundred for length, scale of a weight, scale and offset of a count.
FLAT, BY_LENGTH = 75, 25
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, NORM_SCALE = 1000, 1_000_000_000, 1000, 12

_KEEP = np.full(256, 32, np.uint8)
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    _KEEP[_low: _high + 1] = np.arange(_low, _high + 1)
_KEEP[65:91] = np.arange(97, 123)
_TABLE = _KEEP.tobytes()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z fall."""
    return text.translate(_TABLE).split() if text else []


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(WEIGHT_SCALE * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def norms(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    return FLAT + (BY_LENGTH * n * n_docs) // all_terms


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + NORM_SCALE * m)


class Vocabulary:
    """Terms of a block of items, numbered, and how often each item holds each."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.n_items = len(texts)
        counts = [Counter(terms(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        self.item = np.array([i for i, c in enumerate(counts) for _ in c], np.int64)
        self.term = np.array([self.number[t] for c in counts for t in c], np.int64)
        self.count = np.array([n for c in counts for n in c.values()], np.int64)

    def tiles(self, heaviest: int, width: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, items x terms counts); an item's counts in a tile times ``heaviest`` stay below 2^53."""
        most = max((EXACT - 1) // max(heaviest, 1) // width, 1)
        left = self.count
        item, term = self.item, self.term
        while len(left):
            now = np.minimum(left, most)
            for start in range(0, len(self.number), width):
                inside = (term >= start) & (term < start + width)
                if inside.any():
                    used, place = np.unique(term[inside], return_inverse=True)
                    tile = np.zeros((self.n_items, len(used)))
                    tile[item[inside], place] = now[inside]
                    yield used, tile
            rest = left > most
            left, item, term = left[rest] - most, item[rest], term[rest]


def term_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row_key, doc_id, n (all terms), terms, counts (of the vocabulary) of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for start, part in text_parts(batch.column(2)):
                size, found, many, ends = [], [], [], [0]
                for text in part.cast(pa.binary()).to_pylist():
                    every = terms(text)
                    size.append(len(every))
                    for t, c in Counter(every).items():
                        i = number.get(t)
                        if i is not None:
                            found.append(i)
                            many.append(c)
                    ends.append(len(found))
                rows = pa.array(np.flatnonzero(size), pa.int64())
                ends = pa.array(ends, pa.int32())
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(many, pa.int64()))],
                    names=["row_key", "doc_id", "n", "terms", "counts"]).take(rows)

    return docs.select("row_key", "doc_id", "text").mapInArrow(
        count, "row_key bigint, doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: counted per task, summed by Spark, one number per term."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    rows = counted.select("terms").mapInArrow(tally, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


class Best:
    """The best ``k`` (score, id, key) of every item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.floor = np.ones(n_items, np.int64)  # a score must reach this: 1 until k are known, then the k-th
        self.kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4] * n_items

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Scores (items x documents) of a tile; a document that only equals the floor may still win by its id."""
        for i in np.flatnonzero((scores >= self.floor[:, None]).any(axis=1)):
            row = scores[i]
            low = self.floor[i]
            if len(row) > self.k:  # nothing below the tile's own k-th can be among the best
                low = max(low, np.partition(row, len(row) - self.k)[-self.k])
            at = np.flatnonzero(row >= low)
            every = [np.concatenate(p) for p in zip(self.kept[i], (row[at], absent[at], ids[at], keys[at]))]
            order = np.lexsort((every[3], every[2], every[1], -every[0]))[: self.k]
            self.kept[i] = tuple(p[order] for p in every)
            if len(order) == self.k:
                self.floor[i] = self.kept[i][0][-1]


def score_block(counted: DataFrame, vocabulary: Vocabulary, df: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """Rows (item, score, row_key, doc_id): for each task, the best ``k`` documents of every item of a block."""
    shared = counted.sparkSession.sparkContext.broadcast((vocabulary, weights(df, n_docs)))
    docs_of_tile = max(64, min(DOCS, CELLS // max(vocabulary.n_items, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight = shared.value
        # no impact is above weight x scale / count scale
        tiles = list(vocabulary.tiles(int(weight.max(initial=1)) * (IMPACT_SCALE // TF_SCALE)))
        best = Best(vocabulary.n_items, k)
        for batch in batches:
            for start in range(0, batch.num_rows, docs_of_tile):
                part = batch.slice(start, docs_of_tile)
                lists, n = part.column(3), part.column(2).to_numpy()
                sizes = pc.list_value_length(lists).to_numpy()
                doc = np.repeat(np.arange(len(n)), sizes)
                term, tf = lists.flatten().to_numpy(), part.column(4).flatten().to_numpy()
                impact = weight[term] * saturated(tf, norms(n, n_docs, all_terms)[doc])
                by_term = np.argsort(term, kind="stable")
                doc, term, impact = doc[by_term], term[by_term], impact[by_term]
                scores = np.zeros((vocabulary.n_items, len(n)), np.int64)
                for used, tile in tiles:
                    low, high = np.searchsorted(term, [used[0], used[-1] + 1])
                    at = np.searchsorted(used, term[low:high])
                    hit = used[at] == term[low:high]
                    if not hit.any():
                        continue
                    present, place = np.unique(at[hit], return_inverse=True)
                    dense = np.zeros((len(present), len(n)))
                    dense[place, doc[low:high][hit]] = impact[low:high][hit]
                    scores += (tile[:, present] @ dense).astype(np.int64)
                ids = part.column(1)
                best.add(scores, ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                         ids.fill_null(0).to_numpy(), part.column(0).to_numpy())
        score, absent, ids, keys = (np.concatenate(p) for p in zip(*best.kept))
        item = np.repeat(np.arange(vocabulary.n_items), [len(kept[0]) for kept in best.kept])
        yield pa.record_batch([pa.array(item), pa.array(score), pa.array(keys), pa.array(ids, mask=absent.astype(bool))],
                              names=["item", "score", "row_key", "doc_id"])

    return counted.select("row_key", "doc_id", "n", "terms", "counts").mapInArrow(
        search, "item bigint, score bigint, row_key bigint, doc_id bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    source = with_row_key(docs, "_row_key").select(F.col("_row_key").alias("row_key"), F.col("doc_id").cast("bigint"), "text")
    asked = stored(with_row_key(items, "_row_key").where("text is not null").select(
        F.col("_row_key").alias("item_key"), "item_id", "text"), "items")
    total = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-total["n"] // items_per_block), -(-(total["bytes"] or 0) // BYTES_PER_BLOCK), 1)
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    out = spark.createDataFrame([], schema)
    for number in range(blocks if total["n"] else 0):
        block = asked.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == number).orderBy("item_key").toArrow()
        vocabulary = Vocabulary(block.column("text").cast(pa.binary()).to_pylist())
        if not vocabulary.number:
            continue
        counted = stored(term_counts(source, vocabulary), "counts")
        sums = counted.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not sums["n"]:
            continue
        df = document_frequencies(counted, len(vocabulary.number))
        # nearest to the scan: documents without a vocabulary term can't score
        found = stored(score_block(counted.where(F.size("terms") > 0), vocabulary, df, sums["n"], sums["terms"], k), "found")
        place = F.row_number().over(Window.partitionBy("item").orderBy(
            F.desc("score"), F.col("doc_id").asc_nulls_last(), "row_key"))
        names = spark.createDataFrame(pa.table({
            "item": pa.array(range(vocabulary.n_items), pa.int64()), "item_id": block.column("item_id")}))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
