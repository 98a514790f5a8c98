"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text and depends on the last 16 bytes only. A text is cut after each character
whose hash is the least among all characters within MIN_BYTES bytes on either side (the first of equal ones), so whether
a place is a cut depends on the bytes near it and never on earlier cuts: copies of a passage are cut alike but for
their edges. Only stretches of over MAX_BYTES without such a place (long runs of one pattern) are cut by length, counted from
the cut before. Chunks are compared by a 128-bit digest; the first
occurrence (smallest doc_id, then first in the document) stays. Runs of neighbouring repeated chunks of at least
MIN_RUN bytes are removed; shorter repeats (common lines, notices) are left alone. A run is shorter than its passage by
the parts of chunks at both edges, which stay.

Digests are counted with map-side sums, so a passage of every document is one row per task; the repeats found are
joined back by digest as two plain scans, which lets Spark split a hot digest.

Defined cases: null and empty texts have no chunks; repeated rows: the whole text of all but one is a repeat, if it is long
enough; null ids sort last, i.e. they stay only if no other document has the chunk; long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import only_listed, scanned, with_row_key
from beaconry.session import stored

MIN_BYTES, MAX_BYTES = 12, 64
MIN_RUN = 100
_WINDOW_STEPS = 4  # 16 bytes: the hash has 16 bits and moves one up for each byte
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + gear[data[i]] modulo 2^16, for all i at once by doubling the window."""
    h = _GEAR[data].copy()
    for step in range(_WINDOW_STEPS):
        width = 1 << step
        h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return []
    begins = (np.append(data[1:], 0) & 0xC0) != 0x80  # the next byte starts a character
    hashes = np.where(begins, gear_hash(data), np.int32(1 << 16)).astype(np.int32)
    ends, last, n = [], 0, len(raw)
    for cut in [*[c for c in (np.flatnonzero(_least_nearby(hashes, MIN_BYTES) & begins) + 1).tolist() if c < n], n]:
        while cut - last > MAX_BYTES:
            forced = min(last + MAX_BYTES, cut - MIN_BYTES)
            while not begins[forced - 1]:
                forced -= 1
            ends.append(forced)
            last = forced
        if cut - last >= MIN_BYTES or cut == n:  # not so soon after the start of the text
            ends.append(cut)
            last = cut
    return ends


def _least_nearby(values: np.ndarray, width: int) -> np.ndarray:
    """Where a value is below the ``width`` values before it and not above the ``width`` after it."""
    edge = np.full(width, 1 << 17, np.int32)
    low = np.concatenate([edge, values, edge])
    size = 1
    while size < width:  # low[i] = the least of size values from i on
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    n = len(values)
    return (values < low[:n]) & (values <= low[width + 1: width + 1 + n])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the digests of its chunks, and whether each is its first there."""
    for batch in batches:
        firsts, hi, lo, all_ends = [], [], [], []
        for text in batch.column(2).to_pylist():
            raw, start, parts = (text or "").encode(), 0, []
            ends = chunk_ends(raw)
            all_ends.append(ends)
            for end in ends:
                parts.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                start = end
            both = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
            seen: set[bytes] = set()
            firsts.append([not (p in seen or seen.add(p)) for p in parts])
            hi.append(both[:, 0])
            lo.append(both[:, 1])
        longs = pa.list_(pa.int64())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(hi, longs), pa.array(lo, longs), pa.array(firsts, pa.list_(pa.bool_())),
             pa.array(all_ends, longs)], names=["row_key", "at", "hi", "lo", "first", "ends"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """row_key, spans (byte ranges of at least MIN_RUN that consist of chunks seen before) of every row that has some.

    ``docs``: doc_id, row_key, text. Only digest counts of all chunks are shuffled with the first exchange; who has the
    first occurrence is decided among the repeated chunks alone.
    """
    source = docs.select("row_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("at"), "text")
    cut = stored(source.mapInArrow(
        _chunks, "row_key bigint, at bigint, hi array<bigint>, lo array<bigint>, first array<boolean>, ends array<bigint>"), "chunks")
    flat = cut.select("row_key", "at", F.posexplode(F.arrays_zip("hi", "lo", "first")).alias("pos", "c")).select(
        F.col("c.hi").alias("hi"), F.col("c.lo").alias("lo"), "row_key", "at",
        F.when(F.col("c.first"), F.col("pos")).otherwise(-1 - F.col("pos")).alias("pos"))  # below 0: not the row's first
    repeats = stored(flat.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo"), "repeats")
    hits = stored(flat.join(repeats, ["hi", "lo"]), "hits")
    keepers = stored(hits.groupBy("hi", "lo").agg(F.min_by("row_key", F.struct("at", "row_key")).alias("keeper")), "keepers")
    later = hits.join(keepers, ["hi", "lo"]).where((F.col("row_key") != F.col("keeper")) | (F.col("pos") < 0))
    # one row's chunks: bounded by its text
    some = later.groupBy("row_key").agg(F.collect_list(F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))).alias("repeats"))
    return some.join(cut.select("row_key", "ends"), "row_key").mapInArrow(_spans, "row_key bigint, spans array<bigint>")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for row, repeats, ends in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            spans: list[list[int]] = []
            for p in sorted(repeats):
                start, end = (ends[p - 1] if p else 0), ends[p]
                if spans and spans[-1][1] == start:
                    spans[-1][1] = end
                else:
                    spans.append([start, end])
            flat = [x for s in spans if s[1] - s[0] >= MIN_RUN for x in s]
            if flat:
                rows.append(row)
                found.append(flat)
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["row_key", "spans"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        shown, texts, removed = [], [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = text.encode()
            edges = [0, *spans, len(raw)]
            texts.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
            removed.append(sum(b - a for a, b in zip(spans[::2], spans[1::2])))
            shown.append([{"start": len(raw[:a].decode()), "end": len(raw[:b].decode())} for a, b in zip(spans[::2], spans[1::2])])
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(shown, spans_type), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "row_key", "spans", "removed_bytes", "text"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each document that loses a passage: doc_id, row_key, spans (character offsets), removed_bytes, text (what stays)."""
    source = with_row_key(scanned(docs), "_row_key").select("doc_id", F.col("_row_key").alias("row_key"), "text")
    found = stored(repeated_chunks(source), "repeated")
    id_type = source.schema["doc_id"].dataType.simpleString()
    losing = only_listed(source, found, "row_key", found.count())  # other texts are not shuffled
    return losing.join(found, "row_key").select("doc_id", "row_key", "text", "spans").mapInArrow(
        _cut_out, f"doc_id {id_type}, row_key bigint, spans array<struct<start: bigint, end: bigint>>, "
        "removed_bytes bigint, text string")
