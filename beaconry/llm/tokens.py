"""Token ids of every document, and their compact binary form.

``encode_ids`` runs a public tokenizer over whole texts. White space always separates its pre-tokens, so the
ids of a text are those of its words in turn; each worker remembers the ids of words it met (a bounded number), and only
unseen words go through the tokenizer.

``write_blocks`` stores ids as canonical Huffman codes of limited length, from counts over all ids. Documents
lie in ascending doc_id order. Files are Parquet with one row for each independent block: where its first id
stands in the file, the documents and their lengths, the bits, and the bit offset of every CHECKPOINT-th id. Spark's
committer places them, so any store works and a repeated task leaves no half file. ``read_blocks`` decodes
each block by itself: all checkpoints of a block are decoded side by side by one table lookup per id.

Defined cases: null text has no ids besides the end id; null doc_id sorts first; documents of equal doc_id
stand next to each other in any order; an empty table gives an empty store; a single distinct id gets a code of one bit. A
document is never split between blocks, so a very long one makes one large block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import coded_words, text_parts
from beaconry.session import stored, work_path

MAX_CODE = 18
BLOCK_IDS = 1 << 16
CHECKPOINT = 128
#: Ids must be below this; the code table (one small entry per id) is what the driver and each task hold.
MAX_VOCABULARY = 1 << 20
_MEMO_WORDS = 500_000
#: Contractions, runs of signs, single digits: the parts of the tokenizer's pattern besides runs of letters.
_PARTS = r"('(?:s|t|re|ve|m|ll|d)|[^\p{L}\p{N}\s\x{0B}\x{85}\x{A0}]+|\p{N})"
#: Below U+0250 every letter lower-cases alone and is in composed form; U+0130 is the exception. The second part starts a special token.
_NOT_SIMPLE = r"[^\x{00}-\x{24F}]|\x{130}|<\|"
_PROBES = ("Thor, the ANDS of", "don't we'll .'s 'tis DON'T x''s", "a1b22 3.5-x (y) _z__ #2", "Éà STRAẞE".replace("ẞ", "ß") + " ñoño«œuvre».",
           "ǆ ŁÓDŹ | a|b || .,;:!? <b> \"q\"", "45.114.23.72 x@y.zz http://a.b/c?d=e", "½ ² º µ°C\xa0z \x0b", "theandinger qzxw")


class WordMemo:
    """Ids of texts; only words not met before go through the tokenizer.

    Texts of simple letters are lower-cased and parted as the tokenizer's own pattern does it (runs of letters, runs of
    signs, single digits, contractions), by Arrow; each distinct part of a batch is looked up once, and unseen runs of
    letters are encoded together by the same model, parted by spaces: the ids that end a word tell them apart again.
    All other texts are split at white space only, and their unseen words take the whole tokenizer. That the short
    way is right for a tokenizer is tried out when it is loaded; if not, no text takes it.
    """

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.dtype = Tokenizer.from_file(path), dtype
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # every byte of UTF-8 as the letter that byte-level models use for it
        self.letters = {b: byte_level.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        for c in map(chr, range(0x80, 0x250)):
            self.letters.update(zip(c.encode(), byte_level.pre_tokenize_str(c)[0][0]))
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.short_way = True
        self.short_way = all(self._short(pa.array([p]))[0] == self._whole([p])[0] for p in _PROBES)

    def _plain(self, words: list[str]) -> list[bytes] | None:
        text = " ".join(words).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words) or last[-1] != len(ids):
            return None
        raw, size = ids.tobytes(), ids.itemsize
        bounds = [0, *(last * size).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _whole(self, words: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _joined(self, words: pa.Array, memo: dict[str, bytes], plain: bool) -> list[bytes]:
        """Ids of each list of words, through the memo."""
        distinct, at, offsets = coded_words(words)
        known = list(map(memo.get, distinct))
        unseen = [w for w, i in zip(distinct, known) if i is None]
        if unseen:
            if len(memo) + len(unseen) > _MEMO_WORDS:  # only the words of this part stay
                held = {w: i for w, i in zip(distinct, known) if i is not None}
                memo.clear()
                memo.update(held)
            letters = [w for w in unseen if w.isalpha()] if plain else []
            for start in range(0, len(letters), 500):
                part = letters[start: start + 500]
                memo.update(zip(part, self._plain(part) or self._whole(part)))
            rest = [w for w in unseen if not w.isalpha()] if plain else unseen
            memo.update(zip(rest, self._whole(rest)))
            known = list(map(memo.__getitem__, distinct))
        # ids of the distinct words in a row, then each word's stretch of them in the order of the texts
        pool = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.dtype).itemsize
        begins = np.cumsum(sizes) - sizes
        many = sizes[at]
        ends = np.cumsum(many)
        ids = pool[np.repeat(begins[at] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _short(self, texts: pa.Array) -> list[bytes]:
        parted = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=_PARTS, replacement=r" \1 ")
        return self._joined(pc.ascii_split_whitespace(parted), self.parts, True)

    def _long(self, texts: pa.Array) -> list[bytes]:
        return self._joined(pc.ascii_split_whitespace(texts), self.words, False)

    def ids(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of every text (null: none) and the end id, as little-endian bytes."""
        out: list[bytes] = []
        for _, part in text_parts(texts):
            odd = pc.match_substring_regex(part, pattern=_NOT_SIMPLE).to_numpy(zero_copy_only=False) if (
                self.short_way) else np.ones(len(part), bool)
            found: list[bytes] = [b""] * len(part)
            for way, rows in ((self._short, np.flatnonzero(~odd)), (self._long, np.flatnonzero(odd))):
                if len(rows):
                    for i, raw in zip(rows.tolist(), way(part.take(pa.array(rows)))):
                        found[i] = raw
            out += [raw + end for raw in found]
        return out


_memos: dict[tuple[str, str], WordMemo] = {}


def encode_ids(docs: DataFrame, tokenizer_file: str, end_id: int, dtype: str = "<u2") -> DataFrame:
    """doc_id and ``ids``, the document's ids with the end id as little-endian bytes of ``dtype``."""
    end = np.array([end_id], dtype).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_file, dtype) not in _memos:
            _memos[tokenizer_file, dtype] = WordMemo(tokenizer_file, dtype)
        memo = _memos[tokenizer_file, dtype]
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(memo.ids(batch.column(1), end), pa.binary())],
                                  names=["doc_id", "ids"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(encode, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def count_ids(ids: DataFrame, dtype: str = "<u2") -> np.ndarray:
    """How often each id occurs in the whole table; counted per task, then summed, one number per id."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(part) > MAX_VOCABULARY:
                raise ValueError(f"an id is above {MAX_VOCABULARY}")
            if len(part) > len(total):
                part, total = total, part.astype(np.int64)
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    counts[at] = n
    return counts


def code_lengths(counts: np.ndarray, longest: int = MAX_CODE) -> np.ndarray:
    """Code length of each id (0: unused) with the least total bits among codes of at most ``longest`` bits.

    Package-merge: ``longest`` rounds pair the cheapest items up; going back, the items needed in the last
    round tell how many of the rarest ids get one bit more in each round.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    rounds, packs = [], np.zeros(0, np.int64)
    for _ in range(longest):
        items = np.concatenate([leaf, packs])
        by_cost = np.argsort(items, kind="stable")
        rounds.append(by_cost < n)
        items = items[by_cost]
        even = len(items) // 2 * 2
        packs = items[0:even:2] + items[1:even:2]
    need, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(rounds):
        leaves = int(is_leaf[:need].sum())
        bits[:leaves] += 1
        need = 2 * (need - leaves)
    out[order] = bits
    return out


@dataclass
class Code:
    """Canonical code: shorter codes first, ids in order within a length."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        lengths = self.lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        self.order = used[np.argsort(lengths[used], kind="stable")]
        self.width = int(lengths.max()) if len(used) else 1
        sizes = lengths[self.order]
        step = np.left_shift(np.int64(1), self.width - sizes)
        starts = np.concatenate([[0], np.cumsum(step)[:-1]]) if len(used) else step
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (starts >> (self.width - sizes)).astype(np.uint64)
        self.symbols = np.repeat(self.order.astype(np.uint32), step)
        self.sizes = np.repeat(sizes.astype(np.int64), step)
        missing = (1 << self.width) - len(self.symbols)  # only where a single id is in use
        self.symbols = np.concatenate([self.symbols, np.zeros(missing, np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.ones(missing, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every CHECKPOINT-th id."""
        size = self.lengths[ids].astype(np.uint64)
        end = np.cumsum(size)
        at = end - size
        word, inside = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
        wide = self.codes[ids] << (np.uint64(64) - size - inside)  # over this word and the next
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sums = np.add.reduceat(wide, first)
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        words[word[first]] += sums >> np.uint64(32)
        words[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], at[::CHECKPOINT].astype(np.int64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((len(offsets), CHECKPOINT), np.uint32)
        at, shift, last = offsets.astype(np.int64), np.uint32(32 - self.width), len(window) - 1
        for k in range(min(n, CHECKPOINT)):
            code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[:, k] = self.symbols[code]
            at += self.sizes[code]
        return out.reshape(-1)[:n]


_BLOCK = ("file int, first_id bigint, n_ids bigint, doc_ids array<{id}>, doc_lengths array<bigint>, "
          "offsets array<bigint>, bits binary")


def write_blocks(ids: DataFrame, lengths: np.ndarray, path: str, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> None:
    """Write ``path``/blocks in ascending doc_id order, and ``path``/code with the length of each id's code."""
    spark = ids.sparkSession
    id_type = ids.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(lengths)  # one byte for each id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        number, done = TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def block():
            nonlocal done
            every = np.concatenate(parts)
            bits, offsets = code.encode(every)
            row = pa.record_batch(
                [pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([len(every)], pa.int64()),
                 pa.array([docs], pa.list_(kind)), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                names=["file", "first_id", "n_ids", "doc_ids", "doc_lengths", "offsets", "bits"])
            done += len(every)
            docs.clear()
            parts.clear()
            return row

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                parts.append(np.frombuffer(raw, dtype))
                size += len(parts[-1])
                if size >= block_ids:
                    yield block()
                    size = 0
        if parts:
            yield block()

    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(pack, _BLOCK.format(id=id_type)).write.parquet(f"{path}/blocks")
    table = pa.table({"id": pa.array(np.flatnonzero(lengths), pa.int64()), "bits": pa.array(
        lengths[np.flatnonzero(lengths)].astype(np.int64))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/code")


_codes: dict[str, Code] = {}


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files (and ``ids`` if wanted)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/code").toArrow()
    lengths = np.zeros(int(table.column("id").to_numpy().max()) + 1 if len(table) else 1, np.uint8)
    lengths[table.column("id").to_numpy()] = table.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _codes:
            _codes.clear()
            _codes[path] = Code(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                n = row.column(2)[0].as_py()
                sizes = row.column(4).flatten().to_numpy()
                found = _codes[path].decode(row.column(6)[0].as_py(), row.column(5).flatten().to_numpy(), n)
                data, ends = found.astype("<u4").tobytes(), np.cumsum(sizes)
                begins = ends - sizes
                cols = [pa.array(np.full(len(sizes), row.column(0)[0].as_py(), np.int32)), row.column(3).flatten(),
                        pa.array(begins + row.column(1)[0].as_py(), pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(data[4 * a: 4 * b]) for a, b in zip(begins, ends)], pa.int64())]
                names = ["file", "doc_id", "in_file", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([found[a:b].astype(np.int64) for a, b in zip(begins, ends)],
                                         pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(cols, names=names)

    docs = blocks.mapInArrow(unpack, f"file int, doc_id {id_type}, in_file bigint, n_tokens bigint, ids_crc32 bigint"
                             + (", ids array<bigint>" if with_ids else ""))
    # one row for each file: how many ids stand in the files before it
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    return docs.join(before, "file").select(
        "doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def tokens_round_trip(docs: DataFrame, tokenizer_file: str, end_id: int, vocabulary: int, path: str | None = None) -> DataFrame:
    """Encode, write and read back; the result comes from the files only."""
    dtype = "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"
    path = path or work_path(docs.sparkSession, "tokens")
    ids = stored(encode_ids(docs, tokenizer_file, end_id, dtype), "ids")
    write_blocks(ids, code_lengths(count_ids(ids, dtype)), path, dtype)
    return read_blocks(docs.sparkSession, path)
