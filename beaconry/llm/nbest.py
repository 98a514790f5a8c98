"""N-best segmentation of text into the pieces of a SentencePiece model, and decoding.

A text is prefixed with a space, spaces become the piece space mark, and its lattice has an arc for every piece that
matches, weighted by the piece's score; a character that is no piece itself is spelled in bytes at
a score below all pieces. The scores of a pair-merging model are ranks of its merges, no likelihoods, so ``segment`` scores a
piece by the logarithm of its frequency in the model's own encoding of all the documents (half a count is added to
each piece). The best path is then the likeliest segmentation, which is not always the model's own: that one is given beside it,
with ``same_as_model``. No piece crosses a boundary that the model has no inner pair of characters for, so
the lattice is a chain of independent segments, and equal segments have equal lattices.

For a segment, a forward Viterbi pass gives the best score up to every position. The backward A* search starts at the
end and extends partial paths to the left; the forward score of where a partial path begins is exactly the
best that can still be gained, so paths leave the queue in order of their total score, and the search stops after N.
A segmentation of the whole text that is among the N best changes only segments whose own second best
loses least, so only those are searched; their N best are then combined from the end of the chain.

Defined cases: null ids are kept; null and empty texts have one segmentation with no pieces and score 0; fewer than N segmentations: as
many as there are; equal scores come in the order of the search, the same on every run; long texts are read whole; a text
with the space mark itself decodes to a space there, and ``round_trip`` says so.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import MEMO_CHARS, coded_words, sums_by_row, text_parts, worker_model

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_MEMO = 300_000
_TABLE_LENGTH = 24
_BEGIN_BITS = 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lattice:
    """Pieces and scores of a model, and searches in the lattice of one segment."""

    model_file: str
    scores: np.ndarray | None = None  # by id, instead of the model's own
    pieces: dict[str, tuple[int, float]] = field(default_factory=dict)
    longest: int = 1

    def __post_init__(self) -> None:
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=self.model_file)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        inner: set[str] = set()
        low = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                given = sp.get_score(i) if self.scores is None else float(self.scores[i])
                self.pieces[piece] = (i, given)
                inner.update(map("".join, zip(piece, piece[1:])))
                if given > -1e8:
                    low = min(low, given)
        # pieces made of space marks only carry no real score in some models; they count as the rarest piece
        self.pieces = {p: (i, max(s, low)) for p, (i, s) in self.pieces.items()}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = low - UNKNOWN_PENALTY
        # characters that occur next to each other within a piece, as a table over their classes
        joined = sorted({c for pair in inner for c in pair})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        self.n_classes = len(joined) + 1
        self.together = np.zeros(self.n_classes**2, bool)
        for a, b in inner:
            self.together[int(self.classes[ord(a)]) * self.n_classes + int(self.classes[ord(b)])] = True
        # stands before a segment so that the model's own leading space joins with none of it; its ids are cut off
        known = "".join(self.pieces)
        self.guard = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in known)
        self.guard_size = len(sp.encode(self.guard))
        self.begun: dict[int, np.ndarray] = {}  # by length, whether some piece's hash begins with these bits
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            some = [(p, i, s) for p, (i, s) in self.pieces.items() if len(p) == size]
            if some:
                chars = np.frombuffer("".join(p for p, _, _ in some).encode("utf-32-le"), "<u4").reshape(-1, size)
                hashed = np.zeros(len(some), np.uint64)
                for k in range(size):
                    hashed = hashed * _BASE + chars[:, k] + np.uint64(1)
                order = np.argsort(hashed)
                self.begun[size] = np.zeros(1 << _BEGIN_BITS, bool)
                self.begun[size][hashed >> np.uint64(64 - _BEGIN_BITS)] = True
                self.by_length[size] = (hashed[order], np.array([i for _, i, _ in some])[order],
                                        np.array([s for _, _, s in some], np.float64)[order])

    def own(self, parts: list[str]) -> list[bytes]:
        """The model's own encoding of segments, as little-endian 32-bit ids.

        It merges neighbours only into pieces, and none crosses a segment, so those of a text in turn are the text's own.
        """
        return [array("I", ids[self.guard_size:]).tobytes() for ids in self.model.encode([self.guard + p for p in parts])]

    def arcs_to(self, text: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of every arc that ends at ``end``."""
        out, get = [], self.pieces.get
        for start in range(max(0, end - self.longest), end):
            got = get(text[start:end])
            if got:
                out.append((start, got[1], (got[0],)))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, self.unknown, tuple(self.byte_id[b] for b in text[end - 1].encode())))
        return out

    def forward(self, text: str) -> tuple[list[float], list]:
        """Best score up to each position, and the arcs by their end."""
        best, arcs = [0.0], [[]]
        for end in range(1, len(text) + 1):
            here = self.arcs_to(text, end)
            arcs.append(here)
            best.append(max(best[s] + score for s, score, _ in here))
        return best, arcs

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n (score, ids), best first: backward A* with the forward scores as heuristic."""
        best, arcs = self.forward(text)
        queue = [(-best[-1], 0, len(text), 0.0, None)]
        taken = [0] * (len(text) + 1)
        found: list[tuple[float, tuple[int, ...]]] = []
        order = 0
        while queue and len(found) < n:
            _, _, at, tail, path = heapq.heappop(queue)
            taken[at] += 1
            if taken[at] > n:  # n better ends of this prefix are known
                continue
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((tail, tuple(ids)))
                continue
            for start, score, piece in arcs[at]:
                order += 1
                heapq.heappush(queue, (-(best[start] + score + tail), order, start, score + tail, (piece, path)))
        return found

    def best(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """Best score, its ids, and what the second best loses against it (inf if there is none).

        The second best takes at least one arc off the best path; the best path through an arc is the forward score
        before it, its score, and the backward score after it.
        """
        forward, arcs = self.forward(text)
        n = len(text)
        back = [float("-inf")] * n + [0.0]
        for end in range(n, 0, -1):
            tail = back[end]
            for start, score, _ in arcs[end]:
                if score + tail > back[start]:
                    back[start] = score + tail
        at, path, used = n, [], set()
        while at:
            start, score, ids = min((a for a in arcs[at] if forward[a[0]] + a[1] == forward[at]), key=lambda a: (a[0], a[2]))
            path.append(ids)
            used.add((start, at))
            at = start
        top = forward[n]
        second = max((forward[s] + score + back[e] for e in range(1, n + 1) for s, score, _ in arcs[e]
                      if (s, e) not in used), default=float("-inf"))
        return top, tuple(i for p in reversed(path) for i in p), top - second

    def best_many(self, parts: list[str]) -> list[tuple[float, bytes, float]]:
        """``best`` of many segments at once (ids as bytes): the same passes, a step for all segments of like length.

        Substrings are found among the pieces of their length by a 64-bit polynomial hash.
        """
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        start = 0
        while start < len(order):
            longest = max(len(parts[order[min(start + 4096, len(order)) - 1]]), 1)
            rows = order[start: start + 4096]
            start += 4096
            if longest > _TABLE_LENGTH:
                for i in [i for i in rows if len(parts[i]) > _TABLE_LENGTH]:
                    score, ids, loss = self.best(parts[i])
                    out[i] = (score, np.array(ids, "<u4").tobytes(), loss)
                rows = [i for i in rows if len(parts[i]) <= _TABLE_LENGTH]
                longest = _TABLE_LENGTH
            if rows:
                for i, got in zip(rows, self._table([parts[i] for i in rows], longest)):
                    out[i] = got
        return out

    def _table(self, parts: list[str], longest: int) -> list[tuple[float, bytes, float]]:
        n, sizes = len(parts), np.array([len(p) for p in parts])
        filled = np.zeros((n, longest), np.uint64)
        filled[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        chars = np.ascontiguousarray(filled.T) + np.uint64(1)  # by place, then segment, as all tables below
        none = float("-inf")
        width = min(self.longest, longest)
        score = np.full((width + 1, longest, n), none)  # by length, start, segment
        piece = np.zeros((width + 1, longest, n), np.int32)
        hashed = np.zeros((longest, n), np.uint64)
        inside = np.arange(longest)[:, None]
        for size in range(1, width + 1):
            last = longest - size + 1
            hashed[:last] = hashed[:last] * _BASE + chars[size - 1:]
            fits = inside[:last] + size <= sizes
            found = None
            if size in self.by_length:
                keys, ids, scores = self.by_length[size]
                found = fits & self.begun[size][hashed[:last] >> np.uint64(64 - _BEGIN_BITS)]
                looked = hashed[:last][found]  # few are no pieces
                at = np.minimum(np.searchsorted(keys, looked), len(keys) - 1)
                right = keys[at] == looked
                found[found] = right
                score[size][:last][found] = scores[at[right]]
                piece[size][:last][found] = ids[at[right]]
            if size == 1:
                unknown = fits & ~found if found is not None else fits
                score[1][:last][unknown] = self.unknown
                piece[1][:last][unknown] = -1
        forward = np.full((longest + 1, n), none)
        forward[0] = 0
        step = np.zeros((longest + 1, n), np.int64)
        for end in range(1, longest + 1):
            for size in range(min(width, end), 0, -1):  # the longest first, as among equals the scalar form has it
                cand = forward[end - size] + score[size, end - size]
                better = cand > forward[end]
                np.copyto(forward[end], cand, where=better)
                np.copyto(step[end], size, where=better)
        back = np.full((longest + 1, n), none)
        back[sizes, np.arange(n)] = 0
        for begin in range(longest - 1, -1, -1):
            for size in range(1, min(width, longest - begin) + 1):
                np.maximum(back[begin], back[begin + size] + score[size, begin], out=back[begin])
        top = forward[sizes, np.arange(n)]
        through = np.full(n, none)
        at, path, count = sizes.copy(), np.zeros((n, longest), np.int64), np.zeros(n, np.int64)
        on_path = np.zeros((width + 1, longest, n), bool)
        for _ in range(longest):
            live = np.flatnonzero(at)
            if not len(live):
                break
            size = step[at[live], live]
            begin = at[live] - size
            on_path[size, begin, live] = True
            path[live, longest - 1 - count[live]] = piece[size, begin, live]
            count[live] += 1
            at[live] = begin
        for size in range(1, width + 1):
            last = longest - size + 1
            via = forward[:last] + score[size][:last] + back[size:]
            via[on_path[size][:last]] = none
            np.maximum(through, via.max(axis=0), out=through)
        spelled, raw = (path < 0).any(axis=1).tolist(), path.astype("<u4").tobytes()
        out = []
        for i, (part, k, score_, loss) in enumerate(zip(parts, count.tolist(), top.tolist(), (top - through).tolist())):
            if spelled[i]:  # in bytes: the scalar form knows how
                score_, ids, loss = self.best(part)
                out.append((score_, np.array(ids, "<u4").tobytes(), loss))
            else:
                out.append((score_, raw[4 * (longest * (i + 1) - k): 4 * longest * (i + 1)], loss))
        return out

    def cuts(self, chars: np.ndarray) -> np.ndarray:
        """True at every character (but the first) that no piece joins with the one before it."""
        classes = self.classes[chars]
        return ~self.together[classes[:-1].astype(np.int64) * self.n_classes + classes[1:]]


class Encoder:
    """Whole texts; remembers a bounded number of segments."""

    def __init__(self, model_file: str, n: int, scores: np.ndarray | None = None) -> None:
        self.lattice, self.n = Lattice(model_file, scores), n
        self.parts: dict[str, tuple[float, bytes, float, bytes]] = {}
        self.runs: dict[str, list] = {}

    def segments(self, texts: pa.Array) -> pa.ListArray:
        """The independent segments of every text; an empty text has none."""
        marked = pc.replace_substring(texts, " ", SPACE)
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(SPACE, marked, ""))
        sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = b"".join(marked.cast(pa.binary()).to_pylist())
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        first = np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))  # byte after each character
        docs = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.zeros(len(raw) + 1, bool)
        edge[docs] = True
        if len(chars):
            edge[first[:-1][self.lattice.cuts(chars)]] = True
        edges = np.flatnonzero(edge)
        flat = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(raw)])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, docs).astype(np.int32)), flat)

    def others(self, part: str, top: float, best: bytes) -> list[tuple[float, bytes]]:
        """(loss, ids) of the N best of a segment; ``best`` comes first among its equals."""
        got = self.runs.get(part)
        if got is None:
            if len(self.runs) >= _MEMO // 10:
                self.runs.clear()
            got = [(max(top - s, 0.0), np.array(p, "<u4").tobytes()) for s, p in self.lattice.n_best(part, self.n)]
            got = [(0.0, best), *[g for g in got if g[1] != best][: self.n - 1]]
            if len(part) <= MEMO_CHARS:
                self.runs[part] = got
        return got

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each id occurs in the model's own encoding of some texts."""
        out = np.zeros(self.lattice.model.get_piece_size(), np.int64)
        for _, part in text_parts(texts):
            distinct, at, _ = coded_words(self.segments(part))
            own = self.lattice.own(distinct)
            times = np.repeat(np.bincount(at, minlength=len(distinct)), [len(o) // 4 for o in own])
            out += np.bincount(np.frombuffer(b"".join(own), "<u4"), times, len(out)).astype(np.int64)
        return out

    def encode(self, texts: pa.Array) -> Iterator[list[tuple[float, bytes]]]:
        """For every text up to n (score, ids as little-endian 32-bit numbers), best first."""
        return (runs for runs, _ in self.encode_both(texts))

    def encode_both(self, texts: pa.Array) -> Iterator[tuple[list[tuple[float, bytes]], bytes]]:
        """What ``encode`` gives for every text, and the ids of the model's own encoding."""
        for _, part in text_parts(texts):
            distinct, at, offsets = coded_words(self.segments(part))
            if len(self.parts) > _MEMO:
                self.parts.clear()
            unseen = [p for p in distinct if p not in self.parts]
            found = {p: (*b, o) for p, b, o in zip(unseen, self.lattice.best_many(unseen), self.lattice.own(unseen))}
            known = [found[p] if p in found else self.parts[p] for p in distinct]
            self.parts.update((p, f) for p, f in found.items() if len(p) <= MEMO_CHARS)
            scores = np.array([k[0] for k in known], np.float64)
            losses = np.array([k[2] for k in known], np.float64)[at]
            ids, place = _chained([k[1] for k in known], at)
            own, own_place = _chained([k[3] for k in known], at)
            totals = sums_by_row(scores[at], offsets)
            for total, a, b in zip(totals.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                best, plain = ids[place[a]: place[b]], own[own_place[a]: own_place[b]]
                if self.n == 1 or a == b:
                    yield [(total, best)], plain
                    continue
                # the N best change at most the N segments that lose the least, first in the text among equals
                few = [a + i for i in sorted(_smallest(losses[a:b], self.n))]
                chain = [self.others(distinct[at[i]], *known[at[i]][:2]) for i in few]
                out = []
                for loss, picks in least_sums([[run[0] for run in runs] for runs in chain], self.n):
                    pieces, done = [], place[a]
                    for i, runs, k in zip(few, chain, picks):
                        if k:
                            pieces += [ids[done: place[i]], runs[k][1]]
                            done = place[i + 1]
                    out.append((total - loss, b"".join([*pieces, ids[done: place[b]]])))
                yield out, plain


def _chained(each: list[bytes], at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of distinct segments put together in the order ``at``, and the byte where each (and the last's end) lies."""
    pool = np.frombuffer(b"".join(each), "<u4")
    sizes = np.array([len(e) // 4 for e in each], np.int64)
    begins, many = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(many)
    ids = pool[np.repeat(begins[at] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids.tobytes(), np.concatenate([[0], ends]) * 4


def _smallest(losses: np.ndarray, n: int) -> list[int]:
    few = np.flatnonzero(np.isfinite(losses))
    if len(few) > n:
        edge = np.partition(losses[few], n - 1)[n - 1]  # whole sorting of a long text is not needed
        few = few[losses[few] <= edge]
        few = few[np.argsort(losses[few], kind="stable")[:n]]
    return few.tolist()


def least_sums(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums of one entry from each list (each sorted, first entry 0), with the entries taken.

    Best-first from the end of the chain: of all choices for the lists behind, only the n best can be continued,
    since the lists before add the same to each.
    """
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for i in range(len(losses) - 1, -1, -1):
        best = heapq.nsmallest(n, ((s + loss, (k, *p)) for s, p in best for k, loss in enumerate(losses[i])))
    return best


def decode(ids: bytes, bytes_of: list[bytes]) -> str:
    """Text of ids; bytes that are no UTF-8 become the replacement character."""
    raw = b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return raw.decode("utf-8", "replace")[1:]  # without the space put in front


def piece_scores(docs: DataFrame, model_file: str) -> np.ndarray:
    """Log frequency of every id in the model's own encoding of all texts; one count per piece reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_model((model_file, "counts"), lambda: Encoder(model_file, 1))
        total = np.zeros(coder.lattice.model.get_piece_size(), np.int64)
        for batch in batches:
            total += coder.counts(batch.column(0))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    import sentencepiece

    counts = np.full(sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size(), 0.5)
    for row in docs.select("text").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] += row["n"]
    return np.log(counts / counts.sum())


def segment(docs: DataFrame, model_file: str, n: int = 4, with_ids: bool = True, scores: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, n_pieces, scores (best first), piece_crc32 (of each segmentation's ids), round_trip,
    model_crc32 (of the model's own ids), same_as_model, and the ids of the best and the model's own.

    ``scores`` by id default to ``piece_scores`` of the documents.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(piece_scores(docs, model_file) if scores is None else scores)
    key = (model_file, n, zlib.crc32(fitted.value.tobytes()))

    def lists(ids: list[bytes]) -> pa.ListArray:
        ends = np.cumsum([0, *[len(i) // 4 for i in ids]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_model(key, lambda: Encoder(model_file, n, fitted.value))
        table = coder.lattice.bytes_of
        for batch in batches:
            for start, part in text_parts(batch.column(1)):
                both = list(coder.encode_both(part))
                found, own = [f for f, _ in both], [o for _, o in both]
                cols = [batch.column(0).slice(start, len(part)), pa.array([len(f[0][1]) // 4 for f in found], pa.int64()),
                        pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                        pa.array([[zlib.crc32(i) for _, i in f] for f in found], pa.list_(pa.int64())),
                        pa.array([decode(f[0][1], table) == t for f, t in zip(found, part.to_pylist())], pa.bool_()),
                        pa.array(map(zlib.crc32, own), pa.int64()), pa.array([f[0][1] == o for f, o in both], pa.bool_())]
                names = ["doc_id", "n_pieces", "scores", "piece_crc32", "round_trip", "model_crc32", "same_as_model"]
                if with_ids:
                    cols += [lists([f[0][1] for f in found]), lists(own)]
                    names += ["ids", "model_ids"]
                yield pa.record_batch(cols, names=names)

    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(encode, f"doc_id {id_type}, n_pieces bigint, scores array<double>, piece_crc32 array<bigint>, "
                             "round_trip boolean, model_crc32 bigint, same_as_model boolean"
                             + (", ids array<int>, model_ids array<int>" if with_ids else ""))
