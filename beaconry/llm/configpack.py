"""Packing documents into as few sequences as possible by a configuration linear program.

Only the histogram of piece lengths matters for how many sequences are needed. A configuration says how many pieces of
each length share a sequence; the program covers every length's pieces with as little configuration weight as possible.
It is solved by multiplicative weights: a length's price is its size, lowered exponentially by the share of its
pieces that are covered already. One dynamic program per round (a knapsack with as many copies of a length as there
are pieces left) prices all capacities at once, which gives for every length that lags behind the best configuration that holds it.
Rounding takes configurations whole, the most used first, as often as the pieces allow; the pieces that are left are solved
anew a few times, and the last of them go best-fit, longest first.

The histogram (at most as many rows as a sequence has places) is all that reaches the driver. Pieces know their rank among those
of their length within their task; one row per task and length tells how many came before, so that no window
ever holds all pieces of one length. The plan's runs (length, ranks, sequence, offset) then place each piece. Their number
depends on lengths and rounds, not on the number of documents.

Defined cases: null text has the end id only; null or repeated ids are documents of their own like all others; an
empty table gives an empty result; a document longer than a sequence is cut into full pieces and a rest, however long it is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.tokens import WordMemo
from beaconry.session import stored

LENGTH = 4096
#: Learning prices: classes of length, rounds, the share of a class covered in one, and how strongly coverage lowers a price.
CLASSES, LEARNING_ROUNDS, LEARNING_STEP, SHARPNESS = 96, 120, 0.1, 1.0
#: Solving: rounds, the largest share of a length's pieces covered in one, and how strongly coverage lowers a price.
ROUNDS, STEP, DECAY = 8, 0.34, 1.0
#: Configurations are used that are worth less than the best one by at most this share.
SLACK = 0.02
#: How often what rounding leaves is solved anew.
PASSES = 3

Config = tuple[tuple[int, int], ...]  # (length, copies), lengths falling


class Knapsack:
    """Best value of pieces within every capacity, each length at most as often as there are pieces of it."""

    def __init__(self, lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        self.lengths = lengths
        self.bundles: list[tuple[int, int]] = []  # (index of a length, copies)
        for i, (length, n) in enumerate(zip(lengths.tolist(), np.minimum(left, capacity // lengths).tolist())):
            size = 1
            while n > 0:
                self.bundles.append((i, min(size, n)))
                n -= size
                size *= 2
        best = np.zeros(capacity + 1)
        self.taken = np.zeros((len(self.bundles), capacity + 1), bool)
        for b, (i, copies) in enumerate(self.bundles):
            size, value = int(lengths[i]) * copies, prices[i] * copies
            if size > capacity:
                continue
            other = best[: capacity + 1 - size] + value
            better = other > best[size:]
            self.taken[b, size:] = better
            best[size:][better] = other[better]
        self.best = best

    def contents(self, capacities: np.ndarray) -> np.ndarray:
        """Copies of each length (columns) in the best filling of each capacity (rows)."""
        out = np.zeros((len(capacities), len(self.lengths)), np.int32)
        room = capacities.astype(np.int64).copy()
        for b in range(len(self.bundles) - 1, -1, -1):
            i, copies = self.bundles[b]
            use = np.flatnonzero(self.taken[b, room])
            if len(use):
                out[use, i] += copies
                room[use] -= int(self.lengths[i]) * copies
        return out


def learned_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Prices of lengths after many small steps on a histogram of at most CLASSES classes of length.

    A class counts its pieces with the length of its longest. Lengths that are covered as fillers anyway become cheap, lengths that
    decide how many sequences are needed dear; between classes prices are interpolated.
    """
    ascending = np.argsort(lengths)
    mass = np.cumsum((lengths * counts)[ascending])
    group = np.zeros(len(lengths), np.int64)
    group[ascending] = np.arange(len(lengths)) if len(lengths) <= CLASSES else np.minimum(
        (mass - 1) * CLASSES // mass[-1], CLASSES - 1)
    _, group = np.unique(group, return_inverse=True)
    size, total = np.zeros(group.max() + 1, np.int64), np.bincount(group, counts)
    np.maximum.at(size, group, lengths)
    covered, sums = np.zeros(len(size)), np.zeros(len(size))
    copies = np.maximum(total, 1).astype(np.int64)
    for number in range(LEARNING_ROUNDS):
        prices = size * np.exp(-SHARPNESS * (covered - covered.min()))
        if number >= LEARNING_ROUNDS // 2:
            sums += prices / prices.max()
        knapsack = Knapsack(size, copies, prices, capacity)
        value = prices + knapsack.best[capacity - size]
        rows = np.flatnonzero(value >= (1 - SLACK) * value.max())
        contents = knapsack.contents(capacity - size[rows])
        contents[np.arange(len(rows)), rows] += 1
        quota = np.full(len(size), LEARNING_STEP)
        for row in np.argsort(-value[rows], kind="stable"):
            used = np.flatnonzero(contents[row])
            share = contents[row, used] / total[used]
            times = (quota[used] / share).min()
            quota[used] -= times * share
            covered[used] += times * share
    by_size = np.argsort(size)
    return np.interp(lengths, np.concatenate([[0], size[by_size]]), np.concatenate([[0.0], sums[by_size]]))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, learn: bool) -> dict[Config, float]:
    """Weights of configurations that together cover every length (nearly all of it), by multiplicative weights.

    With learned prices only configurations near the best are used before the last round. Prices that start as sizes
    only know which lengths lag, so there every lagging length gets the best configuration that holds it.
    """
    weight: dict[Config, float] = {}
    left = counts.astype(np.float64)
    start = learned_prices(lengths, counts, capacity) if learn else lengths.astype(np.float64)
    for number in range(ROUNDS):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            break
        last = number == ROUNDS - 1
        size, total = lengths[open_], counts[open_]
        prices = start[open_] * np.exp(DECAY * (left[open_] / total - 1))
        knapsack = Knapsack(size, np.ceil(left[open_]).astype(np.int64), prices, capacity)
        # what a length may give in this round: all that is left in the last one, and of few pieces
        quota = left[open_] if last else np.minimum(left[open_], np.maximum(STEP * total, 1.0))
        value = prices + knapsack.best[capacity - size]
        rows = np.arange(len(size)) if last or not learn else np.flatnonzero(value >= (1 - SLACK) * value.max())
        contents = knapsack.contents(capacity - size[rows])
        contents[np.arange(len(rows)), rows] += 1
        lag = np.zeros(len(rows)) if learn else left[open_] / total
        for row in np.lexsort((-size[rows], -value[rows], -lag)):
            if quota[rows[row]] <= 1e-9:
                continue
            used = np.flatnonzero(contents[row])
            copies = contents[row, used]
            times = float((quota[used] / copies).min())
            if times <= 1e-9:
                continue
            quota[used] -= times * copies
            left[open_[used]] -= times * copies
            config = tuple(zip(size[used].tolist(), copies.tolist()))
            weight[config] = weight.get(config, 0.0) + times
    return weight


def best_fit(left: dict[int, int], capacity: int) -> dict[Config, int]:
    """Pack what is left, longest first, each piece into the fullest sequence that holds it."""
    bins: dict[int, Counter] = {}  # room left -> contents -> how many sequences
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = min(capacity // length, n)
                many, rest = n // each, capacity - each * length
                bins.setdefault(rest, Counter())[((length, each),)] += many
                n -= many * each
                continue
            contents = next(iter(bins[room]))
            many = min(bins[room][contents], n)
            bins[room][contents] -= many
            if not bins[room][contents]:
                del bins[room][contents]
                if not bins[room]:
                    del bins[room]
            fuller = (*contents[:-1], (length, contents[-1][1] + 1)) if contents[-1][0] == length else (*contents, (length, 1))
            bins.setdefault(room - length, Counter())[fuller] += many
            n -= many
    return dict(sum(bins.values(), Counter()))


def solve(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[Config, int]]:
    """(configuration, how many sequences of it): every piece of the histogram exactly once.

    Prices start as sizes, which is best where fillers abound; if more sequences come out than full ones would need,
    prices are learned as well, weights are also rounded down, and the best plan counts.
    """
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best: Counter | None = None
    for learn, up in ((False, True), (True, True), (True, False)):
        plan = rounded(histogram, capacity, learn, up)
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) == least:
            break
    return sorted(best.items(), key=lambda c: (-c[1], c[0]))


def rounded(histogram: dict[int, int], capacity: int, learn: bool, up: bool) -> Counter:
    """Whole numbers of configurations that hold every piece once; a weight's part of a sequence is rounded up or down."""
    left = {length: n for length, n in histogram.items() if n}
    plan: Counter = Counter()
    for _ in range(PASSES):
        if not left:
            break
        lengths = np.array(sorted(left, reverse=True), np.int64)
        weight = fractional(lengths, np.array([left[x] for x in lengths.tolist()], np.int64), capacity, learn)
        fill = {c: sum(a * b for a, b in c) for c in weight}
        before = sum(left.values())
        for config in sorted(weight, key=lambda c: (-weight[c], -fill[c], c)):
            if fill[config] * 100 < capacity * 99 and weight[config] < 1:
                continue  # a loose configuration of less than one sequence: its pieces may fit better once others are settled
            times = min(-int(-weight[config] // 1) if up else int(weight[config] + 1e-9), min(left.get(x, 0) // n for x, n in config))
            if times:
                plan[config] += times
                for x, n in config:
                    left[x] -= times * n
        left = {x: n for x, n in left.items() if n}
        if sum(left.values()) == before:
            break
    plan.update(best_fit(left, capacity))
    return plan


class Runs:
    """Where the piece of a length and a rank lies: runs of ranks, searched by (length, rank)."""

    _RANKS = np.int64(1) << 48

    def __init__(self, plan: list[tuple[Config, int]]) -> None:
        rows, done, first = [], Counter(), 0
        for config, times in plan:
            offset = 0
            for length, copies in config:
                rows.append((length, done[length], first, copies, offset))
                done[length] += copies * times
                offset += copies * length
            first += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.start, self.table = table[:, 0] * self._RANKS + table[:, 1], table

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.start, length * self._RANKS + rank, "right") - 1
        _, begin, first, copies, offset = self.table[at].T
        inside = rank - begin
        return first + inside // copies, offset + inside % copies * length


_PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, in_task bigint"
_memos: dict[str, WordMemo] = {}


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = LENGTH) -> DataFrame:
    """One row per piece; ``in_task`` is its rank among the pieces of its length in its task."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _memos:
            _memos.clear()
            _memos[tokenizer_file] = WordMemo(tokenizer_file, "<u4")
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                cols: list[list[int]] = [[], [], [], [], [], []]
                for row, raw in enumerate(_memos[tokenizer_file].ids(part.column(1), end)):
                    for number, at in enumerate(range(0, len(raw) // 4, capacity)):
                        piece = raw[4 * at: 4 * (at + capacity)]
                        length = len(piece) // 4
                        for col, value in zip(cols, (row, number, at, length, zlib.crc32(piece), seen[length])):
                            col.append(int(value))
                        seen[length] += 1
                row, number, *others = cols
                yield pa.record_batch(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in others[:3]], pa.array(np.full(len(row), task, np.int32)),
                     pa.array(others[3], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "in_task"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(cut, _PIECES.format(id=source.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = LENGTH) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = stored(pieces(docs, tokenizer_file, end_id, capacity), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    tasks = stored(counts.withColumn("before", before), "lengths")
    histogram = {r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Runs(solve(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.places(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(tasks.drop("n"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_task")).alias("rank"))
    return ranked.mapInArrow(place, _PIECES.format(id=cut.schema["doc_id"].dataType.simpleString()).split(", task")[0]
                             + ", sequence_id bigint, offset bigint")
