"""Streams with state of their own: retraining cool-down, running moments and conversation memory."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beaconry.operators.chains import triggers
from beaconry.operators.kpi import Z_LIMIT
from beaconry.session import stored
from beaconry.settings import DEFAULTS
from beaconry.streaming import runner


def cooldown_decisions(
    cycles: DataFrame, cooldown: int = DEFAULTS.retrain_cooldown_seconds, out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Decision per cycle of a stream (model_id, cycle_id, at, any_drift), over all batches so far.

    The state is a table: when each model was retrained last. A batch finds its triggers as the batch operator does (see
    ``chains``), held back by that table, so a model with most of the rows is spread over the cluster. Of cycles at the same
    second the one with the smallest id triggers.
    """

    def decide(batch: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        drifting = batch.where("any_drift")
        held = None if last is None else last.select("model_id", (F.col("at") + cooldown).alias("at"))
        fired = stored(triggers(drifting, "model_id", "at", cooldown, held), "fired")
        first = drifting.join(fired, ["model_id", "at"], "left_semi").groupBy("model_id", "at").agg(
            F.min("cycle_id").alias("cycle_id"), F.lit("retraining_triggered").alias("decision"))
        calm = F.when(F.col("any_drift"), "cool_down_active").otherwise("model_stable")
        rows = batch.join(first, ["model_id", "at", "cycle_id"], "left").select(
            "model_id", "cycle_id", "at", F.coalesce("decision", calm).alias("decision"))
        known = fired if last is None else fired.unionByName(last)
        return rows, known.groupBy("model_id").agg(F.max("at").alias("at"))

    return runner.run(cycles, "cooldown", out=out, checkpoint=checkpoint, carry=decide)


class MomentsProcessor(StatefulProcessor):
    """Number, mean and sum of squared deviations of each metric; a value is merged in and judged."""

    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n bigint, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
        new = pd.concat(list(rows)).dropna(subset=["value"]).sort_values("day")  # windows closed by one batch: the calendar bounds them
        out = []
        for day, value in zip(new["day"], new["value"]):
            n, step = n + 1, value - mean
            mean += step / n
            m2 += step * (value - mean)
            z = (value - mean) / (m2 / (n - 1)) ** 0.5 if n > 1 and m2 > 0 else None
            out.append((key[0], day, value, n, mean, z, z is not None and abs(z) > self.limit))
        if n:
            self.moments.update((n, mean, m2))
        yield pd.DataFrame(out, columns=["metric_name", "day", "value", "n", "mean", "z_score", "is_anomaly"]).astype(
            {"value": "float64", "n": "int64", "mean": "float64", "z_score": "float64", "is_anomaly": "bool"})

    def close(self) -> None:
        pass


def running_z_scores(history: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Each closed window's value (metric_name, day, value) against all of its metric so far, itself included."""
    schema = "metric_name string, day date, value double, n bigint, mean double, z_score double, is_anomaly boolean"
    return history.groupBy("metric_name").transformWithStateInPandas(MomentsProcessor(limit), schema, "append", "none")


class MemoryProcessor(StatefulProcessor):
    """Keeps the last answered turns of each conversation until they are cleared or expire."""

    def __init__(self, turns: int, ttl_ms: int) -> None:
        self.turns, self.ttl_ms = turns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn bigint, question string", ttlDurationMs=self.ttl_ms)
        self.cleared = handle.getValueState("cleared", "turn bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        cleared = self.cleared.get()[0] if self.cleared.exists() else None
        before = cleared
        for chunk in rows:  # only a few turns stay, however many rows a batch brings
            marks = chunk.loc[chunk["clears"], "turn"]
            if len(marks):
                cleared = int(marks.max()) if cleared is None else max(cleared, int(marks.max()))
            said = chunk.loc[chunk["answered"] & ~chunk["clears"], ["turn", "question"]].nlargest(self.turns, "turn")
            known = heapq.nlargest(self.turns, [*known, *zip(said["turn"].astype(int), said["question"])], key=lambda r: r[0])
        known = [r for r in known if cleared is None or r[0] > cleared]
        if cleared != before:
            self.cleared.update((cleared,))
        if known:
            self.kept.put(known)
        else:
            self.kept.clear()
        turns, questions = ([r[i] for r in known] + [None] * (self.turns - len(known)) for i in (0, 1))
        yield pd.DataFrame({"conv_id": key[0], "age": pd.Series(range(1, self.turns + 1), dtype="int32"),
                            "turn": pd.array(turns, "Int64"), "question": pd.Series(questions, dtype="object")})

    def close(self) -> None:
        pass


def conversation_memory(turns: DataFrame, keep: int = DEFAULTS.memory_turns, ttl_hours: int = 24 * 30) -> DataFrame:
    """Memory of every conversation a batch touched (conv_id, turn, question, answered, clears), newest turn first.

    A row that ``clears`` makes the conversation forget all turns up to it; memory that is not touched for ``ttl_hours`` is
    dropped. One row per place comes out, with a null turn where there is none, so that output of earlier batches is replaced.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(
        MemoryProcessor(keep, ttl_hours * 3_600_000), "conv_id bigint, age int, turn bigint, question string", "update", "processingTime")
