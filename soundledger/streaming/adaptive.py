"""A detector and a trigger whose thresholds follow the noise floor: keyed operators in a chain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundledger.operators.aggregates import BIN_HIGH, BIN_LOW, BINS, level_bin
from soundledger.operators.windows import threshold_adjust
from soundledger.streaming.folds import HALVE_ABOVE, Rule, State, detector_rule, key_ddl, trigger_rule
from soundledger.streaming.silence import ROCKSDB

#: A device that sends nothing for so long starts anew.
FORGET_MS = 30 * 24 * 3_600_000
#: Rows whose histograms are held at once.
ROWS = 8192


class _Fold(StatefulProcessor):
    """A rule over a device's ordered rows of a batch; its state is a variable that Spark forgets after a while."""

    def __init__(self, keys: list[str], order: list[str], rule: Rule, initial: State, schema: str, ttl_ms: int | None) -> None:
        self.keys, self.order, self.rule, self.initial, self.schema, self.ttl_ms = keys, order, rule, initial, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ordered = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        after, out = self.rule(ordered, tuple(self.state.get()) if self.state.exists() else self.initial)
        self.state.update(after)
        if len(out):
            for name, value in zip(reversed(self.keys), reversed(key), strict=True):
                out.insert(0, name, value)
            yield out

    def close(self) -> None:
        pass


def fold_chained(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], rule: Rule, initial: State, state_schema: str, output_schema: str, ttl_ms: int | None = FORGET_MS
) -> DataFrame:
    """As ``folds.fold_stream``, on state variables: its output may feed another keyed operator, and idle devices are forgotten.

    Forgetting goes by the clock, and a stream that watches the clock never runs out of batches: where a run shall end when
    its input does (``availableNow``), give no ``ttl_ms``. No column may start with an underscore: Spark renames such columns after the first batch.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keys, order = list(keys), list(order)
    slim = rows.select(*keys, *order, *values)
    processor = _Fold(keys, order, rule, initial, state_schema, ttl_ms)
    return slim.groupBy(*keys).transformWithStateInPandas(processor, f"{key_ddl(slim, keys)}, {output_schema}", "Append", "None" if ttl_ms is None else "ProcessingTime")


def running_floor_rule(time_us: str, tie: str, passed: Sequence[str]) -> Rule:
    """p50 and p95 of the level histogram as of each row, that row included, with counts halved on the way."""
    centres = 2.0 ** (BIN_LOW + (BIN_HIGH - BIN_LOW) * (np.arange(BINS) + 0.5) / BINS)

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        hist, total, start = np.array(state[0], "i8"), state[1], state[2]
        t, level = pdf[time_us].to_numpy("i8"), pdf["level_bin"].to_numpy("i8")
        start = int(t[0]) if start < 0 else start
        counts, quantiles = [], []
        at = 0
        while at < len(level):
            some = level[at : at + min(ROWS, HALVE_ABOVE + 1 - total)]
            upto = np.cumsum(hist + np.cumsum(some[:, None] == np.arange(BINS), axis=0), axis=1)
            n = total + np.arange(1, len(some) + 1)
            hist, total, at = np.diff(upto[-1], prepend=0), total + len(some), at + len(some)
            if total > HALVE_ABOVE:
                hist, total = hist >> 1, total >> 1
                n[-1], upto[-1] = total, np.cumsum(hist)
            counts.append(n)
            quantiles.append([centres[np.where((hit := upto >= np.floor(n * p)[:, None]).any(axis=1), hit.argmax(axis=1), BINS - 1)] for p in (0.5, 0.95)])
        p50, p95 = (np.concatenate([q[i] for q in quantiles]) for i in (0, 1))
        out = pd.DataFrame({time_us: t, tie: pdf[tie].to_numpy(), **{c: pdf[c].to_numpy() for c in passed}, "n": np.concatenate(counts), "since_us": start, "p50": p50, "p95": p95})
        return (hist.tolist(), int(total), start), out

    return rule


def with_noise_floor(rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, rms: str, values: Sequence[str], ttl_ms: int | None = FORGET_MS) -> DataFrame:
    """Each row with p50 and p95 of its device's levels so far, how many it has and since when."""
    types = dict(rows.dtypes)
    kept = ", ".join(f"`{c}` {types[c]}" for c in [time_us, tie, *values])
    return fold_chained(
        rows.withColumn("level_bin", level_bin(F.col(rms))), keys, [time_us, tie], ["level_bin", *values], running_floor_rule(time_us, tie, list(values)), ([0] * BINS, 0, -1),
        "hist ARRAY<BIGINT>, total BIGINT, start BIGINT", f"{kept}, n BIGINT, since_us BIGINT, p50 DOUBLE, p95 DOUBLE", ttl_ms,
    )


def adaptive_detector_stream(
    rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, score: str, rms: str, base: float, margin: float, streak: int, hold_us: int,
    warmup_us: int = 300_000_000, ttl_ms: int | None = FORGET_MS,
) -> DataFrame:
    """State changes of the streak detector whose threshold rises with the noise floor of its device, row by row."""
    floor = with_noise_floor(rows, keys, time_us, tie, rms, [score], ttl_ms)
    warm = F.col(time_us) - F.col("since_us") >= warmup_us
    threshold = F.lit(base) + threshold_adjust(F.col("p95"), warm, F.col("n"), margin)
    marked = floor.withColumn("hit", F.coalesce(F.col(score) >= threshold, F.lit(False)))
    start = (False, 0, -(1 << 62))
    return fold_chained(marked, keys, [time_us, tie], ["hit"], detector_rule(time_us, streak, hold_us, "hit"), start, "opened BOOLEAN, run BIGINT, newest BIGINT", "t_us BIGINT, state STRING", ttl_ms)


def adaptive_trigger_stream(
    rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, rms: str, ratio: float = 5.0, floor: float = 200.0,
    sustain_us: int = 1_500_000, cooldown_us: int = 60_000_000, warmup_us: int = 300_000_000, ttl_ms: int | None = FORGET_MS,
) -> DataFrame:
    """Fires of the sustained trigger against the running median of its device's levels."""
    level = with_noise_floor(rows, keys, time_us, tie, rms, [rms], ttl_ms)
    loud = F.coalesce(F.col(rms) > F.greatest(ratio * F.col("p50"), F.lit(floor)), F.lit(False))
    marked = level.select(*keys, time_us, tie, loud.alias("loud"), F.col(rms).cast("double").alias("level"), "p50")
    rule = trigger_rule(time_us, sustain_us, cooldown_us, warmup_us, ("loud", "level", "p50"))
    return fold_chained(marked, keys, [time_us, tie], ["loud", "level", "p50"], rule, (-1, -1, -1), "since BIGINT, fired BIGINT, start BIGINT", "fire_us BIGINT, ratio DOUBLE, level DOUBLE", ttl_ms)
