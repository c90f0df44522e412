"""Devices that fall silent, found by timers: no row of theirs is needed, not even a first one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundledger.streaming.folds import SILENT_KINDS, key_ddl

#: State variables and timers live in this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last_ms BIGINT, stage INT"
RECOVERED = "OUTAGE_RECOVERED"


class _Silence(StatefulProcessor):
    """Last time a device was heard, and how many stages of silence were told since. A timer stands at the next stage."""

    def __init__(self, keys: list[str], period_ms: int, by_event: bool) -> None:
        self.keys, self.by_event = keys, by_event
        self.stages = [(misses * period_ms, kind) for misses, kind in sorted(SILENT_KINDS.items())]
        self.confirmed = [kind for _, kind in self.stages].index("OUTAGE_CONFIRMED") + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", STATE)

    def _wait(self, last: int, stage: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.heard.update((last, stage))
        if stage < len(self.stages):
            self.handle.registerTimer(last + self.stages[stage][0])

    def _rows(self, key: tuple, told: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame({**{k: [v] * len(told) for k, v in zip(self.keys, key, strict=True)}, "t_us": [t * 1000 for t, _ in told], "kind": [kind for _, kind in told]})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        since = int(initialState["since_ms"].iloc[0]) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        self._wait(since, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A key that has an initial state and no rows comes with an empty frame.
        heard = [r["seen_ms"].to_numpy("i8") for r in rows if len(r)]
        if not heard:
            return
        times = np.unique(np.concatenate(heard)) if self.by_event else np.array([timerValues.getCurrentProcessingTimeInMs()])
        last, stage = (int(x) for x in self.heard.get()) if self.heard.exists() else (int(times[0]), 0)
        times = times[times > last]
        told: list[tuple[int, str]] = []
        if len(times):
            # Stages that ended before the next row although no timer came in between, as both were in one batch.
            gaps = np.diff(times, prepend=last)
            for i in np.flatnonzero(gaps > self.stages[0][0]) if stage == 0 else np.r_[0, np.flatnonzero(gaps[1:] > self.stages[0][0]) + 1]:
                before = int(times[i] - gaps[i])
                passed = [s for s in range(stage if i == 0 else 0, len(self.stages)) if self.stages[s][0] < gaps[i]]
                told += [(before + self.stages[s][0], self.stages[s][1]) for s in passed]
                if max([stage if i == 0 else 0, *[s + 1 for s in passed]]) >= self.confirmed:
                    told.append((int(times[i]), RECOVERED))
            last, stage = int(times[-1]), 0
        self._wait(last, stage)
        yield from self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, stage = (int(x) for x in self.heard.get())
        # All stages that have ended by now: a timer set here fires in the next batch only, and there may be none.
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        told: list[tuple[int, str]] = []
        while stage < len(self.stages) and last + self.stages[stage][0] <= now:
            told.append((last + self.stages[stage][0], self.stages[stage][1]))
            stage += 1
        self._wait(last, stage)
        yield from self._rows(key, told)

    def close(self) -> None:
        pass


def silence_stream(rows: DataFrame, devices: DataFrame, keys: Sequence[str], ts: str, period_ms: int = 60_000, mode: str = "ProcessingTime", watermark: str = "10 minutes") -> DataFrame:
    """``(keys, t_us, kind)``: NORESP_FIRST, OUTAGE_CONFIRMED and OUTAGE_SUSTAINED after 1, 3 and 30 periods without a row, and recoveries.

    ``devices`` are the expected devices ``(keys, since)``, a batch table: their timers start with the stream, so one that
    never speaks is told as well. With ``ProcessingTime`` silence is measured by the clock of the cluster. With
    ``EventTime`` it is measured by ``ts``: a stage is told when the watermark passes its end, or by the next row if that
    comes first, so that results do not depend on how rows fall into batches; rows later than the watermark are dropped
    by Spark, rows older than the newest of their device say nothing. Only the time of a row is read.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keys = list(keys)
    by_event = mode == "EventTime"
    slim = rows.select(*keys, ts).withColumn("seen_ms", F.unix_millis(ts))
    if by_event:
        slim = slim.withWatermark(ts, watermark)
    first = devices.select(*keys, F.unix_millis("since").alias("since_ms")).groupBy(*keys).agg(F.min("since_ms").alias("since_ms"))
    return slim.groupBy(*keys).transformWithStateInPandas(
        _Silence(keys, period_ms, by_event), f"{key_ddl(slim, keys)}, t_us BIGINT, kind STRING", "Append", mode, first.groupBy(*keys)
    )
