"""Keyed state on streams, a micro-batch of a device at a time.

A device's rows of one micro-batch are put in time order and turned into arrays; each rule is a few array expressions
over them and the state that the device's last batch left in Spark's state store. To catch up on a backlog, bound a
batch with ``maxFilesPerTrigger`` on the source: only the columns a rule needs of one device's share of one batch are
held at a time. Rows that come after a later batch of their device are folded where they arrive and counted by
:func:`late_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple
#: Ordered rows of a device and its state give the next state and the output rows.
Rule = Callable[[pd.DataFrame, State], tuple[State, pd.DataFrame]]


def key_ddl(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)


def fold_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], rule: Rule, initial: State, state_schema: str, output_schema: str) -> DataFrame:
    """Apply ``rule`` to each key's rows of a batch. Output rows carry the key columns first; ``output_schema`` names the rest."""
    keys, order, values = list(keys), list(order), list(values)
    slim = rows.select(*keys, *order, *values)
    schema = f"{key_ddl(slim, keys)}, {output_schema}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ordered = pd.concat([b[[*order, *values]] for b in batches]).sort_values(order, ignore_index=True)
        after, out = rule(ordered, state.get if state.exists else initial)
        state.update(after)
        if len(out):
            for name, value in zip(reversed(keys), reversed(key), strict=True):
                out.insert(0, name, value)
            yield out

    return slim.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def since_last(mask: np.ndarray, before: int) -> np.ndarray:
    """Rows since the last one in ``mask`` (0 there); ``before`` counts those of earlier batches."""
    at = np.arange(len(mask))
    last = np.maximum.accumulate(np.where(mask, at, -1))
    return np.where(last >= 0, at - last, at + 1 + before)


def held_value(mask: np.ndarray, values: np.ndarray, before: float) -> np.ndarray:
    """The value at the last row in ``mask``, the row itself included; ``before`` ahead of the first."""
    last = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    return np.where(last >= 0, values[last], before)


def shifted(values: np.ndarray, first: float) -> np.ndarray:
    return np.concatenate([[first], values[:-1]]) if len(values) else values


def late_rows(rows: DataFrame, keys: Sequence[str], time_us: str) -> DataFrame:
    """For each batch of a device the number of rows older than its newest row before the batch."""

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        t = pdf[time_us].to_numpy("i8")
        return (max(state[0], int(t[-1])),), pd.DataFrame({"newest_us": [int(t[-1])], "rows": [len(t)], "late": [int((t < state[0]).sum())]})

    return fold_stream(rows, keys, [time_us], [], rule, (-(1 << 62),), "newest BIGINT", "newest_us BIGINT, rows BIGINT, late BIGINT")


# --- detector ---------------------------------------------------------------------------------------


def detector_rule(time_us: str, streak: int, hold_us: int, hits: str = "_hit") -> Rule:
    """A streak of hits opens an episode; the first miss a hold time after the newest hit closes it.

    Neither depends on whether an episode is open, so both are marked first, and the newest mark decides.
    """

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        opened, run, newest = state
        t, hit = pdf[time_us].to_numpy("i8"), pdf[hits].to_numpy(bool)
        streaks = since_last(~hit, run)
        quiet = t - held_value(hit, t, newest)
        opens, closes = streaks >= streak, ~hit & (quiet >= hold_us)
        is_open = held_value(opens | closes, opens.astype("i8"), int(opened)).astype(bool)
        was_open = shifted(is_open, bool(opened)).astype(bool)
        changed = is_open != was_open
        out = pd.DataFrame({"t_us": t[changed], "state": np.where(is_open[changed], "crying", "idle")})
        return (bool(is_open[-1]), int(streaks[-1]), int(held_value(hit, t, newest)[-1])), out

    return rule


def detector_stream(rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, score: str, threshold: float | Column, streak: int, hold_us: int) -> DataFrame:
    """State changes of the streak detector, as they happen. The threshold may be a column that moves with the noise floor."""
    marked = rows.withColumn("_hit", F.coalesce(F.col(score) >= threshold, F.lit(False)))
    start = (False, 0, -(1 << 62))
    return fold_stream(marked, keys, [time_us, tie], ["_hit"], detector_rule(time_us, streak, hold_us), start, "opened BOOLEAN, run BIGINT, newest BIGINT", "t_us BIGINT, state STRING")


# --- sustained trigger with cooldown -----------------------------------------------------------------


def trigger_rule(time_us: str, sustain_us: int, cooldown_us: int, warmup_us: int, names: tuple[str, str, str] = ("_loud", "_level", "_p50")) -> Rule:
    """Loud for the sustain time fires, then rests for the cooldown. One search a fire, none a row."""

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        since, fired, start = state
        t = pdf[time_us].to_numpy("i8")
        start = int(t[0]) if start < 0 else start
        loud = pdf[names[0]].to_numpy(bool) & (t - start >= warmup_us)
        begins = loud & ~shifted(loud, False).astype(bool)
        begun = held_value(begins, t, -1).astype("i8")
        if since >= 0 and loud[0]:
            begun[: int(np.argmin(loud)) if not loud.all() else len(t)] = since
        ripe = np.flatnonzero(loud & (t - begun >= sustain_us))
        ends = np.append(np.flatnonzero(~loud), len(t))
        fires: list[int] = []
        rested = at = int(np.searchsorted(t, fired + cooldown_us)) if fired >= 0 else 0
        while at < len(t):
            if at > 0 and loud[at]:
                # The run under way counts from the end of the rest; later runs from where they begin.
                stop = int(ends[np.searchsorted(ends, at)])
                first = max(at, int(np.searchsorted(t, t[at] + sustain_us)))
                at = first if first < stop else stop
                if first >= stop:
                    later = int(np.searchsorted(ripe, stop))
                    at = int(ripe[later]) if later < len(ripe) else len(t)
            else:
                later = int(np.searchsorted(ripe, at))
                at = int(ripe[later]) if later < len(ripe) else len(t)
            if at < len(t):
                fires.append(at)
                fired = int(t[at])
                rested = at = max(at + 1, int(np.searchsorted(t, fired + cooldown_us)))
        under_way = loud[-1] and rested < len(t)
        since = max(int(begun[-1]), int(t[rested]) if rested else int(begun[-1])) if under_way else -1
        level, p50 = (pdf[c].to_numpy("f8")[fires] for c in names[1:])
        return (since, fired, start), pd.DataFrame({"fire_us": t[fires], "ratio": level / np.maximum(p50, 1.0), "level": level})

    return rule


def trigger_stream(
    rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, rms: str, p50: str, ratio: float = 5.0, floor: float = 200.0,
    sustain_us: int = 1_500_000, cooldown_us: int = 60_000_000, warmup_us: int = 300_000_000,
) -> DataFrame:
    """Fires of the sustained trigger: level above ``ratio`` times the median and above ``floor``."""
    loud = F.coalesce(F.col(rms) > F.greatest(ratio * F.col(p50), F.lit(floor)), F.lit(False))
    marked = rows.withColumns({"_loud": loud, "_level": F.col(rms).cast("double"), "_p50": F.col(p50).cast("double")})
    return fold_stream(
        marked, keys, [time_us, tie], ["_loud", "_level", "_p50"], trigger_rule(time_us, sustain_us, cooldown_us, warmup_us), (-1, -1, -1),
        "since BIGINT, fired BIGINT, start BIGINT", "fire_us BIGINT, ratio DOUBLE, level DOUBLE",
    )


# --- noise floor -------------------------------------------------------------------------------------

#: Fixed value: samples after which all counts are halved.
HALVE_ABOVE = 65_535


def floor_rule(time_us: str, bins: int) -> Rule:
    """Level bins counted up to the next halving at a time."""

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        hist, total, start = np.array(state[0], "i8"), state[1], state[2]
        t, level = pdf[time_us].to_numpy("i8"), pdf["_bin"].to_numpy("i8")
        at = 0
        while at < len(level):
            some = level[at : at + HALVE_ABOVE + 1 - total]
            hist, total, at = hist + np.bincount(some, minlength=bins), total + len(some), at + len(some)
            if total > HALVE_ABOVE:
                hist, total = hist >> 1, total >> 1
        start = int(t[0]) if start < 0 else start
        out = pd.DataFrame({"t_us": [int(t[-1])], "start_us": [start], "n": [total], "hist": [hist.tolist()]})
        return (hist.tolist(), total, start), out

    return rule


def noise_floor_stream(rows: DataFrame, keys: Sequence[str], time_us: str, tie: str, rms: str, warmup_us: int = 300_000_000) -> DataFrame:
    """The level histogram after each micro-batch of a device, with its p50 and p95 and whether it is warm."""
    from soundledger.operators.aggregates import BINS, hist_quantile, level_bin

    out = fold_stream(
        rows.withColumn("_bin", level_bin(F.col(rms))), keys, [time_us, tie], ["_bin"], floor_rule(time_us, BINS), ([0] * BINS, 0, -1),
        "hist ARRAY<BIGINT>, total BIGINT, start BIGINT", "t_us BIGINT, start_us BIGINT, n BIGINT, hist ARRAY<BIGINT>",
    )
    return out.select(
        *keys, "t_us", "n", hist_quantile(F.col("hist"), 0.5).alias("p50"), hist_quantile(F.col("hist"), 0.95).alias("p95"),
        (F.col("t_us") - F.col("start_us") >= warmup_us).alias("warm"),
    )


# --- health monitor ----------------------------------------------------------------------------------

MONITOR_VALUES = ["answered", "parse_error", "uptime", "state", "peak", "alerts", "overruns", "counter", "captures"]
MONITOR_STATE = "uptime BIGINT, overruns BIGINT, alerts BIGINT, counter BIGINT, captures BIGINT, silent BIGINT, stuck BIGINT"
MONITOR_START = (0, 0, 0, 0, -1, 0, 0)
#: Names of anomalies, quiet states, and limits.
QUIET_STATES = ("idle", "LISTEN")
SILENT_KINDS = {1: "NORESP_FIRST", 3: "OUTAGE_CONFIRMED", 30: "OUTAGE_SUSTAINED"}
MANY_OVERRUNS, PEAK_SIGNAL, STALLED_POLLS = 100, 0.55, 2


def monitor_rule(time_us: str, tie: str) -> Rule:
    """Anomalies of polls as one mask a kind, over three views: all polls, readable ones, and those that report captures."""

    def rule(pdf: pd.DataFrame, state: State) -> tuple[State, pd.DataFrame]:
        uptime, overruns, alerts, counter, captures, silent, stuck = state
        places: list[np.ndarray] = []
        kinds: list[str] = []

        def report(view: np.ndarray, mask: np.ndarray, kind: str) -> None:
            places.append(view[mask])
            kinds.append(kind)

        polls = np.arange(len(pdf))
        answered = pdf["answered"].to_numpy(bool)
        quiet = since_last(answered, silent)
        for misses, kind in SILENT_KINDS.items():
            report(polls, quiet == misses, kind)
        report(polls, answered & (shifted(quiet, silent) >= 3), "OUTAGE_RECOVERED")
        garbled = answered & (pdf["parse_error"].to_numpy() == True)  # noqa: E712  a null is no error
        report(polls, garbled, "METRICS_PARSE_ERR")

        read = polls[answered & ~garbled]
        if len(read):
            now = {c: pdf[c].to_numpy()[read].astype("i8") for c in ("uptime", "overruns", "alerts", "counter")}
            last = {c: shifted(now[c], v) for c, v in (("uptime", uptime), ("overruns", overruns), ("alerts", alerts), ("counter", counter))}
            reboot = (last["uptime"] != 0) & (now["uptime"] < last["uptime"])
            moved = (last["counter"] == 0) | reboot | (now["counter"] > last["counter"])
            still = since_last(moved, stuck)
            report(read, reboot, "REBOOT")
            report(read, still == STALLED_POLLS, "INFERENCE_STALLED")
            report(read, (last["overruns"] != 0) & (now["overruns"] - last["overruns"] > MANY_OVERRUNS), "OVRGROW_BIG")
            report(read, ~np.isin(pdf["state"].to_numpy()[read].astype(str), QUIET_STATES), "STATE")
            report(read, pdf["peak"].to_numpy("f8")[read] > PEAK_SIGNAL, "CRY_SIGNAL")
            report(read, now["alerts"] > last["alerts"], "ALERT_FIRED")
            counted = read[pdf["captures"].notna().to_numpy()[read]]
            if len(counted):
                have = pdf["captures"].to_numpy()[counted].astype("i8")
                had = shifted(have, captures)
                report(counted, (had >= 0) & (have > had), "NEW_WAV")
                captures = int(have[-1])
            uptime, overruns, alerts, counter = (int(now[c][-1]) for c in ("uptime", "overruns", "alerts", "counter"))
            stuck = int(still[-1])
        at = np.concatenate(places)
        out = pd.DataFrame({"t_us": pdf[time_us].to_numpy()[at], tie: pdf[tie].to_numpy()[at], "kind": np.repeat(kinds, [len(p) for p in places])})
        return (uptime, overruns, alerts, counter, captures, int(quiet[-1]), stuck), out

    return rule


def monitor_stream(polls: DataFrame, keys: Sequence[str], time_us: str, tie: str) -> DataFrame:
    """Anomalies of device polls. Needs the columns of ``MONITOR_VALUES``; unanswered polls are rows too."""
    return fold_stream(polls, keys, [time_us, tie], MONITOR_VALUES, monitor_rule(time_us, tie), MONITOR_START, MONITOR_STATE, f"t_us BIGINT, {tie} BIGINT, kind STRING")


def unheard(devices: DataFrame, polls: DataFrame, keys: Sequence[str], time_us: str, now_us: int, limit_us: int) -> DataFrame:
    """Expected devices without an answered poll in the last ``limit_us``: those that sent no rows at all are found too."""
    heard = polls.filter("answered").groupBy(*keys).agg(F.max(time_us).alias("last_us"))
    met = devices.select(*keys).distinct().join(heard, list(keys), "left")
    return met.filter(F.col("last_us").isNull() | (now_us - F.col("last_us") > limit_us)).withColumn("kind", F.lit("NORESP_FIRST"))
