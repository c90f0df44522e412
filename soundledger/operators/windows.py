"""Sequence operators: detector episodes, sustained levels, run lengths, poll deltas, boot lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundledger.operators.chunks import MICROS, neighbour, numbered, running, trailing_rows, with_chunks


def first_owner(df: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key, from the first owner. An aggregate combines hot keys before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return picked.select(*key, "_r.*")


def largest_copy(df: DataFrame, key: Sequence[str], size: str, ties: Sequence[str]) -> DataFrame:
    """One row per key: the largest copy, the earliest of equals."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(size), *ties)).alias("_r"))
    return picked.select(*key, "_r.*")


def detector_episodes(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    tie: str,
    score: str,
    threshold: Column,
    streak: int,
    hold_us: int,
    **chunking,
) -> DataFrame:
    """Episodes of a streak detector with a hold time.

    A run of ``streak`` scores at or above the threshold opens an episode, every
    further hit renews the hold, and the first miss at or after its end closes
    it. An open episode has a null end. Rows between two closing misses form a
    segment, so opening and closing times meet by segment number in one
    aggregate and no window runs over a whole device.
    """
    keys = list(keys)
    rows = df.select(*keys, time_us, tie, (F.col(score) >= threshold).alias("_hit"))
    rows = with_chunks(rows, keys, time_us, **chunking)
    order = [time_us, tie]
    rows = running(
        rows,
        keys,
        order,
        {"_last_hit": ("max", F.when(F.col("_hit"), F.col(time_us))), "_rn": ("count", F.lit(1))},
    )
    rows = running(rows, keys, order, {"_last_miss": ("max", F.when(~F.col("_hit"), F.col("_rn")))})
    run = F.col("_rn") - F.coalesce(F.col("_last_miss"), F.lit(0))
    rows = rows.withColumn("_cand", F.col("_hit") & (run >= streak)).withColumn(
        "_expired", F.coalesce(~F.col("_hit") & (F.col(time_us) >= F.col("_last_hit") + hold_us), F.lit(False))
    )
    rows = running(rows, keys, order, {"_seg": ("sum", F.col("_expired").cast("bigint"))})
    marks = rows.filter(F.col("_cand") | F.col("_expired")).select(
        *keys,
        F.when(F.col("_expired"), F.col("_seg") - 1).otherwise(F.col("_seg")).alias("_seg"),
        F.when(F.col("_cand"), F.col(time_us)).alias("_open"),
        F.when(F.col("_expired"), F.col(time_us)).alias("_close"),
    )
    out = marks.groupBy(*keys, "_seg").agg(F.min("_open").alias("start_us"), F.min("_close").alias("end_us"))
    return out.filter(F.col("start_us").isNotNull()).drop("_seg")


def threshold_adjust(p95: Column, warm: Column, samples: Column, margin: float, low: float = 500.0, high: float = 5000.0) -> Column:
    """Rise of the detector threshold with the noise floor; zero before warm-up or below 64 samples."""
    slope = F.lit(float(margin)) * (p95 - low) / (high - low)
    return (
        F.when(~warm | (samples < 64) | (p95 <= low), 0.0).when(p95 >= high, float(margin)).otherwise(slope)
    )


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], in_run: Column, out: str) -> DataFrame:
    """Length of the current run of rows where ``in_run`` holds, zero outside a run. Needs chunks."""
    marked = numbered(df.withColumn("_in", F.coalesce(in_run, F.lit(False))), keys, order, "_rn")
    marked = running(marked, keys, order, {"_brk": ("max", F.when(~F.col("_in"), F.col("_rn")))})
    return marked.withColumn(out, F.col("_rn") - F.coalesce(F.col("_brk"), F.lit(0))).drop("_in", "_rn", "_brk")


def sustained_level(
    df: DataFrame, keys: Sequence[str], time_us: str, tie: str, level: str, threshold: Column, sustain_us: int, **chunking
) -> DataFrame:
    """First moment in each run above the threshold at which the run has lasted long enough."""
    keys, order = list(keys), [time_us, tie]
    rows = with_chunks(df.select(*keys, *order, level, (F.col(level) > threshold).alias("_above")), keys, time_us, **chunking)
    rows = neighbour(rows, keys, order, {"_prev_above": F.col("_above")})
    begins = F.col("_above") & ~F.coalesce(F.col("_prev_above"), F.lit(False))
    rows = running(rows, keys, order, {"since_us": ("max", F.when(begins, F.col(time_us)))})
    fired = rows.filter(F.col("_above") & (F.col(time_us) - F.col("since_us") >= sustain_us))
    return fired.groupBy(*keys, "since_us").agg(
        F.min(F.struct(time_us, tie, level)).alias("_f")
    ).select(*keys, "since_us", F.col(f"_f.{time_us}").alias("fire_us"), F.col(f"_f.{level}").alias(level))


def anchor_uptime(df: DataFrame, boot_keys: Sequence[str], ts_us: str, uptime_s: str, order: Sequence[str]) -> DataFrame:
    """Give rows logged before clock sync a wall time from their boot's first synced row."""
    synced = F.col(ts_us).isNotNull()
    offset = F.when(synced, F.col(ts_us) - F.col(uptime_s) * MICROS)
    anchors = df.filter(synced).groupBy(*boot_keys).agg(F.min_by(offset, F.struct(*order)).alias("_anchor"))
    return (
        df.join(anchors, list(boot_keys), "left")
        .withColumn("wall_us", F.coalesce(F.col(ts_us), F.col("_anchor") + F.col(uptime_s) * MICROS))
        .drop("_anchor")
    )


def poll_deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], **chunking) -> DataFrame:
    """Reboots, overrun bursts, new captures and alert rises between answered polls.

    Needs ``uptime``, ``overruns``, ``captures`` and ``alerts``. The alert count
    before the first poll counts as zero, as do a zero uptime or overrun count
    for "nothing seen yet".
    """
    cols = ["uptime", "overruns", "captures", "alerts"]
    rows = with_chunks(df, keys, order[0], **chunking)
    rows = neighbour(rows, keys, order, {f"prev_{c}": F.col(c) for c in cols})
    up, ovr, alerts = (F.coalesce(F.col(f"prev_{c}"), F.lit(0)) for c in ("uptime", "overruns", "alerts"))
    return rows.withColumns(
        {
            "reboot": (up != 0) & (F.col("uptime") < up),
            "overrun_burst": (ovr != 0) & (F.col("overruns") - ovr > 100),
            "new_capture": F.coalesce(F.col("captures") > F.col("prev_captures"), F.lit(False)),
            "alert_fired": F.col("alerts") > alerts,
        }
    )


def stalls(df: DataFrame, keys: Sequence[str], order: Sequence[str], uptime: str, counter: str, polls: int = 2, **chunking) -> DataFrame:
    """Polls at which a counter has stood still for exactly ``polls`` polls; a reboot starts over."""
    rows = with_chunks(df, keys, order[0], **chunking)
    rows = neighbour(rows, keys, order, {"_up": F.col(uptime), "_cnt": F.col(counter)})
    reboot = (F.coalesce(F.col("_up"), F.lit(0)) != 0) & (F.col(uptime) < F.col("_up"))
    before = F.when(reboot, 0).otherwise(F.coalesce(F.col("_cnt"), F.lit(0)))
    stuck = (before != 0) & (F.col(counter) <= before)
    rows = runs(rows, keys, order, stuck, "stall_run")
    return rows.filter(F.col("stall_run") == polls).drop("_up", "_cnt")


def outages(df: DataFrame, keys: Sequence[str], order: Sequence[str], answered: Column, **chunking) -> DataFrame:
    """No-response events: first, confirmed after 3, sustained after 30, recovered after at least 3."""
    rows = with_chunks(df.withColumn("_ok", answered), keys, order[0], **chunking)
    rows = runs(rows, keys, order, ~F.col("_ok"), "silent_run")
    rows = neighbour(rows, keys, order, {"_silent_before": F.col("silent_run")})
    before = F.coalesce(F.col("_silent_before"), F.lit(0))
    kind = (
        F.when(F.col("_ok") & (before >= 3), "OUTAGE_RECOVERED")
        .when(F.col("silent_run") == 1, "NORESP_FIRST")
        .when(F.col("silent_run") == 3, "OUTAGE_CONFIRMED")
        .when(F.col("silent_run") == 30, "OUTAGE_SUSTAINED")
    )
    length = F.when(F.col("_ok"), before).otherwise(F.col("silent_run"))
    return rows.select("*", kind.alias("kind"), length.alias("polls")).filter(F.col("kind").isNotNull()).drop(
        "_ok", "_silent_before", "silent_run"
    )


def row_split(position: Column) -> Column:
    """Rows 0 to 2 of every five train, the fourth validates, the fifth tests."""
    r = F.pmod(position, F.lit(5))
    return F.when(r == 4, "test").when(r == 3, "val").otherwise("train")


def session_split(session: Column, seed: int = 0) -> Column:
    """A whole session in one split, so that no session is on both sides of an evaluation."""
    return row_split(F.pmod(F.xxhash64(F.lit(seed), session), F.lit(5)))


def level_signals(df: DataFrame, state: str, peak: str, limit: float = 0.55) -> DataFrame:
    """Polls outside the idle states, and polls whose peak score passes the limit."""
    return df.withColumn("state_left_idle", ~F.col(state).isin("idle", "LISTEN")).withColumn(
        "signal", F.col(peak) > limit
    ).filter(F.col("state_left_idle") | F.col("signal"))


def drop_accounting(df: DataFrame, keys: Sequence[str], order: Sequence[str], lost: str, **chunking) -> DataFrame:
    """Running bytes and events lost."""
    rows = with_chunks(df, keys, order[0], **chunking)
    is_loss = F.col(lost) > 0
    return running(
        rows,
        keys,
        order,
        {"lost_total": ("sum", F.when(is_loss, F.col(lost)).otherwise(0)), "loss_events": ("count", F.when(is_loss, 1))},
    )


def boot_lineage(df: DataFrame, device: str, boot: str, order: Sequence[str], stage: str, generation: str) -> DataFrame:
    """One row per boot: its last stage, the last stage of the boot before, and the device's first generation id."""
    boots = df.groupBy(device, boot).agg(
        F.max_by(stage, F.struct(*order)).alias("last_stage"),
        F.min(F.struct(*order, generation)).alias("_first"),
    )
    by_device = Window.partitionBy(device).orderBy(boot)
    whole = Window.partitionBy(device)
    return boots.select(
        device,
        boot,
        "last_stage",
        F.lag("last_stage").over(by_device).alias("prev_stage"),
        F.min("_first").over(whole)[generation].alias("generation_id"),
    )


def trailing_p95(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, depth: int = 64, **chunking) -> DataFrame:
    """95th percentile of the last ``depth`` values, taken at position n*95/100."""
    rows = with_chunks(df, keys, order[0], **chunking)
    rows = trailing_rows(rows, keys, order, depth, {"_hist": lambda w: F.collect_list(value).over(w)})
    at = F.floor(F.size("_hist") * 95 / 100).cast("int")
    return rows.withColumn("p95", F.get(F.sort_array("_hist"), at)).drop("_hist")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, drop: bool = False, **chunking) -> DataFrame:
    """The newest ``n`` rows per key, or with ``drop`` all others. Ranks add up over chunks, newest chunk first."""
    rows = numbered(with_chunks(df, keys, order[0], **chunking), keys, order, "age_rank", backward=True)
    return rows.filter(F.col("age_rank") > n if drop else F.col("age_rank") <= n).drop("_chunk")
