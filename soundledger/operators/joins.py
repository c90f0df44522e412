"""Joins by key, by nearest time, by time range and by interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundledger.functions.text import mirror_path
from soundledger.operators.chunks import MICROS, neighbour, running, with_chunks


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time_us: str,
    line: str,
    payload: Sequence[str],
    tolerance_us: int,
    **chunking,
) -> DataFrame:
    """As-of join to the nearest right row of the same key, at most ``tolerance_us`` away.

    Left and right rows are merged in time order. The last right row at or
    before a left row and the first at or after it are running aggregates, so
    a left row meets two candidates however many right rows are near. Of
    equally near ones the lower ``line`` wins. Unmatched left rows stay, with nulls.
    """
    keys, payload = list(keys), list(payload)
    body = F.struct(F.col(time_us).alias("t"), F.col(line).alias("line"), *[F.col(p).alias(p) for p in payload])
    # One right row a moment: of rows at the same time only the lowest line can win.
    dense = right.filter(F.col(time_us).isNotNull()).groupBy(*keys, time_us).agg(F.min_by(body, F.col(line)).alias("_hit"))
    lefts = left.withColumn("_left", F.struct(*[F.col(c) for c in left.columns]))
    merged = lefts.select(*keys, time_us, "_left").unionByName(dense.select(*keys, time_us, "_hit"), allowMissingColumns=True)
    merged = merged.withColumn("_side", F.when(F.col("_hit").isNotNull(), 0).otherwise(1))
    merged = with_chunks(merged, keys, time_us, **chunking)
    merged = running(merged, keys, [time_us, "_side"], {"_before": ("max", F.col("_hit"))})
    merged = merged.withColumn("_side", 1 - F.col("_side"))
    merged = running(merged, keys, [time_us, "_side"], {"_after": ("min", F.col("_hit"))}, backward=True)
    rows = merged.filter(F.col("_left").isNotNull())
    gap_b = F.col(time_us) - F.col("_before.t")
    gap_a = F.col("_after.t") - F.col(time_us)
    earlier = gap_a.isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (F.col("_before.line") <= F.col("_after.line")))
    best = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    rows = rows.withColumn("_best", best)
    delta = F.abs(F.col("_best.t") - F.col(time_us))
    ok = F.coalesce(delta <= tolerance_us, F.lit(False))
    return rows.select(
        "_left.*",
        F.when(ok, F.col("_best.line")).alias(line),
        *[F.when(ok, F.col(f"_best.{p}")).alias(p) for p in payload],
        F.when(ok, F.round(delta / MICROS, 3)).alias("match_delta_s"),
    )


def as_of_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time_us: str, payload: Sequence[str], **chunking
) -> DataFrame:
    """Latest right row at or before each left row of the same key."""
    keys, payload = list(keys), list(payload)
    body = F.struct(F.col(time_us).alias("t"), *[F.col(p).alias(p) for p in payload])
    dense = right.groupBy(*keys, time_us).agg(F.max(body).alias("_hit"))
    lefts = left.withColumn("_left", F.struct(*[F.col(c) for c in left.columns]))
    merged = lefts.select(*keys, time_us, "_left").unionByName(dense.select(*keys, time_us, "_hit"), allowMissingColumns=True)
    merged = with_chunks(merged.withColumn("_side", F.when(F.col("_hit").isNotNull(), 0).otherwise(1)), keys, time_us, **chunking)
    merged = running(merged, keys, [time_us, "_side"], {"_before": ("max", F.col("_hit"))})
    return merged.filter(F.col("_left").isNotNull()).select(
        "_left.*", F.col("_before.t").alias("as_of_us"), *[F.col(f"_before.{p}").alias(p) for p in payload]
    )


def last_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str, payload: Sequence[str]) -> DataFrame:
    """Equality join in which the last right row of a key wins."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(line)).alias("_r"))
    return left.join(last.select(*keys, *[F.col(f"_r.{p}").alias(p) for p in payload]), list(keys), "left")


def temporal_neighbours(
    df: DataFrame, keys: Sequence[str], time_s: str, high: Column, window_s: int = 300, bucket_s: int = 3600
) -> DataFrame:
    """How many other rows of a key lie within ``window_s`` seconds, and how many of those are high.

    Rows are first counted per second, so a time bucket holds at most
    ``bucket_s + 2*window_s`` rows whatever the traffic; seconds near a bucket
    edge are copied to the bucket next to it. Rows without a time count none.
    """
    keys = list(keys)
    marked = df.withColumn("_high", F.coalesce(high, F.lit(False)).cast("bigint"))
    per_second = (
        marked.filter(F.col(time_s).isNotNull())
        .groupBy(*keys, time_s)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_high").alias("_h"))
        .withColumn("_home", F.floor(F.col(time_s) / bucket_s))
    )
    first = F.floor((F.col(time_s) - window_s) / bucket_s)
    last = F.floor((F.col(time_s) + window_s) / bucket_s)
    spread = per_second.withColumn("_bucket", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(*keys, "_bucket").orderBy(time_s).rangeBetween(-window_s, window_s)
    counts = (
        spread.select(*keys, time_s, "_home", "_bucket", F.sum("_n").over(frame).alias("_n"), F.sum("_h").over(frame).alias("_h"))
        .filter(F.col("_home") == F.col("_bucket"))
        .drop("_home", "_bucket")
    )
    return (
        marked.join(counts, [*keys, time_s], "left")
        .withColumn("neighbours", F.coalesce(F.col("_n") - 1, F.lit(0)))
        .withColumn("high_neighbours", F.coalesce(F.col("_h") - F.col("_high"), F.lit(0)))
        .drop("_n", "_h", "_high")
    )


def lookup(df: DataFrame, dim: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join to a dimension; Spark broadcasts it if it measures small enough."""
    return df.join(dim, on, how)


def sync_plan(remote: DataFrame, mirror: DataFrame, verify: bool = False) -> DataFrame:
    """Fetch, refetch or skip for every remote manifest entry, by the first rule that holds."""
    planned = remote.withColumn("local", mirror_path(F.col("path"), F.col("category")))
    held = mirror.select(
        F.col("path").alias("local"), F.col("size").alias("local_size"), F.col("sha256").alias("local_sha"), F.lit(True).alias("_held")
    )
    rows = planned.join(held, "local", "left")
    sha = F.coalesce(F.col("sha256"), F.lit(""))
    rules = [
        (F.col("_held").isNull(), "fetch", "missing"),
        (F.coalesce(F.col("mutable"), F.lit(False)), "refetch", "mutable"),
        (sha == "", "refetch", "no remote sha"),
        (F.col("local_size") != F.col("size"), "refetch", "size mismatch"),
    ]
    if verify:
        same = F.coalesce(F.col("local_sha") == sha, F.lit(False))
        rules.append((~same, "refetch", "verify sha mismatch"))
    action, reason = F.when(*_pair(rules[0], 1)), F.when(*_pair(rules[0], 2))
    for rule in rules[1:]:
        action, reason = action.when(*_pair(rule, 1)), reason.when(*_pair(rule, 2))
    rows = rows.withColumn("action", action.otherwise("skip")).withColumn(
        "reason", reason.otherwise("verified" if verify else "present")
    )
    return rows.drop("_held", "local_size", "local_sha")


def _pair(rule: tuple, i: int) -> tuple:
    return rule[0], rule[i]


def match_acks(acks: DataFrame, state: DataFrame) -> DataFrame:
    """Accept an acknowledgement if its path is tracked and its hash, when given, is equal."""
    known = state.select("path", F.col("sha256").alias("_sha"), F.lit(True).alias("_known"))
    given = F.coalesce(F.col("sha256"), F.lit(""))
    ok = F.col("_known").isNotNull() & ((given == "") | (given == F.col("_sha")))
    return acks.join(known, "path", "left").withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_sha", "_known")


def still_pending(pending: DataFrame, acked: DataFrame) -> DataFrame:
    """Pending acknowledgements to retry: those whose path was not acked."""
    return pending.join(acked.select("path"), "path", "left_anti")


def check_copies(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """MISSING, SIZE, HASH or OK for every manifest row, against the files found."""
    seen = found.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_seen"))
    status = (
        F.when(F.col("_seen").isNull(), "MISSING")
        .when(F.col("_size") != F.col("size"), "SIZE")
        .when(F.col("_sha") != F.col("sha256"), "HASH")
        .otherwise("OK")
    )
    return manifest.join(seen, "name", "left").withColumn("status", status).drop("_size", "_sha", "_seen")


def prune_gate(listing: DataFrame, canonical: DataFrame, today: Column, retain_days: int, apply: bool = False) -> DataFrame:
    """Which old day logs may be deleted: only with a canonical copy, not smaller, and with an equal tail.

    ``listing`` has name, size, day and tail; ``canonical`` has name, size and tail.
    """
    old = listing.filter(F.col("day") < F.date_sub(today, retain_days))
    kept = canonical.select("name", F.col("size").alias("_size"), F.col("tail").alias("_tail"), F.lit(True).alias("_kept"))
    rows = old.join(kept, "name", "left")
    reason = (
        F.when(F.col("_kept").isNull(), "no_canonical_copy")
        .when(F.col("_size") < F.col("size"), "canonical_smaller")
        .when(~F.coalesce(F.col("_tail").eqNullSafe(F.col("tail")), F.lit(False)), "tail_mismatch")
        .otherwise("verified")
    )
    verdict = "DELETE" if apply else "WOULD_DELETE"
    return (
        rows.withColumn("reason", reason)
        .withColumn("action", F.when(F.col("reason") == "verified", verdict).otherwise("SKIP"))
        .drop("_size", "_tail", "_kept")
    )


def clip_frames(
    frames: DataFrame, triggers: DataFrame, keys: Sequence[str], time_us: str, pre_us: int, post_us: int, **chunking
) -> DataFrame:
    """Frames within ``[trigger - pre, trigger + post]`` of triggers that are more than ``post`` apart.

    Such clips overlap by less than one clip, so a frame lies in the clip of the
    last trigger whose clip has begun or in the one before, and no other.
    """
    if pre_us > post_us:
        raise ValueError("a pre-roll longer than the post-roll could put a frame into more than two clips")
    keys = list(keys)
    starts = triggers.select(*keys, F.col(time_us).alias("trigger_us"), (F.col(time_us) - pre_us).alias(time_us))
    starts = with_chunks(starts, keys, time_us, **{"spacing_us": post_us, **chunking})
    starts = neighbour(starts, keys, [time_us], {"before_us": F.col("trigger_us")})
    # Triggers are sparse, so the frames alone decide how fine the chunks must be.
    hits = as_of_backward(frames, starts, keys, time_us, ["trigger_us", "before_us"], **{"sizes_from": frames, **chunking})
    both = hits.withColumn("trigger_us", F.explode(F.array("trigger_us", "before_us"))).drop("before_us", "as_of_us")
    inside = F.col(time_us).between(F.col("trigger_us") - pre_us, F.col("trigger_us") + post_us)
    return both.filter(inside)


def resolve_source(wanted: DataFrame, files: DataFrame, own_session: str = "session_id") -> DataFrame:
    """First existing copy of each wanted file by ``priority``, the file's own session taking part as given."""
    best = files.groupBy("file").agg(F.min_by("path", "priority").alias("source_path"))
    return wanted.join(best, "file", "left")


def new_files(listing: DataFrame, present: DataFrame) -> DataFrame:
    """Captures not yet mirrored, and append-only logs always; other entries are left alone."""
    is_capture = F.col("name").endswith(".wav")
    is_log = (F.col("name") == "triggers.jsonl") | (F.col("name").rlike(r"\.(jsonl|log|LOG)$") & ~F.col("name").startswith("."))
    fresh = listing.filter(is_capture).join(present.select("name"), "name", "left_anti")
    return fresh.unionByName(listing.filter(is_log & ~is_capture))
