"""File ledger: replay, compaction, statistics, manifest pages, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundledger.operators.chunks import number_names, running, with_chunks


def replay(events: DataFrame, key: tuple[str, ...] = ("path",), line: str = "line", keep_removed: bool = False) -> DataFrame:
    """Current state of each path from its events in line order.

    The last register, close or purge decides: a purge removes the path, the
    others set all fields. An ack after it marks the path synced. Everything is
    one aggregate per path, combined before the shuffle. ``keep_removed`` adds
    paths that are gone, with ``live`` false, for sinks that must forget them.
    """
    resets = F.col("op").isin("register", "close", "purge")
    fields = F.struct("op", "size", "mtime", "sha256", "category", "sync_state")
    last = events.filter(resets | (F.col("op") == "ack")).groupBy(*key).agg(
        F.max_by(F.when(resets, fields), F.when(resets, F.col(line))).alias("_s"),
        F.max(F.when(resets, F.col(line))).alias("_reset"),
        F.max(F.when(F.col("op") == "ack", F.col(line))).alias("_ack"),
    )
    is_live = F.coalesce(F.col("_s.op").isin("register", "close"), F.lit(False))
    live = last if keep_removed else last.filter(is_live)
    synced = (F.col("_s.sync_state") == "synced") | (F.col("_ack") > F.col("_reset"))
    return live.select(
        *key,
        F.coalesce(F.col("_s.size"), F.lit(0)).alias("size"),
        F.coalesce(F.col("_s.mtime"), F.lit(0)).alias("mtime"),
        F.col("_s.sha256").alias("sha256"),
        F.col("_s.category").alias("category"),
        F.when(F.coalesce(synced, F.lit(False)), "synced").otherwise("pending").alias("sync_state"),
        *([is_live.alias("live")] if keep_removed else []),
    )


def compact(state: DataFrame, now_s: int) -> DataFrame:
    """One register row per live path with its current state, and a marker row with the count."""
    rows = state.select("path", "size", "mtime", "sha256", "category", "sync_state").withColumn("op", F.lit("register"))
    marker = rows.agg(F.count(F.lit(1)).alias("entries")).withColumn("op", F.lit("compact"))
    return rows.unionByName(marker, allowMissingColumns=True).withColumn("ts", F.lit(now_s))


def stats(state: DataFrame, now_s: Column) -> DataFrame:
    """Pending and synced counts and bytes, and the age of the oldest pending file."""
    pending = F.col("sync_state") == "pending"
    agg = state.agg(
        F.count_if(pending).alias("pending_count"),
        F.count_if(~pending).alias("synced_count"),
        F.coalesce(F.sum(F.when(pending, F.col("size"))), F.lit(0)).alias("bytes_pending"),
        F.coalesce(F.sum(F.when(~pending, F.col("size"))), F.lit(0)).alias("bytes_synced"),
        F.coalesce(F.min(F.when(pending, F.col("mtime"))), F.lit(0)).alias("oldest_pending_mtime"),
        F.count(F.lit(1)).alias("total_tracked"),
    )
    oldest = F.col("oldest_pending_mtime")
    return agg.withColumn("oldest_pending_age_s", F.when((oldest > 0) & (now_s > oldest), now_s - oldest).otherwise(0))


def manifest_page(state: DataFrame, since: int, limit: int = 500) -> DataFrame:
    """One page of entries newer than ``since``, by (mtime, path), with the page token of the protocol.

    The token is the last mtime and the next page asks for strictly newer ones,
    so entries that share it across the edge are lost; ``keyset_page`` is safe.
    """
    limit = 500 if limit <= 0 else min(limit, 2000)
    page = state.filter(F.col("mtime") > since).orderBy("mtime", "path").limit(limit + 1)
    ranked = page.withColumn("_rn", F.row_number().over(Window.orderBy("mtime", "path")))
    whole = Window.partitionBy()
    ranked = ranked.withColumn("truncated", F.max("_rn").over(whole) > limit).filter(F.col("_rn") <= limit)
    return ranked.withColumn("next_since", F.when(F.col("truncated"), F.max("mtime").over(whole))).drop("_rn")


def keyset_page(state: DataFrame, after: tuple[int, str], limit: int = 500) -> DataFrame:
    """A page that starts after an (mtime, path) pair and so never loses ties."""
    mtime, path = after
    later = (F.col("mtime") > mtime) | ((F.col("mtime") == mtime) & (F.col("path") > path))
    return state.filter(later).orderBy("mtime", "path").limit(limit)


def ack_batches(acks: DataFrame, path: str = "path", size: int = 100) -> DataFrame:
    """Batch number of each acknowledgement, ``size`` to a batch in path order."""
    return number_names(acks, path, "_pos").withColumn("batch", F.expr(f"_pos div {size}")).drop("_pos")


def expired_day_logs(listing: DataFrame, today: Column, keep_days: int = 14) -> DataFrame:
    """Day logs older than ``keep_days`` days."""
    age = F.datediff(today, F.col("day"))
    return listing.withColumn("age_days", age).filter(age > keep_days)


def free_space_retention(
    files: DataFrame, device: str, needed: Column, hard_needed: Column, time: str = "mtime", **chunking
) -> DataFrame:
    """Files to delete per device until enough bytes are free: oldest synced first, pending only for the hard floor.

    ``needed`` and ``hard_needed`` are the bytes to free for the target and for the floor.
    """
    rows = files.withColumn("_synced", F.col("sync_state") == "synced")
    rows = with_chunks(rows, [device], time, **chunking)
    rows = running(
        rows,
        [device],
        [time, "path"],
        {
            "_freed_synced": ("sum", F.when(F.col("_synced"), F.col("size")).otherwise(0)),
            "_freed_pending": ("sum", F.when(~F.col("_synced"), F.col("size")).otherwise(0)),
        },
        exclusive=True,
    )
    totals = files.filter(F.col("sync_state") == "synced").groupBy(device).agg(F.sum("size").alias("_all_synced"))
    rows = rows.join(totals, device, "left")
    by_target = F.col("_synced") & (F.col("_freed_synced") < needed)
    by_floor = ~F.col("_synced") & (F.coalesce(F.col("_all_synced"), F.lit(0)) + F.col("_freed_pending") < hard_needed)
    return (
        rows.filter(by_target | by_floor)
        .withColumn("unsynced_dropped", ~F.col("_synced"))
        .drop("_synced", "_freed_synced", "_freed_pending", "_all_synced", "_chunk")
    )
