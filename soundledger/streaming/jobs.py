"""Streaming jobs: windows, deduplication, ledger state, fan-out, incremental manifests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundledger.operators import ledger
from soundledger.session import prepare
from soundledger.sources.tables import utc_instants

WATERMARK = "10 minutes"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None, bytes_per_batch: int = 2 << 30) -> DataFrame:
    """A parquet table as a stream of its files, a bounded amount to a batch."""
    prepare(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return utc_instants(reader.parquet(folder))


def run_to_table(rows: DataFrame, path: str, mode: str = "append", partition: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all input there is into a parquet table, and read the table."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
    if partition:
        writer = writer.partitionBy(*partition)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/table")


def snapshots(rows: DataFrame, ts: str, keys: Sequence[str], last: Sequence[str], peaks: Sequence[str], order: str, width: str = "30 seconds", slide: str | None = None) -> DataFrame:
    """Last row and peaks per device and window; with ``slide`` the windows overlap."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        rows.withWatermark(ts, WATERMARK)
        .groupBy(*keys, win.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), *[F.max_by(c, order).alias(f"last_{c}") for c in last], *[F.max(c).alias(f"peak_{c}") for c in peaks]
        )
        .select(*keys, F.col("w.start").alias("window_start"), "n", *[f"last_{c}" for c in last], *[f"peak_{c}" for c in peaks])
    )


def bursts(rows: DataFrame, ts: str, keys: Sequence[str], gap: str) -> DataFrame:
    """Session windows: rows of a device less than ``gap`` apart."""
    return (
        rows.withWatermark(ts, WATERMARK)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")
    )


def deduplicated(rows: DataFrame, ts: str, keys: Sequence[str], within: str = WATERMARK) -> DataFrame:
    """First of equal keys seen within the watermark, across cumulative extracts."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def maintain_ledger(events: DataFrame, path: str) -> None:
    """Keep the ledger's current state: each batch writes the paths it changed under its own batch number.

    A repeated batch overwrites its own folder, so a restart changes nothing.
    """
    changed = ledger.replay(events, keep_removed=True)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    query = changed.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(upsert).trigger(availableNow=True).start()
    query.awaitTermination()


def ledger_state(spark: SparkSession, path: str) -> DataFrame:
    """Live paths with their newest state."""
    changes = _changes(spark, path)
    rest = [c for c in changes.columns if c not in ("path", "batch")]
    newest = changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("s")).select("path", "s.*")
    return newest.filter("live").drop("live")


def compact_ledger(spark: SparkSession, path: str) -> None:
    """Merge all change folders into one table of the newest state of each path, removed ones included; run it on a schedule.

    The merged table is written under the number of the last batch in it; readers take the highest one and only later
    changes, so a merge that dies changes nothing. Folders that a merge has taken in are then deleted.
    """
    changes = _changes(spark, path)
    last = changes.agg(F.max("batch")).first()[0]
    if last is None:
        return
    rest = [c for c in changes.columns if c not in ("path", "batch")]
    merged = changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("s")).select("path", "s.*")
    merged.write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
    for kind, name in (("changes", "batch"), ("merged", "upto")):
        for number in _numbers(spark, f"{path}/{kind}", name):
            if number < last or kind == "changes" and number == last:
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}={number}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the ``name=<number>`` folders that were written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest merged table with the changes after it, each row with its batch."""
    merged = _numbers(spark, f"{path}/merged", "upto")[-1:]
    later = [n for n in _numbers(spark, f"{path}/changes", "batch") if not merged or n > merged[0]]
    parts = [spark.read.parquet(f"{path}/merged/upto={n}").withColumn("batch", F.lit(n)) for n in merged]
    if later:
        parts.append(spark.read.option("basePath", f"{path}/changes").parquet(*[f"{path}/changes/batch={n}" for n in later]))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def fan_out(rows: DataFrame, path: str, consumers: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Feed several consumers from one pass over a stream; each has its own folder per batch."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, build in consumers.items():
                build(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    query = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(deliver).trigger(availableNow=True).start()
    query.awaitTermination()


def manifest_increment(manifest: DataFrame, since: int, known_generation: str, generation: Column, failed: DataFrame | None = None) -> DataFrame:
    """Manifest entries to look at: those newer than the watermark, or all of them, to be verified, after a new generation.

    The watermark passes files whose transfer failed, so ``failed`` paths come again.
    """
    fresh = F.lit(known_generation != "") & (generation != known_generation)
    rows = manifest.withColumn("verify", fresh)
    take = fresh | (F.col("mtime") > since)
    if failed is None:
        return rows.filter(take)
    again = rows.join(failed.select("path").distinct().withColumn("_again", F.lit(True)), "path", "left")
    return again.filter(take | F.coalesce(F.col("_again"), F.lit(False))).drop("_again")


def next_watermark(increment: DataFrame, since: int) -> int:
    top = increment.agg(F.max("mtime")).first()[0]
    return max(since, top or 0)


def manifest_run(spark: SparkSession, manifest: DataFrame, path: str, transfer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One pass of the incremental mirror: what ``transfer`` did with the entries to look at, ``(path, ok)``.

    Generation and watermark of the last pass are kept below ``path`` together with the paths that failed. A manifest of
    a new generation is read whole and verified. A pass that dies leaves the old mark, and its entries come again.
    """
    passes = _numbers(spark, f"{path}/marks", "pass")
    number = passes[-1] + 1 if passes else 0
    generation, since, failed = "", 0, None
    if passes:
        mark = spark.read.parquet(f"{path}/marks/pass={passes[-1]}").first()
        generation, since = mark["generation_id"], mark["since"]
        failed = spark.read.parquet(f"{path}/failed/pass={passes[-1]}")
    todo = manifest_increment(manifest, since, generation, F.col("generation_id"), failed)
    done = transfer(todo)
    done.write.mode("overwrite").parquet(f"{path}/done/pass={number}")
    done = spark.read.parquet(f"{path}/done/pass={number}")
    done.filter(~F.col("ok")).select("path").write.mode("overwrite").parquet(f"{path}/failed/pass={number}")
    now = manifest.agg(F.max("generation_id").alias("g"), F.max("mtime").alias("t")).first()
    fresh = now["g"] is not None and now["g"] != generation
    mark = (now["g"] or generation, (now["t"] or 0) if fresh else max(since, now["t"] or 0))
    spark.createDataFrame([mark], "generation_id STRING, since BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/pass={number}")
    return done
