"""Sinks for feature tables, label versions, manifests, deletion ledgers and telemetry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_table(parts: Sequence[DataFrame], path: str, formats: Sequence[str] = ("csv", "json")) -> None:
    """Union of the parts with blanks for columns a part lacks, once per format."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for fmt in formats:
        writer = rows.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{fmt}")


def write_labels(labels: DataFrame, path: str, audited_at: str, dry_run: bool = False) -> DataFrame:
    """One audit as a version folder of its own, rewritten whole if the same audit runs again."""
    if not dry_run:
        labels.write.mode("overwrite").parquet(f"{path}/audited_at={audited_at}")
    return labels


def read_labels(spark: SparkSession, path: str, audited_at: str | None = None) -> DataFrame:
    """The labels of one audit, by default the newest. Only that version's folder is read."""
    all_versions = spark.read.parquet(path)
    if audited_at is None:
        audited_at = all_versions.agg(F.max("audited_at")).first()[0]
    return all_versions.filter(F.col("audited_at") == audited_at)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)


def append_deletions(plan: DataFrame, path: str, ts: str) -> None:
    """Append the deletions of a prune plan."""
    plan.filter(F.col("action") == "DELETE").drop("action").withColumn("ts", F.lit(ts)).write.mode("append").parquet(path)


def bucket_columns(ts: Column) -> dict[str, Column]:
    """Date and hour folder of a telemetry row; rows from before clock sync share one bucket."""
    return {
        "date": F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unsynced")),
        "hour": F.coalesce(F.date_format(ts, "HH"), F.lit("boot")),
    }


def stream_telemetry(rows: DataFrame, path: str, checkpoint: str, ts: str = "event_ts", files_per_bucket: int = 1):
    """Hour-bucketed telemetry files from a stream; a bucket's files are never rewritten.

    Rows of a bucket meet in ``files_per_bucket`` tasks, spread by a hash of the
    row, so that a batch writes few files yet a busy hour need not pass through one task.
    """
    bucketed = rows.withColumns(bucket_columns(F.col(ts)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_bucket))
    return (
        bucketed.repartition("date", "hour", salt)
        .writeStream.partitionBy("date", "hour")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
