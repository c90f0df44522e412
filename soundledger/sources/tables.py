"""Parquet tables, with zone-less timestamps read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return utc_instants(df)


def utc_instants(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP_NTZ columns once, so that watermarks and epoch functions accept them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
