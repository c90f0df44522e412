"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from soundledger.session import scratch_path, shared_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the written tables that ``df`` reads below the shared folder; only for tables that no later step reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/") + "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that a Python worker gets at a time.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows: a text may have a hundred kilobytes, and workers hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no run of equal keys crosses two frames."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        if held and not (k[-1] == held[-1][keys].to_numpy()[-1]).all():
            first = int(np.argmax((k != held[-1][keys].to_numpy()[-1]).any(axis=1)))
            yield pd.concat([*held, pdf.iloc[:first]], ignore_index=True)
            held, pdf = [], pdf.iloc[first:]
            k = pdf[keys].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if not held and len(change):
            yield pdf.iloc[: change[-1] + 1].reset_index(drop=True)
            pdf = pdf.iloc[change[-1] + 1 :]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Start of each run of equal keys, and the frame's length at the end."""
    k = pdf[keys].to_numpy()
    return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(k)]
