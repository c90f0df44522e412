"""File manifests as a stream: a Python data source whose offset is (snapshot, generation, since, failed)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ENTRY = "path STRING, size BIGINT, mtime BIGINT, sha256 STRING"
FIELDS = ("path", "size", "mtime", "sha256")


def _folder(uri: str):
    """File system and path of a shared folder; the driver and tasks list and read it without Spark."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _whole(root: str, name: str) -> list[int]:
    """Numbers of the ``name=<number>`` folders that were written whole."""
    from pyarrow import fs

    system, path = _folder(root)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    numbers = [f.base_name.partition("=")[2] for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}=")]
    return sorted(int(n) for n in numbers if system.get_file_info(f"{path}/{name}={n}/_SUCCESS").type == fs.FileType.File)


def _files(folder: str) -> list[str]:
    from pyarrow import fs

    system, path = _folder(folder)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".parquet"))


def publish_manifest(entries: DataFrame, root: str, generation: str) -> int:
    """Write a snapshot of a manifest, with its mark (generation, newest mtime), and return its number.

    The mark is the commit: it is written last, and readers look for marks only.
    """
    numbers = _whole(f"{root}/marks", "snapshot")
    number = numbers[-1] + 1 if numbers else 0
    entries.select(*FIELDS).write.mode("overwrite").parquet(f"{root}/entries/snapshot={number}")
    spark = entries.sparkSession
    written = spark.read.schema(ENTRY).parquet(f"{root}/entries/snapshot={number}")
    mark = written.agg(F.coalesce(F.max("mtime"), F.lit(0)).alias("newest")).withColumn("generation", F.lit(generation))
    mark.coalesce(1).write.mode("overwrite").json(f"{root}/marks/snapshot={number}")
    return number


@dataclass
class _Part(InputPartition):
    file: str
    since: int
    verify: bool
    retry: bool


class _Reader(DataSourceStreamReader):
    """Offsets name the newest snapshot, its generation and newest mtime, and the last batch whose failures were taken in.

    From a start to an end offset the stream has the entries newer than the start's mtime; all entries, to be verified,
    if the generation has changed; and the entries whose transfer failed in batches after the start's.
    """

    def __init__(self, root: str, failed: str) -> None:
        self.root, self.failed = root, failed

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": -1, "generation": "", "since": 0, "failed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        numbers = _whole(f"{self.root}/marks", "snapshot")
        if not numbers:
            return self.initialOffset()
        system, path = _folder(f"{self.root}/marks/snapshot={numbers[-1]}")
        from pyarrow import fs

        file = next(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".json"))
        mark = json.loads(system.open_input_file(file).read())
        batches = _whole(self.failed, "batch")
        return {"snapshot": numbers[-1], "generation": mark["generation"], "since": mark["newest"], "failed": batches[-1] if batches else -1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fresh = end["generation"] != start["generation"]
        verify = fresh and start["generation"] != ""
        out: list[InputPartition] = []
        if end["snapshot"] != start["snapshot"]:
            since = -1 if fresh else start["since"]
            out += [_Part(f, since, verify, False) for f in _files(f"{self.root}/entries/snapshot={end['snapshot']}")]
        # A full read has the failed entries anyway.
        if not fresh:
            for batch in _whole(self.failed, "batch"):
                if start["failed"] < batch <= end["failed"]:
                    out += [_Part(f, -1, False, True) for f in _files(f"{self.failed}/batch={batch}")]
        return out

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, _ = _folder(self.root)
        for batch in pq.ParquetFile(system.open_input_file(partition.file)).iter_batches(columns=list(FIELDS)):
            rows = batch if partition.since < 0 else batch.filter(pc.greater(batch["mtime"], partition.since))
            flags = [pa.array([flag] * rows.num_rows, pa.bool_()) for flag in (partition.verify, partition.retry)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *flags], names=[*FIELDS, "verify", "retry"])

    def commit(self, end: dict) -> None:
        pass


class ManifestSource(DataSource):
    """``spark.readStream.format("manifest").option("root", ...).option("failed", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return f"{ENTRY}, verify BOOLEAN, retry BOOLEAN"

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options["root"], self.options["failed"])


def mirror_pass(spark: SparkSession, root: str, path: str, transfer: Callable[[DataFrame], DataFrame]) -> None:
    """Take in everything the manifest has new since the last pass; ``transfer`` adds a column ``ok`` to the entries.

    Offsets are kept in the stream's checkpoint below ``path``: a pass that dies is done again with the same entries and
    overwrites its own batch. Results are below ``done``, entries to be tried again below ``failed``. An entry that is
    both new and tried again comes once, as the newer of the two.
    """
    spark.dataSource.register(ManifestSource)
    rows = spark.readStream.format("manifest").option("root", root).option("failed", f"{path}/failed").load()

    def take(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "sha256", "verify", "retry"), F.struct("mtime", F.col("retry").cast("int") * -1)).alias("e")).select("path", "e.*")
        transfer(once).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        done = spark.read.parquet(f"{path}/done/batch={number}")
        bad = done.filter(~F.col("ok")).select(*FIELDS)
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{path}/failed/batch={number}")

    rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
