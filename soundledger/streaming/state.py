"""The file ledger as keyed map state, read back through the state data source, and progress of streams as a table."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from soundledger.sources.manifest_source import _folder
from soundledger.streaming.folds import key_ddl
from soundledger.streaming.silence import ROCKSDB

RESETS = ("register", "close", "purge")
ENTRY = "op STRING, size BIGINT, mtime BIGINT, sha256 STRING, category STRING, sync_state STRING, reset_line BIGINT, ack_line BIGINT"
FIELDS = ["op", "size", "mtime", "sha256", "category", "sync_state"]


class _Ledger(StatefulProcessor):
    """Newest reset of each path with the newest ack. Lines decide, not arrival, so a removed path keeps its line."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "path STRING", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("line")
        resets = events[events["op"].isin(RESETS)].drop_duplicates("path", keep="last").set_index("path")
        acks = events[events["op"] == "ack"].groupby("path")["line"].max().to_dict()
        fresh = {p: tuple(None if pd.isna(v) else v for v in r) for p, r in zip(resets.index, resets[[*FIELDS, "line"]].itertuples(index=False, name=None), strict=True)}
        paths = sorted({*fresh, *acks})
        for path in paths:
            old = tuple(self.entries.getValue((path,))) if self.entries.containsKey((path,)) else (None,) * 7 + (-1,)
            new = fresh.get(path)
            if new is not None and (old[6] is None or new[6] > old[6]):
                numbers = [None if v is None else int(v) for v in (new[1], new[2])]
                old = (new[0], *numbers, *new[3:6], int(new[6]), old[7])
            self.entries.updateValue((path,), (*old[:7], max(int(old[7]), int(acks.get(path, -1)))))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "paths": [len(paths)]})

    def close(self) -> None:
        pass


def keep_ledger(events: DataFrame, path: str, keys: Sequence[str] = ("device",)) -> None:
    """Take all ledger events there are into the state below ``path``: one map of paths a device. Restarts go on from there."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keys = list(keys)
    slim = events.select(*keys, "path", "line", *FIELDS)
    changed = slim.groupBy(*keys).transformWithStateInPandas(_Ledger(keys), f"{key_ddl(slim, keys)}, paths BIGINT", "Append", "None")
    writer = changed.writeStream.format("parquet").option("path", f"{path}/changed").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def kept_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Live entries, read from the newest state of the stream: its key, path and fields."""
    state = spark.read.format("statestore").option("stateVarName", "entries").load(f"{path}/checkpoint")
    value = F.col("user_map_value")
    synced = (value["sync_state"] == "synced") | (value["ack_line"] > value["reset_line"])
    return state.filter(value["op"].isin("register", "close")).select(
        "key.*", F.col("user_map_key.path").alias("path"), F.coalesce(value["size"], F.lit(0)).alias("size"), F.coalesce(value["mtime"], F.lit(0)).alias("mtime"),
        value["sha256"].alias("sha256"), value["category"].alias("category"), F.when(F.coalesce(synced, F.lit(False)), "synced").otherwise("pending").alias("sync_state"),
    )


# --- progress ----------------------------------------------------------------------------------------

PROGRESS = "query STRING, batch BIGINT, rows BIGINT, newest TIMESTAMP, watermark TIMESTAMP, dropped BIGINT"


def observed(rows: DataFrame, ts: str) -> DataFrame:
    """Rows whose number and newest time are reported with each batch."""
    return rows.observe("input", F.count(F.lit(1)).alias("rows"), F.max(ts).alias("newest"))


class ProgressTable(StreamingQueryListener):
    """Stores what each batch had and dropped as a file in a shared folder; a batch that is run again replaces its file.

    ``dropped`` are rows that came later than the watermark allows: what a keyed operator left out, counted by Spark.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get("input")
        newest = seen["newest"] if seen and seen["rows"] else None
        row = {
            "query": str(p.id), "batch": p.batchId, "rows": seen["rows"] if seen else 0, "newest": newest.isoformat() if newest is not None else None,
            "watermark": p.eventTime.get("watermark"), "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        }
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{p.id}-{p.batchId:09d}.json") as out:
            out.write(json.dumps(row).encode())

    def written(self) -> bool:
        system, folder = _folder(self.path)
        return system.get_file_info(folder).type.name == "Directory"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PROGRESS).json(self.path)
