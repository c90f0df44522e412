"""Readers for captures, logs, ledgers, manifests and listings.

Every reader is a scan plus a parser over its rows; the parsers take any frame
with a ``value`` text column, so they serve batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.functions.scores import WATCHED_NAMES

TRIGGER_SCHEMA = "ts STRING, note STRING, rms DOUBLE, cry_conf DOUBLE, state INT"
LEDGER_SCHEMA = "ts BIGINT, op STRING, path STRING, size BIGINT, mtime BIGINT, sha256 STRING, sync_state STRING, category STRING"
TELEMETRY_SCHEMA = """
  ts STRING, up BIGINT, n_infer BIGINT, n_pub BIGINT, state STRING,
  audio STRUCT<rms: DOUBLE, nf_p50: DOUBLE, nf_p95: DOUBLE, nf_warm: BOOLEAN>,
  infer STRUCT<ms: INT, fps: DOUBLE, cry_conf: DOUBLE, max_cry_1s: DOUBLE, top10: ARRAY<STRUCT<i: INT, v: DOUBLE>>>,
  watched ARRAY<DOUBLE>,
  student STRUCT<version: STRING, loaded: BOOLEAN, cry_conf: DOUBLE, speech_conf: DOUBLE, ms: INT>,
  sys STRUCT<free_heap: BIGINT, free_psram: BIGINT, min_heap: BIGINT, rssi: INT, die_c: DOUBLE, ntp: BOOLEAN, wifi: BOOLEAN, sd: BOOLEAN,
    alerts: BIGINT, sd_err: BIGINT, ovr_bytes: BIGINT, ovr_evts: BIGINT>,
  stacks ARRAY<STRUCT<t: STRING, hwm: BIGINT>>"""
POLL_SCHEMA = """
  uptime_s BIGINT, state STRING, inference_fps DOUBLE, last_cry_conf DOUBLE, max_cry_conf_1s DOUBLE, input_rms DOUBLE, noise_floor_p95 DOUBLE,
  alert_count BIGINT, audio_overrun_events BIGINT, audio_overrun_bytes BIGINT, free_heap BIGINT, inference_count BIGINT, build_sha STRING,
  watched MAP<STRING, DOUBLE>,
  student STRUCT<version: STRING, loaded: BOOLEAN, cry_conf: DOUBLE, speech_conf: DOUBLE, latency_ms: BIGINT, inference_count: BIGINT>,
  sync STRUCT<pending_count: BIGINT, synced_count: BIGINT, bytes_pending: BIGINT, bytes_synced: BIGINT, oldest_pending_age_s: BIGINT, total_tracked: BIGINT>"""
MANIFEST_SCHEMA = """
  generation_id STRING, device_uptime_s BIGINT, now BIGINT,
  files ARRAY<STRUCT<path: STRING, size: BIGINT, mtime: BIGINT, sha256: STRING, sync_state: STRING, category: STRING, mutable: BOOLEAN>>,
  truncated BOOLEAN, next_since BIGINT"""
LISTING_SCHEMA = "entries ARRAY<STRUCT<name: STRING, type: STRING, size: BIGINT, mtime: BIGINT>>"
MARKER_SCHEMA = "firmware_version STRING, boot_count BIGINT, generation_id STRING, mounted_at STRING"
# Fixed order: the headerless event log.
EVENT_LOG = [
    ("wallclock", "string"), ("uptime_s", "bigint"), ("event", "string"), ("cry_conf", "double"), ("max_cry_conf_1s", "double"), ("rms", "double"),
    ("nf_p95", "double"), ("nf_warm", "int"), ("latency_ms", "int"), ("inference_count", "bigint"), ("inference_fps", "double"),
    ("free_heap", "bigint"), ("free_psram", "bigint"), ("rssi", "int"), ("state", "int"),
]


def parse_json_lines(lines: DataFrame, schema: str, keep_bad: bool = False) -> DataFrame:
    """Text lines to typed columns. Blank and malformed lines are dropped, or kept in ``_corrupt_record``."""
    other = [c for c in lines.columns if c != "value"]
    body = lines.filter(F.trim("value") != "")
    typed = F.from_json("value", f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = body.select(*other, typed.alias("_j")).select(*other, "_j.*")
    return out if keep_bad else out.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Headerless event log, 15 columns and from version 3 on 20 more scores.

    The time of a row written before clock sync holds a comma of its own, so
    such a row splits into one field more; it gets a null time and its uptime.
    """
    other = [c for c in lines.columns if c != "value"]
    parts = F.split("value", ",")
    unsynced = F.get(parts, F.lit(1)) == "NOT_SYNCED"
    fields = F.when(unsynced, F.concat(F.array(F.concat_ws(",", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.slice(parts, F.lit(3), F.size(parts)))).otherwise(parts)
    rows = lines.select(*other, fields.alias("_f"), F.coalesce(unsynced, F.lit(False)).alias("not_synced")).filter(F.size("_f") >= len(EVENT_LOG))
    cols = [F.get("_f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(EVENT_LOG)]
    watched = F.transform(F.slice("_f", len(EVENT_LOG) + 1, len(WATCHED_NAMES)), lambda v: v.try_cast("double"))
    wall = F.when(~F.col("not_synced"), F.try_to_timestamp("wallclock"))
    return rows.select(*other, *cols, watched.alias("watched"), "not_synced").withColumn("ts", wall)


def watched_rows(df: DataFrame, values: str = "watched") -> DataFrame:
    """One row per watched class, named by its position."""
    names = F.array(*[F.lit(n) for n in WATCHED_NAMES])
    return df.select(*[c for c in df.columns if c != values], F.posexplode(values).alias("pos", "conf")).withColumn("name", F.get(names, F.col("pos")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("file_path", F.col("_metadata.file_path"))


def session_of(path: Column | None = None) -> Column:
    """Session folder in a file path."""
    return F.regexp_extract(F.col("file_path") if path is None else path, r"/(night-[^/]+)/", 1)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """WAV files below a path, with file name, session and content; decoding is the feature job's."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), session_of(F.col("path")).alias("session_id"), "path", "length", "modificationTime", "content"
    )


def read_sessions(spark: SparkSession, root: str, manifest: str = "manifest.csv", scores: str = "yamnet_files.csv") -> DataFrame:
    """Feature and score tables of all sessions that have both; the first session owns a capture. All values stay text."""

    def load(name: str) -> DataFrame:
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(f"{root}/night-*/{name}")
        return df.withColumn("session_id", session_of(F.col("_metadata.file_path")))

    m, s = load(manifest), load(scores)
    both = m.join(s.select("session_id").distinct(), "session_id", "left_semi")
    rest = [c for c in both.columns if c != "file"]
    owned = both.groupBy("file").agg(F.min_by(F.struct(*rest), "session_id").alias("_m")).select("file", "_m.*")
    # A file scored twice in a session keeps its last line, as a dictionary built from the rows would.
    s = s.withColumn("_line", F.monotonically_increasing_id())
    values = [c for c in s.columns if c not in ("file", "session_id", "_line")]
    s = s.groupBy("session_id", "file").agg(F.max_by(F.struct(*values), "_line").alias("_s")).select("session_id", "file", "_s.*")
    return owned.join(s, ["session_id", "file"], "left")


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Trigger lines with session and line order within the file."""
    return parse_json_lines(_numbered_lines(spark, path), TRIGGER_SCHEMA).withColumn("session_id", session_of())


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with their numbers from 0, large files read by many tasks.

    Spark reads a file in byte ranges and cuts them at line ends. Lines are numbered inside a range, in the order in which a
    task reads them, and the counts of the ranges before it give what to add: one small row a range.
    """
    split = ["file_path", "_from"]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_from"), "value")
    before = Window.partitionBy("file_path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy(*split).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    here = F.row_number().over(Window.partitionBy(*split).orderBy("_at")) - 1
    numbered = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("_here", here)
    return numbered.join(starts, split).select("file_path", (F.col("_before") + F.col("_here")).alias("line"), "value")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events with exact line numbers."""
    return parse_json_lines(_numbered_lines(spark, path), LEDGER_SCHEMA)


def read_telemetry(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    df = reader.schema(T._parse_datatype_string(f"{TELEMETRY_SCHEMA}, _corrupt_record STRING")).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.withColumn("event_ts", F.try_to_timestamp("ts")).withColumn("not_synced", F.col("ts").contains("NOT_SYNCED"))


def read_polls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Poll snapshots ``{poll_ts, device_id, payload}``; an absent payload is a poll without an answer."""
    reader = spark.readStream if stream else spark.read
    return parse_polls(reader.schema("device_id STRING, poll_ts TIMESTAMP, wav_count BIGINT, payload STRING").json(path))


def parse_polls(df: DataFrame) -> DataFrame:
    p = F.from_json("payload", f"{POLL_SCHEMA}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    zero = lambda c: F.coalesce(F.col(f"_p.{c}"), F.lit(0))
    silent = F.coalesce(F.col("payload"), F.lit("")) == ""
    return df.withColumn("_p", p).select(
        *[c for c in df.columns if c != "payload"],
        (~silent).alias("answered"),
        (~silent & F.col("_p._corrupt_record").isNotNull()).alias("parse_error"),
        zero("uptime_s").alias("uptime"), F.coalesce("_p.state", F.lit("?")).alias("state"), F.round(zero("max_cry_conf_1s"), 3).alias("peak"),
        F.round(zero("input_rms"), 0).alias("rms"), zero("alert_count").alias("alerts"), zero("audio_overrun_events").alias("overruns"),
        F.expr("coalesce(_p.free_heap, 0) div 1024").alias("free_kb"), zero("inference_count").alias("counter"),
        F.coalesce("_p.build_sha", F.lit("?")).alias("build"),
        # Nested parts as they come; null where a poll has none.
        F.col("_p.watched").alias("watched"), F.col("_p.student").alias("student"), F.col("_p.sync").alias("sync"),
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_log(_lines(spark, path))


def read_class_map(spark: SparkSession, path: str, expected: int | None = 521) -> DataFrame:
    """Class map ``index, mid, display_name``; the row count is checked."""
    df = spark.read.schema("index INT, mid STRING, display_name STRING").option("header", True).csv(path)
    n = df.count()
    if expected is not None and n != expected:
        raise ValueError(f"expected {expected} classes, found {n}")
    return df


def parse_listing(df: DataFrame) -> DataFrame:
    """Directory listings to one row per entry."""
    return df.select(*[c for c in df.columns if c != "entries"], F.inline("entries"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return parse_listing(spark.read.schema(LISTING_SCHEMA).option("multiLine", True).json(path))


def parse_manifest(pages: DataFrame) -> DataFrame:
    """Manifest pages to one row per file, with the generation of its page."""
    return pages.select("generation_id", F.col("truncated"), "next_since", F.inline("files"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path))


def read_session_markers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKER_SCHEMA).json(path)


def read_release(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Captures of releases kept as JSON documents: a file each, or with ``lines`` a line each. Without a schema all documents are read twice."""
    reader = spark.read.option("multiLine", not lines)
    docs = (reader.schema(schema) if schema else reader).json(path)
    return docs.select("release_id", F.explode("captures").alias("c")).select("release_id", "c.*")


def tail_lines(lines: DataFrame, keys: list[str], line: str, n: int) -> DataFrame:
    """Last ``n`` lines per file, counted from its end, whatever their numbers."""
    from soundledger.operators.windows import newest

    return newest(lines, keys, [line], n, base_us=1 << 30).drop("age_rank")


def content_head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def content_tail(content: Column, n: int) -> Column:
    """Last ``n`` bytes, or all of a shorter file."""
    return F.when(F.octet_length(content) <= n, content).otherwise(F.substring(content, -n, n))
