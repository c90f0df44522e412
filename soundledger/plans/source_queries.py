"""Queries for parsers and sinks, over text lines that Spark builds from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import text as X
from soundledger.plans import bindings as B
from soundledger.plans.registry import query
from soundledger.session import scratch_path
from soundledger.sources import readers as R
from soundledger.sources import sinks
from soundledger.sources.tables import table


def _json(**cols):
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))


@query(
    "r02_session_tables",
    f"""WITH {B.COPIES}, m AS (SELECT name AS file, min(session_id) AS session_id, min(size) AS dummy FROM copies WHERE l_linenumber<=3 AND session_id IN (SELECT session_id FROM copies WHERE l_linenumber>3) GROUP BY 1),
      s AS (SELECT name AS file, session_id, max(size) AS score FROM copies WHERE l_linenumber>3 GROUP BY 1,2)
      SELECT m.file, m.session_id, s.score FROM m LEFT JOIN s USING (file, session_id)""",
)
def session_tables(spark, sf):
    """Feature rows of the first session that owns a capture, joined to that session's scores."""
    c = B.copies(spark, sf)
    feats = c.filter("l_linenumber <= 3").select(F.col("name").alias("file"), "session_id", "size")
    scores = c.filter("l_linenumber > 3").groupBy(F.col("name").alias("file"), "session_id").agg(F.max("size").alias("score"))
    both = feats.join(scores.select("session_id").distinct(), "session_id", "left_semi")
    owned = both.groupBy("file").agg(F.min("session_id").alias("session_id"))
    return owned.join(scores, ["file", "session_id"], "left")


@query(
    "r03_trigger_lines",
    f"""WITH {B.CAP} SELECT 'night-' || session_id AS session_id, strftime(make_timestamp(t_us),'%Y-%m-%dT%H:%M:%S') AS ts, cls || '-' || event_id AS note, round(rms,6) AS rms FROM cap WHERE event_id%5 NOT IN (0,1)""",
)
def trigger_lines(spark, sf):
    ok = _json(ts=F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss"), note=F.concat_ws("-", "cls", "event_id"), rms=F.col("rms"), cry_conf=F.col("s1"), state=F.lit(3))
    line = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 5 == 1, F.concat(F.lit("{broken "), ok)).otherwise(ok)
    path = scratch_path(spark, "triggers")
    nights = B.captures(spark, sf).select(line.alias("value"), F.col("session_id").alias("night"))
    nights.repartition("night").write.partitionBy("night").text(path)
    return R.read_triggers(spark, path).select(F.regexp_replace(F.regexp_extract("file_path", "night=([0-9]+)", 1), "^", "night-").alias("session_id"), "ts", "note", F.round("rms", 6).alias("rms"))


@query(
    "r04_telemetry_lines",
    f"""WITH {B.CAP} SELECT event_id AS up, round(rms,6) AS rms, round(s1,6) AS cry_conf, k>50 AS warm, 20 AS n_watched, CAST(event_id%521 AS INTEGER) AS top1 FROM cap""",
)
def telemetry_lines(spark, sf):
    c = B.captures(spark, sf)
    top = F.array(F.struct((F.col("event_id") % 521).cast("int").alias("i"), F.col("s1").alias("v")))
    line = _json(
        ts=F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"), up=F.col("event_id"), state=F.lit("idle"),
        audio=F.struct(F.col("rms").alias("rms"), (F.col("k") > 50).alias("nf_warm")),
        infer=F.struct(F.col("s1").alias("cry_conf"), top.alias("top10")), watched=F.array_repeat(F.col("s2"), 20),
    )
    path = scratch_path(spark, "telemetry-lines")
    c.select(line.alias("value")).write.text(path)
    t = R.read_telemetry(spark, path).filter(F.col("_corrupt_record").isNull() & ~F.col("not_synced"))
    return t.select(
        "up", F.round("audio.rms", 6).alias("rms"), F.round("infer.cry_conf", 6).alias("cry_conf"), F.col("audio.nf_warm").alias("warm"),
        F.size("watched").alias("n_watched"), F.get("infer.top10", F.lit(0))["i"].alias("top1"),
    )


@query(
    "r05_event_log_lines",
    f"""WITH {B.CAP} SELECT event_id, CASE WHEN event_id%3=0 THEN NULL ELSE t_us//1000*1000 END AS ts_us, event_id%500 AS uptime_s, cls AS event, round(s1,6) AS cry_conf, event_id%3=0 AS not_synced,
      CASE WHEN event_id%4=0 THEN 0 ELSE 20 END AS n_watched FROM cap""",
)
def event_log_lines(spark, sf):
    c = B.captures(spark, sf)
    up = (F.col("event_id") % 500).cast("string")
    wall = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("up="), up, F.lit("s,NOT_SYNCED"))).otherwise(
        F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")
    )
    base = F.concat_ws(",", wall, up, F.col("cls"), F.col("s1").cast("string"), F.lit("0.5,120.0,80.0,1,680,99,1.40,1000,2000,-60,3"))
    line = F.when(F.col("event_id") % 4 == 0, base).otherwise(F.concat(base, F.repeat(F.lit(",0.125"), 20)))
    t = R.parse_event_log(c.select("event_id", line.alias("value")))
    return t.select(
        "event_id", F.unix_micros("ts").alias("ts_us"), "uptime_s", "event", F.round("cry_conf", 6).alias("cry_conf"), "not_synced", F.size("watched").alias("n_watched")
    )


@query("r06_class_map", "SELECT n_nationkey AS idx, n_name || ', ' || n_regionkey AS display_name FROM nation")
def class_map(spark, sf):
    """Quoted names with commas, written and read as CSV."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("index"), F.lit("/m/x").alias("mid"), F.concat_ws(", ", "n_name", "n_regionkey").alias("display_name"))
    path = scratch_path(spark, "class-map")
    n.write.option("header", True).csv(path)
    return R.read_class_map(spark, path, expected=None).select(F.col("index").alias("idx"), "display_name")


@query(
    "r07_listing",
    """SELECT user_id, event_type || CAST(event_id AS VARCHAR) AS name, CASE WHEN event_id%10=0 THEN 'dir' ELSE 'file' END AS type, CAST(floor(value) AS BIGINT) AS size FROM events""",
)
def listing(spark, sf):
    e = table(spark, sf, "events")
    entry = F.struct(
        F.concat("event_type", "event_id").alias("name"), F.when(F.col("event_id") % 10 == 0, "dir").otherwise("file").alias("type"), F.floor("value").alias("size"),
        F.unix_seconds("ts").alias("mtime"),
    )
    doc = e.select("user_id", F.to_json(F.struct(F.array(entry).alias("entries"))).alias("value"))
    return R.parse_listing(R.parse_json_lines(doc, R.LISTING_SCHEMA)).select("user_id", "name", "type", "size")


@query("r08_manifest_pages", f"WITH {B.REMOTE} SELECT path, size, mtime, sha256, category, mutable, o_orderkey<40000 AS truncated FROM remote")
def manifest_pages(spark, sf):
    """Pages of the manifest, a JSON document and file each, joined to one list when read; the first ten say that more follows.

    A page has at most 4,000 keys among the first ten and 40,000 behind them, however long the table is.
    """
    r = B.remote(spark, sf)
    page = F.expr("CASE WHEN o_orderkey < 40000 THEN o_orderkey div 4000 ELSE 9 + o_orderkey div 40000 END")
    files = F.collect_list(F.struct("path", "size", "mtime", "sha256", F.lit("pending").alias("sync_state"), "category", "mutable"))
    pages = r.groupBy(page.alias("page")).agg(files.alias("files"))
    doc = pages.select(F.to_json(F.struct(F.lit("g1").alias("generation_id"), F.lit(5).alias("device_uptime_s"), F.lit(9).alias("now"), "files", (F.col("page") < 10).alias("truncated"), F.col("page").alias("next_since"))).alias("value"))
    path = scratch_path(spark, "manifest")
    doc.write.option("maxRecordsPerFile", 1).text(path)
    return R.read_manifest(spark, path).select("path", "size", "mtime", "sha256", "category", "mutable", "truncated")


@query("r09_ledger_lines", f"WITH {B.LEDGER} SELECT line, op, path, size, sync_state FROM ledger")
def ledger_lines(spark, sf):
    led = B.ledger(spark, sf)
    line = F.to_json(F.struct(F.col("mtime").alias("ts"), "op", "path", "size", "mtime", "sha256", "sync_state", "category"))
    return R.parse_json_lines(led.select("line", line.alias("value")), R.LEDGER_SCHEMA).select("line", "op", "path", "size", "sync_state")


@query("r10_session_markers", "SELECT event_type AS firmware_version, event_id%9 AS boot_count, CAST(event_id AS VARCHAR) AS generation_id FROM events")
def session_markers(spark, sf):
    e = table(spark, sf, "events")
    doc = _json(firmware_version=F.col("event_type"), boot_count=F.col("event_id") % 9, generation_id=F.col("event_id").cast("string"), mounted_at=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx"))
    path = scratch_path(spark, "markers")
    e.select(doc.alias("value")).write.text(path)
    return R.read_session_markers(spark, path).select("firmware_version", "boot_count", "generation_id")


@query(
    "r12_poll_snapshots",
    f"""WITH {B.CAP}, {B.POLLS} SELECT event_id, k>=30 AS answered, k>=30 AND k%10=1 AS parse_error, CASE WHEN k>=30 AND k%10<>1 THEN uptime ELSE 0 END AS uptime,
      CASE WHEN k>=30 AND k%10<>1 THEN k/100e0 ELSE 0 END AS peak, CASE WHEN k>=30 AND k%10<>1 THEN cls ELSE '?' END AS state FROM polls""",
)
def poll_snapshots(spark, sf):
    p = B.polls(spark, sf)
    doc = _json(uptime_s=F.col("uptime"), state=F.col("cls"), max_cry_conf_1s=F.col("k") / 100.0, alert_count=F.col("alerts"))
    payload = F.when(~F.col("answered"), None).when(F.col("k") % 10 == 1, F.concat(F.lit("{x"), doc)).otherwise(doc)
    path = scratch_path(spark, "polls")
    p.select(F.lit("d1").alias("device_id"), F.timestamp_micros("t_us").alias("poll_ts"), F.col("event_id").alias("wav_count"), payload.alias("payload")).write.json(path)
    return R.read_polls(spark, path).select(F.col("wav_count").alias("event_id"), "answered", "parse_error", "uptime", "peak", "state")


@query(
    "r12_poll_parts",
    f"""WITH {B.CAP}, {B.POLLS}, a AS (SELECT *, k>=30 AND k%10<>1 AS good FROM polls)
      SELECT event_id, CASE WHEN good AND k%3<>0 THEN k/100e0 END AS cry, CASE WHEN good AND k%3<>0 THEN CAST(CASE WHEN k%5=0 THEN 2 ELSE 1 END AS INT) END AS n_watched,
        CASE WHEN good AND k%4<>0 THEN 'v' || CAST(k AS VARCHAR) END AS student_version, CASE WHEN good AND k%4<>0 THEN k%2=0 END AS student_loaded, CASE WHEN good AND k%4<>0 THEN counter END AS student_inferences,
        CASE WHEN good THEN captures END AS pending_count, CASE WHEN good THEN captures*1000000000000 END AS bytes_pending, CASE WHEN good THEN uptime END AS oldest_age_s FROM a""",
)
def poll_parts(spark, sf):
    """Watched classes, student and sync blocks of polls, absent in some."""
    p = B.polls(spark, sf)
    k = F.col("k")
    watched = F.when(k % 3 != 0, F.concat(F.lit('{"cry_baby":'), k / 100.0, F.when(k % 5 == 0, ',"speech":0.5').otherwise(""), F.lit("}"))).otherwise("null")
    student = F.when(k % 4 != 0, F.to_json(F.struct(F.concat(F.lit("v"), k).alias("version"), (k % 2 == 0).alias("loaded"), F.lit(0.5).alias("cry_conf"), F.col("counter").alias("inference_count")))).otherwise("null")
    sync = F.to_json(F.struct(F.col("captures").alias("pending_count"), (F.col("captures") * 1_000_000_000_000).alias("bytes_pending"), F.col("uptime").alias("oldest_pending_age_s")))
    doc = F.concat(F.lit('{"uptime_s":'), "uptime", F.lit(',"watched":'), watched, F.lit(',"student":'), student, F.lit(',"sync":'), sync, F.lit("}"))
    payload = F.when(~F.col("answered"), None).when(k % 10 == 1, F.concat(F.lit("{x"), doc)).otherwise(doc)
    path = scratch_path(spark, "poll-parts")
    p.select(F.lit("d1").alias("device_id"), F.timestamp_micros("t_us").alias("poll_ts"), F.col("event_id").alias("wav_count"), payload.alias("payload")).write.json(path)
    return R.read_polls(spark, path).select(
        F.col("wav_count").alias("event_id"), F.col("watched")["cry_baby"].alias("cry"), F.when(F.col("watched").isNotNull(), F.size("watched")).alias("n_watched"),
        F.col("student.version").alias("student_version"), F.col("student.loaded").alias("student_loaded"), F.col("student.inference_count").alias("student_inferences"),
        F.col("sync.pending_count").alias("pending_count"), F.col("sync.bytes_pending").alias("bytes_pending"), F.col("sync.oldest_pending_age_s").alias("oldest_age_s"),
    )


@query(
    "r13_tail_lines",
    "SELECT user_id, event_id AS line, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40",
)
def tail_lines(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("line"), "event_type")
    return R.tail_lines(e, ["user_id"], "line", 40)


@query("r13_content_tail", "SELECT doc_id, sha256(unhex(right(hex(encode(text)), 8192))) AS tail, sha256(unhex(left(hex(encode(text)), 200))) AS head FROM documents")
def content_tail(spark, sf):
    d = table(spark, sf, "documents")
    body = F.encode("text", "UTF-8")
    return d.select("doc_id", X.sha256_hex(R.content_tail(body, 4096)).alias("tail"), X.sha256_hex(R.content_head(body, 100)).alias("head"))


@query(
    "k01_feature_tables",
    f"""WITH {B.CAP} SELECT event_id, round(value,6) AS value, CASE WHEN event_id%2=0 THEN k END AS k, CASE WHEN event_id%2=1 THEN cls END AS cls FROM cap""",
)
def feature_tables(spark, sf):
    """Rows with different columns written as one table with blanks for the missing, as CSV and JSON lines."""
    c = B.captures(spark, sf)
    path = scratch_path(spark, "features")
    sinks.write_feature_table([c.filter("event_id % 2 = 0").select("event_id", "value", "k"), c.filter("event_id % 2 = 1").select("event_id", "value", "cls")], path)
    back = spark.read.schema("event_id BIGINT, value DOUBLE, k BIGINT, cls STRING").option("header", True).csv(f"{path}/csv")
    return back.withColumn("value", F.round("value", 6))


@query(
    "k02_label_versions",
    f"""WITH {B.CAP}, {B.TIERED} SELECT event_id, tier AS confidence_tier, '20240201' AS audited_at FROM tiered""",
)
def label_versions(spark, sf):
    """The label table as one version folder per audit; an older audit stays as it was."""
    from soundledger.plans.aggregate_queries import tiered

    t = tiered(spark, sf).select("event_id", F.col("tier").alias("confidence_tier"))
    path = scratch_path(spark, "labels")
    sinks.write_labels(t.withColumn("confidence_tier", F.lit("low")), path, "20240101")
    sinks.write_labels(t, path, "20240201")
    return sinks.read_labels(spark, path).withColumn("audited_at", F.col("audited_at").cast("string"))


@query(
    "k06_prune_ledger",
    """SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size_deleted FROM documents WHERE doc_id%3=0""",
)
def prune_ledger(spark, sf):
    """One appended row per deletion."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size_deleted"), F.when(F.col("doc_id") % 3 == 0, "DELETE").otherwise("SKIP").alias("action")
    )
    path = scratch_path(spark, "prune")
    sinks.append_deletions(d.filter("size_deleted % 2 = 0"), path, "2024-02-01T00:00:00Z")
    sinks.append_deletions(d.filter("size_deleted % 2 = 1"), path, "2024-02-02T00:00:00Z")
    return spark.read.parquet(path).select("path", "size_deleted")


@query(
    "k08_canonical_manifest",
    f"""WITH {B.COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY size DESC, session_id, l_orderkey, l_linenumber) AS rn FROM copies)
      SELECT name, 'wav' AS kind, size, session_id AS source_session, sha256(name || CAST(size AS VARCHAR)) AS sha256 FROM r WHERE rn=1""",
)
def canonical_manifest(spark, sf):
    from soundledger.operators.windows import largest_copy

    c = B.copies(spark, sf).withColumn("sha256", F.sha2(F.concat("name", "size"), 256))
    best = largest_copy(c, ["name"], "size", ["session_id", "l_orderkey", "l_linenumber"])
    path = scratch_path(spark, "canonical")
    sinks.write_manifest(best.select("name", F.lit("wav").alias("kind"), "size", "sha256", F.col("session_id").alias("source_session")), path)
    return spark.read.parquet(path).select("name", "kind", "size", "sha256", "source_session")


@query(
    "k07_inventory_days",
    f"""WITH {B.CAP}, {B.TIERED} SELECT day, CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS high_pos, CAST(count(*) AS BIGINT) AS total FROM tiered GROUP BY day
      UNION ALL SELECT 'TOTAL', count(*) FILTER (WHERE tier='high_pos'), count(*) FROM tiered""",
)
def inventory_days(spark, sf):
    from soundledger.operators.labels import inventory
    from soundledger.plans.aggregate_queries import tiered

    t = tiered(spark, sf).withColumnsRenamed({"tier": "confidence_tier", "subtype": "cluster_label"})
    return inventory(t)["days"].select("day", "high_pos", "total")


def _tall(part: str, key: str, inner: str) -> str:
    """A table of the report as rows (part, key, metric, value) in SQL."""
    return f"""SELECT '{part}' AS part, key, metric, value FROM (UNPIVOT (SELECT CAST({key} AS VARCHAR) AS key, COLUMNS(* EXCLUDE ({key}))::VARCHAR FROM ({inner})) ON COLUMNS(* EXCLUDE (key)) INTO NAME metric VALUE value)"""


_TIER_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE tier='{t}') AS BIGINT) AS {t}" for t in ("high_pos", "high_neg", "medium_pos", "medium_neg", "low"))
_SUB = "CASE WHEN s1>=0.5e0 THEN CASE k//25 WHEN 0 THEN 'fuss' WHEN 1 THEN 'full_cry' WHEN 2 THEN 'distress' ELSE 'screech' END ELSE '' END"
_ERA = "CASE WHEN day <= '2024-01-10' THEN 'first' WHEN day = '2024-01-11' THEN 'second' ELSE 'third' END"
_REPORT = f"""{B.CAP}, {B.TIERED}, m AS (SELECT *, {_SUB} AS subtype, {_ERA} AS era, 'v' || CAST(event_id%3 AS VARCHAR) AS version, CASE WHEN s2>=0.05e0 THEN 'speech' ELSE 'other' END AS source FROM tiered)"""


def _crosstab(column: str) -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS {column}, {_TIER_COUNTS}, CAST(count(*) AS BIGINT) AS total FROM m GROUP BY {column} UNION ALL SELECT 'TOTAL', {_TIER_COUNTS}, count(*) FROM m"


_PARTS = {
    "days": ("day", _crosstab("day")), "hours": ("hour", _crosstab("hour")), "eras": ("era", _crosstab("era")), "versions": ("version", _crosstab("version")),
    "sessions": ("device_id", "SELECT device_id, CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day, CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS high_pos, CAST(count(*) FILTER (WHERE tier='high_neg') AS BIGINT) AS high_neg FROM m GROUP BY 1"),
    "subtypes": ("day", "SELECT day, " + ", ".join(f"CAST(count(*) FILTER (WHERE subtype='{x}') AS BIGINT) AS {x}" for x in ("fuss", "full_cry", "distress", "screech")) + ", CAST(count(*) AS BIGINT) AS total FROM m WHERE tier='high_pos' AND subtype<>'' GROUP BY day"),
    "negatives": ("source", "SELECT source, CAST(count(*) AS BIGINT) AS count FROM m WHERE tier='high_neg' GROUP BY source"),
    "readiness": ("part", """SELECT 'all' AS part, pos+neg AS eligible, pos, neg, 100*pos//greatest(pos+neg,1) AS pos_pct, 100*neg//greatest(pos+neg,1) AS neg_pct, pos+neg<1000 AS too_few, rare<10 AS rare_subtype FROM (
        SELECT CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE tier='high_neg') AS BIGINT) AS neg, count(*) FILTER (WHERE tier='high_pos' AND subtype='screech') AS rare FROM m)"""),
}


@query("k07_inventory_tables", f"WITH {_REPORT} " + " UNION ALL ".join(_tall(part, key, inner) for part, (key, inner) in _PARTS.items()))
def inventory_tables(spark, sf):
    """All eight tables of the report, one row a cell."""
    from soundledger.operators.labels import inventory
    from soundledger.plans.aggregate_queries import tiered
    from soundledger.plans.scalar_queries import ERAS

    iso = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ssxxx")
    t = tiered(spark, sf).withColumnsRenamed({"tier": "confidence_tier", "subtype": "cluster_label"})
    t = t.withColumns({
        "era": X.firmware_era(iso, ERAS, "third"), "ensemble_version": F.concat(F.lit("v"), F.col("event_id") % 3),
        "negative_source": F.when(F.col("s2") >= 0.05, "speech").otherwise("other"),
    })
    out = None
    for part, df in inventory(t, session="device_id").items():
        key = F.lit("all") if part == "readiness" else F.col(df.columns[0]).cast("string")
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns[part != "readiness" :]])
        rows = df.select(F.lit(part).alias("part"), key.alias("key"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out
