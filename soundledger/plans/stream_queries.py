"""Queries that run as streams over the given tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from soundledger.plans import bindings as B
from soundledger.plans.registry import query
from soundledger.plans.window_queries import EPISODES, episodes_sql
from soundledger.session import scratch_path
from soundledger.sources import manifest_source as manifests
from soundledger.sources import sinks
from soundledger.sources.tables import table
from soundledger.streaming import adaptive, folds, jobs, silence, state

HOUR = 3_600_000_000


def events(spark, sf):
    e = jobs.table_stream(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", "ts", F.unix_micros("ts").alias("t_us"), F.hour("ts").alias("hour"), F.col("user_id").alias("device_id"), F.col("event_type").alias("cls"),
        k.alias("k"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("s1"), (F.col("value") * 10).alias("rms"),
    )


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "t01_tumbling_snapshots",
    f"""WITH w AS (SELECT event_type AS cls, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2024-01-01') AS s, count(*) AS n, arg_max(value*10, ts) AS last_rms, max(value*10) AS peak_rms FROM events GROUP BY 1,2)
      SELECT cls, epoch_us(s) AS window_us, CAST(n AS BIGINT) AS n, round(last_rms,6) AS last_rms, round(peak_rms,6) AS peak_rms FROM w WHERE s + INTERVAL 30 MINUTE <= {CLOSED}""",
)
def tumbling_snapshots(spark, sf):
    out = jobs.run_to_table(jobs.snapshots(events(spark, sf), "ts", ["cls"], ["rms"], ["rms"], "t_us", "30 minutes"), scratch_path(spark, "snapshots"))
    return out.select("cls", F.unix_micros("window_start").alias("window_us"), "n", F.round("last_rms", 6).alias("last_rms"), F.round("peak_rms", 6).alias("peak_rms"))


@query(
    "t02_sliding_windows",
    f"""WITH w AS (SELECT event_type AS cls, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') - o.i * INTERVAL 1 HOUR AS s, max(value*10) AS peak, count(*) AS n FROM events, (VALUES (0),(1)) o(i) GROUP BY 1,2)
      SELECT cls, epoch_us(s) AS window_us, CAST(n AS BIGINT) AS n, round(peak,6) AS peak_rms FROM w WHERE s + INTERVAL 2 HOUR <= {CLOSED}""",
)
def sliding_windows(spark, sf):
    rows = jobs.snapshots(events(spark, sf), "ts", ["cls"], [], ["rms"], "t_us", "2 hours", "1 hour")
    out = jobs.run_to_table(rows, scratch_path(spark, "sliding"))
    return out.select("cls", F.unix_micros("window_start").alias("window_us"), "n", F.round("peak_rms", 6).alias("peak_rms"))


@query(
    "t02_bursts",
    f"""WITH a AS (SELECT user_id%5 AS device, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 40 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id%5 ORDER BY ts)),
      g AS (SELECT *, sum(b) OVER (PARTITION BY device ORDER BY ts) AS g FROM a)
      SELECT device, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY device, g HAVING max(ts) + INTERVAL 40 MINUTE <= {CLOSED}""",
)
def burst_sessions(spark, sf):
    rows = events(spark, sf).withColumn("device", F.col("device_id") % 5)
    out = jobs.run_to_table(jobs.bursts(rows, "ts", ["device"], "40 minutes"), scratch_path(spark, "bursts"))
    return out.select("device", F.unix_micros("burst_start").alias("start_us"), "n")


@query(
    "t03_detector_stream",
    f"""WITH ep AS ({episodes_sql("0.3e0", 2, 2 * HOUR, "device_id")}) SELECT device, start_us AS t_us, 'crying' AS state FROM ep UNION ALL SELECT device, end_us, 'idle' FROM ep WHERE end_us IS NOT NULL""",
)
def detector_stream(spark, sf):
    rows = events(spark, sf).withColumn("device", F.col("device_id"))
    return jobs.run_to_table(folds.detector_stream(rows, ["device"], "t_us", "event_id", "s1", 0.3, 2, 2 * HOUR), scratch_path(spark, "detector"))


@query(
    "t04_noise_floor_stream",
    f"""WITH {B.CAP}, lg AS (SELECT hour AS device, log2(greatest(rms*20,1e0)) AS x FROM cap), b AS (SELECT device, CASE WHEN x<5 THEN 0 WHEN x>=14.5 THEN 31 ELSE CAST(floor((x-5e0)*32/9.5e0) AS INTEGER) END AS bin FROM lg),
      g AS (SELECT d.device, r.i AS bin, (SELECT count(*) FROM b WHERE b.device=d.device AND b.bin=r.i) AS n FROM (SELECT DISTINCT device FROM b) d, range(32) r(i)),
      c AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY device) AS tot FROM g)
      SELECT device, CAST(any_value(tot) AS BIGINT) AS n, round(pow(2e0,5e0+9.5e0*(min(bin) FILTER (WHERE cum>=floor(tot*0.5e0))+0.5e0)/32),6) AS p50, round(pow(2e0,5e0+9.5e0*(min(bin) FILTER (WHERE cum>=floor(tot*0.95e0))+0.5e0)/32),6) AS p95 FROM c GROUP BY 1""",
)
def noise_floor_stream(spark, sf):
    rows = events(spark, sf).select(F.col("hour").alias("device"), "t_us", "event_id", (F.col("rms") * 20).alias("rms"))
    out = jobs.run_to_table(folds.noise_floor_stream(rows, ["device"], "t_us", "event_id", "rms"), scratch_path(spark, "floor"))
    last = out.groupBy("device").agg(F.max_by(F.struct("n", "p50", "p95"), "t_us").alias("s")).select("device", "s.*")
    return last.select("device", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "t05_trigger_stream",
    f"""WITH {B.CAP}, l AS (SELECT device_id AS device, list({{'t': t_us, 'x': rms, 'since': CAST(-1 AS BIGINT), 'fired': CAST(-1 AS BIGINT), 'n': CAST(0 AS BIGINT)}} ORDER BY t_us, event_id) AS xs, min(t_us) AS t0 FROM cap GROUP BY 1),
      f AS (SELECT device, list_reduce(list_prepend({{'t': t0, 'x': 0e0, 'since': CAST(-1 AS BIGINT), 'fired': CAST(-1 AS BIGINT), 'n': CAST(0 AS BIGINT)}}, xs), lambda a, r:
        CASE WHEN r.t - t0 < {24 * HOUR} OR (a.fired>=0 AND r.t-a.fired < {4 * HOUR}) OR NOT r.x > 300e0 THEN {{'t': r.t, 'x': r.x, 'since': CAST(-1 AS BIGINT), 'fired': a.fired, 'n': a.n}}
        WHEN a.since<0 THEN {{'t': r.t, 'x': r.x, 'since': r.t, 'fired': a.fired, 'n': a.n}}
        WHEN r.t-a.since < {HOUR // 6} THEN {{'t': r.t, 'x': r.x, 'since': a.since, 'fired': a.fired, 'n': a.n}}
        ELSE {{'t': r.t, 'x': r.x, 'since': CAST(-1 AS BIGINT), 'fired': r.t, 'n': a.n+1}} END) AS s FROM l)
      SELECT device, s.n AS fires, s.fired AS last_fire_us FROM f WHERE s.n>0""",
)
def trigger_stream(spark, sf):
    rows = events(spark, sf).select(F.col("device_id").alias("device"), "t_us", "event_id", "rms", F.lit(60.0).alias("p50"))
    fires = folds.trigger_stream(rows, ["device"], "t_us", "event_id", "rms", "p50", 5.0, 200.0, HOUR // 6, 4 * HOUR, 24 * HOUR)
    out = jobs.run_to_table(fires, scratch_path(spark, "triggers"))
    return out.groupBy("device").agg(F.count(F.lit(1)).alias("fires"), F.max("fire_us").alias("last_fire_us"))


def _running_floor(device: str, gain: str) -> str:
    """Rows of captures with the noise floor as of each of them, in SQL."""
    upto = ", ".join(f"sum(CASE WHEN bin<={i} THEN 1 ELSE 0 END) OVER w AS u{i}" for i in range(32))
    pick = lambda p: "pow(2e0, 5e0 + 9.5e0*(CASE " + " ".join(f"WHEN u{i}>=floor(n*{p}) THEN {i}" for i in range(31)) + " ELSE 31 END + 0.5e0)/32)"
    return f"""{B.CAP}, lv AS (SELECT {device} AS device, t_us, event_id, s1, rms*{gain} AS rms, log2(greatest(rms*{gain},1e0)) AS x FROM cap),
      bn AS (SELECT *, CASE WHEN x<5 THEN 0 WHEN x>=14.5 THEN 31 ELSE CAST(floor((x-5e0)*32/9.5e0) AS INTEGER) END AS bin FROM lv),
      un AS (SELECT *, count(*) OVER w AS n, min(t_us) OVER w AS since_us, {upto} FROM bn WINDOW w AS (PARTITION BY device ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)),
      fl AS (SELECT device, t_us, event_id, s1, rms, n, since_us, {pick("0.5e0")} AS p50, {pick("0.95e0")} AS p95 FROM un)"""


@query(
    "t03_adaptive_detector",
    f"""WITH {_running_floor("device_id%5", "5")}, a AS (SELECT device, t_us, event_id,
        s1 >= 0.3e0 + CASE WHEN t_us-since_us < 300000000 OR n<64 OR p95<=500e0 THEN 0e0 WHEN p95>=5000e0 THEN 0.1e0 ELSE 0.1e0*(p95-500e0)/(5000e0-500e0) END AS hit FROM fl),
      {EPISODES.format(streak=2, hold=2 * HOUR)}, ep AS (SELECT device, start_us, end_us FROM f WHERE start_us IS NOT NULL)
      SELECT device, start_us AS t_us, 'crying' AS state FROM ep UNION ALL SELECT device, end_us, 'idle' FROM ep WHERE end_us IS NOT NULL""",
)
def adaptive_detector(spark, sf):
    """The detector on the noise floor: two keyed operators in a chain, the threshold moving with every row."""
    rows = events(spark, sf).select((F.col("device_id") % 5).alias("device"), "t_us", "event_id", "s1", (F.col("rms") * 5).alias("rms"))
    return jobs.run_to_table(adaptive.adaptive_detector_stream(rows, ["device"], "t_us", "event_id", "s1", "rms", 0.3, 0.1, 2, 2 * HOUR, ttl_ms=None), scratch_path(spark, "adaptive"))


@query(
    "t05_adaptive_trigger",
    f"""WITH {_running_floor("device_id%50", "1")}, l AS (SELECT device, list({{'t': t_us, 'loud': rms > greatest(3*p50, 200e0), 'since': CAST(-1 AS BIGINT), 'fired': CAST(-1 AS BIGINT), 'n': CAST(0 AS BIGINT)}} ORDER BY t_us, event_id) AS xs, min(t_us) AS t0 FROM fl GROUP BY 1),
      f AS (SELECT device, list_reduce(list_prepend({{'t': t0, 'loud': false, 'since': CAST(-1 AS BIGINT), 'fired': CAST(-1 AS BIGINT), 'n': CAST(0 AS BIGINT)}}, xs), lambda a, r:
        CASE WHEN r.t - t0 < {24 * HOUR} OR (a.fired>=0 AND r.t-a.fired < {4 * HOUR}) OR NOT r.loud THEN {{'t': r.t, 'loud': r.loud, 'since': CAST(-1 AS BIGINT), 'fired': a.fired, 'n': a.n}}
        WHEN a.since<0 THEN {{'t': r.t, 'loud': r.loud, 'since': r.t, 'fired': a.fired, 'n': a.n}}
        WHEN r.t-a.since < {HOUR // 6} THEN {{'t': r.t, 'loud': r.loud, 'since': a.since, 'fired': a.fired, 'n': a.n}}
        ELSE {{'t': r.t, 'loud': r.loud, 'since': CAST(-1 AS BIGINT), 'fired': r.t, 'n': a.n+1}} END) AS s FROM l)
      SELECT device, s.n AS fires, s.fired AS last_fire_us FROM f WHERE s.n>0""",
)
def adaptive_trigger(spark, sf):
    """The sustained trigger against the running median of its own device."""
    rows = events(spark, sf).select((F.col("device_id") % 50).alias("device"), "t_us", "event_id", "rms")
    fires = adaptive.adaptive_trigger_stream(rows, ["device"], "t_us", "event_id", "rms", 3.0, 200.0, HOUR // 6, 4 * HOUR, 24 * HOUR, ttl_ms=None)
    out = jobs.run_to_table(fires, scratch_path(spark, "adaptive-triggers"))
    return out.groupBy("device").agg(F.count(F.lit(1)).alias("fires"), F.max("fire_us").alias("last_fire_us"))


MONITOR = f"""{B.CAP}, p AS (SELECT device_id AS device, t_us, event_id, k>=50 AS answered, k>=50 AND k%17=3 AS parse_error, event_id%500 AS uptime, CASE WHEN cls='view' THEN 'idle' WHEN cls='click' THEN 'LISTEN' ELSE cls END AS state,
   k/100e0 AS peak, (k*7)%20 AS alerts, (event_id%1000)*3 AS overruns, (event_id%9)//2 AS counter, CASE WHEN event_id%6=0 THEN NULL ELSE k END AS captures FROM cap),
 q AS (SELECT *, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY device ORDER BY t_us, event_id)),
 s AS (SELECT *, rn - coalesce(max(CASE WHEN answered THEN rn END) OVER (PARTITION BY device ORDER BY rn ROWS UNBOUNDED PRECEDING),0) AS silent FROM q),
 s2 AS (SELECT *, lag(silent,1,0) OVER (PARTITION BY device ORDER BY rn) AS silent_before FROM s),
 g AS (SELECT *, lag(uptime,1,0) OVER w AS pu, lag(overruns,1,0) OVER w AS po, lag(alerts,1,0) OVER w AS pa, lag(counter,1,0) OVER w AS pc, row_number() OVER w AS gn FROM s2 WHERE answered AND NOT parse_error WINDOW w AS (PARTITION BY device ORDER BY rn)),
 h AS (SELECT *, CASE WHEN pu<>0 AND uptime<pu THEN 0 ELSE pc END AS base FROM g),
 st AS (SELECT *, gn - coalesce(max(CASE WHEN NOT (base<>0 AND counter<=base) THEN gn END) OVER (PARTITION BY device ORDER BY gn ROWS UNBOUNDED PRECEDING),0) AS stuck FROM h),
 cp AS (SELECT *, lag(captures) OVER (PARTITION BY device ORDER BY rn) AS pcap FROM s2 WHERE answered AND NOT parse_error AND captures IS NOT NULL)
 SELECT device, event_id, CASE silent WHEN 1 THEN 'NORESP_FIRST' WHEN 3 THEN 'OUTAGE_CONFIRMED' ELSE 'OUTAGE_SUSTAINED' END AS kind FROM s2 WHERE silent IN (1,3,30)
 UNION ALL SELECT device, event_id, 'OUTAGE_RECOVERED' FROM s2 WHERE answered AND silent_before>=3
 UNION ALL SELECT device, event_id, 'METRICS_PARSE_ERR' FROM s2 WHERE parse_error
 UNION ALL SELECT device, event_id, 'REBOOT' FROM g WHERE pu<>0 AND uptime<pu
 UNION ALL SELECT device, event_id, 'INFERENCE_STALLED' FROM st WHERE stuck=2
 UNION ALL SELECT device, event_id, 'NEW_WAV' FROM cp WHERE captures>pcap
 UNION ALL SELECT device, event_id, 'OVRGROW_BIG' FROM g WHERE po<>0 AND overruns-po>100
 UNION ALL SELECT device, event_id, 'STATE' FROM g WHERE state NOT IN ('idle','LISTEN')
 UNION ALL SELECT device, event_id, 'CRY_SIGNAL' FROM g WHERE peak>0.55e0
 UNION ALL SELECT device, event_id, 'ALERT_FIRED' FROM g WHERE alerts>pa"""


@query("t06_health_monitor", f"WITH {MONITOR}")
def health_monitor(spark, sf):
    e = events(spark, sf)
    state = F.when(F.col("cls") == "view", "idle").when(F.col("cls") == "click", "LISTEN").otherwise(F.col("cls"))
    answered = F.col("k") >= 50
    polls = e.select(
        F.col("device_id").alias("device"), "t_us", "event_id", answered.alias("answered"), (answered & (F.col("k") % 17 == 3)).alias("parse_error"),
        (F.col("event_id") % 500).alias("uptime"), state.alias("state"), (F.col("k") / 100.0).alias("peak"), (F.col("k") * 7 % 20).alias("alerts"),
        (F.col("event_id") % 1000 * 3).alias("overruns"), F.expr("(event_id % 9) div 2").alias("counter"), F.when(F.col("event_id") % 6 != 0, F.col("k")).alias("captures"),
    )
    out = jobs.run_to_table(folds.monitor_stream(polls, ["device"], "t_us", "event_id"), scratch_path(spark, "anomalies"))
    return out.select("device", "event_id", "kind")


@query(
    "t06_silent_devices",
    f"""WITH d AS (SELECT DISTINCT c_custkey%1000 AS device, CAST(epoch_ms(TIMESTAMP '2024-01-01') AS BIGINT) AS ms FROM customer),
      r AS (SELECT user_id%700 AS device, epoch_us(ts)//1000 AS ms FROM events),
      a AS (SELECT * FROM d UNION SELECT r.device, r.ms FROM r LEFT JOIN d USING (device) WHERE d.ms IS NULL OR r.ms > d.ms),
      g AS (SELECT *, lead(ms) OVER (PARTITION BY device ORDER BY ms) AS nxt FROM a),
      k AS (SELECT device, ms + n * 7200000 AS ms, kind, nxt FROM g, (VALUES (1,'NORESP_FIRST'), (3,'OUTAGE_CONFIRMED'), (30,'OUTAGE_SUSTAINED')) v(n, kind))
      SELECT device, ms * 1000 AS t_us, kind FROM k WHERE ms < coalesce(nxt, (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE)//1000 FROM events))
      UNION ALL SELECT device, nxt * 1000, 'OUTAGE_RECOVERED' FROM g WHERE nxt - ms > 3 * 7200000""",
)
def silent_devices(spark, sf):
    """Silence by timers: devices from the customer list, three in ten of which never send an event."""
    rows = events(spark, sf).select((F.col("device_id") % 700).alias("device"), "ts")
    listed = table(spark, sf, "customer").select((F.col("c_custkey") % 1000).alias("device"), F.lit("2024-01-01").cast("timestamp").alias("since"))
    return jobs.run_to_table(silence.silence_stream(rows, listed, ["device"], "ts", 2 * 3_600_000, "EventTime"), scratch_path(spark, "silence"))


@query("t07_ledger_stream", f"WITH {B.LEDGER}, {B.STATE} SELECT * FROM state")
def ledger_stream(spark, sf):
    e = jobs.table_stream(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "register").when(kind == "signup", "close").when(kind == "purchase", "ack").otherwise("purge")
    led = e.select(
        F.concat(F.lit("f"), "user_id", F.lit("-"), k % 7).alias("path"), F.col("event_id").alias("line"), op.alias("op"), F.floor(F.col("value") * 100).alias("size"),
        F.expr("unix_micros(ts) div 1000000").alias("mtime"), (F.col("event_id") % 97).cast("string").alias("sha256"), F.lit("wav").alias("category"),
        F.when(k % 4 == 0, "synced").otherwise("pending").alias("sync_state"),
    )
    path = scratch_path(spark, "ledger")
    jobs.maintain_ledger(led, path)
    return jobs.ledger_state(spark, path)


@query(
    "t08_manifest_increment",
    f"""WITH {B.REMOTE} SELECT path, mtime, o_orderkey%3=0 AS verify FROM remote WHERE o_orderkey%3=0 OR mtime>900000000 OR o_orderkey%10=1""",
)
def manifest_increment(spark, sf):
    r = B.remote(spark, sf)
    gen = F.when(F.col("o_orderkey") % 3 == 0, "g2").otherwise("g1")
    return jobs.manifest_increment(r, 900_000_000, "g1", gen, failed=r.filter("o_orderkey % 10 = 1")).select("path", "mtime", "verify")


@query("t07_ledger_state", f"WITH {B.LEDGER}, {B.STATE} SELECT * FROM state")
def ledger_kept_as_state(spark, sf):
    """The ledger in map state by device and path, taken in two runs of one stream and read back from the state store."""
    path = scratch_path(spark, "ledger-state")
    led = B.ledger(spark, sf).withColumn("device", F.regexp_extract("path", "^f([0-9]+)-", 1).cast("bigint"))
    half = F.col("line") % 2
    for part in (0, 1):
        # Odd lines come in a later file than even ones: lines decide, not arrival.
        led.filter(half == part).write.parquet(f"{path}/in/part={part}")
        stream = spark.readStream.schema(led.schema).parquet(f"{path}/in")
        state.keep_ledger(stream, path)
    return state.kept_ledger(spark, path).drop("device")


LATE_FILES = 5


@query(
    "t11_late_rows",
    f"""WITH e AS (SELECT ts, user_id%20 AS device, (event_id*7)%{LATE_FILES} AS b, event_id%3 = 0 AS scattered FROM events),
      f AS (SELECT *, CASE WHEN scattered THEN b ELSE least({LATE_FILES - 1}, CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-01')/(30e0*86400000000/{LATE_FILES})) AS BIGINT)) END AS file FROM e),
      n AS (SELECT file, count(*) AS rows, max(ts) AS newest FROM f GROUP BY 1),
      w AS (SELECT file, rows, max(newest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS late FROM n)
      SELECT w.file AS batch, w.rows, CAST(count(*) FILTER (WHERE f.ts <= w.late) AS BIGINT) AS dropped FROM w JOIN f USING (file) GROUP BY 1, 2""",
)
def late_rows(spark, sf):
    """Rows per batch, and how many of them a keyed operator dropped as too late, from the stored progress of the stream."""
    path = scratch_path(spark, "late")
    e = table(spark, sf, "events").select("ts", (F.col("user_id") % 20).alias("device"), (F.col("event_id") * 7 % LATE_FILES).alias("b"), (F.col("event_id") % 3 == 0).alias("scattered"))
    by_time = F.least(F.lit(LATE_FILES - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / (30 * 86_400_000_000 / LATE_FILES)))
    e = e.withColumn("file", F.when(F.col("scattered"), F.col("b")).otherwise(by_time))
    for number in range(LATE_FILES):
        e.filter(F.col("file") == number).select("ts", "device").coalesce(1).write.parquet(f"{path}/in/file={number}")
    rows = spark.readStream.schema("ts TIMESTAMP, device BIGINT").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    listed = spark.range(1).select(F.lit(0).cast("long").alias("device"), F.lit("2024-01-01").cast("timestamp").alias("since"))
    progress = state.ProgressTable(f"{path}/progress")
    spark.streams.addListener(progress)
    try:
        jobs.run_to_table(silence.silence_stream(state.observed(rows, "ts"), listed, ["device"], "ts", 3_600_000, "EventTime", "1 day"), f"{path}/out")
        # Progress is told in the background: wait until the last batch's is there.
        for _ in range(100):
            have = progress.table(spark).filter("rows > 0") if progress.written() else None
            if have is not None and have.count() >= LATE_FILES:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    return progress.table(spark).filter("rows > 0").select("batch", "rows", "dropped")


#: Three snapshots of the manifest: the second has newer entries, the third is of a new generation.
_NEWEST = "CASE WHEN o_orderkey%10=3 THEN mtime + 1000000000 ELSE mtime END"


@query(
    "t08_manifest_source",
    f"""WITH {B.REMOTE}, a AS (SELECT path, mtime, o_orderkey, o_orderkey%10=1 AS bad FROM remote WHERE o_orderkey%4<>0),
      b AS (SELECT path, {_NEWEST} AS mtime, o_orderkey FROM remote),
      p1 AS (SELECT 0 AS pass, path, mtime, false AS verify, false AS retry, NOT bad AS ok FROM a),
      p2 AS (SELECT 1, path, mtime, false, false, true FROM b WHERE mtime > (SELECT max(mtime) FROM a)
             UNION ALL SELECT 1, path, mtime, false, true, true FROM a WHERE bad AND path NOT IN (SELECT path FROM b WHERE mtime > (SELECT max(mtime) FROM a))),
      p3 AS (SELECT 2, path, mtime, true, false, true FROM b WHERE o_orderkey%3=0)
      SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""",
)
def manifest_source(spark, sf):
    """Three passes over a manifest that grows and then starts a new generation; transfers of some paths fail in the first."""
    r = B.remote(spark, sf)
    newer = r.withColumn("mtime", F.when(F.col("o_orderkey") % 10 == 3, F.col("mtime") + 1_000_000_000).otherwise(F.col("mtime")))
    root, path = scratch_path(spark, "manifest"), scratch_path(spark, "mirror")
    name = F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("bigint")
    for number, (entries, generation) in enumerate([(r.filter("o_orderkey % 4 <> 0"), "g1"), (newer, "g1"), (newer.filter("o_orderkey % 3 = 0"), "g2")]):
        manifests.publish_manifest(entries, root, generation)
        fails = name % 10 == 1 if number == 0 else F.lit(False)
        manifests.mirror_pass(spark, root, path, lambda rows, fails=fails: rows.withColumn("ok", ~fails))
    done = spark.read.option("basePath", f"{path}/done").parquet(f"{path}/done")
    return done.select(F.col("batch").alias("pass"), "path", "mtime", "verify", "retry", "ok")


@query(
    "t09_fan_out",
    f"""WITH {B.CAP} SELECT 'alerts' AS consumer, CAST(count(*) AS BIGINT) AS n FROM cap WHERE s1>=0.5e0 UNION ALL SELECT 'levels', CAST(count(DISTINCT device_id) AS BIGINT) FROM cap UNION ALL SELECT 'log', CAST(count(*) AS BIGINT) FROM cap""",
)
def fan_out(spark, sf):
    path = scratch_path(spark, "fan-out")
    consumers = {
        "log": lambda b: b.select("event_id"),
        "alerts": lambda b: b.filter("s1 >= 0.5").select("event_id"),
        "levels": lambda b: b.groupBy(F.col("device_id").alias("event_id")).agg(F.max("rms").alias("rms")).select("event_id"),
    }
    jobs.fan_out(events(spark, sf), path, consumers)
    parts = [spark.read.parquet(f"{path}/{n}").select("event_id").distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("consumer", F.lit(n)) for n in consumers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t10_deduplicate", "SELECT event_type AS cls, user_id AS device_id, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1,2")
def deduplicate(spark, sf):
    rows = events(spark, sf).select("ts", "cls", "device_id")
    out = jobs.run_to_table(jobs.deduplicated(rows, "ts", ["cls", "device_id"], "60 days"), scratch_path(spark, "dedup"))
    return out.groupBy("cls", "device_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k04_hour_buckets",
    """SELECT CASE WHEN event_id%20=0 THEN 'unsynced' ELSE strftime(ts,'%Y-%m-%d') END AS date, CASE WHEN event_id%20=0 THEN 'boot' ELSE strftime(ts,'%H') END AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1,2""",
)
def hour_buckets(spark, sf):
    """Telemetry files by date and hour; rows from before clock sync (T11) in a bucket of their own."""
    rows = events(spark, sf).select("event_id", "rms", F.when(F.col("event_id") % 20 != 0, F.col("ts")).alias("event_ts"))
    path = scratch_path(spark, "telemetry")
    sinks.stream_telemetry(rows, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    back = spark.read.schema("event_id BIGINT, rms DOUBLE, event_ts TIMESTAMP, date STRING, hour STRING").parquet(f"{path}/table")
    return back.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k05_anomaly_table",
    f"""WITH a AS (WITH {MONITOR}) SELECT kind, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY kind""",
)
def anomaly_table(spark, sf):
    """Appended anomalies of the monitor, counted by kind."""
    return health_monitor(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
