"""Queries for sequence operators, ledgers, sorts and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import text as X
from soundledger.operators import aggregates, chunks, folds, ledger, windows
from soundledger.plans import bindings as B
from soundledger.plans.join_queries import GREEDY
from soundledger.plans.registry import query
from soundledger.sources.tables import table

HOUR = 3_600_000_000


@query(
    "w01_first_owner",
    f"""WITH {B.COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY session_id, l_orderkey, l_linenumber) AS rn FROM copies)
      SELECT name, session_id, size FROM r WHERE rn=1""",
)
def first_owner(spark, sf):
    return windows.first_owner(B.copies(spark, sf), ["name"], ["session_id", "l_orderkey", "l_linenumber"]).select("name", "session_id", "size")


@query(
    "w02_largest_copy",
    f"""WITH {B.COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY size DESC, session_id, l_orderkey, l_linenumber) AS rn FROM copies)
      SELECT name, session_id, size FROM r WHERE rn=1""",
)
def largest_copy(spark, sf):
    out = windows.largest_copy(B.copies(spark, sf), ["name"], "size", ["session_id", "l_orderkey", "l_linenumber"])
    return out.select("name", "session_id", "size")


#: Episodes from rows ``a`` (device, t_us, event_id, hit).
EPISODES = """b AS (SELECT *, max(CASE WHEN hit THEN t_us END) OVER w AS lp, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY device ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT *, rn - coalesce(max(CASE WHEN NOT hit THEN rn END) OVER w, 0) AS streak, coalesce(NOT hit AND t_us>=lp+{hold}, false) AS expired FROM b
            WINDOW w AS (PARTITION BY device ORDER BY rn ROWS UNBOUNDED PRECEDING)),
      d AS (SELECT *, sum(CASE WHEN expired THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY rn ROWS UNBOUNDED PRECEDING) AS seg FROM c),
      e AS (SELECT device, seg, min(t_us) AS seg_first, min(CASE WHEN hit AND streak>={streak} THEN t_us END) AS start_us FROM d GROUP BY 1,2),
      f AS (SELECT *, lead(seg_first) OVER (PARTITION BY device ORDER BY seg) AS end_us FROM e)"""


def episodes_sql(threshold: str, streak: int, hold: int, device: str = "hour%6") -> str:
    return f"""WITH {B.CAP}, a AS (SELECT {device} AS device, t_us, event_id, s1>={threshold} AS hit FROM cap), {EPISODES.format(streak=streak, hold=hold)}
      SELECT device, start_us, end_us FROM f WHERE start_us IS NOT NULL"""


@query("w03_detector_episodes", episodes_sql("0.3e0", 2, 2 * HOUR))
def detector_episodes(spark, sf):
    c = B.captures(spark, sf).withColumn("device", F.col("hour") % 6)
    return windows.detector_episodes(c, ["device"], "t_us", "event_id", "s1", F.lit(0.3), 2, 2 * HOUR)


@query(
    "w04_threshold_adjust",
    f"""WITH {B.CAP}, b AS (SELECT device_id, CASE WHEN log2(greatest(rms*5,1e0))<5 THEN 0 WHEN log2(greatest(rms*5,1e0))>=14.5 THEN 31 ELSE CAST(floor((log2(greatest(rms*5,1e0))-5e0)*32/9.5e0) AS INTEGER) END AS bin FROM cap),
      h AS (SELECT device_id, bin, count(*) AS c FROM b GROUP BY 1,2), u AS (SELECT *, sum(c) OVER (PARTITION BY device_id ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY device_id) AS tot FROM h),
      q AS (SELECT device_id, pow(2e0,5e0+9.5e0*(min(bin) FILTER (WHERE cum>=floor(tot*0.95e0))+0.5e0)/32) AS p95 FROM u GROUP BY 1),
      s AS (SELECT device_id, CAST(count(*) AS BIGINT) AS n, max(t_us)-min(t_us) >= 300000000 AS warm FROM cap GROUP BY 1), f AS (SELECT * FROM s JOIN q USING (device_id))
      SELECT device_id, round(CASE WHEN NOT warm OR n<64 OR p95<=500e0 THEN 0e0 WHEN p95>=5000e0 THEN 0.1e0 ELSE 0.1e0*(p95-500e0)/(5000e0-500e0) END,6) AS adjust FROM f""",
)
def threshold_adjust(spark, sf):
    c = B.captures(spark, sf).withColumn("level", F.col("rms") * 5)
    seen = c.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t_us") - F.min("t_us") >= 300_000_000).alias("warm"))
    p95 = aggregates.hist_quantile(F.col("hist"), 0.95).alias("p95")
    f = seen.join(aggregates.level_histogram(c, ["device_id"], "level").select("device_id", p95), "device_id")
    return f.select("device_id", F.round(windows.threshold_adjust(F.col("p95"), F.col("warm"), F.col("n"), 0.1), 6).alias("adjust"))


@query(
    "w05_sustained_level",
    f"""WITH {B.CAP}, a AS (SELECT hour%6 AS device, t_us, event_id, rms, rms > greatest(5*50e0, 200e0) AS above FROM cap),
      b AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
      c AS (SELECT *, min(t_us) OVER (PARTITION BY device, run) AS since_us FROM b WHERE above)
      SELECT device, since_us, min(t_us) AS fire_us, arg_min(rms, t_us) AS rms FROM c WHERE t_us-since_us >= 1800000000 GROUP BY 1,2""",
)
def sustained_level(spark, sf):
    c = B.captures(spark, sf).withColumn("device", F.col("hour") % 6)
    limit = F.greatest(F.lit(5 * 50.0), F.lit(200.0))
    return windows.sustained_level(c, ["device"], "t_us", "event_id", "rms", limit, 1_800_000_000)


@query(
    "w06_cooldown",
    f"""WITH RECURSIVE {B.CAP}, ev AS (SELECT hour%4 AS device, t_us AS t FROM cap), {GREEDY.format(gap=2 * HOUR)}
      SELECT device, t AS t_us FROM chain""",
)
def cooldown(spark, sf):
    c = B.captures(spark, sf).withColumn("device", F.col("hour") % 4)
    return folds.space_out(c, ["device"], "t_us", "event_id", 2 * HOUR).select("device", "t_us")


@query(
    "w07_smoothed_rate",
    f"""WITH {B.CAP}, a AS (SELECT device_id, t_us, 1e6/(t_us - lag(t_us) OVER (PARTITION BY device_id ORDER BY t_us, event_id)) AS x FROM cap),
      l AS (SELECT device_id, list(x ORDER BY t_us) FILTER (WHERE x IS NOT NULL) AS xs FROM a GROUP BY 1)
      SELECT device_id, round(3600e0*list_reduce(list_prepend(0e0, coalesce(xs, [])), lambda acc, x: 0.8e0*acc + 0.2e0*x),6) AS per_hour FROM l""",
)
def smoothed_rate(spark, sf):
    r = folds.smoothed_rate(B.captures(spark, sf), ["device_id"], "t_us", "event_id")
    last = r.groupBy("device_id").agg(F.max_by("rate", F.struct("t_us", "event_id")).alias("rate"))
    return last.select("device_id", F.round(F.col("rate") * 3600, 6).alias("per_hour"))


@query(
    "w08_decayed_peak",
    f"""WITH {B.CAP}, l AS (SELECT device_id, list(s1 ORDER BY t_us, event_id) AS xs FROM cap GROUP BY 1)
      SELECT device_id, round(list_reduce(list_prepend(0e0, xs), lambda acc, x: CASE WHEN x>acc THEN x ELSE 0.95e0*acc END),6) AS peak FROM l""",
)
def decayed_peak(spark, sf):
    r = folds.decayed_peak(B.captures(spark, sf), ["device_id"], "t_us", "event_id", "s1")
    last = r.groupBy("device_id").agg(F.max_by("peak", F.struct("t_us", "event_id")).alias("peak"))
    return last.select("device_id", F.round("peak", 6).alias("peak"))


@query(
    "w09_anchor_uptime",
    f"""WITH {B.CAP}, r AS (SELECT device_id, day, event_id, t_us//1000000 % 86400 AS uptime_s, CASE WHEN k<40 THEN NULL ELSE t_us END AS ts_us FROM cap),
      a AS (SELECT device_id, day, arg_min(ts_us - uptime_s*1000000, event_id) FILTER (WHERE ts_us IS NOT NULL) AS anchor FROM r GROUP BY 1,2)
      SELECT r.event_id, coalesce(r.ts_us, a.anchor + r.uptime_s*1000000) AS wall_us FROM r LEFT JOIN a USING (device_id, day)""",
)
def anchor_uptime(spark, sf):
    r = B.captures(spark, sf).select(
        "device_id", "day", "event_id", (F.col("t_s") % 86400).alias("uptime_s"), F.when(F.col("k") >= 40, F.col("t_us")).alias("ts_us")
    )
    return windows.anchor_uptime(r, ["device_id", "day"], "ts_us", "uptime_s", ["event_id"]).select("event_id", "wall_us")


@query(
    "w10_poll_deltas",
    f"""WITH {B.CAP}, {B.POLLS}, a AS (SELECT *, lag(uptime,1,0) OVER w AS pu, lag(overruns,1,0) OVER w AS po, lag(captures) OVER w AS pc, lag(alerts,1,0) OVER w AS pa
        FROM polls WINDOW w AS (PARTITION BY device_id ORDER BY t_us, event_id))
      SELECT event_id, pu<>0 AND uptime<pu AS reboot, po<>0 AND overruns-po>100 AS overrun_burst, coalesce(captures>pc,false) AS new_capture, alerts>pa AS alert_fired FROM a""",
)
def poll_deltas(spark, sf):
    out = windows.poll_deltas(B.polls(spark, sf), ["device_id"], ["t_us", "event_id"])
    return out.select("event_id", "reboot", "overrun_burst", "new_capture", "alert_fired")


@query(
    "w11_stalls",
    f"""WITH {B.CAP}, {B.POLLS}, a AS (SELECT *, lag(uptime,1,0) OVER w AS pu, lag(counter,1,0) OVER w AS pc, row_number() OVER w AS rn FROM polls WINDOW w AS (PARTITION BY device_id ORDER BY t_us, event_id)),
      b AS (SELECT *, CASE WHEN pu<>0 AND uptime<pu THEN 0 ELSE pc END AS base FROM a),
      c AS (SELECT *, rn - coalesce(max(CASE WHEN NOT (base<>0 AND counter<=base) THEN rn END) OVER (PARTITION BY device_id ORDER BY rn ROWS UNBOUNDED PRECEDING),0) AS run FROM b)
      SELECT event_id FROM c WHERE run=2""",
)
def stalls(spark, sf):
    return windows.stalls(B.polls(spark, sf), ["device_id"], ["t_us", "event_id"], "uptime", "counter").select("event_id")


@query(
    "w12_outages",
    f"""WITH {B.CAP}, {B.POLLS}, p AS (SELECT hour%3 AS device, t_us, event_id, k>=75 AS answered FROM cap), a AS (SELECT *, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY device ORDER BY t_us, event_id)),
      b AS (SELECT *, rn - coalesce(max(CASE WHEN answered THEN rn END) OVER (PARTITION BY device ORDER BY rn ROWS UNBOUNDED PRECEDING),0) AS run FROM a),
      c AS (SELECT *, lag(run,1,0) OVER (PARTITION BY device ORDER BY rn) AS before FROM b)
      SELECT event_id, CASE WHEN answered AND before>=3 THEN 'OUTAGE_RECOVERED' WHEN run=1 THEN 'NORESP_FIRST' WHEN run=3 THEN 'OUTAGE_CONFIRMED' WHEN run=30 THEN 'OUTAGE_SUSTAINED' END AS kind,
       CAST(CASE WHEN answered THEN before ELSE run END AS BIGINT) AS polls FROM c WHERE (answered AND before>=3) OR (NOT answered AND run IN (1,3,30))""",
)
def outages(spark, sf):
    p = B.captures(spark, sf).select((F.col("hour") % 3).alias("device"), "t_us", "event_id", (F.col("k") >= 75).alias("answered"))
    return windows.outages(p, ["device"], ["t_us", "event_id"], F.col("answered")).select("event_id", "kind", "polls")


@query(
    "w13_row_split",
    """WITH n AS (SELECT event_id, 'cry-' || strftime(ts,'%Y%m%dT%H%M%S') || '-' || CAST(event_id AS VARCHAR) AS name FROM events),
      r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM n)
      SELECT name, pos, CASE pos%5 WHEN 4 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split FROM r""",
)
def row_split(spark, sf):
    e = table(spark, sf, "events")
    n = e.select(F.concat(F.lit("cry-"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("-"), "event_id").alias("name"))
    return chunks.number_names(n, "name", "pos").withColumn("split", windows.row_split(F.col("pos")))


@query("w14_ledger_replay", f"WITH {B.LEDGER}, {B.STATE} SELECT * FROM state")
def ledger_replay(spark, sf):
    return ledger.replay(B.ledger(spark, sf))


@query(
    "w15_ledger_compact",
    f"""WITH {B.LEDGER}, {B.STATE} SELECT path, size, mtime, sha256, category, sync_state, 'register' AS op, CAST(NULL AS BIGINT) AS entries, 1706745600 AS ts FROM state
      UNION ALL SELECT NULL,NULL,NULL,NULL,NULL,NULL,'compact', CAST(count(*) AS BIGINT), 1706745600 FROM state""",
)
def ledger_compact(spark, sf):
    return ledger.compact(ledger.replay(B.ledger(spark, sf)), 1_706_745_600)


@query(
    "w16_level_signals",
    f"""WITH {B.CAP} SELECT event_id, cls NOT IN ('view','click') AS state_left_idle, s1>0.55e0 AS signal FROM cap WHERE cls NOT IN ('view','click') OR s1>0.55e0""",
)
def level_signals(spark, sf):
    state = F.when(F.col("cls") == "view", "idle").when(F.col("cls") == "click", "LISTEN").otherwise(F.col("cls"))
    c = B.captures(spark, sf).withColumn("state", state)
    return windows.level_signals(c, "state", "s1").select("event_id", "state_left_idle", "signal")


@query(
    "w17_drop_accounting",
    f"""WITH {B.CAP} SELECT event_id, CAST(sum(CASE WHEN k>80 THEN k ELSE 0 END) OVER w AS BIGINT) AS lost_total, count(*) FILTER (WHERE k>80) OVER w AS loss_events FROM cap
      WINDOW w AS (PARTITION BY device_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)""",
)
def drop_accounting(spark, sf):
    c = B.captures(spark, sf).withColumn("lost", F.when(F.col("k") > 80, F.col("k")).otherwise(0))
    return windows.drop_accounting(c, ["device_id"], ["t_us", "event_id"], "lost").select("event_id", "lost_total", "loss_events")


@query(
    "w18_boot_lineage",
    f"""WITH {B.CAP}, b AS (SELECT device_id, day AS boot, arg_max(cls, t_us) AS last_stage FROM cap GROUP BY 1,2), g AS (SELECT device_id, arg_min(day, t_us) AS generation_id FROM cap GROUP BY 1)
      SELECT b.*, lag(last_stage) OVER (PARTITION BY device_id ORDER BY boot) AS prev_stage, generation_id FROM b JOIN g USING (device_id)""",
)
def boot_lineage(spark, sf):
    c = B.captures(spark, sf).withColumn("generation_id", F.col("day")).withColumnRenamed("day", "boot")
    return windows.boot_lineage(c, "device_id", "boot", ["t_us", "event_id"], "cls", "generation_id")


@query(
    "a18_trailing_p95",
    f"""WITH {B.CAP}, h AS (SELECT event_id, list_sort(list(k) OVER (PARTITION BY device_id ORDER BY t_us, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS xs FROM cap)
      SELECT event_id, xs[len(xs)*95//100+1] AS p95 FROM h""",
)
def trailing_p95(spark, sf):
    return windows.trailing_p95(B.captures(spark, sf), ["device_id"], ["t_us", "event_id"], "k").select("event_id", "p95")


@query(
    "l01_manifest_page",
    f"""WITH {B.LEDGER}, {B.STATE}, m AS (SELECT path, size, mtime FROM state WHERE mtime > 1705000000), p AS (SELECT *, row_number() OVER (ORDER BY mtime, path) AS rn, count(*) OVER () AS n FROM m),
      q AS (SELECT * FROM p WHERE rn<=500)
      SELECT path, size, mtime, n>500 AS truncated, CASE WHEN n>500 THEN max(mtime) OVER () END AS next_since FROM q""",
)
def manifest_page(spark, sf):
    page = ledger.manifest_page(ledger.replay(B.ledger(spark, sf)), 1_705_000_000)
    return page.select("path", "size", "mtime", "truncated", "next_since")


@query(
    "l01_keyset_page",
    f"""WITH {B.REMOTE} SELECT path, mtime, size FROM remote WHERE mtime > 800000000 OR (mtime = 800000000 AND path > 'x') ORDER BY mtime, path LIMIT 2000""",
)
def keyset_page(spark, sf):
    return ledger.keyset_page(B.remote(spark, sf), (800_000_000, "x"), 2000).select("path", "mtime", "size")


@query(
    "l02_keep_newest",
    f"""WITH {B.CAP}, r AS (SELECT event_id, hour%3 AS device, row_number() OVER (PARTITION BY hour%3 ORDER BY t_us DESC, event_id DESC) AS rn FROM cap)
      SELECT event_id, device FROM r WHERE rn>500""",
)
def keep_newest(spark, sf):
    c = B.captures(spark, sf).select("event_id", "t_us", (F.col("hour") % 3).alias("device"))
    return windows.newest(c, ["device"], ["t_us", "event_id"], 500, drop=True).select("event_id", "device")


@query(
    "l03_expired_day_logs",
    """SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), date '2024-01-31') AS INTEGER) AS age_days FROM events
      WHERE event_id%7 IN (0,1) AND date_diff('day', CAST(ts AS DATE), date '2024-01-31') > 14""",
)
def expired_day_logs(spark, sf):
    from soundledger.plans.scalar_queries import _logs

    logs = _logs(spark, sf).filter(X.is_day_log(F.col("name"))).withColumn("day", X.log_day(F.col("name")))
    return ledger.expired_day_logs(logs, F.lit("2024-01-31").cast("date")).select("event_id", "age_days")


@query("l04_drift_sample", "SELECT doc_id, sha256(text) AS sha FROM documents ORDER BY url_key LIMIT 5".replace("url_key", "lang, doc_id"))
def drift_sample(spark, sf):
    first = table(spark, sf, "documents").select("lang", "doc_id", "text").orderBy("lang", "doc_id").limit(5)
    return first.select("doc_id", X.sha256_hex(F.encode("text", "UTF-8")).alias("sha"))


@query(
    "l07_ack_batches",
    f"""WITH {B.LEDGER}, p AS (SELECT DISTINCT path FROM ledger) SELECT path, (row_number() OVER (ORDER BY path) - 1)//100 AS batch FROM p""",
)
def ack_batches(spark, sf):
    return ledger.ack_batches(B.ledger(spark, sf).select("path").distinct())


@query(
    "l08_latest_per_stream",
    f"""WITH {B.CAP}, r AS (SELECT event_id, device_id, row_number() OVER (PARTITION BY device_id ORDER BY t_us DESC, event_id DESC) AS rn FROM cap)
      SELECT event_id, device_id, rn AS age_rank FROM r WHERE rn<=30""",
)
def latest_per_stream(spark, sf):
    c = B.captures(spark, sf).select("event_id", "t_us", "device_id")
    return windows.newest(c, ["device_id"], ["t_us", "event_id"], 30).select("event_id", "device_id", "age_rank")
