"""Queries for joins: by key, nearest time, range, interval, plans and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.operators import folds, joins, ledger
from soundledger.plans import bindings as B
from soundledger.plans.registry import query
from soundledger.sources.readers import content_tail
from soundledger.sources.tables import table

DAY = 86_400_000_000


@query(
    "j01_nearest_trigger",
    f"""WITH {B.CAP}, p AS (SELECT c.event_id, t.event_id AS line, t.rms AS trigger_rms, abs(t.t_us-c.t_us) AS d,
      row_number() OVER (PARTITION BY c.event_id ORDER BY abs(t.t_us-c.t_us), t.event_id) AS rn
      FROM cap c JOIN cap t ON c.device_id=t.device_id AND t.cls='signup' AND abs(t.t_us-c.t_us)<=86400000000 WHERE c.cls='purchase')
     SELECT c.event_id, p.line AS trigger_line, round(p.trigger_rms,6) AS trigger_rms, round(p.d/1e6,3) AS match_delta_s
     FROM cap c LEFT JOIN p ON p.event_id=c.event_id AND p.rn=1 WHERE c.cls='purchase'""",
)
def nearest_trigger(spark, sf):
    c = B.captures(spark, sf)
    caps = c.filter("cls = 'purchase'").select("device_id", "t_us", "event_id")
    trig = c.filter("cls = 'signup'").select("device_id", "t_us", F.col("event_id").alias("trigger_line"), F.col("rms").alias("trigger_rms"))
    out = joins.nearest(caps, trig, ["device_id"], "t_us", "trigger_line", ["trigger_rms"], DAY)
    return out.select("event_id", "trigger_line", F.round("trigger_rms", 6).alias("trigger_rms"), "match_delta_s")


@query(
    "j02_same_moment_trigger",
    f"""WITH {B.CAP}, t AS (SELECT session_id, hour, arg_max(event_id, event_id) AS line, arg_max(rms, event_id) AS rms FROM cap WHERE cls='signup' GROUP BY 1,2)
      SELECT c.event_id, t.line, round(t.rms,6) AS trigger_rms FROM cap c LEFT JOIN t USING (session_id, hour) WHERE c.cls='purchase'""",
)
def same_moment_trigger(spark, sf):
    c = B.captures(spark, sf)
    trig = c.filter("cls = 'signup'").select("session_id", "hour", F.col("event_id").alias("line"), F.col("rms").alias("trigger_rms"))
    caps = c.filter("cls = 'purchase'").select("event_id", "session_id", "hour")
    out = joins.last_by_key(caps, trig, ["session_id", "hour"], "line", ["line", "trigger_rms"])
    return out.select("event_id", "line", F.round("trigger_rms", 6).alias("trigger_rms"))


@query(
    "j03_features_with_scores",
    f"""WITH {B.FRAMES}, feat AS (SELECT file, max(list_max(vec)) AS peak FROM frames GROUP BY file),
      sc AS (SELECT file, max(vec[21]) AS best FROM frames WHERE label<5 GROUP BY file)
      SELECT f.file, round(f.peak,6) AS peak, round(coalesce(s.best,0e0),6)+0e0 AS best FROM feat f LEFT JOIN sc s ON f.file=s.file""",
)
def features_with_scores(spark, sf):
    f = B.frames(spark, sf)
    feat = f.groupBy("file").agg(F.max(F.array_max("vec")).alias("peak"))
    sc = f.filter("label < 5").groupBy("file").agg(F.max(F.get("vec", F.lit(20))).alias("best"))
    return feat.join(sc, "file", "left").select("file", F.round("peak", 6).alias("peak"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


@query(
    "j04_segments_with_frames",
    f"""WITH {B.FRAMES} SELECT a.file, a.seg_idx, round(a.vec[1],6)+0e0 AS feature, round(b.vec[2],6)+0e0 AS score FROM frames a
      LEFT JOIN frames b ON a.file=b.file AND a.seg_idx=b.seg_idx AND b.label%3<>0""",
)
def segments_with_frames(spark, sf):
    f = B.frames(spark, sf)
    left = f.select("file", "seg_idx", F.round(F.get("vec", F.lit(0)), 6).alias("feature"))
    right = f.filter("label % 3 <> 0").select("file", "seg_idx", F.round(F.get("vec", F.lit(1)), 6).alias("score"))
    return left.join(right, ["file", "seg_idx"], "left")


@query(
    "j05_replay_with_oracle",
    f"""WITH {B.FRAMES}, r AS (SELECT file, seg_idx, CAST(greatest(-128e0, least(127e0, round_even(vec[1]/0.01e0-5,0))) AS BIGINT) AS raw FROM frames),
      o AS (SELECT file, seg_idx, vec[1] AS fp FROM frames WHERE label<>3)
      SELECT r.file, r.seg_idx, r.raw, round(0.01e0*(r.raw+5),5)+0e0 AS dequant, round(1e0/(1e0+exp(-0.01e0*(r.raw+5))),5) AS sig, round(o.fp,5)+0e0 AS oracle
      FROM r LEFT JOIN o USING (file, seg_idx)""",
)
def replay_with_oracle(spark, sf):
    f = B.frames(spark, sf)
    raw = f.select("file", "seg_idx", F.get(S.quantise(F.col("vec"), 0.01, -5), F.lit(0)).cast("bigint").alias("raw"))
    dq = F.lit(0.01) * (F.col("raw") + 5)
    oracle = f.filter("label <> 3").select("file", "seg_idx", F.round(F.get("vec", F.lit(0)), 5).alias("oracle"))
    rows = raw.select("*", F.round(dq, 5).alias("dequant"), F.round(S.sigmoid(dq), 5).alias("sig"))
    return rows.join(oracle, ["file", "seg_idx"], "left")


@query(
    "j06_temporal_neighbours",
    f"""WITH {B.CAP}, r AS (SELECT hour % 4 AS device, event_id, CASE WHEN event_id%50=0 THEN NULL ELSE t_s END AS t_s, s1>=0.5e0 AS high FROM cap)
      SELECT event_id, CASE WHEN t_s IS NULL THEN 0 ELSE count(*) OVER w - 1 END AS neighbours,
       CASE WHEN t_s IS NULL THEN 0 ELSE count(*) FILTER (WHERE high) OVER w - CASE WHEN high THEN 1 ELSE 0 END END AS high_neighbours FROM r
      WINDOW w AS (PARTITION BY device ORDER BY t_s RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING)""",
)
def temporal_neighbours(spark, sf):
    c = B.captures(spark, sf).select(
        (F.col("hour") % 4).alias("device"), "event_id", F.when(F.col("event_id") % 50 != 0, F.col("t_s")).alias("t_s"), "s1"
    )
    out = joins.temporal_neighbours(c, ["device"], "t_s", F.col("s1") >= 0.5, window_s=1800)
    return out.select("event_id", "neighbours", "high_neighbours")


@query(
    "j07_class_names",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)
def class_names(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    out = joins.lookup(joins.lookup(c, n, "c_nationkey", how="inner"), r, "r_regionkey", how="inner")
    return out.select("c_custkey", "n_name", "r_name")


def _plan_sql(verify: bool) -> str:
    check = "WHEN m.sha256<>r.sha256 THEN 'verify sha mismatch'" if verify else ""
    return f"""WITH {B.REMOTE}, {B.MIRROR}, j AS (SELECT r.path, r.size, r.sha256, r.mutable,
       CASE r.category WHEN 'wav' THEN 'wavs' WHEN 'infer_log' THEN 'infer' ELSE 'misc' END || '/' || CAST(r.o_orderkey AS VARCHAR) || '.wav' AS local FROM remote r),
      p AS (SELECT r.path, CASE WHEN m.path IS NULL THEN 'missing' WHEN r.mutable THEN 'mutable' WHEN r.sha256='' THEN 'no remote sha'
       WHEN m.size<>r.size THEN 'size mismatch' {check} ELSE '{"verified" if verify else "present"}' END AS reason FROM j r LEFT JOIN mirror m ON m.path=r.local)
      SELECT path, reason, CASE WHEN reason='missing' THEN 'fetch' WHEN reason IN ('verified','present') THEN 'skip' ELSE 'refetch' END AS action FROM p"""


@query("j08_sync_plan", _plan_sql(False))
def sync_plan(spark, sf):
    return joins.sync_plan(B.remote(spark, sf), B.mirror(spark, sf)).select("path", "action", "reason")


@query("j08_sync_plan_verify", _plan_sql(True))
def sync_plan_verify(spark, sf):
    return joins.sync_plan(B.remote(spark, sf), B.mirror(spark, sf), verify=True).select("path", "action", "reason")


ACKS = """acks AS (SELECT 'f' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id%9 AS VARCHAR) AS path, event_id,
   CASE event_id%3 WHEN 0 THEN '' ELSE CAST(event_id%97 AS VARCHAR) END AS sha256 FROM events WHERE event_type='click')"""


def _acks(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'click'")
    sha = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 97).cast("string"))
    return e.select(F.concat(F.lit("f"), "user_id", F.lit("-"), F.col("event_id") % 9).alias("path"), "event_id", sha.alias("sha256"))


@query(
    "j09_match_acks",
    f"""WITH {B.LEDGER}, {B.STATE}, {ACKS} SELECT a.event_id, a.path, s.path IS NOT NULL AND (a.sha256='' OR a.sha256=s.sha256) AS accepted
      FROM acks a LEFT JOIN state s ON a.path=s.path""",
)
def match_acks(spark, sf):
    out = joins.match_acks(_acks(spark, sf), ledger.replay(B.ledger(spark, sf)))
    return out.select("event_id", "path", "accepted")


@query(
    "j10_still_pending",
    f"""WITH {B.LEDGER}, {B.STATE}, {ACKS} SELECT path, size FROM state WHERE sync_state='pending' AND path NOT IN (SELECT path FROM acks)""",
)
def still_pending(spark, sf):
    pending = ledger.replay(B.ledger(spark, sf)).filter("sync_state = 'pending'")
    return joins.still_pending(pending, _acks(spark, sf)).select("path", "size")


@query(
    "j11_check_copies",
    f"""WITH {B.REMOTE}, m AS (SELECT o_orderkey AS k, size, sha256 FROM remote),
     f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%7=0 THEN size+1 ELSE size END AS size, CASE WHEN o_orderkey%17=0 THEN 'changed' ELSE sha256 END AS sha256 FROM remote WHERE o_orderkey%5<>0)
     SELECT m.k AS name, CASE WHEN f.k IS NULL THEN 'MISSING' WHEN f.size<>m.size THEN 'SIZE' WHEN f.sha256<>m.sha256 THEN 'HASH' ELSE 'OK' END AS status
     FROM m LEFT JOIN f ON m.k=f.k""",
)
def check_copies(spark, sf):
    m = B.remote(spark, sf).select(F.col("o_orderkey").alias("name"), "size", "sha256")
    k = F.col("name")
    found = m.filter(k % 5 != 0).select(
        "name",
        F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(k % 17 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"),
    )
    return joins.check_copies(m, found).select("name", "status")


@query(
    "j12_prune_gate",
    """WITH d AS (SELECT doc_id, text, n_chars, date '2024-01-01' + CAST(doc_id%40 AS INTEGER) AS day FROM documents),
      j AS (SELECT d.doc_id, d.day, CASE WHEN d.doc_id%6=0 THEN 'no_canonical_copy' WHEN d.doc_id%7=0 THEN 'canonical_smaller'
        WHEN right(hex(encode(d.text)),8192) <> right(hex(encode(CASE WHEN d.doc_id%5=0 THEN d.text || '!' ELSE d.text END)), 8192) THEN 'tail_mismatch' ELSE 'verified' END AS reason FROM d WHERE d.day < date '2024-01-24')
      SELECT doc_id AS name, reason, CASE WHEN reason='verified' THEN 'WOULD_DELETE' ELSE 'SKIP' END AS action FROM j""",
)
def prune_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    size = F.octet_length("text")
    tail = lambda c: content_tail(F.encode(c, "UTF-8"), 4096)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int"))
    listing = d.select(k.alias("name"), size.alias("size"), day.alias("day"), tail(F.col("text")).alias("tail"))
    kept = d.filter(k % 6 != 0).select(
        k.alias("name"),
        F.when(k % 7 == 0, size - 1).otherwise(size + 1).alias("size"),
        tail(F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("tail"),
    )
    return joins.prune_gate(listing, kept, F.lit("2024-02-07").cast("date"), 14).select("name", "reason", "action")


GREEDY = """nxt AS (SELECT device, t, min(t) OVER (PARTITION BY device ORDER BY t RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ev),
 chain AS (SELECT device, min(t) AS t FROM ev GROUP BY device UNION ALL SELECT n.device, n.nt FROM chain c JOIN nxt n ON c.device=n.device AND c.t=n.t WHERE n.nt IS NOT NULL)"""


@query(
    "j13_clip_frames",
    f"""WITH RECURSIVE {B.CAP}, ev AS (SELECT hour%4 AS device, t_us AS t FROM cap WHERE cls='signup'), {GREEDY.format(gap=14_400_000_001)}
      SELECT c.device, c.t AS trigger_us, CAST(count(*) AS BIGINT) AS n_frames, min(f.event_id) AS first_frame, max(f.event_id) AS last_frame, round(sum(f.value),4) AS energy
      FROM chain c JOIN cap f ON f.hour%4=c.device AND f.t_us BETWEEN c.t-4800000000 AND c.t+14400000000 GROUP BY 1,2""",
)
def clip_frames(spark, sf):
    c = B.captures(spark, sf).withColumn("device", F.col("hour") % 4)
    trig = folds.space_out(c.filter("cls = 'signup'"), ["device"], "t_us", "event_id", 14_400_000_001)
    frames = c.select("device", "t_us", "event_id", "value")
    clips = joins.clip_frames(frames, trig, ["device"], "t_us", 4_800_000_000, 14_400_000_000)
    return clips.groupBy("device", "trigger_us").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("event_id").alias("first_frame"), F.max("event_id").alias("last_frame"),
        F.round(F.sum("value"), 4).alias("energy"),
    )


@query(
    "j14_resolve_source",
    f"""WITH {B.COPIES}, f AS (SELECT name, arg_min(session_id, CASE WHEN session_id='night-000007' THEN 0 WHEN session_id='night-000003' THEN 1 ELSE 2+CAST(right(session_id,6) AS BIGINT) END) AS best FROM copies GROUP BY name)
      SELECT p_partkey, best || '/' || name AS source_path FROM part LEFT JOIN f ON name='cry-' || CAST(p_partkey AS VARCHAR) || '.wav'""",
)
def resolve_source(spark, sf):
    s = F.col("session_id")
    order = F.when(s == "night-000007", 0).when(s == "night-000003", 1).otherwise(F.right(s, F.lit(6)).cast("bigint") + 2)
    files = B.copies(spark, sf).select(F.col("name").alias("file"), F.concat("session_id", F.lit("/"), "name").alias("path"), order.alias("priority"))
    wanted = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("cry-"), "p_partkey", F.lit(".wav")).alias("file"))
    return joins.resolve_source(wanted, files).select("p_partkey", "source_path")


@query(
    "j15_new_files",
    """SELECT event_id, CASE WHEN event_id%4=0 THEN 'x.bin' WHEN event_id%4=1 THEN 'log' || CAST(event_id AS VARCHAR) || '.jsonl' WHEN event_id%4=2 THEN '.h' || CAST(event_id AS VARCHAR) || '.log'
       ELSE 'c' || CAST(event_id AS VARCHAR) || '.wav' END AS name FROM events WHERE event_id%4=1 OR (event_id%4=3 AND event_type<>'view')""",
)
def new_files(spark, sf):
    r, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    name = (
        F.when(r == 0, "x.bin").when(r == 1, F.concat(F.lit("log"), i, F.lit(".jsonl"))).when(r == 2, F.concat(F.lit(".h"), i, F.lit(".log")))
        .otherwise(F.concat(F.lit("c"), i, F.lit(".wav")))
    )
    listing = table(spark, sf, "events").select("event_id", name.alias("name"), "event_type")
    return joins.new_files(listing, listing.filter("event_type = 'view'")).select("event_id", "name")



#: Rows of a task that brings equal pairs together.
PAIR_ROWS = 250_000


@query(
    "u01_union_sessions",
    f"""WITH {B.COPIES}, a AS (SELECT name, session_id FROM copies WHERE l_linenumber<=3), b AS (SELECT name, session_id FROM copies WHERE l_linenumber>2)
      SELECT name, min(session_id) AS session_id, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY name""",
)
def union_sessions(spark, sf):
    c = B.copies(spark, sf)
    both = c.filter("l_linenumber <= 3").select("name", "session_id").unionByName(c.filter("l_linenumber > 2").select("session_id", "name"))
    # Distinct pairs first, in parts of bounded rows whatever the table; sixteen shares a name, so that a name copied everywhere is no task's alone.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), c.count() // PAIR_ROWS + 1)
    shared = both.withColumn("share", F.pmod(F.xxhash64("session_id"), F.lit(16))).repartition(parts, "name", "share")
    pairs = shared.groupBy("name", "share", "session_id").agg(F.lit(1).alias("one"))
    names = pairs.groupBy("name", "share").agg(F.min("session_id").alias("session_id"), F.count("one").alias("sessions"))
    return names.repartition(parts, "name").groupBy("name").agg(F.min("session_id").alias("session_id"), F.sum("sessions").alias("sessions"))


@query("u02_eligible_union", f"WITH {B.CAP}, {B.TIERED} SELECT tier, CAST(count(*) AS BIGINT) AS n FROM tiered WHERE tier='high_pos' OR tier='high_neg' GROUP BY tier")
def eligible_union(spark, sf):
    c = B.captures(spark, sf).select(S.confidence_tier([F.col("s1"), F.col("s2")]).alias("tier"))
    return c.filter(S.is_eligible(F.col("tier"))).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u03_not_acked",
    f"WITH {B.LEDGER} SELECT path FROM ledger WHERE op IN ('register','close') EXCEPT SELECT path FROM ledger WHERE op='ack'",
)
def not_acked(spark, sf):
    led = B.ledger(spark, sf)
    return led.filter("op IN ('register', 'close')").select("path").subtract(led.filter("op = 'ack'").select("path"))


@query(
    "u04_all_hours",
    f"WITH {B.CAP}, {B.TIERED} SELECT hour FROM tiered WHERE tier='high_pos' UNION SELECT hour FROM tiered WHERE tier='high_neg'",
)
def all_hours(spark, sf):
    c = B.captures(spark, sf).select("hour", S.confidence_tier([F.col("s1"), F.col("s2")]).alias("tier"))
    hours = lambda t: c.filter(F.col("tier") == t).select("hour")
    return hours("high_pos").union(hours("high_neg")).distinct()
