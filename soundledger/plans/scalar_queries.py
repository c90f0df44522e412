"""Queries for projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.functions import text as X
from soundledger.plans import bindings as B
from soundledger.plans.registry import query
from soundledger.sources.tables import table

NAME_SQL = """names AS (SELECT event_id, 'cry-' || strftime(ts,'%Y%m%dT%H%M%S') ||
  CASE event_id%4 WHEN 0 THEN '+1000' WHEN 1 THEN '-0530' WHEN 2 THEN '' ELSE '+0000' END ||
  CASE WHEN event_id%9=0 THEN '.mp3' ELSE '.wav' END AS name, ts FROM events)"""


def _names(spark, sf):
    zone = F.element_at(F.array(F.lit("+1000"), F.lit("-0530"), F.lit(""), F.lit("+0000")), (F.col("event_id") % 4 + 1).cast("int"))
    ext = F.when(F.col("event_id") % 9 == 0, ".mp3").otherwise(".wav")
    name = F.concat(F.lit("cry-"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), zone, ext)
    return table(spark, sf, "events").select("event_id", name.alias("name"), "ts")


@query(
    "f01_capture_instant",
    f"""WITH {NAME_SQL} SELECT event_id, CASE WHEN event_id%9=0 OR event_id%4=2 THEN NULL ELSE
      epoch_us(ts)//1000000 - CASE event_id%4 WHEN 0 THEN 36000 WHEN 1 THEN -19800 ELSE 0 END END AS epoch_s FROM names""",
)
def capture_instant(spark, sf):
    return _names(spark, sf).select("event_id", F.unix_seconds(X.capture_instant(F.col("name"))).alias("epoch_s"))


@query(
    "f02_capture_iso",
    f"""WITH {NAME_SQL} SELECT event_id, CASE WHEN event_id%4=2 THEN NULL WHEN event_id%9=0 THEN
       strftime(ts,'%Y-%m-%dT%H:%M:%S') || CASE event_id%4 WHEN 0 THEN '+10:00.mp3' WHEN 1 THEN '-05:30.mp3' ELSE '+00:00.mp3' END
      ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S') || CASE event_id%4 WHEN 0 THEN '+10:00' WHEN 1 THEN '-05:30' ELSE '+00:00' END END AS iso FROM names""",
)
def capture_iso(spark, sf):
    return _names(spark, sf).select("event_id", X.capture_iso(F.col("name")).alias("iso"))


@query(
    "f03_safe_float",
    """SELECT event_id, coalesce(try_cast(CASE event_id%4 WHEN 0 THEN '' WHEN 1 THEN 'junk' WHEN 2 THEN CAST(value AS VARCHAR) ELSE NULL END AS DOUBLE), -1e0) AS v,
      try_cast(CASE event_id%4 WHEN 0 THEN '' WHEN 1 THEN 'junk' WHEN 2 THEN CAST(value AS VARCHAR) ELSE NULL END AS DOUBLE) AS raw FROM events""",
)
def safe_float(spark, sf):
    text = (
        F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "junk").when(F.col("event_id") % 4 == 2, F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", S.safe_double(text, -1.0).alias("v"), S.safe_double(text).alias("raw"))


CLASS_SQL = """fs AS (SELECT device_id, day, max(CASE WHEN cls='signup' THEN s1 END) AS cry, max(CASE WHEN cls='purchase' THEN s2 END) AS sob,
  max(CASE WHEN cls='error' THEN s1 END) AS scream, max(CASE WHEN cls='click' THEN s2 END) AS speech, max(CASE WHEN cls='view' THEN s1*1.5e0 END) AS child
  FROM cap GROUP BY 1,2)"""


def _class_scores(spark, sf):
    c = B.captures(spark, sf)
    pick = lambda cls, col: F.max(F.when(F.col("cls") == cls, col))
    return c.groupBy("device_id", "day").agg(
        pick("signup", F.col("s1")).alias("cry"),
        pick("purchase", F.col("s2")).alias("sob"),
        pick("error", F.col("s1")).alias("scream"),
        pick("click", F.col("s2")).alias("speech"),
        pick("view", F.col("s1") * 1.5).alias("child"),
    )


@query(
    "f04_group_scores",
    f"""WITH {B.CAP}, {CLASS_SQL}, p AS (SELECT device_id, day, greatest(0e0, coalesce(cry,0), coalesce(sob,0), coalesce(scream,0)) AS pos_max,
      greatest(0e0, coalesce(speech,0), coalesce(child,0)) AS neg_max FROM fs)
      SELECT device_id, day, round(pos_max,6) AS pos_max, round(neg_max,6) AS neg_max, round(least(1e0,pos_max),6) AS pos_score,
      round(least(1e0,neg_max),6) AS neg_score, round(pos_max-neg_max,6)+0e0 AS purity FROM p""",
)
def group_scores(spark, sf):
    cols = S.group_scores([F.col("cry"), F.col("sob"), F.col("scream")], [F.col("speech"), F.col("child")])
    return _class_scores(spark, sf).select("device_id", "day", *[F.round(c, 6).alias(n) for n, c in cols.items()])


NOTED = f"noted AS (SELECT *, {B.NOTE} AS note FROM tiered)"
LABEL_SQL = """CASE WHEN note='' THEN '' WHEN note LIKE 'auto-rms-%' THEN 'auto'
  WHEN regexp_matches(note, '^Cry[0-9]*$') OR note='Morning%20cry' THEN 'cry' WHEN note='Bedroom-quiet' THEN 'not_cry'
  WHEN note='test-get-alias' THEN 'test' ELSE '' END"""


def _noted(spark, sf):
    c = B.captures(spark, sf).withColumn("tier", S.confidence_tier([F.col("s1"), F.col("s2")]))
    return c.withColumn("note", B.note())


@query(
    "f05_note_label",
    f"""WITH {B.CAP}, {B.TIERED}, {NOTED} SELECT event_id, {LABEL_SQL} AS label,
      CASE WHEN note LIKE 'auto-rms-%' THEN note ELSE replace(note,'%20',' ') END AS text FROM noted""",
)
def note_label(spark, sf):
    n = F.col("note")
    return _noted(spark, sf).select("event_id", X.note_label(n).alias("label"), X.note_text(n).alias("text"))


MEAN3 = "((s1+s2+coalesce(s3,0e0))/(CASE WHEN s3 IS NULL THEN 2 ELSE 3 END))"
SPREAD3 = "(greatest(s1,s2,s3)-least(s1,s2,s3))"


@query(
    "f06_confidence_tier",
    f"""WITH {B.CAP} SELECT event_id, {B.TIER_EXPR.format(spread=SPREAD3, mean=MEAN3)} AS tier,
      round({MEAN3},6) AS consensus, round({SPREAD3},6) AS spread FROM cap""",
)
def confidence_tier(spark, sf):
    three = [F.col("s1"), F.col("s2"), F.col("s3")]
    return B.captures(spark, sf).select(
        "event_id",
        S.confidence_tier(three).alias("tier"),
        F.round(S.score_consensus(three), 6).alias("consensus"),
        F.round(S.score_spread(three), 6).alias("spread"),
    )


@query(
    "f07_note_agreement",
    f"""WITH {B.CAP}, {B.TIERED}, {NOTED}, l AS (SELECT *, {LABEL_SQL} AS label FROM noted)
      SELECT event_id, CASE WHEN label IN ('cry','not_cry') AND s3 IS NOT NULL THEN (label='cry') = (tier IN ('high_pos','medium_pos')) END AS agrees FROM l""",
)
def note_agreement(spark, sf):
    n = _noted(spark, sf)
    return n.select("event_id", S.note_agreement(X.note_label(F.col("note")), F.col("tier"), F.col("s3")).alias("agrees"))


@query(
    "f08_quantise",
    f"""WITH {B.FRAMES}, q AS (SELECT file, seg_idx,
       list_transform(vec, lambda x: greatest(-128e0, least(127e0, round_even(x/0.01e0+3, 0)))) AS host,
       list_transform(vec, lambda x: greatest(-128e0, least(127e0, round(x/0.01e0, 0)+3))) AS dev FROM frames)
      SELECT file, seg_idx, CAST(list_sum(host) AS BIGINT) AS host_sum, CAST(list_max(host) AS BIGINT) AS host_max, CAST(list_sum(dev) AS BIGINT) AS dev_sum,
       round(list_sum(list_transform(host, lambda q: (q-3)*0.01e0)),6)+0e0 AS back_sum FROM q""",
)
def quantise(spark, sf):
    f = B.frames(spark, sf).select(
        "file", "seg_idx", S.quantise(F.col("vec"), 0.01, 3).alias("host"), S.quantise(F.col("vec"), 0.01, 3, half_even=False).alias("dev")
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    back = F.aggregate(S.dequantise(F.col("host"), 0.01, 3), F.lit(0.0), lambda acc, x: acc + x)
    return f.select(
        "file", "seg_idx", total("host").alias("host_sum"), F.array_max("host").cast("bigint").alias("host_max"),
        total("dev").alias("dev_sum"), F.round(back, 6).alias("back_sum"),
    )


@query(
    "f09_sigmoid_softmax",
    f"""WITH {B.FRAMES}, m AS (SELECT file, seg_idx, vec, list_max(vec) AS top FROM frames)
      SELECT file, seg_idx, round(1e0/(1e0+exp(-vec[1])),6) AS sig,
       round((exp(vec[20]-top)+exp(vec[21]-top))/list_sum(list_transform(vec, lambda x: exp(x-top))),6) AS cry_mass FROM m""",
)
def sigmoid_softmax(spark, sf):
    v = F.col("vec")
    return B.frames(spark, sf).select(
        "file", "seg_idx", F.round(S.sigmoid(F.get(v, F.lit(0))), 6).alias("sig"), F.round(S.softmax_mass(v, [19, 20]), 6).alias("cry_mass")
    )


@query(
    "f10_mel_scale",
    """SELECT event_id, round(1127e0*ln(1e0+value/700e0),6) AS mel, round(2595e0*log10(1e0+value/700e0),6) AS mel10,
      round(700e0*(exp(value/1127e0)-1e0),6) AS hz, round(700e0*(pow(10e0,value/2595e0)-1e0),6) AS hz10 FROM events""",
)
def mel_scale(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        F.round(S.hz_to_mel(v), 6).alias("mel"),
        F.round(S.hz_to_mel(v, log10_form=True), 6).alias("mel10"),
        F.round(S.mel_to_hz(v), 6).alias("hz"),
        F.round(S.mel_to_hz(v, log10_form=True), 6).alias("hz10"),
    )


ERAS = [("2024-01-10", "first"), ("2024-01-11", "second")]


@query(
    "f11_firmware_era",
    """SELECT event_id, CASE WHEN event_id%10=0 THEN NULL WHEN strftime(ts,'%Y-%m-%d') <= '2024-01-10' THEN 'first'
      WHEN strftime(ts,'%Y-%m-%d') = '2024-01-11' THEN 'second' ELSE 'third' END AS era FROM events""",
)
def firmware_era(spark, sf):
    iso = F.when(F.col("event_id") % 10 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx"))
    return table(spark, sf, "events").select("event_id", X.firmware_era(iso, ERAS, "third").alias("era"))


@query(
    "f12_local_date_hour",
    """SELECT event_id, CASE WHEN event_id%10=0 THEN '?' ELSE strftime(ts,'%Y-%m-%d') END AS local_date,
      CASE WHEN event_id%10=0 THEN NULL ELSE CAST(date_part('hour',ts) AS INTEGER) END AS local_hour FROM events""",
)
def local_date_hour(spark, sf):
    iso = F.when(F.col("event_id") % 10 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+10:00'"))
    return table(spark, sf, "events").select("event_id", X.local_date(iso).alias("local_date"), X.local_hour(iso).alias("local_hour"))


@query("f13_rfc3339", "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS text FROM events")
def rfc3339(spark, sf):
    return table(spark, sf, "events").select("event_id", X.rfc3339(F.col("ts")).alias("text"))


@query(
    "f14_mirror_path",
    f"""WITH {B.REMOTE} SELECT path, CASE category WHEN 'wav' THEN 'wavs' WHEN 'infer_log' THEN 'infer' ELSE 'misc' END || '/' || CAST(o_orderkey AS VARCHAR) || '.wav' AS local FROM remote""",
)
def mirror_path(spark, sf):
    return B.remote(spark, sf).select("path", X.mirror_path(F.col("path"), F.col("category")).alias("local"))


LOGS = """logs AS (SELECT event_id, CASE event_id%7 WHEN 0 THEN 'infer-' || strftime(ts,'%Y%m%d') || '.jsonl' WHEN 1 THEN 'cry-' || strftime(ts,'%Y%m%d') || '.log'
   WHEN 2 THEN 'infer-boot.jsonl' WHEN 3 THEN 'CRY-' || lpad(CAST(event_id%10000 AS VARCHAR),4,'0') || '.LOG' WHEN 4 THEN 'cry-' || strftime(ts,'%Y%m%d') || '.wav'
   WHEN 5 THEN 'infer-19991301.jsonl' ELSE '.hidden' END AS name, ts FROM events)"""


def _logs(spark, sf):
    r = F.col("event_id") % 7
    day = F.date_format("ts", "yyyyMMdd")
    name = (
        F.when(r == 0, F.concat(F.lit("infer-"), day, F.lit(".jsonl")))
        .when(r == 1, F.concat(F.lit("cry-"), day, F.lit(".log")))
        .when(r == 2, "infer-boot.jsonl")
        .when(r == 3, F.concat(F.lit("CRY-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit(".LOG")))
        .when(r == 4, F.concat(F.lit("cry-"), day, F.lit(".wav")))
        .when(r == 5, "infer-19991301.jsonl")
        .otherwise(".hidden")
    )
    return table(spark, sf, "events").select("event_id", name.alias("name"), "ts")


@query("f15_log_names", f"WITH {LOGS} SELECT event_id, event_id%7 IN (0,1,2,3,5) AS known, event_id%7 IN (0,1,5) AS day_log FROM logs")
def log_names(spark, sf):
    n = F.col("name")
    return _logs(spark, sf).select("event_id", X.is_known_log(n).alias("known"), X.is_day_log(n).alias("day_log"))


@query(
    "f16_log_day",
    f"WITH {LOGS} SELECT event_id, CASE WHEN event_id%7 IN (0,1,4) THEN CAST(epoch_us(ts)//86400000000 AS INTEGER) END AS ordinal FROM logs",
)
def log_day(spark, sf):
    return _logs(spark, sf).select("event_id", X.day_ordinal(X.log_day(F.col("name"))).alias("ordinal"))


@query(
    "f17_safe_path",
    """SELECT doc_id, regexp_matches(p, '^(/sdcard|/logs|/yamnet)(/|$)') AND NOT contains(p,'..') AND NOT contains(p, chr(92)) AS safe FROM
      (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN '/sdcard/' WHEN 1 THEN '/logs' WHEN 2 THEN '/etc/' ELSE '/yamnet/' END || replace(text, chr(10), ' ') AS p FROM documents)""",
)
def safe_path(spark, sf):
    r = F.col("doc_id") % 4
    root = F.when(r == 0, "/sdcard/").when(r == 1, "/logs").when(r == 2, "/etc/").otherwise("/yamnet/")
    p = F.concat(root, F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf, "documents").select("doc_id", X.is_safe_path(p).alias("safe"))


@query(
    "f18_percent_decode",
    f"""WITH {B.CAP}, {B.TIERED}, {NOTED} SELECT event_id, replace(note,'%20',' ') || CASE WHEN event_id%6=0 THEN '%zz' ELSE '' END AS decoded FROM noted""",
)
def percent_decode(spark, sf):
    bad = F.when(F.col("event_id") % 6 == 0, F.concat("note", F.lit("%zz"))).otherwise(F.col("note"))
    return _noted(spark, sf).select("event_id", X.percent_decode(bad).alias("decoded"))


@query("f19_sha256", "SELECT doc_id, sha256(text) AS sha, left(sha256(text),12) AS short FROM documents")
def sha256(spark, sf):
    body = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select("doc_id", X.sha256_hex(body).alias("sha"), X.sha256_hex(body, 12).alias("short"))


@query(
    "f20_state_name",
    """SELECT event_id, CASE event_id%8 WHEN 0 THEN 'boot' WHEN 1 THEN 'connecting' WHEN 2 THEN 'syncing' WHEN 3 THEN 'idle' WHEN 4 THEN 'crying'
      WHEN 5 THEN 'error' ELSE 'unknown' END AS state FROM events""",
)
def state_name(spark, sf):
    return table(spark, sf, "events").select("event_id", S.state_name(F.col("event_id") % 8).alias("state"))


@query(
    "f21_watched_names",
    f"""WITH {B.FRAMES}, names(pos, name) AS (VALUES {", ".join(f"({i + 1},'{n}')" for i, n in enumerate(S.WATCHED_NAMES))})
      SELECT file, seg_idx, name, round(vec[pos],6)+0e0 AS conf FROM frames, names""",
)
def watched_names(spark, sf):
    pairs = B.frames(spark, sf).select("file", "seg_idx", F.explode(S.watched_map(F.col("vec"))).alias("name", "conf"))
    return pairs.withColumn("conf", F.round("conf", 6))


@query(
    "f22_json_fields",
    """SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE event_type END AS op, CASE WHEN length(event_type)<6 THEN event_type END AS short_op,
      CAST(floor(value) AS BIGINT) AS size FROM events""",
)
def json_fields(spark, sf):
    key = F.when(F.col("event_id") % 5 == 0, '{"xop":"').otherwise('{"op": "')
    line = F.concat(key, "event_type", F.lit('","kind":"'), "event_type", F.lit('","size":'), F.floor("value"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", line.alias("line")).select(
        "event_id",
        X.json_text(F.col("line"), "op", 16).alias("op"),
        X.json_text(F.col("line"), "kind", 6).alias("short_op"),
        X.json_unsigned(F.col("line"), "size").alias("size"),
    )


@query("f23_rounding", "SELECT event_id, round(value*1.37e0,1) AS hz, round_even(value/7e0,4) AS frac FROM events")
def rounding(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(F.col("value") * 1.37, 1).alias("hz"), F.bround(F.col("value") / 7.0, 4).alias("frac")
    )


@query(
    "f24_auto_note",
    """SELECT event_id, 'auto-rms-' || CAST(CAST(round_even(value/3e0,0) AS BIGINT) AS VARCHAR) || 'x-rms' || CAST(CAST(round_even(value*10e0,0) AS BIGINT) AS VARCHAR) AS note,
      CAST(round_even(value/3e0,0) AS BIGINT) AS ratio, CAST(round_even(value*10e0,0) AS BIGINT) AS rms FROM events""",
)
def auto_note(spark, sf):
    n = X.auto_note(F.col("value") / 3.0, F.col("value") * 10.0)
    e = table(spark, sf, "events").select("event_id", n.alias("note"))
    return e.select("*", X.auto_note_ratio(F.col("note")).alias("ratio"), X.auto_note_rms(F.col("note")).alias("rms"))


@query(
    "f25_resume_offset",
    f"""WITH {B.REMOTE} SELECT path, CASE WHEN o_custkey*400 > size THEN 0 ELSE o_custkey*400 END AS start FROM remote""",
)
def resume_offset(spark, sf):
    return B.remote(spark, sf).select("path", X.resume_offset(F.col("o_custkey") * 400, F.col("size")).alias("start"))


@query("f26_eligible", f"WITH {B.CAP}, {B.TIERED} SELECT event_id, tier FROM tiered WHERE tier IN ('high_pos','high_neg')")
def eligible(spark, sf):
    c = B.captures(spark, sf).withColumn("tier", S.confidence_tier([F.col("s1"), F.col("s2")]))
    return c.filter(S.is_eligible(F.col("tier"))).select("event_id", "tier")


@query(
    "f27_speech_negatives",
    f"""WITH {B.CAP}, {B.TIERED} SELECT day, CAST(count(*) FILTER (WHERE tier='high_neg' AND s2>=0.05e0) AS BIGINT) AS speech,
      CAST(count(*) FILTER (WHERE tier='high_neg' AND s2<0.05e0) AS BIGINT) AS other FROM tiered GROUP BY day""",
)
def speech_negatives(spark, sf):
    c = B.captures(spark, sf).withColumn("tier", S.confidence_tier([F.col("s1"), F.col("s2")]))
    neg = F.col("tier") == "high_neg"
    return c.groupBy("day").agg(F.count_if(neg & (F.col("s2") >= 0.05)).alias("speech"), F.count_if(neg & (F.col("s2") < 0.05)).alias("other"))


@query(
    "f28_training_label",
    f"WITH {B.CAP} SELECT event_id, CASE WHEN s1>=0.5e0 THEN 1 ELSE 0 END AS y FROM cap WHERE s1>=0.5e0 OR s1<0.1e0",
)
def training_label(spark, sf):
    c = B.captures(spark, sf).select("event_id", S.training_label(F.col("s1")).alias("y"))
    return c.filter(F.col("y").isNotNull())
