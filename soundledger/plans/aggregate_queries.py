"""Queries for profile tables and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.operators import aggregates as A
from soundledger.operators import joins, ledger
from soundledger.plans import bindings as B
from soundledger.plans.join_queries import _plan_sql
from soundledger.plans.registry import query
from soundledger.plans.scalar_queries import LABEL_SQL, NOTED
from soundledger.functions import text as X
from soundledger.sources.tables import table

CLASSES = {i: n for i, n in S.SCORED_CLASSES.items()}
SUB = "CASE WHEN s1>=0.5e0 THEN ['fuss','full_cry','distress','screech'][k//25+1] ELSE '' END"


def tiered(spark, sf):
    c = B.captures(spark, sf).withColumn("tier", S.confidence_tier([F.col("s1"), F.col("s2")]))
    names = F.array(*[F.lit(x) for x in ("fuss", "full_cry", "distress", "screech")])
    sub = F.when(F.col("s1") >= 0.5, F.get(names, F.expr("cast(k div 25 as int)"))).otherwise("")
    return c.withColumn("subtype", sub)


@query(
    "daily_tiers",
    f"""WITH {B.CAP}, n AS (SELECT *, count(*) OVER w - 1 AS neighbours, count(*) FILTER (WHERE s1>=0.5e0) OVER w - CASE WHEN s1>=0.5e0 THEN 1 ELSE 0 END AS high_neighbours
        FROM cap WINDOW w AS (PARTITION BY device_id ORDER BY t_s RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING)),
      tiered AS (SELECT *, {B.TIER2} AS tier FROM n)
      SELECT day, {", ".join(f"CAST(count(*) FILTER (WHERE tier='{t}') AS BIGINT) AS {t}" for t in S.TIERS)}, CAST(count(*) AS BIGINT) AS total,
       CAST(sum(neighbours) AS BIGINT) AS neighbours, CAST(sum(high_neighbours) AS BIGINT) AS high_neighbours FROM tiered GROUP BY day""",
)
def daily_tiers(spark, sf):
    c = tiered(spark, sf).select("device_id", "t_s", "s1", "day", "tier")
    n = joins.temporal_neighbours(c, ["device_id"], "t_s", F.col("s1") >= 0.5, window_s=7200, bucket_s=86_400)
    return n.groupBy("day").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in S.TIERS],
        F.count(F.lit(1)).alias("total"), F.sum("neighbours").alias("neighbours"), F.sum("high_neighbours").alias("high_neighbours"),
    )


@query(
    "a01_class_peaks",
    f"""WITH {B.FRAMES} SELECT file, CAST(count(*) AS BIGINT) AS n_frames, {", ".join(f"round(max(vec[{i + 1}]),6)+0e0 AS max_{n}, round(avg(vec[{i + 1}]),6)+0e0 AS mean_{n}" for i, n in CLASSES.items())}
      FROM frames GROUP BY file""",
)
def class_peaks(spark, sf):
    out = A.class_peaks(B.frames(spark, sf), ["file"], "vec", CLASSES)
    return out.select("file", "n_frames", *[F.round(c, 6).alias(c) for c in out.columns if c[:3] in ("max", "mea")])


@query(
    "a02_histograms",
    f"""WITH {B.CAP}, {B.TIERED}, {NOTED}, l AS (SELECT tier, {SUB} AS subtype, {LABEL_SQL} AS label FROM noted)
      SELECT 'tier' AS "column", tier AS value, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 2 UNION ALL SELECT 'subtype', subtype, count(*) FROM l WHERE subtype<>'' GROUP BY 2
      UNION ALL SELECT 'label', label, count(*) FROM l WHERE label<>'' GROUP BY 2""",
)
def histograms(spark, sf):
    c = tiered(spark, sf).withColumn("label", X.note_label(B.note()))
    return A.histograms(c, ["tier", "subtype", "label"])


COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE tier='{t}') AS BIGINT) AS {t}" for t in S.TIERS)


@query(
    "a03_day_tier_crosstab",
    f"""WITH {B.CAP}, {B.TIERED} SELECT day, {COUNTS}, CAST(count(*) AS BIGINT) AS total FROM tiered GROUP BY day
      UNION ALL SELECT 'TOTAL', {COUNTS}, count(*) FROM tiered""",
)
def day_tier_crosstab(spark, sf):
    return A.tier_crosstab(tiered(spark, sf), "day")


@query(
    "a04_session_summary",
    f"""WITH {B.CAP}, {B.TIERED} SELECT device_id, CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day,
      CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS high_pos, CAST(count(*) FILTER (WHERE tier='high_neg') AS BIGINT) AS high_neg FROM tiered GROUP BY device_id""",
)
def session_summary(spark, sf):
    return A.session_summary(tiered(spark, sf), "device_id", F.col("day"), "tier")


PLAN_SQL = _plan_sql(False)
SUBS = ["fuss", "full_cry", "distress", "screech"]


@query(
    "a05_subtype_by_day",
    f"""WITH {B.CAP}, {B.TIERED}, s AS (SELECT day, {SUB} AS subtype FROM tiered WHERE tier='high_pos')
      SELECT day, {", ".join(f"CAST(count(*) FILTER (WHERE subtype='{x}') AS BIGINT) AS {x}" for x in SUBS)}, CAST(count(*) AS BIGINT) AS total FROM s WHERE subtype<>'' GROUP BY day""",
)
def subtype_by_day(spark, sf):
    pos = tiered(spark, sf).filter("tier = 'high_pos' AND subtype <> ''")
    return A.tier_crosstab(pos, "day", "subtype", SUBS, total=False)


@query(
    "a06_hour_of_day",
    f"""WITH {B.CAP}, {B.TIERED} SELECT hour, CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS high_pos, CAST(count(*) FILTER (WHERE tier='high_neg') AS BIGINT) AS high_neg
      FROM tiered WHERE tier IN ('high_pos','high_neg') GROUP BY hour""",
)
def hour_of_day(spark, sf):
    high = tiered(spark, sf).filter(S.is_eligible(F.col("tier")))
    return A.tier_crosstab(high, "hour", "tier", S.ELIGIBLE_TIERS, total=False).drop("total")


@query(
    "a07_negative_breakdown",
    f"""WITH {B.CAP}, {B.TIERED}, c AS (SELECT CAST(count(*) FILTER (WHERE tier='high_neg' AND s2*10>=0.5e0) AS BIGINT) AS speech, CAST(count(*) FILTER (WHERE tier='high_neg' AND s2*10<0.5e0) AS BIGINT) AS other FROM tiered)
      SELECT speech, other, speech/greatest(speech+other,1) > 0.65e0 AS skewed FROM c""",
)
def negative_breakdown(spark, sf):
    return A.negative_breakdown(tiered(spark, sf), "tier", F.col("s2") * 10)


@query(
    "a08_era_counts",
    """SELECT CASE WHEN strftime(ts,'%Y-%m-%d') <= '2024-01-10' THEN 'first' WHEN strftime(ts,'%Y-%m-%d') = '2024-01-11' THEN 'second' ELSE 'third' END AS era,
      CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""",
)
def era_counts(spark, sf):
    from soundledger.plans.scalar_queries import ERAS

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx")
    return table(spark, sf, "events").groupBy(X.firmware_era(iso, ERAS, "third").alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a09_readiness",
    f"""WITH {B.CAP}, {B.TIERED}, c AS (SELECT CAST(count(*) FILTER (WHERE tier='high_pos') AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE tier='high_neg') AS BIGINT) AS neg,
        count(*) FILTER (WHERE tier='high_pos' AND {SUB}='screech') AS rare FROM tiered)
      SELECT pos+neg AS eligible, pos, neg, 100*pos//greatest(pos+neg,1) AS pos_pct, 100*neg//greatest(pos+neg,1) AS neg_pct, pos+neg<1000 AS too_few, rare<10 AS rare_subtype FROM c""",
)
def readiness(spark, sf):
    return A.readiness(tiered(spark, sf), "tier", "subtype")


@query(
    "a10_first_value",
    """WITH r AS (SELECT event_id, CASE WHEN event_id%5=3 THEN event_type ELSE '' END AS version, CASE WHEN event_id>7 THEN props END AS audited_at FROM events)
      SELECT arg_min(version, event_id) FILTER (WHERE version<>'') AS version, arg_min(audited_at, event_id) FILTER (WHERE audited_at<>'') AS audited_at FROM r""",
)
def first_value(spark, sf):
    r = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 3, F.col("event_type")).otherwise("").alias("version"),
        F.when(F.col("event_id") > 7, F.col("props")).alias("audited_at"),
    )
    return A.first_value(r, ["version", "audited_at"], "event_id")


@query(
    "a11_release_counts",
    """WITH n AS (SELECT event_id, strftime(ts,'%Y%m%d') AS session_id, row_number() OVER (ORDER BY lpad(CAST(event_id AS VARCHAR),12,'0')) - 1 AS pos FROM events)
      SELECT CASE pos%5 WHEN 4 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions FROM n GROUP BY 1""",
)
def release_counts(spark, sf):
    from soundledger.operators import chunks, windows

    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"))
    r = chunks.number_names(e, "name", "pos").withColumn("split", windows.row_split(F.col("pos")))
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


REPLAY = f"""{B.FRAMES}, rep AS (SELECT file, seg_idx, label, CAST(greatest(-128e0, least(127e0, round_even(vec[1]/0.01e0-5,0))) AS BIGINT) AS raw, CASE WHEN label<>3 THEN vec[1] END AS oracle FROM frames),
 dq AS (SELECT *, round(0.01e0*(raw+5),5) AS dequant, round(1e0/(1e0+exp(-0.01e0*(raw+5))),5) AS sig FROM rep)"""


def replay_rows(spark, sf):
    f = B.frames(spark, sf)
    first = F.get("vec", F.lit(0))
    raw = F.get(S.quantise(F.col("vec"), 0.01, -5), F.lit(0)).cast("bigint")
    r = f.select("file", "seg_idx", "label", raw.alias("raw"), F.when(F.col("label") != 3, first).alias("oracle"))
    dq = F.lit(0.01) * (F.col("raw") + 5)
    return r.select("*", F.round(dq, 5).alias("dequant"), F.round(S.sigmoid(dq), 5).alias("sig"))


@query(
    "a12_replay_stats",
    f"""WITH {REPLAY} SELECT file, CAST(count(*) AS BIGINT) AS n, max(raw) AS raw_max, round(avg(raw),6)+0e0 AS raw_mean, round(max(dequant),6)+0e0 AS dequant_max, round(avg(dequant),6)+0e0 AS dequant_mean,
      round(max(sig),6) AS sig_max, round(avg(sig),6) AS sig_mean, round(max(oracle),6)+0e0 AS oracle_max FROM dq GROUP BY file""",
)
def replay_stats(spark, sf):
    r = replay_rows(spark, sf)
    mean = lambda c: F.round(F.avg(c), 6)
    top = lambda c: F.round(F.max(c), 6)
    return r.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw_max"), mean("raw").alias("raw_mean"), top("dequant").alias("dequant_max"),
        mean("dequant").alias("dequant_mean"), top("sig").alias("sig_max"), mean("sig").alias("sig_mean"), top("oracle").alias("oracle_max"),
    )


@query(
    "a13_separation",
    f"""WITH {B.CAP} SELECT cls, min(value) AS lo, quantile_cont(value,0.5) AS med, max(value) AS hi FROM cap GROUP BY cls""",
)
def separation(spark, sf):
    c = B.captures(spark, sf)
    med = A.percentile_columns(c, ["cls"], "value", {"med": 0.5})
    return c.groupBy("cls").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).join(med, "cls")


@query(
    "a14_correlation",
    f"""WITH {REPLAY} SELECT label, CASE WHEN stddev_pop(oracle)>0 AND stddev_pop(raw) FILTER (WHERE oracle IS NOT NULL)>0 THEN round(corr(raw,oracle),6) END AS r_raw,
      CASE WHEN stddev_pop(oracle)>0 THEN round(corr(dequant,oracle),6) END AS r_dequant, CASE WHEN stddev_pop(oracle)>0 THEN round(corr(sig,oracle),6) END AS r_sig FROM dq GROUP BY label""",
)
def correlation(spark, sf):
    r = replay_rows(spark, sf)
    pair = lambda c: F.round(A.correlation(F.when(F.col("oracle").isNotNull(), F.col(c)).cast("double"), F.col("oracle")), 6)
    return r.groupBy("label").agg(pair("raw").alias("r_raw"), pair("dequant").alias("r_dequant"), pair("sig").alias("r_sig"))


@query(
    "a15_threshold_pick",
    f"""WITH {REPLAY}, f AS (SELECT file, min(label) AS label, max(dequant) + CASE WHEN min(label)=0 THEN 1 ELSE 0 END AS peak FROM dq GROUP BY file),
      p AS (SELECT max(peak) FILTER (WHERE label<>0) AS neg_max, min(peak) FILTER (WHERE label=0) AS pos_min FROM f)
      SELECT round(neg_max,6) AS neg_max, round(pos_min,6) AS pos_min, round((neg_max+pos_min)/2,6) AS threshold, CASE WHEN neg_max<pos_min THEN round(pos_min-neg_max,6) END AS margin,
       CASE WHEN neg_max<pos_min THEN 'SAFE' ELSE 'OVERLAP' END AS verdict FROM p""",
)
def threshold_pick(spark, sf):
    f = replay_rows(spark, sf).groupBy("file").agg(F.min("label").alias("label"), F.max("dequant").alias("peak"))
    f = f.withColumn("peak", F.col("peak") + F.when(F.col("label") == 0, 1).otherwise(0))
    out = A.threshold_pick(f, F.col("label") == 0, "peak")
    return out.select(*[F.round(c, 6).alias(c) for c in ("neg_max", "pos_min", "threshold", "margin")], "verdict")


@query(
    "a16_ledger_stats",
    f"""WITH {B.LEDGER}, {B.STATE}, a AS (SELECT CAST(count(*) FILTER (WHERE sync_state='pending') AS BIGINT) AS pending_count, CAST(count(*) FILTER (WHERE sync_state='synced') AS BIGINT) AS synced_count,
       CAST(coalesce(sum(size) FILTER (WHERE sync_state='pending'),0) AS BIGINT) AS bytes_pending, CAST(coalesce(sum(size) FILTER (WHERE sync_state='synced'),0) AS BIGINT) AS bytes_synced,
       coalesce(min(mtime) FILTER (WHERE sync_state='pending'),0) AS oldest_pending_mtime, CAST(count(*) AS BIGINT) AS total_tracked FROM state)
      SELECT *, CASE WHEN oldest_pending_mtime>0 AND 1706745600>oldest_pending_mtime THEN 1706745600-oldest_pending_mtime ELSE 0 END AS oldest_pending_age_s FROM a""",
)
def ledger_stats(spark, sf):
    return ledger.stats(ledger.replay(B.ledger(spark, sf)), F.lit(1_706_745_600).cast("bigint"))


@query(
    "a17_store_status",
    """WITH f AS (SELECT CASE WHEN doc_id%5=0 THEN 'wav' WHEN doc_id%5=1 THEN 'triggers' ELSE 'other' END AS kind, n_chars AS size FROM documents)
      SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(5000000000//1280044 AS BIGINT) AS capacity, false AS low_space FROM f GROUP BY kind""",
)
def store_status(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, "wav").when(F.col("doc_id") % 5 == 1, "triggers").otherwise("other")
    files = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("size"))
    return A.store_status(files, kind, 5_000_000_000, 16_000 * 2 * 40 + 44)


@query(
    "a19_hist_quantile",
    f"""WITH {B.CAP}, lg AS (SELECT device_id, log2(greatest(rms*20,1e0)) AS x FROM cap), b AS (SELECT device_id, CASE WHEN x<5 THEN 0 WHEN x>=14.5 THEN 31 ELSE CAST(floor((x-5e0)*32/9.5e0) AS INTEGER) END AS bin FROM lg),
      g AS (SELECT d.device_id, r.i AS bin, (SELECT count(*) FROM b WHERE b.device_id=d.device_id AND b.bin=r.i) AS n FROM (SELECT DISTINCT device_id FROM b) d, range(32) r(i)),
      c AS (SELECT *, sum(n) OVER (PARTITION BY device_id ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY device_id) AS tot FROM g)
      SELECT device_id, round(pow(2e0,5e0+9.5e0*(min(bin) FILTER (WHERE cum>=floor(tot*0.5e0))+0.5e0)/32),6) AS p50, round(pow(2e0,5e0+9.5e0*(min(bin) FILTER (WHERE cum>=floor(tot*0.95e0))+0.5e0)/32),6) AS p95 FROM c GROUP BY 1""",
)
def hist_quantile(spark, sf):
    h = A.level_histogram(B.captures(spark, sf).withColumn("rms", F.col("rms") * 20), ["device_id"], "rms")
    return h.select("device_id", F.round(A.hist_quantile(F.col("hist"), 0.5), 6).alias("p50"), F.round(A.hist_quantile(F.col("hist"), 0.95), 6).alias("p95"))


@query(
    "a20_canonical_totals",
    f"""WITH {B.COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY size DESC, session_id, l_orderkey, l_linenumber) AS rn FROM copies)
      SELECT CASE WHEN size>=50 THEN 'wav' ELSE 'root_log' END AS kind, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM r WHERE rn=1 GROUP BY 1""",
)
def canonical_totals(spark, sf):
    from soundledger.operators import windows

    best = windows.largest_copy(B.copies(spark, sf), ["name"], "size", ["session_id", "l_orderkey", "l_linenumber"])
    kind = F.when(F.col("size") >= 50, "wav").otherwise("root_log")
    return best.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("a21_plan_counts", f"WITH p AS ({PLAN_SQL}) SELECT action, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY action")
def plan_counts(spark, sf):
    return joins.sync_plan(B.remote(spark, sf), B.mirror(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a22_tier_profile",
    f"""WITH {B.CAP}, {B.TIERED} SELECT tier, CAST(count(*) AS BIGINT) AS n, round(avg(s3),6) AS mean, round(quantile_cont(s3,0.1),6) AS p10, round(quantile_cont(s3,0.9),6) AS p90 FROM tiered GROUP BY tier""",
)
def tier_profile(spark, sf):
    c = tiered(spark, sf)
    base = c.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s3"), 6).alias("mean"))
    p = A.percentile_columns(c, ["tier"], "s3", {"p10": 0.1, "p90": 0.9})
    return base.join(p, "tier", "left").select("tier", "n", "mean", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query(
    "a23_heuristic_rates",
    f"""WITH {B.CAP} SELECT cls, round(avg(CASE WHEN value>60 THEN 1 ELSE 0 END),6) AS loud, round(avg(CASE WHEN s2>0.5e0 THEN 1 ELSE 0 END),6) AS voiced, round(avg(CASE WHEN s3>0.5e0 THEN 1 ELSE 0 END),6) AS scored FROM cap GROUP BY cls""",
)
def heuristic_rates(spark, sf):
    r = A.rates(B.captures(spark, sf), "cls", {"loud": F.col("value") > 60, "voiced": F.col("s2") > 0.5, "scored": F.col("s3") > 0.5})
    return r.select("cls", *[F.round(c, 6).alias(c) for c in ("loud", "voiced", "scored")])
