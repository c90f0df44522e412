"""Queries for trained scores, the label table and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.operators import audio, labels, models
from soundledger.plans import bindings as B
from soundledger.plans.audio_queries import linear_scorer
from soundledger.plans.registry import query
from soundledger.session import scratch_path
from soundledger.sources.tables import table


def feature_rows(spark, sf):
    """Captures with ten numeric features, some of them missing."""
    c = B.captures(spark, sf)
    i = F.col("event_id")
    cols = [
        F.sqrt("value"), F.col("k").cast("double"), F.col("hour").cast("double"), (i % 97).cast("double"), F.when(i % 31 != 0, F.ln(F.col("value") + 1)),
        (i % 13).cast("double"), F.col("s2") * F.col("s1"), (F.col("device_id") % 7).cast("double"), F.col("s2") * F.col("s2"), F.sin(F.col("value")),
    ]
    named = [c.cast("double").alias(n) for n, c in zip(models.CLASSIFIER_FEATURES, cols)]
    rows = c.select("*", *named).withColumn("label", S.training_label(F.col("s1")))
    return rows.withColumn("x", models.feature_array(models.CLASSIFIER_FEATURES))


def cluster_rows(spark, sf):
    """Captures with the eleven features that sub-types are told apart by, some of them missing."""
    c = B.captures(spark, sf)
    i = F.col("event_id")
    pitch = 200.0 + F.col("value") * 3
    cols = [
        F.col("s2"), pitch, (i % 53).cast("double"), F.when(i % 31 != 0, pitch + i % 17), pitch * 1.5, F.col("k").cast("double"), F.sin(F.col("value")), F.col("s1") * F.col("s2"),
        (i % 13).cast("double"), F.sqrt("value"), F.col("hour").cast("double"),
    ]
    return c.select("*", *[x.cast("double").alias(n) for n, x in zip(models.CLUSTER_FEATURES, cols)]).withColumn("x", models.feature_array(models.CLUSTER_FEATURES))


@query("m01_feature_classifier")
def feature_classifier(spark, sf):
    """Weights of the balanced logistic regression, one row per feature."""
    model = models.fit_logistic(feature_rows(spark, sf), "x", "label")
    rows = [(model.rows, float(model.intercept), n, float(w)) for n, w in zip(models.CLASSIFIER_FEATURES, model.weights)]
    return spark.createDataFrame(rows, "train_n BIGINT, intercept DOUBLE, feature STRING, weight DOUBLE")


@query("m02_feature_score")
def feature_score(spark, sf):
    """Probability for every capture with complete features, null for the others."""
    f = feature_rows(spark, sf)
    model = models.fit_logistic(f, "x", "label")
    return f.select("event_id", "label", model.probability(F.col("x")).alias("prob"))


#: Weights, means and deviations that stand for a trained score, so that its application has a SQL twin.
GIVEN = [(0.2, 5.0, 3.0), (-0.01, 50.0, 30.0), (0.05, 12.0, 6.0), (0.3, 48.0, 28.0), (0.4, 3.0, 1.0), (-0.2, 6.0, 4.0), (0.7, 0.1, 0.2), (0.1, 3.0, 2.0), (-0.5, 0.3, 0.3), (0.25, 0.0, 0.7)]
FEATURES_SQL = "sqrt(value), k, hour, event_id%97, CASE WHEN event_id%31<>0 THEN ln(value+1) END, event_id%13, s2*s1, device_id%7, s2*s2, sin(value)"


def given_sql() -> str:
    terms = [f"{w / d!r}::DOUBLE*(x[{i}]-{m!r}::DOUBLE)" for i, (w, m, d) in enumerate(GIVEN, 1)]
    return f"WITH {B.CAP}, f AS (SELECT event_id, [{FEATURES_SQL}]::DOUBLE[] AS x FROM cap) SELECT event_id, round(1/(1+exp(-(-0.4::DOUBLE+{'+'.join(terms)}))),6) AS prob FROM f"


@query("m02_given_weights", given_sql())
def given_weights(spark, sf):
    """Probabilities under given weights; null where a feature is missing."""
    w, mean, std = zip(*GIVEN)
    model = models.LogisticScore(models.Scaling(mean, std), w, -0.4, 0)
    return feature_rows(spark, sf).select("event_id", F.round(model.probability(F.col("x")), 6).alias("prob"))


@query(
    "m04_given_weights",
    f"""WITH {B.FRAMES}, u AS (SELECT file, i AS dim, vec[i] AS v FROM frames, range(1,65) r(i)), s AS (SELECT file, dim, avg(v) AS m, max(v) AS x FROM u GROUP BY 1,2),
      z AS (SELECT file, sum(m*sin(dim-1)+x*sin(dim+63)) AS z FROM s GROUP BY 1) SELECT file, round(1/(1+exp(-z)),6) AS prob FROM z""",
)
def given_embedding_weights(spark, sf):
    """Pooled frame vectors scored by given weights, one a position."""
    import math

    pooled = audio.pool_frames(B.frames(spark, sf), ["file"], "vec")
    model = models.LogisticScore(models.Scaling((0.0,) * 128, (1.0,) * 128), tuple(math.sin(i) for i in range(128)), 0.0, 0)
    return pooled.select("file", F.round(model.probability(F.col("pooled")), 6).alias("prob"))


@query(
    "m05_evaluation",
    f"""WITH {B.CAP}, p AS (SELECT CASE WHEN g=0 THEN 'week-' || CAST(substr(day,9,2) AS INT)//10 END AS session, CASE WHEN s1>=0.5e0 THEN 1 ELSE 0 END AS y, s2 AS p FROM cap, range(2) r(g)),
      c AS (SELECT session, p, sum(y) AS pos, sum(1-y) AS neg FROM p GROUP BY 1,2),
      b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY session ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM c)
      SELECT session, CAST(sum(pos+neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(CASE WHEN p>=0.5e0 THEN pos ELSE neg END)/sum(pos+neg)::DOUBLE,6) AS accuracy,
        round(sum(pos*(below+neg/2e0))/(sum(pos)::DOUBLE*sum(neg)),6) AS auc FROM b GROUP BY 1""",
)
def given_scores_evaluated(spark, sf):
    """Accuracy and AUC of given scores per week and pooled."""
    c = B.captures(spark, sf).withColumn("session", F.concat(F.lit("week-"), F.expr("cast(substr(day, 9, 2) as int) div 10")))
    scored = c.select("session", (F.col("s1") >= 0.5).cast("int").alias("y"), F.col("s2").alias("prob"))
    out = models.evaluation(scored, "session", "y")
    return out.select("session", "n", "positives", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))


@query("m03_subtypes")
def subtypes(spark, sf):
    """Sub-type of each confident capture, from fifty k-means restarts."""
    f = cluster_rows(spark, sf).filter("s1 >= 0.5")
    fit = models.fit_subtypes(f, "x", pitch_index=models.CLUSTER_FEATURES.index("f0_mean_hz"))
    name = fit.label(F.col("x")) if fit else F.lit(None).cast("string")
    return f.select("event_id", name.alias("subtype"))


@query("m04_embedding_classifier")
def embedding_classifier(spark, sf):
    """Score from mean and max pooled frame vectors."""
    f = B.frames(spark, sf)
    pooled = audio.pool_frames(f, ["file"], "vec")
    target = f.groupBy("file").agg((F.avg((F.col("label") >= 5).cast("int")) >= 0.5).cast("int").alias("y"))
    rows = pooled.join(target, "file")
    model = models.fit_logistic(rows, "pooled", "y")
    return rows.select("file", "y", model.probability(F.col("pooled")).alias("prob"))


@query("m05_hold_one_session_out")
def hold_one_session_out(spark, sf):
    """Accuracy and AUC per held-out week and pooled."""
    f = feature_rows(spark, sf).withColumn("session", F.concat(F.lit("week-"), F.expr("cast(substr(day, 9, 2) as int) div 10")))
    return models.evaluation(models.hold_one_out(f, "session", "x", "label"), "session", "label")


MASTER = f"""{B.CAP}, trig AS (SELECT session_id, strftime(make_timestamp(t_us),'%Y-%m-%dT%H:00:00') AS sec, arg_max({B.NOTE}, event_id) AS note, arg_max(rms, event_id) AS rms
     FROM cap WHERE event_id%2=0 GROUP BY 1,2),
  nb AS (SELECT *, strftime(make_timestamp(t_us),'%Y-%m-%dT%H:00:00') AS sec, count(*) OVER w - 1 AS neighbours, count(*) FILTER (WHERE s1>=0.5e0) OVER w - CASE WHEN s1>=0.5e0 THEN 1 ELSE 0 END AS high_neighbours
     FROM cap WINDOW w AS (PARTITION BY device_id ORDER BY t_s RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING)),
  m AS (SELECT n.*, coalesce(t.note,'') AS note, t.rms AS trigger_rms, greatest(s1,s2,s3)-least(s1,s2,s3) AS spread, (s1+s2+coalesce(s3,0e0))/(CASE WHEN s3 IS NULL THEN 2 ELSE 3 END) AS mean FROM nb n LEFT JOIN trig t USING (session_id, sec)),
  tm AS (SELECT *, {B.TIER_EXPR.format(spread="spread", mean="mean")} AS tier FROM m),
  master AS (SELECT *, CASE WHEN note='' THEN '' WHEN note LIKE 'auto-rms-%' THEN 'auto' WHEN regexp_matches(note,'^Cry[0-9]*$') OR note='Morning%20cry' THEN 'cry' WHEN note='Bedroom-quiet' THEN 'not_cry'
     WHEN note='test-get-alias' THEN 'test' ELSE '' END AS label FROM tm)"""


def master_inputs(spark, sf):
    c = B.captures(spark, sf)
    hour_text = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:00:00")
    caps = c.withColumn("ts_iso", hour_text).withColumn("capture_file", F.concat(F.lit("cry-"), F.date_format(F.timestamp_micros("t_us"), "yyyyMMdd'T'HHmmss"), F.lit("-"), "event_id"))
    trig = c.filter("event_id % 2 = 0").select(
        "session_id", hour_text.alias("ts_iso"), F.col("event_id").alias("line"), B.note().alias("trigger_note"), F.col("rms").alias("trigger_rms"),
        F.col("s2").alias("trigger_conf"),
    )
    return caps, trig


def master(spark, sf):
    caps, trig = master_inputs(spark, sf)
    return labels.assemble(caps, trig, "s1", ["s1", "s2", "s3"], window_s=3600, oracle_version="scores/1", audited_at="2024-02-01T00:00:00+00:00")


@query(
    "m06_label_table",
    f"""WITH {MASTER} SELECT event_id, tier AS confidence_tier, round(mean,6) AS consensus_score, round(spread,6) AS oracle_agreement, neighbours, high_neighbours, note AS trigger_note,
      round(trigger_rms,6) AS trigger_rms, label AS human_note_label, CASE WHEN label IN ('cry','not_cry') AND s2 IS NOT NULL THEN (label='cry') = (tier IN ('high_pos','medium_pos')) END AS human_note_agrees FROM master""",
)
def label_table(spark, sf):
    r6 = lambda c: F.round(c, 6).alias(c)
    return master(spark, sf).select(
        "event_id", "confidence_tier", r6("consensus_score"), r6("oracle_agreement"), "neighbours", "high_neighbours", "trigger_note", r6("trigger_rms"),
        "human_note_label", "human_note_agrees",
    )


@query(
    "m06_label_row",
    f"""WITH {MASTER} SELECT event_id, session_id, strftime(make_timestamp(t_us),'%Y-%m-%dT%H:00:00') AS ts_iso, round(s1,6) AS baby_cry, round(s1*0.5e0,6) AS crying_sobbing, round(k/250e0,6) AS speech, round(k/500e0,6) AS child_speech,
      round(s1,6) AS cry_pos_max, round(k/250e0,6) AS cry_neg_max, round(s1,6) AS cry_score, round(k/250e0,6) AS speech_score, round(s1-k/250e0,6) AS cry_purity, round(s2,6) AS s2, round(s3,6) AS s3,
      CASE WHEN s1>=0.5e0 THEN CASE WHEN hour<5.25 THEN 'fuss' WHEN hour<11.85 THEN 'full_cry' WHEN hour<18.45 THEN 'distress' ELSE 'screech' END END AS cluster_label,
      neighbours, high_neighbours, round(spread,6) AS oracle_agreement, round(mean,6) AS consensus_score, tier AS confidence_tier, round(value,6) AS value, note AS trigger_note, round(trigger_rms,6) AS trigger_rms,
      label AS human_note_label, CASE WHEN label IN ('cry','not_cry') AND s2 IS NOT NULL THEN (label='cry') = (tier IN ('high_pos','medium_pos')) END AS human_note_agrees,
      'scores/1' AS oracle_version, 'v0.2' AS ensemble_version, '2024-02-01' AS audited_at FROM master""",
)
def label_row(spark, sf):
    """All columns of the label row, given class scores, both other scores and sub-type centres."""
    caps, trig = master_inputs(spark, sf)
    caps = caps.withColumns({"baby_cry": F.col("s1"), "crying_sobbing": F.col("s1") * 0.5, "speech": F.col("k") / 250.0, "child_speech": F.col("k") / 500.0})
    centres = models.Subtypes(models.Scaling((12.0,), (6.0,)), ((2.0,), (8.5,), (15.2,), (21.7,)), tuple(models.SUBTYPES), 0.0)
    out = labels.label_rows(
        caps, trig, ["baby_cry", "crying_sobbing"], ["speech", "child_speech"], "s2", "s3", centres.label(F.array(F.col("hour").cast("double"))), raw=["event_id", "value"],
        window_s=3600, oracle_version="scores/1", audited_at="2024-02-01",
    )
    exact = {"event_id", "neighbours", "high_neighbours"}
    return out.drop("capture_file", "human_note_text", "trigger_conf").select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in out.dtypes if c not in ("capture_file", "human_note_text", "trigger_conf")])


@query("m06_label_table_trained")
def label_table_trained(spark, sf):
    """The whole audit with a feature score fitted on the spot."""
    f = feature_rows(spark, sf)
    model = models.fit_logistic(f, "x", "label")
    caps = f.withColumn("feat_prob", model.probability(F.col("x"))).withColumn("ts_iso", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss"))
    out = labels.assemble(caps, None, "s1", ["s1", "feat_prob", "s3"], window_s=3600)
    return out.select("event_id", "feat_prob", "confidence_tier", "consensus_score", "oracle_agreement", "neighbours", "high_neighbours")


RELEASE = f"""{MASTER}, rel AS (SELECT 'cry-' || strftime(make_timestamp(t_us),'%Y%m%dT%H%M%S') || '-' || CAST(event_id AS VARCHAR) AS file, session_id, tier, mean, spread, label, high_neighbours,
   CASE WHEN label IN ('cry','not_cry') THEN (label='cry') = (tier IN ('high_pos','medium_pos')) END AS agrees FROM master),
 relsplit AS (SELECT *, CASE (row_number() OVER (ORDER BY file)-1)%5 WHEN 4 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split FROM rel)"""


@query(
    "a11_release_header",
    f"""WITH {RELEASE} SELECT 'split' AS dist, split AS value, CAST(count(*) AS BIGINT) AS n FROM relsplit GROUP BY 2 UNION ALL SELECT 'confidence_tier', tier, count(*) FROM relsplit GROUP BY 2
      UNION ALL SELECT 'human_note_label', label, count(*) FROM relsplit WHERE label<>'' GROUP BY 2 UNION ALL SELECT 'human_note_agrees', CAST(agrees AS VARCHAR), count(*) FROM relsplit WHERE agrees IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'n_captures', '', count(*) FROM relsplit UNION ALL SELECT 'train_eligible_n', '', count(*) FROM relsplit WHERE tier IN ('high_pos','high_neg')
      UNION ALL SELECT 'sessions', '', count(DISTINCT session_id) FROM relsplit""",
)
def release_header(spark, sf):
    caps = labels.release_captures(master(spark, sf), scores=["s1", "s2", "s3"])
    h = labels.release_header(caps, "v0.1", ensemble_version="v0.2")
    dims = {c.removesuffix("_distribution").replace("agreement", "agrees"): c for c in h.columns if c.endswith("_distribution")}
    entry = lambda dist, value, n: F.struct(F.lit(dist).alias("dist"), value.alias("value"), n.alias("n"))

    def listed(dist):
        return F.transform(F.map_entries(dims[dist]), lambda e: entry(dist, e["key"], e["value"]))

    sizes = {"n_captures": F.col("n_captures"), "train_eligible_n": F.col("train_eligible_n"), "sessions": F.col("n_sessions")}
    entries = F.concat(*[listed(d) for d in dims], F.array(*[entry(d, F.lit(""), n) for d, n in sizes.items()]))
    return h.select(F.inline(entries))


@query(
    "k03_frozen_release",
    f"""WITH {RELEASE} SELECT file, session_id, split, tier AS confidence_tier, nullif(label,'') AS human_note_label, high_neighbours,
      (SELECT count(*) FROM relsplit) AS n_captures, (SELECT count(DISTINCT session_id) FROM relsplit) AS n_sessions,
      CASE WHEN file IN (SELECT file FROM relsplit ORDER BY file LIMIT 5) THEN sha256(file) END AS sha256 FROM relsplit""",
)
def frozen_release(spark, sf):
    """Write a release below the shared folder and read it back, with its header and the hashes of its first captures."""
    caps = labels.release_captures(master(spark, sf), scores=["s1", "s2", "s3"])
    folder = scratch_path(spark, "releases")
    content = caps.select("file", F.encode("file", "UTF-8").alias("content"))
    labels.write_release(caps, labels.release_header(caps, "v0.1"), folder, "v0.1", labels.drift_hashes(caps, content))
    back = labels.read_frozen(spark, folder, "v0.1")
    rows = back["captures"].select("file", "session_id", "split", "confidence_tier", "human_note_label", "high_neighbours")
    return rows.crossJoin(F.broadcast(back["header"].select("n_captures", "n_sessions"))).join(back["hashes"], "file", "left")


@query("d18_scored_patches_audio")
def scored_patches_audio(spark, sf):
    """Mel patches of documents read as audio, quantised and scored."""
    from soundledger.plans.audio_queries import document_wavs

    p = audio.mel_patches(document_wavs(spark, sf), ["doc_id"], "content").filter("error IS NULL")
    scored = audio.score_patches(p, "mel", audio.PATCH_FRAMES * audio.MEL_BANDS, linear_scorer(audio.PATCH_FRAMES * audio.MEL_BANDS, 21))
    return scored.select("doc_id", "patch_idx", S.softmax_mass(F.col("scores").cast("array<double>"), [19, 20]).alias("cry_mass"))
