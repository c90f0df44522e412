"""Queries for acoustic features. Waveforms are the 64-value vectors, or WAV files made of document bytes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.operators import audio as A
from soundledger.plans import bindings as B
from soundledger.plans.registry import query
from soundledger.sources.tables import table

# A grid scaled to 64 samples at 64 Hz: one capture is one second.
MINI = A.Grid(
    seg_len_s=0.5, seg_hop_s=0.25, env_win_ms=125.0, env_hop_ms=62.5, nperseg=32, overlap=16, f0_win_ms=500.0, f0_hop_ms=250.0,
    f0_low=4.0, f0_high=16.0, energy_floor=300.0, floor_min=150.0, rounded=False,
)
GAIN = 20_000.0

WAVES = f"waves AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)*{GAIN}) AS x FROM embeddings)"
ENV = """env AS (SELECT vec_id, i, sqrt(list_sum(list_transform(x[i*4+1:i*4+8], lambda v: v*v))/8 + 1e-12) AS e FROM waves, range(15) r(i)),
 fl AS (SELECT vec_id, quantile_cont(e,0.1) AS p10, greatest(3*quantile_cont(e,0.1),150e0) AS active_floor FROM env GROUP BY 1)"""


def waves(spark, sf):
    # A small file is one split, and features need every core.
    e = table(spark, sf, "embeddings").repartition(spark.sparkContext.defaultParallelism)
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * GAIN).alias("x"))


def mini_features(spark, sf):
    return A.capture_features(waves(spark, sf), ["vec_id"], samples="x", sr=64, grid=MINI)


def _pick(df, keys, cols):
    return df.select(*keys, *[F.round(c, 5).alias(c) for c in cols])


@query(
    "d01_envelope",
    f"""WITH {WAVES}, {ENV} SELECT env.vec_id, round(max(e),5) AS rms_peak, round(avg(e),5) AS rms_mean, round(quantile_cont(e,0.5),5) AS rms_p50, round(quantile_cont(e,0.95),5) AS rms_p95,
      round(any_value(p10),5) AS noise_floor_p10, round(any_value(active_floor),5) AS active_floor, round(avg(CASE WHEN e>active_floor THEN 1 ELSE 0 END),5) AS active_frac
      FROM env JOIN fl USING (vec_id) GROUP BY 1""",
)
def envelope(spark, sf):
    cols = ["rms_peak", "rms_mean", "rms_p50", "rms_p95", "noise_floor_p10", "active_floor", "active_frac"]
    return _pick(A.file_rows(mini_features(spark, sf)), ["vec_id"], cols)


_TWO_PI = repr(2 * math.pi)
DFT = f"""hann AS (SELECT list(0.5e0-0.5e0*cos({_TWO_PI}*j/32) ORDER BY j) AS w FROM range(32) r(j)),
 fr AS (SELECT vec_id, f, x[f*16+1:f*16+32] AS s FROM waves, range(3) r(f)),
 mag AS (SELECT vec_id, f, k, k*2e0 AS hz, sqrt(pow(list_sum(list_transform(range(32), lambda j: s[j+1]*w[j+1]*cos({_TWO_PI}*k*j/32))),2)
      + pow(list_sum(list_transform(range(32), lambda j: s[j+1]*w[j+1]*sin({_TWO_PI}*k*j/32))),2))/16 AS m FROM fr, hann, range(17) r(k))"""


@query(
    "d02_spectrum",
    f"""WITH {WAVES}, {DFT}, c AS (SELECT *, sum(m) OVER (PARTITION BY vec_id, f ORDER BY k) AS cum, sum(m) OVER (PARTITION BY vec_id, f) AS tot FROM mag),
      p AS (SELECT vec_id, f, sum(hz*m)/(sum(m)+1e-12) AS cen, min(hz) FILTER (WHERE cum>=0.85e0*(tot+1e-12)) AS r85, min(hz) FILTER (WHERE cum>=0.95e0*(tot+1e-12)) AS r95,
        exp(avg(ln(m+1e-12)))/(avg(m)+1e-12) AS fl FROM c GROUP BY 1,2)
      SELECT vec_id, round(avg(cen),5) AS centroid_mean_hz, round(stddev_pop(cen),5) AS centroid_std_hz, round(avg(r85),5) AS rolloff85_mean_hz, round(avg(r95),5) AS rolloff95_mean_hz,
       round(avg(fl),5) AS flatness_mean FROM p GROUP BY 1""",
)
def spectrum(spark, sf):
    cols = ["centroid_mean_hz", "centroid_std_hz", "rolloff85_mean_hz", "rolloff95_mean_hz", "flatness_mean"]
    return _pick(A.file_rows(mini_features(spark, sf)), ["vec_id"], cols)


@query(
    "d03_pitch",
    f"""WITH {WAVES}, fr AS (SELECT vec_id, f, list_transform(x[f*16+1:f*16+32], lambda v: v - list_avg(x[f*16+1:f*16+32])) AS s FROM waves, range(3) r(f)),
      ac AS (SELECT vec_id, f, lag, list_sum(list_transform(range(32-lag), lambda j: s[j+1]*s[j+1+lag]))/list_sum(list_transform(s, lambda v: v*v)) AS r,
        sqrt(list_sum(list_transform(s, lambda v: v*v))/32+1e-12) AS e FROM fr, range(4,17) l(lag)),
      b AS (SELECT vec_id, f, CASE WHEN any_value(e)>=300 THEN arg_max(lag, r) END AS lag, CASE WHEN any_value(e)>=300 THEN max(r) ELSE 0 END AS conf FROM ac GROUP BY 1,2)
      SELECT vec_id, round(avg(CASE WHEN conf>0.3e0 THEN 1 ELSE 0 END),5) AS f0_voiced_frac, round(coalesce(avg(64e0/lag) FILTER (WHERE conf>0.3e0),0),5) AS f0_mean_hz,
       round(coalesce(stddev_pop(64e0/lag) FILTER (WHERE conf>0.3e0),0),5) AS f0_std_hz, round(coalesce(quantile_cont(64e0/lag,0.5) FILTER (WHERE conf>0.3e0),0),5) AS f0_p50_hz,
       round(coalesce(quantile_cont(64e0/lag,0.95) FILTER (WHERE conf>0.3e0),0),5) AS f0_p95_hz,
       round(coalesce(10*log10(avg(least(0.999e0,greatest(0.001e0,conf))/(1-least(0.999e0,greatest(0.001e0,conf)))) FILTER (WHERE conf>0.3e0)),0),5)+0e0 AS hnr_db FROM b GROUP BY 1""",
)
def pitch(spark, sf):
    cols = ["f0_voiced_frac", "f0_mean_hz", "f0_std_hz", "f0_p50_hz", "f0_p95_hz", "hnr_db"]
    out = _pick(A.file_rows(mini_features(spark, sf)), ["vec_id"], cols)
    return out.withColumn("hnr_db", F.col("hnr_db") + 0.0)


@query(
    "d04_zero_crossings_clips",
    f"""WITH {WAVES} SELECT vec_id, round(list_sum(list_transform(range(1,64), lambda i: CASE WHEN (x[i]>=0) <> (x[i+1]>=0) THEN 1e0 ELSE 0e0 END))/63,5) AS zcr,
      round(list_sum(list_transform(x, lambda v: CASE WHEN abs(v*6)>=32000 THEN 1e0 ELSE 0e0 END))/64,5) AS clip_frac FROM waves""",
)
def zero_crossings_clips(spark, sf):
    loud = waves(spark, sf).withColumn("x", F.transform("x", lambda v: v * 6))
    rates = loud.select("vec_id", A.zero_crossing_rate(F.col("x")).alias("zcr"), A.clip_ratio(F.col("x")).alias("clip_frac"))
    return _pick(rates, ["vec_id"], ["zcr", "clip_frac"])


@query(
    "d06_onsets",
    f"""WITH {WAVES}, {ENV}, a AS (SELECT env.vec_id, i, e>active_floor AS up FROM env JOIN fl USING (vec_id)),
      r AS (SELECT vec_id, i-1 AS i FROM (SELECT *, lag(up) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM a) WHERE up AND NOT before),
      l AS (SELECT vec_id, list(i ORDER BY i) AS xs FROM r GROUP BY 1),
      n AS (SELECT vec_id, list_reduce(list_prepend({{'last': -1000, 'n': 0}}, list_transform(xs, lambda i: {{'last': i, 'n': 0}})),
         lambda acc, s: CASE WHEN s.last-acc.last>=2 THEN {{'last': s.last, 'n': acc.n+1}} ELSE acc END).n AS n FROM l)
      SELECT w.vec_id, CAST(coalesce(n.n,0) AS INTEGER) AS onsets FROM waves w LEFT JOIN n USING (vec_id)""",
)
def onsets(spark, sf):
    return A.file_rows(mini_features(spark, sf)).select("vec_id", "onsets")


BAND_SQL = ", ".join(f"round(coalesce(sum(m*m) FILTER (WHERE hz*100>={lo} AND hz*100<{hi}),0)/(sum(m*m)+1e-12),5) AS {n}" for n, lo, hi in A.BANDS)
PEAK_SQL = ", ".join(f"coalesce(arg_max(hz*100, mm) FILTER (WHERE hz*100>={lo} AND hz*100<{hi}),0) AS {n}" for n, lo, hi in A.PEAK_BANDS)


@query(
    "d07_bands_peaks",
    f"""WITH {WAVES}, {DFT}, b AS (SELECT vec_id, {BAND_SQL} FROM mag GROUP BY 1), q AS (SELECT vec_id, hz, sum(m) AS mm FROM mag GROUP BY 1,2),
      p AS (SELECT vec_id, {PEAK_SQL} FROM q GROUP BY 1) SELECT * FROM b JOIN p USING (vec_id)""",
)
def bands_peaks(spark, sf):
    # The same waveforms read at 6,400 Hz, so that their bins fall into the band table.
    fast = A.Grid(
        seg_len_s=0.005, seg_hop_s=0.0025, env_win_ms=1.25, env_hop_ms=0.625, nperseg=32, overlap=16, f0_win_ms=5.0, f0_hop_ms=2.5,
        f0_low=400.0, f0_high=1600.0, rounded=False,
    )
    f = A.file_rows(A.capture_features(waves(spark, sf), ["vec_id"], samples="x", sr=6400, grid=fast))
    return _pick(f, ["vec_id"], [n for n, _, _ in A.BANDS + A.PEAK_BANDS])


GRID_SQL = """WITH d AS (SELECT doc_id, n_chars/2000e0 AS dur FROM documents) SELECT doc_id, CAST(s AS INTEGER) AS seg_idx, round(s*0.48e0,3) AS start_s
      FROM d, LATERAL (SELECT unnest(range(greatest(0, CAST(floor((dur+1e-6-0.96e0)/0.48e0) AS BIGINT)+1))) AS s)"""


@query("d11_segment_grid", GRID_SQL)
def segment_grid(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(A.segment_grid(F.col("n_chars") / F.lit(2000.0))).alias("seg_idx"))
    return d.withColumn("start_s", F.round(F.col("seg_idx") * 0.48, 3))


@query(
    "d12_segment_features",
    f"""WITH {WAVES}, {ENV}, s AS (SELECT vec_id, g.i AS seg_idx, env.e, env.i FROM env, range(3) g(i) WHERE env.i >= g.i*4 AND env.i < g.i*4+8)
      SELECT s.vec_id, CAST(seg_idx AS INTEGER) AS seg_idx, round(seg_idx*0.25e0,3) AS start_s, round(max(e),5) AS rms_peak, round(quantile_cont(e,0.5),5) AS rms_p50,
       round(avg(CASE WHEN e>active_floor THEN 1 ELSE 0 END),5) AS active_frac, round(any_value(p10),5) AS file_noise_floor FROM s JOIN fl USING (vec_id) GROUP BY 1,2,3""",
)
def segment_features(spark, sf):
    seg = A.segment_rows(mini_features(spark, sf))
    return _pick(seg, ["vec_id", "seg_idx"], ["start_s", "rms_peak", "rms_p50", "active_frac", "file_noise_floor"])


def document_wavs(spark, sf):
    """Each document's bytes as the sample payload of a WAV file."""
    d = table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism)
    return d.select("doc_id", A.wav_bytes(F.encode("text", "UTF-8")).alias("content"))


@query(
    "r01_decode_captures",
    """SELECT doc_id, 16000 AS sr, CAST(octet_length(encode(text))//2 AS INTEGER) AS samples, round((octet_length(encode(text))//2)/16000e0,7) AS dur_s, NULL AS error FROM documents
      WHERE octet_length(encode(text))//2 > 512
      UNION ALL SELECT doc_id, NULL, NULL, NULL, 'ValueError' FROM documents WHERE octet_length(encode(text))//2 <= 512""",
)
def decode_captures(spark, sf):
    f = A.capture_features(document_wavs(spark, sf), ["doc_id"], content="content")
    whole = f.filter(F.col("seg_idx").isNull())
    return whole.select("doc_id", "sr", "samples", F.round(F.col("samples") / F.col("sr"), 7).alias("dur_s"), F.split("error", ":")[0].alias("error"))


@query("d12_document_audio")
def document_audio(spark, sf):
    """File and segment rows of all documents read as audio, on the full 16 kHz grid."""
    return A.capture_features(document_wavs(spark, sf), ["doc_id"], content="content")


DOCS_PER_CAPTURE = 320


def long_captures(spark, sf):
    """Captures of about forty seconds: the bytes of 320 consecutive documents as one WAV file."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]))
    d = d.withColumn("capture", F.expr(f"doc_id div {DOCS_PER_CAPTURE}"))
    # A fixed number of partitions: small ones would be merged into one, and features need every core.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = d.repartition(tasks, "capture").groupBy("capture").agg(joined.alias("text"))
    return c.select("capture", A.wav_bytes(F.encode("text", "UTF-8")).alias("content"))


@query(
    "d12_capture_audit",
    f"""WITH c AS (SELECT doc_id//{DOCS_PER_CAPTURE} AS capture, CAST(sum(octet_length(encode(text)))//2 AS BIGINT) AS samples FROM documents GROUP BY 1)
      SELECT capture, samples, CAST(greatest(0, floor((samples/16000e0+1e-6-0.96e0)/0.48e0)+1) AS BIGINT) AS segments FROM c""",
)
def capture_audit(spark, sf):
    """The capture audit on long captures: all file and segment features, then the segments counted."""
    f = A.capture_features(long_captures(spark, sf), ["capture"], content="content")
    # Summing over every feature keeps the optimizer from pruning the table to its counts.
    used = F.count_if(F.array_max(F.array(*[F.col(n).cast("double") for n in A.FEATURES])).isNull())
    out = f.groupBy("capture").agg(F.max("samples").cast("bigint").alias("samples"), F.count("seg_idx").alias("segments"), used.alias("_empty"))
    return out.filter("_empty = 0").drop("_empty")


@query("d13_mel_patches")
def mel_patches(spark, sf):
    p = A.mel_patches(document_wavs(spark, sf), ["doc_id"], "content")
    health = A.patch_health(S.quantise(F.col("mel"), 0.05, -10), -10)
    return p.select("doc_id", "patch_idx", F.size("mel").alias("cells"), *[c.alias(n) for n, c in health.items()], "error")


@query("d14_mel_db_table")
def mel_db_table(spark, sf):
    t = A.mel_db_table(document_wavs(spark, sf), ["doc_id"], "content")
    return t.select("doc_id", "frame", F.size("mel_db").alias("bands"), F.array_max("mel_db").alias("loudest"), "db_p5", "db_p99", "error")


@query(
    "d15_block_levels",
    f"""WITH {WAVES} SELECT vec_id, CAST(b AS INTEGER) AS block, round(sqrt(list_sum(list_transform(x[b*4+1:b*4+4], lambda v: v*v))/4),5) AS rms FROM waves, (SELECT unnest([0,3,6,9,12,15]) AS b)""",
)
def block_levels(spark, sf):
    w = waves(spark, sf).select("vec_id", F.explode(A.block_levels(F.col("x"), 4, 3)).alias("b"))
    return w.select("vec_id", "b.block", F.round("b.rms", 5).alias("rms"))


@query(
    "d16_top_classes",
    f"""WITH {B.FRAMES}, u AS (SELECT file, seg_idx, i-1 AS idx, vec[i] AS v FROM frames, range(1,65) r(i)), r AS (SELECT *, row_number() OVER (PARTITION BY file, seg_idx ORDER BY v DESC, idx) AS rn FROM u)
      SELECT file, seg_idx, CAST(rn AS INTEGER) AS rank, CAST(idx AS INTEGER) AS idx, round(v,6)+0e0 AS score FROM r WHERE rn<=10""",
)
def top_classes(spark, sf):
    t = B.frames(spark, sf).select("file", "seg_idx", F.posexplode(S.top_classes(F.col("vec"), 10)).alias("pos", "c"))
    return t.select("file", "seg_idx", (F.col("pos") + 1).alias("rank"), "c.idx", F.round("c.score", 6).alias("score"))


@query(
    "d17_pool_frames",
    f"""WITH {B.FRAMES}, u AS (SELECT file, i AS dim, vec[i] AS v FROM frames, range(1,65) r(i)), s AS (SELECT file, dim, avg(v) AS m, max(v) AS x FROM u GROUP BY 1,2)
      SELECT file, CAST(dim-1 AS INTEGER) AS pos, round(m,6)+0e0 AS value FROM s UNION ALL SELECT file, CAST(dim+63 AS INTEGER), round(x,6)+0e0 FROM s""",
)
def pool_frames(spark, sf):
    p = A.pool_frames(B.frames(spark, sf), ["file"], "vec").select("file", F.posexplode("pooled").alias("pos", "value"))
    return p.withColumn("value", F.round("value", 6))


def linear_scorer(cells: int, classes: int):
    """A deterministic linear stand-in for a class model."""

    def load():
        import numpy as np

        weights = np.sin(0.37 * np.arange(cells)[:, None] + 0.11 * np.arange(classes)[None, :])
        return lambda batch: np.asarray(batch, dtype=np.float64) @ weights

    return load


@query(
    "d18_score_patches",
    """SELECT vec_id, CAST(c AS INTEGER) AS cls, round(list_sum(list_transform(range(64), lambda j: CAST(embedding[j+1] AS DOUBLE)*sin(0.37e0*j+0.11e0*c))),3)+0e0 AS score FROM embeddings, range(8) r(c)""",
)
def score_patches(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = A.score_patches(e, "embedding", 64, linear_scorer(64, 8)).select("vec_id", F.posexplode("scores").alias("cls", "score"))
    return s.withColumn("score", F.round(F.col("score").cast("double"), 3))


@query(
    "d19_patch_health",
    f"""WITH {B.FRAMES}, q AS (SELECT file, seg_idx, list_transform(vec, lambda x: greatest(-128e0, least(127e0, round_even(x/0.1e0-4,0)))) AS c FROM frames),
      h AS (SELECT *, list_sum(list_transform(c, lambda x: CASE WHEN x=-4 THEN 1e0 ELSE 0e0 END))/64 AS z FROM q)
      SELECT file, seg_idx, CAST(list_min(c) AS INTEGER) AS mel_min, CAST(list_max(c) AS INTEGER) AS mel_max, round(list_sum(c)/64,6)+0e0 AS mel_mean, round(z,6) AS zero_share, z>0.4e0 AS flat FROM h""",
)
def patch_health(spark, sf):
    q = B.frames(spark, sf).withColumn("codes", S.quantise(F.col("vec"), 0.1, -4))
    h = A.patch_health(F.col("codes"), -4, flat_share=0.4)
    out = q.select("file", "seg_idx", *[c.alias(n) for n, c in h.items()])
    return out.select(
        "file", "seg_idx", F.col("mel_min").cast("int").alias("mel_min"), F.col("mel_max").cast("int").alias("mel_max"),
        F.round("mel_mean", 6).alias("mel_mean"), F.round("zero_share", 6).alias("zero_share"), "flat",
    )


_RULES = ", ".join(f"('{name}', {digits})" for name, digits in A.DECIMALS.items())
_ROUNDED = "CASE digits " + " ".join(f"WHEN {d} THEN round_even(raw, {d})" for d in sorted(set(A.DECIMALS.values()))) + " ELSE raw END"


@query(
    "f23_feature_decimals",
    f"""WITH v AS (SELECT event_id, n.name, n.digits, value*(event_id%9+1)/7e0 AS raw FROM events, (VALUES {_RULES}, ('samples', 17)) n(name, digits) WHERE event_id%5=0)
      SELECT event_id, name, {_ROUNDED} AS value FROM v""",
)
def feature_decimals(spark, sf):
    """The rounding rule of every feature that has one, over values as features; and one without."""
    e = table(spark, sf, "events").filter("event_id % 5 = 0").select("event_id", (F.col("value") * (F.col("event_id") % 9 + 1) / 7.0).alias("raw"))
    long = e.withColumn("name", F.explode(F.array(*[F.lit(n) for n in [*A.DECIMALS, "samples"]])))
    return long.select("event_id", "name", A.rounded_feature(F.col("name"), F.col("raw")).alias("value"))
