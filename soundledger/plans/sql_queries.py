"""Queries in SQL text over the session's registered functions."""

from __future__ import annotations

from soundledger.functions import sql as functions
from soundledger.functions import scores as S
from soundledger.operators import aggregates as A
from soundledger.plans import bindings as B
from soundledger.plans.audio_queries import GRID_SQL
from soundledger.plans.registry import SQL, query
from soundledger.plans.scalar_queries import LABEL_SQL, MEAN3, NOTED, SPREAD3
from soundledger.sources.tables import table
from pyspark.sql import functions as F


@query("sql_segments_lateral", GRID_SQL)
def segments_lateral(spark, sf):
    """Segments by a table function in a lateral join."""
    functions.register(spark)
    return spark.sql(
        "SELECT d.doc_id, s.seg_idx, s.start_s FROM {docs} d, LATERAL segments(d.n_chars / 2000D, 0.96D, 0.48D) s", docs=table(spark, sf, "documents").select("doc_id", "n_chars")
    )


@query("sql_confidence_tier_sql", f"WITH {B.CAP} SELECT event_id, {B.TIER_EXPR.format(spread=SPREAD3, mean=MEAN3)} AS tier FROM cap")
def confidence_tier_sql(spark, sf):
    functions.register(spark)
    return spark.sql("SELECT event_id, confidence_tier(s1, s2, s3) AS tier FROM {cap}", cap=B.captures(spark, sf).select("event_id", "s1", "s2", "s3"))


@query(
    "sql_parse_note_sql",
    f"""WITH {B.CAP}, {B.TIERED}, {NOTED} SELECT event_id, {LABEL_SQL} AS label, CASE WHEN note LIKE 'auto-rms-%' THEN note ELSE replace(note,'%20',' ') END AS text FROM noted""",
)
def parse_note_sql(spark, sf):
    functions.register(spark)
    rows = B.captures(spark, sf).select("event_id", B.note().alias("note"))
    return spark.sql("SELECT event_id, n.label, n.text FROM (SELECT event_id, parse_note(note) AS n FROM {rows})", rows=rows)


@query("sql_hist_quantile_sql", SQL["a19_hist_quantile"])
def hist_quantile_sql(spark, sf):
    functions.register(spark)
    h = A.level_histogram(B.captures(spark, sf).withColumn("rms", F.col("rms") * 20), ["device_id"], "rms")
    return spark.sql("SELECT device_id, round(hist_quantile(hist, 0.5D), 6) AS p50, round(hist_quantile(hist, 0.95D), 6) AS p95 FROM {h}", h=h)


@query(
    "sql_dequantize_sql",
    f"""WITH {B.FRAMES} SELECT file, seg_idx, round(list_sum(list_transform(vec, lambda x: (greatest(-128e0, least(127e0, round_even(x/0.01e0+3, 0)))-3)*0.01e0)),6)+0e0 AS back_sum FROM frames""",
)
def dequantize_sql(spark, sf):
    functions.register(spark)
    codes = B.frames(spark, sf).select("file", "seg_idx", S.quantise(F.col("vec"), 0.01, 3).alias("codes"))
    return spark.sql("SELECT file, seg_idx, round(aggregate(dequantize(codes, 0.01D, 3), 0D, (a, x) -> a + x), 6) + 0D AS back_sum FROM {codes}", codes=codes)
