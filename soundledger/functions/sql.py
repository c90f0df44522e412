"""The functions of this package under names of their own in SQL text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.functions.text import TEST_NOTES
from soundledger.operators.aggregates import BIN_HIGH, BIN_LOW, BINS

#: Bodies of SQL functions: Catalyst puts them in place of a call, so they cost what the column forms cost.
BODIES = {
    "confidence_tier(s1 DOUBLE, s2 DOUBLE, s3 DOUBLE) RETURNS STRING": """
        CASE WHEN greatest(s1, s2, s3) - least(s1, s2, s3) < 0.2 AND {mean} >= 0.7 THEN 'high_pos'
             WHEN greatest(s1, s2, s3) - least(s1, s2, s3) < 0.2 AND {mean} <= 0.1 THEN 'high_neg'
             WHEN greatest(s1, s2, s3) - least(s1, s2, s3) < 0.4 AND {mean} >= 0.4 THEN 'medium_pos'
             WHEN greatest(s1, s2, s3) - least(s1, s2, s3) < 0.4 AND {mean} < 0.4 THEN 'medium_neg' ELSE 'low' END""".format(
        mean="try_divide(coalesce(s1, 0D) + coalesce(s2, 0D) + coalesce(s3, 0D), int(s1 IS NOT NULL) + int(s2 IS NOT NULL) + int(s3 IS NOT NULL))"
    ),
    "note_text(note STRING) RETURNS STRING": r"""
        CASE WHEN startswith(coalesce(note, ''), 'auto-rms-') THEN note
             ELSE regexp_replace(coalesce(try_url_decode(regexp_replace(replace(coalesce(note, ''), '+', '%2B'), '%(?![0-9A-Fa-f]{2})', '%25')), coalesce(note, '')), r'^\s+|\s+$', '') END""",
    "parse_note(note STRING) RETURNS STRUCT<label: STRING, text: STRING>": rf"""
        named_struct('label',
          CASE WHEN coalesce(note, '') = '' THEN '' WHEN startswith(note, 'auto-rms-') THEN 'auto'
               WHEN lower(note_text(note)) RLIKE r'^cry\d*$' OR contains(lower(note_text(note)), 'cry ') OR endswith(lower(note_text(note)), ' cry') OR contains(lower(note_text(note)), 'cry%20') THEN 'cry'
               WHEN contains(lower(note_text(note)), 'quiet') THEN 'not_cry'
               WHEN lower(note_text(note)) IN ({", ".join(f"'{n}'" for n in TEST_NOTES)}) THEN 'test' ELSE '' END,
          'text', note_text(note))""",
    "hist_quantile(hist ARRAY<BIGINT>, p DOUBLE) RETURNS DOUBLE": f"""
        pow(2D, {BIN_LOW}D + {BIN_HIGH - BIN_LOW}D * (aggregate(hist, named_struct('acc', 0L, 'i', 0, 'hit', {BINS - 1}, 'done', false),
          (s, x) -> named_struct('acc', s.acc + x, 'i', s.i + 1,
             'hit', CASE WHEN NOT s.done AND s.acc + x >= floor(aggregate(hist, 0L, (a, y) -> a + y) * p) THEN s.i ELSE s.hit END,
             'done', s.done OR s.acc + x >= floor(aggregate(hist, 0L, (a, y) -> a + y) * p)),
          s -> s.hit) + 0.5D) / {BINS})""",
    "dequantize(codes ARRAY<TINYINT>, scale DOUBLE, zero_point INT) RETURNS ARRAY<DOUBLE>": "transform(codes, q -> (int(q) - zero_point) * scale)",
}


class Segments:
    """Windows of a capture: ``segments(dur_s, length_s, hop_s)`` gives a row for each that fits."""

    def eval(self, dur_s: float, length_s: float, hop_s: float) -> Iterator[tuple[int, float]]:
        if dur_s is None:
            return
        last = int((dur_s + 1e-6 - length_s) // hop_s)
        for i in range(last + 1):
            yield i, round(i * hop_s, 3)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL: ``confidence_tier``, ``note_text``, ``parse_note``, ``hist_quantile``, ``dequantize``, and the table function ``segments``."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    segments = F.udtf(Segments, returnType=T.StructType([T.StructField("seg_idx", T.IntegerType()), T.StructField("start_s", T.DoubleType())]))
    spark.udtf.register("segments", segments)
