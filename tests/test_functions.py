"""Boundary rows of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from soundledger.functions import scores as S
from soundledger.functions import text as X
from soundledger.operators.aggregates import bin_level, exact_percentiles, hist_quantile, level_bin, percentile_columns
from soundledger.operators.windows import row_split


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "scores, tier",
    [
        ([0.75, 0.75], "high_pos"), ([0.7], "high_pos"), ([0.1], "high_neg"), ([0.0, 0.0, 0.05], "high_neg"), ([0.5, 0.75], "medium_pos"),
        ([0.4], "medium_pos"), ([0.39], "medium_neg"), ([0.0, 0.5], "low"), ([0.25, 0.5], "medium_neg"), ([], "low"), ([0.0, 0.25, 0.125], "medium_neg"),
        ([1.0, 0.5], "low"), ([0.0, None, 0.0], "high_neg"),
    ],
)
def test_tier(spark, scores, tier):
    padded = [F.lit(x).cast("double") for x in [*scores, None, None, None][:3]]
    assert one(spark, S.confidence_tier(padded)) == tier


@pytest.mark.parametrize(
    "note, label, text",
    [
        ("cry", "cry", "cry"), ("Cry1", "cry", "Cry1"), ("cry12x", "", "cry12x"), ("Morning cry", "cry", "Morning cry"), ("cry quiet", "cry", "cry quiet"),
        ("Bedroom-quiet", "not_cry", "Bedroom-quiet"), ("auto-rms-33x-rms1632", "auto", "auto-rms-33x-rms1632"), ("living-room", "", "living-room"),
        ("verify-round-2", "test", "verify-round-2"), ("Morning%20cry", "cry", "Morning cry"), ("", "", ""), (None, "", ""), ("a+b%20c", "", "a+b c"),
        ("50%", "", "50%"),
    ],
)
def test_notes(spark, note, label, text):
    n = F.lit(note).cast("string")
    assert one(spark, X.note_label(n)) == label and one(spark, X.note_text(n)) == text


@pytest.mark.parametrize(
    "name, iso, epoch",
    [
        ("cry-20260421T010923+1000.wav", "2026-04-21T01:09:23+10:00", 1776697763), ("cry-20260421T010923-0500.wav", "2026-04-21T01:09:23-05:00", 1776751763),
        ("cry-20260421T010923.wav", None, None), ("cry-boot0001-up12.wav", None, None), ("dog-20260421T010923+1000.wav", None, None),
    ],
)
def test_names(spark, name, iso, epoch):
    assert one(spark, X.capture_iso(F.lit(name))) == iso
    assert one(spark, F.unix_seconds(X.capture_instant(F.lit(name)))) == epoch


def test_json_fields(spark):
    line = F.lit('{"ts":5,"op": "ack","xpath":"no","size":"7","n": 12,"big":12}')
    assert one(spark, X.json_text(line, "op", 16)) == "ack"
    assert one(spark, X.json_text(line, "op", 3)) is None and one(spark, X.json_text(line, "op", 4)) == "ack"
    assert one(spark, X.json_text(line, "n", 16)) is None and one(spark, X.json_text(line, "gone", 16)) is None
    assert one(spark, X.json_text(line, "path", 16)) is None
    assert one(spark, X.json_unsigned(line, "n")) == 12 and one(spark, X.json_unsigned(line, "gone")) is None


@pytest.mark.parametrize("path, ok", [("/sdcard", True), ("/sdcard/a", True), ("/sdcardx", False), ("/logs/../x", False), ("sdcard/a", False), ("/yamnet/a\\b", False)])
def test_paths(spark, path, ok):
    assert one(spark, X.is_safe_path(F.lit(path))) is ok


def test_log_names(spark):
    assert one(spark, X.log_day(F.lit("infer-20260421.jsonl"))).isoformat() == "2026-04-21"
    for bad in ("infer-20261321.jsonl", "infer-19990101.jsonl", "infer.jsonl"):
        assert one(spark, X.log_day(F.lit(bad))) is None


def test_quantise_rounding(spark):
    arr = F.array(*[F.lit(v) for v in (0.25, 0.75, -0.25, 1e9)])
    assert one(spark, S.quantise(arr, 0.5, 0)) == [0, 2, 0, 127]
    assert one(spark, S.quantise(arr, 0.5, 0, half_even=False)) == [1, 2, -1, 127]


def test_top_classes_ties(spark):
    arr = F.array(*[F.lit(v) for v in (0.2, 0.9, 0.9, 0.1)])
    assert [r["idx"] for r in one(spark, S.top_classes(arr, 3))] == [1, 2, 0]


def test_level_histogram(spark):
    bins = [one(spark, level_bin(F.lit(float(v)))) for v in (0.5, 1, 32, 2**14.5 - 1, 2**14.5 + 1)]
    assert bins == [0, 0, 0, 31, 31]
    hist = F.array(*[F.lit(v).cast("bigint") for v in [0, 3, 7] + [0] * 29])
    assert one(spark, hist_quantile(hist, 0.5)) == one(spark, bin_level(F.lit(2)))
    assert one(spark, hist_quantile(hist, 0.05)) == one(spark, bin_level(F.lit(0)))


def test_row_split(spark):
    got = [r["s"] for r in spark.range(7).orderBy("id").select(row_split(F.col("id")).alias("s")).collect()]
    assert got == ["train", "train", "train", "val", "test", "train", "train"]


@pytest.mark.parametrize("n", [1, 2, 7, 565, 5000])
def test_exact_percentiles(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2 if n < 1000 else 6)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "k STRING, v DOUBLE")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r["k"], r["p"]): r["value"] for r in exact_percentiles(df, ["k"], "v", probs, accuracy=100).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
        assert got["b", p] == 1.0
    assert percentile_columns(df.drop("k"), [], "v", {"m": 0.5}).count() == 1
