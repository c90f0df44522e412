"""Jobs whose groups, files and memory must not grow with the table, and tasks that get no rows."""

import json

import pytest
from pyspark.sql import functions as F

from soundledger.operators import models
from soundledger.plans.catalog import QUERIES


def test_subtypes_with_tasks_that_get_no_rows(spark):
    """Most of the forty partitions are empty after the filter."""
    rows = spark.range(0, 60, 1, 40).select("id", F.array((F.col("id") % 2 * 100).cast("double"), F.sin("id")).alias("x")).filter("id < 15")
    fit = models.fit_subtypes(rows, "x", pitch_index=0, k=2, restarts=3)
    names = {r["id"]: r["name"] for r in rows.select("id", fit.label(F.col("x")).alias("name")).collect()}
    assert names == {i: f"cluster_{i % 2}" for i in range(15)}


@pytest.fixture
def written(spark, monkeypatch):
    """Names of the scratch folders that a query asks for, and their paths."""
    from soundledger import session
    from soundledger.plans import source_queries

    paths = {}

    def scratch(spark, name):
        paths[name] = real(spark, name)
        return paths[name]

    real = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", scratch)
    monkeypatch.setattr(source_queries, "scratch_path", scratch)
    return paths


def test_manifest_pages_are_bounded(spark, tmp_path, written):
    keys = spark.range(130_000).select(
        F.col("id").alias("o_orderkey"), F.lit(1.5).alias("o_totalprice"), F.lit("2024-01-01").cast("timestamp").alias("o_orderdate"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus")
    )
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["r08_manifest_pages"](spark, str(tmp_path))
    assert out.count() == 130_000 and out.filter("truncated").count() == 40_000
    sizes = [len(json.loads(r["value"])["files"]) for r in spark.read.text(written["manifest"]).collect()]
    assert sorted(sizes) == [4_000] * 10 + [10_000, 40_000, 40_000]


def test_releases_do_not_take_a_file_each(spark, tmp_path, written):
    rows = spark.range(100_000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["r11_release_document"](spark, str(tmp_path))
    assert out.select("event_id").distinct().count() == out.count() == 100_000
    docs = spark.read.text(written["releases"])
    assert docs.count() == 70 and docs.select(F.input_file_name()).distinct().count() < 20


def test_audio_rows_leave_in_bounded_frames(spark, monkeypatch):
    """A task passes rows of many short captures on together, and never all of them at once."""
    import pandas as pd

    from soundledger.operators import audio

    sizes = []
    rows = iter([(i, None if i % 5 == 0 else i, None, 0.0, 0.0, "x" if i % 5 == 0 else None) for i in range(2500)])
    for frame in audio._in_frames(rows, ["id", "frame", "mel_db", "db_p5", "db_p99", "error"], "frame"):
        sizes.append(len(frame))
        assert str(frame["frame"].dtype) == "Int32" and isinstance(frame, pd.DataFrame)
    assert sizes == [1024, 1024, 452]


def test_language_model_blocks_are_read_in_batches(spark):
    from soundledger.llm import language_model as lm

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    rows = spark.range(35).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.lit(False).alias("held_out"), F.lit("a b").alias("t"))
    try:
        raw = lm.text_blocks(rows).first()["texts"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [b.num_rows for b in lm.block_texts(raw)] == [10, 10, 10, 5]


def test_united_pairs_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    from soundledger.plans import join_queries

    monkeypatch.setattr(join_queries, "PAIR_ROWS", 50)
    rows = spark.range(1000).select(
        (F.col("id") % 3).alias("l_partkey"), (F.col("id") % 400).alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.col("id").alias("l_orderkey"), F.lit(3).alias("l_linenumber")
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["u01_union_sessions"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 21
    sessions = {p: {i % 400 for i in range(1000) if i % 3 == p} for p in range(3)}
    want = {f"cry-{p}.wav": (f"night-{min(s):06d}", len(s)) for p, s in sessions.items()}
    assert {r["name"]: (r["session_id"], r["sessions"]) for r in out.collect()} == want
