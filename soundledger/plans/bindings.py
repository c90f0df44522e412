"""Roles the given tables play: captures, triggers, ledger events, manifests, copies, frames, polls.

Each Spark view has a SQL twin of the same name, used as a CTE in the oracle text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundledger.sources.tables import table

MICROS = 1_000_000

CAP = """cap AS (
  SELECT user_id AS device_id, event_id, epoch_us(ts) AS t_us, epoch_us(ts)//1000000 AS t_s,
         strftime(ts,'%Y-%m-%d') AS day, CAST(date_part('hour',ts) AS INTEGER) AS hour,
         strftime(ts,'%Y%m%d') AS session_id, event_type AS cls, value,
         CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
         least(value/200e0,1e0) AS s1,
         CAST(json_extract_string(props,'$.k') AS BIGINT)/100e0 AS s2,
         CASE WHEN event_id%7=0 THEN NULL ELSE (CAST(json_extract_string(props,'$.k') AS BIGINT)+event_id%11)/110e0 END AS s3,
         value*10 AS rms
  FROM events)"""

TIER_EXPR = """CASE WHEN {spread} < 0.2e0 AND {mean} >= 0.7e0 THEN 'high_pos'
  WHEN {spread} < 0.2e0 AND {mean} <= 0.1e0 THEN 'high_neg'
  WHEN {spread} < 0.4e0 AND {mean} >= 0.4e0 THEN 'medium_pos'
  WHEN {spread} < 0.4e0 AND {mean} < 0.4e0 THEN 'medium_neg' ELSE 'low' END"""

TIER2 = TIER_EXPR.format(spread="abs(s1-s2)", mean="((s1+s2)/2)")

TIERED = f"""tiered AS (SELECT *, {TIER2} AS tier FROM cap)"""

NOTE = """CASE cls WHEN 'view' THEN 'Cry' || CAST(k AS VARCHAR) WHEN 'click' THEN 'Bedroom-quiet'
  WHEN 'signup' THEN 'auto-rms-' || CAST(k AS VARCHAR) || 'x-rms' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
  WHEN 'purchase' THEN CASE WHEN k%3=0 THEN 'test-get-alias' WHEN k%3=1 THEN 'Morning%20cry' ELSE 'a+b%20c' END ELSE '' END"""

LEDGER = """ledger AS (
  SELECT 'f' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(json_extract_string(props,'$.k') AS BIGINT)%7 AS VARCHAR) AS path, event_id AS line,
         CASE event_type WHEN 'view' THEN 'register' WHEN 'click' THEN 'register' WHEN 'signup' THEN 'close'
              WHEN 'purchase' THEN 'ack' ELSE 'purge' END AS op,
         CAST(floor(value*100) AS BIGINT) AS size, epoch_us(ts)//1000000 AS mtime,
         CAST(event_id%97 AS VARCHAR) AS sha256, 'wav' AS category,
         CASE WHEN CAST(json_extract_string(props,'$.k') AS BIGINT)%4=0 THEN 'synced' ELSE 'pending' END AS sync_state
  FROM events)"""

STATE = """last_reset AS (SELECT path, max(line) FILTER (WHERE op IN ('register','close','purge')) AS reset_line,
         max(line) FILTER (WHERE op='ack') AS ack_line FROM ledger GROUP BY path),
state AS (SELECT l.path, l.size, l.mtime, l.sha256, l.category,
         CASE WHEN l.sync_state='synced' OR coalesce(r.ack_line > r.reset_line, false) THEN 'synced' ELSE 'pending' END AS sync_state
  FROM last_reset r JOIN ledger l ON l.path=r.path AND l.line=r.reset_line WHERE l.op<>'purge')"""

REMOTE = """remote AS (
  SELECT '/sdcard/events/' || CAST(o_orderkey AS VARCHAR) || '.wav' AS path,
         CAST(floor(o_totalprice) AS BIGINT) AS size, epoch_us(o_orderdate)//1000000 AS mtime,
         CASE WHEN o_orderkey%11=0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS sha256,
         CASE WHEN o_orderstatus='O' THEN 'wav' WHEN o_orderstatus='F' THEN 'infer_log' ELSE 'other' END AS category,
         o_orderkey%13=0 AS mutable, o_orderkey, o_custkey FROM orders)"""

MIRROR = """mirror AS (
  SELECT CASE category WHEN 'wav' THEN 'wavs' WHEN 'infer_log' THEN 'infer' ELSE 'misc' END || '/' || CAST(o_orderkey AS VARCHAR) || '.wav' AS path,
         CASE WHEN o_orderkey%7=0 THEN size+1 ELSE size END AS size,
         CASE WHEN o_orderkey%17=0 THEN 'changed' ELSE CAST(o_custkey AS VARCHAR) END AS sha256
  FROM remote WHERE o_orderkey%5<>0)"""

COPIES = """copies AS (
  SELECT 'cry-' || CAST(l_partkey AS VARCHAR) || '.wav' AS name, 'night-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS session_id,
         CAST(l_quantity AS BIGINT) AS size, l_orderkey, l_linenumber FROM lineitem)"""

POLLS = """polls AS (
  SELECT device_id, t_us, event_id, cls, k, s1, event_id%500 AS uptime,
         (event_id%1000)*3 AS overruns, k AS captures, (k*7)%20 AS alerts,
         (event_id%9)//2 AS counter, k>=30 AS answered
  FROM cap)"""

FRAMES = """frames AS (
  SELECT vec_id//10 AS file, CAST(vec_id%10 AS INTEGER) AS seg_idx, label,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""


def captures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    t_us = F.unix_micros("ts")
    return e.select(
        F.col("user_id").alias("device_id"),
        "event_id",
        t_us.alias("t_us"),
        F.expr("unix_micros(ts) div 1000000").alias("t_s"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.hour("ts").alias("hour"),
        F.date_format("ts", "yyyyMMdd").alias("session_id"),
        F.col("event_type").alias("cls"),
        "value",
        k.alias("k"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("s1"),
        (k / F.lit(100.0)).alias("s2"),
        F.when(F.col("event_id") % 7 != 0, (k + F.col("event_id") % 11) / F.lit(110.0)).alias("s3"),
        (F.col("value") * 10).alias("rms"),
    )


def note(cls: str = "cls", k: str = "k", value: str = "value"):
    c, n = F.col(cls), F.col(k).cast("string")
    return (
        F.when(c == "view", F.concat(F.lit("Cry"), n))
        .when(c == "click", "Bedroom-quiet")
        .when(c == "signup", F.concat(F.lit("auto-rms-"), n, F.lit("x-rms"), F.floor(value).cast("string")))
        .when(
            c == "purchase",
            F.when(F.col(k) % 3 == 0, "test-get-alias").when(F.col(k) % 3 == 1, "Morning%20cry").otherwise("a+b%20c"),
        )
        .otherwise("")
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = (
        F.when(F.col("event_type").isin("view", "click"), "register")
        .when(F.col("event_type") == "signup", "close")
        .when(F.col("event_type") == "purchase", "ack")
        .otherwise("purge")
    )
    return e.select(
        F.concat(F.lit("f"), F.col("user_id"), F.lit("-"), k % 7).alias("path"),
        F.col("event_id").alias("line"),
        op.alias("op"),
        F.floor(F.col("value") * 100).alias("size"),
        F.expr("unix_micros(ts) div 1000000").alias("mtime"),
        (F.col("event_id") % 97).cast("string").alias("sha256"),
        F.lit("wav").alias("category"),
        F.when(k % 4 == 0, "synced").otherwise("pending").alias("sync_state"),
    )


def remote(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("/sdcard/events/"), key, F.lit(".wav")).alias("path"),
        F.floor("o_totalprice").alias("size"),
        F.expr("unix_micros(o_orderdate) div 1000000").alias("mtime"),
        F.when(key % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("sha256"),
        F.when(F.col("o_orderstatus") == "O", "wav").when(F.col("o_orderstatus") == "F", "infer_log").otherwise("other").alias("category"),
        (key % 13 == 0).alias("mutable"),
        "o_orderkey",
        "o_custkey",
    )


def mirror(spark: SparkSession, sf: str) -> DataFrame:
    from soundledger.functions.text import mirror_path

    r = remote(spark, sf).filter(F.col("o_orderkey") % 5 != 0)
    return r.select(
        mirror_path(F.col("path"), F.col("category")).alias("path"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("o_orderkey") % 17 == 0, "changed").otherwise(F.col("o_custkey").cast("string")).alias("sha256"),
    )


def copies(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("cry-"), F.col("l_partkey"), F.lit(".wav")).alias("name"),
        F.concat(F.lit("night-"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("session_id"),
        F.col("l_quantity").cast("bigint").alias("size"),
        "l_orderkey",
        "l_linenumber",
    )


def polls(spark: SparkSession, sf: str) -> DataFrame:
    c = captures(spark, sf)
    return c.select(
        "device_id",
        "t_us",
        "event_id",
        "cls",
        "k",
        "s1",
        (F.col("event_id") % 500).alias("uptime"),
        (F.col("event_id") % 1000 * 3).alias("overruns"),
        F.col("k").alias("captures"),
        (F.col("k") * 7 % 20).alias("alerts"),
        F.expr("(event_id % 9) div 2").alias("counter"),
        (F.col("k") >= 30).alias("answered"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.expr("vec_id div 10").alias("file"),
        (F.col("vec_id") % 10).cast("int").alias("seg_idx"),
        "label",
        F.col("embedding").cast("array<double>").alias("vec"),
    )
