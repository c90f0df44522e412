"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from soundledger.llm.common import materialize

#: Candidates of a bucket and queries of a block, about: a task compares one block with one bucket.
BUCKET_ROWS = 4096
BLOCK_ROWS = 1024
#: Local cosine thresholds from which coordinates prune better than lengths.
COORDINATE_FROM = 0.6
#: Coordinates looked at for one query.
FOCUS = 4
#: Length classes; a class with many rows is cut into several buckets.
RINGS = 64
NOTHING = pd.DataFrame({c: pd.Series(dtype="i8") for c in ("asked", "row", "vec_id", "score")})
#: Products of lengths below these are exact in doubles, in 64-bit numbers.
DOUBLE, LONG = 2.0**52, 2.0**62
NO_FLOOR = -(2**63)
#: Room for rounding in bounds; the products themselves are exact.
EPS = 1e-9


def quantized(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component, null where the vector is null or a component is null, not finite, or then beyond a long."""
    x = lambda v: v.cast("double")
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    odd = odd | F.exists(vector, lambda v: F.abs(x(v)) * scale >= 2.0**63)
    # Whole doubles beyond 2 ** 53 are their own floor.
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(F.when(F.abs(v) < 2.0**53, v))).otherwise(v.try_cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(vector, lambda v: whole(F.lit(scale) * x(v))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("i8")


def search(q: np.ndarray, floor: np.ndarray, p: np.ndarray, p_norm: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the candidates of one bucket that may reach the query's ``floor``, ties included.

    The local threshold of a query is the cosine that the longest candidate of the bucket would need. Above 1 the bucket
    drops out; where it is high, the query's largest coordinates bound those of a candidate; else lengths decide.
    """
    q_norm = np.linalg.norm(q, axis=1)
    longest = p_norm.max()
    unit = p / np.where(p_norm, p_norm, 1)[:, None]
    reach = q_norm * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, floor / reach, np.where(floor > 0, np.inf, -np.inf))
    for i in np.flatnonzero(local <= 1 + EPS):
        t = local[i]
        if t >= COORDINATE_FROM:
            u = q[i] / q_norm[i]
            rows = np.arange(len(p))
            apart = np.arccos(min(t, 1.0))
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                # Within this angle of the query a unit vector keeps each coordinate in a range around the query's.
                turn = np.arccos(np.clip(u[f], -1, 1))
                low, high = np.cos(min(np.pi, turn + apart)), np.cos(max(0.0, turn - apart))
                c = unit[rows, f]
                rows = rows[(c >= low - EPS) & (c <= high + EPS)]
            yield i, rows
        elif floor[i] > 0:
            yield i, np.flatnonzero(p_norm * q_norm[i] >= floor[i] * (1 - EPS))
        else:
            yield i, np.arange(len(p))


def products(q: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of vectors whose lengths multiply to ``most`` at most; what no long holds becomes the nearest long."""
    if most < DOUBLE:
        return (q.astype("f8") @ p.T.astype("f8")).astype("i8")
    if most < LONG:
        return q @ p.T
    exact = q.astype(object) @ p.T.astype(object)
    return np.clip(exact, NO_FLOOR + 1, 2**63 - 1).astype("i8")


def best_of(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, p_rows: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of a bucket for each query: ties to smaller ids, a query's own row left out."""
    order = np.lexsort((p_rows, p_ids))
    p_rows, p_ids, p = p_rows[order], p_ids[order], p[order]
    p_real, q_real = p.astype("f8"), q.astype("f8")
    p_norm = np.linalg.norm(p_real, axis=1)
    most = float(p_norm.max(initial=0)) * float(np.linalg.norm(q_real, axis=1).max(initial=0)) * (1 + EPS)
    out: list[tuple[np.ndarray, ...]] = []
    whole: list[int] = []

    def take(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (p_rows[rows] != q_rows[i]) & (scores >= floor[i])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ok = scores >= least
            rows, scores = rows[ok], scores[ok]
        best = np.argsort(-scores, kind="stable")[:k]
        out.append((np.full(len(best), q_rows[i]), p_rows[rows[best]], p_ids[rows[best]], scores[best]))

    for i, rows in search(q_real, floor.astype("f8"), p_real, p_norm):
        if len(rows) * 2 > len(p):
            whole.append(i)
        elif len(rows):
            take(i, rows, products(q[i : i + 1], p[rows], most)[0])
    for at in range(0, len(whole), 256):
        some = whole[at : at + 256]
        for i, scores in zip(some, products(q[some], p, most), strict=True):
            take(i, np.arange(len(p)), scores)
    if not out:
        return NOTHING
    return pd.DataFrame(dict(zip(NOTHING.columns, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each bucket for each query, buckets and blocks of queries met as a grid."""

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return NOTHING
        return best_of(left["row"].to_numpy("i8"), _matrix(left["v"]), left["floor"].to_numpy("i8"), right["row"].to_numpy("i8"), right["id"].to_numpy("i8"), _matrix(right["v"]), k)

    key = ["dim", "block", "bucket"]
    # Both sides come from one table; new names tell their columns apart.
    queries = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns]).toDF(*queries.columns)
    candidates = candidates.select([F.col(c).alias(f"p_{c}") for c in candidates.columns]).toDF(*candidates.columns)
    return queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(met, "asked long, row long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of each query with all other rows.

    Candidates are dealt into buckets by length. Every query meets the longest ones first; the k-th best score there is
    a floor, and each further bucket is pruned for it by coordinates or lengths before products are taken. Queries and
    buckets meet as a grid of blocks, so a task holds a bounded part of either.

    Vectors that are null or hold null or non-finite components, rows without an id, and pairs of different lengths take
    no part, nor do vectors with a component that no long holds. Rows that repeat an id and its
    vector count once; a row that repeats an id alone is a candidate, or a query, of its own, also for its id's other rows. Products are exact: in doubles where lengths are small, else in 64-bit or long
    numbers; a score that no long holds is the nearest long. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").distinct()
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # Row numbers are fixed once they are written.
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*", F.size("v").alias("dim"), squares.alias("length2")), "topk-vectors")
    total = rows.count()
    wanted, blocks = max(1, min(RINGS, -(-total // bucket_rows))), max(1, -(-rows.filter("asks").count() // block_rows))
    # Borders by a sketch of lengths; they set the sizes of the rings, not the result. All lists here have RINGS places at most.
    at = [1 - (i + 1) / wanted for i in range(wanted - 1)]
    borders = rows.agg(F.percentile_approx("length2", F.array(*map(F.lit, at)), 10_000)).first()[0] if at and total else []
    border = F.array(*map(F.lit, sorted(set(borders), reverse=True))).cast("array<double>")
    sized = rows.withColumn("ring", F.size(F.filter(border, lambda b: F.col("length2") <= b)))
    counts = {r["ring"]: r["count"] for r in sized.groupBy("ring").count().collect()}
    parts = [max(1, -(-counts.get(i, 0) // bucket_rows)) for i in range(max(counts, default=0) + 1)]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    count = sum(parts)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("ring"))
    number = pick(starts) + F.pmod(F.xxhash64("row"), pick(parts)).cast("int")
    split = sized.withColumn("bucket", number)
    queries = split.filter("asks").select("row", "id", "v", "dim", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    everyone = split.select("row", "id", "v", "dim", "bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = materialize(_best(_meet(queries.withColumn("bucket", F.lit(0)).withColumn("floor", F.lit(NO_FLOOR)), everyone.filter("bucket = 0"), k), k), "topk-first")
    if count <= 1:
        found = first.drop("rank")
    else:
        floors = first.filter(F.col("rank") == k).select(F.col("asked").alias("row"), F.col("score").alias("floor"))
        asking = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
        asking = asking.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(count - 1))))
        found = first.drop("rank").unionByName(_meet(asking, everyone.filter("bucket > 0"), k))
    asked = rows.filter("asks").select(F.col("row").alias("asked"), F.col("id").alias("query_id"))
    return _best(found, k).join(asked, "asked").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
