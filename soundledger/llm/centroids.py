"""Centroid clustering on whole numbers with an incremental distance matrix."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundledger.llm.common import drop_scratch, materialize

CLUSTERS = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
#: Components up to this size keep every product, sum and distance of DIM components inside 64 bits.
SAFE = 1 << 27
#: Whole numbers are summed over tasks in digits of this many bits, which a long holds for 2 ** 23 tasks.
DIGIT = 40

STATE = "kind int, vec_id string, wide boolean, v binary, dots binary, cluster int, distance string, part int, place int, digit int, amount long"


def _whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite double."""
    return math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE


def _pack(rows: np.ndarray) -> list[bytes]:
    """Rows of whole numbers: eight bytes each, or text where they are Python numbers."""
    if rows.dtype == object:
        return [",".join(map(str, r)).encode() for r in rows]
    return [r.tobytes() for r in rows]


def _unpack(cells: pd.Series, wide: bool) -> np.ndarray:
    if wide:
        return np.array([[int(x) for x in c.decode().split(",")] for c in cells], dtype=object)
    return np.frombuffer(b"".join(cells), "i8").reshape(len(cells), -1)


def _fits(centroids: list[list[int]]) -> bool:
    return all(abs(x) <= SAFE for c in centroids for x in c)


def _product(v: np.ndarray, change: list[list[int]]) -> np.ndarray:
    """Products of vectors with the changes of all centroids, over the components that changed in any way."""
    out = np.zeros((len(v), len(change)), v.dtype)
    for k, row in enumerate(change):
        moved = [j for j, x in enumerate(row) if x]
        if moved:
            out[:, k] = v[:, moved] @ np.array([row[j] for j in moved], dtype=v.dtype)
    return out


def _digits(amount: int) -> Iterator[tuple[int, int]]:
    """``amount`` as digits to base 2 ** DIGIT; the last one has the sign."""
    at = 0
    while amount not in (0, -1) and not -(1 << DIGIT) < amount < (1 << DIGIT):
        yield at, amount & ((1 << DIGIT) - 1)
        amount >>= DIGIT
        at += 1
    yield at, amount


def _advance(rows: DataFrame, centroids: list[list[int]], change: list[list[int]], first: bool) -> DataFrame:
    """One pass: products move on by the centroids' changes, every vector goes to its nearest centroid, tasks sum what they hold.

    Rows of kind 0 are vectors with their state. Rows of kind 1 are the digits of a task's sums: places 0 to DIM - 1 are
    components, DIM counts vectors, DIM + 1 sums distances.
    """
    fits = _fits(centroids)
    fitted = _fits([[new - moved for new, moved in zip(a, b, strict=True)] for a, b in zip(centroids, change, strict=True)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(centroids)
        sums = [[0] * (DIM + 2) for _ in range(k)]
        for pdf in batches:
            if first:
                x = np.stack(pdf["e"].to_numpy()).astype("f8") if len(pdf) else np.zeros((0, DIM))
                wide = (np.abs(x) * SCALE > SAFE - 1).any(axis=1)
            else:
                wide = pdf["wide"].to_numpy(bool)
            for is_wide in (False, True):
                at = np.flatnonzero(wide == is_wide)
                if not len(at):
                    continue
                if first:
                    v = np.array([[_whole(c) for c in r] for r in x[at]], dtype=object) if is_wide else np.floor(x[at] * SCALE).astype("i8")
                    dots = None
                else:
                    some = pdf.iloc[at]
                    v, dots = _unpack(some["v"], is_wide), some["dots"]
                # Products with a wide centroid need more than 64 bits, too.
                big = v if is_wide or fits else v.astype(object)
                if first:
                    products = _product(big, centroids)
                elif is_wide or not fitted or not fits:
                    # Products of narrow vectors are small again once all centroids are.
                    products = (_unpack(dots, is_wide or not fitted).astype(object) + _product(v.astype(object), change)).astype(big.dtype)
                else:
                    products = _unpack(dots, False) + _product(v, change)
                norms = np.array([sum(c * c for c in row) for row in centroids], dtype=products.dtype)
                far = norms - 2 * products
                cluster = np.argmin(far, axis=1).astype("i4") if len(far) else np.zeros(0, "i4")
                distance = (big * big).sum(axis=1) + far[np.arange(len(far)), cluster]
                for c in np.unique(cluster):
                    mine = cluster == c
                    total = sums[c]
                    added = v[mine].sum(axis=0)
                    for j in range(DIM):
                        total[j] += int(added[j])
                    total[DIM] += int(mine.sum())
                    total[DIM + 1] += sum(distance[mine].tolist())
                yield pd.DataFrame(
                    {
                        "kind": 0, "vec_id": pdf["vec_id"].iloc[at].to_numpy(), "wide": is_wide, "v": _pack(v), "dots": _pack(products), "cluster": cluster,
                        "distance": [str(d) for d in distance.tolist()], "part": -1, "place": -1, "digit": -1, "amount": 0,
                    }
                )
        made = [(c, place, *digit) for c in range(k) for place, amount in enumerate(sums[c]) if amount for digit in _digits(amount)]
        if made:
            part, place, digit, amount = zip(*made, strict=True)
            n = len(made)
            yield pd.DataFrame(
                {
                    "kind": 1, "vec_id": [None] * n, "wide": False, "v": [None] * n, "dots": [None] * n, "cluster": -1, "distance": None,
                    "part": part, "place": place, "digit": digit, "amount": amount,
                }
            )

    return rows.mapInPandas(work, STATE)


def _sums(state: DataFrame, k: int) -> list[list[int]]:
    """Sums of all tasks by cluster: at most (DIM + 2) places of a few digits a cluster come back."""
    out = [[0] * (DIM + 2) for _ in range(k)]
    for r in state.filter("kind = 1").groupBy("part", "place", "digit").agg(F.sum("amount").alias("amount")).collect():
        out[r["part"]][r["place"]] += r["amount"] << (DIGIT * r["digit"])
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3:") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector with DIM finite components.

    Components become floor(1024 * x). Centroids start as the vectors with the smallest hashes of ``salt`` and id; ties go
    by the vectors themselves, rows without an id come last. Every round assigns vectors to the nearest centroid (the
    smaller number at ties) and moves each centroid that has vectors to the floor of their mean; in the end they are
    assigned once more. All of it is exact.

    A written table holds each vector's products with all centroids. A pass reads it once, adds the products with the
    nonzero component changes of the centroids, takes the smallest distance and writes the next state; sums by cluster are
    made in the same pass and come back as a few numbers. No vector is shuffled. A state goes when the one after the next
    is there. Rounds end early where no centroid changes.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Rows that repeat an id
    are vectors of their own. With fewer vectors than ``clusters``, there are as many clusters as vectors. Components of
    any finite size are computed exactly; a distance or inertia that a long cannot hold is null. Other columns are
    ignored. An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    x = lambda v: v.cast("double")
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("e"))
    # Ids travel as text, never as floats.
    id_type = dict(rows.dtypes)["vec_id"]
    rows = rows.filter(F.col("e").isNotNull() & (F.size("e") == DIM) & ~F.coalesce(odd, F.lit(True)))
    rows = rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.transform("e", x).alias("e"))
    start = rows.select("e", F.sha2(F.concat(F.lit(salt), "vec_id").cast("binary"), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "e").limit(clusters).collect()
    centroids = [[_whole(c) for c in r["e"]] for r in start]
    k = len(centroids)
    if not k:
        empty = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    state = materialize(_advance(rows, centroids, centroids, True), "centroid-state")
    for _ in range(rounds):
        sums = _sums(state, k)
        moved = [[s // total[DIM] for s in total[:DIM]] if total[DIM] else old for total, old in zip(sums, centroids, strict=True)]
        change = [[new - old for new, old in zip(a, b, strict=True)] for a, b in zip(moved, centroids, strict=True)]
        if not any(map(any, change)):
            break
        centroids = moved
        before, state = state, materialize(_advance(state.filter("kind = 0").select("vec_id", "wide", "v", "dots"), centroids, change, False), "centroid-state")
        drop_scratch(before)
    inertia = [total[DIM + 1] for total in _sums(state, k)]
    text = [",".join(map(str, c)) for c in centroids]
    facts = [(c, str(inertia[c]), str(sum(inertia)), hashlib.sha256(text[c].encode()).hexdigest()) for c in range(k)]

    def fact(i: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(y) for f in facts for y in (f[0], f[i])]), F.col("cluster"))

    return state.filter("kind = 0").select(
        F.col("vec_id").cast(id_type).alias("vec_id"), "cluster", F.col("distance").try_cast("long").alias("distance"),
        *[fact(i).try_cast("long").alias(n) for i, n in ((1, "cluster_inertia"), (2, "inertia"))],
        fact(3).alias("centroid_sha256"),
    )


def cluster_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: all distances anew in every round."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) AS place, vec_id, q FROM (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
                WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        ), c0 AS MATERIALIZED (SELECT place - 1 AS cluster, q AS c FROM v WHERE place <= {clusters})"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
            SELECT place, any_value(vec_id) AS vec_id, any_value(q) AS q, min((d, cluster)) AS best FROM (
                SELECT place, vec_id, q, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM v, c{i}
            ) GROUP BY place
        )"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
            SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
                    SELECT best[2] AS cluster, j, CAST(sum(q[j]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{i}, (SELECT unnest(generate_series(1, {DIM})) AS j) GROUP BY ALL
                ) GROUP BY cluster
            ) m USING (cluster)
        )"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM (SELECT vec_id, best[2] AS cluster, best[1] AS d FROM a{rounds}) JOIN c{rounds} USING (cluster)
    """
