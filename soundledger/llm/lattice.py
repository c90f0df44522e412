"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundledger.llm.blocks import GROUP, block_pairs, pair_blocks, spanning
from soundledger.llm.common import group_starts, materialize, whole_groups
from soundledger.llm.graph import connected_components

THRESHOLD = 0.9
TABLES = 8
#: E8 points that make one key: two give about the square of one point's cells.
POINTS = 2
#: Length of one lattice unit against a projected unit vector, whose components have variance 1.
CELL = 2.4
SEED = 11


def e8_nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest of four likely E8 points to each row, as twice their coordinates.

    E8 is D8 (whole coordinates of even sum) and D8 moved by one half. In either, coordinates are rounded; if their sum
    is odd the one rounded worst goes the other way, and the next choice moves the next worst as well or instead.
    """
    rows = np.arange(len(x))
    points, far = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        near = np.rint(y)
        off = y - near
        worst = np.argsort(-np.abs(off), axis=1)
        step = np.where(off >= 0, 1.0, -1.0)
        odd = near.sum(axis=1) % 2 != 0
        first, second = near.copy(), near.copy()
        first[rows[odd], worst[odd, 0]] += step[odd, worst[odd, 0]]
        second[rows[odd], worst[odd, 1]] += step[odd, worst[odd, 1]]
        even = ~odd
        for j in (0, 1):
            second[rows[even], worst[even, j]] += step[even, worst[even, j]]
        for p in (first, second):
            points.append(np.rint(2 * (p + shift)).astype("i8"))
            far.append(((y - p) ** 2).sum(axis=1))
    order = np.argsort(np.stack(far), axis=0, kind="stable")
    stack = np.stack(points)
    return stack[order[0], rows], stack[order[1], rows]


@functools.lru_cache(maxsize=8)
def _planes(dim: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables, POINTS, dim, 8))


@functools.lru_cache(maxsize=1)
def _mixers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 62, (POINTS, 8), dtype="i8").view("u8") | np.uint64(1)


def lattice_keys(unit: np.ndarray, tables: int = TABLES, cell: float = CELL, seed: int = SEED) -> np.ndarray:
    """Keys (rows, tables, 4) of unit vectors: their own cell and the neighbouring cells probed, as 32-bit hashes of lattice points.

    Two cells of one table with one hash are one cell: that adds pairs to verify and loses none.
    """
    planes, mix = _planes(unit.shape[1], tables, seed), _mixers()
    keys = np.empty((len(unit), tables, 4), "i4")
    for t in range(tables):
        codes = []
        for j in range(POINTS):
            best, other = e8_nearest(unit @ planes[t, j] / cell)
            codes.append([(p.view("u8") * mix[j]).sum(axis=1, dtype="u8") for p in (best, other)])
        for n, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            h = codes[0][a] ^ (codes[1][b] << np.uint64(1)) ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
            keys[:, t, n] = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype("u4").view("i4")
    return keys


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Not null, no component null or not finite, not zero."""
    x = lambda v: v.cast("double")
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def similar_links(classes: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, block: int = 1024, cell: float = CELL) -> DataFrame:
    """``(u, v, links)`` from ``(rep, n, v)``: links that span all pairs found, and, with a null ``v``, parts of a vector's number of links.

    A pair is counted in the first of its common cells only, so no list of pairs is needed to count each once: both rows
    carry all their keys.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, some in pdf.groupby(pdf["v"].map(len), sort=True):
                for at in range(0, len(some), 1000):
                    part = some.iloc[at : at + 1000]
                    x = np.stack(part["v"].to_numpy()).astype("f8")
                    keys = lattice_keys(_unit(x), tables, cell).reshape(len(x), -1)
                    slots = keys.shape[1]
                    # Components that single precision holds exactly travel in it.
                    single = bool((x.astype("f4") == x).all())
                    vectors = [v.tobytes() for v in (x.astype("f4") if single else x)]
                    table = (np.arange(slots) // 4).astype("i8") << 32
                    fresh = np.ones(keys.shape, bool)
                    for c in range(slots):
                        for before in range(c // 4 * 4, c):
                            fresh[:, c] &= keys[:, before] != keys[:, c]
                    made = pd.DataFrame(
                        {
                            "key": (keys.astype("i8") & 0xFFFFFFFF | table).T.ravel(), "rep": np.tile(part["rep"].to_numpy("i8"), slots), "n": np.tile(part["n"].to_numpy("i8"), slots),
                            "keys": [k.tobytes() for k in keys] * slots, "single": single, "x": vectors * slots,
                        }
                    )
                    yield made[fresh.T.ravel()]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, GROUP):
            starts = group_starts(pdf, GROUP)
            # Rows alone in their cell have nothing to compare.
            crowd = np.repeat(np.diff(starts) > 1, np.diff(starts))
            if not crowd.any():
                continue
            dim = pdf["x"].map(len).to_numpy() // np.where(pdf["single"], 4, 8)
            for d in np.unique(dim[crowd]):
                some = pdf[crowd & (dim == d)].reset_index(drop=True)
                x = _unit(np.stack([np.frombuffer(v, "f4" if one else "f8").astype("f8") for v, one in zip(some["x"], some["single"], strict=True)]))
                keys = np.frombuffer(b"".join(some["keys"]), "i4").reshape(len(some), -1)
                rep, n, here = (some[c].to_numpy("i8") for c in ("rep", "n", "key"))
                count = np.zeros(len(some), "i8")
                found_a, found_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
                for a, b in block_pairs(group_starts(some, GROUP), *(some[c].to_numpy() for c in ("part", "low", "high")), most=1 << 16):
                    near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    a, b = a[near], b[near]
                    # The pair's first common key in the order of the first row's keys decides where it counts.
                    first = np.full(len(a), -1, "i8")
                    a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
                    open_rows = np.arange(len(a))
                    for c in range(keys.shape[1]):
                        mine = keys[a[open_rows], c]
                        table = c // 4 * 4
                        hit = (keys[b[open_rows], table : table + 4] == mine[:, None]).any(axis=1)
                        first[open_rows[hit]] = mine[hit].astype("i8") & 0xFFFFFFFF | (c // 4 << 32)
                        open_rows = open_rows[~hit]
                        if not len(open_rows):
                            break
                    once = (first == here[a]) & (rep[a] != rep[b])
                    a, b = a[once], b[once]
                    np.add.at(count, a, n[b])
                    np.add.at(count, b, n[a])
                    found_a.append(a)
                    found_b.append(b)
                # Rows of one vector in several cells stay apart here; the links join them.
                root = spanning(len(some), np.concatenate(found_a), np.concatenate(found_b))
                at = np.flatnonzero(root != np.arange(len(root)))
                links = pd.DataFrame({"u": rep[at], "v": pd.array(rep[root[at]], dtype="Int64"), "links": 0}).drop_duplicates()
                at = np.flatnonzero(count)
                counts = pd.DataFrame({"u": rep[at], "v": pd.array([pd.NA] * len(at), dtype="Int64"), "links": count[at]})
                yield pd.concat([links, counts], ignore_index=True)

    rows = classes.mapInPandas(index, "key long, rep long, n long, keys binary, single boolean, x binary")
    return pair_blocks(rows, "rep", block).mapInPandas(compare, "u long, v long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, block: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Equal vectors form a class first and link with one another. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. A row without an id links with nothing and has no
    component. Rows that repeat id and vector count as one vector and are all returned. Other columns are ignored. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    good = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("e"))).select("vec_id", F.transform("e", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    classes = materialize(good.distinct().groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    # Two classes share a smallest id if one id has two vectors, so a class goes by a number of its own, fixed once written.
    marks = lambda e: [F.xxhash64(e).alias("k1"), F.xxhash64(F.lit(2), e).alias("k2")]
    named = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "rep", "n", "e", *marks(F.col("e"))), "vector-nodes")
    found = materialize(similar_links(named.select(F.col("node").alias("rep"), "n", F.col("e").alias("v")), threshold, tables, block), "vector-links")
    sums = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("v IS NOT NULL").select("u", "v"))
    met = named.drop("e").join(sums, "node", "left").join(roots, "node", "left")
    met = met.select("k1", "k2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    met = materialize(met, "vector-met")
    least = materialize(met.groupBy("root").agg(F.min("rep").alias("component_id")), "vector-least")
    ended = materialize(met.join(least, "root").select("k1", "k2", "n_links", "component_id"), "vector-ends")
    whole = F.when(F.col("vec_id").isNotNull() & _usable(F.col("e")), F.transform("e", lambda x: x.cast("double") + F.lit(0.0)))
    keyed = rows.select("vec_id", whole.alias("e")).select("vec_id", *[F.when(F.col("e").isNotNull(), k).alias(n) for k, n in zip(marks(F.col("e")), ("k1", "k2"), strict=True)])
    out = keyed.join(ended, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
