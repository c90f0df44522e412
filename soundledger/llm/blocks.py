"""All pairs inside posting lists, in blocks of a bounded size and without emitting pairs.

A list longer than ``block`` rows is cut into hashed blocks; every pair of blocks becomes a group of its own, so that the
longest list is shared by many tasks and none holds more than about two blocks of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundledger.llm.common import materialize

GROUP = ["key", "low", "high"]


def pair_blocks(index: DataFrame, member: str, block: int = 1024) -> DataFrame:
    """Deal rows ``(key, member, ...)`` out as groups ``(key, low, high)``, sorted, each row with its own ``part``.

    Only the lengths of long lists are looked up; Spark splits that join's hot keys or broadcasts it by measured size.
    """
    long_lists = materialize(
        index.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts")),
        "long-lists",
    )
    parts = F.coalesce("parts", F.lit(1))
    return (
        index.join(long_lists, "key", "left")
        .withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
        .drop("other", "parts")
        .repartition(*GROUP)
        .sortWithinPartitions(*GROUP)
    )


def block_pairs(starts: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each group, a bounded number at a time: within a block, or across its two blocks.

    Short groups are paired together by row distance, long ones by rows of their rectangle.
    """
    sizes = np.diff(starts)
    long_at = np.flatnonzero(sizes > 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= 64))
    reach = 1
    while len(rows):
        rows = rows[(starts[group[rows] + 1] - rows) > reach]
        a, b = rows, rows + reach
        ok = (low[a] == high[a]) | (part[a] != part[b])
        for i in range(0, len(a), most):
            cut = ok[i : i + most]
            if cut.any():
                yield a[i : i + most][cut], b[i : i + most][cut]
        reach += 1
    for g in long_at:
        members = np.arange(starts[g], starts[g + 1])
        if low[members[0]] == high[members[0]]:
            step = max(1, most // len(members))
            for i in range(0, len(members), step):
                a, b = np.meshgrid(members[i : i + step], members, indexing="ij")
                ok = a < b
                yield a[ok], b[ok]
        else:
            left, right = members[part[members] == low[members[0]]], members[part[members] == high[members[0]]]
            step = max(1, most // max(1, len(right)))
            for i in range(0, len(left), step):
                a, b = np.meshgrid(left[i : i + step], right, indexing="ij")
                yield a.ravel(), b.ravel()


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest linked row of each of n rows, given links between rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
