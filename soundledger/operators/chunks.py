"""Ordered per-key computations that do not put a whole key into one task.

A device may own a large share of all rows, so a window over the device alone
would sort that share in a single task. Here every key is cut into time chunks:

* rows are windowed inside ``(key, chunk)``,
* each chunk is reduced to one row by a partial aggregate,
* the small chunk table is scanned in order per key, and its carry-in is joined
  back on ``(key, chunk)``, the partitioning the windowed rows already have.

The chunk of a row depends only on its key and time, so a recomputed task gives
the same answer. Cells with more than ``target_rows`` rows are cut where their
running row count passes the target, so that a burst is cut as finely as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundledger.session import shared_dir

CHUNK = "_chunk"
MICROS = 1_000_000
DAY_US = 86_400 * MICROS
DEFAULT_BASE_US = 28 * DAY_US
TARGET_ROWS = 500_000
# Slices of a cell: the finest cut, two seconds of the default cell.
SLICES = 1 << 20

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _keyed(keys: Sequence[str], chunk: Column) -> Column:
    """Chunk number that fails on a null key, which no join would match to its carry-in."""
    for k in keys:
        chunk = F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key column {k}")).cast("bigint")).otherwise(chunk)
    return chunk


def with_chunks(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    base_us: int = DEFAULT_BASE_US,
    target_rows: int = TARGET_ROWS,
    sizes_from: DataFrame | None = None,
    spacing_us: int | None = None,
) -> DataFrame:
    """Add the chunk number of each row, increasing with time inside a key. A row without a key is an error.

    The histogram of (key, coarse bucket) is aggregated before its shuffle. Where
    a cell is above the target, the rows of its slices are counted too, and the
    running count of slices gives the cuts. Counts are taken over ``sizes_from``
    where a cheaper frame has the same bulk of rows, and left out where rows of a
    key are known to be ``spacing_us`` apart and so cannot fill a bucket. Rows of
    one slice stay together.
    """
    keys = list(keys)
    bucket = F.expr(f"({time_us} - pmod({time_us}, {base_us})) div {base_us}")
    if spacing_us is not None and base_us // spacing_us <= target_rows:
        return df.withColumn(CHUNK, _keyed(keys, F.coalesce(bucket * SLICES, F.lit(0))))
    sized = df if sizes_from is None else sizes_from
    timed = sized.filter(F.col(time_us).isNotNull())
    cells = timed.groupBy(*keys, bucket.alias("_bucket")).count().filter(F.col("count") > target_rows).drop("count")
    if not cells.take(1):
        return df.withColumn(CHUNK, _keyed(keys, F.coalesce(bucket * SLICES, F.lit(0))))
    slot = F.expr(f"pmod({time_us}, {base_us}) div greatest(1, {base_us} div {SLICES})")
    # Every row of ``df`` must find its slice, so slices are counted over all of it.
    slots = df.filter(F.col(time_us).isNotNull()).withColumn("_bucket", bucket).join(cells, [*keys, "_bucket"], "left_semi").groupBy(*keys, "_bucket", slot.alias("_slot")).count()
    # A cell has a bounded number of slices, whatever its rows.
    earlier = Window.partitionBy(*keys, "_bucket").orderBy("_slot")
    reached = F.floor((F.sum("count").over(earlier) - 1) / target_rows)
    # A slice opens a chunk where the running count enters the next multiple of the target.
    cuts = slots.select(*keys, "_bucket", "_slot", reached.alias("_cut"))
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_slot", slot)
        .join(cuts, [*keys, "_bucket", "_slot"], "left")
        .withColumn(CHUNK, _keyed(keys, F.coalesce(F.col("_bucket") * SLICES + F.coalesce("_cut", F.lit(0)), F.lit(0))))
        .drop("_bucket", "_slot", "_cut")
    )


def _sorted(cols: Sequence[str], backward: bool) -> list[Column]:
    return [F.col(c).desc() if backward else F.col(c).asc() for c in cols]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    backward: bool = False,
) -> DataFrame:
    """Running sum, count, max or min per key in ``order``, over a frame that already has chunks.

    ``exclusive`` leaves the current row out, ``backward`` runs from the end.
    """
    keys = list(keys)
    cell = [*keys, CHUNK]
    frame = Window.partitionBy(*cell).orderBy(*_sorted(order, backward))
    frame = frame.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    earlier = Window.partitionBy(*keys).orderBy(*_sorted([CHUNK], backward)).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*cell).agg(*[_LOCAL[kind](col).alias(f"_c_{name}") for name, (kind, col) in specs.items()])
    carry = carry.select(*cell, *[_MERGE[k](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in specs.items()])
    local = df.withColumns({name: _LOCAL[kind](col).over(frame) for name, (kind, col) in specs.items()})
    out = local.join(carry, cell, "left")
    merged = {}
    for name, (kind, _) in specs.items():
        here, before = F.col(name), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            merged[name] = F.greatest(here, before) if kind == "max" else F.least(here, before)
    return out.withColumns(merged).drop(*[f"_c_{n}" for n in specs])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    following: bool = False,
) -> DataFrame:
    """Values of the row just before (or just after) each row; null at the ends of a key."""
    keys, order = list(keys), list(order)
    cell = [*keys, CHUNK]
    near = Window.partitionBy(*cell).orderBy(*_sorted(order, following))
    across = Window.partitionBy(*keys).orderBy(*_sorted([CHUNK], following))
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    edge = F.min_by if following else F.max_by
    carry = (
        df.groupBy(*cell)
        .agg(edge(packed, F.struct(*order)).alias("_edge"))
        .withColumn("_edge", F.lag("_edge").over(across))
    )
    out = df.withColumn("_near", F.lag(packed).over(near)).join(carry, cell, "left")
    best = F.coalesce(F.col("_near"), F.col("_edge"))
    return out.withColumns({n: best[n] for n in values}).drop("_near", "_edge")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, backward: bool = False) -> DataFrame:
    """Row number per key, from one."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, backward=backward)


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    outputs: dict[str, "callable"],
    block_rows: int = 65_536,
) -> DataFrame:
    """Aggregates over the last ``rows`` rows of a key, the current one included.

    Rows are numbered, cut into equal blocks, and the tail of each block is
    copied into the next one, so that every frame is complete inside its block.
    """
    keys, order = list(keys), list(order)
    block_rows = max(block_rows, rows)
    n = numbered(df, keys, order, "_rn")
    home = F.expr(f"(_rn - 1) div {block_rows}")
    spill = F.expr(f"(_rn - 1) % {block_rows}") >= block_rows - (rows - 1)
    placed = n.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(spill, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-(rows - 1), 0)
    return (
        placed.withColumns({name: build(frame) for name, build in outputs.items()})
        .filter(F.col("_block") == F.col("_home"))
        .drop("_rn", "_home", "_block", CHUNK)
    )


def number_names(df: DataFrame, name: str, out: str) -> DataFrame:
    """Zero-based position of each row in the order of a unique text column, over the whole frame.

    Rows are range-partitioned by name and checkpointed with their partition, so that the ranges are the same for both
    uses; one count a partition gives the offsets, and rows are numbered inside a partition.
    """
    shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(name).withColumn("_range", F.spark_partition_id()).checkpoint()
    offsets, total = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        offsets.append((r["_range"], total))
        total += r["count"]
    # One row a partition.
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range INT, _off BIGINT"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(name)) - 1
    return ranged.withColumn("_i", here).join(starts, "_range").withColumn(out, F.col("_i") + F.col("_off")).drop("_range", "_i", "_off")
