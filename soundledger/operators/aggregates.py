"""Profile tables: histograms, cross-tabs, summaries, exact percentiles, correlation, threshold picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundledger.functions.scores import TIERS
from soundledger.session import shared_dir

# The level histogram has 32 bins over log2(rms) from 5 to 14.5.
BINS, BIN_LOW, BIN_HIGH = 32, 5.0, 14.5


def class_peaks(frames: DataFrame, keys: Sequence[str], vector: str, classes: dict[int, str]) -> DataFrame:
    """Frame count and per-class max and mean over the frames of a file."""
    score = lambda i: F.get(F.col(vector), F.lit(i))
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[F.max(score(i)).alias(f"max_{n}") for i, n in classes.items()],
        *[F.avg(score(i)).alias(f"mean_{n}") for i, n in classes.items()],
    )


def histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of several columns in one pass over the data; blank values are not counted."""
    sets = df.select(*columns).groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n")
    )
    n = len(columns)
    which = F.element_at(
        F.filter(
            F.array(*[F.when(F.col("_gid").bitwiseAND(1 << (n - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(columns)]),
            lambda x: x.isNotNull(),
        ),
        1,
    )
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    out = sets.select(which.alias("column"), value.alias("value"), "n")
    return out.filter(F.coalesce(F.col("value"), F.lit("")) != "")


def tier_crosstab(df: DataFrame, by: str, tier: str = "tier", levels: Sequence[str] = TIERS, total: bool = True) -> DataFrame:
    """Counts per group and tier with a row total and, on request, a TOTAL line."""
    grouped = df.rollup(by) if total else df.groupBy(by)
    out = grouped.agg(*[F.count_if(F.col(tier) == t).alias(t) for t in levels], F.count(F.lit(1)).alias("total"))
    return out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("TOTAL"))) if total else out


def session_summary(df: DataFrame, session: str, day: Column, tier: str) -> DataFrame:
    return df.groupBy(session).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_if(F.col(tier) == "high_pos").alias("high_pos"),
        F.count_if(F.col(tier) == "high_neg").alias("high_neg"),
    )


def negative_breakdown(df: DataFrame, tier: str, speech: Column, skew: float = 0.65) -> DataFrame:
    """Speech-dominated and other negatives, and whether speech dominates the class."""
    neg = F.col(tier) == "high_neg"
    out = df.agg(F.count_if(neg & (speech >= 0.5)).alias("speech"), F.count_if(neg & (speech < 0.5)).alias("other"))
    share = F.col("speech") / F.greatest(F.col("speech") + F.col("other"), F.lit(1))
    return out.withColumn("skewed", share > skew)


def readiness(df: DataFrame, tier: str, subtype: str, rare: str = "screech", enough: int = 1000, rare_n: int = 10) -> DataFrame:
    """Training readiness: eligible rows, balance, and the two warnings."""
    out = df.agg(
        F.count_if(F.col(tier) == "high_pos").alias("pos"),
        F.count_if(F.col(tier) == "high_neg").alias("neg"),
        F.count_if((F.col(tier) == "high_pos") & (F.col(subtype) == rare)).alias("rare"),
    )
    n = F.col("pos") + F.col("neg")
    share = lambda c: F.expr(f"(100 * {c}) div greatest(pos + neg, 1)")
    return out.select(
        n.alias("eligible"), "pos", "neg", share("pos").alias("pos_pct"), share("neg").alias("neg_pct"),
        (n < enough).alias("too_few"), (F.col("rare") < rare_n).alias("rare_subtype"),
    )


def first_value(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """First non-blank value of each column in row order."""
    filled = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return df.agg(*[F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(order))).alias(c) for c in columns])


# Groups whose sketches, of a fixed size each, may be broadcast.
FEW_GROUPS = 10_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated percentiles per group, as rows (keys, p, value), without holding a group in memory.

    A bounded sketch brackets each percentile. A second pass counts the values
    below the bracket and ranks only the few inside it, so the answer is exact.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    eps = 2.0 / accuracy
    cuts = [x for p in probs for x in (max(0.0, p - eps), min(1.0, p + eps))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("_cut"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    if keys:
        # A sketch has one row a group; few groups go to every task, so that rows of a large group stay where they are.
        shared_dir(df.sparkSession)
        sketch = sketch.checkpoint()
        few = sketch.count() <= FEW_GROUPS
        both = rows.join(F.broadcast(sketch) if few else sketch, keys)
    else:
        both = rows.crossJoin(F.broadcast(sketch))
    low = [F.col("_min") if p - eps <= 0 else F.col("_cut")[2 * i] for i, p in enumerate(probs)]
    high = [F.col("_max") if p + eps >= 1 else F.col("_cut")[2 * i + 1] for i, p in enumerate(probs)]
    v = F.col("_v")
    # Values inside a bracket are counted one by one; those on either side only as a count and
    # the value next to the bracket, which covers ranks that rounding puts just outside it.
    none = F.lit(None).cast("double")
    spot = lambda i, side, x: F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), x.alias("v"))
    place = F.array(
        *[F.when(v < low[i], spot(i, -1, none)).when(v > high[i], spot(i, 1, none)).otherwise(spot(i, 0, v)) for i in range(len(probs))]
    )
    counted = (
        both.select(*keys, "_n", "_v", F.explode(place).alias("_s"))
        .groupBy(*keys, "_n", F.col("_s.i").alias("_i"), F.col("_s.side").alias("_side"), F.col("_s.v").alias("_in"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_v", F.when(F.col("_side") < 0, F.col("_hi")).otherwise(F.col("_lo")))
    )
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("count").over(upto))
    ranked = ranked.withColumn("p", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
    at = F.col("p") * (F.col("_n") - 1)
    out = ranked.groupBy(*keys, "p").agg(
        F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias("_b"),
        F.first(at - F.floor(at)).alias("_t"),
    )
    return out.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("value"))


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Exact percentiles as one column each."""
    long = exact_percentiles(df, keys, value, list(named.values()))
    wide = long.groupBy(*keys) if keys else long.groupBy()
    return wide.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in named.items()])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def threshold_pick(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Midpoint between the worst negative and the weakest positive, and the margin when they do not overlap."""
    out = df.agg(
        F.max(F.when(~positive, F.col(score))).alias("neg_max"), F.min(F.when(positive, F.col(score))).alias("pos_min")
    )
    clear = F.col("neg_max") < F.col("pos_min")
    return out.select(
        "neg_max", "pos_min", ((F.col("neg_max") + F.col("pos_min")) / 2).alias("threshold"),
        F.when(clear, F.col("pos_min") - F.col("neg_max")).alias("margin"), F.when(clear, "SAFE").otherwise("OVERLAP").alias("verdict"),
    )


def level_bin(rms: Column) -> Column:
    lg = F.log2(F.greatest(rms, F.lit(1.0)))
    inner = F.floor((lg - BIN_LOW) * BINS / (BIN_HIGH - BIN_LOW)).cast("int")
    return F.when(lg < BIN_LOW, 0).when(lg >= BIN_HIGH, BINS - 1).otherwise(inner)


def bin_level(b: Column) -> Column:
    return F.pow(F.lit(2.0), F.lit(BIN_LOW) + (BIN_HIGH - BIN_LOW) * (b + 0.5) / BINS)


def level_histogram(df: DataFrame, keys: Sequence[str], rms: str) -> DataFrame:
    """Counts in the 32 level bins as one array per key; a fixed-size partial aggregate."""
    b = level_bin(F.col(rms))
    return df.groupBy(*keys).agg(F.array(*[F.count_if(b == i) for i in range(BINS)]).alias("hist"))


def hist_quantile(hist: Column, p: float) -> Column:
    """Centre of the first bin whose cumulative count reaches floor(n*p)."""
    total = F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, x: a + x)
    target = F.floor(total * F.lit(p))
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.lit(0).alias("i"), F.lit(BINS - 1).alias("hit"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        acc = s["acc"] + x
        now = ~s["done"] & (acc >= target)
        return F.struct(
            acc.alias("acc"), (s["i"] + 1).alias("i"), F.when(now, s["i"]).otherwise(s["hit"]).alias("hit"), (s["done"] | now).alias("done")
        )

    return bin_level(F.aggregate(hist, start, step, lambda s: s["hit"]))


def store_status(files: DataFrame, kind: Column, free_bytes: int, clip_bytes: int, low_space: int = 256 * 1024 * 1024) -> DataFrame:
    """Files and bytes per kind, how many more clips fit, and the low-space flag."""
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(
        "kind", "n", "bytes", F.lit(free_bytes // clip_bytes).cast("bigint").alias("capacity"), F.lit(free_bytes < low_space).alias("low_space")
    )


def rates(df: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """Share of rows per group at which each condition holds."""
    return df.groupBy(group).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])
