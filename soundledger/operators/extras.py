"""Second-wave operators: presence, alerts, logging reduction, gaps, co-occurrence, sampling, assignment by time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.operators import aggregates as A
from soundledger.operators.chunks import CHUNK, neighbour, with_chunks
from soundledger.operators.folds import map_groups, with_entry
from soundledger.operators.joins import as_of_backward, lookup
from soundledger.operators.windows import sustained_level
from soundledger.session import shared_dir


def presence(df: DataFrame, keys: Sequence[str], time_us: str, tie: str, score: str, level: float, sustain_us: int, **chunking) -> DataFrame:
    """Moments at which a class has been above a level for the sustain time."""
    return sustained_level(df, keys, time_us, tie, score, F.lit(level), sustain_us, **chunking)


def urgent_alerts(scores: DataFrame, limits: DataFrame, cls: str, score: str) -> DataFrame:
    """Scores that reach the threshold of their class; classes without a threshold never alert."""
    return lookup(scores, limits, cls, how="inner").filter(F.col(score) >= F.col("threshold"))


def delta_rows(df: DataFrame, keys: Sequence[str], time_us: str, tie: str, scores: str, delta: float = 0.05, **chunking) -> DataFrame:
    """Rows at which some class moved by more than ``delta`` since the last kept row; the first row is always kept.

    What a chunk keeps depends on the last vector kept before it. All chunks are
    folded at once from a guessed entry vector, each hands its last kept vector
    to the next, and chunks are folded again until no entry changes. That point
    is the row-by-row result, since the first chunk's entry is known and every
    round settles at least one more; folds usually meet within a few rows, so
    the rounds are few. Only one vector per chunk travels between rounds.
    """
    keys = list(keys)
    shared_dir(df.sparkSession)
    rows = with_chunks(df.select(*keys, time_us, tie, scores), keys, time_us, **chunking)
    cell = [*keys, CHUNK]
    vector = rows.schema[scores]

    def fold(g: dict) -> tuple[list[int], object]:
        last, kept = g["entry"][0], []
        for i, row in enumerate(g[scores]):
            if last is None or np.abs(row - last).max() > delta:
                kept.append(i)
                last = row
        return kept, last

    def leave(g: dict) -> dict:
        out = np.empty(1, dtype=object)
        out[0] = fold(g)[1]
        return {"entry": out}

    def keep(g: dict) -> dict:
        kept = fold(g)[0]
        return {c: g[c][kept] for c in (time_us, tie, scores)}

    def run(carry: DataFrame, fn, fields: list[T.StructField]) -> DataFrame:
        return map_groups(with_entry(rows, carry, cell), cell, [time_us, tie], fn, fields)

    carry = rows.select(*cell).distinct().withColumn("entry", F.lit(None).cast(vector.dataType))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    while True:
        exits = run(carry, leave, [T.StructField("entry", vector.dataType)])
        moved = exits.withColumn("entry", F.lag("entry").over(across)).checkpoint()
        old = carry.withColumnRenamed("entry", "_old")
        if not moved.join(old, cell).filter(~F.col("entry").eqNullSafe(F.col("_old"))).take(1):
            return run(carry, keep, [rows.schema[c] for c in (time_us, tie, scores)]).drop(CHUNK)
        carry = moved


def counter_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, **chunking) -> DataFrame:
    """Rows after which the counter jumped by more than one, with the number of rows lost; a falling counter is a restart."""
    rows = with_chunks(df, keys, order[0], **chunking)
    rows = neighbour(rows, keys, order, {"_before": F.col(counter)})
    return rows.withColumn("lost", F.col(counter) - F.col("_before") - 1).filter(F.col("lost") > 0).drop("_before", CHUNK)


def roc_points(df: DataFrame, cls: str, score: Column, positive: Column, steps: int = 20) -> DataFrame:
    """True and false positive rates per class at evenly spaced thresholds, from one fixed-size histogram per class."""
    b = F.least(F.floor(score * steps), F.lit(steps)).cast("int")
    cells = range(steps + 1)
    hist = df.groupBy(cls).agg(
        F.array(*[F.count_if(positive & (b == i)) for i in cells]).alias("_p"), F.array(*[F.count_if(~positive & (b == i)) for i in cells]).alias("_n")
    )
    tail = lambda a, i: F.aggregate(F.slice(a, i + 1, steps + 1), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(
            (i / F.lit(float(steps))).alias("threshold"), F.try_divide(tail(F.col("_p"), i), tail(F.col("_p"), F.lit(0))).alias("tpr"),
            F.try_divide(tail(F.col("_n"), i), tail(F.col("_n"), F.lit(0))).alias("fpr"),
        ),
    )
    return hist.select(cls, F.inline(points))


def class_cooccurrence(frames: DataFrame, scores: Column, names: Sequence[str], level: float) -> DataFrame:
    """How many frames have both classes of each pair above the level.

    The pairs are those of a fixed class list inside one row, counted before any shuffle.
    """
    active = F.filter(F.transform(scores, lambda x, i: F.when(x > level, i)), lambda i: i.isNotNull())
    pairs = F.flatten(F.transform(active, lambda a: F.transform(F.filter(active, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    label = F.array(*[F.lit(n) for n in names])
    counted = frames.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.get(label, F.col("a")).alias("class_a"), F.get(label, F.col("b")).alias("class_b"), "n")


def diurnal_p95(df: DataFrame, cls: str, hour: str, score: str) -> DataFrame:
    return A.percentile_columns(df, [cls, hour], score, {"p95": 0.95})


def false_positives(df: DataFrame, cls: str, score: Column, positive: Column, level: float) -> DataFrame:
    """What fires without a cause: counts and peak per class."""
    return df.filter(~positive & (score >= level)).groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("peak"))


def class_hits(df: DataFrame, keys: Sequence[str], score: Column, level: float = 0.60) -> DataFrame:
    """Hits at or above the level, and the peak, per class and period."""
    return df.groupBy(*keys).agg(F.count_if(score >= level).alias("hits"), F.max(score).alias("peak"))


def assign_sessions(df: DataFrame, sessions: DataFrame, keys: Sequence[str], time_us: str, **chunking) -> DataFrame:
    """Session whose interval holds each row; sessions of a device do not overlap, an open one has a null end."""
    starts = sessions.select(*keys, F.col("start_us").alias(time_us), "session", "end_us")
    out = as_of_backward(df, starts, keys, time_us, ["session", "end_us"], **chunking)
    inside = F.col("end_us").isNull() | (F.col(time_us) < F.col("end_us"))
    return out.withColumn("session", F.when(inside, F.col("session"))).drop("end_us", "as_of_us")


def probability_scale(conf: Column, scale: Column) -> Column:
    """Scores of old builds were squashed once too often; undo that, and leave the others alone."""
    from soundledger.functions.scores import inverse_sigmoid

    return F.when(scale == "sigmoid_squashed", inverse_sigmoid(conf)).otherwise(conf)


def curated_clips(segments: DataFrame, score: str = "score", hnr: str = "hnr_db") -> DataFrame:
    """Segments worth keeping as clips."""
    return segments.filter((F.col(score) > 0.6) & (F.col(hnr) > 6))


def agreement_report(df: DataFrame, by: Sequence[str], teacher: str, student: str, ambient: Column, needed: float = 0.85, margin: float = 0.05) -> DataFrame:
    """Frame correlation of two models, whether it suffices, and a threshold just above the ambient peak."""
    out = df.groupBy(*by).agg(
        A.correlation(F.col(teacher), F.col(student)).alias("r"), (F.max(F.when(ambient, F.col(student))) + margin).alias("threshold")
    )
    return out.withColumn("accepted", F.coalesce(F.col("r") >= needed, F.lit(False)))


def tag_context(captures: DataFrame, events: DataFrame, keys: Sequence[str], time_s: str, window_s: int, cls: str = "cls") -> DataFrame:
    """Kinds of context events within the window of each capture, as a sorted list.

    Events are reduced to distinct (key, second, kind) and marked in every time
    bucket they reach; a capture reads its own bucket only. Kinds are a small
    vocabulary, so a capture meets at most one row per kind and second.
    """
    keys = list(keys)
    bucket = lambda t: F.floor(t / window_s)
    # Per bucket and kind the first and last second suffice to test any capture from outside the bucket,
    # and inside its own bucket every event is within the window.
    spans = events.groupBy(*keys, bucket(F.col(time_s)).alias("_b"), cls).agg(F.min(time_s).alias("_lo"), F.max(time_s).alias("_hi"))
    reach = spans.withColumn("_off", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_bucket", F.col("_b") + F.col("_off"))
    table = reach.groupBy(*keys, "_bucket").agg(F.collect_list(F.struct(F.col(cls).alias("c"), "_off", "_lo", "_hi")).alias("_near"))
    rows = captures.withColumn("_bucket", bucket(F.col(time_s))).join(table, [*keys, "_bucket"], "left")
    t = F.col(time_s)
    hit = lambda e: (e["_off"] == 0) | ((e["_off"] == 1) & (e["_hi"] >= t - window_s)) | ((e["_off"] == -1) & (e["_lo"] <= t + window_s))
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("_near", hit), lambda e: e["c"])))
    return rows.withColumn("context", F.coalesce(kinds, F.array().cast("array<string>"))).drop("_bucket", "_near")


def public_view(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the allowed fields, whatever else a table gains."""
    return df.select(*[c for c in df.columns if c in allowed])


def calibration_sample(patches: DataFrame, key: str, patch: str, n: int, cells: int, seed: int = 0) -> DataFrame:
    """``n`` patches in seeded hash order, topped up with synthetic ones where there are fewer."""
    real = patches.select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("_h"), key, patch).orderBy("_h", key).limit(n).select(patch, F.lit(False).alias("synthetic"))
    unit = lambda i, part: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(part)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda i: F.sqrt(-2.0 * F.ln(unit(i, 0))) * F.cos(2 * np.pi * unit(i, 1))
    noise = F.transform(F.sequence(F.lit(1), F.lit(cells)), lambda i: (normal(i) * 3.0 - 5.0).cast("float"))
    made = patches.sparkSession.range(n).select(noise.alias(patch), F.lit(True).alias("synthetic"))
    return real.unionByName(made).orderBy("synthetic").limit(n)
