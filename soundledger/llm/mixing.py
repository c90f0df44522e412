"""Mix sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundledger.llm.common import materialize

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: By place in WEIGHTS: the change of a source's share over the training time, from -1 (early) to 1 (late).
SLOPES = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, max_passes: int = MAX_PASSES) -> DataFrame:
    """``(source, source_size)`` with ``target`` and ``slope``: weighted shares of all sizes, none above ``max_passes`` times its source.

    Sources whose limit is low for their weight fill up first; the level at which the others share the rest is the first
    that the next source does not reach. One row a source is ordered in one task, no document is.
    """
    turn = ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int")
    ranked = sizes.withColumn("turn", turn).select(
        "source",
        "source_size",
        F.get(F.array(*map(F.lit, weights)), "turn").cast("double").alias("w"),
        F.get(F.array(*map(F.lit, slopes)), "turn").alias("slope"),
        (max_passes * F.col("source_size")).cast("double").alias("most"),
    )
    by_ratio = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    level = (F.sum("most").over(W.partitionBy()) / max_passes - (F.sum("most").over(by_ratio) - F.col("most"))) / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))).over(W.partitionBy())
    target = F.least("most", F.col("w") * first["level"])
    return levels.select("source", "source_size", "slope", target.alias("target"))


def arrival(u: Column, slope: Column) -> Column:
    """Time in 0..1 at which a source's cumulative demand ``t + slope * (t * t - t)`` reaches the share ``u``."""
    half = 1 - slope
    return F.when(slope == 0, u).otherwise((F.sqrt(half * half + 4 * slope * u) - half) / F.when(slope == 0, 1).otherwise(2 * slope))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule: object) -> DataFrame:
    """``docs`` with a struct ``__mix``: size, source_size, target, part, passes, times (one for each pass, the last maybe partial), bucket and row (of its order).

    Within a source, documents follow a hash of their ids. Whole passes are taken first; the next pass goes as far in
    that order as the target asks, the last document in part. A pass starts at the time at which the source's demand
    reaches it. Null texts have size 0, null ids hash as empty text, a null source is a source of its own, equal rows
    follow one another. An empty table gives no rows.

    The order needs no sort of a whole source: sizes are summed by source and hash prefix, prefixes are accumulated, and
    rows are ordered inside one prefix. The number of prefixes grows with the square root of the rows.
    """
    digits = max(1, -(-(max(docs.count(), 1).bit_length() // 2) // 4))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.withColumn("__size", word_count(F.col(text_col))).withColumn("__key", key)
    cell = [F.col(source_col).alias("source"), F.substring("__key", 1, digits).alias("bucket")]
    cells = materialize(sized.groupBy(*cell).agg(F.sum("__size").alias("words")), "mix-cells")
    targets = materialize(source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), **rule), "mix-targets")
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = cells.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__start"))
    targets = targets.select(F.col("source").alias("__t"), "source_size", "slope", "target")
    places = materialize(starts.join(targets, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t"), "mix-places")
    # One key for window and join, so that texts are shuffled once for both: a struct is equal where both sources are null,
    # and needs no cast where neither bucket may be null.
    place = F.struct("__s", F.coalesce("__b", F.lit("")).alias("__b"))
    order = W.partitionBy("__cell").orderBy("__key", id_col, "__size")
    own = order.rowsBetween(W.unboundedPreceding, -1)
    met = sized.withColumn("__cell", F.struct(cell[0].alias("__s"), cell[1].alias("__b")))
    met = met.withColumn("__before", F.coalesce(F.sum("__size").over(own), F.lit(0))).withColumn("__row", F.row_number().over(order))
    met = met.join(places.withColumn("__place", place), F.col("__cell") == F.col("__place")).withColumn("__before", F.col("__start") + F.col("__before"))
    need = F.floor(F.col("target") + 0.5)
    whole = F.coalesce(F.try_divide(need, F.col("source_size")).cast("long"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__need") - F.col("__whole") * F.col("source_size") - F.col("__before")))
    met = met.withColumn("__need", need).withColumn("__whole", whole).withColumn("__part", part)
    passes = F.col("__whole") + (F.col("__part") > 0).cast("long")
    share = lambda i: F.try_divide(i * F.col("source_size") + F.col("__before"), F.col("__need").cast("double"))
    times = F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), lambda i: arrival(F.coalesce(share(i), F.lit(0.0)), F.col("slope"))))
    plan = F.struct(
        F.col("__size").alias("size"),
        "source_size",
        "target",
        F.col("__part").alias("part"),
        F.col("__whole").alias("passes"),
        F.coalesce(times, F.array().cast("array<double>")).alias("times"),
        F.col("__b").alias("bucket"),
        F.col("__row").alias("row"),
    )
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], plan.alias("__mix"))


def mixed_passes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule: object) -> DataFrame:
    """The rows of :func:`mix` once for every pass, with its ``__time`` and its ``__words``, the number of words it takes.

    A row without a pass stays once, and what has no time is not taken: both have null words.
    """
    placed = mix(docs, id_col, text_col, source_col, **rule).select("*", F.posexplode_outer("__mix.times").alias("__pass", "__time"))
    words = F.when(F.col("__pass") == F.col("__mix.passes"), F.col("__mix.part")).otherwise(F.col("__mix.size"))
    return placed.withColumn("__words", F.when(F.col("__time").isNotNull(), words))


def ordered_passes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule: object) -> DataFrame:
    """The rows of :func:`mixed_passes`, range-sorted by training time; the text of each has the words that its pass takes.

    A row that is not taken has no text and stands behind the others.
    """
    passes = mixed_passes(docs, id_col, text_col, source_col, **rule)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__words").cast("int")), " ")
    text = F.when(F.col("__words") < F.col("__mix.size"), cut).when(F.col("__words").isNotNull(), F.col(text_col))
    order = [F.col("__time").asc_nulls_last(), F.col(id_col)]
    return passes.withColumn(text_col, text).repartitionByRange(*order).sortWithinPartitions(*order)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule: object) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, first_time)`` for each row, sorted by ``first_time``; rows that are not taken come last.

    The mix is carried out, see :func:`ordered_passes`, and ``taken`` counts the words in the texts of its passes, which
    are written in training order without their texts.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    plan = [F.col(f"__mix.{c}").alias(c) for c in ("bucket", "row", "size", "source_size", "target")]
    passes = materialize(ordered_passes(own, **rule).select("doc_id", "source", *plan, word_count(F.col("text")).alias("words"), "__time"), "mix-passes")
    rows = passes.groupBy("source", "bucket", "row", "doc_id", "size", "source_size", "target")
    counted = rows.agg(F.sum("words").alias("taken"), F.min("__time").alias("first_time"))
    return counted.orderBy(F.col("first_time").asc_nulls_last(), "doc_id").drop("source", "bucket", "row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule: object) -> DataFrame:
    """A row of ``docs``, all its columns, for every pass that the mix takes, range-sorted by training time.

    Where a source's last pass ends inside a document, that row's text has the taken words only (and ``n_chars``, if
    there is such a column, their length). Rows of size 0 go along with each whole pass of their source, at its place.
    """
    taken = ordered_passes(docs, id_col, text_col, source_col, **rule).filter(F.col("__words").isNotNull())
    out = {}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("__words") < F.col("__mix.size"), F.length(F.col(text_col))).otherwise(F.col("n_chars"))
        out["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return taken.select(*[(out[c].alias(c) if c in out else F.col(f"`{c}`")) for c in docs.columns])
