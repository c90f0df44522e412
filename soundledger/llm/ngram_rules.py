"""Quality rules by n-gram perplexity: a modified Kneser-Ney model counted by Spark, kept in sorted hash arrays."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundledger.llm.common import bound_batches, materialize
from soundledger.llm.warc import _folder

#: Bytes of a gram: the last one and what stands before it.
ORDER = 5
#: A byte that no UTF-8 text holds before it, another behind it.
PAD, END = 0xFE, 0xFF
#: Byte values that may follow a context: all bytes and the end.
SYMBOLS = 257
#: Costs are whole numbers of 2 ** -UNIT bits, so that sums don't depend on order.
UNIT = 16
#: Distinct grams that a counting task holds before it passes them on.
HELD = 1 << 20
#: Bytes of text turned to grams at once, and bytes of text whose distinct grams are looked up together.
CHUNK = 1 << 20
BLOCK = 32 << 20
#: Entries of one piece of the arrays: a task holds one piece at a time.
PIECE = 1 << 22
#: Bands reach these many times the distance of the quartiles below and above them: short texts vary more to the low side.
REACH = (4.0, 2.0)
MIN_WORDS = 50
#: Bins of the bands, a bit a byte.
BINS = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BACK = 0x10


# ---- base counts -------------------------------------------------------------------------------------------------


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows of three words."""
    words = raw.split()
    n = len(words)
    starts = len(raw) - sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = starts - int(((np.frombuffer(raw, "u1") & 0xC0) == 0x80).sum())
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    again = 0
    if n > 2:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "i8", n)
        pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
        _, which, count = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[which] > 1)
        hit = np.zeros(n, bool)
        for j in range(3):
            hit[twice + j] = True
        again = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), again


# ---- grams -------------------------------------------------------------------------------------------------------


def text_grams(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of whole texts, each byte and the end once: (grams, numbers of the texts, first gram of each run of one text)."""
    pad = bytes([PAD]) * (order - 1)
    runs: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        raw = pad + text + bytes([END])
        for at in range(0, len(raw) - order + 1, CHUNK):
            runs.append((i, raw[at : at + CHUNK + order - 1]))
            held += len(runs[-1][1])
            if held >= CHUNK:
                yield _grams(runs, order)
                runs, held = [], 0
    if runs:
        yield _grams(runs, order)


def _grams(runs: list[tuple[int, bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(r[1] for r in runs), "u1").astype("u8")
    n = len(raw) - order + 1
    grams = raw[order - 1 :].copy()
    for j in range(1, order):
        grams |= raw[order - 1 - j : order - 1 - j + n] << np.uint64(8 * j)
    sizes = np.array([len(r[1]) - order + 1 for r in runs])
    if len(runs) > 1:
        # Windows across two runs go.
        keep = np.ones(n, bool)
        ends = np.cumsum(sizes + order - 1)[:-1] - (order - 1)
        for j in range(order - 1):
            keep[ends + j] = False
        grams = grams[keep]
    return grams, np.array([r[0] for r in runs]), np.cumsum(sizes) - sizes


def fold(text: bytes) -> int:
    """Half of a text: equal texts are in one half, and the other half's model scores them."""
    return zlib.crc32(text) & 1


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(f, g, c)``: how often each gram stands in the texts ``t`` of each half; tasks count before the shuffle."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        distinct, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return distinct, np.bincount(which, np.concatenate([h[1] for h in held])).astype("i8")

    def rows(f: int, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"f": np.full(len(grams), f, "i4"), "g": grams.astype("i8"), "c": n})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            raw = [t.encode() for t in batch.column("t").to_pylist()]
            for f in (0, 1):
                for grams, _, _ in text_grams([r for r in raw if fold(r) == f], order):
                    held[f].append(np.unique(grams, return_counts=True))
                    if sum(len(h[0]) for h in held[f]) > HELD:
                        merged = summed(held[f])
                        held[f].clear()
                        if len(merged[0]) > HELD // 2:
                            yield rows(f, *merged)
                        else:
                            held[f].append(merged)
        for f in (0, 1):
            if held[f]:
                yield rows(f, *summed(held[f]))

    return texts.select("t").mapInArrow(work, "f int, g long, c long").groupBy("f", "g").agg(F.sum("c").alias("c"))


# ---- model -------------------------------------------------------------------------------------------------------


@dataclass
class KneserNey:
    """Files of the sorted hash arrays, and how many orders they hold."""

    files: list[str]
    order: int


def _mark(order: int, back: bool = False) -> int:
    return (order | (_BACK if back else 0)) << 56


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the numbers of grams that stand once to four times.

    Where such a number is missing the discount is half of the count it is taken from, at most one half.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5
        out.append(min(max(d, 0.1), k - 0.1))
    return out


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(key, value)``: costs of all grams of all orders, and costs of stepping back from their contexts, in units.

    A gram of a lower order counts the bytes that stand before it, except at the start of a text, where it counts itself.
    A context has at most 257 grams and a gram at most 257 longer ones, so windows and joins have no hot key.
    """
    tables = [counts]
    for n in range(order - 1, 0, -1):
        short = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
        at_start = F.shiftright(short, 8 * (n - 1)) == PAD
        tables.insert(0, materialize(tables[0].groupBy(short.alias("g")).agg(F.sum(F.when(at_start, F.col("c")).otherwise(1)).alias("c")), f"ngram-{n}"))
    lower = None
    out = []
    for n, table in enumerate(tables, 1):
        seen = table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
        d = discounts(list(seen))
        context = W.partitionBy("x")
        rows = table.withColumn("x", F.shiftright("g", 8))
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = rows.select("g", "x", "c", less.alias("d"), F.sum("c").over(context).alias("all"), F.sum(less).over(context).alias("taken"))
        gamma = F.col("taken") / F.col("all")
        if lower is None:
            below = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            below = rows.join(lower, F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)) == F.col("s"))
        met = below.select("g", "x", gamma.alias("gamma"), ((F.col("c") - F.col("d")) / F.col("all") + gamma * F.col("below")).alias("p"))
        met = materialize(met, f"ngram-p{n}")
        lower = met.select(F.col("g").alias("s"), F.col("p").alias("below"))

        def units(p: Column) -> Column:
            return F.round(-F.log2(p) * (1 << UNIT)).cast("int")

        out.append(met.select((F.col("g") + F.lit(_mark(n))).alias("key"), units(F.col("p")).alias("value")))
        out.append(met.select("x", "gamma").distinct().select((F.col("x") + F.lit(_mark(n, True))).alias("key"), units(F.col("gamma")).alias("value")))
    return functools.reduce(DataFrame.unionByName, out)


def hashed(keys: np.ndarray) -> np.ndarray:
    return keys.astype("u8") * _MIX


def sorted_arrays(table: DataFrame, piece: int = PIECE) -> list[str]:
    """Files of ``(key, value)`` as sorted hash arrays, one for each range of hashes."""
    pieces, size = 1, table.count()
    while pieces * piece < size:
        pieces *= 2
    shift = np.uint64(64 - pieces.bit_length() + 1)

    def place(key: pd.Series) -> pd.Series:
        return pd.Series((hashed(key.to_numpy()) >> shift if pieces > 1 else np.zeros(len(key))).astype("i4"))

    def arrays(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hashed(pdf["key"].to_numpy())
        at = np.argsort(h)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "hashes": [h[at].tobytes()], "costs": [pdf["value"].to_numpy("i4")[at].tobytes()]})

    placed = table.withColumn("piece", F.pandas_udf(place, "int")("key"))
    stored = materialize(placed.groupBy("piece").applyInPandas(arrays, "piece int, hashes binary, costs binary"), "ngram-arrays")
    return sorted(stored.inputFiles()) if size else []


def train(texts: DataFrame, order: int = ORDER, piece: int = PIECE) -> tuple[KneserNey, KneserNey]:
    """Models of the two halves of all rows of ``(t)``. A model that has seen a text knows its odd grams, so each half is scored by the other's."""
    counts = materialize(gram_counts(texts, order), f"ngram-{order}")
    made = [materialize(kneser_ney(counts.filter(F.col("f") == f).select("g", "c"), order), "ngram-costs") for f in (0, 1)]
    return tuple(KneserNey(sorted_arrays(table, piece), order) for table in made)


@functools.lru_cache(maxsize=2)
def _opened(file: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pieces in one file, read from the shared folder."""
    import pyarrow.parquet as pq

    fs, path = _folder(file)
    out = pq.read_table(fs.open_input_file(path)).to_pydict()
    return [(np.frombuffer(h, "u8"), np.frombuffer(c, "i4")) for h, c in zip(out["hashes"], out["costs"], strict=True)]


def gram_costs(grams: np.ndarray, model: KneserNey) -> np.ndarray:
    """Costs of distinct grams in units: of the longest known ending, and of stepping back from each longer context that is known.

    Pieces are read one after the other, whatever their number.
    """
    order = model.order
    masked = [grams & np.uint64((1 << 8 * n) - 1) for n in range(order + 1)]
    found = np.full((order + 1, len(grams)), -1, "i8")
    back = np.zeros((order + 1, len(grams)), "i8")
    keys = [hashed(masked[n] + np.uint64(_mark(n))) for n in range(1, order + 1)]
    contexts = [hashed((masked[n] >> np.uint64(8)) + np.uint64(_mark(n, True))) for n in range(1, order + 1)]
    for file in model.files:
        for h, c in _opened(file):
            todo = np.arange(len(grams))
            for n in range(order, 0, -1):
                at = np.minimum(np.searchsorted(h, keys[n - 1][todo]), len(h) - 1)
                hit = h[at] == keys[n - 1][todo]
                found[n, todo[hit]] = c[at[hit]]
                # What is known of an order needs no lower one, which may lie in another piece, too.
                todo = todo[~hit]
                if not len(todo):
                    break
                at = np.minimum(np.searchsorted(h, contexts[n - 1][todo]), len(h) - 1)
                hit = h[at] == contexts[n - 1][todo]
                back[n, todo[hit]] = c[at[hit]]
    cost = np.full(len(grams), round(np.log2(SYMBOLS) * (1 << UNIT)), "i8")
    for n in range(1, order + 1):
        cost = np.where(found[n] >= 0, found[n], cost + back[n])
    return cost


class _Costs:
    """Costs of a block's distinct grams: most are found at their place of a table, the others by search."""

    def __init__(self, grams: np.ndarray, model: KneserNey) -> None:
        self.keys, self.cost = grams, gram_costs(grams, model)
        places = len(grams).bit_length() + 2
        self.shift, self.at = np.uint64(64 - places), np.zeros(1 << places, "i4")
        self.at[(grams * _MIX >> self.shift).astype("i8")] = np.arange(len(grams), dtype="i4")

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.at[(grams * _MIX >> self.shift).astype("i8")]
        miss = np.flatnonzero(self.keys[at] != grams)
        at[miss] = np.searchsorted(self.keys, grams[miss])
        return self.cost[at]


def text_costs(texts: list[bytes], model: KneserNey) -> np.ndarray:
    """Cost in units of each text's bytes and end."""
    distinct = np.zeros(0, "u8")
    for grams, _, _ in text_grams(texts, model.order):
        distinct = np.unique(np.concatenate([distinct, np.unique(grams)]))
    out = np.zeros(len(texts), "i8")
    if len(distinct):
        costs = _Costs(distinct, model)
        for grams, of, starts in text_grams(texts, model.order):
            np.add.at(out, of, np.add.reduceat(costs(grams), starts))
    return out


# ---- rules -------------------------------------------------------------------------------------------------------


def scored_texts(docs: DataFrame, models: tuple[KneserNey, KneserNey], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits_per_byte)`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    id_type = dict(rows.dtypes)["doc_id"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column("t").to_pylist()]
            sizes = np.cumsum([0, *map(len, raw)])
            first = 0
            while first < len(raw):
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + BLOCK, "right")) - 1)
                some = raw[first:last]
                base = np.array([base_counts(r) for r in some], "i8").reshape(-1, 5)
                folds = np.array([fold(r) for r in some])
                bits = np.zeros(len(some))
                for f in (0, 1):
                    mine = np.flatnonzero(folds == f)
                    bits[mine] = text_costs([some[i] for i in mine], models[1 - f])
                bits /= (np.diff(sizes[first : last + 1]) + 1) * (1 << UNIT)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "lang": part["lang"], **{n: base[:, i] for i, n in enumerate(names)}, "bits_per_byte": bits})
                first = last

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(work, f"doc_id {id_type}, lang string, {', '.join(f'{n} long' for n in names)}, bits_per_byte double")


def perplexity_bands(scored: DataFrame, reach: tuple[float, float] = REACH) -> DataFrame:
    """``(lang, low, high)`` in bits a byte, from the quartiles of each language's rows; a quartile is a bin of a thousandth of a bit."""
    bins = scored.groupBy("lang", F.floor(F.col("bits_per_byte") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    own = W.partitionBy("lang")
    ranked = bins.select("lang", "bin", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("n"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("bin")))
    ends = ranked.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    # A language of equal texts has no distance: allow a hundredth of its middle at least.
    wide = F.greatest(F.col("q3") - F.col("q1"), (F.col("q3") + F.col("q1")) / 200)
    return ends.select("lang", ((F.col("q1") - wide * reach[0]) / BINS).alias("low"), ((F.col("q3") + 1 + wide * reach[1]) / BINS).alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, reach: tuple[float, float] = REACH, piece: int = PIECE) -> DataFrame:
    """``(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits_per_byte, low, high, kept)`` for every row.

    Byte models of ``order`` are counted over the two halves of all texts, and each half is scored by the other's. A text fails the base rules with fewer than 50 words, or where
    more than half of its words stand in windows of three words that it repeats. Of the others, a text is kept whose bits
    a byte (the logarithm of its perplexity) lie inside the band of its language: ``reach`` quartile distances below the
    lower quartile and above the upper one, over the texts of that language that pass the base rules.

    Null texts are empty and fail. Rows without a language have a band of their own. Repeated rows and rows without an id
    are counted, scored and returned like all others. Other columns are ignored. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bound_batches(docs.sparkSession)
    scored = materialize(scored_texts(docs, train(texts, order, piece), id_col, text_col, lang_col), "ngram-scored")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    scored = scored.withColumn("base_failed", failed)
    bands = materialize(perplexity_bands(scored.filter(~F.col("base_failed")), reach).withColumnRenamed("lang", "of"), "ngram-bands")
    met = scored.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    inside = F.col("bits_per_byte").between(F.col("low"), F.col("high"))
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
