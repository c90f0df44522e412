"""Language-model scores by logistic context mixing over counted contexts of all training text, next to smoothed word frequencies."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundledger.llm.common import bound_batches, materialize

#: Contexts of 1 to ORDERS bytes; a gram is the longest context and the byte after it.
ORDERS = 5
#: Orders whose contexts every task knows: with the next byte they have 2^16 and 2^24 values at most.
LOW = 2
#: Parts of the table of grams, by hash of the three bytes before the last: counts of orders 3 to 5 never leave a part.
BUCKETS = 1024
#: Bytes of text whose distinct grams are costed and brought back together.
BLOCK = 16 << 20
#: A byte that no UTF-8 text holds before it, another behind it.
PAD, END = b"\xfe" * ORDERS, b"\xff"
#: Bytes of text turned to grams at once, distinct grams or words that a task holds before it passes them on.
CHUNK = 1 << 20
HELD = 1 << 20
#: Most words that tasks know by heart; other words meet their counts in a join.
HEAD = 65_536
HEAD_BYTES = 64
CONFIDENCE = 12
STRETCH_MAX = 11.0
REFINED = 33
RATE = 0.4


def held_out(id_col: Column) -> Column:
    """CRC of the id as text is 0 by 10; rows without an id are learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == 0, F.lit(False))


# ---- words -------------------------------------------------------------------------------------------------------


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z only) and an end, written as the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts, summed in each task first."""

    def rows(count: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        words, n = list(count), list(count.values())
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[i : i + 100_000], pa.binary()).cast(pa.string()), "c": pa.array(n[i : i + 100_000], pa.int64())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("t").to_pylist():
                count.update(tokens(text))
                if len(count) > HELD // 4:
                    yield from rows(count)
                    count = Counter()
        yield from rows(count)

    return texts.select("t").mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = HEAD) -> dict[bytes, float]:
    """log10(c + 0.1) of the words above the lowest power of two that at most ``most`` words reach: a bounded set."""
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    sizes = {r["p"]: r["n"] for r in short.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    power, above = max(sizes, default=0) + 1, 0
    while power > 0 and above + sizes.get(power - 1, 0) <= most:
        power -= 1
        above += sizes.get(power, 0)
    return {r["word"].encode(): float(np.log10(r["c"] + 0.1)) for r in short.filter(F.col("c") >= 1 << power).collect()}


# ---- grams -------------------------------------------------------------------------------------------------------


def gram_chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of whole texts, each byte and the end once: (grams, text numbers, first gram of each run of one text).

    Long texts come in several runs whose contexts overlap.
    """
    runs: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        raw = PAD + (text or "").encode("utf-8", "surrogatepass") + END
        for at in range(0, len(raw) - ORDERS, CHUNK):
            runs.append((i, raw[at : at + CHUNK + ORDERS]))
            held += len(runs[-1][1])
            if held >= CHUNK:
                yield _grams(runs)
                runs, held = [], 0
    if runs:
        yield _grams(runs)


def _grams(runs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(r[1] for r in runs), "u1").astype("u8")
    n = len(raw) - ORDERS
    grams = raw[ORDERS:].copy()
    for j in range(1, ORDERS + 1):
        grams |= raw[ORDERS - j : ORDERS - j + n] << np.uint64(8 * j)
    sizes = np.array([len(r[1]) - ORDERS for r in runs])
    starts = np.cumsum(sizes) - sizes
    if len(runs) > 1:
        # Between two runs lie the context bytes of the second.
        ends = np.cumsum(sizes + ORDERS)[:-1] - ORDERS
        keep = np.ones(n, bool)
        for j in range(ORDERS):
            keep[ends + j] = False
        grams = grams[keep]
    return grams, np.array([r[0] for r in runs]), starts


def text_blocks(texts: DataFrame) -> DataFrame:
    """``(block, texts)``: runs of rows ``(doc_id, held_out, t)`` as compressed Arrow streams of about ``BLOCK`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = os.urandom(10), 0

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for some in held:
                    out.write_batch(some)
            return pa.RecordBatch.from_pydict({"block": [task + number.to_bytes(6, "big")], "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = pc.binary_length(batch["t"]).to_numpy(zero_copy_only=False)
            first = 0
            for i in range(batch.num_rows):
                size += int(sizes[i])
                if size >= BLOCK:
                    held.append(batch.slice(first, i + 1 - first))
                    yield made(held)
                    held, size, first, number = [], 0, i + 1, number + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield made(held)

    return texts.select("doc_id", "held_out", "t").mapInArrow(work, "block binary, texts binary")


def block_texts(texts: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a block, a batch at a time: as Python strings a whole block is several times its size."""
    yield from pa.ipc.open_stream(texts)


def packed(grams: np.ndarray) -> bytes:
    """Sorted grams as compressed differences."""
    return pa.compress(np.diff(grams, prepend=np.uint64(0)).tobytes(), "zstd", asbytes=True)


def unpacked(size: int, grams: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(grams, 8 * size, "zstd", asbytes=True), "u8"), dtype="u8")


def bucket_of(gram: np.ndarray) -> np.ndarray:
    """Part of the table: by the three bytes before the last."""
    near = (gram >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype("i4")


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def block_grams(blocks: DataFrame) -> DataFrame:
    """``(bucket, block, size, grams, n)``: the distinct grams of each block, and how often texts that are learned from have them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, raw in zip(pdf["block"], pdf["texts"], strict=True):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for rows in block_texts(raw):
                    for out in (False, True):
                        for grams, _, _ in gram_chunks(rows["t"].filter(pc.equal(rows["held_out"], out)).to_pylist()):
                            grams.sort()
                            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                            held.append((grams[first], np.diff(np.r_[first, len(grams)]) * (not out)))
                            if sum(len(h[0]) for h in held) > HELD:
                                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                keys, n = summed(*map(np.concatenate, zip(*held, strict=True)))
                buckets = bucket_of(keys)
                order = np.argsort(buckets, kind="stable")
                keys, n, buckets = keys[order], n[order], buckets[order]
                first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
                ends = np.r_[first[1:], len(keys)]
                made = [(int(buckets[i]), block, j - i, packed(keys[i:j]), pa.compress(n[i:j].astype("i8").tobytes(), "zstd", asbytes=True)) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(made, columns=["bucket", "block", "size", "grams", "n"])

    return blocks.mapInPandas(work, "bucket int, block binary, size int, grams binary, n binary")


def opened(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of a row ``(size, grams, n)``."""
    size, grams, n = row
    return unpacked(size, grams), np.frombuffer(pa.decompress(n, 8 * size, "zstd", asbytes=True), "i8")


def gram_table(grams: DataFrame) -> DataFrame:
    """``(bucket, size, grams, n)``: the grams of all texts that are learned from, summed over the blocks."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for row in pdf[["size", "grams", "n"]].itertuples(index=False):
            keys, n = opened(row)
            held.append((keys[n > 0], n[n > 0]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
        keys, n = summed(*map(np.concatenate, zip(*held, strict=True)))
        return pd.DataFrame([(pdf["bucket"].iat[0], len(keys), packed(keys), pa.compress(n.tobytes(), "zstd", asbytes=True))], columns=["bucket", "size", "grams", "n"])

    return grams.groupBy("bucket").applyInPandas(merge, "bucket int, size int, grams binary, n binary").filter("size > 0")


# ---- counts, mixer and refinement --------------------------------------------------------------------------------


def running(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of an order with the next byte, sorted, and the sums of all before each."""
    found, sums = summed(keys & np.uint64((1 << (8 * order + 8)) - 1), n)
    return found, np.r_[0, np.cumsum(sums)]


def low_counts(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Orders 1 to ``LOW`` of all grams."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [opened(r) for r in pdf[["size", "grams", "n"]].itertuples(index=False)]
            if parts:
                keys, n = summed(*map(np.concatenate, zip(*parts, strict=True)))
                keys, n = summed(keys & np.uint64((1 << (8 * LOW + 8)) - 1), n)
                yield pd.DataFrame({"key": keys.astype("i4"), "n": n})

    sums = table.mapInPandas(work, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = sums["key"].to_numpy().astype("u8"), sums["n"].to_numpy()
    return [running(keys, n, order) for order in range(1, LOW + 1)]


class Counts:
    """What orders 1 to ORDERS saw, looked up by gram: those of one bucket, and the low orders of all."""

    def __init__(self, low: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, n: np.ndarray) -> None:
        self.orders = [*low, *(running(keys, n, order) for order in range(LOW + 1, ORDERS + 1))]

    def paths(self, gram: np.ndarray) -> np.ndarray:
        """``[order, bits, gram]``: how often the context was followed by the first 0 to 8 bits of the gram's last byte."""
        out = np.empty((ORDERS, 9, len(gram)), "f8")
        for k, (keys, sums) in enumerate(self.orders):
            own, back = np.unique(gram & np.uint64((1 << (8 * k + 16)) - 1), return_inverse=True)
            for bits in range(9):
                low = own >> np.uint64(8 - bits) << np.uint64(8 - bits)
                out[k, bits] = (sums[np.searchsorted(keys, low + np.uint64(1 << (8 - bits)))] - sums[np.searchsorted(keys, low)])[back]
        return out


def bits_of(gram: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and value of bit ``j`` (7 first) of the grams' last byte."""
    byte = gram & np.uint64(255)
    return (byte >> np.uint64(j + 1)) | np.uint64(1 << (7 - j)), (byte >> np.uint64(j)) & np.uint64(1)


def opinion(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a context with these counts says: the log-odds of a 1 and the class of its confidence; nothing seen says nothing."""
    n = zeros + ones
    odds = np.log((ones + 0.05) / (zeros + 0.05)).clip(-STRETCH_MAX, STRETCH_MAX)
    return odds.astype("f4"), np.minimum(np.ceil(np.log2(n + 1)), CONFIDENCE - 1).astype("u1")


@dataclass
class Mixer:
    """Weights of the orders, gated by each order's confidence and by the longest order that knows the context, and the refinement."""

    by_confidence: np.ndarray
    by_reach: np.ndarray
    refined: np.ndarray

    @staticmethod
    def start() -> Mixer:
        spread = np.tile(np.linspace(0.05, 0.5, CONFIDENCE), (ORDERS, 1))
        center = 1 / (1 + np.exp(-np.linspace(-STRETCH_MAX, STRETCH_MAX, REFINED)))
        return Mixer(spread, np.zeros((ORDERS + 1, 8, ORDERS)), np.tile(center, (256, 1)))


def gather(odds: list[np.ndarray], sure: list[np.ndarray], j: int, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Mixed log-odds, and the longest order that has seen the context."""
    reach = np.zeros(len(odds[0]), "i8")
    for k in range(ORDERS):
        reach[sure[k] > 0] = k + 1
    z = np.zeros(len(reach))
    for k in range(ORDERS):
        z += odds[k] * (mixer.by_confidence[k, sure[k]] + mixer.by_reach[reach, j, k])
    return z.clip(-STRETCH_MAX, STRETCH_MAX), reach


def refine(z: np.ndarray, node: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Probability of a 1: halfway between the mixed one and what was seen at about that one for these bits so far."""
    at = (z + STRETCH_MAX) * (REFINED - 1) / (2 * STRETCH_MAX)
    low = np.minimum(at.astype("i8"), REFINED - 2)
    part = at - low
    seen = mixer.refined[node.astype("i8"), low] * (1 - part) + mixer.refined[node.astype("i8"), low + 1] * part
    return ((1 / (1 + np.exp(-z)) + seen) / 2).clip(2**-16, 1 - 2**-16)


def _opinions(paths: np.ndarray, gram: np.ndarray, j: int, own: int = 0) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Opinions of all orders on bit j, as if ``own`` occurrences of the gram had not been counted."""
    node, bit = bits_of(gram, j)
    odds, sure = [], []
    for k in range(ORDERS):
        same, other = np.maximum(paths[k, 8 - j] - own, 0), paths[k, 7 - j] - paths[k, 8 - j]
        o, s = opinion(np.where(bit == 0, same, other), np.where(bit == 0, other, same))
        odds.append(o)
        sure.append(s)
    return node, bit, odds, sure


def learn_weights(gram: np.ndarray, n: np.ndarray, paths: np.ndarray, mixer: Mixer, batch: int = 8192) -> None:
    """One online pass: after every batch each gate's weights take a step against their mean error."""
    for at in range(0, len(gram), batch):
        g, m = gram[at : at + batch], n[at : at + batch].astype("f8")
        rate = RATE / (1 + at / batch / 50)
        for j in range(7, -1, -1):
            _, bit, odds, sure = _opinions(paths[:, :, at : at + batch], g, j, 1)
            z, reach = gather(odds, sure, j, mixer)
            miss = (bit.astype("f8") - 1 / (1 + np.exp(-z))) * m
            weight = np.bincount(reach, m, ORDERS + 1) + 1
            for k in range(ORDERS):
                push = miss * odds[k]
                own = np.bincount(sure[k], m, CONFIDENCE) + 1
                mixer.by_confidence[k] += rate * 0.1 * np.bincount(sure[k], push, CONFIDENCE) / own
                mixer.by_reach[:, j, k] += rate * 0.1 * np.bincount(reach, push, ORDERS + 1) / weight


def learned_grams(batches: Iterator[pd.DataFrame], low: list[tuple[np.ndarray, np.ndarray]], rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shuffled grams of the table's rows with their counts and paths, about ``rows`` at a time."""
    rng = np.random.default_rng(1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def mixed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, n, paths = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        order = rng.permutation(len(gram))
        return gram[order], n[order], paths[:, :, order]

    for pdf in batches:
        for row in pdf[["size", "grams", "n"]].itertuples(index=False):
            gram, n = opened(row)
            counts, order = Counts(low, gram, n), rng.permutation(len(gram))
            for at in range(0, len(gram), rows):
                some = order[at : at + rows]
                held.append((gram[some], n[some], counts.paths(gram[some])))
                if sum(len(h[0]) for h in held) >= rows:
                    yield mixed()
                    held = []
    if held:
        yield mixed()


def _train(table: DataFrame, low: list[tuple[np.ndarray, np.ndarray]]) -> Mixer:
    """Weights learned online in every task over all grams and averaged by weight; then the refinement's sums over all grams."""
    context = table.sparkSession.sparkContext
    shared = context.broadcast(low)

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, total = Mixer.start(), 0
        for gram, n, paths in learned_grams(batches, shared.value):
            learn_weights(gram, n, paths, mixer)
            total += len(gram)
        if total:
            yield pd.DataFrame({"rows": [total], "w": [np.concatenate([mixer.by_confidence.ravel(), mixer.by_reach.ravel()]).tolist()]})

    # One short row a task, averaged by place.
    found = table.mapInPandas(weights, "rows long, w array<double>").select("rows", F.posexplode("w").alias("at", "x"))
    means = {r["at"]: r["x"] for r in found.groupBy("at").agg((F.sum(F.col("x") * F.col("rows")) / F.sum("rows")).alias("x")).collect()}
    mixer = Mixer.start()
    if means:
        flat = np.array([means[i] for i in range(len(means))])
        mixer.by_confidence = flat[: ORDERS * CONFIDENCE].reshape(ORDERS, CONFIDENCE)
        mixer.by_reach = flat[ORDERS * CONFIDENCE :].reshape(ORDERS + 1, 8, ORDERS)

    def adapt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen = np.zeros(256 * REFINED), np.zeros(256 * REFINED)
        for gram, n, paths in learned_grams(batches, shared.value):
            for j in range(7, -1, -1):
                node, bit, odds, sure = _opinions(paths, gram, j, 1)
                z, _ = gather(odds, sure, j, mixer)
                place = node.astype("i8") * REFINED + np.rint((z + STRETCH_MAX) * (REFINED - 1) / (2 * STRETCH_MAX)).astype("i8")
                seen += np.bincount(place, n, 256 * REFINED)
                hits += np.bincount(place, n * bit, 256 * REFINED)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"place": at.astype("i4"), "hits": hits[at], "seen": seen[at]})

    sums = table.mapInPandas(adapt, "place int, hits double, seen double").groupBy("place").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).toArrow()
    refined, place = mixer.refined.ravel().copy(), sums["place"].to_numpy()
    refined[place] = (sums["hits"].to_numpy() + 4 * refined[place]) / (sums["seen"].to_numpy() + 4)
    mixer.refined = refined.reshape(256, REFINED)
    shared.unpersist()
    return mixer


def gram_bits(gram: np.ndarray, counts: Counts, mixer: Mixer) -> np.ndarray:
    """Bits that the last byte of each gram costs after the others."""
    total = np.zeros(len(gram))
    for at in range(0, len(gram), 1 << 16):
        g = gram[at : at + (1 << 16)]
        paths = counts.paths(g)
        for j in range(7, -1, -1):
            node, bit, odds, sure = _opinions(paths, g, j)
            z, _ = gather(odds, sure, j, mixer)
            p = refine(z, node, mixer)
            total[at : at + (1 << 16)] -= np.log2(np.where(bit == 1, p, 1 - p))
    return total


@dataclass
class LanguageModel:
    """The written table of grams, the sums of the low orders, and the mixer."""

    table: DataFrame
    low: list[tuple[np.ndarray, np.ndarray]]
    mixer: Mixer

    def counts(self, gram: np.ndarray) -> Counts:
        """Counts for some grams, from their buckets alone."""
        parts = self.table.filter(F.col("bucket").isin(np.unique(bucket_of(gram)).tolist())).select("size", "grams", "n").collect()
        held = [opened(tuple(r)) for r in parts]
        return Counts(self.low, *(np.concatenate(x) for x in zip((np.zeros(0, "u8"), np.zeros(0, "i8")), *held, strict=True)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        return gram_bits(gram, self.counts(gram), self.mixer)


def gram_costs(grams: DataFrame, model: LanguageModel) -> DataFrame:
    """``(block, size, grams, bits)`` for the grams of each block: every distinct gram of a bucket is costed once."""
    shared = grams.sparkSession.sparkContext.broadcast((model.low, model.mixer))

    def cost(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        low, mixer = shared.value
        held = [opened(r) for r in known[["size", "grams", "n"]].itertuples(index=False)]
        counts = Counts(low, *(held[0] if held else (np.zeros(0, "u8"), np.zeros(0, "i8"))))
        found: list[np.ndarray] = []
        for size, raw in zip(asked["size"], asked["grams"], strict=True):
            found.append(unpacked(size, raw))
            if sum(map(len, found)) > HELD:
                found = [np.unique(np.concatenate(found))]
        every = np.unique(np.concatenate([np.zeros(0, "u8"), *found]))
        bits = gram_bits(every, counts, mixer).astype("f4")
        asked["bits"] = [bits[np.searchsorted(every, unpacked(size, raw))].tobytes() for size, raw in zip(asked["size"], asked["grams"], strict=True)]
        return asked[["block", "size", "grams", "bits"]]

    asked = grams.select("bucket", "block", "size", "grams")
    return asked.groupBy("bucket").cogroup(model.table.groupBy("bucket")).applyInPandas(cost, "block binary, size int, grams binary, bits binary")


class _Costs:
    """Costs of a block's grams, most of them found at their place of a table and the others by search."""

    def __init__(self, parts: pa.Table) -> None:
        sizes = parts["size"].to_pylist()
        keys, bits = np.empty(sum(sizes), "u8"), np.empty(sum(sizes), "f4")
        at = 0
        for size, raw, b in zip(sizes, parts["grams"], parts["bits"], strict=True):
            keys[at : at + size], bits[at : at + size] = unpacked(size, raw.as_buffer()), np.frombuffer(b.as_buffer(), "f4")
            at += size
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]
        places = len(keys).bit_length() + 1
        self.shift, self.at = np.uint64(64 - places), np.zeros(1 << places, "i4")
        self.at[self.place(self.keys)] = np.arange(len(keys), dtype="i4")

    def place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("i8")

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.at[self.place(grams)]
        miss = np.flatnonzero(self.keys[at] != grams)
        at[miss] = np.searchsorted(self.keys, grams[miss])
        return self.bits[at].astype("f8")


def _fit(grams: DataFrame) -> LanguageModel:
    table = materialize(gram_table(grams), "lm-table")
    low = low_counts(table)
    return LanguageModel(table, low, _train(table, low))


def train(texts: DataFrame) -> LanguageModel:
    """Fit on all rows of ``(t)``: gram counts in a written table that grows with them, weights and refinement from all of it."""
    blocks = text_blocks(texts.select(F.lit("").alias("doc_id"), F.lit(False).alias("held_out"), F.coalesce("t", F.lit("")).alias("t")))
    return _fit(materialize(block_grams(blocks), "lm-grams"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``score`` is the log10 probability of the whole text's bytes and its end under the mixing model; ``bits_per_byte`` is
    -score / log10(2) / (bytes + 1). Null texts are empty: one end. Rows without an id are scored and learned from.
    Repeated rows are all returned. Other columns are ignored. An empty table gives no rows; with nothing to learn from,
    every bit costs one bit and no token is known.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bound_batches(docs.sparkSession)
    learned = rows.filter(~F.col("held_out"))
    # Ids travel as text, never as floats.
    blocks = materialize(text_blocks(rows.withColumn("doc_id", F.col("doc_id").cast("string"))), "lm-texts")
    grams = materialize(block_grams(blocks), "lm-grams")
    model = _fit(grams)
    counts = materialize(word_counts(learned), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frequent_words(counts))
    id_type = dict(rows.dtypes)["doc_id"]

    def work(held: pa.Table, parts: pa.Table) -> pa.Table:
        head, costs, made = shared.value, _Costs(parts), []
        kinds = [("row", pa.binary()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("total", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]
        for block, raw in zip(held["block"].to_pylist(), held["texts"], strict=True):
            number = 0
            for batch in block_texts(raw.as_buffer()):
                texts = batch["t"].to_pylist()
                score = np.zeros(len(texts))
                for grams, of, starts in gram_chunks(texts):
                    np.add.at(score, of, -np.add.reduceat(costs(grams), starts) * np.log10(2))
                out: list[tuple] = []
                for text in texts:
                    here = Counter(tokens(text))
                    total, known, rest = 0.0, 0, []
                    for word, times in here.items():
                        w = head.get(word)
                        if w is None:
                            rest.append(word)
                        else:
                            total += times * w
                            known += times
                    out.append((block + number.to_bytes(6, "big"), sum(here.values()), known, total, [w.decode("utf-8", "surrogatepass") for w in rest], [here[w] for w in rest]))
                    number += 1
                columns = {name: pa.array(values, kind) for (name, kind), values in zip(kinds, zip(*out, strict=True), strict=True)}
                made.append(pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.string()), "held_out": batch["held_out"], **columns, "score": pa.array(score)}))
        return pa.Table.from_batches(made)

    schema = "doc_id string, held_out boolean, row binary, n_tokens long, known long, total double, words array<string>, times array<int>, score double"
    scored = materialize(blocks.groupBy("block").cogroup(gram_costs(grams, model).groupBy("block")).applyInArrow(work, schema), "lm-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rest.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("more_total"))
    out = scored.drop("words", "times").join(met, "row", "left")
    whole = float(np.log10(n + 0.1 * (v + 1)))
    n_known = F.col("known") + F.coalesce("more", F.lit(0))
    unknown = (F.col("n_tokens") - n_known) * F.lit(-1.0)
    base = F.col("total") + F.coalesce("more_total", F.lit(0.0)) + unknown - F.col("n_tokens") * F.lit(whole)
    return out.select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
