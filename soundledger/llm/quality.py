"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundledger.llm.common import bound_batches

BUCKETS_LOG2 = 16
DIM = 16
EPOCHS = 12
RATE = 0.5
#: Labelled documents of each label that the classifier is fitted on, the lowest by a hash of their ids.
MAX_PER_LABEL = 2500
THRESHOLD = 0.7
_MIX = np.uint32(2654435761)


def features(text: str | None) -> np.ndarray:
    """Buckets of a whole text: byte n-grams of 2 to 4, words, word pairs; a word that repeats the last one counts as one marker."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shift = np.uint32(32 - BUCKETS_LOG2)
    found = []
    gram = np.frombuffer(raw, "u1").astype("u4")
    one = gram
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        gram = gram[:-1] * np.uint32(16777619) + one[n - 1 :]
        found.append((gram + np.uint32(n)) * _MIX >> shift)
    words = raw.split()
    if words:
        codes = np.fromiter(map(zlib.crc32, words), "u4", len(words))
        found.append(codes * _MIX >> shift)
        pairs = np.where(codes[1:] == codes[:-1], np.uint32(7), codes[:-1] * np.uint32(31) + codes[1:])
        found.append((pairs + np.uint32(99)) * _MIX >> shift)
    return np.concatenate(found) if found else np.zeros(0, "u4")


@dataclass
class QualityModel:
    """Bucket vectors, output weights of the two labels, and biases."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def evidence(self) -> np.ndarray:
        """What each bucket adds to the log-odds of label 1: the output is linear in the averaged vectors."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype("f8")


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent, one document a step; documents are (buckets, counts, label). Labels weigh alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype("f4")
    output, bias = np.zeros((2, DIM), "f4"), np.zeros(2, "f4")
    labels = np.array([d[2] for d in docs], "i8")
    counts = np.bincount(labels, minlength=2)
    if (counts == 0).any():
        return QualityModel(vectors, output, np.log((counts + 1) / (counts.sum() + 2)).astype("f4"))
    balance = (len(labels) / 2 / counts).clip(0, 10)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, n, y = docs[i]
            share = (n / max(n.sum(), 1)).astype("f4")
            mean = share @ vectors[buckets]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - done / steps) * balance[y]
            done += 1
            step = lr * p
            # Shares are small, so bucket vectors move by their share of the document's feature count.
            vectors[buckets] -= np.outer(share * min(len(share), 1000), step @ output).astype("f4") * np.float32(0.1)
            output -= np.outer(step, mean)
            bias -= step * np.float32(0.1)
    return QualityModel(vectors, output, bias)


def in_fold(id_col: Column) -> Column:
    """Held out: the CRC of the id as text leaves remainder 2 by 4. Rows without an id are not held out; they have no label either."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_label: int = MAX_PER_LABEL) -> QualityModel:
    """Fit on a bounded sample of labelled documents outside the held-out fold, in one task; the model alone reaches the driver.

    The sample is ``max_per_label`` ids of each label by hash of id, each with one text (the smallest by CRC) and all of its
    features, 65,536 at most: at six bytes each, the task holds 2 GB at the very worst and some 0.1 GB for usual texts.
    Labels other than 0 and 1 and rows without an id are left out; a document with both labels counts as 0.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~in_fold(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    order = F.xxhash64("id", F.lit(7))
    picks = [known.filter(F.col("y") == y).orderBy(order, "id").limit(max_per_label) for y in (0, 1)]
    # At most 2 * max_per_label ids: safe to broadcast.
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picks[0].union(picks[1])), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.unique(features(t), return_counts=True) for t in pdf["t"]]
            marks = [zlib.crc32(t.encode()) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "mark": marks, "y": pdf["y"], "f": [r[0].astype("u2").tobytes() for r in rows], "n": [r[1].astype("u4").tobytes() for r in rows]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            # The arrays look into the batch: no document is held twice.
            for i, y, f, n in zip(batch["id"].to_pylist(), batch["y"].to_pylist(), batch["f"], batch["n"], strict=True):
                rows.append((i, np.frombuffer(f.as_buffer(), "u2"), np.frombuffer(n.as_buffer(), "u4"), y))
        rows.sort(key=lambda r: r[0])
        m = fit([r[1:] for r in rows])
        yield pa.RecordBatch.from_pydict({"v": [m.vectors.tobytes()], "o": [m.output.tobytes()], "b": [m.bias.tobytes()]})

    # One row an id, combined in the tasks: an id that many rows share brings one of them.
    once = sample.mapInPandas(count, "id long, mark long, y int, f binary, n binary").groupBy("id").agg(F.min(F.struct("mark", "y", "f", "n")).alias("m"))
    counted = once.select("id", "m.y", "m.f", "m.n").repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit(7)))
    row = counted.mapInArrow(learn, "v binary, o binary, b binary").first()
    if row is None:
        return fit([])
    return QualityModel(np.frombuffer(row["v"], "f4").reshape(-1, DIM), np.frombuffer(row["o"], "f4").reshape(2, DIM), np.frombuffer(row["b"], "f4"))


def scorer(docs: DataFrame, model: QualityModel):
    """A column function: text to the probability of label 1. The shared table has one number a bucket."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.evidence(), float(model.bias[1] - model.bias[0])))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence, bias = shared.value
        for texts in parts:
            means = np.zeros(len(texts))
            for i, text in enumerate(texts):
                f = features(text)
                if len(f):
                    means[i] = evidence[f].mean()
            yield pd.Series(1 / (1 + np.exp(-(means + bias).clip(-500, 500))))

    return score


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Whole texts are scored. Null and empty texts have no features and get the score of the bias. Equal texts get equal
    scores; repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    score = scorer(docs, model)(F.col(text_col)).alias("score")
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(F.col(id_col)).alias("held_out"), score)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier fitted on ``labelled`` and ``labels`` predicts to be good."""
    model = train(labelled, labels, id_col, text_col)
    return docs.filter(scorer(docs, model)(F.col(text_col)) >= threshold)
