"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundledger.llm.common import bound_batches, materialize

CAPACITY = 2048
END_ID = 1
#: A bin of class k holds k pieces of at most capacity // k tokens. Pieces get lengths that nearly fill their class.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, 128, 256, 512, 1024, 2048)
#: Tokens of padding that one more cut of a document must save.
CUT_COST = 8
#: Documents per worker's share of the bins.
SHARD_DOCS = 16384
#: Shares whose unfinished bins are filled together.
POOL = 256
#: Both libraries split texts of these characters alike; other texts go to the slower one.
PLAIN = re.compile("[^\t-\r -~¡-ɏ]|<\\|endoftext\\|>")
#: The faster library fails on about a million characters of white space in a row; texts with longer runs than this go to the other.
MOST_SPACE = 100_000
LONG_SPACE = re.compile(f"(?<![\t-\r ])[\t-\r ]{{{MOST_SPACE + 1}}}")


@functools.lru_cache(maxsize=4)
def _encoder(tokenizer: str | None):
    """Text to ids: the named vocabulary by ``tokenizers``, and by the faster ``tiktoken`` where the two agree."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    if tokenizer:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if PLAIN.search(text) or (len(text) > MOST_SPACE and LONG_SPACE.search(text)):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@functools.lru_cache(maxsize=4)
def cuts(capacity: int = CAPACITY, cost: int = CUT_COST) -> list[list[tuple[int, int]]]:
    """For each remainder below the capacity the cheapest ``(length, class)`` pieces, padding and cuts weighed."""
    classes = [k for k in CLASSES if k <= capacity]
    size = {k: capacity // k for k in classes}
    spare = {k: capacity / k - size[k] for k in classes}
    best: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
    for r in range(1, capacity + 1):
        k = max(k for k in classes if size[k] >= r)
        options = [(size[k] - r + spare[k], [(r, k)])]
        for k in classes:
            if size[k] < r:
                rest = best[r - size[k]]
                options.append((cost + spare[k] + rest[0], [(size[k], k), *rest[1]]))
        best.append(min(options, key=lambda x: (x[0], len(x[1]))))
    return [x[1] for x in best]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenized documents, each with an end token, cut into pieces with their class; ids themselves on demand."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, table = _encoder(tokenizer), cuts(capacity)
        for pdf in batches:
            out: list[tuple] = []
            for doc, text in zip(pdf["id"].array, pdf["t"], strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                full, rest = divmod(len(ids), capacity)
                at = 0
                for length, k in [(capacity, 1)] * full + table[rest]:
                    cut = ids[at : at + length]
                    out.append((doc, at, length, zlib.crc32(cut.tobytes()), len(ids), k, *([cut.astype("i4")] if with_ids else [])))
                    at += length
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int" + ", ids array<int>" * with_ids
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return work(b.astype({"id": "Int64"}) for b in batches)

    return rows.mapInPandas(typed, schema)


def fill_bins(pieces: DataFrame, shards: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: bins of class k take k pieces each, in every shard on its own.

    Pieces left over in a shard are pooled with those of its neighbours; what is left there makes the last, partly
    filled bins, at most one for each class and pool.
    """
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("k"))

    def numbered(df: DataFrame, home: str, level: int) -> DataFrame:
        own = W.partitionBy("k", home)
        df = df.withColumn("i", F.row_number().over(own.orderBy("doc_id", "start", "ids_crc32")) - 1)
        df = df.withColumn("n", F.count("*").over(own)).withColumn("bin", F.floor(F.col("i") / F.col("k")))
        group = (F.col(home) * len(CLASSES) + rank) * 2 + level
        return df.withColumn("sequence_id", group * F.lit(1 << 32) + F.col("bin")).withColumn("full", (F.col("bin") + 1) * F.col("k") <= F.col("n"))

    first = materialize(numbered(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))), "shard", 0), "bins")
    left = numbered(first.filter(~F.col("full")).withColumn("pool", F.floor(F.col("shard") / POOL)).drop("i", "n", "bin", "sequence_id", "full"), "pool", 1)
    bins = first.filter("full").unionByName(left.drop("pool"))
    before = W.partitionBy("sequence_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return bins.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` on demand).

    A null or empty text is one end token. Null ids, repeated rows and repeated ids are packed like any other row. Texts
    of any length are tokenized whole and cut. Other columns are ignored. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return fill_bins(pieces, shards).select(*names)
