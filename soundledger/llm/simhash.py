"""Near-duplicate documents by 64-bit SimHash and a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundledger.llm.blocks import GROUP, block_pairs, pair_blocks, spanning
from soundledger.llm.common import bound_batches, group_starts, materialize, whole_groups
from soundledger.llm.graph import connected_components

MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS


def byte_sets() -> list[tuple[int, ...]]:
    """Sets of four of the eight byte positions such that any five positions hold at least one set.

    Their complements must cover all triples; taking each set that covers no triple twice gives the 14 blocks of the
    Steiner system S(3, 4, 8), the fewest possible.
    """
    taken: list[tuple[int, ...]] = []
    covered: set[tuple[int, ...]] = set()
    for four in combinations(range(8), 4):
        triples = set(combinations(four, 3))
        if not triples & covered:
            covered |= triples
            taken.append(tuple(sorted(set(range(8)) - set(four))))
    return taken


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over whole-text word shingles, repeats included; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    heads, tails = (ends - lengths)[: len(words) - width + 1], ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    for i in range(0, len(heads), 32768):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(heads[i : i + 32768].tolist(), tails[i : i + 32768].tolist(), strict=True)), "u8")
        bits = np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype="u1")
    return int(np.packbits(2 * ones > len(heads), bitorder="little").view("u8")[0])


def text_mark(text: Column) -> Column:
    """MD5 of a text: tells rows that share an id apart. Null texts are empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, mark, fp)``: the id as it is, the text's digest, the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch["t"].to_pylist()), "u8", batch.num_rows).view("i8")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(fps)], ["doc_id", "mark", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(work, "doc_id long, mark binary, fp long")


def fingerprint_links(prints: DataFrame, block: int = 1024) -> DataFrame:
    """Links ``(u, v)`` that span all pairs of distinct fingerprints ``fp`` with at most three differing bits.

    Such a pair has at least five equal bytes at equal positions. Single-byte lists would hold 1/256 of all rows each, so
    a list stands for four positions and their bytes, and every pair that reaches the guaranteed minimum meets in one of
    fourteen lists. There its equal positional bytes are tallied, pairs under the minimum dropped, and the rest verified.
    """
    sets = byte_sets()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy("i8")
            octets = fp.view("u1").reshape(-1, 8)
            keys = [np.ascontiguousarray(octets[:, list(s)]).view("u4").ravel().astype("i8") | (k << 32) for k, s in enumerate(sets)]
            yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.tile(fp, len(sets))})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, GROUP):
            fp, octets = pdf["fp"].to_numpy("i8").view("u8"), pdf["fp"].to_numpy("i8").view("u1").reshape(-1, 8)
            found_a, found_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for a, b in block_pairs(group_starts(pdf, GROUP), *(pdf[c].to_numpy() for c in ("part", "low", "high"))):
                enough = (octets[a] == octets[b]).sum(axis=1) >= MIN_BYTES
                a, b = a[enough], b[enough]
                near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
                found_a.append(a[near])
                found_b.append(b[near])
            root = spanning(len(fp), np.concatenate(found_a), np.concatenate(found_b))
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"u": fp[at].view("i8"), "v": fp[root[at]].view("i8")}).drop_duplicates()

    rows = prints.select("fp").distinct().mapInPandas(index, "key long, fp long")
    return pair_blocks(rows, "fp", block).mapInPandas(link, "u long, v long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``(fp, root, component_id)``: the group of each fingerprint and its smallest id."""
    prints = materialize(simhash_fingerprints(docs, id_col, text_col), "simhash")
    nodes = connected_components(fingerprint_links(prints, block))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    rooted = materialize(
        classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "simhash-roots"
    )
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    return prints, materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-named")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Documents with one fingerprint form a class before anything is paired, so copies cost nothing more. Null and blank
    texts share fingerprint zero. Null ids take part and get their group's smallest id, null if it has none. Repeated
    rows are kept. Other columns are ignored. An empty table gives no rows.
    """
    prints, named = _rooted(docs, id_col, text_col, block)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each group: the one with the smallest id, by the text's digest among equal ids.

    Rows are told apart by id and text, so an id whose texts lie in several groups may stay in each of them. A row without an
    id stays only where its group has no id at all. Of rows equal in id and text the one with the smallest hash of all
    columns stays, so that reruns agree.
    """
    prints, named = _rooted(docs, id_col, text_col)
    rows = prints.join(named, "fp").groupBy("root")
    least = materialize(rows.agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("kept")), "simhash-kept")
    kept = least.select(F.col("kept.doc_id").alias("__kept"), F.col("kept.mark").alias("__kept_mark"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(F.col(id_col).cast("long").alias("__id"), text_mark(F.col(text_col)).alias("__mark"), F.struct(F.xxhash64(whole), F.xxhash64(F.lit(2), whole)).alias("__row"), whole.alias("__whole"))
    own = marked.join(kept, F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__mark") == F.col("__kept_mark")), "left_semi")
    return own.groupBy("__id", "__mark").agg(F.min_by("__whole", "__row").alias("__whole")).select("__whole.*")
