"""Prefix tries of conversations as balanced parentheses, a shard at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundledger.llm.common import materialize

#: Conversations whose first turns others take over, and the most turns taken.
GROUP_OF = 100
HEADS = 6
#: Turns of a level: deeper conversations go on in a block below.
LEVEL = 32
#: Paths of a shard.
SHARD = 20_000
#: Parentheses of a block of excesses.
BLOCK = 64
#: Bytes of ids that are joined before they are hashed.
PIECE = 1 << 20
#: A Mersenne prime and two bases of the rolling hash of turns.
PRIME = (1 << 61) - 1
BASES = (0x1D8E4E27C47D124F, 0x0B2E11B9D4A53C35)
NODE = ["d", "k1", "k2"]


# ---- rolling hashes ----------------------------------------------------------------------------------------------


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo the prime, for numbers below it."""
    a, b = np.asarray(a, "u8"), np.asarray(b, "u8")
    low, half = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = ah * bl + al * bh
    r = np.uint64(2) * ah * bh + (mid >> np.uint64(30)) + ((mid & half) << np.uint64(31)) + al * bl
    return _reduced(r)


def _reduced(r: np.ndarray) -> np.ndarray:
    r = (r & np.uint64(PRIME)) + (r >> np.uint64(61))
    return r - np.where(r >= PRIME, np.uint64(PRIME), np.uint64(0))


def plus(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return _reduced(np.asarray(a, "u8") + np.asarray(b, "u8"))


def power(base: int, e: np.ndarray) -> np.ndarray:
    e = np.asarray(e, "i8").copy()
    out, b = np.ones(len(e), "u8"), np.uint64(base)
    while (e > 0).any():
        out = np.where(e & 1, times(out, b), out)
        b, e = times(b, b), e >> 1
    return out


def rolled(t: np.ndarray, place: np.ndarray, base: int) -> np.ndarray:
    """Hash of each run up to each of its rows; ``place`` counts rows inside runs from 0."""
    h, step, b = t.astype("u8"), 1, base
    while (place >= step).any():
        at = np.flatnonzero(place >= step)
        new = h.copy()
        new[at] = plus(times(h[at - step], b), h[at])
        h, step, b = new, step * 2, int(times(b, b))
    return h


# ---- turns in order ----------------------------------------------------------------------------------------------


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, h1, h2, size)``: places of turns from 0, hashes of conversations up to them, code points.

    Turns are sorted by ranges of the whole order, so that a long conversation is shared by tasks. A task numbers what it
    holds; only the conversation it starts with may go on from other tasks, so one carry a task is added afterwards.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    mark = lambda seed: F.pmod(F.xxhash64(F.lit(seed), role, text), F.lit(PRIME - 1)) + 1
    order = ["conv_id", "turn", "role", "head", "t1", "t2", "row"]
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 100).alias("head"), mark(1).alias("t1"), mark(2).alias("t2"),
        F.monotonically_increasing_id().alias("row"), F.char_length(text).cast("long").alias("size"),
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        conv, count, held, first = None, 0, [0, 0], True
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["conv_id"].to_numpy("i8")
            start = np.r_[True, ids[1:] != ids[:-1]]
            place = np.arange(len(ids)) - np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
            hashes = [rolled(pdf[f"t{i + 1}"].to_numpy("i8"), place, BASES[i]) for i in (0, 1)]
            pos = place.copy()
            run = int(np.argmax(start[1:])) + 1 if start[1:].any() else len(ids)
            if ids[0] == conv:
                pos[:run] += count
                for i in (0, 1):
                    hashes[i][:run] = plus(times(power(BASES[i], place[:run] + 1), held[i]), hashes[i][:run])
            elif conv is not None:
                first = False
            opening = np.zeros(len(ids), bool)
            opening[:run] = first
            first = first and run == len(ids)
            conv, count, held = ids[-1], int(pos[-1]) + 1, [int(h[-1]) for h in hashes]
            yield pd.DataFrame({"part": part, "opening": opening, "conv_id": ids, "pos": pos, "h1": hashes[0].astype("i8"), "h2": hashes[1].astype("i8"), "size": pdf["size"].to_numpy()})

    counted = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "size")
    local = materialize(counted.mapInPandas(number, "part int, opening boolean, conv_id long, pos long, h1 long, h2 long, size long"), "trie-local")
    runs = local.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    split = local.filter("opening").select("conv_id").distinct()
    # One conversation a task opens with: at most two of its runs a task come back.
    carry: dict[int, tuple[int, int, int]] = {}
    conv, total = None, (0, 0, 0)
    for r in runs.join(split, "conv_id").orderBy("conv_id", "part").collect():
        if r["conv_id"] != conv:
            conv, total = r["conv_id"], (0, 0, 0)
        elif total[0]:
            carry[r["part"]] = total
        n, h = r["last"]["pos"] + 1, (r["last"]["h1"], r["last"]["h2"])
        total = (total[0] + n, *[(total[i + 1] * pow(BASES[i], n, PRIME) + h[i]) % PRIME for i in (0, 1)])
    shared = local.sparkSession.sparkContext.broadcast(carry)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf.loc[pdf["opening"], "part"].unique():
                if part in shared.value:
                    n, *h = shared.value[part]
                    at = np.flatnonzero(pdf["opening"].to_numpy() & (pdf["part"].to_numpy() == part))
                    pos = pdf["pos"].to_numpy("i8")
                    for i in (0, 1):
                        new = pdf[f"h{i + 1}"].to_numpy("i8").copy()
                        new[at] = plus(times(power(BASES[i], pos[at] + 1), h[i]), new[at]).astype("i8")
                        pdf[f"h{i + 1}"] = new
                    pos = pos.copy()
                    pos[at] += n
                    pdf["pos"] = pos
            yield pdf[["conv_id", "pos", "h1", "h2", "size"]]

    return materialize(local.mapInPandas(add, "conv_id long, pos long, h1 long, h2 long, size long"), "trie-turns")


def taken_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, d, k1, k2, size, ends)`` for all turns of rebuilt conversations, and the ids of those without turns.

    The hash of a rebuilt path comes from the conversation's own hash: what its first turns gave is replaced by what the
    other conversation's first turns give, moved on by the turns in between. So nothing is sorted again.
    """
    few = turns.filter(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "size"))).alias("heads"))
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumn("h", taken_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP_OF)
    base = few.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    convs = convs.join(few, "conv_id").join(base, "base", "left")
    convs = convs.withColumn("taken", F.slice(F.coalesce("base_heads", F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,size:bigint>>")), 1, F.col("h").cast("int")))
    last = lambda heads, name: F.when(F.size(heads) > 0, F.element_at(heads, -1)[name]).otherwise(F.lit(0))
    convs = convs.withColumn("m", F.size("taken").cast("long")).withColumn("lost", F.slice("heads", 1, F.col("h").cast("int")))
    convs = convs.select(
        "conv_id", "n", "h", "m", "taken", *[F.pmod(last(F.col("taken"), f"h{i}") - last(F.col("lost"), f"h{i}"), F.lit(PRIME)).alias(f"e{i}") for i in (1, 2)]
    )
    convs = materialize(convs, "trie-convs")
    before = convs.select("conv_id", "n", "h", "m", F.explode("taken").alias("t"))
    before = before.select("conv_id", (F.col("t.pos") + 1).alias("d"), F.col("t.h1").alias("k1"), F.col("t.h2").alias("k2"), F.col("t.size").alias("size"), ((F.col("t.pos") + 1 == F.col("m")) & (F.col("n") <= F.col("h"))).alias("ends"))
    own = turns.filter(F.col("pos") >= taken_turns(F.col("conv_id"))).join(convs.select("conv_id", "n", "h", "m", "e1", "e2"), "conv_id")

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            on = (pdf["pos"] - pdf["h"] + 1).to_numpy("i8")
            keys = {f"k{i}": plus(times(power(BASES[i - 1], on), pdf[f"e{i}"].to_numpy("i8")), pdf[f"h{i}"].to_numpy("i8")).astype("i8") for i in (1, 2)}
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "d": on + pdf["m"].to_numpy(), **keys, "size": pdf["size"], "ends": pdf["pos"] + 1 == pdf["n"]})

    own = own.select("conv_id", "pos", "h1", "h2", "size", "n", "h", "m", "e1", "e2").mapInPandas(move, "conv_id long, d long, k1 long, k2 long, size long, ends boolean")
    return materialize(before.unionByName(own), "trie-rebuilt"), convs.filter("m = 0 AND n <= h").select("conv_id")


def distinct_paths(turns: DataFrame, bare: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(j, ks, sizes, conv, n, ended)``: distinct paths inside levels of at most ``level`` turns, with their tops in front.

    A conversation that goes on below a level starts a path there whose top is its last node above. Equal paths are counted
    before they are shuffled again. ``ended`` conversations end with the path, the others go on.
    """
    j = F.floor((F.col("d") - 1) / level).cast("int")
    again = (F.col("d") % level == 0) & ~F.col("ends")
    placed = turns.withColumn("j", F.explode(F.when(again, F.array(j, j + 1)).otherwise(F.array(j))))
    paths = placed.groupBy("conv_id", "j").agg(F.array_sort(F.collect_list(F.struct("d", "k1", "k2", "size", "ends"))).alias("p"))
    root = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    ks = F.transform("p", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2")))
    paths = paths.select("conv_id", "j", F.when(F.col("j") == 0, F.concat(F.array(root), ks)).otherwise(ks).alias("ks"), F.transform("p", lambda x: x["size"]).alias("sizes"), F.element_at("p", -1)["ends"].alias("ends"))
    paths = paths.withColumn("sizes", F.when(F.col("j") == 0, F.concat(F.array(F.lit(0).cast("long")), "sizes")).otherwise(F.col("sizes")))
    none = bare.select("conv_id", F.lit(0).alias("j"), F.array(root).alias("ks"), F.array(F.lit(0).cast("long")).alias("sizes"), F.lit(True).alias("ends"))
    every = paths.unionByName(none).withColumn("last", F.element_at("ks", -1)).withColumn("len", F.size("ks"))
    same = every.groupBy("j", "len", "last").agg(F.first("ks").alias("ks"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.count_if("ends").alias("ended"))
    return materialize(same.select("j", "ks", "sizes", "conv", "n", "ended"), "trie-paths")


# ---- balanced parentheses ----------------------------------------------------------------------------------------


class Parentheses:
    """A balanced sequence of 1 and -1, with the least excess of each block and of pairs of blocks above it."""

    def __init__(self, parens: np.ndarray) -> None:
        self.size = len(parens)
        blocks = 1
        while blocks * BLOCK < self.size:
            blocks *= 2
        excess = np.cumsum(parens, dtype="i8")
        self.excess = np.concatenate([excess, np.full(blocks * BLOCK - self.size, 1 << 40, "i8")])
        self.leaves = blocks
        self.least = np.empty(2 * blocks, "i8")
        self.least[blocks:] = self.excess.reshape(blocks, BLOCK).min(axis=1)
        while blocks > 1:
            blocks //= 2
            self.least[blocks : 2 * blocks] = self.least[2 * blocks : 4 * blocks].reshape(blocks, 2).min(axis=1)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """For each open parenthesis the first later place whose excess is below the one at it."""
        want = self.excess[opens] - 1
        close = self._in_block(opens // BLOCK, want, opens % BLOCK)
        todo = np.flatnonzero(close < 0)
        node = opens[todo] // BLOCK + self.leaves
        up = np.ones(len(todo), bool)
        # Up until a right neighbour holds the excess, then down to its first block that does.
        while up.any():
            right = up & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.leaves - 1)] <= want[todo])
            node = np.where(right, node + 1, np.where(up, node // 2, node))
            up &= ~right
        while True:
            down = node < self.leaves
            if not down.any():
                break
            left = self.least[np.where(down, 2 * node, 0)] <= want[todo]
            node = np.where(down, 2 * node + ~left, node)
        close[todo] = self._in_block(node - self.leaves, want[todo], np.full(len(todo), -1))
        return close

    def _in_block(self, block: np.ndarray, want: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = np.empty(len(block), "i8")
        for i in range(0, len(block), 1 << 15):
            cut = slice(i, i + (1 << 15))
            hit = (self.excess.reshape(-1, BLOCK)[block[cut]] == want[cut, None]) & (np.arange(BLOCK) > after[cut, None])
            out[cut] = np.where(hit.any(axis=1), block[cut] * BLOCK + hit.argmax(axis=1), -1)
        return out


def encode(j: np.ndarray, k1: np.ndarray, k2: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct paths (matrices of keys) as one trie: (path, element, parent, open, close) of each node in preorder.

    A path closes what the one before it has and it has not, and opens the rest of its own.
    """
    at = np.arange(k1.shape[1])
    same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (at < np.minimum(length[1:], length[:-1])[:, None]) & (j[1:] == j[:-1])[:, None]
    common = np.r_[0, np.cumprod(same, axis=1).sum(axis=1)] if len(j) > 1 else np.zeros(1, "i8")
    fresh = (at >= common[:, None]) & (at < length[:, None])
    path, element = np.nonzero(fresh)
    closed = np.cumsum(np.r_[0, length[:-1] - common[1:]] if len(j) > 1 else np.zeros(1, "i8"))
    opens = np.arange(len(path)) + closed[path]
    parens = np.full(2 * len(path), -1, "i1")
    parens[opens] = 1
    ids = np.zeros(k1.shape, "i8")
    ids[path, element] = np.arange(len(path))
    ids = np.maximum.accumulate(ids, axis=0)
    parent = np.where(element > 0, ids[path, np.maximum(element, 1) - 1], -1)
    return path, element, parent, opens, Parentheses(parens).find_close(opens)


NODES = (
    "partial boolean, top boolean, j int, d long, k1 long, k2 long, p1 long, p2 long, path array<struct<k1:bigint,k2:bigint>>, size long, n long, conv long, "
    "ended long, children long, leaves long, saved long, parent_conv long"
)


def shard_nodes(part: pa.RecordBatch, level: int = LEVEL) -> pd.DataFrame:
    """Nodes of a shard's trie: whole ones with their sums over subtrees, and parts of those it may share with its neighbours.

    Only tops and what stands on the first and the last path may be shared. A part sums the whole nodes below it.
    """
    j, conv, n, ended = (part[c].to_numpy() for c in ("j", "conv", "n", "ended"))
    length = pc.list_value_length(part["ks"]).to_numpy().astype("i8")
    width = int(length.max())
    at = np.arange(width) < length[:, None]
    keys = part["ks"].flatten()
    k1, k2, size = (np.zeros(at.shape, "i8") for _ in range(3))
    k1[at], k2[at], size[at] = keys.field("k1").to_numpy(), keys.field("k2").to_numpy(), part["sizes"].flatten().to_numpy()
    path, element, parent, opens, close = encode(j, k1, k2, length)
    nodes = len(path)
    below = (close - opens + 1) // 2
    end = np.arange(nodes) + below
    last = element == length[path] - 1
    on = (n - ended)[path] * last > 0

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(x)]
        return total[end] - total[:-1]

    # Paths that end below a node follow one another.
    ends_at = np.r_[0, np.cumsum(last)]
    first_path, after = ends_at[np.arange(nodes)], ends_at[end]
    least = np.minimum.reduceat(np.r_[conv, np.iinfo("i8").max], np.stack([first_path, after], axis=1).ravel())[::2]
    count = summed(np.where(last, n[path], 0))
    shared = element == 0
    for edge in (0, len(length) - 1):
        mine = np.zeros(width, "i8")
        seen = path <= edge
        np.maximum.at(mine, element[seen], np.flatnonzero(seen))
        shared[mine[: length[edge]]] = True
    leaf = (below == 1) & ~on & ~shared
    weight = np.where(shared, 0, (count - 1) * size[path, element])
    whole = np.bincount(parent[(parent >= 0) & ~shared], minlength=nodes)
    key = lambda x, at: np.where(at >= 0, x[path[at], element[at]], 0)
    out = pd.DataFrame(
        {
            "partial": shared, "top": element == 0, "j": j[path], "d": j[path].astype("i8") * level + element, "k1": k1[path, element], "k2": k2[path, element],
            "p1": key(k1, parent), "p2": key(k2, parent), "path": None, "size": size[path, element], "n": count, "conv": least,
            "ended": np.where(last, ended[path], 0), "children": whole, "leaves": summed(leaf), "saved": summed(weight),
            "parent_conv": pd.array(np.where((parent >= 0) & ~shared[parent], least[parent], -1), dtype="Int64"),
        }
    )
    out.loc[(parent < 0) | shared[parent], "parent_conv"] = pd.NA
    for r in np.flatnonzero(shared):
        i, e = path[r], element[r]
        out.at[r, "path"] = [{"k1": int(a), "k2": int(b)} for a, b in zip(k1[i, : e + 1], k2[i, : e + 1], strict=True)]
    return out


def shard_tables(paths: DataFrame, level: int = LEVEL, shard: int = SHARD) -> DataFrame:
    """Nodes of all shards: runs of at most ``shard`` paths in sorted order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for i in range(0, batch.num_rows, shard):
                made = shard_nodes(batch.slice(i, shard), level)
                schema = schema or pa.schema(
                    [(c, pa.bool_()) for c in ("partial", "top")] + [("j", pa.int32())] + [(c, pa.int64()) for c in ("d", "k1", "k2", "p1", "p2")]
                    + [("path", pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())])))] + [(c, pa.int64()) for c in ("size", "n", "conv", "ended", "children", "leaves", "saved", "parent_conv")]
                )
                yield pa.RecordBatch.from_pandas(made, schema=schema, preserve_index=False)

    rows = paths.repartitionByRange("j", "ks").sortWithinPartitions("j", "ks")
    return materialize(rows.mapInArrow(work, NODES), "trie-shards")


# ---- shared spines and levels ------------------------------------------------------------------------------------


def merged_spines(nodes: DataFrame) -> DataFrame:
    """Parts of one node summed, with all of its children and its sums inside its level.

    Spines are short: a shard has two paths of them. Each adds what is its own to the nodes above it in its path.
    """
    same = nodes.filter("partial").groupBy("top", "j", *NODE).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("path").alias("path"), F.first("size").alias("size"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.sum("ended").alias("ended"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    same = materialize(same, "trie-spines")
    kids = same.filter("NOT top").groupBy((F.size("path") == 2).alias("top"), "j", F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    met = same.join(kids, ["top", "j", "k1", "k2"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    # Tops of lower levels are counted where they end a path.
    goes_on = F.col("n") > F.col("ended")
    inner = (F.col("children") == 0) & ~F.col("top")
    met = materialize(met.withColumn("leaf", inner & ~(goes_on & (F.size("path") > 1))).withColumn("own", F.when(F.col("top"), 0).otherwise((F.col("n") - 1) * F.col("size"))), "trie-merged")
    sent = met.filter("NOT top").select("j", "leaf", "own", F.posexplode("path").alias("e", "k"))
    got = sent.groupBy((F.col("e") == 0).alias("top"), "j", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).agg(F.count_if("leaf").alias("l"), F.sum("own").alias("s"))
    met = met.join(got, ["top", "j", "k1", "k2"], "left")
    return materialize(
        met.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s", "leaf", "own"), "trie-spine-sums"
    )


def level_totals(tops: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(d, k1, k2, leaves, saved)`` of everything below each top, all levels down.

    Sums move up by 1, 2, 4, ... levels: as many rounds as the logarithm of the number of levels.
    """
    up = cuts.select(*NODE, F.struct(F.col("top_d").alias("d"), F.col("top1").alias("k1"), F.col("top2").alias("k2")).alias("up"))
    sums = materialize(tops.select(*NODE, "leaves", "saved").join(up, NODE, "left"), "trie-tops")
    while sums.filter("up IS NOT NULL").limit(1).count():
        moved = sums.filter("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = sums.select(F.struct(*NODE).alias("up"), F.col("up").alias("next"))
        met = sums.join(moved.select("up.*", "l", "s"), NODE, "left").join(above, "up", "left")
        sums = materialize(
            met.select(*NODE, (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("up")), "trie-tops"
        )
    return sums.drop("up")


def id_hashes(ends: DataFrame) -> DataFrame:
    """``(d, k1, k2, ends_sha256)`` from ``(d, k1, k2, conv_id)``: SHA-256 of each node's ids in order, joined by commas.

    Tasks sort ranges of (node, id) and join ids to texts of bounded size; the texts of one node then pass one hash in order,
    as SHA-256 has no parallel form.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf[NODE].to_numpy("i8")
            start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, "i8")
            ids = pdf["conv_id"].to_numpy("i8")
            for a, b in zip(start, [*start[1:], len(keys)], strict=True):
                for i in range(a, b, PIECE // 20):
                    some = ids[i : min(b, i + PIECE // 20)]
                    yield pd.DataFrame({"d": [keys[a, 0]], "k1": [keys[a, 1]], "k2": [keys[a, 2]], "first": [some[0]], "ids": [",".join(map(str, some.tolist()))]})

    def batched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in frames:
            held.append(pdf)
            size += len(pdf["ids"].iloc[0])
            if size > PIECE or len(held) > 5000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        done: list[tuple] = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.d, r.k1, r.k2) != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (r.d, r.k1, r.k2), hashlib.sha256(r.ids.encode())
                else:
                    sha.update(b"," + r.ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
            done = []
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*NODE, "ends_sha256"])

    rows = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id")
    pieces = rows.mapInPandas(lambda b: batched(join(b)), "d long, k1 long, k2 long, first long, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return materialize(pieces.mapInPandas(digest, "d long, k1 long, k2 long, ends_sha256 string"), "trie-ends")


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", level: int = LEVEL, shard: int = SHARD
) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` for every prefix.

    A conversation's turns go by turn (null first), then role and text (its first 100 code points, then a hash); null roles
    and texts are empty, repeated rows are turns of their own. Every conversation takes its first turns, up to five by the
    CRC of its id, from the one that heads its hundred. Rows without a conversation id belong to none and are left out.
    Other columns are ignored. An empty table gives no rows, not even a root.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rebuilt, bare = rebuilt_turns(ordered_turns(rows))
    paths = distinct_paths(rebuilt, bare, level)
    nodes = shard_tables(paths, level, shard)
    spines = merged_spines(nodes)
    tops = spines.filter("top")
    last = F.element_at("ks", -1)
    depth = F.col("j").cast("long") * level
    cuts = paths.filter("n > ended").select(
        (depth + F.size("ks") - 1).alias("d"), last["k1"].alias("k1"), last["k2"].alias("k2"), depth.alias("top_d"), F.col("ks")[0]["k1"].alias("top1"), F.col("ks")[0]["k2"].alias("top2"), "ks"
    )
    cuts = materialize(cuts, "trie-cuts")
    totals = level_totals(tops, cuts)
    # What lies below the level counts for all nodes of the path that leads there, and a cut node has its top's children.
    lead = cuts.join(totals, NODE).select("d", "leaves", "saved", F.posexplode("ks").alias("e", "k"), F.size("ks").alias("len")).filter("e > 0")
    lead = lead.select((F.col("d") - F.col("len") + 1 + F.col("e")).alias("d"), F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), "leaves", "saved", F.lit(0).cast("long").alias("children"))
    kids = tops.filter("d > 0").select(*NODE, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "children")
    more = lead.unionByName(kids).groupBy(*NODE).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("children").alias("c"))
    cols = [*NODE, "p1", "p2", "n", "conv", "children", "leaves", "saved", "parent_conv"]
    below = nodes.filter("NOT partial").select(cols)
    spine = spines.filter("NOT top").withColumn("parent_conv", F.lit(None).cast("long")).select(cols)
    met = below.unionByName(spine).join(more, NODE, "left")
    zero = F.lit(0)
    met = met.select(
        *NODE, "p1", "p2", "n", "conv", "parent_conv", (F.col("children") + F.coalesce("c", zero)).alias("children"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved")
    )
    root = tops.filter("d = 0").join(totals.select(*NODE, F.col("leaves").alias("l"), F.col("saved").alias("s")), NODE)
    root = root.select(*NODE, F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "n", "conv", F.lit(None).cast("long").alias("parent_conv"), "children", F.greatest("l", F.lit(1)).alias("leaves"), F.col("s").alias("saved"))
    every = materialize(met.unionByName(root), "trie-nodes")
    # Parents that are whole in their shard are known; spines, cut nodes and the root are few.
    parents = spines.filter("NOT top").select(*NODE, "conv").unionByName(below.filter(F.col("d") % level == 0).select(*NODE, "conv")).unionByName(root.select(*NODE, "conv"))
    parents = parents.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up"))
    ended = rebuilt.filter("ends").select(*NODE, "conv_id").unionByName(bare.select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id"))
    out = every.join(parents, ["d", "p1", "p2"], "left").join(id_hashes(ended), NODE, "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent_conv", "up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 of a decimal text, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
TRIE_SQL = f"""
    WITH own AS (
        SELECT conv_id, list({{'k': md5(coalesce(role, '') || chr(1) || coalesce(text, '')), 'n': len(coalesce(text, ''))}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), taken AS (SELECT *, xor({_CRC}, 4294967295) % {HEADS} AS h, conv_id - conv_id % {GROUP_OF} AS base FROM own),
    rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM taken a LEFT JOIN own b ON a.base = b.conv_id),
    steps AS (SELECT conv_id, d, array_to_string(list_transform(l[1:d], lambda x: x.k), '') AS p, d = len(l) AS ends, CASE WHEN d > 0 THEN l[d].n ELSE 0 END AS size
              FROM (SELECT *, unnest(generate_series(0, len(l))) AS d FROM rebuilt)),
    nodes AS (
        SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(size) AS w, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
        FROM steps GROUP BY p, d
    ), kids AS (SELECT p[1:32 * (d - 1)] AS p, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1),
    below AS (
        SELECT p[1:32 * e] AS p, count(*) FILTER (c IS NULL) AS leaves, sum(w) AS saved
        FROM (SELECT n.*, c, unnest(generate_series(0, d)) AS e FROM nodes n LEFT JOIN kids USING (p)) GROUP BY 1
    )
    SELECT n.conv_id, CAST(d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
    FROM nodes n JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN (SELECT p AS q, conv_id FROM nodes) up ON n.d > 0 AND up.q = n.p[1:32 * (n.d - 1)]
"""
