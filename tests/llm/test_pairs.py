"""SimHash, lattice hashing, top-k search and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from soundledger.llm.blocks import block_pairs, spanning
from soundledger.llm.graph import connected_components
from soundledger.llm.lattice import e8_nearest, near_vectors
from soundledger.llm.simhash import byte_sets, one_of_each_group, simhash_groups
from soundledger.llm.topk import top_products


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (2000, 2001)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(ids, [x for x in links if x[0] != x[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_byte_sets_cover_every_five_positions():
    from itertools import combinations

    sets = byte_sets()
    assert len(sets) == 14
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_block_pairs_are_all_pairs_once():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 2, 5, 70, 130, 1])
    starts = np.r_[0, np.cumsum(sizes)]
    n = starts[-1]
    part, low, high = np.zeros(n, "i4"), np.zeros(n, "i4"), np.zeros(n, "i4")
    two = slice(starts[4], starts[5])
    part[two], high[two] = rng.integers(0, 2, 130), 1
    got = [(int(a), int(b)) for x, y in block_pairs(starts, part, low, high, most=500) for a, b in zip(x, y, strict=True)]
    want = {(a, b) for s, e in zip(starts, starts[1:], strict=False) for a in range(s, e) for b in range(a + 1, e) if low[a] == high[a] or part[a] != part[b]}
    assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want
    assert spanning(5, np.array([3, 1]), np.array([1, 4])).tolist() == [0, 1, 2, 1, 1]


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [3, 1024])
def test_simhash_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)] + ["Äh", " x", "a\x1cb"]
    base = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            w[int(rng.integers(0, len(w)))] = "neu"
            texts.append(" ".join(w))
    texts += [None, "", " \n\t", "one", "ONE", "two words", base[0], base[0], "x " * 60_000, "Z Y"]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "s", 1), (None, "one", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = [tuple(r) for r in simhash_groups(df, block=block).collect()]
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = components(prints, links)
    want = [(i, f"{prints[i]:016x}", root[i]) for i in prints] + [(3, f"{prints[3]:016x}", root[3]), (None, f"{prints[texts.index('one')]:016x}", root[texts.index("one")])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = [r["doc_id"] for r in one_of_each_group(df).collect()]
    assert sorted(kept, key=repr) == sorted(set(root.values()), key=repr)
    assert one_of_each_group(df).columns == df.columns
    assert simhash_groups(df.limit(0)).count() == 0


def test_one_row_of_each_group_by_row_not_id(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(rng.choice([f"w{i}" for i in range(99)], 200)) for _ in range(4))
    big = 2**60 + 1  # an id that no float holds
    rows = [(3, a), (7, a), (7, b), (7, c), (9, c), (2, d), (2, b), (big, "alone"), (big, "alone")] + [(None, "nobody")] * 40 + [(None, "other")]
    for parts in (1, 7):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(parts)
        got = [(r["doc_id"], r["text"]) for r in one_of_each_group(df).collect()]
        assert sorted(got, key=repr) == sorted([(3, a), (2, b), (7, c), (2, d), (big, "alone"), (None, "nobody"), (None, "other")], key=repr)


def test_e8_points_are_lattice_points_near_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, (500, 8))
    best, other = e8_nearest(x)
    for p in (best, other):
        assert ((p % 2 == 0).all(1) | (p % 2 == 1).all(1)).all()
        assert (p.sum(1) % 4 == 0).all()
    assert (((x - best / 2) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius is one
    assert (((x - best / 2) ** 2).sum(1) <= ((x - other / 2) ** 2).sum(1) + 1e-12).all()


@pytest.mark.parametrize("block", [16, 1024])
def test_near_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    for i in range(100, 160):
        x[i] = x[99] + rng.normal(0, 0.25, 64)
    for i in range(200, 280, 2):
        x[i + 1] = x[i] + rng.normal(0, 0.3, 64)
    x[290:295] = x[289]
    x[296] = 3 * x[295]
    x = x.astype("f4")
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None, *[1.0] * 63]), (1004, []), (1005, [1.0, 2.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + [(*o, 1, "x") for o in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: r for r in near_vectors(df, block=block).collect()}
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = components(range(300), [(int(a), int(b)) for a, b in np.argwhere(near)])
    found = sum(got[i]["n_links"] for i in range(300))
    assert found >= 0.97 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(300))
    assert np.mean([got[i]["component_id"] == root[i] for i in range(300)]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(300))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(1000, 1006))
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, None)
    assert near_vectors(df, block=block).count() == len(rows)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows,block_rows,spread", [(4096, 1024, 0), (40, 5, 0), (40, 5, 2)])
def test_top_products_against_brute_force(spark, bucket_rows, block_rows, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[:40] = x[0] + rng.normal(0, 0.05, (40, 16))
    x = (x * np.exp(spread * rng.normal(size=(300, 1)))).astype("f4")
    x[50:60] = x[49]
    odd = [(1000, None), (1020, [float("inf")] * 16), (1040, [None] * 16), (None, x[0].tolist()), (20, x[20].tolist()), (1060, [1.0, 2.0]), (1061, [1.0, -3.0]), (1080, [])]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(*o, 1) for o in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in top_products(df, F.col("vec_id") % 20 == 0, 20, bucket_rows=bucket_rows, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(64 * x.astype("f8")).astype("i8")
    want = {1060: [(1, 1061, 64 * 64 - 3 * 64 * 2 * 64)]}
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = [int(j) for j in np.lexsort((np.arange(300), -s)) if j != i][:20]
        want[i] = [(n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_products(df, F.lit(False)).count() == 0


def plain_top(rows, is_query, k):
    import math

    kept = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, q in kept:
        if is_query(i):
            scored = sorted(((max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, p, strict=True)))), j, m) for m, j, p in kept if m != n), key=lambda r: (-r[0], r[1], r[2]))
            out += [(i, rank, j, s) for rank, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_products_of_long_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [2.0, 1.0]), (20, [1e9, 1.0]), (3, [1e9 + 1, 3.0]), (20, [-1e9, 2.0]), (40, [9e15, -9e15]), (4, [9e15, 9e15]), (5, [1e16, 1.0])]
    df = spark.createDataFrame([*rows, (60, [1e300, 1.0])], "vec_id long, embedding array<double>")
    for bucket_rows in (2, 4096):
        got = sorted(tuple(r) for r in top_products(df, F.col("vec_id") % 20 == 0, 6, bucket_rows=bucket_rows).collect())
        assert got == plain_top(rows, lambda i: i % 20 == 0, 6)
    probe = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert [r["score"] for r in top_products(probe, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [12288, 8192, 4096]


def test_one_row_stays_where_other_columns_differ(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, "e f g h", "z"), (None, "e f g h", "w")]
    got = set()
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got.add(tuple(sorted((tuple(r) for r in one_of_each_group(df).collect()), key=repr)))
    assert len(got) == 1 and [r[0] for r in got.pop()] == [1, None]
