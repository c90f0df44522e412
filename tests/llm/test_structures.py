"""Centroids, conversation tries and quality rules against plain versions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from soundledger.llm.centroids import cluster_vectors


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(x * 1024) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    small = lambda x: x if x < 2**63 else None
    per = [sum(d for _, d, n in final if n == m) for m in range(len(c))]
    return sorted(
        ((i, n, small(d), small(per[n]), small(sum(per)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in final), key=repr
    )


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "e": F.lit(2.0), "distance": F.lit(0)})


@pytest.mark.parametrize("far", [0.0, 3e6, 1e30])
def test_clusters_against_a_plain_version(spark, far):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 1)) * (i % 5) + rng.gauss(0, 0.3) for _ in range(64)]) for i in range(90)]
    rows += [(3, rows[3][1]), (3, [0.5] * 64), (None, [0.25] * 64), (None, rows[5][1]), (200, None), (201, [1.0] * 63), (202, [None] + [1.0] * 63), (203, [math.inf] + [0.0] * 63), (204, [math.nan] * 64), (205, [])]
    rows += [(300 + i, [1.0 + i % 2] * 64) for i in range(45)]
    if far:
        # Some start as centroids, others do not; centroids grow wide and narrow again.
        rows += [(400 + i, [far * (1 + i % 3)] + [0.0] * 63) for i in range(12)]
    got = sorted((tuple(r) for r in cluster_vectors(vectors(spark, rows).repartition(3)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == plain_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    assert cluster_vectors(vectors(spark, [])).count() == 0
    rows = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)]
    got = sorted((tuple(r) for r in cluster_vectors(vectors(spark, rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == plain_clusters(rows)


def plain_trie(rows):
    import zlib

    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        here = kids.get(p, [])
        leaves = sum(sums[k][0] for k in here) or 1
        saved = sum(sums[k][1] for k in here) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        sums[p] = leaves, saved
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), up, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"d": F.lit("x"), "k1": F.lit(1), "size": F.lit(2), "ends": F.lit(0), "pos": F.lit(5)})


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed):
    import random

    rng = random.Random(seed)
    rows = []
    for c in [*range(-120, -100), *range(0, 60), *range(150, 190), 300, 301]:
        n = rng.choice([1, 1, 2, 3, 7, 9])
        if c in (301, 17):
            n = 40
        for t in range(n):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["", None, "a", "bé", "ccc", "\U0001f600d"]) if c % 3 else "same"))
    # A conversation with a third of all rows, a near copy, an exact copy and one that it begins with.
    long = [(t // 2, "user", f"w{t % 7}") for t in range(260)]
    rows += [(500, *x) for x in long] + [(600, *x) for x in long[:-1]] + [(700, *x) for x in long] + [(800, *x) for x in long[:64]] + [(900, *x) for x in long[:65]]
    rows += [(600, 999, "user", "end")] + [(None, 1, "user", "none")] * 3 + [(1000, 1, "user", "twice")] * 9 + [(1000, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("level", "shard"), [(4, 5), (32, 20_000), (3, 1)])
def test_trie_against_a_plain_version(spark, level, shard):
    from soundledger.llm.trie import prefix_trie

    rows = conversations(level)
    got = trie_rows(prefix_trie(talk(spark, rows).repartition(4), level=level, shard=shard))
    want = plain_trie(rows)
    assert got == want


def test_trie_of_nothing_and_of_bare_conversations(spark):
    from soundledger.llm.trie import prefix_trie

    assert prefix_trie(talk(spark, [])).count() == 0
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 101, 102, 207)]
    assert trie_rows(prefix_trie(talk(spark, rows))) == plain_trie(rows)


def test_parentheses_and_rolling_hashes():
    import random

    import numpy as np

    from soundledger.llm.trie import BASES, PRIME, Parentheses, plus, power, rolled, times

    rng = random.Random(1)
    for size in (1, 3, 70, 900):
        opened, parens = 0, []
        while len(parens) < 2 * size:
            up = opened == 0 or (rng.random() < 0.55 and sum(x > 0 for x in parens) < size)
            parens.append(1 if up else -1)
            opened += parens[-1]
        stack, want = [], {}
        for i, x in enumerate(parens):
            if x > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.array(sorted(want))
        assert Parentheses(np.array(parens)).find_close(opens).tolist() == [want[i] for i in opens.tolist()]
    a, b = [rng.randrange(PRIME) for _ in range(50)], [rng.randrange(PRIME) for _ in range(50)]
    assert times(np.array(a), np.array(b)).tolist() == [x * y % PRIME for x, y in zip(a, b, strict=True)]
    assert plus(np.array(a), np.array(b)).tolist() == [(x + y) % PRIME for x, y in zip(a, b, strict=True)]
    assert power(BASES[0], np.arange(9)).tolist() == [pow(BASES[0], e, PRIME) for e in range(9)]
    place = np.array([0, 1, 2, 0, 0, 1, 2, 3, 4])
    h, now = [], 0
    for t, p in zip(a, place.tolist(), strict=False):
        now = t if p == 0 else (now * BASES[1] + t) % PRIME
        h.append(now)
    assert rolled(np.array(a[:9]), place, BASES[1]).tolist() == h


def plain_kneser_ney(texts, order=5):
    """log2 probability of a gram (a tuple of its bytes), from dictionaries."""
    from collections import Counter, defaultdict

    from soundledger.llm.ngram_rules import END, PAD, discounts

    def grams(text):
        raw = [PAD] * (order - 1) + list(text.encode()) + [END]
        return [tuple(raw[i : i + order]) for i in range(len(raw) - order + 1)]

    tables = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter()
        for g, c in tables[n + 1].items():
            tables[n][g[1:]] += c if g[1] == PAD else 1
    by = {}
    for n, table in tables.items():
        d = discounts([sum(c == k for c in table.values()) for k in (1, 2, 3, 4)])
        contexts = defaultdict(list)
        for g, c in table.items():
            contexts[g[:-1]].append(c)
        by[n] = d, contexts

    def p(g):
        n = len(g)
        if not n:
            return 1 / 257
        d, contexts = by[n]
        cs = contexts.get(g[:-1])
        if not cs:
            return p(g[1:])
        less = lambda c: d[min(c, 3) - 1]
        c = tables[n].get(g, 0)
        return (max(c - less(c), 0) if c else 0) / sum(cs) + sum(map(less, cs)) / sum(cs) * p(g[1:])

    return lambda text: -sum(math.log2(p(g)) for g in grams(text)) / (len(text.encode()) + 1)


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def rule_documents():
    import random

    rng = random.Random(2)
    common = "der die und the of and la le que".split()
    rows = []
    for i in range(130):
        lang = ("en", "de", None)[i % 3]
        words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(30, 150))]
        text = " ".join(words)
        if i % 20 == 3:
            text = "".join(chr(rng.randint(33, 2000)) + rng.choice("  \n") for _ in range(400))
        if i % 20 == 7:
            text = "a b c d\n" * 40
        rows.append((i, lang, text))
    rows += [(5, "en", rows[5][2])] * 4 + [(None, "en", "é # $ | x\x1cy\x85z " * 30), (201, "en", None), (202, "en", ""), (203, "xx", "one two three " * 3), (204, "yy", " ".join(f"w{i}" for i in range(70)))]
    return rows + [(205, "en", " ".join(f"{i:x}" for i in range(60_000)))]


def test_base_counts():
    import random

    from soundledger.llm.ngram_rules import base_counts

    rng = random.Random(3)
    texts = ["", " ", "\n\n", "a", "a b c a b c", "x\nx\n \nx", " | é\x0b#\x0c*\r\x1c\x85"]
    texts += ["".join(rng.choice("ab \n\t|#é　\U0001f600") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert [base_counts(t.encode()) for t in texts] == [plain_base(t) for t in texts]


@pytest.mark.parametrize("piece", [1 << 22, 3000])
def test_quality_rules_against_a_plain_version(spark, piece, monkeypatch):
    from soundledger.llm import ngram_rules

    rows = rule_documents()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"g": F.lit(1), "t": F.lit("x"), "low": F.lit(0), "kept": F.lit("no"), "n_words": F.lit(-1)})
    got = ngram_rules.quality_rules(docs.repartition(3), piece=piece).collect()
    models = [plain_kneser_ney([t or "" for _, _, t in rows if ngram_rules.fold((t or "").encode()) == f]) for f in (0, 1)]
    bits = lambda t: models[1 - ngram_rules.fold(t.encode())](t)
    want = {(i, lang, t or ""): (plain_base(t or ""), bits(t or "")) for i, lang, t in rows}
    assert len(got) == len(rows)
    have = sorted(((r["doc_id"], r["lang"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), 0) for r in got), key=repr)
    assert [h[:3] for h in have] == [w[:3] for w in sorted(((i, lang, want[i, lang, t or ""][0], 0) for i, lang, t in rows), key=repr)]
    near = {(i, lang, base): b for (i, lang, _), (base, b) in want.items()}
    for r in got:
        base = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert abs(r["bits_per_byte"] - near[r["doc_id"], r["lang"], base]) < 1e-3
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    # Bands: quartiles of the texts of a language that pass the base rules.
    for lang in {lang for _, lang, _ in rows}:
        mine = [r for r in got if r["lang"] == lang]
        bins = sorted(math.floor(r["bits_per_byte"] * 1000) for r in mine if not r["base_failed"])
        if bins:
            q1, q3 = (bins[-(-len(bins) * q // 4) - 1] for q in (1, 3))
            wide = max(q3 - q1, (q3 + q1) / 200)
            low, high = (q1 - 4 * wide) / 1000, (q3 + 1 + 2 * wide) / 1000
            assert all(r["kept"] == (not r["base_failed"] and low <= r["bits_per_byte"] <= high) for r in mine)
        else:
            assert not any(r["kept"] for r in mine)
    noise = [r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] % 20 == 3 and r["doc_id"] < 130]
    assert not any(noise) and sum(r["kept"] for r in got) > 100


def test_unseen_grams_step_back(spark):
    import numpy as np

    from soundledger.llm import ngram_rules

    texts = ["hello world, hello there", "her world", "wolf", "", "other wolves", "hell", "low"]
    for piece in (1 << 22, 20):
        half = [t for t in texts if ngram_rules.fold(t.encode()) == 0]
        model = ngram_rules.train(spark.createDataFrame([(t,) for t in texts], "t string"), piece=piece)[0]
        bits = plain_kneser_ney(half)
        new = ["hello wolf", "xyz", "heLlo", "", "worldé"]
        got = ngram_rules.text_costs([t.encode() for t in new], model) / 2**16 / np.array([len(t.encode()) + 1 for t in new])
        assert np.allclose(got, [bits(t) for t in new], atol=1e-3)
    empty = ngram_rules.train(spark.createDataFrame([], "t string"))[1]
    assert np.allclose(ngram_rules.text_costs([b"ab"], empty) / 2**16 / 3, math.log2(257), atol=1e-4)
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert ngram_rules.quality_rules(none).count() == 0
