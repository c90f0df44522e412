"""Quality classifier, language model and pipeline: held-out accuracy, odd rows, plain versions of the stages."""

import importlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundledger.llm import language_model as lm
from soundledger.llm.quality import score_documents, train

SF = "/root/testdata/sf0.01"
crc = lambda i: zlib.crc32(str(i).encode())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    got = score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.array_equal(train(docs.repartition(5), labels).evidence(), model.evidence())
    # Flipped labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(train(docs, flipped).evidence(), model.evidence())


def test_quality_on_odd_rows(spark):
    good, bad = "Ein Satz mit Wörtern und noch einem Wort. ", "!! %% ## @@ "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5), "x", 1) for i in range(60)]
    odd = [(100, None, "x", 1), (101, "", "x", 1), (102, bad * 20_000, "x", 1), (103, "a", "x", 1), (3, rows[3][1], "x", 1), (None, good, "x", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 1, 0), (7, None, 0), (None, 1, 0), (8, 3, 1), (999, 1, 0)], "doc_id long, quality int, score int")
    model = train(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["score"] == by[101]["score"] and by[102]["predicted"] == 0 and not by[None]["held_out"] and by[None]["predicted"] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert score_documents(docs.limit(0), model).count() == 0
    none = train(docs, labels.limit(0))
    assert all(r["score"] == pytest.approx(0.5) for r in score_documents(docs, none).collect())


def texts_of(n):
    rng = np.random.default_rng(6)
    words = ["der", "die", "Haus", "über", "lang", "kurz", "geht", "steht", "schön", "Tag"]
    return [" ".join(rng.choice(words, 60)) + ".\n" for _ in range(n)]


def test_language_model(spark, monkeypatch):
    texts = texts_of(300)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (1002, "neu " * 60_000, "x", 1.0), (5, texts[5], "x", 1.0), (None, "ohne Id", "x", 1.0), (1003, "QXZ\x00 \x1f\x85 漢字", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score double")
    monkeypatch.setattr(lm, "HEAD", 4)
    got = lm.score_texts(df).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter(w for i, t, *_ in rows if i is None or crc(i) % 10 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t, *_ in rows:
        ws = tokens(t)
        want[i] = (i is not None and crc(i) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n, sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    for r in got:
        held, n_tokens, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n_tokens, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    by = {r["doc_id"]: r["score"] / np.log10(2) for r in got}
    held = [i for i in range(300) if crc(i) % 10 == 0]
    bits = -sum(by[i] for i in held) / sum(len(texts[i].encode()) + 1 for i in held)
    frequencies = Counter(b for t in texts for b in t.encode())
    whole = sum(frequencies.values())
    assert bits < 0.4 * -sum(c / whole * np.log2(c / whole) for c in frequencies.values())
    assert -by[1003] / len("QXZ\x00 \x1f\x85 漢字".encode()) > 2 * bits
    assert lm.score_texts(df.limit(0)).count() == 0
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in lm.score_texts(df.filter(F.col("doc_id") == held[0])).collect())


def test_model_is_a_distribution_over_the_next_byte(spark):
    df = spark.createDataFrame([(t,) for t in texts_of(50)], "t string")
    model = lm.train(df)
    for context in (b"der H", b"\xfe" * 5, b"zzzzz"):
        grams = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)], "u8")
        assert (2 ** -model.bits(grams)).sum() == pytest.approx(1)


def test_model_counts_contexts_exactly_and_knows_unseen_ones(spark):
    rng = np.random.default_rng(9)
    text = "".join(map(chr, rng.integers(97, 123, 400_000)))
    model = lm.train(spark.createDataFrame([(text[:150_000],), (text[150_000:],)], "t string"))
    grams = np.concatenate([g for g, _, _ in lm.gram_chunks([text[:150_000], text[150_000:]])])
    asked = np.r_[grams[:200], grams[-200:], np.concatenate([g for g, _, _ in lm.gram_chunks(["".join(map(chr, rng.integers(97, 123, 400)))])])]
    got = model.counts(asked).paths(asked)
    for order in range(1, 6):
        for bits in range(9):
            key = lambda g: (g & np.uint64((1 << (8 * order + 8)) - 1)) >> np.uint64(8 - bits)  # noqa: B023, E731
            count = Counter(key(grams).tolist())
            assert got[order - 1, bits].tolist() == [count[k] for k in key(asked).tolist()]
    # 3 million bits of order 5: more than a table of fixed size told apart.
    assert (got[4, 0, 400:] == 0).mean() > 0.9


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    texts = ["abcdefghijklmnopqrst" * 5, "", None, "xyz", "ü" * 40]

    def all_grams():
        found = []
        for grams, of, starts in lm.gram_chunks(texts):
            ends = [*starts[1:], len(grams)]
            found += [(int(i), int(g)) for i, a, b in zip(of, starts, ends, strict=True) for g in grams[a:b]]
        return found

    whole = all_grams()
    assert whole[:2] == [(0, int.from_bytes(b"\xfe" * 5 + b"a", "big")), (0, int.from_bytes(b"\xfe" * 4 + b"ab", "big"))]
    assert len(whole) == sum(len((t or "").encode()) + 1 for t in texts)
    monkeypatch.setattr(lm, "CHUNK", 7)
    assert all_grams() == whole


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality, dedup, mixing, packing = (f for _, f in pipeline.STAGES)
    scored = score_documents(docs, train(docs, labels))
    kept = quality(spark, docs, SF)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in scored.filter("predicted = 1").select("doc_id").collect()}
    single = dedup(spark, kept, SF)
    texts = [r["text"] for r in single.select("text").collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] for r in kept.select("text").collect()}
    mixed = mixing(spark, single, SF)
    assert sorted(mixed.columns) == sorted(docs.columns)
    packed = packing(spark, mixed, SF)
    rows = mixed.groupBy("doc_id").count()
    starts = packed.filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert rows.join(starts, "doc_id", "left").filter("count <> n or n is null").count() == 0
    whole = packed.agg(F.sum("length")).first()[0]
    assert pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == whole
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "x", None, 0), (-1, "", "x", None, 0)], docs.schema)).withColumn("score", F.lit(1)).withColumn("key", F.lit("k"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 1
