"""License scans, mixing, packing, chats and archives on odd rows and against plain versions."""

import hashlib
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundledger.llm import mixing, queries
from soundledger.llm.chat import CHAT_SQL, format_chats
from soundledger.llm.licenses import TEMPLATES, license_spans, license_sql, scan_licenses
from soundledger.llm.mixing import MAX_PASSES, WEIGHTS, mix, mix_plan, mixed_documents
from soundledger.llm.packing import CAPACITY, END_ID, cuts, pack_documents
from soundledger.llm.warc import read_warc, warc_round_trip, write_warc

SCHEMA = "doc_id long, text string, source string, size int, shard int, k int, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 1, len(t or "")) for i, t, s in rows], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_licenses(spark):
    mit, apache = TEMPLATES[2][1], TEMPLATES[4][1]
    broken = mit.split()
    del broken[60:62]
    isc = TEMPLATES[-1][1]
    inserted = isc.split()
    inserted[15:15] = "page 7 of Some Company Limited".split()
    pieces = [isc.split()[i : i + 3] for i in range(0, len(isc.split()), 3)]
    shuffled = [w for i in range(0, len(pieces) - 1, 2) for w in pieces[i + 1] + pieces[i]]
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, "the MIT\nLicense, mit-license; MITlicense General  Public LICENSE", "a"),
        (4, f"Wörter davor. {' '.join(broken)} und danach {apache}", "a"),
        (5, "Released under the MIT License. x Released under the MIT License.", "a"),
        (6, "Licensed under CC BY-NC 4.0.", "a"),
        (7, "word " * 50_000 + "apache license", "a"),
        (7, "another text of this id under the apache license", "a"),
        (5, "Released under the MIT License. x Released under the MIT License.", "a"),
        (None, "mit license", "a"),
        (8, "permission is hereby granted", "a"),
        (9, " ".join(inserted), "a"),
        (10, " ".join(shuffled), "a"),
        (11, "released under the M\u0130T license by \u212aelvin", "a"),
        (12, " ".join([isc] * 30), "a"),
        (13, "Licensed under CC and then fifteen other words stand here before BY-NC 4.0.", "a"),
    ]
    df = docs(spark, rows)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    con = duckdb.connect()
    documents = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({license_sql()})").fetchall(), key=repr)
    got = plain(scan_licenses(df).select(names))
    assert got == want
    by = {r[0]: r for r in got if r[0] not in (5, 7)}
    assert by[1][1:] == (0, 0, None, None, "", "", 0.0)
    assert by[3][1:6] == (9, 3, 1, 6, "gpl,mit")
    assert by[4][6] == "apache,mit" and by[4][7] > 0.9
    assert by[9][6] == "isc" and by[9][7] > 0.9, "a notice broken in its middle"
    assert by[10][6] == "" and by[11][6] == "" and by[12][6:] == ("isc", 1.0) and by[13][6] == ""
    assert by[6][5:] == ("", "cc-by-nc-4.0", 1.0) and by[8][6] == ""
    spans = license_spans(df.select(F.col("doc_id").alias("id"), F.lit(0).alias("mark"), F.coalesce("text", F.lit("")).alias("text")))
    assert {(r["first"], r["last"]) for r in spans.collect() if r["id"] == 6} == {(0, 6)}
    assert scan_licenses(df.limit(0)).count() == 0


def plain_targets(sizes):
    """Reshare the excess over the limits by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > MAX_PASSES * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = float(MAX_PASSES * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


ROWS = [(i, " ".join(f"w{j}" for j in range(1 + i % 13)) + "\n", f"s{i % 5}") for i in range(60)]
ROWS += [(100 + i, "lang " * 400, "s1") for i in range(5)] + [(200, None, None), (201, " \t", None), (202, "x y", None), (203, "", "leer"), (5, ROWS[5][1], "s0"), (5, ROWS[5][1], "s0"), (None, "ohne id", "Ä")]


def test_mix(spark):
    df = docs(spark, ROWS)
    got = plain(mix_plan(df).drop("first_time"))
    assert got == plain(mix_plan(df.repartition(7)).drop("first_time"))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = plain_targets(sizes)
    source_of = {i: s for i, _, s in ROWS}
    taken = dict.fromkeys(sizes, 0)
    for doc, n, source_size, target, words in got:
        s = source_of[doc]
        assert source_size == sizes[s] and target == pytest.approx(targets[s]) and 0 <= words <= MAX_PASSES * n
        taken[s] += words
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted((d, n) for d, n, *_ in got if d is not None) == sorted((i, size(t)) for i, t, _ in ROWS if i is not None)
    assert mix_plan(df.limit(0)).count() == 0


def test_mixed_documents_are_the_plan_in_training_order(spark):
    df = docs(spark, ROWS)
    rows = mixed_documents(df).collect()
    assert mixed_documents(df).columns == df.columns
    words = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"] or "")
    plan = {}
    for doc, _, _, _, taken in plain(mix_plan(df).drop("first_time")):
        plan[doc] = plan.get(doc, 0) + taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}
    times = [t for r in mix(df).select("__mix.times").collect() for t in r["times"]]
    assert len(times) == len(rows) and all(0 <= t <= 1 for t in times)


def test_mixing_query_counts_the_passes_that_the_curriculum_places(spark, monkeypatch):
    df = docs(spark, ROWS)
    monkeypatch.setattr(queries, "read", lambda *_: df)
    whole = plain(queries.op4_mixing(spark, ""))
    place = mixing.arrival
    monkeypatch.setattr(mixing, "arrival", lambda u, slope: F.when(slope <= 0, place(u, slope)))
    part = plain(queries.op4_mixing(spark, ""))
    assert len(whole) == len(part) == len(ROWS)
    order = sorted({s for _, _, s in ROWS}, key=lambda s: (s is None, s or ""))
    late = {s for i, s in enumerate(order) if mixing.SLOPES[i % 3] > 0}
    source_of = {i: s for i, _, s in ROWS}
    lost = [r for r in whole if source_of[r[0]] in late and r[4]]
    assert lost and part == sorted((r[:4] + (0,) if r in lost else r for r in whole), key=repr)


def test_mixing_query_carries_the_mix_out_in_training_order(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 13)), [f"s{i % 4}", None][i % 5 == 0]) for i in range(80)] + [(300, None, "s1"), (301, "", None)]
    df = docs(spark, rows)
    monkeypatch.setattr(queries, "read", lambda *_: df)

    def check():
        got = [tuple(r) for r in queries.op4_mixing(spark, "").collect()]
        mixed = mixed_documents(df).collect()
        words = dict.fromkeys((r[0] for r in rows), 0)
        for r in mixed:
            words[r["doc_id"]] += len((r["text"] or "").split())
        met = list(dict.fromkeys(r["doc_id"] for r in mixed))
        assert [r[0] for r in got][: len(met)] == met, "rows come as their first passes do"
        assert {r[0]: r[4] for r in got} == words and len(got) == len(rows)
        return got

    early = check()
    assert early[-1][4] == 0 < early[0][4]
    place = mixing.arrival
    monkeypatch.setattr(mixing, "arrival", lambda u, slope: 1 - place(u, slope))
    late = check()
    assert late != early and sorted(late) == sorted(early)
    passes = mixing.ordered_passes
    monkeypatch.setattr(mixing, "ordered_passes", lambda *a, **rule: passes(*a, **rule).withColumn("text", F.when(F.col("doc_id") != late[0][0], F.col("text"))))
    assert {r[0]: r[4] for r in queries.op4_mixing(spark, "").collect()} == {r[0]: r[4] for r in late} | {late[0][0]: 0}, "words are counted in the texts of the passes"


def test_cuts_fill_their_classes():
    for r, pieces in enumerate(cuts()):
        assert sum(p[0] for p in pieces) == r
        assert all(0 < length <= CAPACITY // k for length, k in pieces)


def test_packing(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a" * 3000, "!? 12'll <|endoftext|> x", "ﬁ 漢字    🙂 \x85\x1c", "Zeile\r\n\n\n  Ende ", "word " * 30_000, "é́ ñ Ü\xa0\xad"]
    rows = ROWS + [(300 + i, t, "o") for i, t in enumerate(odd)]
    df = docs(spark, rows)
    got = pack_documents(df, with_ids=True).toPandas()
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t, _ in rows if i is not None}
    copies = {i: sum(r[0] == i for r in rows) for i in ids}
    for i, all_ids in ids.items():
        mine = got[got.doc_id == i].sort_values("start")
        assert (mine.doc_tokens == len(all_ids)).all() and mine.length.sum() == copies[i] * len(all_ids)
        for start, length, crc, piece in mine[["start", "length", "ids_crc32", "ids"]].itertuples(index=False):
            assert list(piece) == all_ids[start : start + length]
            assert crc == zlib.crc32(np.array(piece, "<u4").tobytes())
        places = mine.drop_duplicates("start")
        assert (places.length.cumsum() - places.length == places.start).all()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert by.groupby("sequence_id").length.sum().max() <= CAPACITY
    assert len(got[got.doc_id.isna()]) == 1
    assert pack_documents(df.limit(0)).count() == 0


def test_packing_very_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "b", "a" + " \n" * 600_000, ("a" + " " * 90_000) * 5]
    got = pack_documents(docs(spark, [(i, t, "o") for i, t in enumerate(texts)])).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(exact.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_packing_many_documents_pads_little(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', CAST(50 + pmod(id * 7919, 1500) AS INT))").alias("text"))
    used = pack_documents(df).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = used.filter("bit_count(n) > 1").agg(F.sum(CAPACITY - F.col("n"))).first()[0]
    assert pad <= 0.03 * used.agg(F.sum("n")).first()[0]


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "yo"), (5, 2, "user", "more"),
        (6, 0, "user", None), (7, 0, "user", ""), (8, 0, None, ""), (8, 0, None, ""),
        (9, None, "user", "first"), (9, 1, "user", "x" * 50_000),
        (None, 0, "user", "hi"), (None, 1, "assistant", "nobody"),
    ] + [(20, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)] + [(21, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(299)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, a string")
    con = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    got = format_chats(df)
    want = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({CHAT_SQL})").fetchall(), key=repr)
    assert plain(got) == want
    assert {r[0] for r in want} == {2, 3, 6, 7, 8, 9, 20, None} and dict((r[0], r[2]) for r in want)[2] == 2
    assert format_chats(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    long = "<p>" + "ü" * 1000
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, "http://a/ü?\r\n", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", long), (9, "http://a/9", long), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    got = plain(warc_round_trip(df, f"{tmp_path}/a", shard_bytes=2000, file_bytes=1000))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = h == long and i != 9
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=repr)
    again = plain(write_warc(df.repartition(5), f"{tmp_path}/b", shard_bytes=2000, file_bytes=1000).select("file", "records", "bytes", "sha1"))
    assert again == plain(spark.read.parquet(f"{tmp_path}/a/manifest").select("file", "records", "bytes", "sha1"))
    assert len(again) > 3
    (tmp_path / "b" / ".shard-000000-00000.warc.gz.lost").write_bytes(b"an attempt that died")
    full = {r["page_id"]: bytes(r["payload"]).decode() for r in read_warc(spark, f"{tmp_path}/b", payloads=True).collect() if r["record_type"] == "response"}
    assert full == {i: h or "" for i, _, h in rows if not (h == long and i != 9)}
    assert warc_round_trip(df.limit(0), f"{tmp_path}/c").count() == 0
