"""License scans by diagonal voting of word k-grams, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals that differ by at most this many words belong to one span: room for inserted or missing words. Long templates
#: have more, a quarter of their words up to MOST_SLACK: a page header or a company's name in the middle.
SLACK = 3
MOST_SLACK = 40
#: Share of a template's words that a span must hold.
MIN_COVER = 0.7

#: The phrases asked for, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence texts and notices, each with its label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in"
        " the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the"
        " License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of"
        " source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
        " and this permission notice appear in all copies.",
    ),
)


def template_grams(templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K) -> list[tuple]:
    """``(template, label, words, at, w0..)`` for each word k-gram of each template: a table as long as the templates."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = re.findall(r"[0-9a-z]+", text.lower())
        rows += [(number, label, len(words), i, *words[i : i + k]) for i in range(len(words) - k + 1)]
    return rows


def _template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    names = [f"w{i}" for i in range(K)]
    grams = spark.createDataFrame(template_grams(templates), "template int, label string, words int, at int, " + ", ".join(f"{n} string" for n in names))
    return grams.withColumn("gram", F.xxhash64(*names)).select("template", "label", "words", "at", "gram", F.struct(*names).alias("said"))


def base_places(words: Column) -> Column:
    """``(at, label)`` of each place where a phrase's words stand consecutively."""

    def starts(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            hit = F.lit(True)
            for j, w in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get(words, i + j) == w, F.lit(False))
            found = F.when(hit, label).otherwise(found)
        return found

    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.cast("long").alias("at"), starts(i).alias("label")))
    return F.filter(every, lambda p: p["label"].isNotNull())


def lowered(text: Column) -> Column:
    """Lower case in which no letter but A to Z becomes one of a to z: the Kelvin sign and the dotted I are kept apart."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u029e")), F.lit("\u0130"), F.lit("\u0131")))


def chain_words(hits: Column, words: Column) -> Column:
    """Most template words that a chain of hits ``(pos, -at)`` in document order covers whose template places rise, too.

    One number a template place is kept: the best chain that ends there. A hit looks at all places before its own.
    """
    none = F.array_repeat(F.lit(0), words.cast("int"))

    def step(best: Column, hit: Column) -> Column:
        at = -hit["back"]
        before = F.transform(F.slice(best, F.lit(1), at), lambda x, i: F.when(x > 0, x + F.least(F.lit(K), at - i)).otherwise(F.lit(K)))
        reach = F.greatest(F.lit(K), F.coalesce(F.array_max(before), F.lit(K)))
        return F.transform(best, lambda x, i: F.when(i == at, F.greatest(x, reach)).otherwise(x))

    return F.array_max(F.aggregate(F.array_sort(hits), none, step))


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cover: float = MIN_COVER, slack: int = SLACK) -> DataFrame:
    """``(id, mark, template, label, first, last, cover)``: verified spans of templates in documents ``(id, mark, text)``.

    Each rolling k-gram of a document joins the template places with its hash (a table of fixed length, so it is
    broadcast); the words behind equal hashes are compared. Hits vote for ``document place - template place``.
    Neighbouring diagonals merge; a span counts if a chain of its hits, in document and template order alike, holds enough
    of the template's words. So a notice broken by other words is whole, and its shuffled pieces are none.
    """
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    n = F.greatest(F.size("ws") - 1, F.lit(0))
    shifted = [F.col("ws"), *[F.slice("ws", F.lit(i + 1), n) for i in range(1, K)]]
    split = docs.select("id", "mark", F.transform(F.array(words), lambda ws: ws)[0].alias("ws"))
    rolled = split.select("id", "mark", F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])).alias("pos", "g"))
    g = [F.col("g")[f"w{i}"] for i in range(K)]
    hits = rolled.filter(g[-1].isNotNull()).withColumn("gram", F.xxhash64(*g)).join(F.broadcast(_template_table(docs.sparkSession, templates)), "gram")
    for i in range(K):
        hits = hits.filter(g[i] == F.col("said")[f"w{i}"])
    votes = hits.groupBy("id", "mark", "template", "label", "words", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_list(F.struct("pos", (-F.col("at")).alias("back"))).alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    room = F.greatest(F.lit(slack), F.least(F.lit(MOST_SLACK), F.expr("words div 4").cast("int")))
    along = W.partitionBy("id", "mark", "template").orderBy("diagonal")
    jump = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > room, F.lit(True))
    votes = votes.withColumn("jump", jump.cast("int")).withColumn("span", F.sum("jump").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = votes.groupBy("id", "mark", "template", "label", "words", "span").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last")
    )
    # Too few hits for the cover need no chain.
    enough = F.size("hits") * K >= F.col("words") * min_cover
    cover = F.when(enough, chain_words(F.col("hits"), F.col("words")) / F.col("words")).otherwise(0.0)
    return spans.withColumn("cover", cover).filter(F.col("cover") >= min_cover).drop("hits", "words", "span")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    ``score`` is the largest share of a template that a verified span holds, 0.5 at least where a phrase stands, else 0.
    Null and empty texts have no words and no labels. Rows that repeat an id are told apart by a hash of their texts;
    rows repeated exactly give equal rows. Null ids are kept. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    low = lowered(F.col("text"))
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    # A document without the last word of the phrases has none of them; the words are split once, inside the lambda.
    seen = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.when(F.contains(low, F.lit("license")), base_places(ws)).otherwise(none).alias("places")))[0]
    based = rows.select("id", "mark", seen.alias("seen")).select("id", "mark", "seen.n", "seen.places")
    spans = license_spans(rows, templates)
    found = spans.groupBy(F.col("id").alias("sid"), F.col("mark").alias("smark")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    base_labels = F.array_sort(F.array_distinct(F.col("places.label")))
    met = based.join(found, F.col("id").eqNullSafe(F.col("sid")) & (F.col("mark") == F.col("smark")), "left")
    return met.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def license_sql() -> str:
    """The scan over ``documents`` as DuckDB SQL: grams meet by their words instead of hashes."""
    grams = ", ".join(f"({t}, '{label}', {n}, {at}, '{a}', '{b}', '{c}')" for t, label, n, at, a, b, c in template_grams())
    base = " UNION ALL ".join(
        "SELECT rid, i - 1 AS place, '{}' AS label FROM starts WHERE {}".format(label, " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split())))
        for phrase, label in PHRASES.items()
    )
    return rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS rid, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM documents
    ), grams(template, label, words, place, w0, w1, w2) AS (VALUES {grams}),
    starts AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs),
    places AS ({base}),
    base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS found FROM places GROUP BY rid),
    votes AS (
        SELECT s.rid, g.template, g.label, g.words, s.i - 1 - g.place AS diagonal, list([s.i, -g.place]) AS hits
        FROM starts s JOIN grams g ON s.ws[s.i] = g.w0 AND s.ws[s.i + 1] = g.w1 AND s.ws[s.i + 2] = g.w2 GROUP BY ALL
    ), jumps AS (
        SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= greatest({SLACK}, least({MOST_SLACK}, words // 4)) THEN 0 ELSE 1 END AS jump FROM votes
    ), numbered AS (SELECT *, sum(jump) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM jumps),
    held AS (
        SELECT rid, template, label, CAST(list_max(list_reduce(list_prepend([CAST(0 AS BIGINT) FOR x IN range(words)], list_sort(hits)), lambda best, h:
            list_transform(best, lambda x, i: CASE WHEN i - 1 = -h[2]
                THEN greatest(x, {K}, coalesce(list_max(list_transform(best[1:-h[2]], lambda y, j: CASE WHEN y > 0 THEN y + least({K}, -h[2] - (j - 1)) ELSE {K} END)), {K})) ELSE x END))) AS DOUBLE) / words AS cover
        FROM (SELECT rid, template, label, words, span, flatten(list(hits)) AS hits FROM numbered GROUP BY ALL) WHERE len(hits) * {K} >= words * {MIN_COVER}
    ), found AS (SELECT rid, list_distinct(list(label)) AS more, max(cover) AS cover FROM held WHERE cover >= {MIN_COVER} GROUP BY rid)
    SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
           CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
           coalesce(array_to_string(b.found, ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(f.more, [])))), ',') AS labels,
           greatest(coalesce(f.cover, 0), CASE WHEN b.n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
    FROM docs d LEFT JOIN base b USING (rid) LEFT JOIN found f USING (rid)
    """
