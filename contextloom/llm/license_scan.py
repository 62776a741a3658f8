"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the positions of the license templates: pairs for the
base phrases, triples for notices and whole license texts, which ordinary prose hardly ever shares. The join is on the
hash of a gram's first two words, and all its words are compared there, so hashes never decide. A match of text position
p with template position t is a vote for the diagonal p - t. Diagonals within ``MERGE`` words of one another (words were inserted or left out) are merged: around each
diagonal, the distinct template positions that vote within that reach, over all of the template's, are its cover. The words that tell a license from its kin (versions, non-commercial) must be in it: without the triples that end in
them there is no cover, however long the rest of a notice is. Words
repeated in a text so vote once, and each vote counts only near the place where the template has it. A span is verified
when its cover is at least ``min_cover``; of a run of such diagonals the best one gives the span.

The text is scanned once: a marker rides along with the grams of each row, so rows without any license come out of the
same aggregation, and only markers and votes shuffle, counted before they do.

Defined cases: a null or wordless text has n_words 0 and no labels; repeated rows and ids come out once each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.llm.common import text_of

# Phrases and labels of the base scan.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Openings and notices of public licenses, as words, with labels of this scan.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-notice"),
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
# Words of these that tell one license from its kin; every triple that they stand in must be there.
TELLING = {"gpl-3.0": ("3",), "apache-2.0": ("2", "0"), "cc-by-nc-4.0": ("nc", "4", "0"), "cc-by-4.0": ("attribution", "4", "0"), "mpl-2.0": ("2", "0")}
# Texts of public licenses, or of the notices that they ask for, with labels of this scan.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit-full"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""", "bsd-2-clause"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""", "isc"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-header"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see <https://www.gnu.org/licenses/>.""", "gpl-header"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely""", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means.""", "unlicense"),
)
MERGE = 8
MARK = -1
MASKS, MASK_BITS = 4, 62  # template positions as bits of four numbers


def template_rows() -> list[tuple[int, str, bool, int, int, int, int, bool, str, str, str]]:
    """(template, label, is_base, k, n_grams, n_must, position, must, words of the gram) of every k-gram of the templates.

    A gram must be covered if it ends in a telling word.
    """
    rows = []
    for number, (text, label) in enumerate((*BASE, *NOTICES, *TEXTS)):
        k = 2 if number < len(BASE) else 3
        w = re.findall(r"[a-z0-9]+", text.lower())
        grams = [(w[i : i + k] + [""])[:3] for i in range(len(w) - k + 1)]
        if len(grams) > MASKS * MASK_BITS:
            raise ValueError(f"{label} has more than {MASKS * MASK_BITS} positions")
        must = [k == 3 and g[-1] in TELLING.get(label, ()) for g in grams]
        if any(must[MASK_BITS:]):
            raise ValueError(f"{label} has telling words beyond {MASK_BITS} positions")
        rows += [(number, label, k == 2, k, len(grams), sum(must), t, must[t], *g) for t, g in enumerate(grams)]
    return rows


def _values() -> str:
    rows = [f"({m}, '{label}', {base}, {k}, {n}, {least}, {t}, {must}, '{a}', '{b}', '{c}')" for m, label, base, k, n, least, t, must, a, b, c in template_rows()]
    return ", ".join(rows)


def templates(spark: SparkSession) -> DataFrame:
    """The template positions, a fixed table of some hundred rows, and the marker."""
    names = "template, label, is_base, k, n_grams, n_must, t, must, w1, w2, w3"
    rows = spark.sql(f"SELECT * FROM VALUES {_values()} AS v({names})")
    marker = spark.sql(f"SELECT {MARK} AS template, '' AS label, false AS is_base, 2 AS k, 1 AS n_grams, 0 AS n_must, 0 AS t, false AS must, '' AS w1, '' AS w2, '' AS w3")
    return rows.unionByName(marker).withColumn("gram", F.when(F.col("template") == MARK, F.lit(MARK).cast("long")).otherwise(F.xxhash64("w1", "w2")))


def votes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Votes by row, template and diagonal, their template positions as bits; for each row also a marker, of template -1.

    Lower-casing is Unicode's, not only that of A-Z: it moves no word boundary, and no letter outside ASCII becomes
    one of a template's, save the Kelvin sign, which is kept apart.
    """
    low = F.lower(F.replace(text_of(text), F.lit("\u212a"), F.lit("\u00c5")))
    flat = F.btrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    words = F.when(flat == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(flat, " "))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    grams = rows.select("doc_id", "row", "words", F.size("words").cast("long").alias("n_words"), F.concat(pairs, F.array(F.lit(MARK).cast("long"))).alias("grams"))
    at = grams.select("doc_id", "row", "n_words", "words", F.posexplode("grams").alias("p", "gram"))
    word = lambda n: F.get("words", F.col("p") + n)
    same = (F.col("template") == MARK) & (F.col("p") == F.col("n_words")) | (
        (F.col("template") != MARK) & (word(0) == F.col("w1")) & (word(1) == F.col("w2")) & ((F.col("k") == 2) | (word(2) == F.col("w3")))
    )
    bit = F.expr(f"shiftleft(1L, t % {MASK_BITS})")
    masks = [F.bit_or(F.when(F.floor(F.col("t") / MASK_BITS) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in range(MASKS)]
    return (
        at.join(F.broadcast(templates(docs.sparkSession)), "gram").where(same)
        .groupBy("row", "doc_id", "n_words", "template", (F.col("p") - F.col("t")).alias("diagonal"))
        .agg(*masks, F.bit_or(F.when(F.col("must"), bit).otherwise(F.lit(0).cast("long"))).alias("told"), F.first("n_must").alias("n_must"), F.min("t").alias("from_t"), F.max(F.col("t") + F.col("k") - 1).alias("to_t"),
             F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("n_grams").alias("n_grams"))
    )


def positions(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, map(F.bit_count, masks))


def merged(v: DataFrame) -> DataFrame:
    """Each diagonal with its own votes and, over the diagonals within its reach, cover and bounds.

    A base phrase stands on one diagonal, so its diagonals have no reach. A span begins and ends where its first and
    last covered template positions stand; of several places, on the diagonal with the most votes.
    """
    line = F.when(F.col("is_base"), F.col("diagonal").cast("long") * (MERGE + 1)).otherwise(F.col("diagonal"))
    reach = Window.partitionBy("row", "template").orderBy(line).rangeBetween(-MERGE, MERGE)
    names = [f"m{j}" for j in range(MASKS)]
    near = positions([F.bit_or(m).over(reach) for m in names])
    cover = F.when(F.bit_count(F.bit_or("told").over(reach)) == F.col("n_must"), near / F.col("n_grams")).otherwise(0.0)
    v = v.withColumn("votes", positions([F.col(m) for m in names]))
    first = F.min_by(F.col("diagonal") + F.col("from_t"), F.struct("from_t", -F.col("votes")))
    last = F.max_by(F.col("diagonal") + F.col("to_t"), F.struct("to_t", "votes"))
    return v.select(
        "row", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "diagonal", "votes", cover.alias("cover"),
        first.over(reach).cast("long").alias("first_word"), last.over(reach).cast("long").alias("last_word"),
    )


def license_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_cover: float = 0.75) -> DataFrame:
    """One row per verified span: doc_id, label, first_word, last_word (inclusive), cover."""
    m = merged(votes(docs, text, doc_id)).where((F.col("template") != MARK) & (F.col("cover") >= min_cover))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    far = (F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(line) > MERGE)).cast("int")
    m = m.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("span", F.sum("far").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("first_word", "last_word", "cover"), F.struct("cover", "votes", -F.col("diagonal"))).alias("best")
    return m.groupBy("row", "doc_id", "template", "span", "label").agg(best).select("doc_id", "label", "best.*")


def license_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_cover: float = 0.75) -> DataFrame:
    """One row per document: places of the base phrases, labels and the best cover."""
    m = merged(votes(docs, text, doc_id))
    whole = F.col("is_base") & (F.col("votes") == F.col("n_grams"))
    join = lambda found: F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",")
    found = (F.col("template") != MARK) & (whole | ~F.col("is_base") & (F.col("cover") >= min_cover))
    return (
        m.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(whole).alias("n_base"),
            F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
            join(whole).alias("base_labels"),
            join(found).alias("labels"),
            F.round(F.max(F.when(F.col("template") == MARK, 0.0).otherwise(F.col("cover"))), 6).alias("score"),
        )
        .drop("row")
    )


#: From the definition: around each diagonal, the distinct template positions that any vote within reach has.
REPORT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT r, unnest(range(1, len(words))) AS i, words FROM d),
g AS (SELECT r, i - 1 AS p, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3 FROM p),
t(template, label, is_base, k, n_grams, n_must, t, must, w1, w2, w3) AS (VALUES {_values()}),
v AS (SELECT r, template, label, is_base, n_grams, n_must, must, p, t, p - t AS diagonal
      FROM g JOIN t ON g.w1 = t.w1 AND g.w2 = t.w2 AND (t.k = 2 OR g.w3 = t.w3)),
a AS (SELECT DISTINCT r, template, diagonal FROM v),
c AS (SELECT a.r, a.diagonal, label, is_base, CASE WHEN count(DISTINCT t) FILTER (must) = n_must THEN count(DISTINCT t)::DOUBLE / n_grams ELSE 0 END AS cover,
             is_base AND count(DISTINCT t) FILTER (v.diagonal = a.diagonal) = n_grams AS whole
      FROM a JOIN v ON v.r = a.r AND v.template = a.template AND abs(v.diagonal - a.diagonal) <= CASE WHEN v.is_base THEN 0 ELSE {MERGE} END
      GROUP BY a.r, a.template, a.diagonal, label, is_base, n_grams, n_must),
o AS (SELECT r, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label) FILTER (whole OR (NOT is_base AND cover >= 0.75))), ',') AS labels,
        max(cover) AS score FROM c GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN o USING (r)
"""
