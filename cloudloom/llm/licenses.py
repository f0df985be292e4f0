"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Templates are statements, notices, titles, SPDX tags and full texts of licences. Terms are the template words; those that name a licence count NAMED times
more in short templates, so that the statement of another licence is not taken for it. Their document frequency is counted over all files; words
outside the templates weigh as much as a term that no file has. Header candidates are every line and every paragraph (lines between lines without a word)
of every file, no prefix is cut; files named like a licence are also compared as a whole, and if that matches it goes before
their parts. A unit can reach the threshold only if template terms carry that share of its weight, so
most stop at that test; the others meet the templates in a join by term. A file's own licence is its best match. A directory's licence is the one most of its own
files carry; files without one inherit from their nearest ancestor directory that has a licence, by joins on directory paths.

Null and empty texts match nothing and inherit. Null paths are in no directory. Repeated rows are each reported. Very long texts are compared whole, paragraph by
paragraph. Ties go to the first licence name. An empty table gives no rows. Extra columns are carried by `scan`; its result columns replace columns of
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, item_words, small, staged, table

#: Licence, the words that name it, and a statement, notice, title, tag or full text.
TEMPLATES = (
    ("Apache-2.0", "apache", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "apache", "apache license version 2.0 january 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", "", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("Apache-2.0", "apache", "spdx license identifier apache 2.0"),
    ("MIT", "mit", "released under the mit license"),
    ("MIT", "mit", "licensed under the mit license"),
    ("MIT", "mit", "the mit license mit"),
    ("MIT", "mit", "spdx license identifier mit"),
    ("MIT", "", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", "", """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "bsd 2 2", "spdx license identifier bsd 2 clause"),
    ("BSD-2-Clause", "", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
        OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "bsd 3 3", "spdx license identifier bsd 3 clause"),
    ("BSD-3-Clause", "", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-3-Clause", "", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
        OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", "isc", "spdx license identifier isc"),
    ("ISC", "", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies."""),
    ("GPL-2.0", "gpl 2 2", "spdx license identifier gpl 2.0 only"),
    ("GPL-2.0", "gpl 2 2", "spdx license identifier gpl 2.0 or later"),
    ("GPL-2.0", "2", "gnu general public license version 2 june 1991"),
    ("GPL-2.0", "", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0", "gpl 3 3", "spdx license identifier gpl 3.0 only"),
    ("GPL-3.0", "gpl 3 3", "spdx license identifier gpl 3.0 or later"),
    ("GPL-3.0", "3", "gnu general public license version 3 29 june 2007"),
    ("GPL-3.0", "", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "lgpl 3 3", "spdx license identifier lgpl 3.0 or later"),
    ("LGPL-3.0", "lesser 3", "gnu lesser general public license version 3 29 june 2007"),
    ("LGPL-3.0", "lesser", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", "agpl 3", "spdx license identifier agpl 3.0 or later"),
    ("AGPL-3.0", "affero 3", "gnu affero general public license version 3 19 november 2007"),
    ("AGPL-3.0", "affero", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL-2.0", "mozilla", "subject to the terms of the mozilla public license v 2.0"),
    ("MPL-2.0", "mozilla", "mozilla public license version 2.0"),
    ("MPL-2.0", "mpl", "spdx license identifier mpl 2.0"),
    ("MPL-2.0", "", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "unlicense", "spdx license identifier unlicense"),
    ("Unlicense", "", "this is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "cc0", "spdx license identifier cc0 1.0"),
    ("CC0-1.0", "cc0", "creative commons legal code cc0 1.0 universal"),
    ("CC-BY-4.0", "by", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "", "licensed under cc by 4.0 creative commons attribution international"),
    ("CC-BY-4.0", "by", "spdx license identifier cc by 4.0"),
    ("CC-BY-SA-4.0", "by sa sa", "licensed under cc by sa 4.0"),
    ("CC-BY-SA-4.0", "by sa sa", "spdx license identifier cc by sa 4.0"),
    ("CC-BY-NC-4.0", "nc", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "by nc nc", "spdx license identifier cc by nc 4.0"),
    ("Zlib", "zlib", "spdx license identifier zlib"),
    ("Zlib", "", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software."""),
    ("BSL-1.0", "boost", "boost software license version 1.0 17 august 2003"),
    ("BSL-1.0", "bsl", "spdx license identifier bsl 1.0"),
)
#: How often a naming word counts besides its place in the text.
NAMED = 2
THRESHOLD = 0.7
#: File names that are compared as a whole.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: What separates paragraphs: two line ends with no word between them.
PARAGRAPH = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
RESULT = ("own_license", "score", "license", "inherited_from")


def template_terms(templates: tuple = TEMPLATES) -> list[tuple[str, dict[str, int]]]:
    """Licence and term frequencies of each template."""
    out = []
    for name, naming, text in templates:
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split() + NAMED * naming.split()
        out.append((name, {w: words.count(w) for w in words}))
    return out


def term_weights(files: DataFrame, templates: tuple = TEMPLATES) -> tuple[dict[str, float], float]:
    """The inverse document frequency of each template term, and that of an unseen term, over all files."""
    vocabulary = sorted({w for _, t in template_terms(templates) for w in t})
    terms = F.array(*map(F.lit, vocabulary))
    words = item_words(F.col("text"))
    n = files.count()
    df = dict(files.select(F.explode(F.array_intersect(words, terms)).alias("t")).groupBy("t").agg(F.count("*")).collect())  # one row a template term
    weight = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {w: weight(df.get(w, 0)) for w in vocabulary}, weight(0)


def units(files: DataFrame) -> DataFrame:
    """fid, whole (0: a licence file's text, 1: a line or paragraph), unit."""
    text = F.coalesce("text", F.lit(""))
    of = lambda whole: lambda u: F.struct(F.lit(whole).alias("whole"), u.alias("unit"))
    lines = F.transform(F.split(text, "\n", -1), of(1))
    paragraphs = F.transform(F.filter(F.split(text, PARAGRAPH, -1), lambda p: F.contains(p, F.lit("\n"))), of(1))
    whole = F.when(F.coalesce(F.col("path"), F.lit("")).rlike(LICENSE_FILE), F.transform(F.array(text), of(0))).otherwise(F.array())
    return files.select("fid", F.explode(F.concat(lines, paragraphs, whole)).alias("u")).select("fid", "u.*")


def squared_counts(words: Column) -> Column:
    """The sum of the squares of how often each word comes, in one pass over the sorted words: a word's k-th copy adds k * k - (k - 1) * (k - 1)."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("k"), F.lit(0.0).alias("total"))

    def step(so_far: Column, word: Column) -> Column:
        k = F.when(so_far["word"] == word, so_far["k"] + 1).otherwise(1)
        return F.struct(word.alias("word"), k.alias("k"), (so_far["total"] + 2 * k - 1).alias("total"))

    return F.aggregate(F.sort_array(words), start, step, lambda end: end["total"])


def matches(files: DataFrame, weights: dict[str, float], unseen: float, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """fid, license, score: the best template of every file that reaches the threshold. files: fid, path, text."""
    u = held(units(files), words=item_words(F.col("unit"))).drop("unit")
    u = held(u, n=F.size("words"), known=F.filter(F.col("words"), lambda w: w.isin(*weights)))
    # terms of every second file and more weigh little; `rare` ones may weigh as much as a word that no file has
    light = sorted(w for w in weights if weights[w] < unseen / 4)
    most_light = max((weights[w] for w in light), default=0.0)
    u = held(u, rare=F.size(F.filter(F.col("known"), lambda w: ~w.isin(*light))) if light else F.size("known"))
    # cheap bound of the cosine: known words weigh at most so much together, each other word at least `unseen`
    bound = threshold**2 / (1 - threshold**2)
    together = F.col("rare") * unseen + (F.size("known") - F.col("rare")) * most_light
    u = u.filter((F.size("known") > 0) & (together * together >= bound * (F.col("n") - F.size("known") - 2) * unseen**2))
    count_of = lambda words: lambda w: F.struct(w.alias("term"), F.size(F.filter(F.col(words), lambda x: x == w)).alias("tf"))
    u = held(u, other=F.filter(F.col("words"), lambda w: (w != "") & ~w.isin(*weights))).drop("words")
    # the words outside the templates have no bound, so counting them one by one would take the square of a unit's size
    u = held(u, other_sq=squared_counts(F.col("other")) * unseen**2, tfs=F.transform(F.array_distinct("known"), count_of("known")))
    idf = F.create_map(*(x for w, v in weights.items() for x in (F.lit(w), F.lit(v))))
    u = held(u, known_sq=F.aggregate("tfs", F.lit(0.0), lambda a, x: a + F.pow(x["tf"] * idf[x["term"]], 2))).filter(F.col("known_sq") >= bound * F.col("other_sq") * (1 - 1e-9))
    u = u.withColumn("uid", F.monotonically_increasing_id())  # before the terms are rows
    u = u.select("fid", "whole", "uid", F.sqrt(F.col("known_sq") + F.col("other_sq")).alias("norm"), F.explode("tfs").alias("x"))
    # the templates' postings: one row a template and term, so their size is that of the templates
    rows = []
    for t, (name, terms) in enumerate(template_terms(templates)):
        length = math.sqrt(sum((k * weights[w]) ** 2 for w, k in terms.items()))
        rows += [(w, t, name, k * weights[w] ** 2 / length) for w, k in terms.items()]
    index = F.broadcast(files.sparkSession.createDataFrame(rows, "term string, template int, license string, share double"))
    scores = u.join(index, F.col("x.term") == F.col("term")).groupBy("fid", "whole", "uid", "template", "license").agg((F.sum(F.col("x.tf") * F.col("share")) / F.first("norm")).alias("score"))
    best = F.min(F.struct("whole", (-F.round("score", 9)).alias("order"), "license", "score")).alias("b")
    return scores.filter(F.col("score") >= threshold).groupBy("fid").agg(best).select("fid", "b.license", F.least(F.col("b.score"), F.lit(1.0)).alias("score"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first; '' is the root."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def inherited(own: DataFrame) -> DataFrame:
    """dir, licence_dir, dir_license: for every directory its nearest directory with a licence. own: directory, license (null if none)."""
    votes = own.filter("license is not null and directory is not null").groupBy("directory", "license").agg(F.count("*").alias("n"))
    licensed = votes.groupBy("directory").agg(F.min_by("license", F.struct(-F.col("n"), F.col("license"))).alias("dir_license"))
    licensed = small(staged(licensed, "licensed-dirs")).withColumnRenamed("directory", "licence_dir")
    dirs = own.filter("directory is not null").select("directory").distinct()
    up = dirs.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "licence_dir"))
    return up.join(licensed, "licence_dir").groupBy("directory").agg(F.min_by(F.struct("licence_dir", "dir_license"), "up").alias("x")).select("directory", "x.*")


def scan(files: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of files but text, and own_license, score, license, inherited_from. files: fid (equal only in equal rows), path, text and more."""
    weights, unseen = term_weights(files, templates)
    best = small(staged(matches(files.select("fid", "path", "text"), weights, unseen, templates, threshold), "license-matches"))
    directory = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    given = [c for c in files.columns if c not in ("text", *RESULT)]
    own = files.select("fid", F.struct(*given).alias("row"), directory.alias("directory")).join(best, "fid", "left")
    dirs = small(staged(inherited(own), "license-dirs"))
    took = F.col("license").isNull() & F.col("dir_license").isNotNull()
    return own.join(dirs, "directory", "left").select(
        "row.*", F.col("license").alias("own_license"), "score", F.coalesce("license", "dir_license").alias("license"), F.when(took, F.col("licence_dir")).alias("inherited_from")
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/number of the hundred/doc_id.txt; the document whose id ends the hundred's numbering, 00, is that directory's LICENSE."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(part("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", part("source"), part("lang"), F.floor(F.coalesce("doc_id", F.lit(0)) / 100).cast("string"), name)
    # the same in every read of the table, however it is split
    fid = F.concat_ws(":", part("doc_id"), F.hex(F.xxhash64("text")), path)
    return docs.select(fid.alias("fid"), F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(table(spark, sf_dir, "documents"))
    got = scan(files)
    return got.select("doc_id", "path", "own_license", F.round("score", 6).alias("score"), "license", "inherited_from")


_TERMS = ", ".join(f"({t}, '{name}', '{w}', {k})" for t, (name, terms) in enumerate(template_terms()) for w, k in terms.items())

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(coalesce(doc_id, 0) // 100 AS VARCHAR) AS dir, coalesce(source, 'none') AS dir1,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir2, coalesce(CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' END, coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt') AS file,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tpl(tid, name, term, k) AS (VALUES TERMS),
p AS (SELECT doc_id, unnest(string_split_regex(t, 'PARAGRAPH')) AS unit FROM d),
u AS (SELECT *, row_number() OVER () AS i FROM (
  SELECT doc_id, 1 AS whole, unnest(string_split(t, chr(10))) AS unit FROM d UNION ALL
  SELECT doc_id, 1, unit FROM p WHERE contains(unit, chr(10)) UNION ALL
  SELECT doc_id, 0, t FROM d WHERE file = 'LICENSE')),
tok AS (SELECT doc_id, whole, i, term, count(*) AS c FROM (SELECT doc_id, whole, i, unnest(regexp_extract_all(unit, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM u) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS w FROM (SELECT v.term, n, count(DISTINCT tok.doc_id) AS df FROM (SELECT DISTINCT term FROM tpl) v CROSS JOIN n LEFT JOIN tok USING (term) GROUP BY 1, 2)),
len AS (SELECT tid, sqrt(sum(k * w * k * w)) AS len FROM tpl JOIN w USING (term) GROUP BY tid),
norm AS (SELECT i, sqrt(sum(pow(c * coalesce(w, ln(1 + n) + 1), 2))) AS norm FROM tok CROSS JOIN n LEFT JOIN w USING (term) GROUP BY i),
dot AS (SELECT doc_id, whole, i, tid, name, sum(c * k * w * w) AS dot FROM tok JOIN tpl USING (term) JOIN w USING (term) GROUP BY ALL),
sc AS (SELECT doc_id, whole, name, dot / (norm * len) AS score FROM dot JOIN norm USING (i) JOIN len USING (tid)),
best AS (SELECT doc_id, name, least(score, 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY whole, round(score, 9) DESC, name) AS r FROM sc WHERE score >= 0.7) WHERE r = 1),
own AS (SELECT d.doc_id, dir, dir1, dir2, file, best.name AS own_license, best.score FROM d LEFT JOIN best USING (doc_id)),
lic AS (SELECT dir, own_license AS license FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, own_license) AS r FROM own WHERE own_license IS NOT NULL GROUP BY dir, own_license) WHERE r = 1)
SELECT o.doc_id, o.dir || '/' || o.file AS path, own_license, round(score, 6) AS score, coalesce(own_license, a.license, b.license, c.license) AS license,
       CASE WHEN own_license IS NOT NULL THEN NULL WHEN a.license IS NOT NULL THEN a.dir WHEN b.license IS NOT NULL THEN b.dir WHEN c.license IS NOT NULL THEN c.dir END AS inherited_from
FROM own o LEFT JOIN lic a ON a.dir = o.dir LEFT JOIN lic b ON b.dir = o.dir2 LEFT JOIN lic c ON c.dir = o.dir1
""".replace("TERMS", _TERMS).replace("PARAGRAPH", PARAGRAPH)
