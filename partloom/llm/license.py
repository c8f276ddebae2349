"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.
DataFrame functions only.

Every word of every text counts: weights come from the number of texts that hold a word. A template's leading words are its
heaviest ones, as many as leave the others less than ``least`` of its length as a vector: a passage without any of them can't
reach ``least``. Where a leading word stands in a text, the passage is laid around it as the template lies around that word, so
wrapped lines, comment marks and carriage returns don't matter, and whole bodies are compared like one-line notices. Passages
whose shared words are too light for ``least`` go by the same bound; each distinct one of the others is scored once.

A file whose best passage makes up at least ``FILE_SHARE`` of its words is a licence file, of whatever length, as is one that is
declared to be. It gives its licence to its directory; a file without one of its own takes that of the nearest directory above
it that has one. Directories are joined with all of their ancestors, so depth costs rows and not steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import ascii_lower, bounded, file_row, stored

#: Names and notices of licences, and whole bodies or openings of their texts.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
BODIES = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
#: Only where nothing else is found: other licences' texts hold these words too.
WEAK = "Proprietary"
TEMPLATES = (*NOTICES, *BODIES, *((name, f"SPDX-License-Identifier: {name}") for name in SPDX))
WORD = r"[a-z0-9]+(?:\.[0-9]+)?"
LEAST, FILE_SHARE = 0.8, 0.1
DIRECTORY_FILES = 512


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _weight(total: int) -> Column:
    return F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1)


def template_words(templates: DataFrame, df: DataFrame, total: int, least: float) -> DataFrame:
    """templates (license, text) to n, license, length, term, tf, m (its weight), norm2 (of the template) and lead. As many
    rows as the templates have different words. A template without words has none."""
    numbered = templates.groupBy("license", "text").agg(F.count("*").alias("times")).select(F.xxhash64("license", "text").alias("n"), "license", words_of(F.col("text")).alias("words"))
    terms = numbered.select("n", "license", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("n", "license", "length", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(df, "term", "left").withColumn("m", _weight(total))
    of = Window.partitionBy("n")
    tail = F.sum(F.col("m") * F.col("m")).over(of.orderBy("m", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    norm2 = F.sum(F.col("m") * F.col("m")).over(of)
    return weighed.select("n", "license", "length", "term", "tf", "m", norm2.alias("norm2"), (tail >= least * least * norm2 * (1 - 1e-9)).alias("lead"))


def lead_places(templates: DataFrame, words: DataFrame) -> DataFrame:
    """Where leading words lie in their templates: n, term, before (words in front of it), length."""
    numbered = templates.select(F.xxhash64("license", "text").alias("n"), F.posexplode(words_of(F.col("text"))).alias("before", "term")).distinct()
    return numbered.join(words.where("lead").select("n", "term", "length"), ["n", "term"])


def passages(files: DataFrame, places: DataFrame, leads: list[str], reach: int) -> DataFrame:
    """files (row, words) to row, n and passage (array of words), each once for a row. ``reach`` is the longest template's
    length: what stands farther from a leading word is in none of its passages."""
    found = files.select("row", "words", F.array_intersect("words", F.array(*map(F.lit, leads)) if leads else F.array().cast("array<string>")).alias("found")).where(F.size("found") > 0)
    begin = lambda i: F.greatest(i - reach, F.lit(1))
    near = lambda t, i: F.struct(t.alias("term"), (i - begin(i)).alias("at"), F.slice("words", begin(i), F.lit(2 * reach + 1)).alias("near"))
    at = lambda t: F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.get("words", i - 1) == t)
    around = found.select("row", F.explode(F.flatten(F.transform("found", lambda t: F.transform(at(t), lambda i: near(t, i))))).alias("a")).select("row", "a.*")
    start = F.col("at") - F.col("before")
    clipped = F.greatest(start, F.lit(0))
    return around.join(F.broadcast(places), "term").select("row", "n", F.slice("near", clipped + 1, start + F.col("length") - clipped).alias("passage"))


def scores(found: DataFrame, words: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """Distinct n and passage to their cosine."""
    terms = found.select("n", "passage", F.explode("passage").alias("term")).groupBy("n", "passage", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(df, "term").withColumn("w", _weight(total)).join(F.broadcast(words.select("n", "term", "m")), ["n", "term"], "left")
    sums = weighed.groupBy("n", "passage").agg(F.sum(F.col("w") * F.col("m")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("norm2"))
    return sums.join(F.broadcast(words.groupBy("n", "license").agg(F.first("norm2").alias("model"))), "n").select("n", "passage", "license", F.round(F.col("dot") / F.sqrt(F.col("norm2") * F.col("model")), 4).alias("score"))


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, down to the root, which is empty."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def scan_licenses(files: DataFrame, templates: DataFrame, *, least: float = LEAST, file_share: float = FILE_SHARE, row: Column | None = None) -> DataFrame:
    """files (doc_id, directory, is_license, text) to doc_id, directory, license, origin (header or directory), score and
    from_directory; templates (license, text) are a declared table that every task gets.

    Null and empty texts have no licence of their own. Of several passages the best score counts, ``WEAK`` last, then the
    first licence by name; of several licence files in a directory the same. Null directories count as the root, null
    is_license as false. Rows with equal or null ids are scanned each by its own text. Whole texts are scanned, however long.
    ``row`` tells rows apart, the same whenever they are read; without it the files are written once with numbers. Other
    columns are left out, whatever their names.
    """
    files = files.select((F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", F.coalesce("directory", F.lit("")).alias("directory"), F.coalesce("is_license", F.lit(False)).alias("is_license"), "text")
    files = stored(files, "files") if row is None else files
    worded = files.select("row", words_of(F.col("text")).alias("words"))
    df = stored(worded.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    total = files.where("text is not null").count()
    words = stored(template_words(templates, df, total, least), "templates")
    known = words.groupBy().agg(F.collect_set(F.when(F.col("lead"), F.col("term"))).alias("leads"), F.coalesce(F.max("length"), F.lit(1)).alias("reach")).first()
    laid = passages(worded, lead_places(templates, words), sorted(known.leads), known.reach)
    model = words.groupBy("n").agg(F.collect_list(F.struct("term", (F.col("m") * F.col("m")).alias("m2"))).alias("terms"), F.first("norm2").alias("model"))
    shared = F.aggregate("terms", F.lit(0.0), lambda sum_, x: sum_ + F.when(F.array_contains("passage", x.term), x.m2).otherwise(0.0))
    near = laid.join(F.broadcast(model), "n").where(shared >= least * least * F.col("model") * (1 - 1e-9)).select("row", "n", F.array_join("passage", " ").alias("passage"))
    near = stored(near.distinct(), "passages")
    reached = scores(near.select("n", "passage").distinct().select("n", F.split("passage", " ").alias("passage")), words, df, total).where(F.col("score") >= least)
    reached = stored(reached.select("n", F.array_join("passage", " ").alias("passage"), "license", "score"), "scores")
    order = F.struct((F.col("license") == WEAK).alias("weak"), (-F.col("score")).alias("less"), "license", (-F.size(F.split("passage", " "))).alias("fewer"))
    best = near.join(bounded(reached), ["n", "passage"]).groupBy("row").agg(F.min(order).alias("best"))
    about = files.select("row", "doc_id", "directory", "is_license", F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)), F.lit(0)).alias("size"))
    own = stored(about.join(bounded(stored(best, "best")), "row", "left"), "own")
    gives = F.col("is_license") | (-F.col("best.fewer") >= file_share * F.col("size"))
    given = own.where(gives & F.col("best").isNotNull()).groupBy("directory").agg(F.min(F.struct("best.weak", "best.less", "best.license")).alias("gift")).select(F.col("directory").alias("above"), "gift")
    up = own.select("directory").distinct().select("directory", F.explode(_ancestors(F.col("directory"))).alias("above"))
    nearest = up.join(given, "above").groupBy("directory").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "gift")).alias("near"))
    inherited = nearest.select("directory", F.col("near.above").alias("from_directory"), F.col("near.gift.license").alias("dir_license"), (-F.col("near.gift.less")).alias("dir_score"))
    joined = own.select("doc_id", "directory", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score")).join(bounded(stored(inherited, "inherited")), "directory", "left")
    origin = F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "directory")
    return joined.select("doc_id", "directory", F.coalesce("license", "dir_license").alias("license"), origin.alias("origin"), F.coalesce("score", "dir_score").alias("score"), F.when(origin == "directory", F.col("from_directory")).alias("from_directory"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a document lies in source/lang/<its 512 neighbours by id>."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    block = F.floor(F.col("doc_id") / DIRECTORY_FILES).cast("long").cast("string")
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), block)
    files = docs.select("doc_id", place.alias("directory"), F.lit(False).alias("is_license"), "text", file_row().alias("at"))
    return scan_licenses(files, spark.createDataFrame(list(TEMPLATES), "license string, text string"), row=F.col("at"))


_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
_WORDS = f"regexp_extract_all(translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
OP3_SQL = rf"""
with f as (
  select doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), cast(cast(floor(doc_id / 512) as bigint) as varchar)) directory, text, {_WORDS.format("text")} words
  from documents),
total as (select count(text) total from f),
df as (select term, count(*) df from (select unnest(list_distinct(words)) term from f) group by 1),
template(license, text) as (values {_VALUES}),
tw as (select row_number() over (order by license, text) n, license, {_WORDS.format("text")} words from template),
tterm as (
  select n, license, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) m
  from (select n, license, term, count(*) tf from (select n, license, unnest(words) term from tw) group by 1, 2, 3) left join df using (term), total),
model as (
  select *, sum(m * m) over (partition by n) norm2, sum(m * m) over (partition by n order by m, term desc rows unbounded preceding) tail from tterm),
place as (
  select n, p.term, p.i - 1 before, len(words) length
  from (select n, words, unnest(words) term, unnest(generate_series(1, len(words))) i from tw) p join model using (n) where model.term = p.term and tail >= 0.64 * norm2 * (1 - 1e-9)),
spot as (select doc_id, directory, unnest(words) term, unnest(generate_series(1, len(words))) i from f),
passage as (
  select distinct spot.doc_id, spot.directory, n, f.words[greatest(i - before, 1):i - before + length - 1] passage
  from spot join place using (term) join f on f.doc_id = spot.doc_id),
term as (select n, passage, term, count(*) tf from (select n, passage, unnest(passage) term from (select distinct n, passage from passage)) group by 1, 2, 3),
score as (
  select n, passage, license, round(dot / sqrt(norm2 * mnorm2), 4) score
  from (
    select t.n, passage, sum(w * m) dot, sum(w * w) norm2
    from (select n, passage, term, tf * (ln((1 + total) / (1 + df)) + 1) w from term join df using (term), total) t left join model on model.n = t.n and model.term = t.term group by 1, 2)
  join (select distinct n, license, first(norm2) over (partition by n) mnorm2 from model) using (n)),
own as (
  select doc_id, directory, license, score, len(passage) words from passage join score using (n, passage) where score >= 0.8
  qualify row_number() over (partition by doc_id order by license = 'Proprietary', score desc, license, len(passage) desc) = 1),
given as (
  select own.directory above, license, score from own join f using (doc_id) where own.words >= 0.1 * len(f.words)
  qualify row_number() over (partition by own.directory order by license = 'Proprietary', score desc, license) = 1),
up as (
  select directory, array_to_string(string_split(directory, '/')[1:i], '/') above from (select distinct directory from f), generate_series(1, 3) g(i)),
near as (select directory, above, license, score from up join given using (above) qualify row_number() over (partition by directory order by length(above) desc) = 1)
select f.doc_id, f.directory, coalesce(own.license, near.license) license,
       case when own.license is not null then 'header' when near.license is not null then 'directory' end origin,
       coalesce(own.score, near.score) score, case when own.license is null then near.above end from_directory
from f left join own on own.doc_id = f.doc_id left join near on near.directory = f.directory
"""
