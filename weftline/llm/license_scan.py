"""License notices and whole licenses in whole texts: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-cased words of letters and digits, in shingles of SHINGLE words. Windows of
LENGTHS words overlap by three quarters; a template is sought in windows of the least length L with
t <= 3 L / 4 + 1 words, so that each place of a template lies wholly in some window of that length: up to 12,289
words, twice the longest of the common licenses. Of a window only shingles that some template has are
sketched; the others cannot count for any template, and leaving them out only raises similarities. A
window that holds the wanted share of a template's shingles has a Jaccard similarity of x / (t + L - 4 - x) with
it at least, for x = CONTAINMENT t of t distinct shingles: 0.25 or more unless the template repeats its own
wording. With BANDS bands of one MinHash row they meet in a band with probability 1 - (1 - 0.25)^32 > 0.9999;
templates for which it would be under LEAST_COLLISION are refused. What meets is verified exactly, once for
each window and template: at least CONTAINMENT of the template's distinct shingles are in the window.

All of it is DataFrame functions. Shingles of templates are found where the text is read: by a hash set
of up to IN_LIST of them, else by a broadcast hash join (of MAX_TEMPLATE_SHINGLES at most, checked). Templates' bands are broadcast up to MAX_BAND_ROWS. Only
they are shuffled, to be gathered by window; a window gets L - 4 of them at most, and one with fewer than any
template of its length needs is left out, which loses nothing.

Defined results: a null or wordless text has no notice. One row per doc_id and template, with the best
containment and of equal ones the first word's place; rows that repeat a doc_id give one row, and so do all
rows without one. An empty table gives no rows. Notices of fewer words than a shingle are refused as
templates and given as short ones: one shingle of all their words, found where those words follow each
other. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.text import bind, whole

SHINGLE = 5
CONTAINMENT = 0.8
LENGTHS = tuple(8 << k for k in range(12))
BANDS = 32
LEAST_COLLISION = 0.99
#: Template shingles that are searched as a set; more are joined.
IN_LIST = 1000
MAX_TEMPLATE_SHINGLES = 2_000_000
#: Rows of templates' bands (BANDS of each) that are broadcast; more are joined.
MAX_BAND_ROWS = 1_000_000

#: Wording of public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so""",
    "Apache-2.0-header": """Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at""",
}

#: Notices of fewer words than a shingle.
SHORT_TEMPLATES = {"All-rights-reserved": "All rights reserved."}


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles, in order."""
    heads = lambda w: F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return bind(words, lambda w: F.transform(heads(w), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])))


def sketch(hashes: Column, bands: int) -> Column:
    """The least of the hashes re-hashed with each band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def window_length(words: Column) -> Column:
    """The least of LENGTHS whose windows hold every place of so many words."""
    fit = F.lit(LENGTHS[-1])
    for length in reversed(LENGTHS[:-1]):
        fit = F.when(words <= 3 * length // 4 + 1, length).otherwise(fit)
    return fit


def collision(shingles: int, length: int, containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    """The least probability that a template of so many distinct shingles meets a window that holds its share of them."""
    held = ceil(containment * shingles - 1e-9)
    return 1 - (1 - held / (shingles + length - (SHINGLE - 1) - held)) ** bands


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(license, length, parts): the templates' distinct shingles and window length."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(list((templates or TEMPLATES).items()), "license string, text string")
    rows = rows.select("license", license_words(F.col("text")).alias("w"))
    longest = 3 * LENGTHS[-1] // 4 + 1
    if wrong := rows.where((F.size("w") < SHINGLE) | (F.size("w") > longest)).first():
        raise ValueError(f"template {wrong.license} must have {SHINGLE} to {longest} words")
    return rows.select("license", window_length(F.size("w")).alias("length"), F.array_distinct(shingles(F.col("w"))).alias("parts"))


def short_table(spark: SparkSession, short: dict[str, str]) -> DataFrame:
    """(license, length, parts): the one shingle of each short template, whose length is its words'."""
    rows = spark.createDataFrame(list(short.items()), "license string, text string").select("license", license_words(F.col("text")).alias("w"))
    if wrong := rows.where((F.size("w") == 0) | (F.size("w") >= SHINGLE)).first():
        raise ValueError(f"short template {wrong.license} must have 1 to {SHINGLE - 1} words")
    part = F.coalesce(*[F.when(F.size("w") == m, shingles(F.col("w"), m)) for m in range(1, SHINGLE)])
    return rows.select("license", F.size("w").alias("length"), part.alias("parts"))


def hit(size: int, i: Column, h: Column) -> Column:
    """A shingle of a template at word i; size is 0 for one of SHINGLE words, else a short template's words."""
    return F.struct(F.lit(size).alias("size"), i.cast("int").alias("i"), h.alias("h"))


def short_hits(words: Column, size: int, hashes: list[int]) -> Column:
    """The first place of each short template of so many words."""
    return bind(shingles(words, size), lambda h: F.transform(F.array_intersect(h, F.lit(hashes).cast("array<bigint>")), lambda s: hit(size, F.array_position(h, s) - 1, s)))


def _hits(docs: DataFrame, known: DataFrame, n_parts: int, short: dict[int, list[int]]) -> DataFrame:
    """(tag, doc_id, size, i, h): the places of the templates' shingles, tag telling rows apart."""
    texts = docs.select("doc_id", F.col("text").alias("text"), F.monotonically_increasing_id().alias("tag"))
    parts = known.select(F.explode("parts").alias("h")).distinct()
    found = [lambda w, m=m, hashes=hashes: short_hits(w, m, hashes) for m, hashes in sorted(short.items())]
    few = n_parts <= IN_LIST
    if few:
        some = [r.h for r in parts.collect()]
        found.append(lambda w: F.filter(F.transform(shingles(w), lambda x, i: hit(0, i, x)), lambda p: p["h"].isin(some)))
    # an outer explode, filtered after it: the optimizer then computes a text's shingles once
    rows = texts.select("tag", "doc_id", F.explode_outer(bind(license_words(F.col("text")), lambda w: F.concat(*[f(w) for f in found]))).alias("at")) if found else None
    rows = rows.where("at is not null").select("tag", "doc_id", "at.*") if found else None
    if few:
        return rows
    every = texts.select("tag", "doc_id", F.posexplode(shingles(license_words(F.col("text")))).alias("i", "h"))
    joined = every.join(F.broadcast(parts), "h").select("tag", "doc_id", F.lit(0).alias("size"), "i", "h")
    return joined if rows is None else joined.unionByName(rows)


def _windows(hits: DataFrame, need: dict[int, float]) -> DataFrame:
    """(doc_id, length, hits): windows, by their hits in order, that hold as many distinct ones as some template of that
    length needs. A hit of a short template is a window of its own."""

    def within(length: int) -> Column:
        """The windows of that length that hold word i."""
        hop, reach = length // 4, length - SHINGLE
        first = F.greatest(F.ceil((F.col("i") - reach) / hop), F.lit(0)).cast("int")
        return F.transform(F.sequence(first, F.floor(F.col("i") / hop).cast("int")), lambda k: F.struct(F.lit(length).alias("length"), k.alias("k")))

    own = F.array(F.struct(F.col("size").alias("length"), F.col("i").alias("k")))
    rows = hits.select("tag", "doc_id", "i", "h", F.explode(F.when(F.col("size") > 0, own).otherwise(F.concat(*[within(n) for n in need]) if need else own)).alias("w"))
    gathered = rows.groupBy("tag", "doc_id", "w.length", "w.k").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("hits"))
    enough = F.col("length") < SHINGLE
    for length, least in need.items():
        enough = enough | ((F.col("length") == length) & (F.size(F.array_distinct("hits.h")) >= least))
    return gathered.where(enough).select("doc_id", "length", "hits")


def scan(
    docs: DataFrame,
    templates: dict[str, str] | DataFrame | None = None,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
    short: dict[str, str] | None = None,
) -> DataFrame:
    """doc_id, license, containment, first_word: each template that a document holds. Templates: a name to text, or a table
    (license, text). Own templates come without short ones."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # one row a window length and one a short template: small, whatever the templates
    classes = known.groupBy("length").agg(F.min(F.size("parts")).alias("least"), F.sum(F.size("parts")).alias("n"), F.count(F.lit(1)).alias("templates")).collect()
    if (n_parts := sum(r.n for r in classes)) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"templates have {n_parts} shingles; at most {MAX_TEMPLATE_SHINGLES} are allowed")
    if weak := [r.length for r in classes if collision(r.least, r.length, containment, bands) < LEAST_COLLISION]:
        raise ValueError(f"templates sought in windows of {weak} words repeat their own wording too much for {bands} bands")
    brief = short_table(spark, (SHORT_TEMPLATES if templates is None else {}) if short is None else short)
    sizes: dict[int, list[int]] = {}
    for r in brief.collect():
        sizes.setdefault(r.length, []).append(r.parts[0])
    windows = _windows(_hits(docs, known, n_parts, sizes), {r.length: containment * r.least - 1e-9 for r in classes})
    # both sides of the template table are broadcast within a bound: bands rows a template, and each template's shingles once
    small = bands * sum(r.templates for r in classes) <= MAX_BAND_ROWS
    sent = F.broadcast if small else lambda df: df
    own = known.unionByName(brief).withColumn("sketch", sketch(F.col("parts"), bands))
    by_band = own.select("license", "length", F.posexplode("sketch").alias("band", "least"))
    met = windows.withColumn("part", F.array_distinct("hits.h")).withColumn("window_sketch", sketch(F.col("part"), bands))
    met = met.select("*", F.posexplode("window_sketch").alias("band", "least")).join(sent(by_band), ["length", "band", "least"])
    met = met.join(sent(own.select("license", "parts", "sketch")), "license")
    # of the bands in which they meet the first stands for all
    first_band = F.array_position(F.zip_with("window_sketch", "sketch", lambda a, b: a == b), True) - 1
    found = met.where(F.col("band") == first_band).withColumn("containment", F.size(F.array_intersect("parts", "part")) / F.size("parts"))
    place = F.get(F.filter("hits", lambda x: F.array_contains("parts", x["h"])), F.lit(0))["i"]
    found = found.where(F.col("containment") >= containment).select("doc_id", "license", "containment", place.cast("long").alias("first_word"))
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))
