"""Licence scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.
DataFrame operations only.

Texts and templates become lower-case words (runs of letters and digits) and shingles of five words (fewer words: one
shingle of all). For each length that a template has, windows of that many words start every stride words. A window's
signature is the minimum of each of bands x rows salted hashes over its shingles; a window and a template that agree in
all rows of any band are candidates. A stride of an eighth of the length keeps the best window of a match at a Jaccard
similarity of about 0.58 or more even when only 0.8 of the template's shingles are there, and 16 bands of 2 rows find
that with a probability of 0.998 for that one window, and more with its neighbours. Candidates are verified by the
exact share of the template's distinct shingles within the window's reach (the window and a stride either side); a
share of at least `least` counts.

A window without any shingle of any template cannot match. So windows are laid only around anchor words: a small set
of words, computed from the templates, such that each shingle of each template holds one. Every text is searched for
them whole; leaving windows without an anchor changes no result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Short notices of widespread public licences, as they stand in files and pages.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
]

SHINGLE = 5
#: Function words, which ordinary prose is full of; they anchor a shingle only if it has no other word.
FUNCTION_WORDS = frozenset("a an and any as at be by for from if in is it may not of on or that the this to under with you without following either except to all are".split())
_WORDS = re.compile(r"[^\W_]+")


def template_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def shingles_of(words: list[str], size: int = SHINGLE) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Few, rare words such that each shingle of each template holds one: at each step the word that hits the most
    shingles still without one, long words before short, as those are rarer in other text."""
    open_ = [set(s.split()) for _, t in templates for s in shingles_of(template_words(t))]
    found = []
    while open_:
        hits = Counter(w for s in open_ for w in (s - FUNCTION_WORDS or s))
        best = max(hits, key=lambda w: (hits[w] * min(len(w), 10), w))
        found.append(best)
        open_ = [s for s in open_ if best not in s]
    return sorted(found)


def shingle_hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def signature(hashed: Column, bands: int, rows: int) -> Column:
    """An array of bands, each a hash of the minima of its rows over the shingles' hashes."""

    def minimum(k: int) -> Column:
        return F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*(F.xxhash64(*(minimum(b * rows + r) for r in range(rows))) for b in range(bands)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row. Spark would copy its expression into every later use, inside
    lambda functions even once for each element; what a generator gives is not copied."""
    return df.withColumn(name, F.explode(F.array(value)))


def _shingle_array(words: Column, size: int) -> Column:
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, bands: int = 16, rows: int = 2, least: float = 0.8) -> DataFrame:
    """id_col, licence, containment (the best of its templates), matches (windows' worth of evidence: templates matched)
    and first_word (0-based word at which the first matching window starts): one row for each document and licence.

    Defined results: null and empty texts, and those without a match, give no row. Rows with the same id, or with none, are
    scanned apart and reported together: what one of them holds is reported, whatever the others hold and in any order. An empty table, or no templates, gives an empty table. Other columns are ignored. The
    templates are a parameter, and as a list of texts in the program they are small; they alone are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = [(i, name, len(w := template_words(text)), sorted(set(shingles_of(w)))) for i, (name, text) in enumerate(templates) if template_words(text)]
    empty = docs.select(F.col(id_col), F.lit("").alias("licence"), F.lit(0.0).alias("containment"), F.lit(0).alias("matches"), F.lit(0).alias("first_word")).limit(0)
    if not known:
        return empty
    table = spark.createDataFrame(known, "template int, licence string, words int, shingles array<string>")
    bands_of = table.select("template", "licence", "words", "shingles", F.posexplode(signature(shingle_hashes(F.col("shingles")), bands, rows)).alias("i", "band"))
    marks = anchors(templates)
    #: The anchors that the templates of each length hold.
    own_marks = {n: sorted({m for _, _, size, s in known if size == n for m in marks if any(m in x.split() for x in s)}) for n in {k[2] for k in known}}
    pattern = "(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, marks)) + ")(?![\\p{L}\\p{N}])"
    low = F.lower(F.col(text_col))
    hit = docs.select(F.col(id_col).alias("id"), low.alias("low")).filter(F.col("low").rlike(pattern))
    words = F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Only the texts with an anchor go on, and of those only the words near one.
    hit = _once(hit, "w", words).select("id", "w")
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at(F.col("w"), i + 1).isin(marks))
    hit = _once(hit, "at", places).filter(F.size("at") > 0)
    lengths = sorted({n for _, _, n, _ in known})

    def starts(n: int) -> Column:
        """Window starts for length n: multiples of the stride whose window, or its reach, holds an anchor."""
        step = max(1, n // 8)
        own = F.filter("at", lambda p: F.element_at(F.col("w"), p + 1).isin(own_marks[n]))
        around = F.flatten(F.transform(own, lambda p: F.sequence(F.floor(F.greatest(p - F.lit(n - 1), F.lit(0)) / F.lit(step)), F.floor(p / F.lit(step)))))
        return F.transform(F.array_distinct(around), lambda k: F.struct(F.lit(n).alias("words"), F.lit(step).alias("step"), (k * F.lit(step)).cast("int").alias("start")))

    windows = hit.select("id", "w", F.explode(F.flatten(F.array(*map(starts, lengths)))).alias("x"))
    windows = windows.select(
        "id", F.col("x.words").alias("words"), F.col("x.start").alias("start"),
        F.slice("w", F.col("x.start") + 1, F.col("x.words")).alias("inner"),
        F.slice("w", F.greatest(F.col("x.start") - F.col("x.step") + 1, F.lit(1)), F.col("x.words") + 2 * F.col("x.step")).alias("reach"),
    )
    signed = _once(windows, "hashes", shingle_hashes(_shingle_array(F.col("inner"), SHINGLE)))
    signed = _once(signed, "sig", signature(F.col("hashes"), bands, rows)).select("id", "words", "start", "reach", "sig")
    # The bands of the templates, a few numbers each, go into the plan. A window that meets some becomes one row for each
    # template met, however many bands agree, so rows stay where they are and need no key of their own.
    met = [(r.i, r.band, r.template, r.words) for r in bands_of.collect()]
    by_band: dict[int, set[int]] = {}
    for i, band, _, _ in met:
        by_band.setdefault(i, set()).add(band)
    meets = F.lit(False)
    for i, values in sorted(by_band.items()):
        meets = meets | F.element_at("sig", i + 1).isin(sorted(values))
    known_bands = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(band).alias("band"), F.lit(t).alias("template"), F.lit(n).alias("n")) for i, band, t, n in sorted(met)))
    agree = F.filter(known_bands, lambda x: (x["n"] == F.col("words")) & (F.element_at(F.col("sig"), x["i"]) == x["band"]))
    signed = signed.filter(meets).select("id", "start", "reach", F.explode(F.array_distinct(F.transform(agree, lambda x: x["template"]))).alias("template"))
    found = signed.join(F.broadcast(table), "template")
    # A template of fewer words than a shingle has is one short shingle, so the reach is cut alike for it.
    size = F.least(F.lit(SHINGLE), F.col("words"))
    reach = F.transform(F.sequence(F.lit(1), F.greatest(F.size("reach") - size + 1, F.lit(1))), lambda i: F.array_join(F.slice("reach", i, size), " "))
    share = F.size(F.array_intersect("shingles", reach)) / F.size("shingles")
    sure = found.withColumn("containment", share).filter(F.col("containment") >= least)
    return sure.groupBy(F.col("id").alias(id_col), "licence").agg(F.round(F.max("containment"), 6).alias("containment"), F.count_distinct("template").cast("int").alias("matches"), F.min("start").alias("first_word"))
