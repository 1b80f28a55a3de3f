"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are cut into five-word shingles and belong to a window width, the power of two from
twice their length on. Texts are covered by windows of that width at half-width steps, so a whole
occurrence always lies in one window. A window that holds a template of ``t`` shingles has a Jaccard similarity of at
least ``t`` over its own shingles; bands of one row each collide with probability
1 - (1 - s)^bands. ``bands`` takes as many as keep the miss of a whole occurrence under ``MISS`` for the template
with the least s: for the notices below it is one shingle among the twelve of a window of 16 words (s = 1/12), which takes 106.

A band can only collide in a window that holds the template's own least shingle of that band, so the texts'
shingles are first joined with those (a broadcast of templates x bands, bounded by ``MAX_TEMPLATES``),
and only windows around such shingles are hashed. Colliding windows are verified: at least
``CONTAINED`` of the template's distinct shingles are in one stretch of the window. Matches of all windows of a text are then held against each other
by the places of their shingles: where two overlap, the fuller one stands.

Defined results: null and empty texts have no match; repeated rows get a row each; a
template of fewer than five words is refused; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattfleet.llm.common import NON_WORD, shingle_at, shingle_hashes, words_of

SHINGLE = 5
#: Probability that the bands miss a whole occurrence in one window, at most.
MISS = 1e-4
CONTAINED = 0.75
MAX_TEMPLATES = 2_000

#: Usual license notices, by SPDX name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
]


def templates(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``license, template, shingles, width`` of each notice; ``template`` numbers them."""
    if len(notices) > MAX_TEMPLATES:
        raise ValueError(f"{len(notices)} templates; the broadcast is bounded at {MAX_TEMPLATES}")
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(notices)], "template int, license string, text string")
    rows = rows.withColumn("w", words_of(F.col("text"), NON_WORD))
    if short := [r[0] for r in rows.where(F.size("w") < SHINGLE).select("text").collect()]:
        raise ValueError(f"fewer than {SHINGLE} words: {short}")
    width = F.pow(F.lit(2), F.ceil(F.log2(2 * F.size("w")))).cast("int")
    return rows.select("template", "license", F.array_distinct(shingle_hashes(F.col("w"), SHINGLE)).alias("shingles"), width.alias("width"))


def _least(hashes: Column, band: Column) -> Column:
    """The shingle that comes first in the order of one band."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(band, h).alias("o"), h.alias("h"))))["h"]


def _densest(places: Column, size: Column) -> Column:
    """The places of one occurrence: of all stretches a third longer than the template (four places at least), the
    one that holds most, the narrowest of these."""
    reach = size + F.greatest(F.lit(4), F.floor(size / 3).cast("int"))
    within = lambda p: F.filter(places, lambda q: (q >= p) & (q < p + reach))
    rank = lambda p: F.struct(F.size(within(p)).alias("n"), (p - F.element_at(within(p), -1)).alias("narrow"), (-p).alias("first"))
    return within(-F.array_max(F.transform(places, rank))["first"])


def bands(notices: DataFrame) -> int:
    """Bands that the template with the least share of its window needs for ``MISS``."""
    s = notices.agg(F.min(F.size("shingles") / (F.col("width") - (SHINGLE - 1)))).first()[0]
    return 1 if s is None or s >= 1 else math.ceil(math.log(MISS) / math.log1p(-s))


def _bands(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``band, least`` for each of ``n`` bands of the column ``shingles``."""
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    return rows.withColumn("least", _least(F.col("shingles"), F.col("band")))


def matches(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_words, copies`` per distinct document row with ``found``: structs of license, template,
    start, width, containment and the word positions ``at`` of matched shingles, one per matching window."""
    words = F.col("words")
    n_bands = bands(notices)
    wanted = _bands(notices, n_bands).select("template", "license", "width", "band", "least", F.col("shingles").alias("t_shingles"))
    anchors = wanted.select("width", F.col("least").alias("h")).distinct()
    myself = notices.sparkSession.range(1).select(F.lit(0).alias("width"), F.lit(0).cast("long").alias("h"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text"), NON_WORD).alias("words"))
    texts = texts.withColumn("n_words", F.size(words))
    rows = texts.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.size(words) - SHINGLE, F.lit(-1)))).alias("pos"))
    rows = rows.withColumn("h", F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(shingle_at(words, F.col("pos"), SHINGLE)))
    near = rows.join(F.broadcast(anchors.unionByName(myself)), "h").where(F.when(F.col("pos") < 0, F.col("width") == 0).otherwise(F.col("width") > 0))
    half = F.expr("cast(width div 2 as int)")
    step = F.when(F.col("pos") >= 0, F.expr("cast(pos div greatest(cast(width div 2 as int), 1) as int)")).otherwise(F.lit(-1))
    # the two windows that a position is in; the earlier one must still hold the whole shingle
    near = near.select("doc_id", "text_key", "n_words", "width", "pos", "words", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    near = near.withColumn("start", F.when(F.col("pos") < 0, -1 - F.col("back")).otherwise((step - F.col("back")) * half))
    near = near.where(F.when(F.col("pos") < 0, F.col("start") == -1)
                      .otherwise((F.col("start") >= 0) & (F.col("start") + F.col("width") >= F.col("pos") + SHINGLE)))
    near = near.withColumn("window", F.when(F.col("start") >= 0, F.expr("slice(words, start + 1, width)"))).drop("words", "pos", "back")
    near = near.groupBy("doc_id", "text_key", "n_words", "width", "start", "window").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("start") >= 0
    rows = near.withColumn("shingles", F.array_distinct(shingle_hashes(F.col("window"), SHINGLE)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.when(real, F.lit(n_bands - 1)).otherwise(0))).alias("band"))
    rows = rows.withColumn("least", F.when(real, _least(F.col("shingles"), F.col("band"))))
    rows = rows.join(F.broadcast(wanted), ["width", "band", "least"], "left")
    # only windows that can contain enough of a template are looked at by place
    able = F.size(F.array_intersect("t_shingles", "shingles")) >= CONTAINED * F.size("t_shingles")
    rows = rows.withColumn("hashes", F.when(able, shingle_hashes(F.col("window"), SHINGLE)))
    rows = rows.withColumn("places", F.array_compact(F.transform("hashes", lambda h, i: F.when(F.array_contains("t_shingles", h), i))))
    rows = rows.withColumn("at", _densest(F.col("places"), F.size("t_shingles")))
    seen = F.size(F.array_distinct(F.transform("at", lambda i: F.get("hashes", i))))
    rows = rows.withColumn("containment", F.when(able, seen / F.size("t_shingles")))
    hit = F.when(F.col("containment") >= CONTAINED, F.struct(
        "license", "template", "start", "width", "containment", F.transform("at", lambda i: F.col("start") + i).alias("at")))
    found = (rows.groupBy("doc_id", "text_key", "n_words")
             .agg(F.sum(F.when(~real, F.col("n"))).alias("copies"), F.sort_array(F.collect_set(hit)).alias("all")))
    # Notices that differ in a version number share most shingles, and a window may hold the start of a notice alone, where they
    # tie: of matches that overlap anywhere in the text, whatever their windows, the one that holds most of its template stands.
    beaten = lambda x: F.exists("all", lambda y: (y["containment"] > x["containment"]) & F.arrays_overlap(y["at"], x["at"]))
    return found.withColumn("found", F.filter("all", lambda x: ~beaten(x))).drop("all")


def report(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """Per document row its words, sorted license names, number of matching templates and the best containment."""
    notices = templates(docs.sparkSession) if notices is None else notices
    rows = matches(docs, notices).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.array_join(F.sort_array(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.size(F.array_distinct(F.col("found.template"))).cast("long").alias("n_templates"),
        F.coalesce(F.array_max(F.col("found.containment")), F.lit(0.0)).alias("best"))
