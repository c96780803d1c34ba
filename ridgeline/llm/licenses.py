"""License scans: MinHash bands over overlapping text windows retrieve templates, containment verifies.

A template of n words is sought in windows of 2 n words that start every n words, so that every
n consecutive words lie whole in a window.  A window's words make 5-word shingles; its MinHash under
each of b functions is a band.  A window that holds ``least`` of a template's shingles has a Jaccard
index of at least J, known from the sizes, and shares a band with it with probability 1 - (1 - J)^b; b
is chosen to make that 1 - ``miss``.  Candidates are verified by exact containment.

Only windows with a shingle of some template are hashed: no other can share a MinHash with a
template.  Templates are a parameter; their bands are the one thing that is broadcast, templates
times b rows.  Only DataFrame functions are used.

Words are runs of letters and digits, in lower case.  Null text has none; templates of fewer than 5
words are one shingle of all their words and match such a run at any place; rows with equal doc_id are one
document's; an empty table has no matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.license_texts import TEXTS
from ridgeline.sources.scratch import Scratch

SIZE, LEAST, MISS = 5, 0.8, 1e-9
WORDS = r"[^\p{L}\p{N}]+"

#: Notices of well-known licences, as their texts ask for, and short licences as a whole.
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0-notice", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *TEXTS,
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda x: x != "")


def shingles(words: str, begin: Column, end: Column, size: int) -> Column:
    """Hashes of the shingles at word numbers begin to end (0 first, both included) of a column of word hashes."""
    return F.transform(F.sequence(begin, end), lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def template_table(spark: SparkSession, templates) -> DataFrame:
    """template, license, n (words), size (of its shingles), grams (distinct hashes of its shingles)."""
    t = spark.createDataFrame([tuple(x) for x in templates], "template string, license string, text string")
    t = t.withColumn("w", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x))).withColumn("n", F.size("w")).filter("n > 0")
    t = t.withColumn("size", F.least(F.col("n"), F.lit(SIZE)))
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.col("size"))))
    return t.withColumn("grams", F.array_distinct(grams)).select("template", "license", "n", "size", "grams")


def bands_for(n: int, grams: int, size: int, least: float, miss: float) -> int:
    """Bands that find a window of 2 n words with a share ``least`` of a template's shingles."""
    shared = math.ceil(least * grams)
    j = shared / (2 * n - size + 1 + grams - shared)
    return max(1, math.ceil(math.log(miss) / math.log1p(-j))) if j < 1 else 1


def min_hash(grams: Column, band: Column) -> Column:
    return F.array_min(F.transform(grams, lambda s: F.xxhash64(band, s)))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """doc_id, template, license, containment (the best), first_word (of its first window) and windows (that match)."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    known = table.collect()  # the parameter, with its hashes
    kinds: dict[tuple[int, int], int] = {}  # (words, shingle size) -> bands
    for t in known:
        kinds[t.n, t["size"]] = max(kinds.get((t.n, t["size"]), 1), bands_for(t.n, len(t.grams), t["size"], least, miss))
    every: dict[int, set[int]] = {}
    for t in known:
        every.setdefault(t["size"], set()).update(t.grams)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words_of(F.col("text").cast("string")), lambda x: F.xxhash64(x)).alias("w"))

    def hits(size: int) -> Column:
        """Places of shingles that some template of this shingle size has."""
        own = sorted(every[size])
        own += own[:1] * max(0, 11 - len(own))  # a longer list is looked up as a set
        return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)), lambda i: F.xxhash64(F.slice("w", i + 1, size)).isin(own) & (F.size("w") >= size))

    def windows(n: int, size: int, bands: int) -> Column:
        """Windows with a hit: number k starts at word k n and holds 2 n words."""
        numbers = F.flatten(F.transform(f"hits{size}", lambda i: F.array(F.floor(i / n), F.greatest(F.floor(i / n) - 1, F.lit(0).cast("long")))))
        return F.transform(F.array_distinct(numbers), lambda k: F.struct(F.lit(n).alias("n"), F.lit(size).alias("size"), F.lit(bands).alias("bands"), k.cast("int").alias("k")))

    # The row number keeps Spark from moving the filter below the hits, which would tokenise anew for each word.
    rows = rows.select("doc_id", "w", F.monotonically_increasing_id().alias("row"), *(hits(size).alias(f"hits{size}") for size in sorted(every))).filter(" or ".join(f"size(hits{size}) > 0" for size in every))
    found = [windows(n, size, bands) for (n, size), bands in sorted(kinds.items())]
    rows = rows.select("doc_id", "row", "w", F.explode(F.concat(*found)).alias("x")).select("doc_id", "row", "w", "x.*")
    begin, stop = F.col("k") * F.col("n"), F.least(F.col("k") * F.col("n") + 2 * F.col("n"), F.size("w")) - F.col("size")
    rows = rows.filter(stop >= begin).withColumn("grams", F.array_distinct(F.transform(F.sequence(begin, stop), lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, F.col("size")))))).drop("w")
    every_window = Scratch(spark).keep(rows)
    # Only numbers go through the bands; what they retrieve is joined back to its shingles.
    hashes = F.transform(F.sequence(F.lit(1), F.col("bands")), lambda b: min_hash(F.col("grams"), b))
    rows = every_window.select("row", "n", "size", "k", F.posexplode(hashes).alias("band", "hash")).withColumn("band", F.col("band") + 1)
    sizes = spark.createDataFrame([(n, s, b) for (n, s), b in kinds.items()], "n int, size int, bands int")
    banded = table.join(F.broadcast(sizes), ["n", "size"]).select("template", "license", "n", "size", F.col("grams").alias("wanted"), F.explode(F.sequence(F.lit(1), F.col("bands"))).alias("band"))
    banded = banded.withColumn("hash", min_hash(F.col("wanted"), F.col("band")))
    found = rows.join(F.broadcast(banded.drop("wanted", "license")), ["n", "size", "band", "hash"]).select("row", "n", "size", "k", "template").distinct()
    found = found.join(every_window, ["row", "n", "size", "k"]).join(F.broadcast(table.select("template", "license", F.col("grams").alias("wanted"))), "template")
    found = found.withColumn("containment", F.size(F.array_intersect("grams", "wanted")) / F.size("wanted")).filter(F.col("containment") >= least)
    return found.groupBy("doc_id", "template", "license").agg(F.max("containment").alias("containment"), F.min(F.col("k") * F.col("n")).cast("long").alias("first_word"), F.countDistinct("k").alias("windows"))


def sql(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same by exact containment of all windows; templates of 5 words or more only."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in templates)
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH t0 AS (SELECT * FROM (VALUES {rows}) v(template, license, text)),
t AS (SELECT template, license, len(w)::BIGINT AS n, list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS wanted FROM (SELECT template, license, {words} AS w FROM t0)),
d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) AS g, len(w)::BIGINT AS m FROM d WHERE len(w) >= 5),
grams AS (SELECT template, unnest(wanted) AS gram, n FROM t),
hit AS (SELECT DISTINCT doc_id, template, n, g.i // n AS k0 FROM (SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS i FROM s) g JOIN grams USING (gram)),
win AS (SELECT DISTINCT doc_id, template, n, greatest(k0 - o, 0) AS k FROM hit, (VALUES (0), (1)) x(o)),
c AS (SELECT w.doc_id, w.template, t.license, w.n, w.k, len(list_intersect(t.wanted, s.g[w.k * w.n + 1:w.k * w.n + 2 * w.n - 4])) / len(t.wanted)::DOUBLE AS containment
  FROM win w JOIN t ON w.template = t.template JOIN s ON w.doc_id IS NOT DISTINCT FROM s.doc_id)
SELECT doc_id, template, license, max(containment) AS containment, min(k * n)::BIGINT AS first_word, count(DISTINCT k)::BIGINT AS windows
FROM c WHERE containment >= {least} GROUP BY doc_id, template, license
"""
