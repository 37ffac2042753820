"""License notices in texts: MinHash bands over overlapping windows retrieve
templates, exact shingle containment verifies them.

All of it is DataFrame functions. A text's words give five-word shingles; runs
of shingles are windows. A window's signature holds, for each band, the least
of its shingles' hashes under the band's own seed; windows and templates that
share a value of a band meet in a join with the (small, fixed) template table.
A band has one row, and bands are hashed apart, so that a window of Jaccard
similarity J to a template's window is missed by all b bands with probability
(1 - J) ** b:

* templates of 1 to 3 shingles must stand whole (0.8 of 3 is over 2). Windows
  of one shingle have the shingle itself as the least of any band, so that one
  band never misses;
* longer templates meet windows of 8 shingles at every fourth one, and give
  each of their own windows of 8: a full copy of 4 shingles has J of at least
  1/2, missed by 16 bands with 0.002 %; a copy of 11 or more has an equal
  window and is never missed; a copy at containment 0.8 of 5 shingles keeps 4
  and has J of at least 4/9, missed with 0.01 %.

What meets is verified: the share of the template's shingles that stand within
a template's length around the window must be at least ``least``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import written

#: Notices in common use, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
SHINGLE = 5
LEAST = 0.8
#: Shingles of a window, shingles from one window to the next, and bands, for longer templates.
LONG = (8, 4, 16)
#: Templates of so many shingles, or more, are longer ones.
SPLIT = 4


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column) -> Column:
    """Hashes of all runs of SHINGLE words; none if there are fewer. The words
    are bound to a lambda's variable, or they would be split anew at each use."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(w), of), F.lit(0))


def _banded(windows: DataFrame, size: int, bands: int) -> DataFrame:
    """A row for each window (column x: p and up to ``size`` hashes h) and band
    (c), with its least hash b; least() passes over the nulls of a short window."""
    keep = [c for c in windows.columns if c != "x"]
    wide = windows.select(*keep, F.col("x.p").alias("p"), *(F.get("x.h", F.lit(k)).alias(f"h{k}") for k in range(size)))
    each = wide.select("*", F.explode(F.array(*map(F.lit, range(bands)))).alias("c"))
    hashed = lambda h: F.when(h.isNotNull(), F.xxhash64(h, F.col("c")))
    return each.select(*keep, "p", "c", F.least(*(hashed(F.col(f"h{k}")) for k in range(size))).alias("b"))


def _windows(s: Column, size: int, step: int) -> Column:
    """Windows of ``size`` shingles at each ``step``, and the last one."""
    last = F.greatest(F.lit(0), F.size(s) - size)
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
    return F.transform(starts, lambda p: F.struct(p.alias("p"), F.slice(s, p + 1, size).alias("h")))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license, t: the template's distinct shingles, n)."""
    rows = spark.createDataFrame(templates, "license string, text string")
    t = rows.select("license", F.array_distinct(_shingles(words(F.col("text")))).alias("t"))
    return t.select("license", "t", F.size("t").alias("n")).filter("n > 0")


def _short(rows: DataFrame, t: DataFrame) -> DataFrame:
    """(id, key, p, license, t, n): windows of one shingle of a template."""
    mine = t.select("license", "t", "n", F.explode("t").alias("own"))
    return rows.select("id", "key", F.posexplode("s").alias("p", "h")).join(F.broadcast(mine), F.col("h") == F.col("own")).select("id", "key", "p", "license", "t", "n")


def _long(rows: DataFrame, t: DataFrame, size: int, step: int, bands: int) -> DataFrame:
    """(id, key, p, license, t, n): windows of the documents that share a band
    with a template's window. Rows are narrow here: the shingles of a document
    stay behind."""
    mine = _banded(t.select("license", "t", "n", F.explode(_windows(F.col("t"), size, 1)).alias("x")), size, bands)
    mine = mine.select("license", "t", "n", F.col("c").alias("band"), F.col("b").alias("value")).distinct()
    theirs = _banded(rows.select("id", "key", F.explode(_windows(F.col("s"), size, step)).alias("x")), size, bands)
    return theirs.join(F.broadcast(mine), (F.col("b") == F.col("value")) & (F.col("c") == F.col("band"))).select("id", "key", "p", "license", "t", "n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Returns (id_col, license, containment, first_shingle), a row for each
    document and license with a notice in the document: the largest share of a
    template's shingles found in one place, and where (shingle number) the
    first window with it begins.

    A null or empty text, and one under five words, has no notices. Rows that
    share an id are one document; null ids are one too. Repeated rows change
    nothing. Of templates of one license the best contained counts, of places
    with equal containment the first. Other columns are not read. An empty
    table gives an empty result. Texts of any length are scanned whole.
    """
    t = template_table(docs.sparkSession, templates or TEMPLATES)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = texts.select("id", "key", _shingles(words(F.col("text"))).alias("s"))
    rows = rows.filter(F.size("s") > 0)
    short = _short(rows, t.filter(F.col("n") < SPLIT))
    long = _long(rows, t.filter(F.col("n") >= SPLIT), *LONG)
    met = written(short.unionByName(long).groupBy("id", "key", "p", "license", "t", "n").agg(F.lit(1).alias("one")), "license-windows")
    own = met.select(F.col("id").alias("i"), F.col("key").alias("k"), "p", "license", "t", "n")
    again = texts.join(own.select("i", "k").distinct(), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    again = again.dropDuplicates(["id", "key"]).select("id", "key", _shingles(words(F.col("text"))).alias("s"))
    met = again.join(own, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    low = F.greatest(F.lit(1), F.col("p") + 1 - F.col("n"))
    around = F.slice("s", low, 2 * F.col("n") + LONG[0])
    share = F.size(F.array_intersect(around, "t")) / F.col("n")
    found = met.select("id", "license", "p", share.alias("c")).filter(F.col("c") >= least)
    best = found.groupBy("id", "license").agg(F.max("c").alias("containment"), F.min(F.struct(-F.col("c"), "p")).alias("m"))
    return best.select(F.col("id").alias(id_col), "license", "containment", F.col("m.p").alias("first_shingle"))
