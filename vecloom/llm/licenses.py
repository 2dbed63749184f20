"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates are lower-cased, cut into runs of letters and digits, and hashed as 5-word shingles.
Windows of 1, 2, 3, 4 and 8 shingles start at every position; a window's signature in a band is
the least of its shingle hashes under the band's mask. A template is indexed by the windows of the
largest such size s that it has, and by its least single shingles, one more than a match may lack: of n
shingles a text of containment 0.8 lacks floor(n / 5) at most, so it has one of floor(n / 5) + 1 wherever its
parts lie, and is retrieved with certainty. The bands find looser matches.
Candidates are then held to exact containment: shared distinct shingles / the template's.

All work on a document stays in its row (array functions, no shuffle); only templates, a fixed
table, are broadcast. DataFrame operations only.

Edge cases: null, empty and under-five-word texts match nothing; repeated rows give one match; a template
repeated in a text counts once; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

WORDS = 5
CONTAINMENT = 0.8
MASKS = (0, 0x6B79D38A5C1F2E07)
SIZES = (1, 2, 3, 4, 8)

# The wording of common license notices.
TEMPLATES = [
    ("gpl3-work", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-program", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-work", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(column: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text_of(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(w: Column) -> Column:
    hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])
    return F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), hashed)).otherwise(F.array().cast("array<bigint>"))


def _slide(m: Column, by: int, other: Column | None = None) -> Column:
    """Least of each element and the one ``by`` further on (in ``other``, if given)."""
    x = m if other is None else other
    tail = F.slice(x, F.lit(by + 1), F.greatest(F.size(x), F.lit(0)))
    return F.zip_with(m, tail, lambda a, b: F.least(a, b))


def signatures(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus ``h`` (shingle hashes) and per size and band the windows' signatures ``s<size>_<band>``."""
    df = df.withColumn("w", words(text)).withColumn("h", _shingles(F.col("w"))).drop("w")
    for b, mask in enumerate(MASKS):
        one = F.transform("h", lambda x: x.bitwiseXOR(F.lit(mask).cast("bigint"))) if mask else F.col("h")
        df = df.withColumn(f"s1_{b}", one).withColumn(f"s2_{b}", _slide(F.col(f"s1_{b}"), 1))
        df = df.withColumn(f"s3_{b}", _slide(F.col(f"s2_{b}"), 2, F.col(f"s1_{b}"))) if b == 0 else df
        df = df.withColumn(f"s4_{b}", _slide(F.col(f"s2_{b}"), 2)).withColumn(f"s8_{b}", _slide(F.col(f"s4_{b}"), 4))
    return df


def _bands(size: int) -> range:
    return range(len(MASKS)) if size == SIZES[-1] else range(1)  # smaller windows must agree wholly


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]], containment: float = CONTAINMENT) -> tuple[DataFrame, list[int]]:
    """``template, license, shingles, sig`` (a row per signature) and all signatures."""
    t = signatures(spark.createDataFrame(templates, "template string, license string, text string"), "text")
    size = F.size("h")
    n = F.array_distinct("h")
    lacking = F.floor(F.size(n) * (1 - containment) + 1e-9).cast("int")
    arrays = [F.slice(F.array_sort(n), F.lit(1), lacking + 1)]
    for k, s in enumerate(SIZES):
        top = SIZES[k + 1] if k + 1 < len(SIZES) else 1 << 30
        for b in _bands(s):
            full = F.slice(F.col(f"s{s}_{b}"), F.lit(1), F.greatest(size - s + 1, F.lit(0)))
            arrays.append(F.when((size >= s) & (size < top), full).otherwise(F.array().cast("array<bigint>")))
    t = t.select("template", "license", n.alias("shingles"), F.explode(F.array_distinct(F.concat(*arrays))).alias("sig"))
    rows = t.collect()  # the templates are a fixed table
    kept = spark.createDataFrame(rows, t.schema) if rows else t
    return kept, sorted({r["sig"] for r in rows})


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """A row per document and template it contains: ``doc_id, template, license, n_matched, containment, first_word``."""
    table, sigs = template_table(docs.sparkSession, TEMPLATES if templates is None else templates, containment)
    d = signatures(docs.select("doc_id", text_of().alias("text")), "text")
    own = F.concat(*[F.col(f"s{s}_{b}") for s in SIZES for b in _bands(s)])
    index = F.array(*[F.lit(s) for s in sigs]).cast("array<bigint>")
    hits = d.select("doc_id", "h", F.array_intersect(own, index).alias("hits"))
    # outer: an inner explode would repeat the whole chain above in a filter on the array's size
    cand = hits.select("doc_id", "h", F.explode_outer("hits").alias("sig")).join(F.broadcast(table), "sig")
    shared = F.array_intersect("shingles", "h")
    best = F.size(shared) / F.size("shingles")
    first = F.array_min(F.transform(shared, lambda x: F.array_position("h", x))) - 1
    met = cand.select("doc_id", "template", "license", F.size(shared).cast("long").alias("n_matched"), best.alias("containment"), first.alias("first_word"))
    # a template may be retrieved by several signatures of a document
    return met.where(F.col("containment") >= containment).distinct()
