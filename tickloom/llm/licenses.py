"""License scan: MinHash bands over overlapping text windows, then exact shingle containment (native code only).

Words are lower-cased runs of letters and digits, shingles are SHINGLE words. For a template of n shingles the
text windows are n shingles long and start every max(1, n // STRIDE_PART) shingles, so any occurrence lies within half a
stride of a window. A band is one MinHash value; BANDS bands retrieve a window whose Jaccard similarity with
the template is J with probability 1 - (1 - J) ** BANDS: over 0.9999 at J = 0.55, and 1 at J = 1. A band of a
window can only equal the template's if the window holds the shingle that gives the template's minimum, so
only windows around such shingles are hashed; this skips no collision. A retrieved window is verified on the
shingle strings of the window and a stride around it: containment = shared distinct template shingles /
template shingles must reach CONTAINMENT.

Templates are a table (name, text; the notices in TEMPLATES by default). They are compiled by the same expressions as
texts and stand in the query as one constant, so the plan is the same for ten templates and for thousands; more than
MAX_SHINGLES shingles of all templates together are refused, so what is shipped is bounded.

Defined results: null, empty and very short texts match nothing, and so do templates without SHINGLE words or a name; very
long texts are read whole; every template that reaches CONTAINMENT is named once, in code point order; repeated rows
give repeated rows; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import let

SHINGLE = 5
BANDS = 12
CONTAINMENT = 0.8
STRIDE_PART = 8
MAX_SHINGLES = 200_000

# License notices in common use.
TEMPLATES = {
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _strings(words: Column, n: Column) -> Column:
    """The shingle strings of an array of words; none when there are fewer than SHINGLE."""
    return F.when(
        n >= SHINGLE,
        F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _ranked(j: int):
    return lambda x: F.struct(F.xxhash64(x, F.lit(j)).alias("m"), x.alias("x"))


def _compile(templates: DataFrame) -> tuple[list[dict], list[dict]]:
    """(templates as name, shingles, number of them, stride and band minima; the shingle hashes that give the minima)."""
    rows = templates.where("name IS NOT NULL AND text IS NOT NULL").groupBy("name").agg(F.min("text").alias("text"))
    rows = rows.select("name", _words(F.col("text")).alias("w"))
    rows = rows.select("name", F.array_distinct(_strings(F.col("w"), F.size("w"))).alias("shingles")).where(F.size("shingles") > 0)
    total = rows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    if total > MAX_SHINGLES:
        raise ValueError(f"templates of {total} shingles; scan for {MAX_SHINGLES} at most at once")
    rows = rows.withColumn("h", F.transform("shingles", lambda s: F.xxhash64(s)))
    rows = rows.select("name", "shingles", *[F.array_min(F.transform("h", _ranked(j))).alias(f"b{j}") for j in range(BANDS)])
    made, args = [], []
    for t, r in enumerate(rows.orderBy("name").collect()):
        n = len(r["shingles"])
        bands = [r[f"b{j}"] for j in range(BANDS)]
        made.append({"name": r["name"], "shingles": r["shingles"], "n": n, "stride": max(1, n // STRIDE_PART), "bands": [b["m"] for b in bands]})
        args += [{"x": x, "t": t} for x in sorted({b["x"] for b in bands})]
    return made, args


def _starts(i: Column, n: Column, stride: Column, size: Column) -> Column:
    """Starts of the windows of n shingles that hold place i, of all windows a stride apart and the last one."""
    first = F.ceil(F.greatest(i - (n - 1), F.lit(0)) / stride).cast("int") * stride
    last = F.greatest(size - n, F.lit(0))
    none = F.array().cast("array<int>")
    return F.concat(F.when(first <= i, F.sequence(first, i, stride)).otherwise(none), F.when(last <= i, F.array(last)).otherwise(none))


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined, empty if none), best_containment."""
    spark = docs.sparkSession
    if templates is None:
        listed = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()])
        templates = spark.range(1).select(F.inline(listed))
    compiled, args = _compile(templates)
    known = F.from_json(F.lit(json.dumps(compiled)), "array<struct<name:string,shingles:array<string>,n:int,stride:int,bands:array<bigint>>>")
    pairs = F.from_json(F.lit(json.dumps(args)), "array<struct<x:bigint,t:int>>")
    among = ", ".join(sorted({f"{a['x']}L" for a in args})) or "NULL"
    words = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    hashed = words.select("doc_id", "words", F.transform(_strings(F.col("words"), F.size("words")), lambda s: F.xxhash64(s)).alias("h"))
    places = F.expr(f"IF(exists(h, x -> x IN ({among})), filter(transform(h, (x, i) -> struct(x, i)), p -> p.x IN ({among})), NULL)")
    hits = hashed.select("doc_id", "words", "h", places.alias("hits"))

    def around(p: Column) -> Column:
        def of(q: Column) -> Column:
            t = F.get(known, q["t"])
            return F.transform(_starts(p["i"], t["n"], t["stride"], F.size("h")), lambda s: F.struct(q["t"].alias("t"), s.alias("s")))

        return F.flatten(F.transform(F.filter(pairs, lambda q: q["x"] == p["x"]), of))

    def retrieved(c: Column) -> Column:
        t = F.get(known, c["t"])
        band = lambda window: F.exists(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(window, lambda x: F.xxhash64(x, j))) == F.get(t["bands"], j)
        )
        return let(F.slice("h", c["s"] + 1, t["n"]), band)

    def verified(c: Column) -> Column:
        t = F.get(known, c["t"])
        begin = F.greatest(c["s"] - t["stride"], F.lit(0))
        piece = F.slice("words", begin + 1, t["n"] + 2 * t["stride"] + (SHINGLE - 1))
        shared = F.array_intersect(let(piece, lambda w: _strings(w, F.size(w))), t["shingles"])
        return F.struct(t["name"].alias("name"), (F.size(shared) / t["n"].cast("double")).alias("c"))

    candidates = F.filter(F.array_distinct(F.flatten(F.transform("hits", around))), retrieved)
    found = hits.select("doc_id", F.when(F.col("hits").isNotNull(), F.transform(candidates, verified)).alias("found"))
    kept = found.select("doc_id", F.filter("found", lambda m: m["c"] >= CONTAINMENT).alias("found"))
    named = kept.select("doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))).alias("names"), F.array_max(F.transform("found", lambda m: m["c"])).alias("best_containment"))
    return named.select(
        "doc_id",
        F.coalesce(F.size("names"), F.lit(0)).alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
        "best_containment",
    )
