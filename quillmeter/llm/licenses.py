"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template is found where a window holds at least 0.8 of its five-word shingles. A shingle outside every template can't count
towards that, so the scan keeps the shingles of the broadcast template set only (a lookup by hash in generated code, then the
words are compared); most texts keep none. Windows of twice a template's length class, overlapping by half, hold any
occurrence of a template whole.

Each window gets MinHash values, one row a band. A template of n shingles in a class of windows of 2 * scale words has a
similarity s of at least 0.8 n / (2 scale + 0.2 n) to a window that holds it, whatever else stands there, and is met with
probability 1 - (1 - s) ** bands. The number of bands is derived from the smallest s of all templates so that this is at least
``met`` (0.9999). Templates of up to ``direct`` words are looked up by their shingles instead: of n shingles, k of which must be
there, any n - k + 1 hold one that is, so none is missed.

Edge cases: null and wordless texts match nothing; a template of fewer than five words is one shingle; overlapping matches are
all reported; rows repeated in the input are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N, THRESHOLD, MET, DIRECT, BROADCAST_SHINGLES = 5, 0.8, 0.9999, 32, 1_000_000

#: Notices of common licenses and whole texts of short ones, as they are given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}


def license_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def template_shingles(templates: DataFrame, n: int = N) -> DataFrame:
    """A row per template: template, scale (power of two from its length), shingles (array of distinct words arrays)."""
    t = templates.select("template", common.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice("w", i + 1, n))
    return t.select("template", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("w"), F.lit(n))))).cast("int").alias("scale"), F.array_distinct(cuts).alias("shingles"))


def minhashes(h, bands: int) -> list:
    return [F.xxhash64(F.lit(k), h) for k in range(bands)]


def bands_for(shingles: int, scale: int, threshold: float = THRESHOLD, met: float = MET) -> int:
    """Bands of one row with which a template is met by any window that holds it, with that probability."""
    least = threshold * shingles / (2 * scale + (1 - threshold) * shingles)
    return math.ceil(math.log(1 - met) / math.log(1 - least))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, n: int = N, threshold: float = THRESHOLD, bands: int | None = None, direct: int = DIRECT, broadcast_shingles: int = BROADCAST_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and matches, an array of (template, containment, start): of the window that holds most, and the first word of the match."""
    spark = docs.sparkSession
    known = common.stored(template_shingles(license_templates(spark) if templates is None else templates, n), "templates", files=8)
    if bands is None:  # a row for each power of two, at most
        classes = known.where(F.col("scale") > direct).groupBy("scale").agg(F.min(F.size("shingles")).alias("n")).collect()
        bands = max((bands_for(r.n, r.scale, threshold) for r in classes), default=1)
    single = known.select("template", "scale", F.explode("shingles").alias("s"))
    m = F.size("s")
    key = F.coalesce(*(F.when(m == k, common.bag(F.col("s"), F.lit(0), k)) for k in range(n, 0, -1)))
    single = common.stored(single.select("template", "scale", "s", m.alias("m"), key.alias("key")), "template_shingles", files=8)
    probe = single.groupBy("key", "m", "s").agg(F.sort_array(F.collect_set("scale")).alias("scales"))
    probe = common.stored(probe, "template_probe", files=8)
    lengths = [r.m for r in single.select("m").distinct().orderBy(F.desc("m")).collect()] or [n]  # n numbers at most
    side = common.small_side(probe, broadcast_shingles)

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.reverse(text_col)).alias("row"), common.words(F.col(text_col)).alias("w"))
    at = text.select("id", "row", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - min(lengths), F.lit(-1)))).alias("i"))
    each = F.array(*(F.struct(F.lit(k).alias("len"), F.when((F.col("i") >= 0) & (F.col("i") + k <= F.size("w")), common.bag(F.col("w"), F.col("i"), k)).alias("h")) for k in lengths))
    at = at.select("id", "row", "w", "i", F.inline(each)).where(F.col("h").isNotNull() | (F.col("i") < 0) & (F.col("len") == lengths[0]))
    if side is probe:  # a shuffled row carries its shingle, not the text
        at = at.withColumn("w", F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("len"))).withColumn("from", F.lit(0))
    else:
        at = at.withColumn("from", F.greatest(F.col("i"), F.lit(0)))
    met = at.join(side, (at.h == side.key) & (at.len == side.m) & common.same_array(F.slice("w", F.col("from") + 1, F.col("len")), F.col("s")), "left")
    met = met.where(F.col("scales").isNotNull() | (F.col("i") < 0)).select("id", "row", "i", "h", "scales")
    own = F.col("i") < 0
    held = met.groupBy("id", "row").agg(F.count(F.when(own, 1)).alias("copies"), F.collect_list(F.when(~own, F.struct("i", "h", "scales"))).alias("hits"))
    held = common.stored(held, "license_hits")

    hits = held.where(F.size("hits") > 0).select("id", "row", F.inline("hits")).select("id", "row", "i", "h", F.explode("scales").alias("scale"))
    block = F.floor(F.col("i") / F.col("scale")).cast("long")
    window = hits.select("id", "row", "i", "h", "scale", F.explode(F.array(block - 1, block)).alias("win")).groupBy("id", "row", "scale", "win")
    window = window.agg(F.collect_set(F.struct("i", "h")).alias("at"), *(F.min(x).alias(f"b{k}") for k, x in enumerate(minhashes(F.col("h"), bands))))
    window = window.withColumn("own", F.array_distinct(F.transform("at", lambda x: x["h"])))
    probe_of = lambda band, value: F.struct(F.lit(band).alias("band"), value.alias("value"))
    banded = F.array(*(probe_of(k, F.col(f"b{k}")) for k in range(bands)))
    by_key = lambda keys: F.when(F.col("scale") <= direct, F.transform(keys, lambda h: probe_of(bands, h))).otherwise(banded)
    n_keys = F.size("shingles")
    needed = F.slice(F.array_sort("shingles"), 1, n_keys - F.ceil(n_keys * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)
    bucket = single.groupBy("template", "scale").agg(F.collect_set("key").alias("shingles"), *(F.min(x).alias(f"b{k}") for k, x in enumerate(minhashes(F.col("key"), bands))))
    bucket = bucket.select("template", F.col("scale").alias("tscale"), "shingles", F.inline(by_key(needed))).withColumnRenamed("band", "tband").withColumnRenamed("value", "tvalue")
    bucket = common.small_side(common.stored(bucket, "template_bands", files=8), broadcast_shingles)
    found = window.select("id", "row", "scale", "win", "at", "own", F.inline(by_key(F.col("own")))).join(bucket, (F.col("scale") == F.col("tscale")) & (F.col("band") == F.col("tband")) & (F.col("value") == F.col("tvalue")))
    inside = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    found = found.withColumn("containment", inside).where(F.col("containment") >= threshold)
    first = F.array_min(F.transform(F.filter("at", lambda x: F.array_contains("shingles", x["h"])), lambda x: x["i"]))
    best = found.groupBy("id", "row", "template").agg(F.min(F.struct((-F.col("containment")).alias("less"), first.cast("long").alias("start"))).alias("b"))
    best = best.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("template", (-F.col("b.less")).alias("containment"), F.col("b.start").alias("start")))).alias("matches"))
    best = best.select(F.col("id").alias("i2"), F.col("row").alias("r2"), "matches")
    slim = held.select("id", "row", "copies")
    out = slim.join(best, F.col("id").eqNullSafe(F.col("i2")) & (F.col("row") == F.col("r2")), "left")
    none = F.array().cast("array<struct<template:string,containment:double,start:bigint>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("matches", none).alias("matches"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(id_col, "matches")


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("matches", lambda x: x["template"]), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"))


def op4_sql() -> str:
    """The same by exact containment over whole texts: every window of a template's length class, all shingles, no bands."""
    q = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{q(k)}', '{q(v)}')" for k, v in TEMPLATES.items())
    split = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT template, {split("txt")} AS w FROM (VALUES {rows}) v(template, txt)),
t1 AS (SELECT template, CAST(pow(2, ceil(log2(greatest(len(w), 5)))) AS BIGINT) AS scale, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM t WHERE len(w) > 0),
t2 AS (SELECT DISTINCT template, scale, list_slice(w, i + 1, i + 5) AS s FROM t1),
tn AS (SELECT template, count(*) AS n FROM t2 GROUP BY 1),
d AS (SELECT doc_id, {split("text")} AS w FROM documents),
ms AS (SELECT DISTINCT len(s) AS m FROM t2),
p AS (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m),
h AS (SELECT doc_id, i, template, scale, s FROM p JOIN t2 ON list_slice(w, i + 1, i + m) = t2.s),
win AS (SELECT doc_id, template, s, unnest([i // scale - 1, i // scale]) AS k FROM h),
c AS (SELECT doc_id, template, k, count(DISTINCT s) AS n FROM win GROUP BY ALL),
ok AS (SELECT DISTINCT doc_id, c.template FROM c JOIN tn USING (template) WHERE CAST(c.n AS DOUBLE) / tn.n >= {THRESHOLD}),
g AS (SELECT doc_id, count(*) AS n, string_agg(template, ',' ORDER BY template) AS l FROM ok GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(l, '') AS licenses FROM d LEFT JOIN g USING (doc_id)
"""
