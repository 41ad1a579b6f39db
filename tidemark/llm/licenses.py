"""License scan with DataFrame functions alone: MinHash bands retrieve, exact shingle containment verifies.

A template's set is its distinct shingles of ``shingle`` words (of all its words, if it has fewer). A match is a window of
a text that holds at least ``percent`` of a template's shingles. Windows overlap: for templates of m words they are
m + s words long and start at every s-th word, s = m / 4, so some window holds any whole passage of m words. A window and
a template that match have a Jaccard similarity of about 0.5 or more; with BANDS bands of one row the chance to miss
such a pair is 2 ** -BANDS, and each retrieved pair is then verified exactly.

Windows are built around anchor words only, which loses nothing: anchors are words of the template such that fewer
shingles than a match needs are without one. Texts without any anchor are put aside by one regular expression.

Defined results: null and empty texts match nothing; whole texts are scanned, in arrays that grow with the one text; rows of
equal id are reported together, repeated rows as one; several templates of equal text are all reported, which settles ties;
an empty table gives no rows; columns of the input beside doc_id and text, whatever their names, are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

BANDS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Common licence notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "proprietary": "All rights reserved",
}


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def needed(shingles: int, percent: int) -> int:
    return -(-percent * shingles // 100)


def anchors(words: list[str], shingle: int, percent: int) -> set[str]:
    """The longest words of a template, as many as leave fewer shingles without one than a match needs."""
    k = min(shingle, len(words))
    sets = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    out: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(1 for s in sets if not out & set(s)) < needed(len(sets), percent):
            break
        out.add(w)
    return out


def word_array(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    return F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingle_array(words: Column, k: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.concat_ws(" ", F.slice(words, i, k))))


def band_array(shingles: Column) -> Column:
    """The least value of each of BANDS hash functions."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[F.struct(F.lit(band).alias("band"), least(band).alias("value")) for band in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str], shingle: int) -> DataFrame:
    """template, m, k, t_shingles, t_bands; as many rows as there are templates."""
    rows = [F.struct(F.lit(name).alias("template"), F.array(*map(F.lit, plain_words(text))).alias("words")) for name, text in templates.items()]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("m", F.size("words")).withColumn("k", F.least(F.lit(shingle), F.size("words")))
    return table.withColumn("t_shingles", shingle_array(F.col("words"), F.col("k"))).drop("words")


def windows_of(m: int, found: list[str]) -> Column:
    """The windows of column ``w`` for templates of ``m`` words, as structs of m and words: those that hold an anchor."""
    s = max(1, m // 4)
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*found), i)), lambda i: i.isNotNull())
    reach = lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - m - s + 1) / s).cast("int")), F.floor(i / s).cast("int"))
    starts = F.array_distinct(F.flatten(F.transform(at, reach)))
    return F.transform(starts, lambda b: F.struct(F.lit(m).alias("m"), F.slice("w", b * s + 1, F.lit(m + s)).alias("words")))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, template, n_matched and n_shingles of the best window, for each document and template that match."""
    spark, templates = docs.sparkSession, {k: v for k, v in (templates or TEMPLATES).items() if plain_words(v)}
    words = {name: plain_words(text) for name, text in templates.items()}
    by_size: dict[int, set[str]] = {}
    for w in words.values():
        by_size.setdefault(len(w), set()).update(anchors(w, shingle, percent))
    every = sorted(set().union(*by_size.values()))
    low = F.translate("text", UPPER, LOWER)
    texts = docs.where("text is not null").where(low.rlike("|".join(every))).select("doc_id", word_array(F.col("text")).alias("w"))

    windows = [windows_of(m, sorted(found)) for m, found in sorted(by_size.items())]
    rows = texts.select("doc_id", F.explode(F.concat(*windows)).alias("x")).select("doc_id", "x.m", "x.words")
    rows = rows.withColumn("k", F.least(F.lit(shingle), F.col("m"))).where(F.size("words") >= F.col("k"))
    rows = rows.select("doc_id", "m", shingle_array(F.col("words"), F.col("k")).alias("shingles"))
    rows = rows.select("doc_id", "m", "shingles", F.explode(band_array(F.col("shingles"))).alias("b")).select("doc_id", "m", "shingles", "b.band", "b.value")

    table = template_table(spark, templates, shingle).withColumn("b", F.explode(band_array(F.col("t_shingles")))).select("template", "m", "t_shingles", "b.band", "b.value")
    pairs = rows.join(F.broadcast(table), ["m", "band", "value"])  # BANDS rows for each of the given templates
    matched = pairs.select("doc_id", "template", F.size(F.array_intersect("shingles", "t_shingles")).cast("long").alias("n_matched"), F.size("t_shingles").cast("long").alias("n_shingles"))
    return matched.where(100 * F.col("n_matched") >= percent * F.col("n_shingles")).groupBy("doc_id", "template").agg(F.max("n_matched").alias("n_matched"), F.max("n_shingles").alias("n_shingles"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read(spark, sf_dir, "documents"))


def op2_sql() -> str:
    """All windows against all templates, without bands or anchors."""
    values = ", ".join(f"('{name}', '{' '.join(plain_words(text))}')" for name, text in TEMPLATES.items())
    return rf"""
WITH t AS (SELECT template, string_split(phrase, ' ') AS w FROM (VALUES {values}) AS v(template, phrase)),
t2 AS (SELECT template, w, len(w) AS m, least(5, len(w)) AS k, greatest(1, len(w) // 4) AS s FROM t),
ts AS (SELECT DISTINCT template, m, k, s, array_to_string(w[i:i + k - 1], ' ') AS sh FROM t2, LATERAL unnest(generate_series(1, m - k + 1)) AS g(i)),
tn AS (SELECT template, count(*) AS n_shingles FROM ts GROUP BY template),
d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS sh FROM d, (SELECT DISTINCT k FROM ts) AS ks, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS g(i)),
hit AS (SELECT doc_id, template, m, k, s, i, sh FROM ds JOIN ts USING (k, sh)),
win AS (SELECT doc_id, template, b, count(DISTINCT sh) AS n FROM hit, LATERAL unnest(generate_series(greatest(0, (i + k - 1 - m - s + s - 1) // s), (i - 1) // s)) AS g(b) WHERE b * s + 1 <= i AND i + k - 1 <= b * s + m + s GROUP BY doc_id, template, b)
SELECT doc_id, template, CAST(max(n) AS BIGINT) AS n_matched, CAST(any_value(n_shingles) AS BIGINT) AS n_shingles
FROM win JOIN tn USING (template) WHERE 100 * n >= 75 * n_shingles GROUP BY doc_id, template
"""


OP2_SQL = op2_sql()
