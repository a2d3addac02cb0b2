"""Finding license texts inside documents.

Templates and documents are cut into overlapping windows of eight words, one at every word;
templates of five to seven words give windows of five. A window is a set of five-word
shingles, and its MinHash under each of `BANDS` permutations of hash values is one band.
Windows that share a band with a template window are candidates. Two windows of Jaccard
similarity s share a band with probability 1 - (1 - s)**BANDS: 1 for equal windows, above
0.93 where one shingle in four is gone on each side, and neighbouring windows add to it. For
each candidate the words around it are compared with the template exactly: the share of the
template's shingles among them is its containment.

Band values of the templates are a set with a fixed bound, built into the plan, so documents
are scanned where they lie and only candidates are shuffled. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .quality import let

SHINGLE, WIDE, NARROW, LEAST, MOST_BANDS = 5, 8, 5, 0.8, 20_000
#: What permutes hash values for each band.
PERMUTATIONS = (0, 0x5BD1E9955BD1E995, -0x61C8864680B583EB)
BANDS = len(PERMUTATIONS)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT notice": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "No warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((texts or TEMPLATES).items()), "license string, text string")


def words_of(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " "))
    return let(plain, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def shingles(words: Column) -> Column:
    """A hash for each five consecutive words."""

    def windows(hashes):
        return F.when(F.size(hashes) < SHINGLE, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(hashes) - SHINGLE), lambda i: F.xxhash64(*[hashes[i + k] for k in range(SHINGLE)]))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def band(hashes: Column, at: Column, number: int, wide: bool) -> Column:
    """MinHash of the window that begins at word `at`, under one permutation."""
    values = [hashes[at + k].bitwiseXOR(F.lit(PERMUTATIONS[number])) for k in range(WIDE - SHINGLE + 1 if wide else 1)]
    return F.least(*values) if len(values) > 1 else values[0]


def places(hashes: Column, wide: bool) -> Column:
    beyond = F.size(hashes) - (WIDE - SHINGLE if wide else 0)
    return F.when(beyond > 0, F.sequence(F.lit(0), beyond - 1)).otherwise(F.array().cast("array<int>"))


def find_licenses(docs: DataFrame, known: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, first_word
    (place of the first candidate window), n_windows.

    `known` holds the templates (license, text). Those of fewer than five words are not
    looked for. A set of templates with more than `MOST_BANDS` band values is refused: look
    for them in several calls. Null and short texts, and empty tables, give no rows. Rows
    that repeat a doc_id count as one document."""
    spark = configure(docs.sparkSession)
    known = (templates(spark) if known is None else known).where("license is not null").select("license", words_of(F.col("text")).alias("words"))
    known = known.where(F.size("words") >= SHINGLE).select("license", F.size("words").alias("length"), shingles(F.col("words")).alias("hashes"))
    wide, narrow = (F.size("hashes") >= WIDE - SHINGLE + 1), (F.size("hashes") < WIDE - SHINGLE + 1)

    def all_bands(is_wide):
        return F.flatten(F.transform(places(F.col("hashes"), is_wide), lambda i: F.array(*[F.struct(F.lit(n).alias("number"), band(F.col("hashes"), i, n, is_wide).alias("value"), F.lit(is_wide).alias("wide")) for n in range(BANDS if is_wide else 1)])))

    bands = known.select("license", "length", F.explode(F.when(wide, all_bands(True)).when(narrow, all_bands(False))).alias("b")).select("license", "length", "b.*").distinct()
    told = bands.select("number", "value", "wide").distinct().limit(MOST_BANDS + 1).collect()
    if len(told) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} band values of templates; look for them in several calls")
    longest = known.agg(F.max("length")).first()[0] or 0
    values = {(number, is_wide): [r["value"] for r in told if r["number"] == number and r["wide"] == is_wide] for number in range(BANDS) for is_wide in (True, False)}

    def hits(hashes, is_wide):
        def struck(i):
            cases = [band(hashes, i, n, is_wide).isin(values[n, is_wide]) for n in range(BANDS) if values[n, is_wide]]
            out = cases[0]
            for case in cases[1:]:
                out = out | case
            return out

        if not any(values[n, is_wide] for n in range(BANDS)):
            return F.array().cast("array<int>")
        return F.filter(places(hashes, is_wide), struck)

    def around(words):
        def found(hashes):
            def row(at, is_wide: bool):
                begin = F.greatest(F.lit(0), at - longest)
                numbers = [F.struct(F.lit(n).alias("number"), band(hashes, at, n, is_wide).alias("value"), F.lit(is_wide).alias("wide")) for n in range(BANDS if is_wide else 1)]
                return F.struct(at.alias("at"), F.slice(words, begin + 1, F.lit(2 * longest + WIDE)).alias("words"), F.array(*numbers).alias("bands"))

            return F.concat(F.transform(hits(hashes, True), lambda at: row(at, True)), F.transform(hits(hashes, False), lambda at: row(at, False)))

        return let(shingles(words), found)

    candidates = docs.select("doc_id", F.explode(let(words_of(F.col("text")), around)).alias("c")).select("doc_id", "c.at", F.col("c.words").alias("around"), F.explode("c.bands").alias("b"))
    met = candidates.select("doc_id", "at", "around", "b.number", "b.value", "b.wide").join(bands, ["number", "value", "wide"])
    checked = met.groupBy("doc_id", "license", "at").agg(F.first("around").alias("around")).join(known.select("license", "hashes"), "license")
    share = F.size(F.array_intersect(F.array_distinct("hashes"), shingles(F.col("around")))) / F.size(F.array_distinct("hashes"))
    return (
        checked.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= least)
        .groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
    )
