"""License scans: MinHash bands over windows of words retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle, share of a template's shingles that must stand in the text, bands (of one hash each).
SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 24
#: Distinct shingles of the templates of a round: their table is collected and broadcast. A longer template has a round of its own.
ROUND_SHINGLES = 50_000

# Notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-licensed": "licensed under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "under the terms of the GNU Lesser General Public License",
    "agpl": "under the terms of the GNU Affero General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-licensed": "licensed under the BSD 3-Clause License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "eupl-1.2": "Licensed under the EUPL, Version 1.2",
    "artistic-2.0": "distributed under the terms of the Artistic License 2.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
}


def license_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case; null has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def _shingles(words: Column, of, size: int) -> Column:
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: of(F.slice(words, i + 1, size)))).otherwise(F.array())


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    return _shingles(words, lambda x: F.xxhash64(x), size).cast("array<bigint>")


def shingle_texts(words: Column, size: int = SHINGLE) -> Column:
    return _shingles(words, lambda x: F.array_join(x, " "), size).cast("array<string>")


def _minima(window: Column) -> Column:
    """A band for each of BANDS hash functions: the least value over the window's shingles."""

    def band(k: int) -> Column:
        return F.struct(F.lit(k).alias("band"), F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k)))).alias("least"))

    return F.array(*[band(k) for k in range(BANDS)])


def collision_probability(jaccard: float, bands: int = BANDS) -> float:
    """That a window and a template of this similarity share a band."""
    return 1 - (1 - jaccard) ** bands


def rounds(templates: dict[str, str]) -> list[tuple[int, dict[str, str]]]:
    """(words in a shingle, templates): those of at least SHINGLE words, and shorter ones by their number of words, in rounds of bounded size."""
    by_size: dict[int, list[tuple[str, str, int]]] = {}
    for name, notice in templates.items():
        n = len(_plain_words(notice))
        if n:
            by_size.setdefault(min(n, SHINGLE), []).append((name, notice, n))
    out: list[tuple[int, dict[str, str]]] = []
    for size, found in sorted(by_size.items()):
        held: dict[str, str] = {}
        shingles = 0
        for name, notice, n in found:
            if held and shingles + n > ROUND_SHINGLES:
                out.append((size, held))
                held, shingles = {}, 0
            held[name] = notice
            shingles += n
        out.append((size, held))
    return out


def _plain_words(notice: str) -> list[str]:
    """license_words() of a template."""
    return re.findall("[a-z0-9]+", notice.lower())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license_id, containment and n_shingles (matched) of each license notice in each text.

    Templates of n shingles, 2**c <= n < 2**(c+1), are looked for in windows of 2**c shingles that start every
    quarter window. If a template stands in the text, a window lies within it, whose similarity is over 1/2; if a
    fifth of its shingles differ, it is still over 1/4, and two such share one of the 24 bands with probability
    over 0.998. Windows without any template's shingle share no least value with one, so they are not hashed.
    What the bands retrieve is verified on the words themselves: the window and a template's length around it must hold
    80 % of the template's distinct shingles. The best containment counts.

    There may be any number of templates of any length: they are taken in rounds, see rounds(), whose tables are broadcast;
    text never shuffles. A template of fewer than SHINGLE words is one shingle of as many words; one without words matches
    nothing, nor do null and empty texts. Rows with the same id count as one. Extra columns are not returned, so they
    can't clash; an empty table gives an empty one.
    """
    planned = rounds(TEMPLATES if templates is None else templates)
    empty = docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0.0).alias("containment")).limit(0)
    found = [_scan_round(docs, part, size, doc_id, text) for size, part in planned] or [empty]
    found = reduce(DataFrame.unionByName, found)
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.max("n_shingles").alias("n_shingles"))


def _scan_round(docs: DataFrame, templates: dict[str, str], size: int, doc_id: str, text: str) -> DataFrame:
    """Matches of one round, a row for each window that retrieved one."""
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in templates.items()], "license_id string, notice string").withColumn("w", license_words(F.col("notice")))
    table = table.select("license_id", F.array_distinct(shingle_hashes(F.col("w"), size)).alias("h"), F.array_distinct(shingle_texts(F.col("w"), size)).alias("wanted"))
    rows = table.select("h").collect()
    known = sorted({h for r in rows for h in r.h})
    classes = sorted({int(math.log2(len(r.h))) for r in rows})
    power = F.floor(F.log2(F.size("h").cast("double"))).cast("int")
    banded = table.select("license_id", "wanted", power.alias("class"), F.explode(_minima(F.col("h"))).alias("b")).select("license_id", "wanted", "class", "b.*")

    def windows(c: int) -> Column:
        length, step = 1 << c, max(1, (1 << c) // 4)
        starts = F.flatten(F.transform("hits", lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-length // step))), lambda j: (F.floor(p / step) - j) * step), lambda s: (s >= 0) & (s + length > p))))
        first = lambda s: F.greatest(s - 2 * length, F.lit(0))
        return F.transform(F.array_distinct(starts), lambda s: F.struct(F.lit(c).alias("class"), F.slice("h", s.cast("int") + 1, F.lit(length)).alias("window"), F.slice("w", first(s).cast("int") + 1, (s - first(s)).cast("int") + 3 * length + size - 1).alias("around")))

    # explode(array(x)) is a border that the optimizer doesn't copy expressions across: each is computed once a row.
    once = lambda x: F.explode(F.array(x))
    hashed = docs.select(F.col(doc_id).alias("doc_id"), once(license_words(F.col(text))).alias("w"))
    hashed = hashed.select("doc_id", "w", once(shingle_hashes(F.col("w"), size)).alias("h"))
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
    found = hashed.select("doc_id", "w", "h", once(hits).alias("hits")).filter(F.size("hits") > 0)
    found = found.select("doc_id", F.explode(F.flatten(F.array(*[windows(c) for c in classes]))).alias("x")).select("doc_id", "x.*")
    found = found.select("doc_id", "class", "around", F.explode(_minima(F.col("window"))).alias("b")).select("doc_id", "class", "around", "b.*")
    found = found.join(F.broadcast(banded), ["class", "band", "least"])
    matched = F.size(F.array_intersect("wanted", shingle_texts(F.col("around"), size)))
    found = found.select("doc_id", "license_id", matched.cast("long").alias("n_shingles"), (matched / F.size("wanted")).alias("containment"))
    return found.filter(F.col("containment") >= CONTAINMENT)
