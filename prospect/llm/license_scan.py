"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A text's possible headers are its lines and the windows
of consecutive ones, as many as the longest template has words, so that a notice
is found however it is broken; lines without terms do not count. A licence file
(by its name) is compared as a whole too. Terms are words and version numbers in
lower case; a term's weight is its inverse document frequency over all files,
counted for the templates' terms, and 1 for any other. What cannot reach
``COSINE`` is not compared: a passage is at least as long as the terms that it
shares with a template, so these must weigh enough, however common they are; and
a window ends where dropping a line loses a shared term, since it is no worse
without that line otherwise. The sparse vectors meet the templates' in a join on
terms. The best template with a cosine of
``COSINE`` or more is the file's own licence. A directory's licence is that of
its licence file (the best match, then the least path). A file without its own
inherits from the nearest directory above it that has one: the distinct
directories are joined with their ancestors' paths, and files with directories.

Templates are given (notices of common licences, a fixed short list); their
terms are bounded by it, so the broadcast is.

Edge cases: a null or empty text has no lines and can only inherit; a null path
has no directory and inherits nothing; equal scores go to the first licence by
name; repeated rows are rated as often as they come; every line of a very long text
counts; an empty table gives no rows. Columns besides ``path`` and ``text`` are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

COSINE = 0.6
#: Usual notices by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. Released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Names of licence files.
FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, text) for name, text in TEMPLATES], "license string, text string")


def terms(text: Column) -> Column:
    """Words and version numbers, distinct, in lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\.", " "), " +"), lambda w: w != ""))


def _vectors(known: DataFrame) -> DataFrame:
    return cut(known.withColumn("t", F.monotonically_increasing_id()).select("t", "license", F.explode(terms(F.col("text"))).alias("term")), "templates")


def _may_match(shared: Column, others: Column, sides: list[list[str]], squares: dict[str, float]) -> Column:
    """Whether a passage with these terms of the templates and ``others`` more can have a cosine of ``COSINE``; never false if it has."""
    known = F.array(*(F.struct(F.array(*map(F.lit, t)).alias("terms"), F.lit(COSINE**2 * sum(squares[w] for w in t)).alias("need")) for t in sides))
    square = F.create_map(*(F.lit(x) for w in squares for x in (w, squares[w])))
    dot = lambda t: F.aggregate(F.array_intersect(shared, t["terms"]), F.lit(0.0), lambda a, w: a + F.element_at(square, w))
    # the passage's squared length is the dot product with itself: no less than that with the template, plus 1 for each other term
    return F.exists(known, lambda t: F.exists(F.array(dot(t)), lambda d: (d > 0) & (d * d * (1 + 1e-6) >= t["need"] * (d + others))))


def _own(files: DataFrame, vectors: DataFrame, words: list[str], most_lines: int) -> DataFrame:
    """(row, license, cosine): the best template of each file that has one."""
    spark = files.sparkSession
    # inverse document frequencies of the templates' terms, over all files
    counts = {r["term"]: r["n"] for r in files.select(F.explode("known_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, files.count())
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in words}
    weights = spark.createDataFrame(list(idf.items()), "term string, idf double")
    sides = [sorted(r["terms"]) for r in vectors.groupBy("t").agg(F.collect_list("term").alias("terms")).collect()]  # bounded by the templates
    may = lambda shared, others: _may_match(shared, others, sides, {w: x * x for w, x in idf.items()})
    mine = F.array(*map(F.lit, words))
    open_ = files.where(may(F.col("known_terms"), F.lit(0)))
    lines = F.filter(F.transform(F.split("text", "\n"), terms), lambda t: F.size(t) > 0)
    whole = F.when(F.element_at(F.split("path", "/"), -1).rlike(FILES), terms(F.col("text")))
    open_ = cut(open_.select("row", lines.alias("lines"), whole.alias("whole")), "lines")
    each = open_.select("row", "lines", F.transform("lines", lambda t: F.array_intersect(t, mine)).alias("shared"), F.transform("lines", lambda t: F.size(F.array_except(t, mine))).alias("others"))
    first = F.filter(F.sequence(F.lit(0), F.size("shared") - 1), lambda i: (F.size(F.get("shared", i)) > 0) & may(F.flatten(F.slice("shared", i + 1, most_lines)), F.lit(0)))
    each = each.withColumn("i", F.explode(first)).select("row", *(F.slice(c, F.col("i") + 1, most_lines).alias(c) for c in ("lines", "shared", "others")))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("shared")),
        lambda n: (F.size(F.array_except(F.get("shared", n - 1), F.flatten(F.slice("shared", 1, n - 1)))) > 0)
        & (F.size(F.array_except(F.get("shared", F.lit(0)), F.flatten(F.slice("shared", 2, n - 1)))) > 0)
        & may(F.flatten(F.slice("shared", 1, n)), F.array_max(F.slice("others", 1, n))),
    )
    each = each.withColumn("n", F.explode(ends)).select("row", F.array_distinct(F.flatten(F.slice("lines", F.lit(1), F.col("n")))).alias("terms"))
    passages = each.unionByName(open_.where("whole is not null").select("row", F.col("whole").alias("terms")))
    passages = cut(passages.select("row", F.concat_ws(" ", F.array_sort("terms")).alias("line")).distinct(), "passages")
    # a line that many files have is compared once
    w = F.broadcast(weights.select("term", "idf"))
    each = passages.select("line").distinct().select("line", F.explode(F.split("line", " ")).alias("term")).join(w, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    norms = each.groupBy("line").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    sides = vectors.join(w, "term").withColumn("side", F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("t"))))
    dots = each.join(F.broadcast(sides.select("t", "license", "term", "side")), "term").groupBy("line", "t", "license", "side").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    scored = dots.join(norms, "line").withColumn("cosine", F.round(F.col("dot") / (F.col("side") * F.col("norm")), 9)).where(F.col("cosine") >= COSINE)
    lines = scored.groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    best = passages.join(lines, "line").groupBy("row").agg(F.min("b").alias("b"))
    return best.select("row", "b.license", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The files' columns without the text, with ``license``, ``cosine`` (of an own one), ``found`` (own, inherited or none) and ``licensed_by``, the directory inherited from."""
    known = known if known is not None else templates(files.sparkSession)
    named = [c for c in files.columns if c not in ("text", "license", "cosine", "found", "licensed_by", "row", "dir", "known_terms")]
    rows = files.select(*named, F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    vectors = _vectors(known)
    words = [r["term"] for r in vectors.select("term").distinct().orderBy("term").collect()]  # bounded by the templates
    most_lines = max(1, known.agg(F.max(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 1)
    rows = cut(rows.withColumn("known_terms", F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, words)))), "files")
    parts = F.split("path", "/")
    rows = rows.withColumn("dir", F.when(F.size(parts) > 1, F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1))).when(F.col("path").isNotNull(), F.lit("")))
    own = cut(_own(rows, vectors, words, most_lines), "own")
    rated = rows.drop("text", "known_terms").join(own, "row", "left")
    licensed = rated.where(F.col("license").isNotNull() & F.element_at(parts, -1).rlike(FILES))
    by_dir = licensed.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b")).select("above", F.col("b.license").alias("inherited"))
    dirs = rows.select("dir").where("dir is not null").distinct()
    pieces = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda n: F.struct(n.alias("depth"), F.when(n > 0, F.concat_ws("/", F.slice(pieces, 1, n))).otherwise(F.lit("")).alias("above")))
    nearest = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(up)).alias("u")).select("dir", "u.depth", "u.above").distinct()
    nearest = nearest.join(by_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("n")).select("dir", F.col("n.above").alias("licensed_by"), F.col("n.inherited").alias("inherited"))
    out = rated.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        *named,
        F.coalesce("license", "inherited").alias("license"),
        "cosine",
        F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(~has, F.col("licensed_by")).alias("licensed_by"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a directory for each source, 400 and 20 documents.

    Of a directory's documents the first is its licence file: those whose number is
    divisible by 400 in the upper directory, by 20 in the lower one. A document's
    number is its id, or the id's CRC-32 where that is no whole number; one without
    an id is ``unnamed.txt`` of its source's directory, one without a source is of ``unknown``.
    """
    n = F.coalesce(F.expr("try_cast(cast(doc_id as string) as bigint)"), F.crc32(F.col("doc_id").cast("string")))
    name = F.when(n % 20 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    upper, lower = F.floor(n / 400).cast("string"), F.floor(n / 20).cast("string")
    root = F.coalesce("source", F.lit("unknown"))
    path = F.when(n.isNull(), F.concat_ws("/", root, F.lit("unnamed.txt"))).when(n % 400 == 0, F.concat_ws("/", root, upper, name)).otherwise(F.concat_ws("/", root, upper, lower, name))
    return docs.select("doc_id", path.alias("path"), "text")
