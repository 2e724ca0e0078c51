"""Licence families of paragraphs: sparse word n-grams, logistic regression, templates.

A paragraph is a line, or a window of adjacent lines up to a blank one, as
notices are wrapped, even at one word a line.  A window counts if its first and last line both add to what
it holds of a template, so a notice isn't found again with its surroundings; of
the paragraphs that begin at one line the surest stands for all.  Windows are made only from a line that has
a pair of a template to one that has, pairs over the line's end among them.

A multinomial logistic regression over single words and pairs is fitted on the
templates below, damaged and set among words of the corpus, against an unknown
class: at most SAMPLE lines of the corpus, drawn by hash, that share no
pair of rare words with a template.  Its vocabulary is the templates' n-grams
that have a word which is rare in those of the sample that share no pair with a
template (a notice doesn't go unseen because it is frequent), so a paragraph without any such
word has no feature and is unknown without being scored.  The score from which a
family counts is calibrated on held-out paragraphs of both classes.  A family
then has to be confirmed: enough of one of its templates' pairs must stand in the
paragraph.

Defined results: no text has no paragraphs; rows are scanned one for one; an
empty table gives an empty result.
"""
from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn as drawn_part
from .common import written

UNKNOWN = "unknown"
#: Paragraphs drawn for the unknown class; percentage, and number, of them that a rare word may stand in; damaged copies of a template.
SAMPLE, RARE, RARE_LEAST, COPIES = 4000, 1, 20, 24
#: Percentage of a template's pairs that confirms its family; the lowest score that may be calibrated.
CONFIRMED, LEAST_SCORE = 60, 0.5
#: Short notices of well-known licences, by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."), ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("apache", "Licensed under the Apache License, Version 2.0."), ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Distributed under the License on an AS IS basis, without warranties or conditions of any kind, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software under the terms of the GNU Lesser General Public License, version 2.1."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license."), ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by", "Licensed under CC BY 4.0."), ("cc-by", "Content is available under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "This work is dedicated to the public domain."), ("public-domain", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("proprietary", "All rights reserved."), ("proprietary", "Copyright (c) 2020 the authors. All rights reserved."), ("proprietary", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
]
#: Lines that a notice takes at most: the longest template with each word on its own line.
LINES = max(len(re.findall(r"[^\W_]+", text)) for _, text in TEMPLATES)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def pairs(ws: Column) -> Column:
    return F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str, known: list[str]) -> DataFrame:
    """Rows ``row`` (of ``docs``)``, doc_id, paragraph`` (first line, from 0)``, n`` (lines)``, parts`` (their words): lines with a letter or digit, and windows of
    such lines that begin and end with a line that has one of the pairs ``known``."""
    split = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), tokens)
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), split.alias("ls"))
    over = lambda ws, i: F.concat_ws(" ", F.element_at(ws, -1), F.get(F.get("ls", i + 1), F.lit(0)))  # noqa: E731  the pair over the line's end
    told = F.transform("ls", lambda ws, i: F.struct(ws.alias("ws"), F.exists(pairs(ws), lambda p: p.isin(known)).alias("own"),
                                                    F.when(F.size(ws) > 0, over(ws, i).isin(known)).otherwise(False).alias("over")))
    told = lines.select("row", "doc_id", told.alias("told"))
    reach = F.transform("told", lambda x, i: F.slice("told", i + 1, F.when(x["own"] | x["over"], LINES).otherwise(1)))
    ahead = told.select("row", "doc_id", F.posexplode(reach).alias("paragraph", "ahead")).where(F.size(F.get("ahead", F.lit(0))["ws"]) > 0)
    blank = F.array_position(F.transform("ahead", lambda x: F.size(x["ws"])), F.lit(0))
    run = F.when(blank > 0, blank.cast("int") - 1).otherwise(F.size("ahead"))
    sizes = F.filter(F.sequence(F.lit(1), run), lambda n: (n == 1) | F.get("ahead", n - 1)["own"] | F.get("ahead", n - 2)["over"])
    return ahead.select("row", "doc_id", "paragraph", "ahead", F.explode(sizes).alias("n")).select(
        "row", "doc_id", "paragraph", "n", F.transform(F.slice("ahead", 1, F.col("n")), lambda x: x["ws"]).alias("parts"))


def draw(docs: DataFrame, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` different paragraphs, those of the smallest hashes."""
    texts = docs.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    # Texts have about a paragraph or more each; equal paragraphs have one hash and are drawn once.
    hashed = drawn_part(texts.select(F.xxhash64("text").alias("h"), "text"), F.col("h"), 4 * sample, docs.count())
    low = hashed.distinct().orderBy("h", "text").limit(sample)
    return low.select("h", "text", tokens(F.col("text")).alias("ws"))


class Scanner:
    """A fitted scanner: vocabulary, model and calibrated score."""

    def __init__(self, spark: SparkSession, drawn: DataFrame, seed: int = 7):
        self.spark = spark
        plain = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "id int, family string, text string").withColumn("ws", tokens(F.col("text")))
        self.templates = plain.select("id", "family", F.array_distinct(pairs(F.col("ws"))).alias("pairs"))
        template_words = plain.select(F.explode("ws").alias("word")).distinct()
        self.pairs = template_pairs = sorted({g for r in self.templates.select("pairs").collect() for g in r.pairs})
        apart = drawn.where(~F.arrays_overlap(pairs(F.col("ws")), F.array(*[F.lit(g) for g in template_pairs])))
        # Words of templates only: a bounded list for the driver, as the templates are fixed.
        seen = apart.select(F.explode(F.array_distinct("ws")).alias("word")).join(F.broadcast(template_words), "word").groupBy("word").agg(F.count("*").alias("n"))
        size = max(1, apart.count())
        common = {r.word for r in seen.where((F.col("n") * 100 > RARE * size) & (F.col("n") > RARE_LEAST)).collect()}
        grams = {g for r in plain.select(F.concat("ws", pairs(F.col("ws"))).alias("g")).collect() for g in r.g}
        self.vocabulary = sorted(g for g in grams if not set(g.split()) <= common)
        self.rare = sorted({w for g in self.vocabulary for w in g.split()} - common)
        self.families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
        self.vectors = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="grams", outputCol="features")
        # Repeated runs see the same rows: damage depends on hashes alone.
        filler = F.array(*[F.lit(w) for w in sorted(common)] or [F.lit("the")])
        damaged = plain.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        kept = F.filter("ws", lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64("id", "copy", i), F.lit(12)) > 0))
        pad = lambda side: F.slice(filler, 1 + F.pmod(F.xxhash64("id", "copy", F.lit(side)), F.size(filler)).cast("int"), F.pmod(F.xxhash64("copy", F.lit(side)), F.lit(9)).cast("int"))
        known = damaged.select("family", F.when(F.col("copy") == 0, F.col("ws")).otherwise(F.concat(pad(1), kept, pad(2))).alias("ws"), (F.pmod(F.xxhash64("copy", "id"), F.lit(4)) == 0).alias("held"))
        shared = F.size(F.array_intersect(pairs(F.col("ws")), F.array(*[F.lit(g) for g in self.vocabulary if " " in g])))
        other = drawn.where(shared == 0).select(F.lit(UNKNOWN).alias("family"), "ws", (F.pmod(F.xxhash64("h"), F.lit(4)) == 0).alias("held"))
        rows = known.union(other).withColumn("label", F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1)
        rows = written(self.features(rows).select("label", "family", "held", "features").coalesce(1), "licence-sample")  # bounded by SAMPLE and the templates
        self.model = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, family="multinomial").fit(rows.where("not held"))
        wrong = self.scored(rows.where("held")).where((F.col("predicted") != UNKNOWN) & (F.col("predicted") != F.col("family")))
        self.least = max(LEAST_SCORE, wrong.agg(F.max("probability")).first()[0] or 0.0)

    def features(self, rows: DataFrame) -> DataFrame:
        return self.vectors.transform(rows.withColumn("grams", F.concat("ws", pairs(F.col("ws")))))

    def scored(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows.drop("probability", "prediction", "rawPrediction"))
        name = F.get(F.array(*[F.lit(f) for f in self.families]), F.col("prediction").cast("int"))
        return out.withColumn("predicted", name).withColumn("probability", F.array_max(vector_to_array("probability")))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Paragraphs with a rare word of a template, the surest of each first line: ``doc_id, paragraph, family, probability, overlap, confirmed``."""
        rare = F.array(*[F.lit(w) for w in self.rare])
        # A document without any rare word is done with; then the same holds for each paragraph.
        some = docs.where(F.arrays_overlap(tokens(F.coalesce(F.col(text_col), F.lit(""))), rare))
        rows = paragraphs(some, id_col, text_col, self.pairs).withColumn("ws", F.flatten("parts")).where(F.arrays_overlap("ws", rare))
        # Stored, or the words would be worked out again for each pair of them, and the pairs for each template.
        rows = written(rows.withColumn("own", pairs(F.col("ws"))), "paragraphs")
        # All templates in one row of fixed size.
        rows = rows.crossJoin(F.broadcast(self.templates.agg(F.collect_list(F.struct("family", "pairs")).alias("ts"))))
        part = lambda t, own: F.size(F.array_intersect(t["pairs"], own)) / F.size(t["pairs"])
        # A window that holds too little of any template can't be confirmed.
        rows = rows.where((F.col("n") == 1) | F.exists("ts", lambda t: part(t, F.col("own")) * 100 >= CONFIRMED))
        told = self.scored(self.features(rows)).select("row", "doc_id", "paragraph", "n", "parts", "own", "ts", "predicted", "probability")
        best = lambda own: F.aggregate(F.filter("ts", lambda t: t["family"] == F.col("predicted")), F.lit(0.0), lambda s, t: F.greatest(s, part(t, F.col(own))))
        both = told.withColumn("overlap", F.round(best("own"), 6)).where((F.col("n") == 1) | (F.col("predicted") != UNKNOWN))
        # Windows without their first or last line must hold less; their pairs are those of the window from, or up to, a place.
        first, last = F.size(F.get("parts", F.lit(0))), F.size(F.element_at("parts", -1))
        both = both.withColumns({"tail": F.slice("own", first + 1, F.size("own")), "head": F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - last))})
        both = both.where((F.col("n") == 1) | (F.col("overlap") > F.round(best("tail"), 6)) & (F.col("overlap") > F.round(best("head"), 6)))
        sure = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= self.least) & (F.col("overlap") * 100 >= CONFIRMED)
        found = both.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "n", F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
                            F.round("probability", 6).alias("probability"), "overlap", sure.alias("confirmed"), "row")
        rank = F.struct("confirmed", "overlap", "probability", (-F.col("n")).alias("shorter"), "family")
        one = found.groupBy("row", "doc_id", "paragraph").agg(F.max(rank).alias("b"))
        return one.select("doc_id", "paragraph", "b.family", "b.probability", "b.overlap", "b.confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    return Scanner(docs.sparkSession, written(draw(docs, text_col, sample), "drawn")).scan(docs, id_col, text_col)
