"""Licence scans: a trained paragraph classifier over word n-grams, in DataFrame operations only.

A paragraph is the text between blank lines; its words are lower-case runs of letters and digits, so that line feeds
inside it part words like blanks. What is classified are a paragraph's lines and, for every template that the paragraph
may contain, the windows of its words where that template's words stand. So notices wrapped over lines are found, and
several notices in one line or paragraph each by windows of their own. The training rows are the templates below (texts,
headers, and short grants made of every name of a licence) in a few deterministic variants (a word left out, a notice
before it, other text around it), and, as the class "unknown", sentences that talk about licences without granting one
and paragraphs of the corpus that share little with any template (from at most SAMPLE documents, those of the smallest
hash of their id). Anchors are the templates' words other than everyday ones, a fixed list; paragraphs without an anchor
are not looked at. Features are the one-, two- and three-word grams that hold an anchor. The model is a multinomial
logistic regression on these sparse binary features; its probabilities are calibrated by a temperature that fits
training variants kept aside. A family is confirmed where it is a line's or window's most probable one and a template of
it is contained there (share of the template's two-word grams, and all words that name the licence); a paragraph with a
line or window that is classified but without any confirmed family counts as unknown.

Defined results: a document has one row with its families (sorted, joined by commas; empty without any), the number of
licence and of unknown paragraphs, and the largest probability of a confirmed family (0 without any). Null and empty
texts have no paragraphs; a row's findings are those of its own text, also where rows share an id or have none; an
empty table gives no rows; other columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Documents whose paragraphs may stand for the unknown class, and how many of those paragraphs are used.
SAMPLE, NOISE = 400, 1200
VARIANTS = 12
CONFIRMED = 0.6
#: Words a window has beyond those of its template: a word may stand between them.
SLACK = 2
#: Line feeds with nothing but blanks between them.
BLANK_LINES = r"\n[ \t\x0B\f\r]*\n\s*"
UNKNOWN = "unknown"
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)

# fixed values: names of public licences, by family, with the words that tell each
NAMES = (
    ("MIT", "MIT", ("MIT license", "MIT")),
    ("Apache-2.0", "Apache", ("Apache license", "Apache license, version 2.0", "Apache 2.0 license", "Apache-2.0")),
    ("GPL", "GPL", ("GPL", "GPL, version 2", "GPL, version 3", "GPLv2", "GPLv3", "GNU GPL", "GPL-2.0-only", "GPL-3.0-or-later")),
    ("GPL", "GNU general", ("GNU general public license", "GNU general public license, version 2", "GNU general public license, version 3", "GNU general public license v3.0")),
    ("LGPL", "LGPL", ("LGPL", "LGPL, version 2.1", "LGPLv3", "GNU LGPL", "LGPL-2.1-or-later")),
    ("LGPL", "lesser", ("GNU lesser general public license", "GNU lesser general public license, version 2.1")),
    ("AGPL", "AGPL", ("AGPL", "AGPLv3", "GNU AGPL", "AGPL-3.0-only")),
    ("AGPL", "Affero", ("GNU Affero general public license", "GNU Affero general public license, version 3")),
    ("BSD", "BSD", ("BSD license", "BSD 2-clause license", "BSD 3-clause license", "new BSD license", "BSD-3-Clause", "BSD-2-Clause")),
    ("MPL-2.0", "Mozilla", ("Mozilla public license", "Mozilla public license, v. 2.0")),
    ("MPL-2.0", "MPL", ("MPL 2.0", "MPL-2.0")),
    ("ISC", "ISC", ("ISC license", "ISC")),
    ("CC-BY", "Attribution", ("Creative Commons Attribution 4.0 International license", "Creative Commons Attribution license")),
    ("CC-BY", "CC BY", ("CC BY 4.0", "CC BY license")),
    ("CC-BY-SA", "ShareAlike", ("Creative Commons Attribution-ShareAlike 4.0 International license", "Creative Commons Attribution-ShareAlike license")),
    ("CC-BY-SA", "CC SA", ("CC BY-SA 4.0", "CC BY-SA 3.0")),
    ("CC-BY-NC", "NonCommercial", ("Creative Commons Attribution-NonCommercial 4.0 International license", "Creative Commons Attribution-NonCommercial license")),
    ("CC-BY-NC", "CC NC", ("CC BY-NC 4.0", "CC BY-NC license")),
    ("CC0", "CC0", ("CC0 1.0 Universal", "CC0 license", "CC0-1.0")),
)
# fixed values: the shapes of short grants
GRANTS = ("licensed under the {}", "under the terms of the {}", "under the {}", "license: {}", "SPDX-License-Identifier: {}")
# fixed values: wordings of public licences and notices, by family
TEXTS = (
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program"),
    ("GPL", "GPLv2"), ("GPL", "GPLv3"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("LGPL", "LGPLv2"), ("LGPL", "LGPLv3"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL", "AGPLv3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC0", "The author has dedicated this work to the public domain by waiving all rights"),
    ("CC0", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced or transmitted without prior written permission of the publisher."),
    ("proprietary", "This document is confidential and proprietary; unauthorized copying or distribution is strictly prohibited"),
)
# fixed values: everyday words, which are no anchors (the abbreviation MIT is one, in German)
EVERYDAY = frozenset(
    "the of and a an to in is it its be are was been this that these by for on or with any may not you your all at as no from but can if will which under mit without other "
    "their our has have had do does than then there such only also must shall more one two new either later here above following first who what when where they we he she so "
    "into about over out up used use should could would".split()
)
#: Tokens that _words parts or writes otherwise; they lead to paragraphs just as anchors do.
SPELT = ("licence", "licences", "licenced", *(f"{g}{v}{n}" for g in ("gpl", "lgpl", "agpl") for v in ("", "v") for n in (2, 3)))
#: family, text, and the words a place must hold besides, for every text and every grant of every name.
TEMPLATES = tuple((f, t, "") for f, t in TEXTS) + tuple((f, g.format(n), tell) for f, tell, names in NAMES for n in names for g in GRANTS)
# fixed values: sentences about licences that grant none
OTHERS = (
    "The driver lost his license after the accident.", "You need a fishing license to fish in this lake.", "Poetic license is common in this genre.",
    "The license fee for broadcasters rose last year.", "Human rights groups protested in the capital.", "The table was reserved for eight people.",
    "The Apache were a people of the southwest.", "He studied at MIT before moving to the coast.", "The general addressed the public in person.",
    "Permission to land was refused by the tower.", "Software versions differ between machines.", "The commons voted on the bill in the evening.",
    "Both sides agreed under the terms of the treaty.", "He was released under the terms of the agreement.", "The shop is licensed under the gaming act.", "Goods are distributed under the brand of the firm.",
    "The general public is admitted under the rules of the park.", "Rights and duties follow from the contract.", "No part of the story may be true.", "The publisher gave permission to print a copy.",
)


def _fixed(spark: SparkSession, rows: list[tuple[str, ...]]) -> DataFrame:
    """Constant rows (family, text, tell), as one expression."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("family", "text", "tell"), row))) for row in rows))))


def _words(text: Column) -> Column:
    """Lower-case words; one spelling of license, versions apart from abbreviations."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), r"\b([al]?gpl)(?=v?[0-9])", "$1 ")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Grams of n words, joined by blanks."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _features(words: Column, anchors: Column) -> Column:
    every = F.concat(_grams(words, 1), _grams(words, 2), _grams(words, 3))
    return F.array_distinct(F.filter(every, lambda g: F.arrays_overlap(F.split(g, " "), anchors)))


class Scanner:
    """The trained model: anchors, features, classes, temperature."""

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        templates = _fixed(spark, [*TEMPLATES]).select("family", _words(F.col("text")).alias("template"), _words(F.col("tell")).alias("tell")).distinct()
        #: The constant table: family, words, telling words.
        self.fixed = sorted((r["family"], tuple(r["template"]), tuple(r["tell"])) for r in templates.collect())
        self.anchors = sorted({w for _, words, _ in self.fixed for w in words if w not in EVERYDAY and (len(w) > 2 or w in ("cc", "v2", "v3"))})
        self.anchor_array = F.array(*map(F.lit, self.anchors))
        self.leads = F.array(*map(F.lit, sorted({*self.anchors, *SPELT})))
        ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        few = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        lines = few.select(F.explode(F.split("text", "\n")).alias("line")).select(_words(F.col("line")).alias("words")).filter("size(words) > 0").distinct()
        against = F.array(*(F.array(*map(F.lit, w)) for _, w, _ in self.fixed))
        # Lines that share a good part of a template may be licences themselves.
        alike = F.exists(against, lambda t: F.size(F.array_intersect(t, F.col("words"))) >= 0.6 * F.size(t))
        strange = lines.filter(~(F.arrays_overlap("words", self.anchor_array) & alike))
        noise = cut(strange.orderBy(F.xxhash64("words"), "words").limit(NOISE).select("words"))
        rows = self._training(spark, templates, noise)
        grams = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=1.0, vocabSize=1 << 14)
        self.vector = grams.fit(rows)
        self.classes = sorted({f for f, *_ in TEMPLATES} | {UNKNOWN})
        index = F.create_map(*(x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))))
        rows = cut(self.vector.transform(rows).select("family", "variant", index[F.col("family")].alias("y"), "x"))
        learnt = rows.filter("variant % 4 <> 3").coalesce(1).sortWithinPartitions("family", "variant", F.col("x").cast("string"))
        self.model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3, maxIter=60).fit(learnt)
        aside = self.model.transform(rows.filter("variant % 4 = 3")).select(F.col("y").cast("int").alias("y"), vector_to_array("rawPrediction").alias("raw"))
        tried = aside.select("y", "raw", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t"))
        loss = tried.groupBy("t").agg(F.sum((-F.log(F.greatest(F.element_at(self._softmax(F.col("raw"), F.col("t")), F.col("y") + 1), F.lit(1e-12)))).cast("decimal(30,9)")).alias("loss"))
        best = loss.orderBy("loss", "t").first()
        self.temperature = float(best["t"]) if best else 1.0

    @staticmethod
    def _softmax(raw: Column, temperature: Column) -> Column:
        top = F.array_max(raw)
        powers = F.transform(raw, lambda r: F.exp((r - top) / temperature))
        return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))

    def _training(self, spark: SparkSession, templates: DataFrame, noise: DataFrame) -> DataFrame:
        """Rows (family, variant, grams)."""
        h = lambda *c: F.pmod(F.xxhash64("template", "variant", *c), F.lit(1 << 30))
        numbered = noise.select(F.row_number().over(Window.orderBy(F.xxhash64("words"), "words")).alias("at"), F.slice("words", 1, 12).alias("around"))
        placed = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("at", (h(F.lit("around")) % F.lit(max(1, noise.count())) + 1).cast("int")).join(numbered, "at", "left")
        gone = (h(F.lit("gone")) % F.size("template") + 1).cast("int")
        some = F.coalesce("around", F.array().cast("array<string>"))
        less = F.when(F.col("variant").isin(2, 3, 6, 7), F.filter(F.col("template"), lambda w, i: i + 1 != gone)).otherwise(F.col("template"))
        words = F.when(F.col("variant") % 3 == 1, F.concat(some, less)).when(F.col("variant") % 3 == 2, F.concat(less, some)).otherwise(less)
        notice = F.when(F.col("variant") >= 8, F.concat(F.array(F.lit("copyright"), F.lit("c"), (h(F.lit("year")) % 40 + 1985).cast("string")), words)).otherwise(words)
        positive = placed.select("family", "variant", notice.alias("words"))
        others = _fixed(spark, [(UNKNOWN, o, "") for o in OTHERS]).select("family", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"), _words(F.col("text")).alias("words"))
        plain = noise.select(F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("words"), F.lit(VARIANTS)).cast("int").alias("variant"), "words")
        # Half of a template, or only its common words, is not the licence.
        halves = templates.select(F.lit(UNKNOWN).alias("family"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("variant"), F.filter("template", lambda w, i: i % 3 == 1).alias("words"))
        rows = positive.unionByName(others).unionByName(plain).unionByName(halves)
        return cut(rows.select("family", "variant", _features(F.col("words"), self.anchor_array).alias("grams")).coalesce(1))

    def _table(self, rows: list[tuple[str, tuple, tuple]]) -> Column:
        """Templates as a constant array: family, two-word grams, telling words, size of a window."""
        grams = lambda w: sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
        return F.array(*(F.struct(F.lit(f).alias("family"), strings(grams(w)).alias("grams"), strings(tell).alias("tell"), F.lit(len(w) + SLACK).alias("size")) for f, w, tell in rows))

    @staticmethod
    def _holds(template: Column, words: Column, grams: Column) -> Column:
        """Whether words, of these two-word grams, contain a template."""
        enough = F.size(F.array_intersect(template["grams"], grams)) >= CONFIRMED * F.size(template["grams"])
        return enough & (F.size(F.array_except(template["tell"], words)) == 0)

    def _windows(self, words: Column) -> Column:
        """The windows of a paragraph's words that contain a template, for every template, as arrays of words; each once."""
        every = F.array(*map(F.lit, sorted({f"{a} {b}" for _, w, _ in self.fixed for a, b in zip(w, w[1:])})))
        grams = _grams(words, 2)

        def of(t: Column, grams: Column) -> Column:
            starts = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull())
            cuts = F.array_distinct(F.transform(starts, lambda i: F.slice(words, i, t["size"])))
            return F.filter(cuts, lambda w: self._holds(t, w, _grams(w, 2)))

        def found(seen: Column) -> Column:
            able = F.filter(self._table(self.fixed), lambda t: self._holds(t, words, seen["hits"]))
            return F.array_distinct(F.flatten(F.transform(able, lambda t: of(t, seen["grams"]))))

        once = F.transform(F.array(F.struct(grams.alias("grams"), F.array_intersect(grams, every).alias("hits"))), lambda seen: F.when(F.size(seen["hits"]) > 0, found(seen)))
        return F.coalesce(F.get(once, F.lit(0)), F.array().cast("array<array<string>>"))

    def paragraphs(self, documents: DataFrame) -> DataFrame:
        """Every line with an anchor and every window of paragraphs with an anchor: doc_id, k1 and k2 (of the row's text), paragraph (from 0), family, probability, contained (whether a template of the family is), confirmed."""
        anchored = lambda text: F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), self.leads)
        texts = _identified(documents, F.col("text").cast("string").alias("text")).filter(anchored(F.col("text")))
        key = ["doc_id", "k1", "k2", "paragraph"]
        parts = texts.select("doc_id", "k1", "k2", F.posexplode(F.split("text", BLANK_LINES)).alias("paragraph", "part")).filter(anchored(F.col("part")))
        lines = F.transform(F.filter(F.split("part", "\n"), anchored), _words)
        worded = parts.withColumn("words", _words(F.col("part")))
        units = worded.select(*key, F.explode(F.array_distinct(F.concat(lines, self._windows(F.col("words"))))).alias("words"))
        ready = units.withColumn("grams", _features(F.col("words"), self.anchor_array))
        scored = self.model.transform(self.vector.transform(ready)).withColumn("p", self._softmax(vector_to_array("rawPrediction"), F.lit(self.temperature)))
        names = F.array(*map(F.lit, self.classes))
        best = scored.select(*key, "words", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("family"), F.array_max("p").alias("probability"))
        own = best.withColumn("own", F.when(F.col("family") != UNKNOWN, _grams(F.col("words"), 2)))
        of_family = F.filter(self._table(self.fixed), lambda t: t["family"] == F.col("family"))
        checked = own.withColumn("contained", F.coalesce(F.exists(of_family, lambda t: self._holds(t, F.col("words"), F.col("own"))), F.lit(False)))
        return checked.withColumn("confirmed", (F.col("family") != UNKNOWN) & F.col("contained")).drop("words", "own")


def _identified(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id and two hashes of the text, which together tell rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), *more)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, families, n_licence, n_unknown, probability of every document."""
    found = Scanner(documents).paragraphs(documents)
    sure = F.col("confirmed")
    each = found.groupBy("doc_id", "k1", "k2", "paragraph").agg(F.collect_set(F.when(sure, F.col("family"))).alias("own"), F.max(F.when(sure, F.col("probability"))).alias("probability"))
    sums = each.groupBy(F.col("doc_id").alias("id"), F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))), ",").alias("families"),
        F.count_if(F.size("own") > 0).alias("n_licence"), F.count_if(F.size("own") == 0).alias("n_unknown"), F.round(F.max("probability"), 6).alias("probability"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    return _identified(documents).join(sums, same, "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


SQL = None
