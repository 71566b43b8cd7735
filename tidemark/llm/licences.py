"""Licence scans: a trained paragraph classifier, calibrated and confirmed by templates, in DataFrame operations.

A line with a word is judged by itself, and so are the spans of a paragraph, a run of such lines: spans of 32
and 64 words over more than one line, from the start of every line and from every 16th word, newlines and
comment prefixes left out, so that a wrapped notice of up to 48 words is found whole wherever it stands. Only
spans with one of some words or word pairs without which no template can be confirmed are looked at. A paragraph reports a
confirmed family once, with its best span, unless a confirmed line of that family stands inside the span; a
line that is not confirmed gives way to a span of its family.

Features are the different lower-cased words and word pairs that the templates use. A sparse (L1)
multinomial logistic regression over licence families and an unknown class is fitted on template sentences,
shortened ones among them, and on a bounded sample of other lines of the corpus: in hash order, a few of each
document, none that resembles a template. Its temperature is fitted on held-out examples and the least
probability is set above what held-out other lines reach. A prediction is confirmed if enough of the words
and pairs of one template of that family stand in the line or span; the least probability holds for
predictions that are not confirmed.

Only features with a weight are looked up: paragraphs are exploded to words and pairs and met with
the small weight table (``max_features`` rows at most, hence broadcast). What is shuffled is one row for each line
or span with such a feature: where it stands, its text and its features' numbers. A paragraph without any such
feature is unknown.

Defined results: null and empty texts have no paragraphs; identical rows (same id and text) are reported
once; rows that share an id but not the text are told apart by ``version``; a null id is kept; texts and
lines of any length are read whole; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cascade import let
from tidemark.llm.stage import stored

UNKNOWN = "unknown"
#: Notice sentences of the licence families.
TEMPLATES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0 into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["Released under the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "reserved": ["All rights reserved.", "Copyright by the authors. All rights reserved.", "No part of this work may be reproduced without written permission of the publisher."],
}
#: Sentences with words of licences that license nothing.
OTHERS = [
    "She was released from the hospital under the care of a doctor.", "The driver lost his license in the second version of the story.",
    "The general public was not permitted to use the library.", "You may find a copy of the file at the front desk.",
    "This work is part of a larger source of conditions.", "All the tables were reserved by noon.", "The software was free of errors and any person could run it.",
]
MAX_FEATURES, SAMPLE_PARAGRAPHS = 2000, 2000
LEAST_PROBABILITY, CONFIRMED = 0.5, 0.6
#: A sample line resembles a template if it has this share of the template, or this share of it stands in the template.
LIKE_TEMPLATE, INSIDE_TEMPLATE, LINES_A_DOCUMENT = 0.4, 0.6, 4
#: Words of the shorter and of the longer spans, and between the starts of spans inside a line.
SPANS, SPAN_STEP = (32, 64), 16
#: Words found in any text: alone they never make a span worth a look, in pairs only where nothing else is left.
EVERYDAY = "a all an and any are be by can except for found free from has have he in into is it later law may met mit no not of or part she that the this to under use was with work you".split()
#: Less frequent words of any text, taken after the rarer ones.
PLAIN = """4 author authors charge code deal domain either extent file files following form forms general governed included international person possible
program provided public published source style subject terms version without written""".split()
WORD = r"[\p{L}\p{N}]"
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]


def paragraph_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def features(line: Column) -> Column:
    """The different words and pairs of neighbouring words of a line."""
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))
    return let(paragraph_words(line), lambda w: F.array_distinct(F.concat(w, pairs(w))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), paragraph (line number from 0), line."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("paragraph", "line"))
    return listed.where(F.col("line").rlike(WORD))


def needed_grams(confirmed: float) -> tuple[list[str], list[tuple[str, str]]]:
    """Words and word pairs of which a text must hold one, or no template has the share ``confirmed`` of its grams in it.

    Rare words come first, then pairs of everyday words, so that few texts pass. Everyday words alone are not
    needed below a share of 0.6: they are about half of a template's grams.
    """
    lists = [re.findall(r"[a-z0-9]+", x.lower()) for lines in TEMPLATES.values() for x in lines]
    grams = [{*((w,) for w in x), *zip(x, x[1:])} for x in lists]
    words, pairs = set(), set()
    while True:
        left = [(g, [x for x in g if x not in pairs and not words & {*x}]) for g in grams]
        left = [x for g, rest in left if len(rest) >= confirmed * len(g) for x in rest]
        if not left:
            return sorted(words), sorted(pairs)
        found = {w for x in left for w in x if w not in EVERYDAY and len(w) > 2}
        if found:
            words.add(min(found, key=lambda w: (w in PLAIN, -sum(w in x for x in left), w)))
        elif two := {x for x in left if len(x) == 2}:
            # the rarer-looking pair: its shorter word is longest
            pairs.add(min(two, key=lambda x: (-min(map(len, x)), -left.count(x), x)))
        else:
            words.add(min(w for x in left for w in x))


def gate_pattern(words: list[str], pairs: list[tuple[str, str]]) -> str:
    """A pattern for the lower-cased text of a paragraph that holds one of these; grouped by first letter."""
    between = r"[^\p{L}\p{N}]+(?:(?:rem|dnl)[^\p{L}\p{N}]+)?"
    given: dict[str, list[str]] = {}
    for first, rest in [*((w[0], w[1:]) for w in words), *((a[0], a[1:] + between + b) for a, b in pairs)]:
        given.setdefault(first, []).append(rest)
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(x)})" for c, x in sorted(given.items())) + r")(?![\p{L}\p{N}])"


def spans(docs: DataFrame, confirmed: float) -> DataFrame:
    """doc_id, version, block (first line of the paragraph), paragraph and last (lines), start (word), words of every span to be judged."""
    needed, needed_pairs = needed_grams(confirmed)
    gate = gate_pattern(needed, needed_pairs)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike(WORD), F.concat(i.cast("string"), F.lit("\x01"), x)).otherwise(""))
    # the line number before each line would part a pair at a line's end, so paragraphs are told by it later only
    blocks = docs.where(F.contains("text", F.lit("\n")) & F.lower("text").rlike(gate)).select(
        "doc_id", F.xxhash64("text").alias("version"), F.explode(F.split(F.btrim(F.array_join(lines, "\n"), F.lit("\n")), r"\n{2,}")).alias("block")
    ).where(F.contains("block", F.lit("\n")) & F.lower(F.regexp_replace("block", r"(?m)^\d+\x01", "")).rlike(gate))
    # comment marks are no words; those that are letters are cut off
    own = lambda x: paragraph_words(F.regexp_replace(x, r"(?i)^\s*(rem|dnl)\s", ""))
    placed = F.flatten(F.transform(F.split("block", "\n"), lambda x: let(
        F.split(x, "\x01", 2), lambda part: F.transform(own(F.get(part, F.lit(1))), lambda w: F.struct(F.get(part, F.lit(0)).cast("int").alias("at"), w.alias("word")))
    )))
    names, two = F.array(*map(F.lit, needed)), F.array(*[F.lit(" ".join(x)) for x in needed_pairs])
    hit = lambda w: F.filter(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.array_contains(names, F.get(w, i)["word"]) | F.coalesce(F.array_contains(two, F.concat(F.get(w, i)["word"], F.lit(" "), F.get(w, i + 1)["word"])), F.lit(False)),
    )
    short, long = SPANS

    def starts(w: Column, hits: Column) -> Column:
        edge = lambda i: (i % SPAN_STEP == 0) | (F.get(w, i)["at"] != F.get(w, i - 1)["at"])
        near = lambda i, size: F.exists(hits, lambda h: (h >= i) & (h < i + size))
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: edge(i) & near(i, long))
        return F.flatten(F.transform(at, lambda i: F.array(
            F.when(near(i, short), F.struct(i.alias("start"), F.slice(w, i + 1, F.lit(short)).alias("w"))),
            F.when(i + short < F.size(w), F.struct(i.alias("start"), F.slice(w, i + 1, F.lit(long)).alias("w"))),
        )))

    cut = let(placed, lambda w: F.when(F.size(w) > 0, let(hit(w), lambda h: F.when(F.size(h) > 0, starts(w, h)))))
    listed = blocks.select("doc_id", "version", F.split_part("block", F.lit("\x01"), F.lit(1)).cast("int").alias("block"), F.explode(cut).alias("x"))
    told = listed.where("x is not null").select(
        "doc_id", "version", "block", F.get("x.w", F.lit(0))["at"].alias("paragraph"), F.element_at("x.w", -1)["at"].alias("last"),
        F.col("x.start").cast("int").alias("start"), F.col("x.w")["word"].alias("words"),
    )
    return told.where(F.col("paragraph") < F.col("last"))


def template_table(spark: SparkSession) -> DataFrame:
    """template, family, line and features of every template."""
    rows = [(f"{family}/{i}", family, line) for family, lines in TEMPLATES.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "template string, family string, line string").withColumn("grams", features(F.col("line")))


def examples(spark: SparkSession, docs: DataFrame, sample: int) -> DataFrame:
    """family, grams, held: templates, templates without their first or last words, and other paragraphs."""
    given = template_table(spark)
    short = given.select("family", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cut"), let(F.split("line", " "), lambda w: F.slice(w, F.col("cut") + 1, F.size(w))).alias("w"))
    lines = given.select("family", "line", F.lit(False).alias("held")).unionByName(
        short.where("cut > 0").select("family", F.array_join("w", " ").alias("line"), (F.col("cut") == 2).alias("held"))
    ).unionByName(
        given.select("family", F.concat(F.lit("Copyright 2020 the authors. "), "line").alias("line"), F.lit(True).alias("held"))
    ).unionByName(spark.createDataFrame([(UNKNOWN, x, False) for x in OTHERS], "family string, line string, held boolean"))
    picked = sample_lines(docs, sample).select("line", features(F.col("line")).alias("grams"))
    # lines like a template, or like a part of one, are no examples of the unknown class
    both = F.size(F.array_intersect("grams", "of"))
    like = (both >= LIKE_TEMPLATE * F.size("of")) | ((F.size("grams") >= 5) & (both >= INSIDE_TEMPLATE * F.size("grams")))
    met = picked.crossJoin(F.broadcast(given.select(F.col("grams").alias("of")))).groupBy("line", "grams").agg(F.max(like).alias("like"))
    other = met.where("not like").select(F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("line"), F.lit(2)) == 0).alias("held"), "grams")
    return lines.select("family", "held", features(F.col("line")).alias("grams")).unionByName(other)


def sample_lines(docs: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` different lines with a word in hash order, at most LINES_A_DOCUMENT of a document."""
    chance = min(1.0, 4 * sample / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**30)) < F.lit(int(chance * 2**30)))
    ordered = F.array_sort(F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.xxhash64("doc_id", x).alias("hash"), x.alias("line"))))
    few = drawn.select(F.explode(F.slice(ordered, 1, LINES_A_DOCUMENT)).alias("x"))
    return few.groupBy("x.line").agg(F.min("x.hash").alias("hash")).orderBy("hash", "line").limit(sample).select("line")


class Classifier:
    """Weights by feature and class, the intercepts, the temperature and the least probability.

    ``numbers`` is the table (feature, number) of the features with a weight, ``weights`` their rows by number.
    """

    def __init__(self, numbers: DataFrame, weights: list[list[float]], classes: list[str], intercepts: list[float], temperature: float, least: float):
        self.numbers, self.weights, self.classes, self.intercepts, self.temperature, self.least = numbers, weights, classes, intercepts, temperature, least

    def scores(self, numbers: Column) -> Column:
        """The classes' scores of a set of feature numbers."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<array<double>>")
        start = F.array(*map(F.lit, self.intercepts))
        return F.aggregate(numbers, start, lambda sums, j: F.zip_with(sums, F.get(table, j), lambda x, y: x + y))


def probabilities(scores: Column, temperature: float) -> Column:
    """Softmax of an array of scores."""
    top = F.array_max(scores)
    return let(
        F.transform(scores, lambda x: F.exp((x - top) / temperature)),
        lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)),
    )


def fit(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS, max_features: int = MAX_FEATURES) -> Classifier:
    """A classifier from the templates and at most ``sample`` paragraphs of ``docs``."""
    spark = docs.sparkSession
    rows = stored(examples(spark, docs, sample).repartition(1), "licence-examples")
    classes = [*sorted(TEMPLATES), UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    vocabulary = [r[0] for r in template_table(spark).select(F.explode("grams").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(max_features).collect()]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x")
    table = counter.setBinary(True).transform(rows).withColumn("y", number.cast("double"))
    # every class weighs the same
    sizes = table.where("not held").groupBy("y").agg((F.lit(100.0) / F.count("*")).alias("weight"))
    train = table.where("not held").join(F.broadcast(sizes), "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=0.002, elasticNetParam=1.0, maxIter=80).fit(train)
    matrix = model.coefficientMatrix.toArray()
    used = [(g, [float(x) for x in matrix[:, j]]) for j, g in enumerate(vocabulary) if abs(matrix[:, j]).max() > 1e-6]
    numbers = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(used)], "feature string, number int")
    held = model.transform(table.where("held")).select("y", vector_to_array("rawPrediction").alias("raw"))
    tried = held.select("y", "raw", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t"))
    loss = tried.withColumn("p", F.get(probabilities(F.col("raw"), F.col("t")), F.col("y").cast("int")))
    best = loss.groupBy("t").agg(F.avg(-F.log(F.greatest("p", F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
    temperature = float(best["t"]) if best else 1.0
    family_chance = F.array_max(F.slice(probabilities(F.col("raw"), F.lit(temperature)), 1, len(classes) - 1))
    reached = held.where(F.col("y") == len(classes) - 1).agg(F.percentile(family_chance, F.lit(0.999))).first()[0]
    return Classifier(numbers, [w for _, w in used], classes, [float(x) for x in model.interceptVector], temperature, max(LEAST_PROBABILITY, float(reached or 0.0)))


def scan(docs: DataFrame, classifier: Classifier | None = None, confirmed: float = CONFIRMED) -> DataFrame:
    """One row for each line, and each paragraph with a wrapped notice, that is predicted to be of a family.

    doc_id, version, paragraph (number of the line or of the span's first), line (of a span its words), family,
    probability, template (the best of the family), similarity (share of its words and pairs that stand in the line
    or span), confirmed.
    """
    c = classifier or fit(docs)
    key = ["doc_id", "version", "block", "paragraph", "last", "start", "size"]
    single = paragraphs(docs).select(
        "doc_id", "version", F.lit(-1).alias("block"), "paragraph", F.col("paragraph").alias("last"), F.lit(0).alias("start"), F.lit(0).alias("size"), "line"
    )
    wrapped = spans(docs, confirmed).withColumn("line", F.array_join("words", " ")).withColumn("size", F.size("words"))
    units = single.unionByName(wrapped.select(*single.columns))
    # identical rows meet in one unit here, so a set of feature numbers stands for all of them; only units with a
    # weighted feature take their text along, once each
    matched = units.select(*key, "line", F.explode(features(F.col("line"))).alias("feature")).join(F.broadcast(c.numbers), "feature")
    seen = matched.groupBy(*key).agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.first("line").alias("line"))
    n = len(c.classes)
    judged = seen.select(*key, "line", probabilities(c.scores(F.col("numbers")), F.lit(c.temperature)).alias("p"))
    top = let(F.slice("p", 1, n - 1), lambda p: F.struct(F.array_max(p).alias("probability"), F.array_position(p, F.array_max(p)).alias("at")))
    names = F.array(*map(F.lit, c.classes))
    predicted = judged.select(*key, "line", "p", top.alias("top")).where(F.col("top.probability") > F.get("p", F.lit(n - 1)))
    found = predicted.select(
        *key, "line", F.get(names, (F.col("top.at") - 1).cast("int")).alias("family"), F.col("top.probability").alias("probability"), features(F.col("line")).alias("own")
    )
    key.append("line")
    given = F.broadcast(template_table(docs.sparkSession).select("template", F.col("family").alias("of"), "grams"))
    share = F.size(F.array_intersect("grams", "own")) / F.size("grams")
    best = found.join(given, F.col("family") == F.col("of")).groupBy(*key, "family", "probability").agg(F.max(F.struct(share.alias("similarity"), "template")).alias("best"))
    told = best.select(*key, "family", "probability", "best.template", "best.similarity", (F.col("best.similarity") >= confirmed).alias("confirmed"))
    return settled(stored(told.where(F.col("confirmed") | ((F.col("block") < 0) & (F.col("probability") >= c.least))), "licence-units"))


def settled(units: DataFrame) -> DataFrame:
    """Lines, and the best span of each paragraph and family, less those that say the same again."""
    own = ["doc_id", "version", "family"]

    def without(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        other = right.select(*[F.col(x).alias(f"_{x}") for x in names]).distinct()
        on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names]
        return left.join(other, on, "left_anti")

    lines, wide = units.where("block < 0"), units.where("block >= 0")
    each_line = lambda df: df.select("*", F.explode(F.sequence("paragraph", "last")).alias("at"))
    sure = lines.where("confirmed").select(*own, F.col("paragraph").alias("_at"), *[F.col(x).alias(f"_{x}") for x in own]).distinct().drop(*own)
    told = each_line(wide).join(sure, [*[F.col(x).eqNullSafe(F.col(f"_{x}")) for x in own], F.col("at") == F.col("_at")], "left_semi")
    alone = without(wide, told, [*own, "block", "paragraph", "last", "line"])
    rest = [x for x in units.columns if x not in (*own, "block")]
    first = ["similarity", F.negative(F.size(F.split("line", " "))).alias("short"), *[x for x in rest if x != "similarity"]]
    best = alone.groupBy(*own, "block").agg(F.max(F.struct(*first)).alias("x")).select(*own, *[F.col("x")[x].alias(x) for x in rest])
    open_lines = without(lines.where("not confirmed").withColumn("at", F.col("paragraph")), each_line(best), [*own, "at"])
    names = ["doc_id", "version", "paragraph", "line", "family", "probability", "template", "similarity", "confirmed"]
    return lines.where("confirmed").select(names).unionByName(open_lines.select(names)).unionByName(best.select(names))
