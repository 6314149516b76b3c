"""Licence families of paragraphs by a sparse word n-gram logistic regression.

A paragraph is a line with a word. Features are the words and pairs of neighbouring words
that occur in licence templates. A multinomial regression with an L1 penalty is trained on
the templates, alone and inside paragraphs of the corpus, against paragraphs that hold no
licence; those form the class ``unknown``. Its probability is calibrated: the threshold of
a family is the highest probability that any paragraph without a licence gets, half way
to one. A prediction counts once a template of the family is found in the paragraph again,
that is most of the template's n-grams.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names, text_or_empty
from sitewatch.operators.checkpoints import cut

# Usual sentences by which texts name their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
}
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+"
TRAINING_PARAGRAPHS = 400  # of the corpus, by the smallest hashes
CONFIRMED = 0.8  # share of a template's n-grams that a paragraph must hold
FAMILIES = tuple(TEMPLATES)


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


VOCABULARY = tuple(sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)}))
WORDS = tuple(g for g in VOCABULARY if " " not in g)


@dataclass(frozen=True)
class Classifier:
    """``weights``: one row per n-gram; the classes are the families and then unknown."""

    weights: DataFrame
    intercepts: tuple[float, ...]
    thresholds: tuple[float, ...]


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, paragraph, words`` for lines with a word; no text is left out."""
    lines = F.split(F.lower(text_or_empty(text)), "\n")
    return (
        own_names(docs, doc_id, text)
        .select(doc_id, F.xxhash64(text_or_empty(text)).alias("text_key"), F.posexplode(lines).alias("paragraph", "line"))
        .select(doc_id, "text_key", "paragraph", F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("words"))
    )


def gram_rows(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gram`` for n-grams whose first word occurs in a template, each once.

    A paragraph is one row until here, so its n-grams are told apart without a shuffle.
    """
    pairs = F.arrays_zip(F.col("words").alias("one"), F.expr("slice(words, 2, greatest(size(words), 1))").alias("two"))
    met = F.filter(pairs, lambda p: p["one"].isin(*WORDS))
    both = F.transform(
        met,
        lambda p: F.when(p["two"].isNull(), F.array(p["one"])).otherwise(
            F.array(p["one"], F.concat_ws(" ", p["one"], p["two"]))
        ),
    )
    return paragraphs.select(*keys, F.explode(F.array_distinct(F.flatten(both))).alias("gram"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Fit on the templates and a bounded number of corpus paragraphs."""
    spark = docs.sparkSession
    lines = own_names(docs, text).select(F.explode(F.split(text_or_empty(text), "\n")).alias("line")).where("line <> ''")
    hashed = lines.withColumn("h", F.xxhash64("line"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(TRAINING_PARAGRAPHS)
    told = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("line").alias("line"))
    sample = [r["line"] for r in told.orderBy("h").collect()]
    known = {t: set(grams(t)) for texts in TEMPLATES.values() for t in texts}
    plain = [s for s in sample if not any(len(g & set(grams(s))) >= CONFIRMED * len(g) for g in known.values())]
    rows = [(grams(s), float(len(FAMILIES))) for s in (*plain, "", "the license of this work", "see the terms of use")]
    for label, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            rows.append((grams(template), float(label)))
            rows += [(grams(f"{s} {template}"), float(label)) for s in plain[:: max(1, len(plain) // 20)]]
    table = spark.createDataFrame(rows, "grams array<string>, label double")
    vectorizer = CountVectorizerModel.from_vocabulary(list(VOCABULARY), "grams", "features")
    data = vectorizer.setBinary(True).transform(table)
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60).fit(data)
    matrix = model.coefficientMatrix.toArray()
    intercepts = tuple(float(x) for x in model.interceptVector)
    weights = [
        (gram, *map(float, matrix[:, i])) for i, gram in enumerate(VOCABULARY) if any(abs(x) > 1e-9 for x in matrix[:, i])
    ]
    weighted = {w[0]: w[1:] for w in weights}

    def probability(gs: list[str]) -> list[float]:
        raw = [b + sum(weighted[g][k] for g in gs if g in weighted) for k, b in enumerate(intercepts)]
        parts = [math.exp(x - max(raw)) for x in raw]
        return [x / sum(parts) for x in parts]

    held_out = [probability(g) for g, label in rows if label == len(FAMILIES)]
    highest = [max(p[k] for p in held_out) for k in range(len(FAMILIES))]
    schema = "gram string, " + ", ".join(f"w{k} double" for k in range(len(FAMILIES) + 1))
    return Classifier(
        spark.createDataFrame(weights, schema), intercepts, tuple((1 + h) / 2 if h < 0.5 else 0.75 for h in highest)
    )


def scan(docs: DataFrame, model: Classifier | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, probability, paragraph, n_paragraphs`` per row.

    ``license`` is the family of the surest confirmed paragraph, ``unknown`` where a
    paragraph is predicted but no template confirms it, else ``none``; ``paragraph`` is
    the line's number. Null and empty texts have none. Repeated rows are rows of their
    own; null ids pass through; an empty table gives an empty result.
    """
    model = model or train(docs, doc_id, text)
    spark = docs.sparkSession
    keys = [doc_id, "text_key", "paragraph"]
    met = gram_rows(paragraphs(docs, doc_id, text), keys)
    classes = range(len(FAMILIES) + 1)
    holds = [
        (gram, number) for number, t in enumerate(t for f in FAMILIES for t in TEMPLATES[f]) for gram in grams(t)
    ]
    sizes = [len(grams(t)) for f in FAMILIES for t in TEMPLATES[f]]
    family_of = [k for k, f in enumerate(FAMILIES) for _ in TEMPLATES[f]]
    # Found n-grams per template, four counts of 16 bits in a number: a row stays short.
    # Both tables have a row per n-gram of the templates: a few hundred, fixed in the code.
    holding = (
        spark.createDataFrame(holds, "gram string, template int").groupBy("gram").agg(F.collect_set("template").alias("in"))
    )
    weights = holding.join(model.weights, "gram", "left")
    groups = [range(first, min(first + 4, len(sizes))) for first in range(0, len(sizes), 4)]
    found = [
        F.sum(sum((F.when(F.array_contains("in", n), 1 << 16 * (n - g[0])).otherwise(0) for n in g), F.lit(0).cast("long"))).alias(f"t{g[0]}")
        for g in groups
    ]

    def count_of(n: int) -> Column:
        return F.shiftright(f"t{n - n % 4}", 16 * (n % 4)).bitwiseAND(F.lit(0xFFFF))

    summed = (
        met.join(F.broadcast(weights), "gram")
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in classes], *found)
    )
    raw = [F.col(f"w{k}") + F.lit(model.intercepts[k]) for k in classes]
    top = F.greatest(*raw)
    total = sum((F.exp(x - top) for x in raw[1:]), F.exp(raw[0] - top))
    shares = [F.greatest(F.lit(0.0), *[count_of(n) / sizes[n] for n, o in enumerate(family_of) if o == k]) for k in range(len(FAMILIES))]
    verdicts = F.array(
        *[
            F.struct(
                F.round(F.exp(raw[k] - top) / total, 6).alias("probability"),
                F.lit(f).alias("family"),
                (shares[k] >= CONFIRMED).alias("confirmed"),
                F.lit(model.thresholds[k]).alias("threshold"),
            )
            for k, f in enumerate(FAMILIES)
        ]
    )
    predicted = summed.select(*keys, F.array_max(verdicts).alias("v")).where("v.probability >= v.threshold")
    best = predicted.groupBy(doc_id, "text_key").agg(
        F.max(F.struct(F.col("v.confirmed").alias("confirmed"), F.col("v.probability").alias("probability"), (-F.col("paragraph")).alias("place"), F.col("v.family").alias("family"))).alias("best"),
        F.count_distinct("paragraph").alias("n_paragraphs"),
    )
    best = cut(best, "licenses").withColumnsRenamed({doc_id: "_id", "text_key": "_text"})
    rows = own_names(docs, doc_id, text).select(doc_id, F.xxhash64(text_or_empty(text)).alias("_key"))
    same = rows[doc_id].eqNullSafe(best["_id"]) & (rows["_key"] == best["_text"])
    family = F.when(F.col("best").isNull(), "none").when(F.col("best.confirmed"), F.col("best.family")).otherwise(UNKNOWN)
    return rows.join(best, same, "left").select(
        doc_id,
        family.alias("license"),
        F.col("best.probability").alias("probability"),
        (-F.col("best.place")).alias("paragraph"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
    )
