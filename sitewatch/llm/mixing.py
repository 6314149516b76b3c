"""Mixing documents to target weights of domains with soft membership.

A naive Bayes classifier over hashed tokens is trained on a table of labels and predicts
for every document how likely each domain is. A document's rate says how often it is
used. Rates are the nonnegative least-squares solution, nearest to one, for which the
expected tokens per domain, sum of rate x tokens x posterior, match the targets.

They are found by projected gradient descent in the metric of the tokens: with the Gram
matrix M = sum of tokens x p p' as scale the Lipschitz constant is one, so every step
rate = max(0, rate - p . inv(M) e) lowers the error. A rate follows from the few vectors
inv(M) e of the steps so far, so a step is one aggregate over the posteriors: only one
number per domain reaches the driver, and no state is carried from step to step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names, packed, text_or_empty
from sitewatch.operators.checkpoints import cut

DOMAINS = ("good", "poor", "toxic")
#: Shares of the tokens that each domain shall have.
TARGETS = {"good": 0.95, "poor": 0.01, "toxic": 0.04}
MOST_REPEATS = 1.0  # times that a domain may be used as a whole
BUCKETS = 65_536
MAX_LABELS = 50_000  # labelled documents that train the classifier, by the smallest hashes
SHRINKAGE = 2.0  # weight of the overall distribution against a domain's own, so rare tokens say little
MAX_STEPS = 40
TOLERANCE = 1e-6
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


@dataclass(frozen=True)
class Classifier:
    """``weights``: bucket and one log ratio per domain; ``priors``: one per domain."""

    domains: tuple[str, ...]
    weights: DataFrame
    priors: tuple[float, ...]


def label_domains(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, domain`` from quality and toxicity labels; rows with nulls are left out.

    A document with several labels counts by the worst of them.
    """
    return (
        own_names(labels, doc_id, "quality", "toxic")
        .dropna()
        .groupBy(doc_id)
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .select(doc_id, F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").otherwise("poor").alias("domain"))
    )


def token_rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per token with its bucket, and one with bucket -1 per document."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKENS), F.lit(0))
    exploded = docs.select(*keys, F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), tokens)).alias("token"))
    bucket = F.when(F.col("token").isNull(), -1).otherwise(F.pmod(F.xxhash64("token"), F.lit(BUCKETS))).cast("int")
    return exploded.select(*keys, bucket.alias("bucket"))


def train(
    docs: DataFrame,
    labelled: DataFrame,
    domains: tuple[str, ...] = DOMAINS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Classifier:
    """Naive Bayes on ``MAX_LABELS`` labelled documents; unlabelled domains get no mass."""
    sample = (
        labelled.where(F.col("domain").isin(*domains)).orderBy(F.xxhash64(doc_id), doc_id).limit(MAX_LABELS)
    )
    # At most MAX_LABELS short rows, so the texts need no shuffle.
    told = own_names(docs, doc_id, text).join(F.broadcast(sample.select(doc_id, "domain")), doc_id)
    counted = (
        token_rows(told, ["domain"], text)
        .groupBy("bucket")
        .agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    )
    counted = cut(counted, "mixing_counts")
    spark = docs.sparkSession
    sizes = [f"n{i}" for i in range(len(domains))]
    rows = counted.where("bucket = -1").select(*sizes).first()
    documents = np.array(rows if rows else [0] * len(domains), float)
    sums = counted.where("bucket >= 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes]).first()
    total = max(sum(sums), 1)
    present = documents > 0
    priors = np.where(present, np.log(np.maximum(documents, 1) / max(documents.sum(), 1)), -1e6)
    buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    overall = (sum(F.coalesce(F.col(c), F.lit(0)) for c in sizes) + 1) / (total + BUCKETS)
    ratio = [
        F.log((F.coalesce(F.col(c), F.lit(0)) / max(sums[i], 1) / overall + SHRINKAGE) / (1 + SHRINKAGE)).alias(f"w{i}")
        for i, c in enumerate(sizes)
    ]
    weights = buckets.join(counted, "bucket", "left").select("bucket", *ratio)
    if not documents.sum():
        priors = np.full(len(domains), -math.log(len(domains)))
    return Classifier(domains, cut(weights, "mixing_weights"), tuple(priors.tolist()))


def posteriors(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, rows, n_tokens, p`` with one row per id and text."""
    keyed = own_names(docs, doc_id, text).withColumn("text_key", F.xxhash64(text_or_empty(text)))
    names = [f"w{i}" for i in range(len(model.domains))]
    summed = (
        token_rows(keyed, [doc_id, "text_key"], text)
        .join(F.broadcast(model.weights), "bucket", "left")  # BUCKETS rows
        .groupBy(doc_id, "text_key")
        .agg(
            F.count(F.when(F.col("bucket") == -1, 1)).alias("rows"),
            F.count(F.when(F.col("bucket") >= 0, 1)).alias("tokens"),
            *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in names],
        )
    )
    scores = [F.col(w) / F.col("rows") + F.lit(b) for w, b in zip(names, model.priors, strict=True)]
    best = F.greatest(*scores)
    parts = [F.exp(s - best) for s in scores]
    total = sum(parts[1:], parts[0])
    return summed.select(
        doc_id,
        "text_key",
        "rows",
        (F.col("tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        F.array(*[F.round(x / total, 9) for x in parts]).alias("p"),
    )


def _rate(steps: list[list[float]], domains: int) -> Column:
    if not steps:
        return F.lit(1.0)
    vectors = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    return F.aggregate(
        vectors,
        F.lit(1.0),
        lambda rate, v: F.greatest(
            F.lit(0.0), rate - sum((F.col("p")[i] * v[i] for i in range(1, domains)), F.col("p")[0] * v[0])
        ),
    )


def fit_steps(
    told: DataFrame, domains: tuple[str, ...], targets: dict[str, float], most_repeats: float = MOST_REPEATS
) -> list[list[float]]:
    """The vectors of all steps, until expected tokens per domain meet the targets.

    The domain with the largest share is used once as a whole and sets the total. A
    domain that has too few tokens for its share is used ``most_repeats`` times.
    """
    n = len(domains)
    weight = F.col("n_tokens") * F.col("rows")
    gram = told.agg(
        *[F.coalesce(F.sum(weight * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i in range(n) for j in range(n)],
        *[F.coalesce(F.sum(weight * F.col("p")[i]), F.lit(0.0)) for i in range(n)],
    ).first()
    scale = np.array(gram[: n * n], float).reshape(n, n)
    now = np.array(gram[n * n :], float)
    share = np.array([targets.get(d, 0.0) for d in domains])
    asked = (share > 0) & (now > 0)
    if not asked.any():
        return []
    share = np.where(asked, share, 0) / share[asked].sum()
    anchor = int(np.argmax(share))
    goal = np.minimum(share * now[anchor] / share[anchor], most_repeats * now)
    inverse = np.linalg.pinv(scale)
    steps: list[list[float]] = []
    while len(steps) < MAX_STEPS:
        error = now - goal
        if np.abs(error).max() <= TOLERANCE * goal.sum():
            break
        steps.append((inverse @ error).tolist())
        used = weight * _rate(steps, n)
        now = np.array(told.agg(*[F.sum(used * F.col("p")[i]) for i in range(n)]).first(), float)
    return steps


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] = TARGETS,
    domains: tuple[str, ...] = DOMAINS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, text_key, n_tokens, p_<domain>, rate, copies`` per row.

    ``copies`` is the rate rounded down or up, by the hash of the id, so that the mean is
    the rate. Null text has no tokens and the prior as its posterior. Repeated rows get
    the same rate; null ids are hashed like any other; without labels all domains are
    equally likely and every rate is near one; an empty table gives an empty result.
    """
    model = train(docs, labelled, domains, doc_id, text)
    told = cut(posteriors(docs, model, doc_id, text), "mixing_posteriors")
    steps = fit_steps(told, domains, targets)
    chance = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 32) / float(1 << 32)
    rated = told.withColumn("rate", F.round(_rate(steps, len(domains)), 6))
    return rated.select(
        doc_id,
        "text_key",
        "n_tokens",
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        F.floor(F.col("rate") + chance).cast("long").alias("copies"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    ).drop("_row")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents as often as they are used, with all their columns."""
    used = (
        mix(docs, labelled, targets)
        .where("copies > 0")
        .select(F.xxhash64("doc_id").alias("key"), "text_key", "copies")
        .distinct()
    )
    keyed = packed(docs, key=F.xxhash64("doc_id"), text_key=F.xxhash64(text_or_empty()))
    return (
        keyed.join(used, ["key", "text_key"])
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("row.*")
    )
