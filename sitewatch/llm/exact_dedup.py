"""Exact duplicates by a tree merge of digest runs.

Rows are dealt to ``RUNS`` runs by their id. A run holds one row per digest: the winning
id and the number of rows. Runs are then merged in rounds, as in a binomial exchange with
radix 16: in round r a run is known by r digits of the digest and the remaining digits of
its origin, so the 16 runs that differ in digit r meet, exchange by the digest's digit and
merge. After the last round every digest lies in one run. A text that a third of all rows
share is one row per run and task from the start, so no round sees it more than 16 times
per merge target, and nothing ends in a single root.

Digests are verified: the SHA-256 is joined by the length and by an independent 64-bit
hash of the text, and rows merge only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names, packed, text_or_empty
from sitewatch.operators.checkpoints import cut

ROUNDS = 3
RUNS = 16**ROUNDS
DIGEST = ["sha", "length", "check"]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id and text with its digest, its run and the number of equal rows."""
    value = text_or_empty(text)
    return (
        own_names(docs, doc_id, text)
        .select(
            F.col(doc_id).alias("id"),
            F.unhex(F.sha2(value, 256)).alias("sha"),
            F.octet_length(value).alias("length"),
            F.xxhash64(value).alias("check"),
        )
        .groupBy("id", *DIGEST)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("run", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(RUNS)).cast("int"))
    )


def merge_runs(runs: DataFrame, keep_largest: bool = True) -> DataFrame:
    """Merge the runs of all digests; one row per digest comes out."""
    winner = F.max("keep_id") if keep_largest else F.min("keep_id")
    merged = runs.withColumnRenamed("run", "slot")
    for step in range(ROUNDS):
        place = 16**step
        digit = F.conv(F.substring(F.hex("sha"), step + 1, 1), 16, 10).cast("int")
        own = F.floor(F.col("slot") / place) % 16
        merged = (
            merged.withColumn("slot", (F.col("slot") + (digit - own) * place).cast("int"))
            .groupBy("slot", *DIGEST)
            .agg(winner.alias("keep_id"), F.sum("rows").alias("rows"))
        )
    return merged.drop("slot")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, sha`` and its copy number.

    Null text counts as empty. Of equal texts the largest id stays (or the smallest);
    of repeated rows with that id one stays. A null id loses to any other; where all ids
    of a group are null, one row stays and ``keep_id`` is null. An empty table gives an
    empty result; further columns are ignored.
    """
    winner = F.max("id") if keep_largest else F.min("id")
    ids = cut(digests(docs, doc_id, text), "digests")
    runs = ids.groupBy("run", *DIGEST).agg(winner.alias("keep_id"), F.sum("rows").alias("rows"))
    groups = merge_runs(runs, keep_largest).where("rows > 1")
    # Back down the tree: a digest has one row per run, so no key of this join is hot.
    told = (
        runs.select("run", *DIGEST)
        .join(groups.withColumnRenamed("rows", "group_size"), DIGEST)
    )
    marked = ids.join(told, ["run", *DIGEST], "left")
    alone = F.col("group_size").isNull()
    return (
        marked.select(
            F.col("id").alias(doc_id),
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", "rows").alias("group_size"),
            *DIGEST,
            F.col("rows").alias("_rows"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
        .drop("_rows")
        .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; repeated rows are left once.

    The join and the window have the same keys, so the texts are shuffled once.
    """
    kept = (
        exact_groups(docs, doc_id, text)
        .where("kept")
        .select(F.xxhash64(doc_id).alias("key"), "sha", F.col(doc_id).alias("kept_id"))
    )
    keyed = packed(docs, key=F.xxhash64(F.col(f"`{doc_id}`")), sha=F.unhex(F.sha2(text_or_empty(text), 256)))
    staying = keyed.join(kept, ["key", "sha"]).where(F.col(f"row.`{doc_id}`").eqNullSafe(F.col("kept_id")))
    copies = Window.partitionBy("key", "sha").orderBy("key")
    return staying.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("row.*")
