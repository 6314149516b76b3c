"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``virtual_nodes`` of them, and a cell
belongs to the next virtual node clockwise. A key lies in the cell of its hash. Shards
take the keys of their own cells first, cell after cell along the ring, up to their
capacity; keys that found their shard full continue clockwise to the next virtual node
whose shard has room. Capacities add up to the number of rows and differ by one at most,
so the law ``rows`` holds: counts are at most one apart.

With one more shard, capacities shrink evenly: its nodes take their arcs, and keys beyond the
smaller capacities move on; other keys stay where they are.

Spark counts the keys per cell. That table has at most ``CELLS`` rows whatever the input,
so the walk around the ring runs over it on the driver; it yields ranges of ranks, and
Spark assigns the keys by their rank in their cell. A cell holds 1/65,536 of the rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names, text_or_empty
from sitewatch.operators.checkpoints import cut

CELLS = 65_536


def virtual_nodes(spark: SparkSession, shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(cell, shard) around the ring; a cell that several nodes hit goes to the first shard.

    A node's place depends on its shard and its number there, not on how many shards there
    are: one more shard adds nodes and moves none.
    """
    shard, number = F.floor(F.col("id") / per_shard).cast("int"), F.col("id") % per_shard
    nodes = (
        spark.range(shards * per_shard)
        .select(
            F.shiftrightunsigned(F.xxhash64(shard, number, F.lit("node")), 48).cast("int").alias("cell"),
            shard.alias("shard"),
        )
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
    )
    return sorted((r["cell"], r["shard"]) for r in nodes.collect())


def walk(
    counts: dict[int, int], nodes: list[tuple[int, int]], shards: int
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first) for all keys."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    places = [cell for cell, _ in nodes]
    owners = [shard for _, shard in nodes]
    after = list(range(len(nodes)))  # a node, or a later one, that may have room

    def with_room(node: int) -> int:
        trail = []
        while True:
            if after[node] != node:
                trail.append(node)
                node = after[node]
            elif filled[owners[node]] >= room[owners[node]]:
                trail.append(node)
                after[node] = (node + 1) % len(nodes)
                node = after[node]
            else:
                break
        for passed in trail:
            after[passed] = node
        return node

    ranges, waiting = [], []
    for cell in sorted(counts):
        node = bisect_left(places, cell) % len(nodes)
        shard, count = owners[node], counts[cell]
        taken = min(count, room[shard] - filled[shard])
        if taken:
            ranges.append((cell, 0, taken, shard, filled[shard]))
            filled[shard] += taken
        if taken < count:
            waiting.append((cell, taken, count, node))
    for cell, rank, count, node in waiting:
        while rank < count:
            node = with_room(node)
            shard = owners[node]
            taken = min(count - rank, room[shard] - filled[shard])
            ranges.append((cell, rank, rank + taken, shard, filled[shard]))
            filled[shard] += taken
            rank += taken
    return ranges


def ring_shards(
    docs: DataFrame, shards: int = 16, per_shard: int = 128, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard`` per row.

    Null text has size 1 and the checksum of the empty text; a null id is hashed like any
    other value. Repeated rows are rows of their own: they are interchangeable and get
    different slots. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    value = text_or_empty(text)
    keyed = own_names(docs, doc_id, text).select(
        F.col(doc_id),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
    )
    place = F.xxhash64(doc_id, "text_crc32")
    keyed = cut(keyed.withColumn("_place", place).withColumn(
        "_cell", F.shiftrightunsigned("_place", 48).cast("int")), "ring_keys")
    counts = {r["_cell"]: r["n"] for r in keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    nodes = virtual_nodes(spark, shards, per_shard)
    places = [cell for cell, _ in nodes]
    ranges = spark.createDataFrame(
        [
            (*r, nodes[bisect_left(places, r[0]) % len(nodes)][1])
            for r in walk(counts, nodes, shards)
        ],
        "_cell int, _from long, _to long, shard int, _slot long, home_shard int",
    )
    by_cell = ranges.groupBy("_cell").agg(
        F.array_sort(F.collect_list(F.struct("_to", "_from", "shard", "_slot", "home_shard"))).alias("_ranges")
    )
    cells = Window.partitionBy("_cell").orderBy("_place", doc_id, "text_crc32", "size")
    rank = F.row_number().over(cells) - 1
    ranked = keyed.withColumn("_rank", rank.cast("long")).join(F.broadcast(by_cell), "_cell")
    own = F.filter("_ranges", lambda r: F.col("_rank") < r["_to"])[0]
    return ranked.withColumn("_own", own).select(
        doc_id,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_own.shard").alias("shard"),
        (F.col("_own._slot") + F.col("_rank") - F.col("_own._from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_own.home_shard").alias("home_shard"),
    )

