"""Connected components, and the links among nodes that share a signature."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.operators.checkpoints import cut
from sitewatch.operators.skew import split_hot_join

#: Pairs a member that are compared at last without further rounds; sizes and marks rule most out.
PAIRS = 1_000
#: Rounds end when one finds less than this part of what the one before found.
SHRINKING = 4
#: Members of one signature that a task compares with others.
ROWS_PER_SPLIT = 1_000
#: Signatures before one, in the order of a node's, by which a pair that has met already is known.
EARLIER = 3


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on its smallest neighbour."""
    if small:
        sided = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = sided.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    hung = sided.join(least, "u")
    if small:
        hung = hung.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        hung = hung.where("v > u").select(F.col("v").alias("x"), "m")
    return hung.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the least node names it.

    Rounds go on until the edges no longer change, that is until every component is one
    star. Aggregates combine before the shuffle, so a node may hold any share of the edges.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    while True:
        before = _print(now)
        now = cut(_star(_star(now, small=False), small=True), name)
        if _print(now) == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _print(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes: equal only for equal edge sets."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
            F.sum(F.hash("a", "b").cast("long")),
        ).first()
    )


def link_groups(
    members: DataFrame,
    linked: Callable[[DataFrame], DataFrame],
    traits: DataFrame,
    near: Callable[[str, str], Column],
) -> DataFrame:
    """Links ``a, b`` with the components of all pairs that share a signature and are linked.

    ``members`` has ``signature, node, slack``; two nodes are a pair of a signature if
    their slacks add up to zero or less. ``traits`` has ``node`` and a few numbers of each
    node, and ``near(one, other)`` a condition on two columns of such numbers that every
    linked pair fulfils. It is tested where members meet, so only pairs that fulfil it are
    ever written. ``linked`` returns the pairs ``a, b`` that are links.

    Signatures with the same nodes are one. In every round each open signature has another
    member as its head, and all members of other components are compared with it. Rounds go
    on while more than ``PAIRS`` pairs a member are left and a round finds a good part of
    what the one before found; then all pairs of one signature that are still in different
    components are compared. At the end every pair of one signature has been asked, ruled
    out, or lies in one component.
    """
    links = cut(linked(_first_pairs(members)), "links")
    named = [c for c in traits.columns if c != "node"]
    trait = traits.select("node", F.struct(*named).alias("trait"))
    open_ones = _without_equal_groups(_labelled(members, links))
    found, round_no = None, 0
    while True:
        open_ones = cut(open_ones, "group_open")
        if round_no and _few_left(open_ones):
            break
        fresh = cut(linked(_head_pairs(open_ones.join(trait, "node"), near, round_no)), "links_of_round")
        before, found = found, fresh.count()
        if found:
            links = cut(links.unionByName(fresh), "links")
            open_ones = _labelled(open_ones.drop("component"), links)
        if not found or (before is not None and found * SHRINKING < before):
            break
        round_no += 1
    return cut(links.unionByName(linked(_remaining_pairs(open_ones, trait, near))), "links")


def _without_equal_groups(open_ones: DataFrame) -> DataFrame:
    """One signature for all that have the same nodes, each node with its least slack.

    Copies share most of their signatures, so most of these stand for the same nodes. Two
    groups whose names fall together by chance would be united, which loses no pair.
    """
    own = Window.partitionBy("signature")
    name = F.xxhash64(
        F.count(F.lit(1)).over(own),
        F.min("node").over(own),
        F.max("node").over(own),
        F.sum(F.hash("node").cast("long")).over(own),
    )
    return (
        open_ones.withColumn("signature", name)
        .groupBy("signature", "node", "component")
        .agg(F.min("slack").alias("slack"))
    )


def _few_left(open_ones: DataFrame) -> bool:
    """Whether the pairs that are left to compare are at most ``PAIRS`` a member."""
    sizes = open_ones.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("n"))
    held = sizes.groupBy("signature").agg(F.sum("n").alias("all"), F.max("n").alias("largest"))
    left = (F.col("all") - F.col("largest")).cast("double") * F.col("all")
    row = held.agg(F.sum(left).alias("pairs"), F.sum("all").alias("members")).first()
    return (row["pairs"] or 0) <= PAIRS * (row["members"] or 0)


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of signatures that several components share, with their component."""
    known = components(links, "group_components")
    named = members.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    within = Window.partitionBy("signature")
    named = named.withColumns({"_x": F.min("component").over(within), "_y": F.max("component").over(within)})
    return named.where("_x <> _y").drop("_x", "_y")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every node with the least node of its smallest, and of its largest, signature."""
    ends = members.groupBy("node").agg(F.min("signature").alias("x"), F.max("signature").alias("y"))
    ends = cut(ends.select("node", F.explode(F.array_distinct(F.array("x", "y"))).alias("signature")), "group_ends")
    heads = ends.groupBy("signature").agg(F.min("node").alias("head"), F.max("node").alias("most")).where("head <> most")
    return _pairs(ends.join(heads.select("signature", "head"), "signature").where("node <> head").select("head", "node"))


def _head_pairs(open_ones: DataFrame, near: Callable[[str, str], Column], round_no: int) -> DataFrame:
    """Per signature, all members of other components against one member drawn by a hash."""
    drawn = F.struct(F.xxhash64("node", F.lit(round_no)).alias("draw"), "node", "component", "slack", "trait")
    met = open_ones.withColumn("head", F.min(drawn).over(Window.partitionBy("signature")))
    met = met.where((F.col("component") != F.col("head.component")) & (F.col("slack") + F.col("head.slack") <= 0))
    return _pairs(met.where(near("trait", "head.trait")).select(F.col("head.node").alias("head"), "node"))


def _pairs(df: DataFrame) -> DataFrame:
    one, two = df.columns
    return df.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _remaining_pairs(open_ones: DataFrame, trait: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Per signature, nodes outside its largest component against all nodes not in theirs.

    Large signatures are split on both sides of the join, and conditions are part of it.
    Every node also tells the ``EARLIER`` signatures before this one in the order of its
    own: two nodes that share one of these, with slacks that let them, are a pair there
    already. The first signature by which a pair may be linked has none before it that
    they share in that way, so every pair is met once at least, and seldom more often.
    """
    sizes = open_ones.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = (
        sizes.groupBy("signature")
        .agg(F.max(F.struct("n", "component")).alias("top"))
        .select("signature", F.col("top.component").alias("largest"))
    )
    in_order = Window.partitionBy("node").orderBy("signature")
    earlier = [F.lag(F.struct("signature", "slack"), back).over(in_order) for back in range(1, EARLIER + 1)]
    told = open_ones.withColumns({f"e{i}": e for i, e in enumerate(earlier)}).join(trait, "node")
    told = told.withColumn("earlier", F.struct(*[f"e{i}" for i in range(EARLIER)])).join(largest, "signature")
    told = cut(told.select("signature", "node", "component", "slack", "trait", "earlier", "largest"), "group_told")
    other = told.drop("largest")
    minor = told.where("component <> largest").select(
        "signature",
        F.col("node").alias("m"),
        F.col("component").alias("c"),
        F.col("slack").alias("s"),
        F.col("trait").alias("t"),
        F.col("earlier").alias("e"),
    )
    met = split_hot_join(minor, other, ["signature"], "node", ROWS_PER_SPLIT, probe_id="m")
    met = met.where("c <> component and s + slack <= 0").where(~_met_before("e", "earlier"))
    return _pairs(met.where(near("t", "trait")).select("m", "node"))


def _met_before(one: str, other: str) -> Column:
    """Whether two nodes share one of the signatures told, with slacks that let them be linked."""
    told = [(f"{one}.e{i}", f"{other}.e{j}") for i in range(EARLIER) for j in range(EARLIER)]
    shared = [
        (F.col(f"{a}.signature") == F.col(f"{b}.signature")) & (F.col(f"{a}.slack") + F.col(f"{b}.slack") <= 0)
        for a, b in told
    ]
    return F.coalesce(reduce(or_, shared), F.lit(False))
