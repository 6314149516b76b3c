"""Jaccard self-join of word shingles by parity sketches.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Its parity sketch is
a long bit string: every shingle flips one bit, so the Hamming distance of two sketches is
at most the symmetric difference of the sets. Sets of sizes x <= y with Jaccard >= 0.75
differ by at most (x + y) / 7 shingles, and y is at most 4x / 3, so the sketches of a
linked pair differ in at most D = x / 3 places (rounded down), seen from either side.

The sketch is split into blocks. D differing bits spoil at most D blocks, hence of the
first D + 1 blocks that are not zero one at least is equal in both sketches (pigeonhole;
zero blocks are skipped, as they say nothing). A document therefore emits one signature
per block for its first D + 1 non-zero blocks, and linked documents share a signature.
Sizes are dealt to bands with a number of blocks each; a document that may have partners
in the next band emits the signatures of that band too. Shingles that very many documents
hold come last in the order, so they are hardly ever among the first D + 1. That steers
the cost, never the result.

Pairs with a common signature must pass a second, short parity sketch, whose Hamming
distance may not exceed the bound, and then an exact comparison of the sets.

Documents with equal sets are one node. Within the nodes of a signature, links are found
without comparing all pairs. First a node is compared with the least node of its smallest
and of its largest signature, which already joins most groups. Then, while signatures
hold several components, members are compared with heads in rounds; see
``components.link_groups``. Pairs that are in different components after that are
compared in full, wherever sizes and a folded sketch of ``MARK_BITS`` bits, which are tested
inside the join, do not rule a link out. Nothing is dropped: a pair is skipped only where
its nodes are connected already or cannot be linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import chunks, map_arrow, own_names, packed
from sitewatch.llm.components import components, link_groups
from sitewatch.operators.checkpoints import cut

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # Jaccard of 0.75
REMEMBERED = 100_000
#: At most so many common shingles are put last; more would cost memory, fewer only time.
COMMON = 1 << 18
COMMON_SHARE = 2_000  # a task names shingles in more than 1 of so many of its documents
SPLITS = 64  # parts in which the documents of a common signature are looked at first
BAND_STEP, BLOCKS_PER_SHINGLE, FIRST_BAND = 4, 16, 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0x94D049BB133111EB)
_NOTHING = np.zeros(0, np.uint64)
FIELDS = ["kind", "id", "key", "name", "n", "sketch", "mark"]
MARK_BITS = 512  # parities that are compared inside joins
FRESH = 500_000  # shingles that a task counts at a time
FILTER_BITS = 1 << 24  # of the bitmap of wanted ids; more ids only let more texts pass


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _LAST
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Shingle sets of texts; remembers word hashes within a worker."""

    def __init__(self) -> None:
        self.word = Hashes()

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of all texts one after another, each in order, and where each begins."""
        if len(self.word) > REMEMBERED:
            self.word.clear()
        split = [(t or "").encode().lower().split() for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter(map(self.word.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
        width = max(len(flat) - WORDS + 1, 0)
        rolled = np.zeros(width, np.uint64)
        for step in range(WORDS):
            rolled = rolled * _ODD + flat[step : step + width]
        rolled = mixed(rolled)
        parts, start = [], 0
        for n in counts.tolist():
            if n >= WORDS:
                own = np.sort(rolled[start : start + n - WORDS + 1])
                parts.append(own[np.append(True, own[1:] != own[:-1])])
            elif n:
                value = np.uint64(n)
                for word in flat[start : start + n]:
                    value = mixed(np.array([value]) * _ODD + word)[0]
                parts.append(np.array([value], np.uint64))
            else:
                parts.append(_NOTHING)
            start += n
        return np.concatenate([_NOTHING, *parts]), np.cumsum([0, *map(len, parts)])


def set_names(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One 64-bit name per set; equal sets have equal names."""
    total = np.append(np.uint64(0), np.cumsum(mixed(value * _ODD)))
    sums = total[start[1:]] - total[start[:-1]]
    return mixed(sums + np.diff(start).astype(np.uint64) * _ODD).view(np.int64)


def bands(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Which sets take part in a band, the band's number and its blocks as a power of two."""
    low, high, band = 0, FIRST_BAND, 0
    while low < sizes.max(initial=0):
        # Partners are up to 4/3 as large, so the upper quarter of a band below takes part.
        own = (sizes > low * NUMERATOR // DENOMINATOR) & (sizes <= high)
        # Among few shingles two could share a block, so the lowest band has very many.
        yield own, band, 32 if band == 0 else int(BLOCKS_PER_SHINGLE * high).bit_length() - 1
        low, high, band = high, high * BAND_STEP, band + 1


def signatures(
    value: np.ndarray, start: np.ndarray, common: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, whether its block is of common shingles, slack) for all sets.

    Before the first signature that two sets share, count the blocks with a single shingle,
    p of one set and q of the other. Each stands for a difference of its own: either its
    shingle is missing in the other set, or the other set holds more in that block, which
    then does not count there, and one of these is missing here. So p + q may not exceed
    (x + y) / 7. With the slack 7p - x of a signature, two sets can be linked by their
    first common signature only if their slacks add up to zero or less.

    The sketch has 2^64 bits and is kept as the places of its ones, which are the hashes
    themselves; a block is a range of places.
    """
    sizes = np.diff(start)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    frequent = np.zeros(len(value), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        frequent = common[at] == value
        if frequent.any():
            order = np.argsort(owner * 2 + frequent, kind="stable")
            value, frequent = value[order], frequent[order]
    out = []
    for own, band, power in bands(sizes):
        mine = own[owner]
        v, o, f = value[mine], owner[mine], frequent[mine]
        if not len(v):
            continue
        block = v >> np.uint64(64 - power)
        head = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (o[1:] != o[:-1]) | (f[1:] != f[:-1])))
        single = np.diff(np.append(head, len(v))) == 1
        content = np.add.reduceat(mixed(v + _ODD), head)
        o, f, block = o[head], f[head], block[head]
        per_set = np.bincount(o, minlength=len(sizes))
        place = np.arange(len(o)) - (np.cumsum(per_set) - per_set)[o]
        needed = place <= sizes[o] // 3
        passed = np.cumsum(single) - single
        passed -= passed[np.append(0, np.cumsum(per_set)[:-1])[o]]
        name = mixed(content[needed] + mixed(block[needed] * np.uint64(64) + np.uint64(band * 2) + f[needed]))
        slack = 7 * passed[needed] - sizes[o[needed]]
        out.append((name.view(np.int64), o[needed], f[needed], slack.astype(np.int32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def short_sketches(value: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Parity sketches of two to four bits per shingle, a power of two and 64 at least."""
    sizes = np.diff(start)
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    place = (value & np.repeat((bits - 1).astype(np.uint64), sizes)).astype(np.int64)
    flips = np.bincount(place + np.repeat(ends - bits, sizes), minlength=int(ends[-1]) if len(ends) else 0)
    packed = np.packbits((flips & 1).astype(np.uint8)).tobytes()
    return [packed[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def marks(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Parity sketches of ``MARK_BITS`` bits, one row of 64-bit integers per set."""
    sizes = np.diff(start)
    out = np.zeros((len(sizes), MARK_BITS // 64), np.int64)
    for first in range(0, len(sizes), 4096):
        some = sizes[first : first + 4096]
        own = value[start[first] : start[first + len(some)]]
        place = (own & np.uint64(MARK_BITS - 1)).astype(np.int64) + np.repeat(np.arange(len(some)) * MARK_BITS, some)
        flips = np.bincount(place, minlength=len(some) * MARK_BITS) & 1
        out[first : first + len(some)] = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(len(some), -1)
    return out


def may_be_linked(one: str, other: str) -> Column:
    """Sizes and marks of two nodes do not rule a link out; true for every linked pair."""
    a, b = F.col(f"{one}.n"), F.col(f"{other}.n")
    differing = F.lit(0)
    for word in range(MARK_BITS // 64):
        differing = differing + F.bit_count(F.col(f"{one}.w{word}").bitwiseXOR(F.col(f"{other}.w{word}")))
    return (F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR) & (7 * differing <= a + b)


def hamming(one: bytes, two: bytes) -> int:
    """Distance of two sketches; the longer is folded, which keeps its parities."""
    if len(one) > len(two):
        one, two = two, one
    folded = np.bitwise_xor.reduce(np.frombuffer(two, np.uint8).reshape(-1, len(one)), axis=0)
    return int(np.bitwise_count(np.frombuffer(one, np.uint8) ^ folded).sum())


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, key, text``; the key also tells rows without an id apart, by their texts."""
    return own_names(docs, doc_id, text).select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text")
    )


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written table: per row its set's name and size, and counts of frequent shingles.

    ``kind`` 0: ``id`` is the document, ``name`` its set, with a short sketch. ``kind`` 1: ``name`` is a shingle
    that ``n`` sets of one task hold; kept where that is a fair share of the task's sets.
    """
    source = _keyed(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), np.zeros(0, np.int64)
        held, count, sets = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        fresh: list[np.ndarray] = []

        def counted(held: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([_NOTHING, *fresh]), return_counts=True)
            fresh.clear()
            at = np.searchsorted(held, new)
            known = np.zeros(len(new), bool)
            known[at < len(held)] = held[at[at < len(held)]] == new[at < len(held)]
            count[at[known]] += times[known]
            joined = np.concatenate([held, new[~known]])
            order = np.argsort(joined, kind="stable")
            return joined[order], np.concatenate([count, times[~known]])[order]

        for batch in batches:
            for part in chunks(batch):
                value, start = shingler.sets(part.column("text").to_pylist())
                sizes, names = np.diff(start), set_names(value, start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(names), np.int8)),
                        part.column("id"),
                        part.column("key"),
                        pa.array(names),
                        pa.array(sizes),
                        pa.array(short_sketches(value, start), pa.binary()),
                        pa.array(list(marks(value, start)), pa.list_(pa.int64())),
                    ],
                    FIELDS,
                )
                _, once = np.unique(names, return_index=True)
                once = once[~np.isin(names[once], seen)]
                seen = np.union1d(seen, names[once])
                sets += len(once)
                fresh.append(value[np.isin(np.repeat(np.arange(len(names)), sizes), once)])
                if sum(map(len, fresh)) > FRESH:
                    held, count = counted(held, count)
                    if len(held) > 4 * FRESH:
                        often = count > 1
                        held, count = held[often], count[often]
        held, count = counted(held, count)
        often = count >= max(3, sets // COMMON_SHARE)
        held, count = held[often], count[often]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(len(held), np.int8)),
                pa.nulls(len(held), pa.int64()),
                pa.nulls(len(held), pa.int64()),
                pa.array(held.view(np.int64)),
                pa.array(count),
                pa.nulls(len(held), pa.binary()),
                pa.nulls(len(held), pa.list_(pa.int64())),
            ],
            FIELDS,
        )

    return cut(map_arrow(source, run, "kind byte, id long, key long, name long, n long, sketch binary, mark array<long>"), "shingle_sets")


def common_shingles(told: DataFrame) -> np.ndarray:
    """The most frequent shingles, ``COMMON`` at most; they only steer the order of blocks."""
    rows = (
        told.where("kind = 1")
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
        .where("n >= 20")
        .orderBy(F.desc("n"), "name")
        .limit(COMMON)
        .select("name")
        .toPandas()
    )
    return np.sort(rows["name"].to_numpy(np.int64).view(np.uint64))


def shared_signatures(docs: DataFrame, common: np.ndarray, text: str) -> DataFrame:
    """``signature, node, slack`` of signatures by which several nodes may be linked."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    source = own_names(docs, text).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                value, start = shingler.sets(part.column("text").to_pylist())
                names = set_names(value, start)
                _, once = np.unique(names, return_index=True)
                once = np.sort(once[~np.isin(names[once], seen)])  # copies in this task emit once
                seen = np.union1d(seen, names[once])
                sizes = np.diff(start)
                mine = np.isin(np.repeat(np.arange(len(names)), sizes), once)
                told, owner, frequent, slack = signatures(value[mine], np.append(0, np.cumsum(sizes[once])), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(told), pa.array(names[once][owner]), pa.array(frequent), pa.array(slack)],
                    ["signature", "node", "frequent", "slack"],
                )

    split = F.when(F.col("frequent"), F.pmod("node", F.lit(SPLITS))).otherwise(0).cast("int")
    group = Window.partitionBy("signature", "_split")
    told = (
        map_arrow(source, run, "signature long, node long, frequent boolean, slack int")
        .withColumn("_split", split)
        .withColumns({
            "_least": F.min("node").over(group),
            "_most": F.max("node").over(group),
            "_low": F.min("slack").over(group),
        })
        .where("frequent or (_least <> _most and slack + _low <= 0)")
        .dropDuplicates(["signature", "_split", "node"])  # in place: rows of a split lie together
        .select("signature", "node", "slack", "frequent")
    )
    told = cut(told, "near_shared")
    # Common signatures were dealt to several splits, so their least slack is found here.
    often = told.where("frequent")
    low = often.groupBy("signature").agg(F.min("slack").alias("low"))
    often = often.join(low, "signature").where("slack + low <= 0")
    return told.where("not frequent").unionByName(often.drop("low")).drop("frequent")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The written pairs ``a, b`` whose sets reach the similarity, compared exactly.

    ``nodes`` has the ``key`` of one document per node. The rows of a node ``a`` follow
    it in order, in parts of its partners, so a worker holds one set of ``a`` and one
    chunk of texts at a time.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(SPLITS)).cast("int")
    lanes = pairs.select("a", "b", part.alias("lane"))
    roles = lanes.select("a", "lane", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(
        lanes.select("a", "lane", F.col("a").alias("node"), F.lit(0).alias("role")).distinct()
    )
    keyed = cut(roles.join(nodes.select("node", "key"), "node"), "near_roles")
    ordered = (
        keyed.join(texts_of(docs, keyed, doc_id, text), "key")
        .repartition("a", "lane")
        .sortWithinPartitions("a", "lane", "role")
        .select("a", "node", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head = Shingler(), np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch):
                value, start = shingler.sets(part.column("text").to_pylist())
                links: list[tuple[int, int]] = []
                a, node, role = (part.column(c).to_pylist() for c in ("a", "node", "role"))
                for i in range(part.num_rows):
                    own = value[start[i] : start[i + 1]]
                    if role[i] == 0:
                        head = own
                        continue
                    low, high = sorted((len(own), len(head)))
                    if low * DENOMINATOR < high * NUMERATOR:
                        continue
                    common = len(np.intersect1d(own, head, assume_unique=True))
                    if DENOMINATOR * common >= NUMERATOR * (low + high - common):
                        links.append((a[i], node[i]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
                )

    return map_arrow(ordered, run, "a long, b long")


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose short sketches do not rule a link out."""
    one = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = pairs.join(one, "a").join(two, "b").where(least * DENOMINATOR >= most * NUMERATOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // 7
            near = [
                hamming(x, y) <= most
                for x, y, most in zip(
                    batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), bound.tolist(), strict=True
                )
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, text`` of the keys wanted and of some others.

    A bitmap of fixed size holds back most texts that nobody asked for before they are
    shuffled; the join that follows is exact. A task passes repeated rows on once.
    """
    place = F.pmod("key", F.lit(FILTER_BITS))
    words = (
        wanted.select(place.alias("place"))
        .selectExpr("shiftright(place, 6) AS w", "shiftleft(1L, CAST(place & 63 AS int)) AS bit")
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["w"]] = words["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    keyed = _keyed(docs, doc_id, text).select("key", "text", place.alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("place").to_numpy()
            some = batch.select(["key", "text"]).filter(pa.array(((shared.value[at >> 6] >> (at & 63)) & 1).astype(bool)))
            fresh = []
            for key in some.column("key").to_pylist():
                fresh.append(key not in seen)
                seen.add(key)
            yield some.filter(pa.array(fresh, pa.bool_()))

    return map_arrow(keyed, run, "key long, text string")


def grouped_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, key, n, component, component_id`` per row; ``component`` is null for empty sets."""
    told = described(docs, doc_id, text)
    sets = told.where("kind = 0")
    common = common_shingles(told)
    members = cut(shared_signatures(docs, common, text), "near_members")
    nodes = (
        sets.where("n > 0")
        .groupBy(F.col("name").alias("node"))
        .agg(F.min("key").alias("key"), F.max(F.struct("n", "sketch", "mark")).alias("s"))
        .join(members.select("node").distinct(), "node", "left_semi")
    )
    words = [F.col("s.mark")[word].alias(f"w{word}") for word in range(MARK_BITS // 64)]
    nodes = cut(nodes.select("node", "key", "s.n", "s.sketch", *words), "near_nodes")

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(cut(alike(pairs, nodes), "near_pairs"), nodes, docs, doc_id, text)

    traits = nodes.select("node", "n", *[f"w{word}" for word in range(MARK_BITS // 64)])
    links = link_groups(members, linked, traits, may_be_linked)
    known = components(links, "near_components").withColumnRenamed("node", "name")
    named = cut(
        sets.where("n > 0")
        .groupBy("name")
        .agg(F.min("id").alias("least"))
        .join(known, "name", "left")
        .withColumn("component", F.coalesce("component", "name")),
        "near_named",
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_name = named.join(least, "component").select("name", "component", "component_id")
    alone = sets.where("n = 0").select("id", "key", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    linked_rows = sets.where("n > 0").join(by_name, "name").select("id", "key", "n", "component", "component_id")
    return linked_rows.unionByName(alone)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; the smallest id reachable by links.

    Null and wordless texts have an empty set and are alone. Rows with a null id are
    linked like others but never name a component; a component of only such rows has a
    null id. Repeated rows are linked with each other; an empty table gives an empty
    result; further columns are ignored. Ids are integers.
    """
    return grouped_rows(docs, doc_id, text).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id"
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns.

    Texts without words are linked with nothing, so all of them stay.
    """
    rows = cut(grouped_rows(docs, doc_id, text), "near_rows")
    kept = (
        rows.where("n > 0")
        .groupBy("component")
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("row"))
        .select(F.col("row.key").alias("key"), F.lit(True).alias("once"))
    )
    wordless = rows.where("n = 0").select("key", F.lit(False).alias("once")).distinct()
    keyed = packed(docs, key=F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    copies = Window.partitionBy("key").orderBy("key")
    return (
        keyed.join(kept.unionByName(wordless), "key")
        .withColumn("copy", F.row_number().over(copies))
        .where("not once or copy = 1")
        .select("row.*")
    )
