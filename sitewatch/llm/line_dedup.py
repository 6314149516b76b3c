"""Near-copies of lines by a segment-partition edit join.

Lines are equal in class if a chain of lines leads from one to the other in which
neighbours differ by few insertions, deletions or replacements of a character: by none if
the shorter one has fewer than 10 characters, by one below 40, else by two (``allowed``).
A line is cut into one segment more than that; of two lines within the threshold one
holds a segment of the other unchanged, near the same place. So every line files its
segments under its length, and probes the index of every length that it may match with
those substrings only that can meet a segment (the length-aware choice by place). Lines
under a common key are candidates, and a banded bit-parallel edit distance over five
diagonals decides.

Equal lines are one node. Within the lines of a key not all pairs are compared: see
``components.link_groups``. Lengths and a parity sketch of the pairs of neighbouring
characters, of which one edit changes four at most, are tested inside its joins. In each
class the first line stays, by document id and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import chunks, own_names, packed, text_or_empty
from sitewatch.llm.components import components, link_groups
from sitewatch.operators.checkpoints import cut

EDITS = 2  # the most that is allowed
FUZZY_FROM, LONG_FROM = 10, 40  # shortest lines with one edit, and with two
MARK_BITS = 128
SPLITS = 64  # parts in which the lines of a frequent key are looked at first
FREQUENT = 32  # lines of one chunk under one key
FILTER_BITS = 1 << 24  # of the bitmap of wanted lines; more lines only let more pass
SEED = 42  # that of the built-in hash function, so both sides name lines alike


def line_name(line: bytes) -> int:
    value = xxhash.xxh64_intdigest(line, SEED)
    return value - (1 << 64) if value >> 63 else value


def allowed(length: int) -> int:
    """Edits between two lines of which the shorter one has so many characters."""
    return EDITS if length >= LONG_FROM else 1 if length >= FUZZY_FROM else 0


def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of one segment more than edits, whose sizes differ by one at most."""
    parts = allowed(length) + 1
    small, longer = divmod(length, parts)
    sizes = [small + (i >= parts - longer) for i in range(parts)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(parts)]


def probes(length: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of all substrings that a line looks up.

    A segment before which at most i edits happened and after which at most the rest did
    lies within these bounds of its place.
    """
    found = []
    for other in range(max(FUZZY_FROM, length - EDITS), length + 1):
        more, edits = length - other, allowed(other)
        if more > edits:
            continue
        for i, (start, size) in enumerate(segments(other)):
            low = max(0, start - i, start + more - (edits - i))
            high = min(length - size, start + i, start + more + (edits - i))
            found += [(other, i, at, size) for at in range(low, high + 1)]
    return found


class Keys:
    """Index and probe keys of lines; the places are worked out once per length."""

    def __init__(self) -> None:
        self.places: dict[int, list[tuple[int, int, int, int]]] = {}

    def of(self, line: str) -> set[int]:
        length = len(line)
        places = self.places.get(length)
        if places is None:
            own = [(length, i, start, size) for i, (start, size) in enumerate(segments(length))]
            places = self.places[length] = sorted({*own, *probes(length)})
        digest = xxhash.xxh64_intdigest
        return {digest(line[at : at + size].encode(), other * 8 + i) for other, i, at, size in places}


def edit_distances(ones: list[str], twos: list[str]) -> np.ndarray:
    """Edit distance of each pair, right up to EDITS and larger than EDITS beyond it.

    One bit per diagonal of the band and pair; the vectors of vertical steps move along
    the diagonal with every character. Pairs of similar length are computed together.
    """
    out = np.full(len(ones), EDITS + 1)
    sizes = [max(len(a), len(b), 1) for a, b in zip(ones, twos, strict=True)]
    for power in {s.bit_length() for s in sizes}:
        own = np.array([i for i, s in enumerate(sizes) if s.bit_length() == power])
        own = own[[abs(len(ones[i]) - len(twos[i])) <= EDITS for i in own]]
        if len(own):
            out[own] = _banded([ones[i] for i in own], [twos[i] for i in own])
    return out


def _codes(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int64)
    for row, text in enumerate(texts):
        out[row, before : before + len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out


def _banded(ones: list[str], twos: list[str]) -> np.ndarray:
    width, low = 2 * EDITS + 1, EDITS
    rows = np.array([len(a) for a in ones])
    columns = np.array([len(b) for b in twos])
    longest = int(columns.max())
    a = _codes(ones, low, int(rows.max()) + longest + 2 * width, -1)
    b = _codes(twos, 0, longest + 1, -2)
    all_bits = (1 << width) - 1
    # Bit k is row (column - EDITS + k); above row 0 the values grow away from it.
    up = np.full(len(ones), sum(1 << k for k in range(width) if k - low >= 1))
    down = np.full(len(ones), sum(1 << k for k in range(width) if k - low <= 0))
    distance = np.abs(rows - columns)
    own = rows - columns + low
    for column in range(1, longest + 1):
        up, down = (up >> 1) | (1 << (width - 1)), down >> 1
        equal = np.zeros(len(ones), np.int64)
        for k in range(width):
            equal |= (a[:, column - 1 + k] == b[:, column - 1]).astype(np.int64) << k
        same = (((((equal & up) + up) ^ up) | equal | down)) & all_bits
        right = (down | ~(same | up)) & all_bits
        left = same & up
        right, left = ((right << 1) | 1) & all_bits, (left << 1) & all_bits
        up, down = (left | ~(same | right)) & all_bits, same & right
        distance = distance + np.where(column <= columns, 1 - ((same >> own) & 1), 0)
    return distance


def _fuzzy_lines(texts: list[str | None]) -> dict[str, None]:
    return dict.fromkeys(line for t in texts if t for line in t.split("\n") if len(line) >= FUZZY_FROM)


def shared_keys(docs: DataFrame, text: str) -> DataFrame:
    """``signature, node`` of keys under which several lines (may) stand."""
    source = own_names(docs, text).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                lines = list(_fuzzy_lines(part.column("text").to_pylist()))
                names = np.array([line_name(x.encode()) for x in lines], np.int64)
                fresh = np.flatnonzero(~np.isin(names, seen))
                seen = np.union1d(seen, names)  # equal lines of this task are filed once
                told = [keys.of(lines[i]) for i in fresh]
                key = np.array([k for t in told for k in t], np.uint64).view(np.int64)
                node = np.repeat(names[fresh], [len(t) for t in told])
                _, first, at, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                often = count[at] >= FREQUENT
                split = np.where(often, 1 + node % SPLITS, 0).astype(np.int32)
                # One line of a frequent key also stands where those of other chunks may.
                heads = first[count >= FREQUENT]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(key, key[heads])),
                        pa.array(np.append(node, node[heads])),
                        pa.array(np.append(split, np.zeros(len(heads), np.int32))),
                    ],
                    ["signature", "node", "split"],
                )

    group = Window.partitionBy("signature", "split")
    return (
        source.mapInArrow(run, "signature long, node long, split int")
        .withColumns({"_least": F.min("node").over(group), "_most": F.max("node").over(group)})
        .where("split > 0 or _least <> _most")
        .dropDuplicates(["signature", "split", "node"])  # in place: rows of a split lie together
        .select("signature", "node", F.lit(0).alias("slack"))
    )


def line_marks(lines: list[str]) -> np.ndarray:
    """Parities of the pairs of neighbouring characters, two 64-bit integers per line."""
    sizes = np.array([len(line) for line in lines], np.int64)
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    inside = owner[1:] == owner[:-1]
    pair = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:] * np.uint64(0xBF58476D1CE4E5B9)
    place = ((pair ^ (pair >> np.uint64(29))) >> np.uint64(7)) % np.uint64(MARK_BITS)
    flips = np.bincount(place.astype(np.int64)[inside] + owner[1:][inside] * MARK_BITS, minlength=len(lines) * MARK_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(len(lines), MARK_BITS // 64)


def may_be_near(one: str, other: str) -> Column:
    """Lengths and marks of two lines do not rule a link out; true for every linked pair."""
    a, b = F.col(f"{one}.n"), F.col(f"{other}.n")
    edits = F.when(F.least(a, b) >= LONG_FROM, F.lit(EDITS)).otherwise(F.lit(1))
    differing = sum(F.bit_count(F.col(f"{one}.w{word}").bitwiseXOR(F.col(f"{other}.w{word}"))) for word in range(2))
    return (F.abs(a - b) <= edits) & (differing <= 4 * edits)


def lines_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """``node, line`` of the nodes, written once; a bitmap of fixed size sorts out most others."""
    place = F.pmod("node", F.lit(FILTER_BITS))
    words = (
        nodes.select(place.alias("place"))
        .selectExpr("shiftright(place, 6) AS w", "shiftleft(1L, CAST(place & 63 AS int)) AS bit")
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["w"]] = words["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    source = own_names(docs, text).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lines = list(_fuzzy_lines(part.column("text").to_pylist()))
                names = np.array([line_name(x.encode()) for x in lines], np.int64)
                at = names % FILTER_BITS
                asked = np.flatnonzero((shared.value[at >> 6] >> (at & 63)) & 1)
                some = [lines[i] for i in asked]
                mark = line_marks(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[asked]), pa.array(some, pa.string()), pa.array(mark[:, 0]), pa.array(mark[:, 1])],
                    ["node", "line", "w0", "w1"],
                )

    found = source.mapInArrow(run, "node long, line string, w0 long, w1 long").join(nodes, "node", "left_semi")
    return cut(found.dropDuplicates(["node"]), "line_texts")


def within_edits(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    one = lines.select(F.col("node").alias("a"), F.col("line").alias("one"))
    two = lines.select(F.col("node").alias("b"), F.col("line").alias("two"))
    both = pairs.join(one, "a").join(two, "b").where(F.abs(F.length("one") - F.length("two")) <= EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "one"):
                ones, twos = part.column("one").to_pylist(), part.column("two").to_pylist()
                most = np.array([allowed(min(len(x), len(y))) for x, y in zip(ones, twos, strict=True)], np.int64)
                yield part.select(["a", "b"]).filter(pa.array(edit_distances(ones, twos) <= most))

    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, key, place, node`` of every line with a word; places count from 0."""
    value = text_or_empty(text)
    return (
        own_names(docs, doc_id, text)
        .select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("key"), F.posexplode(F.split(value, "\n")).alias("place", "line"))
        .where(_worded(F.col("line")))
        .select("id", "key", "place", F.xxhash64("line").alias("node"))
    )


def dropped_places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, dropped``: the places of the lines that go, for documents that have any."""
    rows = cut(line_rows(docs, doc_id, text), "line_rows")
    members = cut(shared_keys(docs, text), "line_members")
    texts = lines_of(docs, members.select("node").distinct(), text)
    traits = texts.select("node", F.length("line").alias("n"), "w0", "w1")
    links = link_groups(members, lambda pairs: within_edits(pairs, texts), traits, may_be_near)
    known = components(links, "line_components")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "place")
    nodes = rows.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    named = cut(
        nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "line_classes"
    )
    firsts = named.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).where("n > 1")
    told = cut(named.select("node", "component").join(firsts.drop("n"), "component").select("node", "stays"), "line_firsts")
    gone = rows.join(told, "node").where(~((F.col("key") == F.col("stays.key")) & (F.col("place") == F.col("stays.place"))))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("dropped"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` per row: the places of lines that go.

    Places count from 0 over all lines; lines without a word always stay. Of a class the
    line of the smallest id stays, then of the smallest place; a null id comes last. Null
    text has one empty line. Repeated rows are one document and get the same result; an
    empty table gives an empty result; further columns are ignored.
    """
    by_doc = dropped_places(docs, doc_id, text)
    value = text_or_empty(text)
    each = own_names(docs, doc_id, text).select(
        doc_id,
        F.xxhash64(doc_id, text).alias("key"),
        (F.length(value) - F.length(F.translate(value, "\n", "")) + 1).cast("long").alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    return each.join(by_doc, "key", "left").select(
        doc_id,
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns and without the repeated lines in their texts."""
    told = dropped_places(docs, doc_id, text)
    keyed = packed(docs, key=F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    kept = F.array_join(
        F.filter(F.split(F.col(f"row.`{text}`"), "\n"), lambda _, i: ~F.array_contains("dropped", i)), "\n"
    )
    new = F.when(F.col("dropped").isNull(), F.col(f"row.`{text}`")).otherwise(kept)
    return keyed.join(told, "key", "left").withColumn("row", F.col("row").withField(f"`{text}`", new)).select("row.*")
