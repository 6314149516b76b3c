"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-gram buckets are counted: of the trusted target, which are
labelled documents of good quality without toxicity, and of the raw corpus, which are all
documents. A document's score is the mean over its n-grams of log p_target - log p_raw.
N-grams are single tokens and pairs of neighbours; a token is a run of word characters or
of other signs, so marks stuck to words count as themselves. One threshold holds for all
documents: the one that best parts labelled good from labelled poor documents, found on a
histogram of their scores.

All labels and all documents take part. Labels meet the texts in one join, for the counts,
and the scores in another, for the threshold; only bucket counts and histograms reach the
driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.llm.common import chunks, map_arrow, own_names
from sitewatch.operators.checkpoints import cut

BUCKETS = 10_000
BROADCAST_LABELS = 500_000  # some 65 MB in an executor; with more, texts go where their labels are
BINS = 4_000
#: Scores are means of log ratios; beyond these they count as the outermost bins.
LOWEST, HIGHEST = -4.0, 4.0
SMOOTHING = 1.0
MIN_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
REMEMBERED = 300_000
TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


class Words:
    """Numbers of words within a worker, and the hashed tokens of each word."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tokens = np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)

    def numbers(self, split: list[list[bytes]]) -> np.ndarray:
        import xxhash

        if len(self.number) > REMEMBERED:
            self.forget()
        number = self.number
        fresh = [w for w in dict.fromkeys(w for words in split for w in words) if w not in number]
        if fresh:
            for w in fresh:
                number[w] = len(number)
            parts = [TOKENS.findall(w) for w in fresh]
            hashed = np.array([xxhash.xxh64_intdigest(t) for p in parts for t in p], np.uint64)
            self.tokens = np.concatenate([self.tokens, hashed])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(p) for p in parts])])
        return np.fromiter((number[w] for words in split for w in words), np.int64)

    def grams(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, and the document of each."""
        size = self.start[numbers + 1] - self.start[numbers]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        flat = self.tokens[np.arange(total) + np.repeat(self.start[numbers] - (last - size), size)]
        per_doc = np.diff(np.append(0, np.append(0, last)[ends]))
        doc = np.repeat(np.arange(len(ends)), per_doc)
        pair = doc[1:] == doc[:-1]
        pairs = (flat[:-1] * _ODD + (flat[1:] ^ (flat[1:] >> np.uint64(29))))[pair] * _ODD
        single = (flat % np.uint64(BUCKETS)).astype(np.int64)
        double = ((pairs >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
        return np.concatenate([single, double]), np.concatenate([doc, doc[:-1][pair]])


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(numbers) < 4:
        return 0
    _, code = np.unique(numbers, return_inverse=True)
    code = code.astype(np.int64)
    pair = code[:-1] * (code.max() + 1) + code[1:]
    if code.max() >= 1 << 20:  # three codes would not fit in one integer
        _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * (code.max() + 1) + code[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(numbers), bool)
    for step in range(3):
        covered[often + step] = True
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(texts: list[str | None], words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The five base counts per text, all word numbers, and where each text's words end."""
    data = [(t or "").encode() for t in texts]
    split = [d.split() for d in data]
    numbers = words.numbers(split)
    ends = np.cumsum([len(s) for s in split])
    counts = np.zeros((5, len(texts)), np.int64)
    start = 0
    for i, (d, text, end) in enumerate(zip(data, texts, ends.tolist(), strict=True)):
        raw = np.frombuffer(d, np.uint8)
        counts[:, i] = (
            end - start,
            len(text or "") - int(_IS_SPACE[raw].sum()),
            int(_IS_SYMBOL[raw].sum()),
            repeated_lines(d),
            repeated_words(numbers[start:end]),
        )
        start = end
    return list(counts), numbers, ends


def label_kinds(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``labelled`` id and ``kind`` of every label: 0 poor, 1 good but toxic, 2 trusted.

    Rows with a null in them are left out. An id with several labels is trusted only if
    all of them say so.
    """
    return (
        own_names(labels, doc_id, "quality", "toxic")
        .dropna()
        .groupBy(F.col(f"`{doc_id}`").alias("labelled"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .select("labelled", F.when(F.col("q") == 0, 0).when(F.col("t") == 0, 2).otherwise(1).alias("kind"))
    )


def with_kinds(docs: DataFrame, told: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every text and the kind of its label, null without one."""
    near = F.broadcast(told) if told.count() <= BROADCAST_LABELS else told.hint("shuffle_hash")
    # Rows without an id meet no label; they are spread by their texts.
    part = F.when(F.col(f"`{doc_id}`").isNull(), F.pmod(F.xxhash64(f"`{text}`"), F.lit(10_000))).otherwise(0)
    meets = (F.col(f"`{doc_id}`") == F.col("labelled")) & (part == F.col("_part"))
    return own_names(docs, doc_id, text).join(near, meets, "left").select(F.col(f"`{text}`"), "kind")


def fit(docs: DataFrame, told: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray | None:
    """Log ratio per bucket, counted over all documents; None where none is trusted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, target = Words(), np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for part in chunks(batch, text):
                split = [(t or "").encode().split() for t in part.column(text).to_pylist()]
                bucket, doc = words.grams(words.numbers(split), np.cumsum([len(s) for s in split]))
                raw += np.bincount(bucket, minlength=BUCKETS)
                trusted = (part.column("kind").fill_null(-1).to_numpy(zero_copy_only=False) == 2)[doc]
                target += np.bincount(bucket[trusted], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen].astype(np.int64)), pa.array(target[seen].astype(np.int64))],
            ["bucket", "raw", "target"],
        )

    counted = (
        map_arrow(with_kinds(docs, told, doc_id, text), count, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    raw[counted["bucket"]] += counted["raw"]
    target[counted["bucket"]] += counted["target"]
    if target.sum() == SMOOTHING * BUCKETS:
        return None
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def lowest_bin(scored: DataFrame, told: DataFrame, doc_id: str, failed: str, place: str) -> int:
    """The bin from which on documents are kept, by the labelled ones that pass the base rule."""
    histogram = (
        own_names(scored, doc_id, failed, place)
        .where(~F.col(f"`{failed}`"))
        .join(told, F.col(f"`{doc_id}`") == F.col("labelled"))
        .groupBy(F.col(f"`{place}`").alias("bin"))
        .agg(F.count_if(F.col("kind") == 0).alias("poor"), F.count_if(F.col("kind") > 0).alias("good"))
        .toPandas()
    )
    poor, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    poor[histogram["bin"]] = histogram["poor"]
    good[histogram["bin"]] = histogram["good"]
    return int(bins(np.array([best_threshold(poor, good)]))[0])


def bins(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1).astype(np.int64)


def best_threshold(poor: np.ndarray, good: np.ndarray) -> float:
    """The lower edge of the bin from which on documents are kept.

    It maximises the share of good documents kept plus the share of poor ones rejected;
    of equally good edges the middle one is taken. Without labels of both kinds every
    document is kept.
    """
    if not poor.sum() or not good.sum():
        return -math.inf
    lost = np.append(0, np.cumsum(good))[:-1] / good.sum()
    caught = np.append(0, np.cumsum(poor))[:-1] / poor.sum()
    gain = caught - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return LOWEST + (HIGHEST - LOWEST) * int(best[len(best) // 2]) / BINS


def scores(words: Words, numbers: np.ndarray, ends: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    bucket, doc = words.grams(numbers, ends)
    total = np.bincount(doc, weights=ratios[bucket], minlength=len(ends))
    return total / np.maximum(np.bincount(doc, minlength=len(ends)), 1)


def base_failed(counts: list[np.ndarray]) -> np.ndarray:
    n_words, repeat = counts[0], counts[4]
    return (n_words < MIN_WORDS) | (100 * repeat > REPEATED_PERCENT * n_words)


def judged(
    docs: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text", added: list[str] | None = None
) -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``place`` (its bin) per row.

    Null text has no words and fails the base rule. Repeated rows are judged alike, ids
    may be null, and an empty table gives an empty result. With two names in ``added`` all
    columns of the input come back, whatever they are called, and ``base_failed`` and
    ``place`` under these names.
    """
    source = docs if added else own_names(docs, doc_id, text)
    if added:
        schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{added[0]}` boolean", f"`{added[1]}` int"])
    else:
        schema = f"`{doc_id}` {dict(source.dtypes)[doc_id]}, {COUNTS}, base_failed boolean, score double, place int"
    names = [f.split()[0] for f in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in chunks(batch, text):
                counts, numbers, ends = measure(part.column(text).to_pylist(), words)
                failed = pa.array(base_failed(counts))
                score = scores(words, numbers, ends, ratios)
                place = pa.array(bins(score).astype(np.int32))
                if added:
                    yield pa.RecordBatch.from_arrays([*part.columns, failed, place], [*part.schema.names, *added])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), *map(pa.array, counts), failed, pa.array(score), place],
                    [doc_id, *names, "base_failed", "score", "place"],
                )

    return map_arrow(source, run, schema)


def _judged_and_kept(docs: DataFrame, labels: DataFrame, added: list[str] | None = None) -> tuple[DataFrame, Column]:
    """The judged rows, written, and which of them are kept by a model fitted on all of them."""
    told = cut(label_kinds(labels).withColumn("_part", F.lit(0).cast("long")), "label_kinds")
    ratios = fit(docs, told)
    scored = cut(judged(docs, np.zeros(BUCKETS) if ratios is None else ratios, added=added), "judged")
    failed, place = added or ["base_failed", "place"]
    lowest = 0 if ratios is None else lowest_bin(scored, told, "doc_id", failed, place)
    return scored, ~F.col(f"`{failed}`") & (F.col(f"`{place}`") >= lowest)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict of every document by a model fitted on all of them."""
    scored, kept = _judged_and_kept(docs, labels)
    return scored.withColumn("kept", kept).drop("place")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    unused = "_" * max(map(len, docs.columns))
    scored, kept = _judged_and_kept(docs, labels, [f"{unused}_failed", f"{unused}_place"])
    return own_names(scored.where(kept), *docs.columns)
