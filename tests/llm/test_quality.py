import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sitewatch.llm import quality
from sitewatch.operators.checkpoints import cut

SPACE = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def base(text):
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def grams(text):
    odd, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    tokens = [xxhash.xxh64_intdigest(t) for w in words_of(text) for t in quality.TOKENS.findall(w.encode())]
    pairs = [((a * odd + (b ^ (b >> 29))) * odd) & full for a, b in zip(tokens, tokens[1:], strict=False)]
    return [t % quality.BUCKETS for t in tokens] + [(p >> 20) % quality.BUCKETS for p in pairs]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    clean = [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(n):
        size = rnd.choice([20, 60, 90])
        own = [rnd.choice(clean) for _ in range(size)]
        poor = i % 4 == 0
        if poor:
            own = [w + rnd.choice(["***", "$$$"]) for w in own]
        rows.append((i, " ".join(own) + ("\nline\nline" if i % 5 == 0 else "")))
        if i % 2 == 0:
            labels.append((i, 0 if poor else 1, 1 if i % 14 == 2 else 0))
    return rows, labels


def brute(rows, labels):
    told = {}
    for i, q, t in labels:
        if None not in (i, q, t):
            told.setdefault(i, []).append((q, t))
    kind = {i: 0 if min(v)[0] == 0 else (2 if max(t for _, t in v) == 0 else 1) for i, v in told.items()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += kind.get(i) == 2
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > quality.BUCKETS else raw * 0
    score = [float(np.mean(ratio[grams(t)])) if grams(t) else 0.0 for _, t in rows]
    place = quality.bins(np.array(score))
    counts = [base(t) for _, t in rows]
    poor, good = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    for (i, _), c, p in zip(rows, counts, place, strict=True):
        if i in kind and not failed(c):
            (good if kind[i] else poor)[p] += 1
    edge = -1
    if poor.sum() and good.sum():
        gains = [poor[:e].sum() / poor.sum() - good[:e].sum() / good.sum() for e in range(quality.BINS)]
        best = [e for e, g in enumerate(gains) if g >= max(gains) - 1e-12]
        edge = best[len(best) // 2]
    return sorted(
        ((i, *c, failed(c), not failed(c) and bool(p >= edge)) for (i, _), c, p in zip(rows, counts, place, strict=True)),
        key=repr,
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_verdicts(make, label, got):
    rows, labels = corpus(120)
    rows += [(900, None), (901, ""), (902, "é| a\x0bb\x85c\n \n" * 30), (None, "null id " * 40), (904, "a b c d " * 40)]
    labels += [(None, 1, 0), (5, None, 0), (2, 0, 0)]
    out = quality.quality_verdicts(make(rows, extra=True), label(labels))
    assert got(out, *COLUMNS) == brute(rows, labels)
    kept = {r[0] for r in got(out, *COLUMNS) if r[-1]}
    assert kept and not any(i % 4 == 0 for i in kept)


def test_all_labels_count_however_many_there_are(spark, make, label, got):
    rows, labels = corpus(120)
    # A million labels of other documents; the labels of these must not be crowded out.
    others = spark.range(1_000_000, 2_000_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    out = got(quality.quality_verdicts(make(rows), label(labels).union(others)), *COLUMNS)
    assert out == brute(rows, labels)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        repeated = [*rows, rows[2], rows[2], (None, rows[4][1]), (None, None)]
        out = got(quality.quality_verdicts(make(repeated), label(labels).union(others)), *COLUMNS)
        assert out == brute(repeated, labels)
        plan = quality.with_kinds(make(rows), cut(quality.label_kinds(others).withColumn("_part", F.lit(0)), "t"), "doc_id", "text")
        plan = plan._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan  # texts are neither sent to every task nor sorted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_rows_that_stay_keep_all_columns(make, label, got):
    rows, labels = corpus(60)
    df = make([*rows, rows[1], rows[1]], extra=True)
    out = quality.keep_quality(df, label(labels))
    assert out.columns == df.columns
    want = [r[0] for r in got(quality.quality_verdicts(df, label(labels)), *COLUMNS) if r[-1]]
    assert sorted(r[0] for r in got(out, "doc_id")) == sorted(want)


def test_without_labels_only_the_base_rule_decides(make, label, got):
    rows, _ = corpus(30)
    out = got(quality.quality_verdicts(make(rows), label([])), *COLUMNS)
    assert out == brute(rows, []) and any(r[-1] for r in out)
    assert quality.quality_verdicts(make([]), label([])).count() == 0


def test_threshold():
    poor, good = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    poor[100], good[201] = 5, 9
    edge = (quality.best_threshold(poor, good) - quality.LOWEST) / (quality.HIGHEST - quality.LOWEST) * quality.BINS
    assert 101 <= round(edge) <= 201
    assert quality.best_threshold(poor, good * 0) == -math.inf


def test_repeated_words_with_very_many_words():
    rnd = random.Random(2)
    numbers = [rnd.randint(0, 40) for _ in range(400)]
    want = base(" ".join(map(str, numbers)))[4]
    assert quality.repeated_words(np.array(numbers)) == want
    wide = np.arange(1_300_000)
    assert quality.repeated_words(np.concatenate([wide, wide[5:9]])) == 8
