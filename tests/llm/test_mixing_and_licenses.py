import random

import numpy as np
import pytest

from sitewatch.llm import licenses, mixing


def corpus(n=160, seed=2):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = ["good", "good", "good", "poor", "toxic"][i % 5]
        own = [f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(30, 80))]
        if kind == "poor":
            own = [f"{w} ***" for w in own]
        if kind == "toxic":
            own[::4] = ["insult"] * len(own[::4])
        rows.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, 0 if kind == "poor" else 1, 1 if kind == "toxic" else 0))
    return rows, labels


def projected(weight, p, goal):
    """Nearest rates to one that meet the goal, by many plain steps in the same metric."""
    gram = (p * weight[:, None]).T @ p
    rate = np.ones(len(weight))
    for _ in range(4000):
        error = p.T @ (weight * rate) - goal
        rate = np.maximum(0, rate - p @ (np.linalg.pinv(gram) @ error))
    return rate


def test_rates_meet_the_targets(make, label, spark):
    rows, labels = corpus()
    targets = {"good": 0.9, "poor": 0.02, "toxic": 0.08}
    out = mixing.mix(make(rows, extra=True), mixing.label_domains(label(labels)), targets).toPandas()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    weight = out["n_tokens"].to_numpy(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-6)
    now = p.T @ weight
    goal = np.minimum(np.array([targets[d] for d in mixing.DOMAINS]) * now[0] / 0.9, now)
    reached = p.T @ (weight * out["rate"].to_numpy())
    assert np.allclose(reached, goal, atol=2e-5 * goal.sum())
    assert np.allclose(out["rate"], projected(weight, p, goal), atol=1e-4)
    chosen = out.set_index("doc_id")
    right = [chosen.loc[i, [f"p_{d}" for d in mixing.DOMAINS]].astype(float).idxmax()[2:] for i, _ in rows]
    assert np.mean([r == ["good", "good", "good", "poor", "toxic"][i % 5] for r, (i, _) in zip(right, rows, strict=True)]) > 0.95
    assert set(out["copies"] - np.floor(out["rate"])) <= {0, 1}
    used = mixing.mixed_documents(make(rows, extra=True), mixing.label_domains(label(labels)), targets)
    assert used.columns == make(rows, extra=True).columns and used.count() == out["copies"].sum()


def test_rates_are_held_at_zero(spark):
    rows = [(10, [1.0, 0.0]), (10, [0.5, 0.5]), (10, [0.0, 1.0])]
    told = spark.createDataFrame([(n, p, 1) for n, p in rows], "n_tokens long, p array<double>, rows long")
    steps = mixing.fit_steps(told, ("a", "b"), {"a": 1.0, "b": 0.0})
    rate = [r["r"] for r in told.select(mixing._rate(steps, 2).alias("r")).collect()]
    assert min(rate) >= 0 and rate[2] < 1e-3
    assert mixing.fit_steps(told, ("a", "b"), {}) == []


def test_nulls_repeated_rows_no_labels_and_empty(make, label):
    rows = [(1, "good words"), (1, "good words"), (None, "words"), (2, None), (3, "")]
    out = mixing.mix(make(rows), mixing.label_domains(label([(1, 1, 0), (2, None, 1), (None, 1, 0)]))).collect()
    assert len(out) == 5
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=repr) == sorted(
        [(1, 2), (1, 2), (None, 1), (2, 0), (3, 0)], key=repr
    )
    assert mixing.mix(make(rows), mixing.label_domains(label([]))).count() == 5
    assert mixing.mix(make([]), mixing.label_domains(label([]))).count() == 0


PLAIN = [
    "the version of this story is under the tree and free of charge",
    "to be or not to be in the source of all things",
    "general words about a public house and its work",
    "a b c d e f g",
]


def test_families_and_decoys(make):
    rows, want = [], {}
    for number, (family, texts) in enumerate(licenses.TEMPLATES.items()):
        for place, text in enumerate(texts):
            i = number * 100 + place
            rows.append((i, f"{PLAIN[i % 4]}\n{text.upper() if place % 2 else text}\n{PLAIN[(i + 1) % 4]}"))
            want[i] = family
    decoys = [*PLAIN, "", None, "he took out a license for the dog", "see the general terms of the public library", "version 2.0 of the software"]
    rows += [(1000 + i, t) for i, t in enumerate(decoys)]
    out = {r["doc_id"]: r for r in licenses.scan(make(rows, extra=True)).collect()}
    for i, family in want.items():
        assert out[i]["license"] == family and out[i]["paragraph"] == 1, (i, out[i])
    for i in range(len(decoys)):
        assert out[1000 + i]["license"] == "none", (decoys[i], out[1000 + i])


def test_license_nulls_repeated_rows_and_empty(make, got):
    text = "Released under the MIT License."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "x" * 100_000)]
    out = got(licenses.scan(make(rows)), "doc_id", "license")
    assert out == sorted([(1, "mit"), (1, "mit"), (None, "mit"), (2, "none"), (3, "none")], key=repr)
    assert licenses.scan(make([])).count() == 0


@pytest.mark.parametrize("text", ["A-b C.d", "", "one", "1 2 3"])
def test_grams(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    assert set(licenses.grams(text)) == {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}
