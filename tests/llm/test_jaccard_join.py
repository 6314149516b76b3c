import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import jaccard_join
from sitewatch.llm.jaccard_join import Shingler, hamming, short_sketches, signatures


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = lower.encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and linked(sets[i], sets[j]):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))


def near_copies(seed, n, words=(5, 120)):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, base = [], []
    passage = " ".join(rnd.choices(vocabulary, k=60))
    for i in range(n):
        if base and rnd.random() < 0.6:
            own = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        else:
            own = rnd.choices(vocabulary, k=rnd.randint(*words))
            base.append(own)
        text = " ".join(w.upper() if rnd.random() < 0.1 else w for w in own)
        rows.append((i, text + (" " + passage if rnd.random() < 0.2 else "")))
    return rows


def test_components_of_near_copies(make, got):
    rows = near_copies(1, 250) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c")]
    assert got(jaccard_join.near_groups(make(rows, extra=True))) == sorted(brute(rows), key=repr)


def test_one_large_group_and_a_common_passage(make, got):
    rnd = random.Random(4)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    passage = " ".join(f"p{k}" for k in range(55))
    rows += [(1000 + i, f"{passage} " + " ".join(f"q{i}_{k}" for k in range(90))) for i in range(150)]
    assert got(jaccard_join.near_groups(make(rows))) == sorted(brute(rows), key=repr)


def test_chains_whose_ends_are_not_linked(make, got):
    base = [f"c{k}" for k in range(100)]
    rows = []
    for i in range(12):
        own = list(base)
        own[: 2 * i] = [f"d{k}" for k in range(2 * i)]
        rows.append((20 - i, " ".join(own)))
    assert got(jaccard_join.near_groups(make(rows))) == sorted(brute(rows), key=repr)


def test_repeated_rows_null_ids_and_empty_table(make, got):
    text = " ".join(f"n{k}" for k in range(30))
    rows = [(3, text), (3, text), (None, text + " more"), (None, "alone " * 3), (None, None)]
    out = got(jaccard_join.near_groups(make(rows)), "doc_id", "component_id")
    assert out == sorted([(3, 3), (3, 3), (None, 3), (None, None), (None, None)], key=repr)
    assert jaccard_join.near_groups(make([])).count() == 0


def test_rows_that_stay(make, got):
    text = " ".join(f"n{k}" for k in range(30))
    rows = [(5, text), (3, text + " end"), (3, text + " end"), (7, "other words here"), (8, None), (9, ""), (None, text)]
    df = make(rows, extra=True)
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert got(kept, "doc_id") == [(3,), (7,), (8,), (9,)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=200, unique=True), st.data())
def test_linked_sets_share_a_signature(numbers, data):
    drop = data.draw(st.integers(0, max(0, len(numbers) // 7)))
    add = data.draw(st.lists(st.integers(10**6 + 1, 10**7), max_size=max(0, len(numbers) // 7 - drop), unique=True))
    one = set(numbers)
    two = set(numbers[drop:]) | set(add)
    if not two or 4 * len(one & two) < 3 * len(one | two):
        return
    hashed = [np.sort(jaccard_join.mixed(np.array(sorted(s), np.uint64))) for s in (one, two)]
    value, start = np.concatenate(hashed), np.cumsum([0, len(one), len(two)])
    for common in (np.zeros(0, np.uint64), np.sort(hashed[0][::3])):
        name, owner, _, slack = signatures(value, start, common)
        of = [dict(zip(name[owner == i].tolist(), slack[owner == i].tolist(), strict=True)) for i in (0, 1)]
        assert any(of[0][x] + of[1][x] <= 0 for x in set(of[0]) & set(of[1]))
    sketches = short_sketches(value, start)
    assert hamming(*sketches) <= len(one ^ two)


def test_blocks_of_several_shingles_do_not_rule_a_link_out():
    """1,024 blocks; c and a1 share one, which is a single difference of the two sets."""
    at = lambda block, low: (block << 54) + low
    frequent = [at(600 + k, 7) for k in range(17)]
    c, a1, a2 = at(500, 1), at(500, 2), at(1, 3)
    one, two = {*frequent, c, a1, a2}, {*frequent, c, *(at(k, 4) for k in range(2, 6))}
    assert (len(one), len(two), len(one & two), len(one | two)) == (20, 22, 18, 24)
    sets = [np.sort(np.array(sorted(s), np.uint64)) for s in (one, two)]
    name, owner, _, slack = signatures(np.concatenate(sets), np.array([0, 20, 42]), np.array(frequent, np.uint64))
    of = [dict(zip(name[owner == i].tolist(), slack[owner == i].tolist(), strict=True)) for i in (0, 1)]
    assert any(of[0][s] + of[1][s] <= 0 for s in set(of[0]) & set(of[1]))


def test_sets_equal_plain_sets():
    texts = [t for _, t in near_copies(2, 40)] + ["", None, "a", "a b c d", "a b c d e", "x " * 50, "\xa0a b"]
    value, start = Shingler().sets(texts)
    assert np.diff(start).tolist() == [len(shingles(t)) for t in texts]
