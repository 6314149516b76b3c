import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import line_dedup
from sitewatch.llm.line_dedup import EDITS, FUZZY_FROM, Keys, allowed, edit_distances, line_marks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, line, edits):
    out = list(line)
    for _ in range(edits):
        place, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out.insert(place, rnd.choice("xyz é"))
        elif kind == 1:
            out.pop(place)
        else:
            out[place] = rnd.choice("xyz é")
    return "".join(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.text("ab", max_size=40)), min_size=1, max_size=8))
def test_banded_distance(pairs):
    found = edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), d in zip(pairs, found, strict=True):
        assert min(d, EDITS + 1) == min(distance(a, b), EDITS + 1)


def test_lines_within_the_threshold_share_a_key_and_have_near_marks():
    rnd, keys = random.Random(2), Keys()
    for _ in range(3000):
        line = "".join(rnd.choices("abc ", k=rnd.randint(FUZZY_FROM, 90)))
        other = edited(rnd, line, rnd.randint(0, EDITS))
        most = allowed(min(len(line), len(other)))
        if distance(line, other) <= most and min(len(line), len(other)) >= FUZZY_FROM:
            assert keys.of(line) & keys.of(other)
            one, two = line_marks([line, other])
            assert sum(((x ^ y) % 2**64).bit_count() for x, y in zip(one.tolist(), two.tolist(), strict=True)) <= 4 * most


def test_short_lines_take_part(make, got):
    rows = [(1, "All rights reserved."), (2, "All rights reserved"), (3, "all rights reserve"), (4, "short one"), (5, "short on")]
    assert got(line_dedup.repeated_lines(make(rows)), "doc_id", "n_dropped") == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0)]


def brute(rows):
    """Places that go, per id."""
    told = [
        (i, place, line)
        for i, t in rows
        for place, line in enumerate((t or "").split("\n"))
        if line.encode().split()
    ]
    group = list(range(len(told)))
    for x in range(len(told)):
        for y in range(x):
            a, b = told[x][2], told[y][2]
            most = 2 if min(len(a), len(b)) >= 40 else 1 if min(len(a), len(b)) >= 10 else 0
            near = a == b or (abs(len(a) - len(b)) <= most and distance(a, b) <= most)
            if near and group[x] != group[y]:
                old = group[x]
                group = [group[y] if g == old else g for g in group]
    first = {}
    for g, (i, place, _) in zip(group, told, strict=True):
        first[g] = min(first.get(g, (i, place)), (i, place))
    gone = {}
    for g, (i, place, _) in zip(group, told, strict=True):
        if (i, place) != first[g]:
            gone.setdefault(i, set()).add(place)
    return sorted((i, len((t or "").split("\n")), len(gone.get(i, ())), sorted(gone.get(i, ()))) for i, t in rows)


def table(seed, n):
    rnd = random.Random(seed)
    lines, rows = [], []
    for i in range(n):
        own = []
        for _ in range(rnd.randint(0, 4)):
            if lines and rnd.random() < 0.5:
                line = edited(rnd, rnd.choice(lines), rnd.randint(0, 3))
            else:
                line = "".join(rnd.choices("abcdefgh ", k=rnd.choice([3, 10, 39, 41, 60, 100])))
                lines.append(line)
            own.append(line)
        rows.append((i, "\n".join(own)))
    return rows


def test_lines_that_go(make, got):
    rows = table(3, 90) + [(500, None), (501, ""), (502, "\n\n x\n"), (503, " x")]
    assert got(line_dedup.repeated_lines(make(rows, extra=True))) == sorted(brute(rows), key=repr)


def test_hot_line_and_many_near_lines(make, got):
    rnd = random.Random(6)
    base = "the same long line of text that a third of all documents carry"
    rows = [(i, base if i % 3 else edited(rnd, base, 1)) for i in range(150)]
    assert got(line_dedup.repeated_lines(make(rows))) == sorted(brute(rows), key=repr)


def test_texts_without_the_lines(make, got):
    line = "a line of more than forty characters, which two documents have"
    rows = [(1, f"{line}\nfirst\n\n"), (2, f"second\n{line}!"), (None, line), (3, None), (3, None), (4, "first")]
    df = make(rows, extra=True)
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns
    want = [(1, f"{line}\nfirst\n\n"), (2, "second"), (None, ""), (3, None), (3, None), (4, "")]
    assert got(out, "doc_id", "text") == sorted(want, key=repr)
    assert line_dedup.repeated_lines(make([])).count() == 0
