import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import html
from sitewatch.llm.html import blocks, common_lines


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_longest_common_subsequence(a, b):
    at = common_lines(a, b)
    assert len(at) == lcs(a, b) and at == sorted(set(at))
    rest = iter(b)
    assert all(a[i] in rest for i in at)


def text(page):
    return [t for t, _ in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain & simple", ["plain & simple"]),
        ("<p>a<b>b</b> c<br>d</p><p> x\n\t y </p>", ["ab c d", "x y"]),
        ("<p>1 &lt; 2 &amp;amp; &#233;&copy &middot;</p>", ["1 < 2 &amp; é© ·"]),
        ("<script>if (a<b) x('</p>')</script><style>p{}</style><p>t</p>", ["t"]),
        ("<script>never closed <p>x</p>", []),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", ["yes"]),
        ("<nav><ul><li>menu</ul></nav><p>t</p><footer><p>f</p></footer>", ["t"]),
        ("<div class=\"ad\"><div>x</div>y</div>t", ["t"]),
        ("<div class='post-comments'><p>c</p></div><p>t</p>", ["t"]),
        ("<div class=ad><p>never closed<article><p>t</p></article>", ["t"]),
        ("<p title='a > b'>t</p><p title=\"x>y\">u", ["t", "u"]),
        ("<p class=\"broken>t</p>", ["t"]),
        ("<h1>H</h1><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", ["H", "one", "two", "a", "b"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<p>cut &am", ["cut &am"]),
        ("<form><p>f</p></form><aside>s</aside><header>h</header>t", ["t"]),
        ("<span class=share>s</span>t<p>u</p>", ["t", "u"]),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_long_and_deep_pages_take_linear_time():
    assert len(text("<div>" * 20000 + "x")) == 1
    assert len(text("<p>x</p>" * 20000)) == 20000


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_shared_lines_go_and_articles_stay(spark):
    shell = "<p>Site name</p><p>Open menu</p>{}<p>All rights reserved</p>"
    art = "<p>Site name</p><article><p>{}</p><p>same passage</p></article><p>Imprint</p>"
    rows = [
        (1, "http://a.example/p/10", shell.format("<p>first story</p>")),
        (2, "http://a.example/p/11?x=1", shell.format("<p>second story</p>")),
        (3, "https://www.a.example/q/500", art.format("third")),
        (4, "https://www.a.example/q/501", art.format("fourth")),
        (5, "http://alone.example/", "<p>only page</p>"),
        (6, "http://copy.example/1", "<p>a copy</p>"),
        (7, "http://copy.example/2", "<p>a copy</p>"),
        (8, None, None),
        (None, None, ""),
        (9, "http://a.example/p/9", shell.format("<p>repeated row</p>")),
        (9, "http://a.example/p/9", shell.format("<p>repeated row</p>")),
    ]
    from pyspark.sql import functions as F

    df = pages(spark, rows).withColumns({"lines": F.lit(1), "_key": F.lit(2), "place": F.lit(3), "host": F.lit("h")})
    out = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect()), key=repr)
    want = {
        1: "first story", 2: "second story", 3: "third\n\nsame passage", 4: "fourth\n\nsame passage",
        5: "only page", 6: "a copy", 7: "a copy", 8: "", None: "", 9: "repeated row",
    }
    assert out == sorted(((i, want[i], len(want[i])) for i, _, _ in rows), key=repr)
    assert html.main_text(pages(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div id=story><h1>H</h1><p>s</p></div><article class=teaser><p>t</p></article><article><p>u</p></article>", [("H", False), ("s", False), ("t", False), ("u", False)]),
        ("<p>o</p><article><h1>H</h1><p>s</p></article><article class=comment><p>c</p></article>", [("o", False), ("H", True), ("s", True)]),
        ("<div class='layout has-sidebar'><p>s</p></div>", [("s", False)]),
        ("<div class=banner><main><p>s</p></main></div>", [("s", True)]),
        ("<aside><article><p>t</p></article></aside><p>s</p>", [("s", False)]),
        ("<form><article><p>s</p></article></form>", [("s", True)]),
        ("<article><h1>H</h1></article><article><p>t</p></article>", [("H", True), ("t", False)]),
    ],
)
def test_articles_are_evidence_and_names_count_as_a_whole(page, want):
    assert blocks(page) == want


def test_differencing_decides_pages_with_articles(spark):
    page = "<p>Site name</p><div><h1>{0}</h1><p>story {0}</p></div><article><p>teaser</p></article><article><p>other</p></article>"
    whole = "<p>Site name</p><p>by {0}</p><article><p>{0}</p><p>same passage</p></article>"
    rows = [(1, "http://a.example/1", page.format("one")), (2, "http://a.example/2", page.format("two")),
            (3, "http://b.example/1", whole.format("three")), (4, "http://b.example/2", whole.format("four"))]
    out = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows)).collect()}
    assert out == {1: "one\n\nstory one", 2: "two\n\nstory two", 3: "by three\n\nthree\n\nsame passage", 4: "by four\n\nfour\n\nsame passage"}


def test_partner_is_the_nearer_neighbour_however_the_table_is_cut(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    urls = [f"http://h{rnd.randint(0, 3)}.example/{rnd.choice('ab')}/{rnd.randint(0, 999)}" for _ in range(120)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "_key long, url string")
    order = sorted(
        df.select("_key", html.host(F.col("url")).alias("h"), html.path(F.col("url")).alias("p")).collect(),
        key=lambda r: (r["h"], r["p"], r["_key"]),
    )

    def near(a, b):
        n = next((i for i, (x, y) in enumerate(zip(a["p"], b["p"], strict=False)) if x != y), None)
        longest = max(len(a["p"]), len(b["p"]))
        return longest + 1 if n is None and len(a["p"]) == len(b["p"]) else (n if n is not None else min(len(a["p"]), len(b["p"]))) + 1

    want = {}
    for i, r in enumerate(order):
        sides = [(near(r, o), before, o["_key"]) for o, before in ((order[i - 1] if i else None, 1), (order[i + 1] if i + 1 < len(order) else None, 0)) if o and o["h"] == r["h"]]
        if sides:
            want[r["_key"]] = max(sides)[2]
    for parts in (1, 7):
        found = {r["_key"]: r["partner"] for r in html.nearest_pages(df.repartition(parts)).collect()}
        assert found == want
