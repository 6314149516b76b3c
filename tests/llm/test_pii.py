import datetime
import re

import pytest
from pyspark.sql import functions as F

from sitewatch.llm import pii

CARD, OTHER = "4485275742308327", "4485275742308328"
IBAN = "DE89370400440532013000"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def run(make, texts):
    return {r["doc_id"]: r for r in pii.pseudonymised(make(list(enumerate(texts)))).collect()}


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        (CARD, "card"),
        ("4485-2757-4230-8327", "card"),
        (IBAN, "iban"),
        ("DE89 3704 0044 0532 0130 00", "iban"),
        ("192.168.0.255", "address"),
        ("2024-02-29", "date"),
        ("31.12.1999", "date"),
        ("01/02/2003", "date"),
        ("jo.smith99@mail.example.com", "email"),
        ("+1 (555) 123-4567", "phone"),
        ("123-45-6789", "tax"),
        ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret"),
    ],
)
def test_valid_values_change_within_their_format(make, value, kind):
    out = run(make, [f"see {value}, and {value}!", f"({value})"])
    assert list(out[0]["kinds"]) == [kind, kind] and out[0]["n_values"] == 2
    new = re.fullmatch(r"see (.*), and (.*)!", out[0]["text"])
    assert new[1] == new[2] != value and out[1]["text"] == f"({new[1]})"
    shape = lambda v: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
    if kind != "address":
        assert shape(new[1]) == shape(value)
    if kind == "card":
        assert luhn(re.sub("[^0-9]", "", new[1]))
    if kind == "iban":
        plain = new[1].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@pytest.mark.parametrize(
    "text",
    ["", OTHER, "DE89370400440532013001", "999.1.1.1", "1.2.3.4.5", "2023-02-29", "31.02.2000", "no@mail", "12345", "a" * 40, "1" * 40, "version 2.0."],
)
def test_what_is_not_valid_stays(make, text):
    out = run(make, [text])
    assert out[0]["text"] == text and out[0]["n_values"] == 0


def test_values_before_capital_words_and_numbers(make):
    rows = [
        ("BE68539007547034", " A few", "iban"),
        ("AT611904300234573201", " I paid", "iban"),
        ("BE68 5390 0754 7034", " 2024 was", "iban"),
        ("3782-822463-10005", " A 12", "card"),
        ("12/25/1990", " A 12", "date"),
        ("5.3.1990", " A 12", "date"),
        ("3 March 1990", " A 12", "date"),
        ("Dec. 25th, 1990", " A 12", "date"),
        ("AT61 4485 2757 4230 8327", " A 12", "card"),
    ]
    out = run(make, [f"on {value}{rest}" for value, rest, _ in rows])
    again = run(make, [out[i]["text"] for i in range(len(rows))])
    for i, (value, rest, kind) in enumerate(rows):
        assert list(out[i]["kinds"]) == list(again[i]["kinds"]) == [kind]
        assert value not in out[i]["text"] and out[i]["text"].startswith("on ") and out[i]["text"].endswith(rest)


def test_numbers_are_permuted(spark):
    df = spark.range(189 * 773).select(
        pii.permute_pair(F.floor(F.col("id") / 773), F.col("id") % 773, (189, 773), "k").alias("p")
    )
    assert df.distinct().count() == 189 * 773
    texts = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("t"))
    out = texts.select(pii.permute_text(F.col("t"), "k", letters=False).alias("n"))
    assert out.distinct().count() == 10_000 and out.where("n rlike '^[0-9]{4}$'").count() == 10_000


def test_keys_differ(make):
    df = make([(1, CARD)])
    assert pii.pseudonymised(df, "a").first()["text"] != pii.pseudonymised(df, "b").first()["text"]


def test_nulls_repeated_rows_long_and_empty(make):
    long = "x" * 300_000 + f" {CARD} " + "y." * 100_000
    df = make([(1, None), (None, CARD), (2, "t"), (2, "t"), (3, long)], extra=True)
    out = pii.pseudonymised(df).collect()
    assert sorted(((r["doc_id"], r["n_values"]) for r in out), key=repr) == sorted(
        [(1, 0), (None, 1), (2, 0), (2, 0), (3, 1)], key=repr
    )
    told = next(r["text"] for r in out if r["doc_id"] == 3)
    assert len(told) == len(long) and told[:300_001] == long[:300_001]
    assert pii.pseudonymised(make([])).count() == 0


def test_spellings_of_one_value_stay_linked(make):
    rows = [
        (1, "4111 1111 1111 1111"), (2, "4111-1111-1111-1111"), (3, "4111111111111111"),
        (4, "GB82WEST12345698765432"), (5, "GB82 WEST 1234 5698 7654 32"),
        (6, "1990-12-25"), (7, "25.12.1990"), (8, "12/25/1990"), (9, "25 December 1990"), (10, "Dec 25, 1990"),
        (11, "1990-12-05"), (12, "5.12.1990"), (13, "December 5th, 1990"), (14, "call +44 20 7946 0958 now"),
    ]
    got = {r["doc_id"]: (r["text"], r["kinds"]) for r in pii.pseudonymised(make(rows), "k").collect()}
    assert all(kinds for _, kinds in got.values())
    plain = {i: re.sub("[ -]", "", got[i][0]) for i in range(1, 6)}
    assert len({plain[1], plain[2], plain[3]}) == 1 and plain[4] == plain[5]
    assert plain[1] != "4111111111111111" and got[2][0][4] == "-" and got[5][0][:2] == "GB" and got[5][0][4] == " "

    def day(i):
        text = re.sub(r"(?<=\d)(st|nd|rd|th)", "", got[i][0])
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y"):
            try:
                return datetime.datetime.strptime(text, form).date()
            except ValueError:
                pass
        raise AssertionError(text)

    assert len({day(i) for i in range(6, 11)}) == 1 and day(6) != datetime.date(1990, 12, 25) and day(6).day > 12
    assert len({day(i) for i in range(11, 14)}) == 1 and day(11).day <= 12
    assert "7946" not in got[14][0]


def test_dates_are_permuted_within_their_class(spark, make):
    first = datetime.date(2001, 1, 1)
    days = [first + datetime.timedelta(d) for d in range(400)]
    got = [r["text"] for r in pii.pseudonymised(make([(i, d.isoformat()) for i, d in enumerate(days)]), "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(days)
    assert all((int(g[8:]) > 12) == (d.day > 12) for g, d in zip(got, days, strict=True))
