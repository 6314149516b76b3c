"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Candidates are found by patterns and validated: card numbers by the Luhn sum, account
numbers by the length of their country and the remainder by 97, addresses by their
octets, dates by the calendar, with the day first where both orders are possible. What
fails stays as it is. A valid value is permuted within its format under a key, so equal
values stay equal and different values stay different in all documents, and the result
is valid again: card and account numbers get new check digits.

Texts of digits and letters go through a Feistel network on characters: the value is cut
in two halves, and in every round one half is shifted, character by character within
digits, small or capital letters, by a keyed hash of the other. Addresses and dates are
numbers of a rectangle, 65,536 x 65,536 and 189 x 773 days of the 400 years from 1800,
and go through a network that adds in each factor.

Everything is a column expression; a text is cut at its candidates once and put together
again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names, text_or_empty

ROUNDS = 8
DEFAULT_KEY = "set a key of your own"
DAYS = (189, 773)  # factors of the days in 400 years
FIRST_DAY = "1800-01-01"
WALK = 96  # repeated permutations; with 2 of 5 days below 13, more are needed once in 10^21 dates
# Patterns of candidates, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}"
# Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"\b(?=[A-Z]{2}\d{2})(?:" + "|".join(
    rf"(?:{n.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(size - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    for size, n in IBAN_LENGTHS.items()
) + r")\b"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_FIRST = r"(?<![\d./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d/])"
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(?:" + "|".join(f"{m}|{m[:3]}\\.?" if m != "May" else m for m in MONTHS) + "|Sept\\.?)"
WRITTEN = rf"(?<![\d.,/-])\d{{1,2}}(?:st|nd|rd|th)? (?:of )?{MONTH},? \d{{4}}\b|\b(?=[JFMASOND]){MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}\b"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SECRET = r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}\b|\b(?=[0-9A-F]*\d)(?=[0-9A-F]*[A-F])[0-9A-F]{32,128}\b"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{5}))(?![\d-])"
TAX = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
KINDS = {
    "email": EMAIL,
    "iban": IBAN,
    "iso_date": ISO_DATE,
    "day_first": DAY_FIRST,
    "written": WRITTEN,
    "address": ADDRESS,
    "secret": SECRET,
    "card": CARD,
    "tax": TAX,
    "phone": PHONE,
}


def _one_group(pattern: str) -> str:
    """The card pattern's own group needs a number of its own within the alternation."""
    return pattern.replace(r"([ -])", r"(?<gap>[ -])").replace(r"\1", r"\k<gap>")


CANDIDATE = "|".join(f"(?:{_one_group(p)})" for p in KINDS.values())


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{KINDS[kind]})$")


def _hash_number(key: str, step: Column, other: Column, modulus: int) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), step.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(modulus))


def permute_pair(first: Column, second: Column, sizes: tuple[int, int], key: str) -> Column:
    """A permutation of the rectangle ``sizes`` as a struct of two numbers ``l`` and ``r``."""
    start = F.struct(first.cast("long").alias("l"), second.cast("long").alias("r"))

    def both(state: Column, step: Column) -> Column:
        left = F.pmod(state["l"] + _hash_number(key, step, state["r"], sizes[0]), F.lit(sizes[0]))
        return F.struct(left.alias("l"), state["r"].alias("r"))

    def other(state: Column, step: Column) -> Column:
        right = F.pmod(state["r"] + _hash_number(key, step, state["l"], sizes[1]), F.lit(sizes[1]))
        return F.struct(state["l"].alias("l"), right.alias("r"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda state, step: F.when(step % 2 == 0, both(state, step)).otherwise(other(state, step)),
    )


def _shift(half: Column, other: Column, step: Column, key: str, letters: bool) -> Column:
    """Every character moved within its own kind by the keyed hash of the other half."""
    seed = F.concat_ws("|", F.lit(key), step.cast("string"), other)
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|more")), 512))

    def moved(char: Column, place: Column) -> Column:
        # 64 amounts of 16 bits; longer halves begin anew, which is a permutation still.
        amount = F.conv(F.substr(stream, F.pmod(place, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(char)
        turned = lambda low, n: F.chr(F.lit(low) + F.pmod(code - low + amount, F.lit(n)))
        digit = char.rlike("^[0-9]$")
        out = F.when(digit, turned(48, 10))
        if letters:
            out = out.when(char.rlike("^[a-z]$"), turned(97, 26)).when(char.rlike("^[A-Z]$"), turned(65, 26))
        return out.otherwise(char)

    return F.array_join(F.transform(F.split(half, ""), moved), "")


def permute_text(value: Column, key: str, letters: bool) -> Column:
    """A permutation of all texts with the same kinds of characters at the same places."""
    cut_at = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substr(value, F.lit(1), cut_at).alias("l"),
        F.substr(value, cut_at + 1, F.length(value)).alias("r"),
    )

    def step(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, _shift(state["l"], state["r"], number, key, letters)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(_shift(state["r"], state["l"], number, key, letters)).alias("r"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(done["l"], done["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits; the last digit counts once."""
    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * F.when(pair["i"] % 2 == 1, 2).otherwise(1)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    placed = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))
    )
    return F.aggregate(placed, F.lit(0), add)


def valid_card(value: Column) -> Column:
    return _is(value, "card") & (luhn_sum(_digits(value)) % 10 == 0)


def remainder_97(value: Column) -> Column:
    """Remainder by 97 of a text in which letters count as 10 to 35."""
    def add(left: Column, char: Column) -> Column:
        return F.when(char.rlike("^[0-9]$"), (left * 10 + F.ascii(char) - 48) % 97).otherwise(
            (left * 100 + F.ascii(char) - 55) % 97
        )

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def _moved_to_end(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    return F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))


def valid_iban(value: Column) -> Column:
    return _is(value, "iban") & (remainder_97(_moved_to_end(value)) == 1)


def _after_four(value: Column) -> Column:
    return F.regexp_replace(F.substr(value, F.lit(5), F.length(value)), "^ ", "")


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.cast("int"))


def valid_address(value: Column) -> Column:
    return _is(value, "address") & F.forall(_octets(value), lambda o: o.between(0, 255))


def _month_number(value: Column) -> Column:
    """The month that a written date names."""
    short = F.regexp_extract(value, "(" + "|".join(m[:3] for m in MONTHS) + ")", 1)
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short)


def _as_date(value: Column, kind: str) -> Column:
    if kind == "iso_date":
        return F.try_to_date(value, "yyyy-MM-dd")
    year = F.regexp_extract(value, r"(\d{4})$", 1)
    if kind == "written":
        day = F.regexp_extract(value, r"(?:^|[^\d])(\d{1,2})(?!\d)", 1)
        return F.try_to_date(F.concat_ws("-", year, _month_number(value).cast("string"), day), "yyyy-M-d")
    plain = F.regexp_replace(value, "/", ".")
    return F.coalesce(F.try_to_date(plain, "d.M.yyyy"), F.try_to_date(plain, "M.d.yyyy"))


def _days(value: Column, kind: str) -> Column:
    return F.datediff(_as_date(value, kind), F.lit(FIRST_DAY).cast("date"))


def valid_date(value: Column, kind: str) -> Column:
    return _is(value, kind) & F.coalesce(_days(value, kind).between(0, DAYS[0] * DAYS[1] - 1), F.lit(False))


def _put_back(value: Column, new: Column, kept: str) -> Column:
    """The characters ``new`` in place of those of ``value`` that match, with all others between."""
    return F.array_join(
        F.zip_with(F.split(value, kept), F.split(new, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), ""
    )


def _new_card(value: Column, key: str) -> Column:
    """The digits permuted as one number, so spellings of one card stay linked; a new check digit."""
    digits = _digits(value)
    new = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), f"{key}|card", letters=False)
    check = (F.lit(10) - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
    return _put_back(value, F.concat(new, check.cast("string")), "[0-9]")


def _new_iban(value: Column, key: str) -> Column:
    """All behind the check digits permuted without its spaces; country kept, new check digits."""
    plain = F.regexp_replace(value, " ", "")
    country = F.substr(plain, F.lit(1), F.lit(2))
    new = permute_text(F.substr(plain, F.lit(5), F.length(plain)), f"{key}|iban", letters=True)
    check = F.lit(98) - remainder_97(F.concat(new, country, F.lit("00")))
    return _put_back(value, F.concat(country, F.lpad(check.cast("string"), 2, "0"), new), "[A-Z0-9]")


def _new_address(value: Column, key: str) -> Column:
    o = _octets(value)
    done = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), f"{key}|address")
    octets = F.array(F.floor(done["l"] / 256), done["l"] % 256, F.floor(done["r"] / 256), done["r"] % 256)
    return F.array_join(F.transform(octets, lambda x: x.cast("string")), ".")


def _new_date(value: Column, kind: str, key: str) -> Column:
    days = _days(value, kind)
    again = lambda one, two: permute_pair(one, two, DAYS, f"{key}|date")
    dated = lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))
    # Days above 12 go to such days and others to others, for every spelling alike: so a date
    # with the month first stays one that cannot be read with the day first.
    late = F.dayofmonth(_as_date(value, kind)) > 12
    start = again(F.floor(days / DAYS[1]), days % DAYS[1])
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), start, lambda p, _: F.when((F.dayofmonth(dated(p)) > 12) == late, p).otherwise(again(p["l"], p["r"]))
    )
    month_first = F.try_to_date(F.regexp_replace(value, "/", "."), "d.M.yyyy").isNull()
    date = dated(done)
    if kind == "iso_date":
        return F.date_format(date, "yyyy-MM-dd")
    if kind == "written":
        return _date_like(value, date)
    first, second = F.regexp_extract(value, r"^\d+(.)", 1), F.regexp_extract(value, r"(.)\d{4}$", 1)
    # The parts keep their order; a part of one digit stays one where the new number allows it.
    widths = [F.length(F.regexp_extract(value, r, 1)) for r in (r"^(\d+)", r"^\d+.(\d+)")]
    parts = [F.date_format(date, "d"), F.date_format(date, "M")]
    swapped = [F.when(month_first, parts[1]).otherwise(parts[0]), F.when(month_first, parts[0]).otherwise(parts[1])]
    one, two = (F.when(w == 2, F.lpad(x, 2, "0")).otherwise(x) for w, x in zip(widths, swapped, strict=True))
    return F.concat(one, first, two, second, F.date_format(date, "yyyy"))


def _date_like(value: Column, date: Column) -> Column:
    """The date written like ``value``: with the same words, in the same order."""
    names, shorts = F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(m[:3]) for m in MONTHS])
    old = F.regexp_extract(value, "([A-Z][a-z]+)", 1)
    month = F.when(F.array_contains(names, old), F.get(names, F.month(date) - 1)).otherwise(F.get(shorts, F.month(date) - 1))
    day = F.dayofmonth(date)
    ending = F.when(day.between(11, 13), "th").otherwise(
        F.when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    )
    number = F.when(value.rlike(r"\d(?:st|nd|rd|th)"), F.concat(day.cast("string"), ending)).otherwise(day.cast("string"))
    dated = F.regexp_replace(value, r"(?<!\d)\d{1,2}(?:st|nd|rd|th)?(?!\d)", "#")
    dated = F.regexp_replace(dated, r"\d{4}$", "~")
    dated = F.replace(dated, old, month)
    return F.replace(F.replace(dated, F.lit("#"), number), F.lit("~"), F.date_format(date, "yyyy"))


def _new_phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 0)
    rest = F.substr(value, F.length(country) + 1, F.length(value))
    return F.concat(country, _in_place(rest, f"{key}|phone"))


def _in_place(value: Column, key: str) -> Column:
    """The digits permuted as one number, whatever stands between them, and put back."""
    return _put_back(value, permute_text(_digits(value), key, letters=False), "[0-9]")


def _new_email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.length(local) + 1, F.length(value))
    return F.concat(permute_text(local, f"{key}|email", letters=True), domain)


def _new_secret(value: Column, key: str) -> Column:
    """Digits stay digits and letters from a to f stay such: 10 and 6 in a circle."""
    new = permute_text(value, f"{key}|secret", letters=False)
    # Letters move by a keyed hash of the digits, which are known again afterwards.
    stream = F.sha2(F.concat(F.lit(key), F.lit("|letters|"), F.regexp_replace(new, "[^0-9]", "")), 512)

    def moved(char: Column, place: Column) -> Column:
        amount = F.conv(F.substr(stream, F.pmod(place, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        low = F.when(char.rlike("^[a-f]$"), 97).otherwise(65)
        return F.when(char.rlike("^[0-9]$"), char).otherwise(F.chr(low + F.pmod(F.ascii(char) - low + amount, F.lit(6))))

    return F.array_join(F.transform(F.split(new, ""), moved), "")


def pseudonym(value: Column, key: str) -> tuple[Column, Column]:
    """(the value's pseudonym, its kind); both null where it is not valid."""
    rules: list[tuple[str, Column, Callable[[], Column]]] = [
        ("email", _is(value, "email"), lambda: _new_email(value, key)),
        ("iban", valid_iban(value), lambda: _new_iban(value, key)),
        ("date", valid_date(value, "iso_date"), lambda: _new_date(value, "iso_date", key)),
        ("date", valid_date(value, "day_first"), lambda: _new_date(value, "day_first", key)),
        ("date", valid_date(value, "written"), lambda: _new_date(value, "written", key)),
        ("address", valid_address(value), lambda: _new_address(value, key)),
        ("secret", _is(value, "secret"), lambda: _new_secret(value, key)),
        ("card", valid_card(value), lambda: _new_card(value, key)),
        # A card behind a word of four characters that made it look like an account number.
        ("card", _is(value, "iban") & value.rlike("^.{4} ") & valid_card(_after_four(value)), lambda: F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(_after_four(value))), _new_card(_after_four(value), key))),
        ("tax", _is(value, "tax"), lambda: _in_place(value, f"{key}|tax")),
        ("phone", _is(value, "phone"), lambda: _new_phone(value, key)),
    ]
    name, valid, new = rules[0]
    kind, made = F.when(valid, name), F.when(valid, new())
    for name, valid, new in rules[1:]:
        kind, made = kind.when(valid, name), made.when(valid, new())
    return made, kind


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, kinds, n_values`` per row: the text with its pseudonyms.

    ``kinds`` holds the kind of every value in text order, as an array. Null text gives
    empty text without values. Ids, nulls and repeated rows pass through; an empty table
    gives an empty result; further columns are ignored. The key is a secret of the user.
    """
    found = own_names(docs, doc_id, text).select(
        doc_id,
        text_or_empty(text).alias("text"),
        F.regexp_extract_all(text_or_empty(text), F.lit(CANDIDATE), F.lit(0)).alias("found"),
    )

    def told(value: Column) -> Column:
        new, kind = pseudonym(value, key)
        return F.struct(F.coalesce(new, value).alias("new"), kind.alias("kind"))

    named = found.withColumn("told", F.transform("found", told))
    gaps = F.split("text", CANDIDATE)
    whole = F.array_join(
        F.zip_with(gaps, F.col("told"), lambda gap, t: F.concat(gap, F.coalesce(t["new"], F.lit("")))), ""
    )
    kinds = F.filter(F.transform("told", lambda t: t["kind"]), lambda k: k.isNotNull())
    return named.select(
        doc_id,
        F.when(F.size("found") == 0, F.col("text")).otherwise(whole).alias("text"),
        kinds.alias("kinds"),
        F.size(kinds).alias("n_values"),
    )
