"""URL rules: host suffixes and path prefixes looked up by hash.

A rule fits its host and every subdomain, if the path of a URL starts with the rule's. So
each URL is expanded into the expressions *last k labels of the host + first m characters
of the path*, for those shapes ``(k, m)`` only that some rule has. Expressions meet rules
in an equi-join on the first 32 bits of their SHA-256; what meets is confirmed by the full
digest and by the texts, and of the rules that fit the longest one decides.

Everything is column expressions and joins.

Defined results: a null URL and one without ``://`` have an empty host and path, fit no
rule and get the default verdict. The host is what stands between ``://`` and the next
``/``, ``?``, ``#`` or the end, so a user name or a port belong to it; only A-Z are lowered.
Rules with a null host or path are left out; a rule that is given twice counts once; if one
place is both allowed and blocked, it is blocked. Longer means: more characters of host and path
together, then of the host. A row that occurs n times comes back n times. Other columns,
whatever their names, do not matter. Empty tables give empty results; without rules every
URL gets the default verdict. Ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names
from sitewatch.operators.checkpoints import cut

ALLOW, BLOCK = "allow", "block"
#: Rules up to this number are sent to all executors (some 100 bytes each).
BROADCAST_RULES = 200_000
#: A larger rule table is joined by shuffle; a frequent expression then goes to so many tasks.
SPREAD = 32
#: Repeated rows are given back in steps of so many.
STEP = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (verdict, host, path) triples as a table; long ones are read from files."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    listed = F.array(*rows).cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(listed))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\.", -1))


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per place: its text, digest, shape and whether it blocks."""
    places = (
        own_names(rules, "verdict", "host", "path")
        .where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", (F.col("verdict") == BLOCK).alias("blocks"))
        .groupBy("host", "path")
        .agg(F.max("blocks").alias("blocks"))
    )
    return places.select(
        "host", "path", "blocks", _labels(F.col("host")).alias("k"), F.length("path").alias("m"), _digest(F.col("host"), F.col("path")).alias("digest")
    )


def _expanded(urls: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every URL with the expressions of the shapes that it is long enough for.

    Shapes are pairs of a number of labels and a length. They are packed into one row of
    arrays, so they stay as small as host names and rule paths are long. One row without
    an expression stands for the URL itself.
    """
    itself = F.array(F.lit(None).cast("struct<x_host:string,x_path:string>"))
    packed = shapes.agg(F.collect_set(F.struct("k", "m")).alias("shapes"))
    fitting = F.filter("shapes", lambda s: (s["k"] <= F.col("n_labels")) & (s["m"] <= F.col("n_path")))
    expressions = F.transform(
        fitting,
        lambda s: F.struct(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["k"]).alias("x_host"),
            F.substring(F.col("path"), F.lit(1), s["m"]).alias("x_path"),
        ),
    )
    wide = urls.withColumns({"n_labels": _labels(F.col("host")), "n_path": F.length("path")})
    return (
        wide.join(F.broadcast(packed))  # one row
        .select("id", "host", "path", F.explode(F.concat(itself, expressions)).alias("x"))
        .select("id", "host", "path", "x.x_host", "x.x_path")
        .withColumn("digest", _digest(F.col("x_host"), F.col("x_path")))
        .withColumn("prefix", _prefix(F.col("digest")))
    )


def _matched(expressions: DataFrame, rules: DataFrame, broadcast_rules: int) -> DataFrame:
    """Expressions with the weight of the rule they are; the short prefix finds it, the rest confirms.

    The weight orders rules and says how many characters of host and path they take.
    """
    known = rules.select(
        _prefix(F.col("digest")).alias("r_prefix"),
        F.col("digest").alias("r_digest"),
        F.col("host").alias("r_host"),
        F.col("path").alias("r_path"),
        (
            F.shiftleft((F.length("host") + F.length("path")).cast("long"), 32)
            + F.shiftleft(F.length("host").cast("long"), 1)
            + F.col("blocks").cast("long")
        ).alias("r_weight"),
    )
    confirmed = (
        (F.col("digest") == F.col("r_digest")) & (F.col("x_host") == F.col("r_host")) & (F.col("x_path") == F.col("r_path"))
    )
    kept = ["id", "host", "path", F.col("x_host").isNull().alias("itself"), F.when(confirmed, F.col("r_weight")).alias("weight")]
    if rules.count() <= broadcast_rules:
        return expressions.join(F.broadcast(known), F.col("prefix") == F.col("r_prefix"), "left").select(*kept)
    # Each rule visits all spreads; the rows of a frequent expression are dealt over them.
    visiting = known.withColumn("r_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = expressions.where("x_host is not null").withColumn(
        "spread", F.pmod(F.xxhash64("id", "host", "path"), F.lit(SPREAD)).cast("int")
    )
    met = dealt.join(visiting, (F.col("prefix") == F.col("r_prefix")) & (F.col("spread") == F.col("r_spread"))).select(*kept)
    alone = expressions.where("x_host is null").select("id", "host", "path", F.lit(True).alias("itself"), F.lit(None).cast("long").alias("weight"))
    return met.unionByName(alone)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = ALLOW,
    id_column: str = "page_id",
    url_column: str = "url",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Per row: id, ``host, path, rule, verdict``.

    The best rule is a maximum, so the expressions of a URL are combined in the task that
    made them and one small row per URL is shuffled, dealt by id and URL.
    """
    known = cut(_prepared(rules), "url_rules")
    urls = own_names(pages, id_column, url_column).select(
        F.col(f"`{id_column}`").alias("id"),
        url_host(F.col(f"`{url_column}`")).alias("host"),
        url_path(F.col(f"`{url_column}`")).alias("path"),
    )
    met = _matched(_expanded(urls, known.select("k", "m").distinct()), known, broadcast_rules)
    best = met.groupBy("id", "host", "path").agg(F.count_if("itself").alias("times"), F.max("weight").alias("best"))
    of_host = F.shiftright(F.col("best").bitwiseAND(F.lit(2**32 - 1)), 1).cast("int")
    of_path = F.shiftright("best", 32).cast("int") - of_host
    rule = F.concat(F.right("host", of_host), F.substring("path", F.lit(1), of_path))
    verdict = (
        F.when(F.col("best").isNull(), F.lit(default))
        .when(F.col("best").bitwiseAND(F.lit(1)) == 1, F.lit(BLOCK))
        .otherwise(F.lit(ALLOW))
    )
    out = best.select(F.col("id").alias(id_column), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "times")
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(STEP).cast("long")))
    again = F.explode(F.sequence(F.col("step"), F.least(F.col("times"), F.col("step") + STEP - 1)))
    return out.withColumn("step", steps).withColumn("again", again).drop("times", "step", "again")


def drop_blocked(pages: DataFrame, rules: DataFrame, default: str = ALLOW, url_column: str = "url") -> DataFrame:
    """The whole rows whose URL is allowed.

    Every distinct URL is judged once and the blocked (or, by default blocked, the allowed)
    ones are joined to the pages, whose texts are not aggregated.
    """
    distinct = own_names(pages, url_column).select(F.col(f"`{url_column}`").alias("id")).distinct()
    judged = judge_urls(distinct.withColumn("url", F.col("id")), rules, default, "id", "url")
    listed = judged.where(F.col("verdict") != default).select(F.col("id").alias("_listed_url"))
    on = F.col(f"`{url_column}`").eqNullSafe(F.col("_listed_url"))
    return pages.join(listed, on, "left_anti" if default == ALLOW else "left_semi")
