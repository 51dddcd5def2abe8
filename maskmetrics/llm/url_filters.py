"""URL filters by lookups of hashed expressions: DataFrame functions only.

A rule is (host, path, verdict). It fits its host and all subdomains of it, if the URL's path starts with the rule's. Every
URL is expanded into expressions host-suffix + path-prefix; a rule fits exactly if its host + path is one of them. Expressions
meet the rules in an equi-join on the first bits of their SHA-256; the full digest then confirms, and of the rules that fit
the longest wins.

URLs are made distinct before, with partial aggregates, so that a page or host with most of the rows is expanded once. Rules are
broadcast where they are counted to be at most BROADCAST_RULES (under 200 bytes each without their text, of which MAX_RULE
characters are allowed). More rules meet the expressions in a shuffle by hash prefix, where prefixes with more than a task's
even share are joined apart: they are fewer than twice the tasks, and so few rules are broadcast. The same way hot URLs get
their verdicts back without moving their rows.

Precedence: the longest host + path; among equally long ones the longer host; a rule given twice with both verdicts blocks.

Cases: a null URL, or one without "://", has an empty host and path, fits no rule and gets the default verdict. A host is taken
as it stands (port and user included), A-Z lower-cased; an empty path doesn't start with "/". Rules without a host, with a null
verdict or with one that is neither allow nor block are refused; a null path is an empty one. Repeated pages are judged each.
Empty tables give empty results, no rules the default. Columns of the input that are named as the four added ones give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, partitions

ALLOW, BLOCK = "allow", "block"
BROADCAST_RULES = 20_000
MAX_RULE = 4096
#: hexadecimal digits of the digest that the join goes by
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first "://" up to "/", "?", "#" or the end) and the path (up to "?", "#" or the end); both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots, as an array without empty ones."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(every, lambda s: s != "")


def path_prefixes(path: Column, lengths: Column) -> Column:
    """The path's beginnings of the lengths that any rule's path has."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (host, path, verdict) as a table."""
    rows = [F.struct(*(F.lit(x).cast("string").alias(c) for x, c in zip(r, ("host", "path", "verdict")))) for r in rules]
    found = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return found.select("host", "path", "verdict")


def prepared(rules: DataFrame, prefix: int) -> DataFrame:
    """(prefix, digest, rule, verdict, order) of the distinct rules; order is a struct that the winner has the greatest of."""
    host, path = lower(F.col("host")), F.coalesce("path", F.lit(""))
    wrong = F.col("host").isNull() | (F.col("host") == "") | F.col("verdict").isNull() | ~F.col("verdict").isin(ALLOW, BLOCK) | (F.length("host") + F.length(path) > MAX_RULE)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("no rule: "), F.to_json(F.struct("host", "path", "verdict"))))).otherwise(host)
    own = rules.select(checked.alias("host"), path.alias("path"), F.col("verdict")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    rule = F.concat("host", "path")
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return own.select(
        F.substring(digest, 1, prefix).alias("prefix"), digest.alias("digest"), rule.alias("rule"), "verdict", F.length("path").alias("path_length"), F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length")).alias("order")
    )


def expressions(urls: DataFrame, lengths: Column, prefix: int) -> DataFrame:
    """(host, path, prefix, digest) of every expression of the URLs (host, path)."""
    both = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(path_prefixes(F.col("path"), lengths), lambda p: F.concat(h, F.lit("\n"), p))))
    out = urls.select("host", "path", F.explode(both).alias("e")).withColumn("digest", F.sha2("e", 256))
    return out.select("host", "path", F.substring("digest", 1, prefix).alias("prefix"), "digest")


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str, hot: DataFrame) -> DataFrame:
    """left joined with right (how: inner or left); those of left whose keys are in `hot`, few distinct keys, meet their rows of right by a broadcast."""
    few = F.broadcast(hot.select(*on).distinct())
    own = F.broadcast(right.join(few, on, "left_semi"))
    return left.join(few, on, "left_semi").join(own, on, how).unionByName(left.join(few, on, "left_anti").join(right, on, how))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, prefix: int = PREFIX, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule (host + path of the rule that wins, or null) and verdict."""
    tasks = partitions(pages.sparkSession)
    many = lambda counted, total: counted.where(F.col("n") > max(1000, total // tasks))
    host, path = host_and_path(column(url))
    kept = [column(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = prepared(rules, prefix)
    # at most MAX_RULE + 1 numbers
    lengths = sorted(r[0] for r in own.select("path_length").distinct().collect())
    own = own.select("prefix", F.col("digest").alias("full"), "rule", "verdict", "order")
    urls = pages.select(host.alias("host"), path.alias("path")).where(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("n"))
    asked = expressions(urls, F.lit(lengths).cast("array<int>"), prefix)
    if own.limit(broadcast_rules + 1).count() <= broadcast_rules:
        met = asked.join(F.broadcast(own), "prefix")
    else:
        met = meet(asked, own, ["prefix"], "inner", many(asked.groupBy("prefix").agg(F.count("*").alias("n")), asked.count()))
    # confirmed here, not in a filter that would join the join's keys
    confirmed = F.when(F.col("digest") == F.col("full"), F.struct("order", "rule", "verdict"))
    best = met.groupBy("host", "path").agg(F.max(confirmed).alias("best"))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    out = meet(rows, best.select("host", "path", "best.rule", "best.verdict"), ["host", "path"], "left", many(urls, pages.count()))
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
