"""URL filters: pattern rules found through their rarest literal token.

Rules are rows: prefix rules (a host with its subdomains, and a path prefix) and pattern
rules (a regular expression with the literal tokens that any URL it fits must contain).
Every rule is indexed under one of its tokens, the one that occurs in the fewest of the
URLs at hand. The distinct tokens of a URL fetch its candidate rules by an equi-join, and
only those run their regular expressions. The best rule of a URL is a maximum; URLs are
reduced to distinct ones first, so a page repeated a million times is judged once.

DataFrame functions only. No side is broadcast by hint: Spark does so by the size it knows.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no
prefix rule; the default verdict holds where no rule fits. Repeated rows, null ids and
empty tables need no care; of the input only the URL column is looked at and all columns
are kept by ``judge``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

# Verdict, host, path prefix.
BASE_RULES = [
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]

# Rules of the method for URLs that no base rule fits: expression, literal tokens.
PATTERN_RULES = [
    (r"://([^/?#]*[.-])?ads[.-]", ["ads"]),
    (r"://([^/?#]*[.-])?doubleclick[.-]", ["doubleclick"]),
    (r"://([^/?#]*[.-])?casino[.-]", ["casino"]),
    (r"://([^/?#]*[.-])?porn[.-]", ["porn"]),
    (r"/[^?#]*[.]exe([?#]|$)", ["exe"]),
    (r"/[^?#]*[.]zip([?#]|$)", ["zip"]),
    (r"/login([/?#]|$)", ["login"]),
]

RULE = "priority int, length int, rule string, token array<string>, pattern string, verdict string"


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def prefix_rule(verdict: str, rule_host: str, rule_path: str) -> tuple:
    """Fits ``host + path`` where the host is the rule's or below it and the path starts with the rule's."""
    name = rule_host + rule_path
    # Only tokens that a separator closes are sure to be whole tokens of the URL.
    closed = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", name.lower())
    return 1, len(name), name, closed, rf"(?s)\A([^/]*[.])?{re.escape(name)}", verdict


def pattern_rules(rules: list[tuple[str, list[str]]], verdict: str) -> list[tuple]:
    """One row per expression; its tokens must be whole tokens of every URL that it fits."""
    return [(0, len(p), p, t, p, verdict) for p, t in rules]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    if bad := [r[2] for r in rules if not r[3]]:
        raise ValueError(f"rules without a literal token: {bad}")
    return spark.createDataFrame(rules, RULE)


def standard_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [prefix_rule(*r) for r in BASE_RULES] + pattern_rules(PATTERN_RULES, BLOCK))


def _indexed(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Rules with their rarest token, by the number of URLs that contain it (then by name)."""
    listed = rules.withColumn("rule_token", F.explode("token"))
    known = listed.select(F.col("rule_token").alias("t")).distinct()
    # Counted for tokens of rules only, and reduced before the shuffle.
    counts = url_tokens.join(known, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    counted = listed.join(counts, F.col("rule_token") == F.col("t"), "left")
    rarity = F.struct(F.coalesce("n", F.lit(0)), "rule_token")
    return counted.groupBy(*rules.drop("token").columns).agg(F.min(rarity)["rule_token"].alias("t"))


def best_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url``, ``rule``, ``verdict`` of every distinct URL that some rule fits; the best one: prefix
    rules before patterns, then the longest, then by text."""
    u = F.col(url_col)
    distinct = urls.select(u.alias("url")).filter(u.isNotNull()).distinct()
    place = F.concat(host(F.col("url")), path(F.col("url")))
    own = distinct.select("url", place.alias("place"), F.explode(tokens(F.concat_ws("/", place, "url"))).alias("t"))
    candidates = own.join(_indexed(rules, own.select("t")), "t")
    subject = F.when(F.col("priority") == 1, F.col("place")).otherwise(F.col("url"))
    fits = candidates.filter(F.regexp_like(subject, F.col("pattern")))
    best = F.max(F.struct("priority", "length", "rule", "verdict"))
    return fits.groupBy("url").agg(best.alias("best")).select(
        "url", F.when(F.col("best.priority") == 1, F.col("best.rule")).alias("rule"), F.col("best.verdict").alias("verdict")
    )


def judge(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", host_col: str = "host", path_col: str = "path",
    rule_col: str = "rule", verdict_col: str = "verdict", default: str = ALLOW,
) -> DataFrame:
    """``pages`` with host, path, the prefix rule that decided (null if none did), and the verdict."""
    found = best_rules(pages, rules, url_col).select(
        F.col("url").alias("__url"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict")
    )
    joined = pages.join(found, pages[url_col] == found["__url"], "left")
    return joined.withColumns(
        {
            host_col: host(F.col(url_col)), path_col: path(F.col(url_col)),
            rule_col: F.col("__rule"), verdict_col: F.coalesce("__verdict", F.lit(default)),
        }
    ).drop("__url", "__rule", "__verdict")
