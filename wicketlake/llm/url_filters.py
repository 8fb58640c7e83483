"""URL filters: prefix rules over reversed hosts, met with urls by a sorted sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicketlake.llm.common import literal_rows, named

ASCII_CAPITALS, ASCII_SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ASCII_CAPITALS, ASCII_SMALL)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the top one down, as a key in which a domain stands before all its subdomains."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) from a short list; long lists are read from a table of these columns."""
    return literal_rows(spark, rules, "verdict string, host string, path string")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule that fits, or ``default`` without one.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with its path.
    Its key is the reversed host, a tab and the path; all urls it fits have that key as a prefix once their
    host is cut to the rule's labels, so a rule is an interval of keys, and intervals nest or are apart. A
    url has a key for each suffix of its host that is the host of a rule. Rules and keys of one host are
    swept in order: each interval that opens or closes changes the depth of the stack, and the rule on top
    is the last one opened at the present depth. Of the tops for the suffixes of a host the longest rule
    wins (host and path counted; then the longer host, then the smaller path, block before allow).

    A host with more than ``rows_per_part`` keys is swept in parts: its rules go to each part and its keys
    are dealt out by their hash, so no part grows with the host. Rules that say the same twice count once;
    of rules that differ in the verdict only, the smaller verdict (allow) gives way to block. Rules with a
    null host count as none; a null path is "". A null url, or one without ://, has an empty host and path
    and gets ``default``. Every row gives one row, repeated rows repeat; input columns with the names of new
    ones are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new]
    rows = pages.select(*[named(c) for c in kept], url_host(named(url)).alias("host"), url_path(named(url)).alias("path"))
    rules = rules.where("host IS NOT NULL").select(
        F.translate("host", ASCII_CAPITALS, ASCII_SMALL).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict"
    ).groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    names = rows.select("host").groupBy("host").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = names.select("host", "n", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    hosts = hosts.join(rules.select(F.col("r_host").alias("suffix")).distinct(), "suffix", "left_semi")
    parts = hosts.groupBy("suffix").agg(F.ceil(F.sum("n") / rows_per_part).cast("int").alias("parts"))
    # what the sweep needs of the urls: each (host, path) once
    urls = rows.groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
    keys = urls.join(hosts.select("host", "suffix").join(parts, "suffix"), "host")
    keys = keys.select(
        reversed_host(F.col("suffix")).alias("domain"),
        F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"),
        F.col("path").alias("at"),
        F.lit(1).alias("order"),
        F.lit(0).alias("step"),
        F.lit(None).cast("string").alias("r_path"),
        F.lit(None).cast("string").alias("r_verdict"),
        "host",
        "suffix",
    )
    dealt = rules.join(parts, F.col("r_host") == F.col("suffix")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    domain = reversed_host(F.col("r_host"))
    nobody = F.lit(None).cast("string")
    ends = F.concat("r_path", F.lit("\U0010ffff"))
    opened = dealt.select(domain.alias("domain"), "part", F.col("r_path").alias("at"), F.lit(0).alias("order"), F.lit(1).alias("step"), "r_path", F.col("verdict").alias("r_verdict"), nobody.alias("host"), F.col("r_host").alias("suffix"))
    closed = dealt.select(domain.alias("domain"), "part", ends.alias("at"), F.lit(2).alias("order"), F.lit(-1).alias("step"), "r_path", F.col("verdict").alias("r_verdict"), nobody.alias("host"), F.col("r_host").alias("suffix"))
    events = keys.unionByName(opened).unionByName(closed)
    # at one key: inner intervals close before outer ones, outer ones open before inner ones, urls between
    inner = F.when(F.col("order") == 2, -F.length("r_path")).otherwise(F.coalesce(F.length("r_path"), F.lit(0)))
    sweep = W.partitionBy("domain", "part").orderBy("at", "order", inner)
    events = events.withColumn("inner", inner).withColumn("depth", F.sum("step").over(sweep.rowsBetween(W.unboundedPreceding, 0)))
    # an opening stands at the depth it creates, so the last one at a depth is on top of the stack there
    level = W.partitionBy("domain", "part", "depth").orderBy("at", "order", "inner").rowsBetween(W.unboundedPreceding, 0)
    opens = F.col("step") == 1
    top = F.last(F.when(opens, F.struct("r_path", F.col("r_verdict").alias("v"))), ignorenulls=True).over(level)
    tops = events.withColumn("top", top).where("step = 0 AND depth > 0 AND top IS NOT NULL")
    best = tops.groupBy("host", F.col("at").alias("path")).agg(
        F.max_by(
            F.struct(F.concat("suffix", "top.r_path").alias("rule"), F.col("top.v").alias("verdict")),
            F.struct(F.length(F.concat("suffix", "top.r_path")), F.length("suffix")),
        ).alias("best")
    )
    out = rows.join(best, ["host", "path"], "left")
    return out.select(
        *[named(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
