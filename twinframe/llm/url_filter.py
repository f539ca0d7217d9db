"""Verdicts of URLs by host and path rules, through short hash prefixes. DataFrame functions only.

Each rule becomes one key, its host with the directory part of its path, and each URL becomes the keys that a rule
could have: host suffixes (a host and all it is a subdomain of) combined with directory prefixes of the path. Which
combinations are needed follows from the rules: only the distinct pairs of label count and directory depth that rules
have can match, so a URL of thousands of labels or segments gives no more keys than any other. The keys meet in an
equi-join on the first ``PREFIX`` hexadecimal digits of their SHA-256. What meets is confirmed by the full digest,
computed from the URL at the rule's own depth, and by the rest of the rule's path behind its last slash.

A prefix such as that of ``com/`` may be hit by a third of all URLs, so URLs are dealt over ``SALTS`` copies of the
rules. The planner broadcasts the rules only where their written size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise

PREFIX = 8
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _times(text: str, sign: str) -> str:
    return f"(length({text}) - length(replace({text}, '{sign}', '')))"


def _key(host: str, path: str, labels: str, depth: str) -> str:
    """SQL of the key with so many labels of the host and so many directories of the path."""
    directory = f"if({depth} = 0, '', concat(substring_index({path}, '/', {depth}), '/'))"
    return f"concat(substring_index({host}, '.', -{labels}), {directory})"


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``rule_host, rule_path, rule_verdict, labels, depth, digest, prefix`` of the rules; those without a host or a
    verdict are none, and a null path is the empty one."""
    plain = rules.filter("host is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).distinct()
    sized = plain.withColumn("labels", F.expr(_times("rule_host", ".") + " + 1").cast("int")).withColumn(
        "depth", F.expr(_times("rule_path", "/")).cast("int"))
    digest = F.sha2(F.expr(_key("rule_host", "rule_path", "labels", "depth")), 256)
    return sized.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX))


def judged_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = SALTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages (page_id, url)`` under ``rules (host, path, verdict)``.

    A rule fits its host and all subdomains of it where the URL's path starts with the rule's. Of the rules that fit,
    that with the most characters wins, then that with the longer host, then the verdict that sorts last (``block``
    before ``allow``). ``rule`` is the winner's host and path, null where none fits; the verdict is ``default`` then.
    A null URL and one without ``://`` have an empty host and path. Null ids are values like any other, and repeated
    rows each get their verdict. An empty table gives no rows, and without rules all is ``default``. Only the named
    columns are read.
    """
    ready = materialise(
        prepared_rules(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "rules")
    # The pairs of label count and depth that rules have: few, as both count dots and slashes of single URLs.
    shapes = sorted(tuple(r) for r in ready.select("labels", "depth").distinct().collect())
    # Repeated rows are one until the end, but never over more than one input partition: a hot row stays spread.
    rows = pages.select("page_id", "url", F.spark_partition_id().alias("part")).groupBy("page_id", "url", "part").agg(
        F.count(F.lit(1)).alias("copies"))
    parted = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    listed = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(d).alias("depth")) for a, d in shapes])
    if not shapes:
        listed = F.array().cast("array<struct<labels:int,depth:int>>")
    fitting = f"filter(shapes, s -> s.labels <= {_times('host', '.')} + 1 and s.depth <= {_times('path', '/')})"
    prefixes = f"transform({fitting}, s -> substr(sha2({_key('host', 'path', 's.labels', 's.depth')}, 256), 1, {PREFIX}))"
    keyed = parted.withColumn("shapes", listed).select(
        "page_id", "url", "part", "copies", "host", "path", F.explode_outer(F.expr(prefixes)).alias("wanted"),
        F.pmod(F.xxhash64("page_id", "url", "part"), F.lit(salts)).cast("int").alias("dealt"))
    confirmed = (
        (F.col("wanted") == F.col("prefix")) & (F.col("dealt") == F.col("salt"))
        & (F.sha2(F.expr(_key("host", "path", "labels", "depth")), 256) == F.col("digest"))
        & F.startswith("path", "rule_path"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = keyed.join(ready, confirmed, "left").groupBy("page_id", "url", "part", "copies", "host", "path").agg(
        F.max(F.when(F.col("rule_host").isNotNull(), rank)).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
