"""Allow and block rules on URLs: host-suffix and path-prefix expressions, met by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortgrid.llm.common import ascii_lower, small

SHORT = 8  # hex digits of the digest that the join compares


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end.

    Both are empty for null and for text without ://.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each page.

    rules (host, path, verdict): a rule fits its host and all subdomains if the page's path starts with the rule's.
    The longest rule wins, of equal ones "block"; without a rule the verdict is the default. Rules with a null are
    ignored; a page without a host meets none. Pages with equal host and path are judged once, whatever
    their number. Other columns are ignored.

    Only suffixes with as many labels as some rule's host, and prefixes as long as some rule's path, are tried.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))

    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(ascii_lower(F.col("host")), "path").alias("rule"),
        F.size(F.split("host", "\\.")).alias("labels"),
        F.length("path").alias("length"),
        "verdict",
    )
    rules = rules.groupBy("rule", "labels", "length").agg(F.max("verdict").alias("verdict"))
    tried = rules.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    labels, lengths = tried["labels"] or [], tried["lengths"] or []
    rules = rules.select(F.sha2("rule", 256).alias("digest"), "rule", "verdict")
    rules = rules.withColumn("short", F.substring("digest", 1, SHORT))

    names = F.split("host", "\\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(names) >= n, F.array_join(F.slice(names, -n, n), ".")) for n in labels]), lambda x: x.isNotNull()
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()
    )
    places = parsed.where("host <> ''").select("host", "path").distinct()
    if not labels:
        best = places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    else:
        tries = places.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        tries = tries.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
        tries = tries.withColumn("short", F.substring("digest", 1, SHORT))
        rules = F.broadcast(rules) if small(rules) else rules
        fits = tries.join(rules.withColumnRenamed("digest", "full"), "short").where("digest = full")
        best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
        best = best.select("host", "path", "best.rule", "best.verdict")
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
