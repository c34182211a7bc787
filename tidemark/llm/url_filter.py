"""URL filters: rules by host and path, and link-graph propagation, in DataFrame operations only.

Where no rule fits a url, its host decides: trust flows from hosts with allowed pages along links (personalised
PageRank), distrust from hosts with blocked pages against the links; a host whose distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: A host may hold any share of the pages: pages meet what is known of their host in so many places.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: An absolute link; a relative one stays on its host and says nothing about others.
LINK = r"""(?is)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://; A-Z of the host are lower-cased."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def by_host(rows: DataFrame, of_host: DataFrame) -> DataFrame:
    """rows (page_id, host, ...) with what of_host (host, ...) has for their host, if anything."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    copies = of_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "_salt"], "left").drop("_salt")


def parsed_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """verdict, rule, rule_host, rule_path of rules such as ("block", "example.org/es/")."""
    literal = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules))
    rows = spark.range(1).select(F.explode(literal).alias("r")).select("r.*")
    host = F.substring_index("rule", "/", 1)
    return rows.select("verdict", "rule", host.alias("rule_host"), F.substr("rule", F.length(host) + 1).alias("rule_path"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict: the longest rule that fits, ties by the rule's text.

    Rules meet the suffixes of distinct hosts in an equi-join; each page then tries the few rules of its host.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    rule = F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "verdict")
    of_host = hosts.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    tried = by_host(rows, of_host).withColumn("r", first)
    return tried.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, counted."""
    src, _ = host_and_path(F.col("url"))
    dst = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    links = pages.select(src.alias("src"), dst.alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(host, mass) of personalised PageRank: links (src, dst, n), seeds (host, weight).

    Not normalised: all mass comes from the seeds' weights. Mass at a host without links stays there. It ends after
    `rounds`, or when no more than `tolerance` of the mass moves.
    """
    share = cut(links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    ends = share.select("src").distinct()
    seeds = cut(seeds.filter("weight > 0").select("host", F.col("weight").cast("double").alias("weight")))
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    # What a seed keeps: all of it if it has no links, or the part that does not flow.
    moving = cut(seeds.join(ends, seeds["host"] == ends["src"], "left_semi"))
    settled = [seeds.join(ends, seeds["host"] == ends["src"], "left_anti")]
    for _ in range(rounds):
        settled.append(moving.select("host", (F.col("weight") * (1 - damping)).alias("weight")))
        flow = moving.join(share, moving["host"] == share["src"]).groupBy("dst").agg(F.sum(F.col("weight") * F.col("share") * damping).alias("weight")).withColumnRenamed("dst", "host")
        flow = cut(flow)
        settled.append(flow.join(ends, flow["host"] == ends["src"], "left_anti"))
        moving = flow.join(ends, flow["host"] == ends["src"], "left_semi")
        if (moving.agg(F.sum("weight")).first()[0] or 0.0) <= tolerance * total:
            break
    settled.append(moving.select("host", "weight"))
    out = settled[0].select("host", "weight")
    for more in settled[1:]:
        out = out.unionByName(more.select("host", "weight"))
    return out.groupBy("host").agg(F.sum("weight").alias("mass"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], ratio: float = 2.0) -> DataFrame:
    """A row for each row of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A host's seed of trust is the number of its pages that a rule allows, of distrust those that a rule blocks. Where no
    rule fits, the verdict is block if distrust > ratio * trust, else allow; hosts that nothing reaches are allowed. A
    null url has an empty host and path; null html has no links; rows that repeat are judged alike. An empty table gives
    no rows, and without rules everything is allowed.
    """
    found = cut(judged(pages, parsed_rules(pages.sparkSession, rules))) if rules else cut(judged(pages, parsed_rules(pages.sparkSession, [("allow", "/")]).limit(0)))
    links = cut(host_links(pages))
    seeds = found.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block"))
    trust = propagated(links, seeds.select("host", F.col("allow").alias("weight")))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagated(back, seeds.select("host", F.col("block").alias("weight")))
    hosts = seeds.select("host").join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    of_host = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return by_host(found, hosts).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", of_host).alias("verdict"), "trust", "distrust")
