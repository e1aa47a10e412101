"""URL filters: longest matching rule, and trust and distrust spread over the links between hosts where none matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (host, start of the path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Share of its weight that a host passes on, steps of spreading between looks at the scores, and the share of a host's score by which it may still grow over these steps at the end.
DAMPING, STEPS, TOLERANCE = 0.85, 3, 1e-6


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's; nulls if none. Rules are few and fixed, so they are a CASE of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind from its seeds (kind, host, weight), over edges (kind, src, dst, weight) with weights of a source summing to 1. Weight that reaches a host without out-links returns to the seeds, as if the walk began anew: each kind's scores sum to 1, so kinds can be compared.

    Scores only grow from step to step. Steps go on until over STEPS of them no host is newly reached and
    no score grows by more than TOLERANCE of itself.
    """
    start = seeds.select("kind", "host", ((1 - DAMPING) * F.col("weight")).alias("score"))
    score = start
    while True:
        before = score.select(F.col("kind").alias("b_kind"), F.col("host").alias("b_host"), F.col("score").alias("b_score"))
        for _ in range(STEPS):
            moved = score.join(edges, (score["kind"] == edges["kind"]) & (score["host"] == edges["src"])).select(score["kind"], F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("weight")).alias("score"))
            score = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = stored(score)
        met = score.join(before, (score["kind"] == before["b_kind"]) & (score["host"] == before["b_host"]), "left")
        if met.where(F.col("b_score").isNull() | (F.col("score") - F.col("b_score") > TOLERANCE * F.col("score"))).isEmpty():
            break
    # restarts for the lost weight are spread like the first start, so they only scale a kind's scores
    whole = score.groupBy("kind").agg(F.sum("score").alias("whole"))
    return score.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("score") / F.col("whole")).alias("score"))  # two rows


def judged(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html).

    Where no rule fits, a host is blocked if of the trust and distrust that reach it, distrust is more
    than `threshold`. Trust starts at hosts in the measure of their pages that rules allow, distrust at
    those with pages that rules block; trust follows the links of pages (absolute href or src) from host
    to host, distrust runs against them. Hosts that neither reaches, and urls without a host, are allowed.
    Null or odd urls have empty host and path; a null page has no links; repeated rows are judged alike
    and weigh each; null ids are kept; an empty table gives an empty result; other columns are ignored.
    The graph is of hosts, and all of it stays in Spark; pages meet blocked hosts in a join whose hot
    hosts Spark can split, as a host is there once on one side.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumns({"rule": rule, "ruled": verdict})
    links = rows.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), 1)).alias("dst"))
    links = links.withColumn("dst", lower_ascii(F.col("dst"))).where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    links = stored(links)
    both = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = stored(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("weight")))
    told = stored(rows.where("ruled IS NOT NULL AND host != ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").cast("double").alias("n")))
    whole = told.groupBy("kind").agg(F.sum("n").alias("all"))
    score = _spread(edges, told.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("weight")))  # two rows
    value = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    bad = stored(score.groupBy("host").agg(value("allow").alias("trust"), value("block").alias("distrust")).where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("spread")))
    return rows.drop("html").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))
