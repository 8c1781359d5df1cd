"""URL filter by rules and by trust that spreads over links between hosts.

Pages judged by a rule make their hosts seeds: the share of a host's pages that rules allow is
its trust, the share they block its distrust. Trust flows along links, distrust against them
(who links to blocked hosts is suspect), each by personalised PageRank over the distinct edges
between hosts. A page without a rule is blocked if the distrust of its host exceeds its trust by
MARGIN. Only host rows take part in the rounds; pages are read once for their links.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.session import materialize

# Fixed values: (verdict, host, path) of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/"))
DAMPING = 0.85
ROUNDS = 10
MARGIN = 0.5 * (1 - DAMPING)     # half of what a fully blocked host without links has
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>\\]+)"


def folded(host: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return folded(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits host (or a parent domain) and path, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def edges_of(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts, from absolute links; null html and empty hosts have none."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.select("src", folded(F.col("dst")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of all hosts that either reaches; seeds are (host, trust, distrust)."""
    out = edges.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "h")
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).withColumnRenamed("dst", "h")
    ways = materialize(
        edges.join(out, F.col("src") == F.col("h")).select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (1 / F.col("n")).alias("share"))
        .union(edges.join(into, F.col("dst") == F.col("h")).select(F.lit("distrust"), "dst", "src", 1 / F.col("n"))), "host-edges")
    kinds = F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)")
    base = materialize(seeds.select("host", kinds).filter("score > 0").withColumn("score", F.col("score") * (1 - DAMPING)), "seeds")
    score = base
    for _ in range(rounds if ways.head(1) else 0):
        moved = score.join(ways, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share") * DAMPING).alias("score"))
        score = materialize(base.select("host", "kind", "score").union(moved).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    return score.groupBy("host").agg(part("trust"), part("distrust"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per input row.

    A null url and one without ``://`` have empty host and path, fit no rule and are allowed.
    Repeated pages are judged alike and count once each in their host's shares.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": says})
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = materialize(edges_of(pages), "links")
    scores = materialize(spread(edges, seeds), "host-scores")
    judged_ = rows.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("said", F.when(F.col("distrust") - F.col("trust") > MARGIN, "block").otherwise("allow"))
    return judged_.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
