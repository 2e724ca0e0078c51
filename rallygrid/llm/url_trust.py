"""URL filter: rules on host and path, then trust propagated over host links.

Rules decide first.  Hosts with allowed pages are trusted seeds and hosts with
blocked pages are blocked seeds, weighted by their pages.  Trust follows links by
personalised PageRank; distrust follows them backwards (who links to a blocked
host is suspect).  A host edge is a hyperlink to another host, or the tie of a
host with its parent domain, which goes both ways.  A page without a rule is
blocked if its host has more distrust than ``ratio`` percent of its trust.

Scores are whole numbers of 10 ** -15 of all mass, so sums don't depend on their
order and results repeat exactly.

Defined results: no ``://`` or no url has an empty host and path, no rule and no
score (allowed); repeated rows are judged alike; rows are kept one for one; an
empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: All mass; percentage that follows links; rounds; percentage of its trust that a host's distrust must exceed.
MASS, FOLLOW, ROUNDS, RATIO = 10 ** 15, 85, 10, 100

URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for r_host, r_path, action in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        name, verdict = F.when(fits, r_host + r_path).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """Distinct edges ``src, dst`` between hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst"))
    hosts = pages.select("host").distinct()
    # Every ancestor with at least two labels: a host, its parent, and so on.
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    steps = hosts.select(chain.alias("c")).select(F.explode(F.when(F.size("c") > 1, F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b")))).alias("s"))
    ties = steps.select(F.col("s.a").alias("src"), F.col("s.b").alias("dst")).distinct()
    both = links.union(ties).union(ties.select(F.col("dst"), F.col("src")))
    return both.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows ``host, trust, distrust`` from ``seeds`` (``host, allowed, blocked`` page counts)."""
    ways = edges.select(F.lit("trust").alias("way"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = ways.groupBy("way", "src").agg(F.count("*").alias("degree"))
    ways = written(ways.join(degree, ["way", "src"]), "ways")
    split = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("way"), F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("way"), F.col("blocked").alias("n")))).alias("s"))
    split = split.select("host", "s.way", "s.n").where("n > 0")
    totals = split.groupBy("way").agg(F.sum("n").alias("total"))
    start = written(split.join(F.broadcast(totals), "way").select("way", "host", F.expr(f"({MASS} div total) * n").alias("mass")), "seeds")  # two rows
    now = start
    for _ in range(rounds):
        moved = now.withColumnRenamed("host", "src").join(ways, ["way", "src"]).select("way", F.col("dst").alias("host"), F.expr(f"(mass * {FOLLOW}) div (100 * degree)").alias("mass"))
        jump = start.select("way", "host", F.expr(f"(mass * {100 - FOLLOW}) div 100").alias("mass"))
        now = written(moved.union(jump).groupBy("way", "host").agg(F.sum("mass").alias("mass")), "mass")
    own = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("mass"))), F.lit(0)).alias(way)
    return now.groupBy("host").agg(own("trust"), own("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, ratio: int = RATIO) -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict, trust, distrust``."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumns({"rule": rule, "said": said})
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    scores = propagate(written(host_edges(rows, "html"), "edges"), seeds, rounds)
    distrust, trust = (F.coalesce(c, F.lit(0)) for c in ("distrust", "trust"))
    verdict = F.coalesce("said", F.when(distrust > F.expr(f"coalesce(trust, 0) div 100 * {ratio}"), "block").otherwise("allow"))
    return ruled.drop("html").join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
