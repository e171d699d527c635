"""URL filters: rules by host and path, and trust propagated over the graph of host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, lower_ascii, written

#: (host, beginning of the path, verdict); a rule's name is host and path in one.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Rounds stop when no host's score changes by more than CLOSE of itself. Scores that a host first gets after k rounds are
#: below DAMPING ** k of all, so this ends; after ROUNDS, where what is left is below the smallest double, it raises.
DAMPING, CLOSE, ROUNDS = 0.85, 1e-3, 4600
#: A host is blocked if distrust outweighs trust by MARGIN.
MARGIN = 1.0
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules read them; both '' without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, shape, 1)), F.regexp_extract(url, shape, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits))


def node(host: Column) -> Column:
    """A host as the graph knows it: without a user before it, a port or a dot behind it."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def rank(nodes: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """(host, score): personalised PageRank of (src, dst) edges, restarts by the nodes' weight in ``seed``.

    Scores add up to 1: what reaches hosts without links onward goes back to the seeds. Rounds are written tables and go
    on until no score changes by more than CLOSE of itself, however many hosts share the total. A round's sums are
    partial aggregates by target, so a host with very many links is summed up where its links are.
    """
    total = nodes.agg(F.coalesce(F.sum(seed), F.lit(0.0))).first()[0]
    if not total:
        return nodes.select("host", F.lit(0.0).alias("score"))
    degree = edges.groupBy(F.col("src").alias("host")).agg(F.count("*").alias("degree"))
    start = written(nodes.join(degree, "host", "left").select("host", "degree", (F.col(seed) / total).alias("start")), "start")
    scores = written(start.select("host", F.col("start").alias("score"), F.when(F.col("degree").isNull(), F.col("start")).otherwise(0.0).alias("ends"), (F.col("start") / F.col("degree")).alias("each")), "rank")
    if edges.isEmpty():
        return scores.select("host", "score")
    ends = scores.agg(F.sum("ends")).first()[0]
    for _ in range(ROUNDS):
        sent = edges.join(scores.select(F.col("host").alias("src"), "each"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum("each").alias("in"))
        new = start.join(sent, "host", "left").join(scores.select("host", F.col("score").alias("old")), "host")
        score = (1 - DAMPING + DAMPING * ends) * F.col("start") + DAMPING * F.coalesce("in", F.lit(0.0))
        new = new.select("host", "degree", "old", score.alias("score"))
        new = written(new.select("host", "old", "score", F.when(F.col("degree").isNull(), F.col("score")).otherwise(0.0).alias("ends"), (F.col("score") / F.col("degree")).alias("each")), "rank")
        moved, ends = new.agg(F.coalesce(F.max(F.abs(F.col("score") - F.col("old")) / F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)), F.sum("ends")).first()
        discard(scores)
        scores = new
        if moved < CLOSE:
            return scores.select("host", "score")
    raise ValueError("scores do not settle")


def judge(pages: DataFrame, page_id: str = "page_id", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    A rule's verdict holds. Pages without one take their host's: hosts are trusted seeds by the number of their pages
    that rules allow, and blocked seeds by the number of those that they block; trust flows along links between hosts,
    distrust against them. Each adds up to the number of pages that its rules decide, so that they can be compared: a
    host with more distrust than MARGIN times its trust is blocked. In the graph a host stands without port and user.

    Null urls and urls without ``://`` have an empty host and path, take no part in the graph and are allowed. Null html:
    no links. Repeated rows are judged each, and count each as pages of their host; empty table: no rows. Other columns
    are not read, whatever their names.
    """
    host, path = parts(F.col("url"))
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: node(lower_ascii(h))))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), links.alias("to"))
    base = written(base.withColumns({"r": rule_of(F.col("host"), F.col("path"), rules), "node": node(F.col("host"))}), "pages")
    of = lambda verdict: F.count_if(F.col("r.verdict") == verdict).cast("double")
    own = base.where("node <> ''").groupBy(F.col("node").alias("host")).agg(of("allow").alias("good"), of("block").alias("bad"))
    edges = base.where("node <> ''").select(F.col("node").alias("src"), F.explode("to").alias("dst")).where("src <> dst and dst <> ''").distinct()
    edges = written(edges, "edges")
    extra = edges.select(F.col("dst").alias("host")).distinct().join(own.select("host"), "host", "left_anti").select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    nodes = written(own.unionByName(extra), "hosts")
    good, bad = nodes.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    trust = rank(nodes, edges, "good").select(F.col("host").alias("node"), (F.col("score") * good).alias("trust"))
    distrust = rank(nodes, back, "bad").select(F.col("host").alias("node"), (F.col("score") * bad).alias("distrust"))
    out = base.join(trust.join(distrust, "node"), "node", "left")
    of_host = F.when(F.coalesce(F.col("distrust") > MARGIN * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), of_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
