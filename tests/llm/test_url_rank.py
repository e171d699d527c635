"""Rank of hosts whatever their number."""

import random

from pyspark.sql import functions as F

from codexa.llm import urls


def test_rank_travels_as_far_among_many_hosts(spark):
    n = 10_000
    ids = spark.range(n).select(F.col("id").cast("string").alias("i"))
    host = lambda h: F.concat(F.lit(h), "i")
    nodes = ids.select(host("a").alias("host"), F.lit(0.0).alias("bad")).unionByName(ids.select(host("b").alias("host"), F.lit(0.0).alias("bad"))).unionByName(ids.select(host("s").alias("host"), F.lit(1.0).alias("bad")))
    edges = ids.select(host("s").alias("src"), host("b").alias("dst")).unionByName(ids.select(host("b").alias("src"), host("a").alias("dst")))
    got = urls.rank(nodes, edges, "bad").groupBy(F.left("host", F.lit(1)).alias("k")).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    for r in got.collect():
        want = 0.85 ** "sba".index(r.k) / (1 + 0.85 + 0.85**2) / n
        assert abs(r.low - want) < 1e-3 * want and abs(r.high - want) < 1e-3 * want, r


def test_rank_is_that_of_plain_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(30)] + [f"x{i}" for i in range(12)]
    edges = {(f"h{i}", f"h{(i + 1) % 30}") for i in range(30)}  # a ring
    edges |= {(f"h{i}", "x0") for i in range(0, 30, 2)} | {("x0", f"x{i}") for i in range(1, 6)}  # a hub, hosts that link nowhere
    edges |= {tuple(rng.sample(hosts, 2)) for _ in range(20)} - {(a, "x3") for a in hosts}
    seeds = {h: float(rng.randrange(4)) for h in hosts[:8]}
    nodes = spark.createDataFrame([(h, seeds.get(h, 0.0)) for h in hosts], "host string, good double")
    got = {r.host: r.score for r in urls.rank(nodes, spark.createDataFrame(sorted(edges), "src string, dst string"), "good").collect()}
    start = {h: seeds.get(h, 0.0) / sum(seeds.values()) for h in hosts}
    out = {h: [b for a, b in edges if a == h] for h in hosts}
    score = dict(start)
    for _ in range(400):
        ends = sum(score[h] for h in hosts if not out[h])
        score = {h: (0.15 + 0.85 * ends) * start[h] + 0.85 * sum(score[a] / len(out[a]) for a in hosts if h in out[a]) for h in hosts}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[h] - score[h]) <= 0.01 * score[h] for h in hosts)


def test_ports_and_users_are_no_other_hosts(spark):
    rows = [(1, "http://bad.com:8080/en/1", None), (2, "http://me@to.xyz:80/1", '<a href="http://you@bad.com/">x</a>'), (3, "http://to.xyz/2", None)]
    got = {r.page_id: (r.host, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=[("bad.com:8080", "/en/", "block")]).collect()}
    assert got == {1: ("bad.com:8080", "block"), 2: ("me@to.xyz:80", "block"), 3: ("to.xyz", "block")}
