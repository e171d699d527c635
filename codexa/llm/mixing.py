"""Mixing sources to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.llm.common import free_name, hash_bits, n_words, written

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(k, source, source_size, target) from (k, source, source_size): shares of the total by cycling weights.

    A target stops at ``cap`` times its source's size; the excess goes to the others by weight. The fixed point is
    found at once: sources ordered by cap / weight fill up one after the other. One row per source, so the windows are small.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights)))
    rows = rows.withColumns({"most": F.col("source_size") * float(cap), "total": F.sum("source_size").over(W.partitionBy())})
    up = W.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("full", F.col("most") * rest <= (F.col("total") - before) * F.col("weight"))
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(W.partitionBy()), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(W.partitionBy())
    rows = rows.withColumns({"filled": filled, "open_weight": open_weight})
    level = (F.col("total") - F.col("filled")) / F.col("open_weight") * F.col("weight")
    return rows.select("k", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weights=WEIGHTS, cap: float = CAP, seed: str = SEED, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken[, row]): how often each document enters the mix.

    Within a source a document's expected copies are target / source_size. Their prefix sums, in the order of falling
    size, start at one random offset per source (drawn from ``seed``), and a document is emitted once for each integer
    that its interval crosses: copies = floor(before + e + u) - floor(before + u). Neighbours being of like size, the
    words taken stay within about one document of the target. Reruns agree.

    As e is constant in a source, the prefix sum is e times a rank. The rank is summed up from three levels: sizes of a
    source, sub-buckets of a (source, size), rows of a sub-bucket; a group of n equal rows has about sqrt(n)
    sub-buckets of about sqrt(n) rows, so no task holds a large group.

    Null source: a source of its own, last. Null or empty text: size 0, takes 0 words. Repeated rows count each; empty
    table: no rows. A total of 0: all targets 0. ``row`` names a column of numbers that tell rows apart: it breaks ties
    and is returned. Other columns of ``docs`` are not read, whatever their names.
    """
    size = n_words(F.col("text")) if size is None else size
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    number = [F.col(row).alias("row")] if row else []
    base = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("k"), *number), "mix")
    groups = base.groupBy("k", "size").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    groups = written(groups, "mix-groups")
    goal = targets(groups.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("k", "size", ahead.alias("ahead"), F.ceil(F.sqrt("n")).alias("subs"))
    sub = F.pmod(hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8), F.col("subs"))
    rows = base.join(groups, ["k", "size"]).withColumn("sub", sub)
    counts = rows.groupBy("k", "size", "sub").agg(F.count("*").alias("m"))
    in_size = F.coalesce(F.sum("m").over(W.partitionBy("k", "size").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("k", "size", "sub", in_size.alias("in_size"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("k", "size", "sub").orderBy("doc_id", *["row"] * bool(row))))
    rows = rows.join(counts, ["k", "size", "sub"]).join(goal.drop("source"), "k")
    rank = F.col("ahead") + F.col("in_size") + F.col("place")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hash_bits(F.concat(F.lit(seed), F.col("k")), 8) / F.lit(2.0**32)
    copies = F.floor(F.col("each") * F.col("rank") + F.col("u")) - F.floor(F.col("each") * (F.col("rank") - 1) + F.col("u"))
    rows = rows.withColumns({"each": each, "rank": rank, "u": offset}).withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["row"] * bool(row))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with the columns of ``docs``.

    Rows are numbered in a written table and find their copies by that number, so repeated and null ids make no
    difference and no group of rows meets in one task.
    """
    row, n = free_name(docs, "_row"), free_name(docs, "_copies")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix(rows, doc_id, row=row, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n))
    several = F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))
    return rows.join(taken, row).withColumn(n, several).select(*[F.col(f"`{c}`") for c in docs.columns])


# size order, sub-buckets and offset as above
MIX_SQL = f"""WITH base AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * {CAP}.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE AS total FROM src),
f AS (SELECT *, most * sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
  (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_ FROM w),
goal AS (SELECT k, source_size, CASE WHEN full_ THEN most ELSE (total - coalesce(sum(CASE WHEN full_ THEN most END) OVER (), 0)) / sum(CASE WHEN NOT full_ THEN weight END) OVER () * weight END AS target FROM f),
g AS (SELECT *, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % ceil(sqrt(count(*) OVER (PARTITION BY k, size)))::BIGINT AS sub FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, sub, doc_id) AS rank, ('0x' || left(md5('{SEED}' || k), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each FROM r JOIN goal USING (k)),
c AS (SELECT *, (floor(each * rank + u) - floor(each * (rank - 1) + u))::BIGINT AS copies FROM e)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c"""
