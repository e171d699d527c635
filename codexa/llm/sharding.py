"""Sharding by extendible hashing; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, free_name, hash_bits, written

SHARD_BYTES = 1 << 20
BITS, STEP, LOW = 60, 8, 12


def _resolve(rows: DataFrame, limit: int, start: int, stop: int, low: bool) -> DataFrame:
    """(g, leaf, depth): for each prefix of ``stop`` bits the first depth from ``start`` on whose bucket is final, else null.

    A bucket is final if its bytes fit or it holds one row. Bytes of all prefixes come from sums over the leaves; a
    leaf finds its ancestors by an equi-join, for depths up to LOW with a broadcast of at most 2 ** (LOW + 1) rows.
    """
    leaf = F.shiftright("h", BITS - stop)
    hist = rows.groupBy("g", leaf.alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    levels = hist.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(stop)))).withColumn("prefix", F.expr(f"shiftright(leaf, {stop} - depth)"))
    nodes = levels.groupBy("g", "depth", "prefix").agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n")).where((F.col("all_bytes") <= limit) | (F.col("all_n") == 1)).select("g", "depth", "prefix")
    keys = ["g", "depth", "prefix"]
    if low and start <= LOW:
        fits = levels.where(F.col("depth") <= LOW).join(F.broadcast(nodes.where(F.col("depth") <= LOW)), keys)
        if stop > LOW:
            fits = fits.unionByName(levels.where(F.col("depth") > LOW).join(nodes.where(F.col("depth") > LOW), keys))
    else:
        fits = levels.join(nodes, keys)
    found = fits.groupBy("g", "leaf").agg(F.min("depth").alias("depth"))
    return hist.select("g", "leaf").join(found, ["g", "leaf"], "left")


def shard(docs: DataFrame, doc_id: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES, row: str | None = None) -> DataFrame:
    """(doc_id, bytes, depth, shard[, row]): the shard is the prefix of ``depth`` hash bits, as a string of 0 and 1.

    All rows start in one bucket; a bucket over ``limit`` bytes splits on the next bit, others stay, so the directory
    is the set of shortest prefixes whose bytes fit. A bucket of one row is final whatever its size. Rows of one
    doc_id share their first 60 bits; where they don't fit together, further bits are drawn from the written row's
    number, so that repeated rows split too. Levels are resolved some at a time, later ones for oversized buckets only.

    Null text: 0 bytes; null doc_id: hashed as ''. Empty table: no rows. ``row`` names a column of numbers that tell
    rows apart, which is returned. Other columns are not read, whatever their names.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    number = (F.col(row) if row else F.monotonically_increasing_id()).alias("row")
    base = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("bytes"), hash_bits(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("h"), number)
    base = written(base, "shard")
    total = base.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = lambda depth, h: F.when(F.col(depth) == 0, "").otherwise(F.left(F.lpad(F.bin(h), BITS, "0"), F.col(depth)))
    done = None
    for phase in (1, 2):
        if phase == 1:
            rest, taken = base.withColumns({"g": F.lit(0).cast("long"), "head": F.lit("")}), 0
        else:  # same first 60 bits: on by the row's number
            rest = rest.withColumns({"g": F.col("h"), "head": F.lpad(F.bin("h"), BITS, "0"), "h": hash_bits(F.col("row").cast("string"))})
        start, stop = 0, min(BITS, 3 + max(0, math.ceil(math.log2(max(total, 1) / limit)))) if phase == 1 else STEP
        while True:
            found = _resolve(rest, limit, start, stop, low=phase == 1)
            rows = rest.withColumn("leaf", F.shiftright("h", BITS - stop)).join(found, ["g", "leaf"])
            rows = written(rows.drop("leaf"), "shard-level")
            depth = (F.col("depth") + (BITS if phase == 2 else 0)).cast("long")
            part = rows.where("depth is not null").select("doc_id", "bytes", depth.alias("depth"), F.concat("head", bits("depth", "h")).alias("shard"), *["row"] * bool(row))
            done = part if done is None else done.unionByName(part)
            rest = rows.where("depth is null").drop("depth")
            if rest.isEmpty():
                return done
            if stop == BITS:
                break
            start, stop = stop + 1, min(BITS, stop + STEP)
    raise ValueError("rows that share all hash bits do not fit one shard")


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", **options) -> str:
    """All rows and columns of ``docs`` as Parquet, one file for each shard; returns the name of the folders' column.

    That is ``shard``, or ``shard_`` where ``docs`` has such a column. Folders are named by the letter b and the shard's
    bits, so that a reader takes them for text. Each row goes to its own shard: rows are told apart by their number in
    a written table, not by their id, so repeated and null ids split as ``shard`` says.
    """
    row, column = free_name(docs, "_row"), free_name(docs, "shard")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    place = shard(rows, doc_id, row=row, **options).select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias(column))
    rows.join(place, row).drop(row).repartition(column).write.mode("overwrite").partitionBy(column).parquet(folder)
    discard(rows)
    return column


SHARD_SQL = f"""WITH base AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT AS h FROM documents),
lev AS (SELECT *, h >> (60 - d)::INT AS prefix FROM base, range(0, 61) t(d)),
ok AS (SELECT doc_id, bytes, h, d FROM lev QUALIFY sum(bytes) OVER (PARTITION BY d, prefix) <= {SHARD_BYTES} OR count(*) OVER (PARTITION BY d, prefix) = 1)
SELECT doc_id, bytes, min(d) AS depth, left(lpad(bin(h), 60, '0'), min(d)::INT) AS shard FROM ok GROUP BY doc_id, bytes, h"""
