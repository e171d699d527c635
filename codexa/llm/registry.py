"""The subpackage's queries and their SQL."""

from __future__ import annotations

from codexa.llm.common import table
from codexa.llm.mixing import MIX_SQL, mix
from codexa.llm.sharding import SHARD_SQL, shard

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(MIX_SQL)
def op1_mix_sources(spark, d):
    return mix(table(spark, d, "documents"))


@query(SHARD_SQL)
def op2_extendible_shards(spark, d):
    return shard(table(spark, d, "documents"))


@query()
def op3_quality_classifier(spark, d):
    from codexa.llm.quality import classify

    return classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query()
def op9_toxicity(spark, d):
    from codexa.llm.toxicity import classify

    return classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query()
def op8_best_two_fit(spark, d):
    from codexa.llm.packing import pack

    return pack(table(spark, d, "documents"))


def _topk_sql() -> str:
    from codexa.llm.topk import TOPK_SQL

    return TOPK_SQL


@query(_topk_sql())
def op4_exact_topk(spark, d):
    from pyspark.sql import functions as F

    from codexa.llm.topk import topk

    return topk(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op5_ngram_jaccard(spark, d):
    from codexa.llm.jaccard import join

    return join(table(spark, d, "documents"), n=3, threshold=90)


@query()
def op6_quality_rules(spark, d):
    from codexa.llm.rules import judge

    return judge(table(spark, d, "documents"))


@query()
def op7_url_filters(spark, d):
    from codexa.llm.urls import judge

    return judge(table(spark, d, "pages"))


@query()
def op10_license_scan(spark, d):
    from codexa.llm.licenses import scan

    return scan(table(spark, d, "documents"))
