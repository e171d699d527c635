"""The query line's inline filters and the catalogs they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.functions.text import strip

COMMANDS = {"salir": "quit", "exit": "quit", "quit": "quit", "catalogo": "catalog"}


def catalog(index: DataFrame, column: str) -> DataFrame:
    """(ord from 1, value): sorted distinct non-empty values. The values are few; the window runs over them alone."""
    values = index.where(F.col(column) != "").select(F.col(column).alias("value")).distinct()
    return values.select(F.row_number().over(W.orderBy("value")).alias("ord"), "value")


def parse(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, raw, consulta, filtro_documento, filtro_jerarquia, command).

    ``queries``: query_id, raw; ``documents``: a catalog. ``ley:<n>`` names the n-th catalog entry (out of range: ignored),
    ``ley:<text>`` and ``jerarquia:<text>`` are substrings; the last of each kind that has an effect wins; '' is no filter.
    """
    lower = F.filter(F.split(F.lower("raw"), r"(?U)\s+"), lambda x: x != "")
    size = documents.agg(F.count("*").alias("n_docs"))
    rows = queries.join(F.broadcast(size), how="cross").withColumn("parts", lower)
    value = lambda x: F.substr(x, F.lit(5))
    digits = lambda x: value(x).rlike("^[0-9]+$")
    number = lambda x: value(x).try_cast("long")
    ley = F.filter("parts", lambda x: x.startswith("ley:") & (~digits(x) | (F.coalesce(number(x), F.lit(0)).between(1, F.col("n_docs")))))
    jer = F.filter("parts", lambda x: x.startswith("jerarquia:"))
    rows = rows.withColumns({"_l": F.try_element_at(F.transform(ley, value), F.lit(-1)), "_j": F.try_element_at(F.transform(jer, lambda x: F.substr(x, F.lit(11))), F.lit(-1))})
    rows = rows.withColumn("_n", F.when(F.col("_l").rlike("^[0-9]+$"), F.col("_l").try_cast("long")))
    rows = rows.join(documents.select(F.col("ord").alias("_n"), F.col("value").alias("_v")), "_n", "left")
    words = F.filter(F.split(strip("raw"), r"(?U)\s+"), lambda p: (p != "") & ~F.lower(p).startswith("ley:") & ~F.lower(p).startswith("jerarquia:"))
    command = F.coalesce(*[F.when(F.lower(strip("raw")) == k, v) for k, v in COMMANDS.items()])
    return rows.select("query_id", "raw", F.array_join(words, " ").alias("consulta"), F.coalesce("_v", "_l").alias("filtro_documento"), F.col("_j").alias("filtro_jerarquia"), command.alias("command"))
