"""Helpers of the operators: table access, text columns, white space."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.session import materialize

#: Fixed value: the white space that separates words (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(column: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id bigint, text string`` (null text as empty); clashing extra columns go."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one row for each non-null doc_id: of rows that share an id, the
    smallest text stands for the document.  The regrouping, which moves texts, only runs when
    some id is repeated; the result is the same either way."""
    docs = docs.where(F.col("doc_id").isNotNull())
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"))


def write_narrow(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize` for rows of a few numbers, in an eighth of the shuffle's partitions (16 at least).

    The number of partitions is set for texts; such rows are some hundredth of them, so fewer files hold them as well.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.coalesce(max(16, parts // 8)), name)


#: A key is joined apart as hot when it holds this share of the rows; there are fewer than 1 / share such keys.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` (a written table) has for each key; ``size`` counts a key's rows.

    Keys of very many rows are at most 1 / ``HOT_SHARE``, so their groups are broadcast whatever the size of the
    table; all other keys are joined by a shuffle in which none is large.
    """
    total = groups.agg(F.sum(size).alias("__total"))
    marked = groups.join(F.broadcast(total), F.lit(True)).withColumn(
        "__hot", F.col(size) >= F.greatest(F.lit(2), F.col("__total") * HOT_SHARE)).drop("__total")
    marked = write_narrow(marked, "groups")
    hot, cold = (marked.where(c).drop("__hot") for c in ("__hot", "NOT __hot"))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
