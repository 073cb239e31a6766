"""Exact de-duplication through a persistent digest index, in DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest.  A batch is
reduced to one row for each digest, anti-joined with the index (the index
side is read in bucket order, with no shuffle) and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.common import unique_name
from rillet.llm.common import SPACE, text_of, write_narrow
from rillet.session import materialize, scratch_path

#: A digest is split off as hot when it holds this share of the rows; there are fewer than 1 / share such digests.
HOT_SHARE = 1 / 1000
#: Rows of a batch for each bucket of a new index (some hundred MB of digests), and its least number of buckets.
ROWS_PER_BUCKET, MIN_BUCKETS = 4_000_000, 64


class DigestIndex:
    """Digests seen so far: ``digest, keep_id``, in a table at ``path`` (a shared folder).

    The same path opened again, also in another session, goes on with what is there, in the number of buckets it
    was made with (a row of its own beside the buckets); ``buckets`` counts for a new index only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = MIN_BUCKETS):
        self.spark, self.path = spark, path
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_made")
        if made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):
            buckets = spark.read.schema("buckets int").parquet(made.toString()).first()["buckets"]
        else:
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).coalesce(1).write.parquet(made.toString())
        self.buckets = buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Appends the digests of ``groups`` (digest, keep_id) that the index does not hold."""
        new = groups.select("digest", "keep_id").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")  # one file for each bucket and append
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest") \
            .option("path", self.path).saveAsTable(self.name)


def new_index(spark: SparkSession, n_rows: int) -> DigestIndex:
    """A fresh index in the shared folder, with buckets enough for ``n_rows``."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), max(MIN_BUCKETS, -(-n_rows // ROWS_PER_BUCKET)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest`` of each row: sha-256 (hex) of the text with each run of white space as one space."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.sha2(F.regexp_replace(text_of(text), SPACE, " "), 256).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts in the batch the row with the smallest doc_id stays (``keep_id``), unless the index already
    holds the digest: then none stays and ``keep_id`` is the id in the index.  ``group_size`` counts the
    batch's rows with that text.  Without an index a fresh one in the shared folder is used.

    Null text counts as empty and as equal to empty texts.  A null doc_id comes after all others, and is kept
    only if its text has no other row.  Where the row that stays is repeated with its id, exactly one of the
    repeats is kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # A digest a row, written once: the row numbers stay as they are for all later reads.
    rows = materialize(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    index = index or new_index(spark, rows.count())
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("batch_id"), F.count(F.lit(1)).alias("group_size"))
    # A flag of its own says that the index holds the digest: its keep_id is null where all its rows had null ids.
    known = index.table().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    groups = groups.join(known.hint("merge"), "digest", "left")
    groups = write_narrow(groups.select(
        "digest", "group_size", "batch_id", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("batch_id"))
        .alias("keep_id"), F.col("known").isNull().alias("new")), "digest-groups")
    index.append(groups.where("new"))
    # Repeats of the row that stays: the first row number among them is the one.
    stay = rows.join(groups.where("group_size > 1 AND new").select("digest", "batch_id"), "digest") \
        .where(F.col("doc_id").eqNullSafe(F.col("batch_id"))).groupBy("digest").agg(F.min("row").alias("stay_row"))
    groups = groups.drop("batch_id")
    shared = groups.where("group_size > 1").join(stay, "digest", "left")
    # Digests of very many rows: at most 1 / HOT_SHARE of them, so they can be broadcast whatever the size of
    # the table; all other digests are joined by a shuffle in which none is large.
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    hot = shared.join(F.broadcast(total), F.col("group_size") >= F.greatest(F.lit(2), F.col("n") * HOT_SHARE)) \
        .drop("n")
    hot = write_narrow(hot, "hot-digests")
    cold = groups.where("group_size = 1").withColumn("stay_row", F.lit(None).cast("bigint")).unionByName(
        shared.join(F.broadcast(hot.select("digest")), "digest", "left_anti"))
    by_hot = rows.join(F.broadcast(hot), "digest")
    by_rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    kept = F.col("new") & ((F.col("group_size") == 1) | F.coalesce(F.col("row") == F.col("stay_row"), F.lit(False)))
    return by_hot.unionByName(by_rest).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup_in_ranges(docs: DataFrame, ranges: int = 3, index: DigestIndex | None = None, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """The rows of :func:`exact_dedup`, with the table fed through one index in ascending ranges of doc_id.

    What an earlier range holds decides the later ones through the index; ``group_size`` counts the rows of all
    ranges.  Null doc_ids come in the last range.
    """
    key = F.col(doc_id).cast("bigint")
    cuts, n_rows = docs.agg(F.percentile_approx(key, [i / max(ranges, 2) for i in range(1, max(ranges, 2))]),
                            F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or [])) if ranges > 1 else []
    index = index or new_index(docs.sparkSession, n_rows)
    found = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs if low is None else docs.where((key > low) | key.isNull())
        part = part if high is None else part.where(key <= high)
        verdict = exact_dedup(part, index, doc_id, text).drop("group_size")
        found = verdict if found is None else found.unionByName(verdict)
    found = write_narrow(found, "range-verdicts")
    shared = write_narrow(found.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"),
                         "group-sizes")
    # As above: digests of very many rows are few and broadcast, all others are joined by a shuffle.
    total = found.agg(F.count(F.lit(1)).alias("n"))
    hot = write_narrow(shared.join(F.broadcast(total), F.col("n_rows") >= F.greatest(
        F.lit(2), F.col("n") * HOT_SHARE)).drop("n"), "hot-sizes")
    names = F.broadcast(hot.select("text_sha256"))
    by_rest = found.join(names, "text_sha256", "left_anti").join(
        shared.join(names, "text_sha256", "left_anti"), "text_sha256", "left")
    return found.join(F.broadcast(hot), "text_sha256").unionByName(by_rest).select(
        "doc_id", "keep_id", F.coalesce("n_rows", F.lit(1)).cast("bigint").alias("group_size"), "kept", "text_sha256")


def keep_first(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text :func:`exact_dedup` keeps, all columns.

    Rows that go are matched by doc_id, so repeats of the row that stays would stay with it: such ids are reduced
    to one row each (any of them: they agree in id and text).  Rows with a null doc_id go unless their text is
    the only one (then they stay).
    """
    verdict = write_narrow(exact_dedup(docs, index, doc_id, text), "exact-verdicts")
    by_id = verdict.groupBy("doc_id").agg(
        F.sum(F.col("kept").cast("int")).alias("n_kept"), F.count(F.lit(1)).alias("n")).where("n_kept < n")
    id_, digest, kept_ = (unique_name(docs, x) for x in ("__id", "__digest", "__kept"))
    part = by_id.where("n_kept > 0").select(F.col("doc_id").alias(id_))
    out = docs.join(by_id.select(F.col("doc_id").alias(id_)), docs[doc_id].eqNullSafe(F.col(id_)), "left_anti")
    if part.isEmpty():
        return out
    # Ids with both kept and dropped rows: the texts decide, one row for each kept text.
    kept = verdict.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(kept_))
    some = docs.join(part, docs[doc_id].eqNullSafe(F.col(id_)), "left_semi")
    some = some.withColumn(digest, F.sha2(F.regexp_replace(text_of(text), SPACE, " "), 256))
    some = some.join(kept, docs[doc_id].eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(kept_)), "left_semi")
    return out.unionByName(some.dropDuplicates([doc_id, digest]).select(*docs.columns))
