"""Quality classifier: document evidence combined with host- and path-level posteriors (empirical Bayes).

A classifier over hashed character n-grams gives each document a probability.
Grouped sums shrink the mean of a host towards the corpus and the mean of a
path (host and path) towards its host; sparse groups stay near their parent.
The path's posterior, as log-odds against the corpus, shifts the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillet.llm import ngrams
from rillet.session import materialize


def _style(text: str) -> np.ndarray:
    """Code points as they are: case, marks and layout count."""
    return ngrams.codes(text, lower=False)


class EvidenceModel:
    """Naive Bayes over n-grams, calibrated by a logistic curve on labelled rows it was not fitted on."""

    def __init__(self, counts: np.ndarray, smoothing: float = 0.5):
        p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        self.weights = np.log(p[1] / p[0]).astype(np.float32)[:, None]
        self.slope, self.shift = 1.0, 0.0

    def margin(self, text: str) -> float:
        points = _style(text)
        return float(ngrams.mean_scores(points, self.weights)[0]) if points.size else 0.0

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> None:
        """Newton steps of a logistic regression with a small ridge."""
        x = np.stack([margins, np.ones_like(margins)], axis=1)
        w = np.zeros(2)
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = x.T @ (x * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hess, x.T @ (q - labels) + 1e-3 * w)
        self.slope, self.shift = float(w[0]), float(w[1])

    def probability(self, text: str) -> float:
        z = self.slope * self.margin(text) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        max_per_label: int = 2000) -> EvidenceModel | None:
    """The model from at most ``max_per_label`` labelled documents of each label (smallest md5 of the id).

    Half of them (by crc32 of the id) fit the n-grams, the other half the calibration.  None when a
    label has no documents in either half.  Null labels, ids and texts are left out.
    """
    told = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    # A threshold on the digest leaves about twice the limit of each label, whatever the number; only these are ranked.
    digest = F.md5(F.col("doc_id").cast("string"))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    sizes = told.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # two rows
    told = told.join(F.broadcast(sizes), "label").where(share * F.col("n") < 2 * max_per_label).drop("n")
    order = Window.partitionBy("label").orderBy(digest, "doc_id")
    told = told.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_per_label).drop("rn")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .where(F.col("text") != "")
    # At most 2 × max_per_label ids; rows that share an id are one text (the smallest).
    sample = rows.join(F.broadcast(told), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")) \
        .withColumn("half", (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int"))
    sample = materialize(sample.select("label", "half", "text"), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ngrams.BUCKETS), np.int64)
        for batch in batches:
            for y, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = _style(value)
                for at in range(0, points.size, 1 << 16):
                    sums[y] += np.bincount(ngrams.hashed(points[at: at + (1 << 16) + 2]), minlength=ngrams.BUCKETS)
        y, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(y, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[y, bucket], pa.int64())],
            ["label", "bucket", "n"])

    # The model: at most 2 × BUCKETS numbers.
    found = sample.where("half = 0").select("label", "text").mapInArrow(count, "label int, bucket int, n bigint") \
        .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if found["label"].nunique() < 2:
        return None
    counts = np.zeros((2, ngrams.BUCKETS))
    counts[found["label"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    model = EvidenceModel(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.margin(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["label", "margin"])

    # Two numbers for each row of the bounded sample.
    held = sample.where("half = 1").select("label", "text").mapInArrow(margins, "label int, margin double").toPandas()
    if held["label"].nunique() < 2:
        return None
    held = held.sort_values(["label", "margin"])
    model.calibrate(held["margin"].to_numpy(), held["label"].to_numpy().astype(float))
    return model


def evidence(docs: DataFrame, model: EvidenceModel | None, doc_id: str, text: str, host: Column,
             path: Column) -> DataFrame:
    """``doc_id, host, path, evidence`` of each row; 0.5 without a text or a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
                        F.col(text).cast("string").alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            values = [model.probability(t) if model and t else 0.5 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.float64())],
                                             ["doc_id", "host", "path", "evidence"])

    return keyed.mapInArrow(rows, f"doc_id {kind}, host string, path string, evidence double")


def _strength(groups: DataFrame, parent_mean: str, total: str) -> DataFrame:
    """One row, ``k``: how many documents the prior counts for, from the spread of group means about their
    parents beyond what sampling explains (method of moments), held to 1 … 10,000."""
    within = F.col(parent_mean) * (1 - F.col(parent_mean))
    between = F.pow(F.col("mean") - F.col(parent_mean), 2)
    sums = groups.agg(F.sum(F.col(total) * between).alias("b"), F.sum(within).alias("w"),
                      F.sum(F.col(total)).alias("n"), F.sum(F.col(total) * within).alias("nw"))
    spread = F.greatest(F.col("b") - F.col("w"), F.lit(0.0)) / F.col("n")
    k = F.when(spread > 1e-9, F.col("nw") / F.col("n") / spread).otherwise(F.lit(10_000.0))
    return sums.select(F.least(F.greatest(F.coalesce(k, F.lit(1.0)), F.lit(1.0)), F.lit(10_000.0)).alias("k"))


def posteriors(rated: DataFrame) -> DataFrame:
    """``host, path, n, host_posterior, path_posterior, corpus_mean`` from rows ``host, path, evidence``."""
    paths = rated.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"))
    paths = materialize(paths, "path-sums")  # one row a path, read for each level
    corpus = paths.agg((F.sum("s") / F.sum("n")).alias("corpus_mean"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")) \
        .join(F.broadcast(corpus)).withColumn("mean", F.col("host_s") / F.col("host_n"))
    hosts = hosts.join(F.broadcast(_strength(hosts, "corpus_mean", "host_n"))).select(
        "host", "corpus_mean",
        ((F.col("host_s") + F.col("k") * F.col("corpus_mean")) / (F.col("host_n") + F.col("k")))
        .alias("host_posterior"))
    paths = paths.join(hosts, "host").withColumn("mean", F.col("s") / F.col("n"))
    return paths.join(F.broadcast(_strength(paths, "host_posterior", "n"))).select(
        "host", "path", "n", "host_posterior", "corpus_mean",
        ((F.col("s") + F.col("k") * F.col("host_posterior")) / (F.col("n") + F.col("k"))).alias("path_posterior"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def quality_classifier(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       host: Column | None = None, path: Column | None = None, label: str = "quality",
                       max_per_label: int = 2000, threshold: float = 0.5, group_weight: float = 1.0) -> DataFrame:
    """One row per input row: ``doc_id, host, path, evidence, host_posterior, path_posterior, score, kept``.

    ``score`` is the document's probability of being good: its evidence's log-odds plus ``group_weight`` times the
    log-odds of the path's posterior against the corpus; ``kept`` where it is ``threshold`` or more.

    Without ``host`` and ``path``, ``source`` and ``lang`` stand in for them, as in the registered query: its table
    has no URL, and these are the columns that group its documents.  Path posteriors are then means by language
    within a source.

    Null or empty texts have evidence 0.5; null hosts and paths are ``""``; without usable labels all evidence
    is 0.5 and everything is kept.  Repeated rows each count and each get a row; an empty table gives an
    empty result.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, doc_id, text, label, max_per_label)
    rated = materialize(evidence(docs, model, doc_id, text, host, path), "quality-evidence")
    both = rated.join(posteriors(rated), ["host", "path"])
    shift = _logit(F.col("path_posterior")) - _logit(F.col("corpus_mean"))
    z = _logit(F.col("evidence")) + group_weight * shift
    score = 1 / (1 + F.exp(-z))
    return both.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior",
                       score.alias("score"), (score >= threshold - 1e-9).alias("kept"))
