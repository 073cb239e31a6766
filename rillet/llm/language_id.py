"""Language identification by error-correcting output codes.

Each language has a codeword.  For each bit a linear classifier over hashed
character n-grams (naive Bayes between the languages with a 1 and those with
a 0) predicts the bit; decoding takes the language whose codeword has the least
loss, each bit weighted by how far its classifier parts the two sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillet.llm import ngrams

UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """``k`` codewords of +1 / -1: rows of a Hadamard matrix of at least 16 columns without its constant one.

    Any two differ in half of the bits.
    """
    m = max(4, int(np.ceil(np.log2(max(k, 2)))) + 1)
    i = np.arange(1 << m)
    parity = np.zeros((1 << m, 1 << m), np.int64)
    both = i[:, None] & i[None, :]
    for bit in range(m):
        parity ^= (both >> bit) & 1
    return (1 - 2 * parity)[1: k + 1, 1:] if k < 1 << m else (1 - 2 * parity)[:k, 1:]


class CodeModel:
    """Bit classifiers and decoder fitted to n-gram counts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        code = codewords(len(languages))
        p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        usable = (code.max(axis=0) > 0) & (code.min(axis=0) < 0)  # bits with languages on both sides
        self.code = code[:, usable].astype(float)
        weights = np.stack([np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in self.code.T],
                           axis=1) if usable.any() else np.zeros((counts.shape[1], 0))
        expected = p @ weights  # mean margin of each language in each bit
        ones = np.where(self.code > 0, expected, np.inf).min(axis=0, initial=np.inf)
        zeros = np.where(self.code < 0, expected, -np.inf).max(axis=0, initial=-np.inf)
        self.middle = (ones + zeros) / 2 if usable.any() else np.zeros(0)
        self.half = np.maximum((ones - zeros) / 2, 1e-3) if usable.any() else np.zeros(0)
        self.weights = weights.astype(np.float32)

    def predict(self, text: str) -> tuple[str, float, float]:
        """``(language, score, lead)``: score is the share of the best language in the decoded losses (soft-max),
        lead its distance in loss to the next one, per bit."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        margin = (ngrams.mean_scores(ngrams.codes(text), self.weights) - self.middle) / self.half
        loss = (np.logaddexp(0, -3 * self.code * margin) * self.half).sum(axis=1) / self.half.sum()
        order = np.argsort(loss, kind="stable")
        share = np.exp(-4 * (loss - loss[order[0]]))
        return self.languages[order[0]], float(1 / share.sum()), float(loss[order[1]] - loss[order[0]])


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        max_per_language: int = 1000) -> CodeModel | None:
    """The model from at most ``max_per_language`` documents of each language (those with the smallest md5 of
    the id), never from held-out ones, nulls or empty texts; None when there are none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != ""))
    # A threshold on the digest leaves about twice the limit of each language, whatever the number of rows; only these
    # are ranked.  There are as many languages as the model holds, and at most ``max_per_language`` ids of each.
    digest = F.md5(F.col("doc_id").cast("string"))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang") \
        .where(share * F.col("n") < 2 * max_per_language).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(digest, "doc_id")
    chosen = few.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_per_language).drop("rn")
    # Rows that share an id and a language are one text (the smallest).
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")) \
        .select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, value in zip(frame["lang"], frame["text"], strict=True):
                points = ngrams.codes(value)
                total = sums.setdefault(name, np.zeros(ngrams.BUCKETS, np.int64))
                for at in range(0, points.size, 1 << 16):
                    total += np.bincount(ngrams.hashed(points[at: at + (1 << 16) + 2]), minlength=ngrams.BUCKETS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": used, "n": total[used]})

    counts = sample.mapInPandas(count, "lang string, bucket int, n bigint") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # The model: at most BUCKETS numbers for each language.
    found = counts.toPandas()
    if found.empty:
        return None
    languages = sorted(found["lang"].unique())
    table = np.zeros((len(languages), ngrams.BUCKETS))
    table[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy()] = found["n"].to_numpy()
    return CodeModel(languages, table)


def identify(docs: DataFrame, model: CodeModel | None, doc_id: str = "doc_id", text: str = "text",
             min_lead: float = 0.15) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, ambiguous``.

    ``und`` with score 0 where the text is null or has no letter, or without a model.  ``ambiguous``: the next
    language's loss is less than ``min_lead`` above the best one's.  Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: languages × BUCKETS bits' weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for value in batch.column(1).to_pylist():
                if model is None or value is None or not any(map(str.isalpha, value)):
                    out.append((UNKNOWN, 0.0, True))
                else:
                    lang, score, lead = model.predict(value)
                    out.append((lang, score, lead < min_lead))
            langs, scores, doubtful = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(doubtful, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                max_per_language: int = 1000) -> DataFrame:
    """Fits on the rows that are not held out and predicts all: adds ``held_out`` to :func:`identify`'s columns.

    Null doc_ids count as held out.  Repeated rows each get a row; an empty table gives an empty result.
    """
    model = fit(docs, doc_id, text, lang, max_per_language)
    told = identify(docs, model, doc_id, text)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


