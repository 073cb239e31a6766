"""Toxicity by non-negative positive-unlabelled learning.

Known are confirmed toxic documents and text without a label; no document is
known to be clean.  With the share of toxic documents (the class prior) π, the
risk of a classifier g is π·E⁺[l(g)] + max(0, Eᵘ[l(-g)] - π·E⁺[l(-g)]): the
second term stands for the clean documents, whose loss cannot be negative, so
a step that would make it so is taken back instead.  Some linear classifiers
over word parts are trained, each without a share of the unlabelled sample of
its own, and their margins are averaged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import text_of
from rillet.llm.terms import LETTERS, as_bytes, sliced, term_runs
from rillet.session import materialize

#: Bytes of the word parts, with a mark at each end of the word.
PARTS = range(4, 11)
#: A word part counts in three ways: found, found twice, found in a hundredth of the words.
LEVELS = 3
#: Word parts looked up in the unlabelled sample, and features kept for the classifiers.
MAX_CANDIDATES, MAX_FEATURES = 50_000, 4096
#: A feature's texts among the toxic ones must be so large a share of them (and three at least), and pass what is
#: usual by so many standard deviations.
MIN_SHARE, MIN_DEVIATIONS = 0.01, 5.0
#: Words whose features a task remembers.
REMEMBERED = 200_000


def word_counts(text: bytes) -> Counter:
    """Words of a text (letters, lower-cased) and how often each is there."""
    words: Counter = Counter()
    for run in term_runs(text.decode("utf-8", "replace").lower().encode(), LETTERS):
        words.update(run)
    return words


def parts_of(word: bytes) -> set[bytes]:
    """The parts of a word: runs of ``PARTS`` bytes of the word between its marks, and the whole (cut at 64 bytes)."""
    word = b"<" + word[:64] + b">"
    return {word, *(word[i: i + n] for n in PARTS for i in range(len(word) - n + 1))}


class Features:
    """Numbers for the features of texts: pairs of a word part and a level, in a given order."""

    def __init__(self, names: list[tuple[bytes, int]]):
        self.place: dict[bytes, list[int]] = {}
        for i, (part, level) in enumerate(names):
            self.place.setdefault(part, [-1] * LEVELS)[level] = i
        self.known: dict[bytes, list[bytes]] = {}

    def of(self, text: bytes) -> list[int]:
        words = word_counts(text)
        found: Counter = Counter()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word, n in words.items():
            parts = self.known.get(word)
            if parts is None:
                parts = self.known[word] = [p for p in parts_of(word) if p in self.place]
            for part in parts:
                found[part] += n
        total = words.total()
        out = []
        for part, n in found.items():
            here = self.place[part]
            out.extend(here[level] for level in levels(n, total) if here[level] >= 0)
        return sorted(out)


def levels(n: int, total: int) -> list[int]:
    return [0] + [1] * (n > 1) + [2] * (100 * n >= total)


def fit_margin(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, seed: int,
               epochs: int = 40, batches: int = 8, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one the constant) of a linear classifier by non-negative PU learning with logistic loss.

    Rows are the numbers of the features that a text has.  Each epoch deals both samples into ``batches``; steps are
    those of Adam.
    """
    def stacked(rows: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [rows[i] for i in order]
        return np.repeat(np.arange(len(some)), [r.size for r in some]), np.concatenate([*some, np.zeros(0, np.int64)])

    def slope(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, size: int, sign: int) -> tuple[float, np.ndarray]:
        """Mean of log(1 + exp(-sign·margin)) and its gradient."""
        z = sign * (np.bincount(rows, weights=w[cols], minlength=size) + w[-1])
        pull = -sign / (1 + np.exp(np.clip(z, -500, 500))) / size
        grad = np.bincount(cols, weights=pull[rows], minlength=w.size)
        grad[-1] += pull.sum()
        return float(np.logaddexp(0, -z).mean()), grad

    rng = np.random.default_rng(seed)
    w = np.zeros(n_features + 1)
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    w[-1] = math.log(prior / (1 - prior))
    n_batches = max(1, min(batches, len(positive), len(unlabelled)))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p, u in zip(np.array_split(p_order, n_batches), np.array_split(u_order, n_batches), strict=True):
            p_rows, p_cols = stacked(positive, p)
            u_rows, u_cols = stacked(unlabelled, u)
            _, up = slope(w, p_rows, p_cols, p.size, 1)
            p_loss, p_down = slope(w, p_rows, p_cols, p.size, -1)
            u_loss, u_down = slope(w, u_rows, u_cols, u.size, -1)
            clean = u_down - prior * p_down
            grad = prior * up + clean if u_loss - prior * p_loss >= 0 else -clean
            grad[:-1] += decay * w[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad ** 2
            w -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w


class ToxicModel:
    """Features and averaged weights."""

    def __init__(self, names: list[tuple[bytes, int]], weights: np.ndarray):
        self.features, self.weights = Features(names), weights.tolist()

    def score(self, text: bytes) -> float:
        margin = self.weights[-1] + math.fsum(self.weights[i] for i in self.features.of(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def held_out(doc_id: Column) -> Column:
    """Documents whose label is never learned: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _bounded(ids: DataFrame, n: int, limit: int, salt: str) -> DataFrame:
    """At most ``limit`` distinct ids of ``ids`` (doc_id, about ``n`` rows): those with the smallest md5.

    A threshold leaves about twice the limit first, so that the ordering is of bounded size.
    """
    digest = F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    some = ids.where(share < min(1.0, 2 * limit / max(n, 1))).distinct()
    return some.orderBy(digest, "doc_id").limit(limit)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_positive: int,
           max_unlabelled: int) -> tuple[DataFrame, dict[int, int]]:
    """``y, share, text`` of the training sample (y: 1 confirmed toxic, 0 unlabelled), and how many learnable labels
    there are of each kind."""
    told = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    found = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")) \
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = _bounded(told.where("y = 1").select("doc_id"), found.get(1, 0), max_positive, "toxic:")
    any_ = _bounded(rows.select("doc_id"), rows.count(), max_unlabelled, "unlabelled:")
    chosen = toxic.withColumn("y", F.lit(1)).unionByName(any_.withColumn("y", F.lit(0)))
    # At most max_positive + max_unlabelled ids; rows that share an id are one text (the smallest).
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int").alias("share")
    return materialize(texts.select("y", share, "text"), "toxicity-sample"), found


def choose_features(sampled: DataFrame, max_features: int) -> list[tuple[bytes, int]]:
    """The features that are most in excess in the confirmed toxic texts against the unlabelled ones."""
    def counted(only: set[bytes] | None):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            n = 0
            parts: dict[bytes, list[bytes]] = {}
            for batch in sliced(batches):
                for data in as_bytes(batch.column(0)):
                    words = word_counts(data)
                    here: Counter = Counter()
                    if len(parts) > REMEMBERED // 8:
                        parts.clear()
                    for word, k in words.items():
                        if word not in parts:
                            parts[word] = [p for p in parts_of(word) if only is None or p in only]
                        for part in parts[word]:
                            here[part] += k
                    total = words.total()
                    seen.update((p, v) for p, k in here.items() for v in levels(k, total))
                    n += 1
                    if len(seen) > 500_000:
                        yield batch_of(seen)
                        seen.clear()
            seen[b"", 0] = n  # how many texts
            yield batch_of(seen)
        return rows

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()),
             pa.array(list(seen.values()), pa.int64())], ["part", "level", "n"])

    schema = "part binary, level int, n bigint"
    per = F.sum("n").alias("n")
    least = max(3, math.ceil(MIN_SHARE * sampled.where("y = 1").count()))
    toxic = sampled.where("y = 1").select("text").mapInArrow(counted(None), schema).groupBy("part", "level").agg(per)
    top = toxic.where((F.col("n") >= least) | (F.col("part") == F.lit(b""))).orderBy(F.col("n").desc(), "part", "level").limit(LEVELS * MAX_CANDIDATES)
    inside = {(bytes(r["part"]), r["level"]): r["n"] for r in top.collect()}  # bounded by MAX_CANDIDATES
    n_toxic = inside.pop((b"", 0), 0)
    if not inside:
        return []
    outside = sampled.where("y = 0").select("text").mapInArrow(counted({p for p, _ in inside}), schema) \
        .groupBy("part", "level").agg(per)
    around = {(bytes(r["part"]), r["level"]): r["n"] for r in outside.collect()}  # bounded alike
    n_any = max(around.pop((b"", 0), 0), 1)
    excess = {}
    for f, n in inside.items():
        usual = n_toxic * (around.get(f, 0) + 1) / (n_any + 1)  # texts with it, were toxic ones like all
        if n - usual >= MIN_DEVIATIONS * math.sqrt(usual):
            excess[f] = n * math.log(n / usual)
    return sorted(excess, key=lambda f: (-excess[f], f))[:max_features]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        prior: float | None = None, max_positive: int = 3000, max_unlabelled: int = 6000, members: int = 3,
        max_features: int = MAX_FEATURES) -> ToxicModel | None:
    """The model; None without confirmed toxic examples or without features that tell them apart.

    It is fitted on at most ``max_positive`` confirmed toxic and ``max_unlabelled`` further documents, none of them
    held out.  ``prior`` is the share of toxic documents; by default that among the labels (0.1 if they are all toxic).
    """
    sampled, found = sample(docs, labels, doc_id, text, label, max_positive, max_unlabelled)
    if not found.get(1):
        return None
    if prior is None:
        prior = found[1] / (found[0] + found[1]) if found.get(0) else 0.1
    prior = min(max(prior, 1e-3), 0.5)
    names = choose_features(sampled, max_features)
    if not names:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in sliced(batches):
            rows = [features.of(data) for data in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["y", "share", "features"])

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[tuple(f) for f in rows["features"]]).sort_values(["share", "order"])
        sides = [[np.asarray(f, np.int64) for f in rows.loc[rows["y"] == y, "features"]] for y in (1, 0)]
        if not sides[0] or not sides[1]:
            return pd.DataFrame({"member": [], "place": [], "weight": []})
        weights = fit_margin(*sides, n_features=len(names), prior=prior, seed=key[0])
        return pd.DataFrame({"member": key[0], "place": np.arange(weights.size), "weight": weights})

    rows = sampled.mapInArrow(numbered, "y int, share int, features array<int>")
    # Each classifier has all toxic examples, and the others but for its own share: groups bounded by the sample.
    each = F.sequence(F.lit(0), F.lit(members - 1))
    others = each if members == 1 else F.filter(each, lambda m: m != F.col("share") % members)
    dealt = rows.withColumn("member", F.explode(F.when(F.col("y") == 1, each).otherwise(others)))
    trained = dealt.groupBy("member").applyInPandas(train, "member int, place int, weight double").toPandas()
    if trained.empty:
        return None
    weights = trained.sort_values(["place", "member"]).groupby("place")["weight"].mean().to_numpy()
    return ToxicModel(names, weights)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             threshold: float = 0.5, **options) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted`` (see :func:`fit` for the options).

    ``score`` is the chance that the text is toxic, from the text alone; ``predicted`` is 1 from ``threshold`` on.
    Labels of held-out documents (:func:`held_out`; null ids too) are never read.  Repeated rows are scored alike;
    null texts score as empty ones, by the constant of the model.  Without a model all score 0.  Conflicting labels
    of a document count as toxic; null labels and labels of unknown documents do not count.  An empty table gives
    an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, **options))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = model.value
        for batch in sliced(batches):
            values = [told.score(data) if told else 0.0 for data in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    scored = keyed.mapInArrow(rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
