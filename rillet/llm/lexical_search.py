"""Ranked lexical search with a document FP-tree and depth-first branch-and-bound.

Documents are reduced to their counts of the items' terms.  Tasks cut their
documents into chunks and build a tree of each: a document's terms, the most
frequent of the corpus first, are a path, and documents that begin alike share
it.  A node knows the largest count of each term and the smallest length
factor ``m`` below it, so an item's score of any document below is bounded;
each item walks the tree depth first, the highest bound first, and leaves out
what is bounded under the lowest of its best documents so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillet.llm.terms import LETTERS_DIGITS, as_bytes, sliced, term_runs
from rillet.session import materialize

#: (item, term) pairs that are searched for at once; more items are searched for in further passes over the documents.
#: They, their terms and the terms' document counts are what a pass broadcasts and brings to the driver.
BLOCK_TERMS = 200_000
#: Documents, and counts of terms in them, that a tree is made of.
TREE_DOCS, TREE_COUNTS = 8192, 1_000_000
#: Documents that a leaf may hold before it is parted by a further term.
LEAF = 16
#: Parts of an item's candidates that are ranked apart before the last ranking.
SALTS = 64


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term`` (distinct) of each item; rows that share an item_id are one item, null ids are left out."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = sorted({w for run in term_runs(data, LETTERS_DIGITS) for w in run})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    keyed = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    return keyed.where(F.col("item_id").isNotNull()).mapInArrow(rows, "item_id bigint, term binary").distinct()


def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, ids, counts`` of each document with a term: all its terms, and how often it has those of the
    vocabulary (bounded by ``BLOCK_TERMS``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in sliced(batches):
            keys, total, ids, counts, ends = [], [], [], [], [0]
            for key, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                n, tf = 0, Counter()
                for run in term_runs(data, LETTERS_DIGITS):
                    n += len(run)
                    tf.update(run)
                if n:
                    known = [(place[w], c) for w, c in tf.items() if w in place]
                    ids.extend(i for i, _ in known)
                    counts.extend(c for _, c in known)
                    keys.append(key)
                    total.append(n)
                    ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(total, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["doc_id", "n", "ids", "counts"])

    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return keyed.mapInArrow(rows, "doc_id bigint, n bigint, ids array<int>, counts array<int>")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], ["id", "df"])

    held = np.zeros(size, np.int64)
    for row in vectors.select("ids").mapInArrow(rows, "id bigint, df bigint").groupBy("id").agg(
            F.sum("df").alias("df")).collect():  # a row a term of the block
        held[row["id"]] = row["df"]
    return held


def scores(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum over the terms (columns) of weight · (10⁹·tf div (1000·tf + 20·m)), a row for each of ``m``."""
    return (weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))).sum(axis=1)


class DocumentTree:
    """FP-tree of documents: rows of ``ranks`` (terms by falling frequency, rising in a row) with their counts.

    Paths without a branch are one node, and leaves hold up to ``LEAF`` documents (or any number with the same
    terms); neighbouring small children of a node are one leaf.
    """

    def __init__(self, ranks: np.ndarray, counts: np.ndarray, ends: np.ndarray, m: np.ndarray, n_ranks: int):
        self.n_ranks = n_ranks
        self.starts = np.concatenate([[0], ends[:-1]])
        self.ends = ends
        self.ranks, self.counts, self.m = ranks, counts, m
        docs = np.repeat(np.arange(ends.size), ends - self.starts)
        self.doc_keys = docs * n_ranks + ranks  # rising: (document, rank)
        self.children: list[np.ndarray] = []
        self.documents: list[np.ndarray | None] = []
        self.least_m: list[int] = []
        self._keys: list[np.ndarray] = []
        self._values: list[np.ndarray] = []
        self._largest = np.zeros(n_ranks, np.int64)
        self._build()
        sizes = [k.size for k in self._keys]
        self.node_keys = np.concatenate(self._keys) + np.repeat(np.arange(len(sizes)), sizes) * n_ranks
        self.node_values = np.concatenate(self._values)
        self.least = np.array(self.least_m, np.int64)
        del self._keys, self._values

    def _term(self, docs: np.ndarray, depth: int) -> np.ndarray:
        at = self.starts[docs] + depth
        inside = at < self.ends[docs]
        out = np.full(docs.size, -1, np.int64)
        out[inside] = self.ranks[at[inside]]
        return out

    def _parts(self, docs: np.ndarray, depth: int) -> tuple[list[np.ndarray], int]:
        """The documents parted by their first differing term from ``depth`` on, and the depth below it; one part
        alone if they are few or have the same terms."""
        while docs.size > LEAF:
            term = self._term(docs, depth)
            if (term == term[0]).all():
                if term[0] < 0:
                    break
                depth += 1
                continue
            order = np.argsort(term, kind="stable")
            docs, term = docs[order], term[order]
            cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), docs.size]
            parts, small = [], []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > LEAF:
                    parts.append(docs[a:b])
                    continue
                if small and sum(x.size for x in small) + b - a > LEAF:
                    parts.append(np.concatenate(small))
                    small = []
                small.append(docs[a:b])
            if small:
                parts.append(np.concatenate(small))
            # A part's documents share its term only if it is no union of small ones; those are leaves.
            return parts, depth + 1
        return [docs], depth

    def _note(self, keys: np.ndarray, values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The largest value of each key."""
        np.maximum.at(self._largest, keys, values)
        some = np.unique(keys)
        top = self._largest[some].copy()
        self._largest[some] = 0
        return some, top, least

    def _leaf(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        sizes = self.ends[docs] - self.starts[docs]
        at = np.repeat(self.starts[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return self._note(self.ranks[at], self.counts[at], int(self.m[docs].min()))

    def _build(self) -> None:
        """Nodes from the root down (children numbered together), their maxima from the leaves up."""
        todo = [(np.arange(self.ends.size), 0)]
        at = 0
        while at < len(todo):
            docs, depth = todo[at]
            parts, below = self._parts(docs, depth)
            if len(parts) == 1:
                self.children.append(np.zeros(0, np.int64))
                self.documents.append(docs)
            else:
                self.children.append(np.arange(len(todo), len(todo) + len(parts)))
                self.documents.append(None)
                todo.extend((p, below) for p in parts)
            todo[at] = (None, 0)
            at += 1
        noted: list = [None] * at
        for node in range(at - 1, -1, -1):
            if self.documents[node] is not None:
                noted[node] = self._leaf(self.documents[node])
            else:
                below = [noted[c] for c in self.children[node]]
                noted[node] = self._note(np.concatenate([b[0] for b in below]), np.concatenate([b[1] for b in below]),
                                         min(b[2] for b in below))
        for keys, values, least in noted:
            self._keys.append(keys)
            self._values.append(values)
            self.least_m.append(least)

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not keys.size:
            return np.zeros(wanted.shape, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def bounds(self, nodes: np.ndarray, ranks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each node, no document below it scores more."""
        tf = self._found(self.node_keys, self.node_values, nodes[:, None] * self.n_ranks + ranks)
        return scores(weight, tf, self.least[nodes])

    def exact(self, docs: np.ndarray, ranks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        tf = self._found(self.doc_keys, self.counts, docs[:, None] * self.n_ranks + ranks)
        return scores(weight, tf, self.m[docs])

    def search(self, ranks: np.ndarray, weight: np.ndarray, best: Best, order: np.ndarray, ids: np.ndarray) -> None:
        """Adds the tree's documents to ``best`` that may be among them (``order``, ``ids``: rank and id of a tie)."""
        stack = [(int(b), 0) for b in self.bounds(np.zeros(1, np.int64), ranks, weight)]
        while stack:
            bound, node = stack.pop()
            if bound < max(best.floor, 1):
                continue
            docs = self.documents[node]
            if docs is not None:
                found = self.exact(docs, ranks, weight)
                good = found >= max(best.floor, 1)
                best.add(found[good], order[docs[good]], ids[docs[good]])
                continue
            below = self.children[node]
            bound_of = self.bounds(below, ranks, weight)
            rise = np.argsort(bound_of, kind="stable")
            rise = rise[bound_of[rise] >= max(best.floor, 1)]
            stack.extend(zip(bound_of[rise].tolist(), below[rise].tolist(), strict=True))


class Best:
    """The best documents of an item so far, by falling score and rising id (null ids last)."""

    def __init__(self, top: int):
        self.top, self.floor = top, 0
        self.score = self.order = self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, order: np.ndarray, ids: np.ndarray) -> None:
        if not score.size:
            return
        score, order, ids = (np.concatenate(x) for x in ((self.score, score), (self.order, order), (self.id, ids)))
        keep = np.lexsort((ids, order, -score))[: self.top]
        self.score, self.order, self.id = score[keep], order[keep], ids[keep]
        if keep.size == self.top:
            self.floor = int(self.score[-1])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches as tables for one tree each."""
    held, docs, counts = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            docs += part.num_rows
            counts += len(part.column(2).flatten())
            if docs >= TREE_DOCS or counts >= TREE_COUNTS:
                yield pa.Table.from_batches(held)
                held, docs, counts = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _tree(chunk: pa.Table, rank_of: np.ndarray, n_docs: int, n_terms: int) -> DocumentTree:
    n = chunk.column("n").to_numpy()
    lists, counts = chunk.column("ids").combine_chunks(), chunk.column("counts").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    docs = np.repeat(np.arange(sizes.size), sizes)
    ranks = rank_of[lists.flatten().to_numpy()]
    order = np.argsort(docs * rank_of.size + ranks, kind="stable")
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return DocumentTree(ranks[order], counts.flatten().to_numpy().astype(np.int64)[order], np.cumsum(sizes), m, rank_of.size)


def best_of_tasks(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], held: np.ndarray, n_docs: int, n_terms: int,
                  top: int) -> DataFrame:
    """``item_id, doc_id, score``: the best documents of each item in each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    rank_of = np.empty(held.size, np.int64)
    rank_of[np.argsort(-held, kind="stable")] = np.arange(held.size)
    asked = [(item, np.sort(rank_of[ids]), weight[ids[np.argsort(rank_of[ids])]]) for item, ids in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((asked, rank_of))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rank_of = shared.value
        best = [Best(top) for _ in asked]
        for chunk in _chunks(batches):
            ids = chunk.column("doc_id").combine_chunks()
            order, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            tree = _tree(chunk, rank_of, n_docs, n_terms)
            for (_, ranks, weight), found in zip(asked, best, strict=True):
                tree.search(ranks, weight, found, order, ids)
        sizes = [b.score.size for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([a[0] for a in asked], np.int64), sizes)),
                 pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.order for b in best]) > 0),
                 pa.array(np.concatenate([b.score for b in best]))], ["item_id", "doc_id", "score"])

    return vectors.mapInArrow(rows, "item_id bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``top`` documents of highest score above 0, equal scores by
    ascending doc_id.

    Terms are runs of ASCII letters and digits and of everything above ASCII, A-Z lower-cased.  With N documents that
    have a term, L terms in all, n in a document, df documents with a term and tf its occurrences in one, a term weighs
    floor(1000·ln((2N + 2) / (2df + 1))), a document's m is 50 + (50·n·N div L), and its score sums
    weight · (10⁹·tf div (1000·tf + 20·m)) over the item's terms.

    Every row of ``docs`` is a document, so repeated rows each get a rank; a null text has no terms; null doc_ids come
    after all others of their score.  Rows of ``items`` that share an item_id are one item, those with a null id are
    left out, and items without a known term have no rows.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    wanted = materialize(item_terms(items, item_id, item_text), "item-terms")
    n_blocks = -(-wanted.count() // BLOCK_TERMS)
    out = []
    for block in range(n_blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        by_item: dict[int, list[bytes]] = {}
        for row in mine.toLocalIterator():
            by_item.setdefault(row["item_id"], []).append(bytes(row["term"]))
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in by_item.values() for w in ws}))}
        queries = [(item, np.array([vocabulary[w] for w in ws])) for item, ws in sorted(by_item.items())]
        vectors = materialize(restricted_vectors(docs, vocabulary, doc_id, text), "term-vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs and queries:
            held = document_counts(vectors, len(vocabulary))
            out.append(best_of_tasks(vectors, queries, held, n_docs, n_terms, top))
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    falling = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = Window.partitionBy("item_id", "salt").orderBy(*falling)
    some = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank", "salt")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*falling))
    return some.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
