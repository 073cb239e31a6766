"""Near-duplicate documents by minhash with tensored banding and exact verification.

Two collections of ``m`` small hashes are made, each of three minhashes.  The
m² tables are keyed by one small hash of either collection, so 6·m minhashes
serve m² tables of six.  Documents that meet in a table are candidates; a
link is confirmed on the full shingle sets.

A table's bucket is first compared only with the member that meets the most
others (a star); in a family of edited copies that is the text they stem from,
so these links join most of it.  Members that are left outside their star's
component are then compared with all members of the star.  An odd sketch (the
parity of the shingles in each of 4 to 8 bits per shingle) bounds the symmetric
difference of two sets from below, so it drops pairs in the join itself and
never loses a link; what passes is checked on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.common import unique_name
from rillet.llm import shingles
from rillet.llm.common import join_groups, keyed_texts, one_row_per_id, write_narrow
from rillet.llm.components import components
from rillet.llm.terms import as_bytes, sliced
from rillet.session import materialize

#: Small hashes in each of the two collections: a pair with similarity 0.8 meets in some of the 196 tables with
#: probability (1 - (1 - 0.8³)¹⁴)² = 0.9999, one with 0.85 with 0.999997.
SMALL = 14
#: Minhashes in a small hash.
WIDTH = 3
#: Of the 84 one-bit sketches of a pair with similarity 0.8 or more, more than 25 differ with probability 2e-7.
MAX_SKETCH_DISTANCE = 25

#: Rows of a star's two sides that meet in one block of the comparison within stars.
OUTSIDE_BLOCK, MEMBER_BLOCK = 256, 4096
#: Rows of the broadcast filter of ids (16,777,216 bits, about 8 MB).
FILTER_WORDS = 1 << 18

_SIGNATURE = ("doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, sketch1 bigint, sketch2 bigint, "
              "small array<bigint>, odd array<bigint>")


def _pieces(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (UTF-8) of a batch, in pieces of half a MB: a worker's arrays are about 50 bytes a byte of text."""
    keys, texts, size = [], [], 0
    for part in sliced([batch]):
        for key, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def signatures(docs: DataFrame, n_words: int) -> DataFrame:
    """Set size, set digest (128 bits), one-bit sketches, small hashes and odd sketch of each document (doc_id, text)."""
    n_hashes = 2 * SMALL * WIDTH

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _pieces(batch):
                sets = shingles.shingle_sets(texts, n_words)
                size = np.array([s.size for s in sets], np.int64)
                some = np.flatnonzero(size)
                digest = np.zeros((len(sets), 2), np.int64)
                sketch = np.zeros((len(sets), 2), np.int64)
                small = np.zeros((len(sets), 2 * SMALL), np.int64)
                if some.size:
                    full = [sets[i] for i in some]
                    digest[some] = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                                    for s in full]
                    least = shingles.mix64(shingles.minhashes(full, n_hashes))
                    bits = (least >> np.uint64(40) & np.uint64(1)).reshape(some.size, 2, n_hashes // 2)
                    place = np.uint64(1) << np.arange(n_hashes // 2, dtype=np.uint64)
                    sketch[some] = (bits * place).sum(axis=2, dtype=np.uint64).view(np.int64)
                    acc = np.broadcast_to(np.arange(2 * SMALL, dtype=np.uint64), (some.size, 2 * SMALL)).copy()
                    for k in range(WIDTH):
                        acc = shingles.mix64(acc * np.uint64(0xD6E8FEB86659FD93) + least[:, k::WIDTH])
                    small[some] = acc.view(np.int64)
                flat = pa.array(small[some].reshape(-1))
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, 2 * SMALL, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     pa.array(sketch[:, 0]), pa.array(sketch[:, 1]),
                     pa.ListArray.from_arrays(pa.array(ends), flat), _lists([shingles.odd_sketch(s) for s in sets])],
                    ["doc_id", "n_shingles", "set1", "set2", "sketch1", "sketch2", "small", "odd"])

    return docs.mapInArrow(rows, _SIGNATURE)


def full_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """``doc_id, shingles array<bigint>`` of each document (doc_id, text)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _pieces(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), _lists(shingles.shingle_sets(texts, n_words))], ["doc_id", "shingles"])

    return docs.mapInArrow(rows, "doc_id bigint, shingles array<bigint>")


def _plausible(threshold_pct: int) -> Column:
    """Of rows with the sizes and sketches of two documents: whether they can be similar enough."""
    near = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    return (near <= MAX_SKETCH_DISTANCE) & (
        100 * F.least("n_a", "n_b") >= threshold_pct * F.greatest("n_a", "n_b"))


def _odd_bits_differ(a: str, b: str) -> Column:
    """Bits that differ between two odd sketches (of equal length)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _not_refuted(threshold_pct: int) -> Column:
    """Whether the odd sketches leave room for the threshold: 100·|∩| ≥ pct·|∪| says that the symmetric difference
    is at most (100 - pct) / (100 + pct) of the sizes' sum, and it is no less than the sketches' differing bits.

    The longer of two sketches is folded; sets more than twice the other's sketch apart are left to the size test.
    """
    size_a, size_b = F.size("odd_a"), F.size("odd_b")
    bits = F.when(size_a == size_b, _odd_bits_differ("odd_a", "odd_b")) \
        .when(size_a == 2 * size_b, _odd_bits_differ("half_a", "odd_b")) \
        .when(2 * size_a == size_b, _odd_bits_differ("odd_a", "half_b")).otherwise(0)
    return (100 + threshold_pct) * bits <= (100 - threshold_pct) * (F.col("n_a") + F.col("n_b"))


def _folded(odd: Column) -> Column:
    """The odd sketch of half the length: position modulo half the bits."""
    half = (F.size(odd) / 2).cast("int")
    return F.zip_with(F.slice(odd, F.lit(1), half), F.slice(odd, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def buckets(reps: DataFrame) -> DataFrame:
    """``doc_id, met, key``: each document's bucket in the tables, from rows ``doc_id, small``; ``met`` counts the
    documents that share its small hashes, summed over these.

    Small hashes that only one document has cannot meet another and are left out before the tables are formed.
    """
    each = reps.select("doc_id", F.posexplode("small").alias("pos", "value"))
    shared = each.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alive = each.join(shared, ["pos", "value"]).groupBy("doc_id").agg(
        F.sum("n").alias("met"), F.collect_list(F.struct("pos", "value")).alias("hashes"))  # at most 2 × SMALL
    first = F.filter("hashes", lambda x: x["pos"] < SMALL)
    second = F.filter("hashes", lambda x: x["pos"] >= SMALL)
    tables = F.flatten(F.transform(first, lambda x: F.transform(
        second, lambda y: F.xxhash64(x["pos"], y["pos"], x["value"], y["value"]))))
    return alive.select("doc_id", "met", F.explode(tables).alias("key"))


def across_stars(met: DataFrame, joined: DataFrame, marks: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b; a < b) to check between members of a star (rows ``center, doc_id``) that are in different
    components (``node, component``), one of them outside the star's own.

    Both sides of a star are cut into blocks by their number, so no star is compared in one task.
    """
    of = joined.select(F.col("node").alias("doc_id"), "component")
    of_center = joined.select(F.col("node").alias("center"), F.col("component").alias("home"))
    # Stars by their number of members: large ones are few and joined apart, so none is dealt to one task by its center.
    homes = write_narrow(met.groupBy("center").agg(F.count(F.lit(1)).alias("size")).join(of_center, "center", "left")
                        .select("center", "size", F.coalesce("home", "center").alias("home")), "star-homes")
    placed = join_groups(met.join(of, "doc_id", "left"), homes, "center", "size").select(
        "center", "doc_id", F.coalesce("component", "doc_id").alias("c"), "home") \
        .withColumn("outside", F.col("c") != F.col("home")).drop("home")
    placed = write_narrow(placed, "star-members")
    sizes = placed.groupBy("center").agg(F.count(F.lit(1)).alias("members"), F.count_if("outside").alias("others")) \
        .where("members > 1 AND others > 0").select(
            "center", "members", F.ceil(F.col("others") / OUTSIDE_BLOCK).cast("int").alias("rows"),
            F.ceil(F.col("members") / MEMBER_BLOCK).cast("int").alias("columns"))
    open_ = join_groups(placed, write_narrow(sizes, "open-star-sizes"), "center", "members").drop("members")
    open_ = materialize(open_.join(marks, "doc_id"), "open-stars")

    def side(name: str, block: Column, copies: Column) -> DataFrame:
        return open_.select(
            "center", F.col("doc_id").alias(name), F.col("outside").alias(f"outside_{name}"), block, copies,
            *[F.col(x).alias(f"{x}_{name}") for x in ("c", "n", "s1", "s2", "odd")],
            _folded(F.col("odd")).alias(f"half_{name}"))

    def dealt(count: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int")

    others = side("a", dealt("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    all_ = side("b", dealt("columns").alias("column"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    x, y = others.where("outside_a").alias("x"), all_.alias("y")
    same = (F.col("x.center") == F.col("y.center")) & (F.col("x.row") == F.col("y.row")) \
        & (F.col("x.column") == F.col("y.column"))
    return x.join(y, same & (F.col("c_a") != F.col("c_b")) & (~F.col("outside_b") | (F.col("a") < F.col("b")))
                  & _plausible(threshold_pct) & _not_refuted(threshold_pct)) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def only_needed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``needed`` (distinct ids).

    A table of ``FILTER_WORDS`` rows at most, each with 64 bits that ids fall on, is broadcast and keeps most other
    texts out of the shuffle of the exact join; with very many ids it only filters less.  (An inner join: the
    optimiser would move a semi-join below the filter, and so shuffle all texts.)
    """
    word = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS)).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(doc_id), 32), 64) AS int))")
    words = needed.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    near = docs.withColumn("word", word).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return near.select(*docs.columns).join(needed, "doc_id")


def confirmed(pairs: DataFrame, docs: DataFrame, n_words: int, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(full_sets(only_needed(docs, needed), n_words), "shingle-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").where(
        100 * both >= threshold_pct * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, n_words: int = 5, threshold_pct: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are what white space parts, with A-Z lower-cased; a document's set holds its distinct
    ``n_words``-word shingles.  Documents with 100·|∩| ≥ ``threshold_pct``·|∪| are linked; ``component_id`` is
    the smallest doc_id that links lead to, and the document with that id is kept.

    Texts with fewer words have one shingle, their whole sequence; texts that are null or without words have
    none and are linked with nothing.  Rows with a null doc_id are left out, and rows that share a doc_id are one
    document (the smallest text).  An empty table gives an empty result.
    """
    docs = one_row_per_id(keyed_texts(docs, doc_id, text))
    signed = materialize(signatures(docs, n_words), "minhash")
    # Equal sets are one class, spoken for by its smallest id.
    classes = signed.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    reps = signed.drop("set1", "set2", "odd").join(classes.select(F.col("rep").alias("doc_id")), "doc_id")
    reps = materialize(reps, "minhash-classes")

    members = buckets(reps)
    marks = reps.select("doc_id", F.col("n_shingles").alias("n"), F.col("sketch1").alias("s1"), F.col("sketch2").alias("s2"))
    members = materialize(members, "minhash-tables")
    stars = members.groupBy("key").agg(
        F.max(F.struct("met", (-F.col("doc_id")).alias("least"))).alias("most"), F.count(F.lit(1)).alias("size")) \
        .where("size > 1").select("key", (-F.col("most.least")).alias("center"))
    met = members.join(stars, "key").where("doc_id <> center").select("center", "doc_id").distinct()
    met = write_narrow(met, "stars")

    def with_marks(rows: DataFrame, column: str, side: str) -> DataFrame:
        return rows.join(marks.select(F.col("doc_id").alias(column), F.col("n").alias(f"n_{side}"),
                                      F.col("s1").alias(f"s1_{side}"), F.col("s2").alias(f"s2_{side}")), column)

    pairs = met.select(F.least("center", "doc_id").alias("a"), F.greatest("center", "doc_id").alias("b")).distinct()
    pairs = with_marks(with_marks(pairs, "b", "b"), "a", "a").where(_plausible(threshold_pct)).select("a", "b")
    pairs = write_narrow(pairs, "star-pairs")
    links = materialize(confirmed(pairs, docs, n_words, threshold_pct), "star-links")
    joined = components(links)

    cross = across_stars(met, joined, marks.join(signed.select("doc_id", "odd"), "doc_id"), threshold_pct)
    tried = write_narrow(cross.join(pairs, ["a", "b"], "left_anti"), "cross-pairs")
    more = materialize(confirmed(tried, docs, n_words, threshold_pct), "cross-links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    verdict = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "set1", "set2", F.coalesce("component", "rep").alias("component"))
    whole = signed.select("doc_id", "n_shingles", "set1", "set2").where("n_shingles > 0") \
        .join(verdict, ["set1", "set2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    whole = whole.unionByName(signed.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return whole.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one_of_each(docs: DataFrame, n_words: int = 5, threshold_pct: int = 80, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, all columns; rows with a null doc_id stay."""
    id_ = unique_name(docs, "__id")
    gone = near_duplicates(docs, n_words, threshold_pct, doc_id, text).where(~F.col("kept")).select(
        F.col("doc_id").alias(id_))
    return docs.join(gone, docs[doc_id] == F.col(id_), "left_anti")
