"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Counts are added up by language, source and term, and each language keeps the
terms of enough documents.  A source's counts are sorted arrays of (term id,
count), cut into blocks of ids.  A task takes two tiles of sources in one
block and merges their arrays pair by pair: a galloping intersection prices
the terms that both have, what is left of either side is priced against the
other's smoothed zero, and the terms that neither has by their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillet.llm.common import text_of
from rillet.llm.terms import LETTERS, as_bytes, sliced, term_runs
from rillet.session import materialize

#: Terms in a block of ids (on average, dealt by a hash) and sources in a tile: a task holds two tiles of one block.
BLOCK_IDS, TILE = 1 << 15, 16
#: Distinct (language, source, term) a task holds before it passes on its counts.
HELD = 120_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` of documents (lang, source, text, none null), added up within tasks."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in count.items():
                df = held[lang, source]
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([df[w] for w in terms], pa.int64())], ["lang", "source", "term", "n", "df"])
            count.clear()
            held.clear()

        for batch in sliced(batches):
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, data in zip(keys, as_bytes(batch.column(2)), strict=True):
                n = count.setdefault(key, Counter())
                size -= len(n)
                seen: set[bytes] = set()
                for run in term_runs(data, LETTERS):
                    n.update(run)
                    seen.update(run)
                held.setdefault(key, Counter()).update(seen)
                size += len(n)
                if size > HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    return docs.mapInArrow(rows, "lang string, source string, term string, n bigint, df bigint") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def prices(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(10⁹·(count + 2) / (total + 2·size)) of each count, exactly (long division by thousands)."""
    by = np.uint64(max(total + 2 * size, 1))
    left = count.astype(np.uint64) + np.uint64(2)
    out = np.zeros(count.size, np.uint64)
    for step in range(4):
        out = out * np.uint64(1000) + left // by
        left = left % by * np.uint64(1000) if step < 3 else left
    return (out + np.uint64(1)).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)² / (p + q))."""
    return (p - q) ** 2 // (p + q)


def gallop(small: np.ndarray, large: np.ndarray, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of distinct ids of those in both.

    The smaller one is taken in runs; for each, doubling steps from where the last one ended bracket its ids in
    the larger array, and only the bracket is searched.
    """
    here, there, at = [], [], 0
    for start in range(0, small.size, run):
        ids = small[start: start + run]
        step, end = run, at
        while end < large.size and large[end] <= ids[-1]:
            end += step
            step *= 2
        end = min(end + 1, large.size)
        place = at + np.searchsorted(large[at:end], ids)
        inside = place < large.size
        hit = np.flatnonzero(inside)[large[place[inside]] == ids[inside]]
        here.append(start + hit)
        there.append(place[hit])
        at = int(place[-1])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *here]), np.concatenate([empty, *there])


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], size: int) -> int:
    """Sum of :func:`apart` over the ``size`` terms of a block, for two groups (ids, prices, price of a zero count)."""
    (ids_a, price_a, zero_a), (ids_b, price_b, zero_b) = (a, b) if a[0].size <= b[0].size else (b, a)
    in_a, in_b = gallop(ids_a, ids_b)
    both = apart(price_a[in_a], price_b[in_b]).sum()
    only_a = apart(price_a, np.int64(zero_b)).sum() - apart(price_a[in_a], np.int64(zero_b)).sum()
    only_b = apart(price_b, np.int64(zero_a)).sum() - apart(price_b[in_b], np.int64(zero_a)).sum()
    neither = size - ids_a.size - ids_b.size + in_a.size
    return int(both + only_a + only_b + neither * int(apart(np.int64(zero_a), np.int64(zero_b))))


def _pair_task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Merges each source of one tile with each of the other (within a tile: with each later one)."""
    def ready(rows: pa.Table) -> list[tuple]:
        out = []
        for i in range(rows.num_rows):
            total, size = rows["total"][i].as_py(), rows["v"][i].as_py()
            ids, counts = (rows[c][i].values.to_numpy() for c in ("ids", "counts"))
            zero = int(prices(np.zeros(1, np.int64), total, size)[0])
            out.append((rows["source"][i].as_py(), (ids, prices(counts, total, size), zero)))
        return sorted(out, key=lambda x: x[0])

    lang, _, first, second = (k.as_py() for k in key)
    found: list[tuple] = []
    if left.num_rows and right.num_rows:
        size, same = left["block_size"][0].as_py(), first == second
        ready_a = ready(left)
        ready_b = ready_a if same else ready(right)
        found = [(s, t, merged(x, y, size)) for s, x in ready_a for t, y in ready_b if not same or s < t]
    a, b, value = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array(a, pa.string()),
                     "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def pair_values(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of every unordered pair of sources of a language, from rows ``lang, source, total, v,
    block, block_size, ids, counts`` (v: kept terms of the language) for each of the ``groups`` (lang, source)."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = vectors.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = placed.withColumn("second", F.explode(F.filter(others, lambda x: x >= F.col("tile")))) \
        .withColumnRenamed("tile", "first")
    right = placed.withColumn("first", F.explode(F.filter(others, lambda x: x <= F.col("tile")))) \
        .withColumnRenamed("tile", "second")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own beside the left's
    keys = ["lang", "block", "first", "second"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _pair_task, "lang string, a string, b string, value bigint") \
        .groupBy("lang", "a", "b").agg(F.sum("value").cast("bigint").alias("value"))


def _price(count: str, total: str, size: str) -> Column:
    """:func:`prices` as a column (decimals: the product may pass 64 bits)."""
    return F.expr(f"1 + (CAST({count} AS decimal(20,0)) + 2) * 1000000000 DIV "
                  f"greatest(CAST({total} + 2 * {size} AS decimal(20,0)), 1)")


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, text: str = "text", lang: str = "lang",
               source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` for each (lang, source) group that occurs.

    Terms are runs of ASCII letters and of everything above ASCII, A-Z lower-cased; a language keeps the V terms in
    ``min_docs`` of its documents or more.  With ``count`` occurrences of a kept term and N of all of them, in a group
    or in the language, its price is p = 1 + floor(10⁹·(count + 2) / (N + 2V)).

    * Part ``pair``: ``item`` is each other source of the language, ``value`` the sum of floor((p - q)² / (p + q)) over
      all kept terms (0 without any).
    * Part ``term``: ``item`` is each kept term that the group has at a price above the language's, ``value`` its
      floor((p - q)² / (p + q)); the ``top_terms`` highest.

    Ranks go by falling value and rising item.  Null texts, languages and sources count as empty; repeated rows each
    count; an empty table gives an empty result.
    """
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    counts = materialize(term_counts(rows), "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("docs")) \
        .where(F.col("docs") >= min_docs).drop("docs").withColumn("id", F.monotonically_increasing_id())
    vocabulary = materialize(vocabulary, "kept-terms")  # the ids stay as they are written
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    n_blocks = max(1, -(-(langs.agg(F.max("v")).first()[0] or 0) // BLOCK_IDS))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")
    kept = materialize(counts.join(vocabulary, ["lang", "term"]).select(
        "lang", "source", "term", "id", block, "n", "lang_n"), "kept-counts")

    groups = rows.select("lang", "source").distinct() \
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left") \
        .join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = materialize(groups, "groups")
    sizes = vocabulary.select("lang", block).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_size"))
    arrays = kept.groupBy("lang", "source", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))  # at most the terms of a block
    empty = F.array().cast("array<bigint>")
    vectors = groups.join(sizes, "lang", "left").withColumn("block", F.coalesce("block", F.lit(0))) \
        .join(arrays, ["lang", "source", "block"], "left").select(
            "lang", "source", "total", "v", "block", F.coalesce("block_size", F.lit(0)).alias("block_size"),
            F.coalesce(F.col("terms.id"), empty).alias("ids"), F.coalesce(F.col("terms.n"), empty).alias("counts"))
    pairs = materialize(pair_values(materialize(vectors, "count-arrays"), groups), "pair-values")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pairs.withColumn("rank", F.row_number().over(falling))
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _price("n", "total", "v").alias("p"),
        _price("lang_n", "lang_total", "v").alias("q")).where("p > q")
    terms = priced.select("lang", "source", "item", F.expr("(p - q) * (p - q) DIV (p + q)").alias("value")) \
        .withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))) \
        .select("lang", "source", "part", "item", "value", "rank")
