"""Removal of repeated strings of documents, byte by byte.

All windows of 100 bytes are dealt out by their anchor (see ``anchors``), so equal
windows meet in one group.  Windows whose anchor is alone cannot be repeated.  In
the groups, equal runs of windows are first reduced to their first
occurrence; the Burrows-Wheeler transform of what is left gives the classes of equal
windows (see ``bwt``), of which the first stays.  A group that is too large for one
transform is parted down to its windows, which are grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm import anchors, bwt
from rillet.llm.common import keyed_texts, one_row_per_id
from rillet.session import materialize

#: Most bytes of run texts that are transformed together.
CHUNK = 1 << 20
#: Anchors with more runs than this, or more than CHUNK bytes, are parted further by a second anchor.
HOT_RUNS = 1_000
#: A place is doc_id · 2**40 + offset: offsets of a document in one long, in document order.
_SHIFT = 40


def _pieces(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes laid end to end and ends of the texts of a batch, in pieces."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < limit):
            size += len(texts[stop])
            stop += 1
        yield (keys[at:stop], np.frombuffer(b"".join(texts[at:stop]), np.uint8),
               np.cumsum([len(t) for t in texts[at:stop]]))
        at = stop


def window_runs(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, doc_id, start, n, repeats``: the runs of windows of each document (doc_id, text)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, raw, ends in _pieces(batch):
                start, n, value, repeats = anchors.runs(raw, ends, window)
                doc = np.searchsorted(ends, start, "right")
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(keys[doc]), pa.array(start - begins[doc]),
                     pa.array(n.astype(np.int32)), pa.array(repeats)],
                    ["anchor", "doc_id", "start", "n", "repeats"])

    return docs.mapInArrow(rows, "anchor bigint, doc_id bigint, start bigint, n int, repeats boolean")


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """The runs whose anchor occurs in another run, or twice in theirs; ``hot``: its runs are many."""
    found = window_runs(docs, window)
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_runs"), F.max("repeats").alias("again"),
                                         F.sum(F.col("n") + (window - 1)).alias("size")) \
        .where((F.col("n_runs") > 1) | F.col("again"))
    shared = shared.select("anchor", ((F.col("n_runs") > HOT_RUNS) | (F.col("size") > CHUNK)).alias("hot"))
    return found.join(shared, "anchor")


def _by_document(runs: DataFrame) -> DataFrame:
    """One row a document: its runs, as many as its length allows."""
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", "repeats", "hot")).alias("runs"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a list-of-struct column."""
    flat = column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    size = np.array([len(x) if x.is_valid else 0 for x in column])
    return np.concatenate([[0], np.cumsum(size)]), fields


def run_texts(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``key, bytes, place, repeats, hot``: the bytes of every run.  The key is the anchor; a run of a hot anchor is
    cut where a second anchor (another hash) changes, and both make its key."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            at, run = _lists(batch.column("runs"))
            key: list[int] = []
            text: list[bytes] = []
            doc: list[int] = []
            start: list[int] = []
            again: list[bool] = []
            parted: list[bool] = []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(text, pa.binary()), pa.array(doc, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(again, pa.bool_()), pa.array(parted, pa.bool_())],
                    ["key", "bytes", "doc_id", "start", "repeats", "hot"])

            held = 0
            for i, raw in enumerate(texts):
                part = slice(at[i], at[i + 1])
                for a, s, n, r, hot in zip(run["anchor"][part].tolist(), run["start"][part].tolist(),
                                           run["n"][part].tolist(), run["repeats"][part].tolist(),
                                           run["hot"][part].tolist(), strict=True):
                    own = raw[s: s + n + window - 1]
                    if not hot:
                        cuts, seconds = [0, n], [a]
                    else:
                        second = anchors.window_anchors(np.frombuffer(own, np.uint8), window, seed=1)
                        places = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]]))
                        cuts = [*places.tolist(), n]
                        seconds = anchors.mix64(second[places] + np.uint64(a % (1 << 64))).view(np.int64).tolist()
                    for lo, hi, k in zip(cuts, cuts[1:], seconds, strict=False):
                        key.append(k)
                        text.append(own[lo: hi + window - 1])
                        doc.append(keys[i])
                        start.append(s + lo)
                        again.append(r or hot)
                        parted.append(hot)
                        held += hi - lo + window
                if held > 8 << 20:
                    yield out()
                    key, text, doc, start, again, parted, held = [], [], [], [], [], [], 0
            yield out()

    both = docs.join(_by_document(runs), "doc_id").select("doc_id", "text", "runs")
    found = both.mapInArrow(
        rows, "key bigint, bytes binary, doc_id bigint, start bigint, repeats boolean, hot boolean")
    return found.select("key", "bytes", _place().alias("place"), F.col("repeats").cast("int").alias("repeats"), "hot")


def _place() -> Column:
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << _SHIFT).cast("decimal(13,0)") \
        + F.col("start").cast("decimal(13,0)")
    return place.cast("decimal(38,0)")


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and offset of decimal places."""
    words = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset: 2 * (column.offset + len(column))]
    low, high = words[::2].view(np.uint64), words[1::2]
    return (high << (64 - _SHIFT)) | (low >> np.uint64(_SHIFT)).view(np.int64), \
        (low & np.uint64((1 << _SHIFT) - 1)).view(np.int64)


def first_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``(doc_id, lo, hi)``: ranges of window starts that are the first of their class among the run texts."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    symbols = np.unique(joined)
    table = np.zeros(256, np.uint8)
    table[symbols] = np.arange(1, symbols.size + 1)
    classes = bwt.string_classes(table[joined], window)
    size = np.array([len(t) for t in texts])
    n = size - window + 1
    text_at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = classes[text_at[row] + k]
    offset = start[row] + k
    order = np.lexsort((offset, doc[row], own))
    first = np.zeros(order.size, bool)
    first[order] = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    opens = first & np.concatenate([[True], ~first[:-1] | (row[1:] != row[:-1])])
    closes = first & np.concatenate([~first[1:] | (row[1:] != row[:-1]), [True]])
    return doc[row[opens]], offset[opens], offset[closes] + 1


def single_windows(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, lo, hi``: of the windows in the run texts (bytes, place), the first of each class, grouped by their
    bytes: a group is one row, however many runs hold the window."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = _places(batch.column("place"))
            text = batch.column("bytes").to_pylist()
            sizes = np.array([len(t) for t in text], np.int64) - window + 1
            # Some 8 MB of windows at a time: whole runs, of which none is long.
            for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(np.cumsum(sizes) // 80_000)) + 1):
                n = sizes[part]
                if not n.sum():
                    continue
                raw = b"".join(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text[i], np.uint8), window).tobytes()
                               for i in part.tolist())
                ends = np.arange(n.sum() + 1, dtype=np.int32) * window
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), int(n.sum()), [None, pa.py_buffer(ends), pa.py_buffer(raw)]),
                     pa.array(np.repeat(doc[part], n)), pa.array(np.repeat(start[part], n) + k)],
                    ["bytes", "doc_id", "start"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = _places(batch.column("place"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(start + 1)],
                                             ["doc_id", "lo", "hi"])

    found = texts.select("bytes", "place").mapInArrow(windows, "bytes binary, doc_id bigint, start bigint")
    first = found.select("bytes", _place().alias("place")).groupBy("bytes").agg(F.min("place").alias("place"))
    return first.select("place").mapInArrow(ranges, "doc_id bigint, lo bigint, hi bigint")


def kept_windows(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, lo, hi``: window starts in the repeated runs that no earlier window equals."""
    distinct = texts.groupBy("key", "bytes").agg(
        F.min("place").alias("place"), F.max("repeats").alias("repeats"), F.max("hot").alias("hot"))
    # The size of what a hot anchor's group adds; other groups are within CHUNK.
    distinct = distinct.withColumn("size", F.when(F.col("hot"), F.octet_length("bytes"))).drop("hot")
    # Written, so that the shuffles of all texts are gone before the groups are dealt out.
    distinct = materialize(distinct, "distinct-runs")
    wide = materialize(distinct.where("size IS NOT NULL").groupBy("key").agg(F.sum("size").alias("size"))
                       .where(F.col("size") > CHUNK).select("key"), "wide-groups")
    runs = distinct.drop("size")
    if wide.isEmpty():
        return grouped_windows(runs, window)
    return grouped_windows(runs.join(wide, "key", "left_anti"), window).unionByName(
        single_windows(runs.join(wide, "key", "left_semi"), window))


def grouped_windows(distinct: DataFrame, window: int) -> DataFrame:
    """``doc_id, lo, hi``: the first windows of each class among distinct runs, in groups of at most CHUNK bytes."""
    dealt = distinct.repartition("key").sortWithinPartitions("key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        last: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # a group that may go on
        size = last_size = 0

        def flush(parts) -> pa.RecordBatch:
            text = [t for p in parts for t in p[0]]
            key, doc, start, again = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            alone = new & np.concatenate([new[1:], [True]]) & (again == 0)
            n = np.array([len(t) for t in text]) - window + 1
            found = [(doc[alone], start[alone], start[alone] + n[alone])]
            rest = np.flatnonzero(~alone)
            if rest.size:
                found.append(first_windows([text[i] for i in rest], doc[rest], start[rest], window))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)],
                                              ["doc_id", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            doc, start = _places(batch.column("place"))
            text = batch.column("bytes").to_pylist()
            again = batch.column("repeats").to_numpy()
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in text])]).tolist()
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [key.size]]).tolist()
            for at, edge in zip(edges, edges[1:], strict=False):
                if last and last[-1][1][-1] != key[at]:  # the group before is whole
                    if held and size + last_size > CHUNK:
                        yield flush(held)
                        held, size = [], 0
                    held += last
                    size += last_size
                    last, last_size = [], 0
                part = slice(at, edge)
                last.append((text[part], key[part], doc[part], start[part], again[part]))
                last_size += sizes[edge] - sizes[at]
        if held and size + last_size > CHUNK:
            yield flush(held)
            held = []
        if held or last:
            yield flush(held + last)

    return dealt.mapInArrow(rows, "doc_id bigint, lo bigint, hi bigint")


def removed_mask(n_bytes: int, start: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                 window: int) -> np.ndarray:
    """Which bytes go: those in a window of the repeated runs (start, n) that is not among the kept (lo, hi)."""
    change = np.zeros(n_bytes + 1, np.int64)
    np.add.at(change, start, 1)
    np.subtract.at(change, start + n, 1)
    np.subtract.at(change, lo, 1)
    np.add.at(change, hi, 1)
    gone = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    cover = np.zeros(n_bytes + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.subtract.at(cover, gone + window, 1)
    return np.cumsum(cover[:-1]) > 0


def repeated_spans(docs: DataFrame, window: int = 100, doc_id: str = "doc_id", text: str = "text",
                   with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_bytes`` if asked for).

    Every byte goes that is covered by a string of ``window`` bytes (of the UTF-8 text) that also starts earlier: in
    a document with a smaller doc_id, or before in the same one; overlaps count, and the strings are those of the
    input.  ``n_spans`` counts the maximal runs of removed bytes.

    Null text counts as empty, and texts shorter than ``window`` stay whole.  Rows with a null doc_id, which have no
    place in the order, stay whole and take part in nothing.  Rows that share a doc_id are one document (the
    smallest text).  An empty table gives an empty result.
    """
    everything = keyed_texts(docs, doc_id, text)
    docs = one_row_per_id(everything)
    runs = materialize(repeated_runs(docs, window), "repeated-runs")
    kept = materialize(kept_windows(run_texts(docs, runs, window), window), "first-windows")
    gone = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    stay = kept.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("kept"))
    plans = gone.join(stay, "doc_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            run_at, run = _lists(batch.column("runs"))
            kept_at, keep = _lists(batch.column("kept"))
            out = []
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                a, b = slice(run_at[i], run_at[i + 1]), slice(kept_at[i], kept_at[i + 1])
                mask = removed_mask(len(raw), run["start"][a], run["n"][a], keep["lo"][b], keep["hi"][b], window)
                left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (mask[0] if mask.size else 0))
                out.append((int(mask.sum()), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())],
                ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    cut = docs.join(plans, "doc_id").select("doc_id", "text", "runs", "kept").mapInArrow(
        rows, "doc_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")
    whole = docs.unionByName(everything.where("doc_id IS NULL")).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"),
        *([F.col("text").cast("binary").alias("bytes")] if with_text else []))
    both = whole.join(cut.where("n_removed > 0"), "doc_id", "left")
    return both.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *([F.coalesce("kept_bytes", "bytes").alias("kept_bytes")] if with_text else []))
