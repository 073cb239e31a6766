"""Records of files whose format has no safe place to cut, read by many tasks.

A CSV cell may hold line feeds and a JSON array document need not hold any, so
a task that starts inside a file cannot tell what its first bytes belong to.
Spark cuts such files at a byte (a line feed, or a closing brace) all the same.
Each split is first read under both assumptions, that it starts inside or
outside a quoted text, and reports what it does to either: a map of states.
The maps, one row a split, are composed along each file; then every split knows
its state, joins its pieces to records, and hands on the beginning and end of
the records that it shares with its neighbours, which are put together by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillet.common import StepError

#: How far a piece moves the nesting depth, and whether a quoted text is open after it; given whether one was before.
Scan = Callable[[str, bool], tuple[int, bool]]

_CLOSING_QUOTE = re.compile(r'(?:[^"]|"")*+"')
_TEXT_END = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_TEXT = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_LEAD = re.compile(r"[\s,]*")


def scan_csv(line: str, inside: bool) -> tuple[int, bool]:
    """A line of CSV: a quote opens a cell only as its first character, is doubled in it, and ends it otherwise."""
    if '"' not in line:
        return 0, inside
    at, n = 0, len(line)
    while at < n or inside:
        if inside or line[at] == '"':
            closing = _CLOSING_QUOTE.match(line, at if inside else at + 1)
            if closing is None:
                return 0, True
            at, inside = closing.end(), False
            if at < n and line[at] != ",":  # what follows the quote is part of the cell, up to the comma
                at = line.find(",", at)
                if at < 0:
                    return 0, False
            at += 1
        else:
            at = line.find(',"', at) + 1
            if at == 0:
                return 0, False
    return 0, False


def scan_json(piece: str, inside: bool) -> tuple[int, bool]:
    """A piece of JSON up to a closing brace: what it opens and closes outside of texts."""
    if inside:
        end = _TEXT_END.match(piece)
        if end is None:
            return 0, True
        piece = piece[end.end():]
    if '"' in piece:
        piece = _TEXT.sub("", piece)
        open_ = piece.find('"')
        inside = open_ >= 0
        if inside:
            piece = piece[:open_]
    else:
        inside = False
    return piece.count("{") + piece.count("[") - piece.count("}") - piece.count("]"), inside


def _pieces(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """``value, file, start`` of all pieces between separators; a file is named by a hash, a split by its first byte."""
    return spark.read.option("lineSep", sep).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """Runs of pieces of one split, in order (a split may come in several runs)."""
    for batch in batches:
        names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for name, rows in groupby(zip(names, batch.column(0).to_pylist(), strict=True), key=lambda x: x[0]):
            yield name, [x[1] for x in rows]


def _maps(pieces: DataFrame, scan: Scan, suffix: str) -> list:
    """A row for each split: what it does to a state outside and inside of a quoted text, and its first character."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], list] = {}
        for name, texts in _by_split(batches):
            state = done.setdefault(name, [0, False, 0, True, ""])
            for text in texts:
                state[4] = state[4] or text.lstrip("﻿ \t\r\n")[:1]
                for k in (0, 2):
                    moved, state[k + 1] = scan(text + suffix, state[k + 1])
                    state[k] += moved
        files, starts = zip(*done, strict=True) if done else ((), ())
        cols = list(zip(*done.values(), strict=True)) if done else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.int64()), pa.array(starts, pa.int64()), pa.array(cols[0], pa.int64()),
             pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()),
             pa.array(cols[4], pa.string())],
            ["file", "start", "moves_outside", "after_outside", "moves_inside", "after_inside", "first"])

    return pieces.mapInArrow(rows, "file bigint, start bigint, moves_outside bigint, after_outside boolean, "
                             "moves_inside bigint, after_inside boolean, first string").orderBy("file", "start").collect()


def _states(maps: list) -> dict[tuple[int, int], tuple[int, bool]]:
    """Depth, and whether a quoted text is open, at the start of each split."""
    out: dict[tuple[int, int], tuple[int, bool]] = {}
    for _, splits in groupby(maps, key=lambda r: r["file"]):
        depth, inside = 0, False
        for r in splits:
            out[r["file"], r["start"]] = depth, inside
            depth += r["moves_inside"] if inside else r["moves_outside"]
            inside = r["after_inside"] if inside else r["after_outside"]
    return out


def _records(pieces: DataFrame, states: dict, scan: Scan, sep: str, suffix: str, rest: int, array: bool) -> DataFrame:
    """``value, first`` (whether it is its file's first) of each record; a record is over where no quoted text is open
    and the depth is ``rest``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        held: list[str] = []
        depth, inside, kind, first, over = 0, False, 0, False, False
        out: list[tuple] = []

        def pass_on(kind: int) -> None:
            """Kinds: 0 a whole record, 1 goes on from the split before, 2 begins in this split and is not over."""
            nonlocal first
            value = sep.join(held)
            held.clear()
            if kind != 1:
                if array:
                    value = value[_LEAD.match(value).end():]
                    if first and value.startswith("["):
                        value = value[1:].lstrip()
                    if value.startswith("]"):  # an empty array
                        value = ""
                if not value:
                    return
            out.append((value, kind, first and kind != 1, *now))
            first = first and kind == 1

        for name, texts in _by_split(batches):
            if name != now:
                if held:
                    pass_on(1 if kind else 2)
                if name not in states:
                    raise StepError("the splits of the files are not those of the first pass (other session settings?)")
                now, (depth, inside) = name, states[name]
                first, over = name[1] == 0, False
                kind = 0 if first or (depth == rest and not inside) else 1
            for text in texts:
                if over:
                    continue
                if array and not held and not inside and not kind and depth == rest and text.lstrip().startswith("]"):
                    over = True  # the end of the array
                    continue
                held.append(text + suffix)
                moved, inside = scan(held[-1], inside)
                depth += moved
                if depth == rest and not inside:
                    pass_on(kind)
                    kind = 0
            if len(out) >= 2048:
                yield batch_of(out)
                out = []
        if held:
            pass_on(1 if kind else 2)
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                          ["value", "kind", "first", "file", "start"])

    found = pieces.mapInArrow(rows, "value string, kind int, first boolean, file bigint, start bigint")
    # At most two parts of records a split: those that begin in one and end in a later one.
    part = found.where("kind > 0")
    order = Window.partitionBy("file").orderBy("start", "kind")
    part = part.withColumn("record", F.count_if(F.col("kind") == 2).over(order))
    whole = part.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "value"))).alias("parts"), F.max("first").alias("first"))
    joined = whole.select(F.array_join("parts.value", sep).alias("value"), "first")
    return found.where("kind = 0").select("value", "first").unionByName(joined)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, first`` of each CSV record (line feeds in quoted cells stay; empty lines are none)."""
    pieces = _pieces(spark, path, "\n")
    return _records(pieces, _states(_maps(pieces, scan_csv, "")), scan_csv, "\n", "", 0, False)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """``value`` of each object in the files' JSON arrays (one array a file); None if a file holds no array.

    Elements must be objects.
    """
    pieces = _pieces(spark, path, "}")
    maps = _maps(pieces, scan_json, "}")
    if any(r["start"] == 0 and r["first"] not in ("[", "") for r in maps):
        return None
    return _records(pieces, _states(maps), scan_json, "", "}", 1, True).select("value")
