"""Token ids in binary shards: frequency-ranked, byte-aligned variable-length codes.

A shard block holds whole documents in ascending doc_id order.  Its ids are
replaced by their rank in the block (most frequent first) and each rank takes
1 to 4 bytes; the lengths, two bits a rank, are kept apart in control bytes.
Reading looks the lengths up in a table of 256 control bytes and gathers the
data bytes with numpy.  Blocks are the rows of a Parquet table, so that Spark's
commit protocol covers lost tasks and any store will do.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillet.llm.common import keyed_texts
from rillet.session import scratch_path

BLOCK_SCHEMA = ("part int, block int, first_token bigint, doc_ids array<bigint>, counts array<bigint>, "
                "ranked_ids binary, control binary, data binary")

#: Length in bytes of each of the four ranks that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``(ranked_ids, control, data)`` of an array of ids (unsigned 32-bit)."""
    ids = np.asarray(ids, dtype=np.uint32)
    if ids.size == 0:
        return b"", b"", b""
    counts = np.bincount(ids) if int(ids.max()) < 1 << 22 else None
    if counts is not None:
        used = np.flatnonzero(counts)
        order = used[np.argsort(-counts[used], kind="stable")]
        rank_of = np.zeros(counts.size, np.uint32)
        rank_of[order] = np.arange(order.size, dtype=np.uint32)
        ranks = rank_of[ids]
    else:
        used, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
        by_count = np.argsort(-n, kind="stable")
        order = used[by_count]
        rank_of = np.empty(used.size, np.uint32)
        rank_of[by_count] = np.arange(used.size, dtype=np.uint32)
        ranks = rank_of[inverse]
    quads = np.zeros((ids.size + 3) // 4 * 4, np.uint8)
    codes = quads[: ids.size]
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if order.size > limit + 1:
            codes += ranks > limit
    start = np.cumsum(codes, dtype=np.int64)
    start += np.arange(ids.size) - codes
    data = np.empty(int(start[-1]) + int(codes[-1]) + 1, np.uint8)
    data[start] = ranks & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(codes >= k)
        if not longer.size:
            break
        data[start[longer] + k] = ranks[longer] >> (8 * k) & 0xFF
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(ranked_ids: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block, as little-endian unsigned 32-bit integers."""
    if n == 0:
        return np.zeros(0, "<u4")
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not longer.size:
            break
        ranks[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked_ids, "<u4")[ranks].astype("<u4")


class WordCachedTokenizer:
    """Byte-level BPE of a tokenizers file, text by text, with the ids of frequent words kept.

    The pre-tokenizer never joins characters across a space that has a non-space after it, so a text is cut
    there and each piece is encoded once for all its occurrences.  At most ``cache_words`` pieces are kept.
    New pieces are cut by the file's own pattern and their parts go through its BPE model, many in one call.
    Added tokens of the file are matched before the pre-tokenizer, so a text that holds one literally is
    encoded whole.
    """

    def __init__(self, path: str, cache_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)")
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = [c for c in alphabet if ord(c) < 256]
        moved = iter([c for c in alphabet if ord(c) >= 256])  # the other bytes, in ascending order
        self.byte_char = {b: chr(b) if chr(b) in plain else next(moved) for b in range(256)}
        self.byte_char[0xFF] = "\n"  # never in UTF-8, so it can part the pieces
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character of the vocabulary file stands for one byte
            self.token_bytes[i] = len(token)
        self.cache: dict[str, bytes] = {}
        self.part_cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.blank = re.compile(r" (?!\S)")
        self.cut = re.compile(r" (?=\S)")

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, encoded on its own."""
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        """Puts the ids of pre-tokens into ``part_cache``."""
        for at in range(0, len(parts), 2048):
            raw = [p.encode() for p in parts[at: at + 2048]]
            ids = np.array(self.parts.encode_batch_fast(
                [b"\xff".join(raw).decode("latin-1").translate(self.byte_char)],
                add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.token_bytes[ids])
            stops = np.searchsorted(ends, np.cumsum([len(r) for r in raw]), "left") + 1
            held, begin = ids.tobytes(), 0
            for part, stop in zip(parts[at: at + 2048], (4 * stops).tolist(), strict=True):
                self.part_cache[part] = held[begin:stop]
                begin = stop

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of ``" " + word`` into the cache; a word begins with a non-space."""
        if not words:
            return
        bare = [w for w in words if " " not in w]
        for word, ids in zip([w for w in words if " " in w], self._whole([" " + w for w in words if " " in w]),
                             strict=True):
            self.cache[word] = ids
        if not bare:
            return
        parts = self.pattern.findall(" " + " ".join(bare))
        new = list(set(parts).difference(self.part_cache))
        self._learn_parts(new)
        held, word, ids = iter(bare), None, b""
        for part in parts:
            if part[0] == " ":  # only the first part of a word does
                if word is not None:
                    self.cache[word] = ids
                word, ids = next(held), self.part_cache[part]
            else:
                ids += self.part_cache[part]
        self.cache[word] = ids
        for part in new[max(0, len(new) - max(0, len(self.part_cache) - self.cache_words)):]:
            del self.part_cache[part]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held = [i for i, t in enumerate(texts) if self.added.search(t)]
        if held:
            whole = dict(zip(held, self._whole([texts[i] for i in held]), strict=True))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        split = [self.cut.split(t) if self.blank.search(t) else t.split(" ") for t in texts]
        heads = self._whole([p[0] for p in split])
        new = list(set().union(*(p[1:] for p in split)).difference(self.cache))
        self._learn(new)
        get = self.cache.__getitem__
        out = [h + b"".join(map(get, p[1:])) for h, p in zip(heads, split, strict=True)]
        for word in new[max(0, len(new) - max(0, len(self.cache) - self.cache_words)):]:
            del self.cache[word]
        return out


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """The worker's tokenizer of that file; a reused worker keeps it with its cache."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2,
                 doc_id: str = "doc_id", text: str = "text", block_tokens: int = 1 << 20) -> None:
    """Encodes every text, appends ``end_id`` and writes the ids to ``path`` in ascending doc_id order.

    A block is closed when it holds ``block_tokens`` ids, at the end of a document, so a task holds one block
    and one batch of texts.  Null text counts as empty (the end id alone).  Null doc_ids come first; rows
    that share a doc_id follow each other in the order of their texts.  An empty table gives no block.
    """
    where = tokenizer_path or default_tokenizer()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                        ("ranked_ids", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        encode = tokenizer(where).encode
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in held]
            ranked, control, data = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "first_token": first, "doc_ids": list(ids), "counts": counts,
                "ranked_ids": ranked, "control": control, "data": data}], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                keys = some.column(0).to_pylist()
                for key, raw in zip(keys, encode(some.column(1).to_pylist()), strict=True):
                    ids.append(key)
                    held.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= block_tokens:
                        yield close()
                        first, block, size = first + size, block + 1, 0
                        ids, held = [], []
        if ids:
            yield close()

    ordered = keyed_texts(docs, doc_id, text).repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``first_id``: ids of all documents before the block, over all shards."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    ends = blocks.select("part", (F.col("first_token") + F.aggregate(
        "counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("end"))
    # One row a shard: the window runs over as many rows as there were write tasks.
    totals = ends.groupBy("part").agg(F.max("end").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("part").alias("__part"), before.alias("__before"))
    return blocks.join(F.broadcast(totals), F.col("part") == F.col("__part")).withColumn(
        "first_id", F.col("__before") + F.col("first_token")).drop("__part", "__before", "part", "block", "first_token")


def _decoded(frame: pa.RecordBatch) -> Iterator[tuple[list, list, int, np.ndarray]]:
    for row in range(frame.num_rows):
        keys, counts, ranked, control, data, first = (frame.column(c)[row].as_py() for c in (
            "doc_ids", "counts", "ranked_ids", "control", "data", "first_id"))
        yield keys, counts, first, unpack(ranked, control, data, sum(counts))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<bigint>`` of each document, from the files at ``path``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, first, ids in _decoded(batch):
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                for lo in range(0, len(keys), 1024):
                    hi = min(lo + 1024, len(keys))
                    lists = pa.ListArray.from_arrays(
                        pa.array(at[lo: hi + 1] - at[lo], pa.int32()), pa.array(ids[at[lo]: at[hi]].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo:hi], pa.int64()), pa.array(first + at[lo:hi], pa.int64()), lists],
                        ["doc_id", "start", "ids"])

    return _blocks(spark, path).mapInArrow(rows, "doc_id bigint, start bigint, ids array<bigint>")


def shard_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files at ``path``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, first, ids in _decoded(batch):
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                raw, cuts = memoryview(ids.tobytes()), (4 * at).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(first + at[:-1], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, path).mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenised(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards to a fresh folder of the shared one and reads the digests back."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, **options)
    return shard_digests(docs.sparkSession, path)
