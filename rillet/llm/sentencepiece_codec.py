"""SentencePiece encoding and decoding: Viterbi over the matches of an Aho-Corasick automaton.

The model file gives the pieces; a piece's score is the logarithm of a Zipf
law over its rank in the file (the file holds merge ranks, no
probabilities).  One pass of the automaton over a word yields every piece that
ends at each position, following output links; each relaxes the best score
there.  Characters that no piece covers become byte pieces, so that decoding
gives back the text exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import text_of

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: A word with the blanks before it, or blanks at a line's end.
_WORD = re.compile(r" *[^ ]+| +")


class PieceModel:
    """Encoder and decoder of one model file.

    A text gets one mark in front and its spaces become marks.  A piece has marks at its beginning only (those of more
    than one are runs of blanks; others and pieces with a line feed are refused), so that none reaches over the end
    of a word: a word and the blanks before it are encoded by themselves, and at most ``cache_words`` of them are kept.
    A mark that the text itself holds is written as bytes.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.piece: list[bytes] = [b""] * size
        self.scores: dict[str, tuple[float, int]] = {}
        self.automaton = ahocorasick.Automaton()
        rank = 0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.piece[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"a piece that reaches over a word's end: {piece!r}")
                rank += 1
                score = -float(np.log(rank + 2.7))
                self.piece[i] = piece.replace(MARK, " ").encode()
                self.scores[piece] = (score, i)
                self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        #: A byte piece costs more than any piece of the file.
        self.byte_score = -float(np.log(rank + 2.7)) - 2.0
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def viterbi(self, word: str) -> list[int]:
        """Ids of the segmentation with the best sum of scores; of equal ones, the one with the longer last piece."""
        n = len(word)
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        reached = 0  # every position up to here has its final score

        def by_bytes(upto: int) -> None:
            nonlocal reached
            while reached < upto:
                reached += 1
                cost = best[reached - 1] + self.byte_score * len(word[reached - 1].encode("utf-8", "surrogatepass"))
                if cost > best[reached]:
                    best[reached], back[reached] = cost, (reached - 1, -1)

        for end, (length, score, i) in self.automaton.iter(word):
            if end > reached:
                by_bytes(end)  # scores at the starts of all pieces that end here
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (end + 1 - length, i)
        by_bytes(n)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                raw = word[start:at].replace(MARK, " ").encode("utf-8", "surrogatepass")
                ids.extend(self.byte_id[list(raw)][::-1].tolist())
            at = start
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a word and the blanks before it.  A mark of the text itself never meets the automaton: it is bytes."""
        ids: list[int] = []
        for k, part in enumerate(word.split(MARK)):
            if k:
                ids.extend(self.byte_id[list(MARK.encode())].tolist())
            ids.extend(self.viterbi(part.replace(" ", MARK)))
        return np.array(ids, "<i4").tobytes()

    def _line(self, line: str) -> bytes:
        if "  " in line:
            words = _WORD.findall(line)
        else:  # the same words: each begins with its blank
            first, *rest = line.split(" ")
            words = [first, *[f" {w}" for w in rest]] if first else [f" {w}" for w in rest]
        cache = self.cache
        out = []
        for word in words:
            ids = cache.get(word)
            if ids is None:
                ids = self._word(word)
                if len(cache) < self.cache_words:
                    cache[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text (empty for an empty one)."""
        if not text:
            return np.zeros(0, "<i4")
        return np.frombuffer(self._newline().join(map(self._line, f" {text}".split("\n"))), "<i4")

    def _newline(self) -> bytes:
        return np.array([self.byte_id[10]], "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark in front goes."""
        raw = b"".join(map(self.piece.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids array<int>`` of the whole text.

    Null text gives null ids, empty text no ids.  A column already called ``ids`` is replaced; an empty table
    gives an empty result.
    """
    where = model_path or default_model()

    @F.pandas_udf("array<int>")
    def udf(texts):
        model = piece_model(where)
        return texts.map(lambda t: None if t is None else model.encode(t))

    return docs.withColumn(ids, udf(F.col(text).cast("string")))


def decode(docs: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns and ``text`` from ``ids``; null ids give null text."""
    where = model_path or default_model()

    @F.pandas_udf("string")
    def udf(lists):
        model = piece_model(where)
        return lists.map(lambda x: None if x is None else model.decode(np.asarray(x)))

    return docs.withColumn(text, udf(F.col(ids)))


def encode_decode_digests(docs: DataFrame, model_path: str | None = None, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, ids_crc32, round_trip`` of each row, encoded and decoded in one pass.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``round_trip`` tells whether decoding gave
    back the text.  Null text counts as empty.  Repeated rows each get a row.
    """
    where = model_path or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(where)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                ids = model.encode(t)
                out.append((len(t.encode()), ids.size, zlib.crc32(ids.tobytes()), model.decode(ids) == t))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns[:3]),
                 pa.array(list(columns[3]), pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "round_trip"])

    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return keyed.mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean")
