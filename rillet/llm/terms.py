"""Terms of texts as bytes: runs of letters (or letters and digits) and of all bytes above ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def _translation(digits: bool) -> bytes:
    """Byte table: A-Z lower-cased, every other ASCII byte that is no part of a term a blank."""
    out = bytearray(range(256))
    for c in range(128):
        if 0x41 <= c <= 0x5A:
            out[c] = c + 32
        elif not (0x61 <= c <= 0x7A or (digits and 0x30 <= c <= 0x39)):
            out[c] = 0x20
    return bytes(out)


LETTERS, LETTERS_DIGITS = _translation(False), _translation(True)


def term_runs(text: bytes, translation: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, as lists of about ``piece`` bytes of text each (cut between terms)."""
    text = text.translate(translation)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
