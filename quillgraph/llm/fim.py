"""Fill-in-middle transformation of documents by piece tables.

A document is a short list of descriptors (buffer, start, length) over two buffers that never change: its UTF-8 text and
the sentinels. Cutting splits a descriptor, an arrangement permutes the parts and puts sentinel descriptors between them,
and the inverse permutation restores the text from the output. Text is copied once, when an output is written; digests
are taken from the descriptors' slices one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the sentinels, and in what order each form writes them with the parts
#: (0 prefix, 1 middle, 2 suffix) that follow them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
PLAIN = "plain"
#: Per cent of the documents that are rearranged, and per cent of these that begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes looked at together when code points are counted, and of the texts of a result batch.
BLOCK, BATCH_BYTES = 1 << 20, 16 << 20

TEXT, SENTINELS = 0, 1
_SENTINELS = PREFIX + SUFFIX + MIDDLE
_ARRANGED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())])


class Piece(NamedTuple):
    """A slice of a buffer, in bytes."""

    buffer: int
    start: int
    length: int


def cut(pieces: list[Piece], ends: Iterable[int]) -> list[list[Piece]]:
    """The descriptors up to each of the ascending offsets ``ends``, and the rest; those that hold an end are split."""
    parts, part, rest, at = [], [], list(reversed(pieces)), 0
    for end in ends:
        while rest and at < end:
            piece = rest.pop()
            if at + piece.length > end:
                rest.append(Piece(piece.buffer, piece.start + end - at, at + piece.length - end))
                piece = Piece(piece.buffer, piece.start, end - at)
            part.append(piece)
            at += piece.length
        parts.append(part)
        part = []
    return [*parts, rest[::-1]]


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each after its sentinel."""
    return [piece for mark, part in FORMS[form] for piece in (Piece(SENTINELS, _SENTINELS.index(mark), len(mark)), *parts[part])]


def unarrange(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that give back the text: its parts without sentinels, in the inverse order.

    A text that is rearranged holds no sentinel, and none arises where parts and sentinels meet, so each is found where
    it was put. An output that doesn't have the sentinels of its form is refused.
    """
    if form == PLAIN:
        return [Piece(TEXT, 0, len(output))]
    starts, at = [], 0
    for mark, _ in FORMS[form]:
        at = output.find(mark, at)
        if at < 0 or (not starts and at):
            raise ValueError(f"the output is not of the form {form}")
        starts.append(at)
        at += len(mark)
    parts = cut([Piece(TEXT, 0, len(output))], [end for at in starts for end in (at, at + len(PREFIX))])[2::2]
    inverse = np.argsort([part for _, part in FORMS[form]])
    return [piece for k in inverse for piece in parts[k]]


def slices(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes that the descriptors stand for, without a copy."""
    buffers = memoryview(text), memoryview(_SENTINELS)
    return (buffers[p.buffer][p.start : p.start + p.length] for p in pieces)


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    """SHA-256 of what the descriptors stand for, slice by slice."""
    state = hashlib.sha256()
    for part in slices(pieces, text):
        state.update(part)
    return state.hexdigest()


def _starts(block: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(block, np.uint8) & 0xC0 != 0x80)


def count_points(text: bytes) -> int:
    """The code points of UTF-8 text."""
    if text.isascii():
        return len(text)
    return sum(len(_starts(text[k : k + BLOCK])) for k in range(0, len(text), BLOCK))


def offsets(text: bytes, points: list[int]) -> list[int]:
    """The byte offsets of ascending code-point offsets."""
    if text.isascii():
        return points
    found, seen = [], 0
    for k in range(0, len(text), BLOCK):
        here = _starts(text[k : k + BLOCK])
        while len(found) < len(points) and points[len(found)] < seen + len(here):
            found.append(k + int(here[points[len(found)] - seen]))
        seen += len(here)
    return found + [len(text)] * (len(points) - len(found))


def choose(doc_id: int | None, text: bytes, n: int, seed: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a document, in code points, from a hash of its id alone."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or h3 % 100 >= REARRANGED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), low, high


def _batches(rows: Iterable[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; ``text`` is the column that holds the bytes of a text."""

    def made():
        columns = [pa.array(c, pa.binary()).cast(pa.string()) if k == text else pa.array(c, schema.types[k]) for k, c in enumerate(zip(*held, strict=True))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or b"")
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def fill_in_middle(df: DataFrame, id_col: str, text_col: str, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of every row.

    ``n`` counts the code points of the whole text. The form is plain, psm or spm; it and the cuts depend on the id, so
    copies with different ids are cut apart, rows that repeat an id are cut at the same places if they are equally long,
    and nothing depends on order or partitions. A null text is an empty one; empty texts and texts that
    hold a sentinel are plain, and plain texts are their own output, with null lengths. A null id counts as an empty
    string. Other columns are left out, so their names cannot clash. No rows give no rows. No shuffle is needed.
    """

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                n = count_points(text)
                form, low, high = choose(doc, text, n, seed)
                pieces = [Piece(TEXT, 0, len(text))]
                if form != PLAIN:
                    pieces = arrange(cut(pieces, offsets(text, [low, high])), form)
                lengths = (None, None) if form == PLAIN else (low, high - low)
                yield doc, n, form, *lengths, b"".join(slices(pieces, text)), digest(pieces, text)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _batches(rows(batches), _ARRANGED, 5), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(arranged: DataFrame) -> DataFrame:
    """``arranged`` (with doc_id, form and output) with ``restored``, the text rebuilt from output and form alone, and its digest.

    A null output is an empty one; an output that doesn't fit its form stops the job. No rows give no rows.
    """
    names = [c for c in arranged.columns if c not in ("restored", "restored_sha256")]

    def run(batches):
        for batch in batches:
            form, output = (batch.column(batch.schema.get_field_index(c)) for c in ("form", "output"))
            begun, size, texts, digests = 0, 0, [], []
            for k, (kind, data) in enumerate(zip(form.to_pylist(), output.cast(pa.binary()), strict=True)):
                data = data.as_py() or b""
                pieces = unarrange(data, kind)
                texts.append(b"".join(slices(pieces, data)))
                digests.append(digest(pieces, data))
                size += len(data)
                if size >= BATCH_BYTES or k == len(form) - 1:
                    part = batch.slice(begun, k + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)], names=[*names, "restored", "restored_sha256"])
                    begun, size, texts, digests = k + 1, 0, [], []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.select(names).schema)
    return arranged.select(names).mapInArrow(run, f"{schema}, restored string, restored_sha256 string")
