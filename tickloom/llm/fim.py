"""Fill-in-middle transformation over piece tables.

A document is an immutable buffer of UTF-8; the sentinels are another. A document, a cut document and an output are lists of
descriptors (buffer, start, end) over them. Cutting splits descriptors at line ends, an arrangement permutes the parts and puts
sentinel descriptors between them, the inverse permutation restores them. Digests stream the descriptors through the hash; text
is only made where it is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What comes before prefix, suffix and middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Per cent of documents that are transformed, and of those, that begin with the suffix.
RATE, SPM = 100, 50
SEED = 7
#: Order of the parts (0 prefix, 1 suffix, 2 middle) in each form. A text is its prefix, middle and suffix.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
NATURAL = (0, 2, 1)

SHAPE = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Piece:
    """Bytes start to end of a buffer."""

    buffer: memoryview
    start: int
    end: int

    def view(self) -> memoryview:
        return self.buffer[self.start : self.end]


def whole(data: bytes) -> list[Piece]:
    return [Piece(memoryview(data), 0, len(data))] if data else []


def cut(pieces: list[Piece], at: Iterable[int]) -> list[list[Piece]]:
    """Parts between ascending places, counted in bytes from the first piece; a piece that holds a place is split there."""
    parts: list[list[Piece]] = [[]]
    rest, seen = list(pieces), 0
    for place in at:
        while rest and seen < place:
            p = rest.pop(0)
            size = p.end - p.start
            if seen + size > place:
                middle = p.start + place - seen
                rest.insert(0, Piece(p.buffer, middle, p.end))
                p, size = Piece(p.buffer, p.start, middle), place - seen
            parts[-1].append(p)
            seen += size
        parts.append([])
    parts[-1].extend(rest)
    return parts


def arranged(parts: list[list[Piece]], form: str, sentinels: tuple[bytes, ...] = SENTINELS) -> list[Piece]:
    """Parts (prefix, suffix, middle) in the order of the form, each after its sentinel."""
    return [p for k in ORDERS[form] for p in [*whole(sentinels[k]), *parts[k]]]


def restored(output: bytes, form: str, sentinels: tuple[bytes, ...] = SENTINELS) -> list[Piece]:
    """The document again, as pieces of the output: parts lie between its sentinels, in the order of the form; the inverse permutation puts them back.

    A sentinel can't come about where a part meets another sentinel, as each begins with a character that none has elsewhere.
    """
    if form == "plain":
        return whole(output)
    order = ORDERS[form]
    starts = []
    for k in order:
        starts.append(output.index(sentinels[k], starts[-1] if starts else 0))
    ends = [*starts[1:], len(output)]
    buffer = memoryview(output)
    return [Piece(buffer, starts[order.index(k)] + len(sentinels[k]), ends[order.index(k)]) for k in NATURAL]


def digest(pieces: Iterable[Piece]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.view())
    return h.hexdigest()


def code_points(pieces: Iterable[Piece]) -> int:
    """Bytes that don't go on with a code point."""
    return sum(int(np.count_nonzero((np.frombuffer(p.view(), np.uint8) & 0xC0) != 0x80)) for p in pieces)


def line_ends(data: bytes) -> np.ndarray:
    """Place after each unit: a line with its end, or what follows the last one."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of a document; those of a null doc_id are those of the word null."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(doc_id: int | None, data: bytes, rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[bytes, ...] = SENTINELS) -> tuple[int, str, list[list[Piece]], list[Piece]]:
    """Units, form, parts (prefix, suffix, middle; none if plain) and output of one document."""
    ends = line_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not data or any(s in data for s in sentinels) or h3 % 100 >= rate:
        return n, "plain", [], whole(data)
    at = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = cut(whole(data), at)
    form = "spm" if h4 % 100 < spm else "psm"
    parts = [prefix, suffix, middle]
    return n, form, parts, arranged(parts, form, sentinels)


def fill_in_middle(docs: DataFrame, texts: bool = False, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row for every row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; with texts, the output too.

    A null text counts as empty. Texts that are empty or hold a sentinel stay plain; their prefix_chars and middle_chars are null.
    Repeated rows stay, and equal doc_ids are cut by the same numbers; a null doc_id stays null. Extra columns are ignored; an
    empty table gives an empty result. restored_sha256 is of the text as rebuilt from the output and the form alone.
    """
    shape = f"doc_id long, {SHAPE}{', output string' if texts else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in range(7 + texts)]
            for i, text in zip(ids, batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, form, parts, pieces = transformed(i, data, rate, spm, seed)
                output = b"".join(p.view() for p in pieces)
                row = [i, n, form, code_points(parts[0]) if parts else None, code_points(parts[2]) if parts else None, digest(pieces), digest(restored(output, form))]
                for column, value in zip(out, [*row, output.decode()] if texts else row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)
