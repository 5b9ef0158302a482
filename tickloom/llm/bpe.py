"""Byte-pair encoding with a pair occurrence index, and decoding, equal to the tokenizers library's on word-end vocabularies.

The words that a partition has not met yet are laid end to end; an index maps each pair of neighbours to all its
positions, active ranks are applied in ascending order, and each merge updates the lists of the pairs that it makes.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import sha256_hex

#: Words after which a task starts a new memory; the one before it stays until then, so at most about twice as many are held.
REMEMBERED = 30_000
#: New words that one index holds; lists of this size stay in the processor's cache.
BLOCK = 2_000
#: Texts that are split at a time: so many rows, or fewer that hold about so many characters, as words take some ten times the memory of their text.
ROWS, CHARACTERS = 256, 1 << 18
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
#: White_Space of Unicode.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


@dataclass(frozen=True)
class Vocabulary:
    """first, last: id of each byte inside and at the end of a word; rank of each pair (left * 2**20 + right), and the pair of each rank; id that each rank makes; the pairs sorted, with their ranks; token of each id."""

    first: tuple[int, ...]
    last: tuple[int, ...]
    ranks: dict[int, int]
    pairs: list[int]
    made: list[int]
    sorted_keys: np.ndarray
    sorted_ranks: np.ndarray
    tokens: dict[int, str]
    special: dict[str, int]


def byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    ids, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
    ranks, pairs, made = {}, [], []
    for k, pair in enumerate(data["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.append((ids[a] << 20) + ids[b])
        ranks[pairs[-1]] = k
        made.append(ids[a + b])
    symbols, special = byte_symbols(), {t["content"]: t["id"] for t in data["added_tokens"]}
    return Vocabulary(tuple(ids[s] for s in symbols), tuple(ids[s + suffix] for s in symbols), ranks, pairs, made, np.sort(np.array(pairs)), np.argsort(np.array(pairs)), {i: t for t, i in ids.items()} | {i: t for t, i in special.items()}, special)


def encode_words(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of each word, all merged together."""
    if not words:
        return []
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    codes = np.frombuffer(b"".join(data), np.uint8)
    symbols = np.array(v.first)[codes]
    symbols[ends - 1] = np.array(v.last)[codes[ends - 1]]
    ids, at, active = symbols.tolist(), *_occurrences(symbols, ends, v)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    for e in ends.tolist():
        after[e - 1] = -1
        if e < len(ids):
            before[e] = -1
    rank_of, made, pairs, push = v.ranks.get, v.made, v.pairs, heapq.heappush
    while active:
        rank = heapq.heappop(active)
        places, key, new = at.pop(rank), pairs[rank], made[rank]
        left, right, as_left = key >> 20, key & 0xFFFFF, new << 20
        places.sort()
        for k in places:
            nxt = after[k]
            if nxt < 0 or ids[k] != left or ids[nxt] != right:
                continue  # used up by a merge since
            ids[k], ids[nxt] = new, -1
            far = after[k] = after[nxt]
            if far >= 0:
                before[far] = k
                r = rank_of(as_left + ids[far])
                if r is not None:
                    if r in at:
                        at[r].append(k)
                    else:
                        at[r] = [k]
                        push(active, r)
            near = before[k]
            if near >= 0:
                r = rank_of((ids[near] << 20) + new)
                if r is not None:
                    if r in at:
                        at[r].append(near)
                    else:
                        at[r] = [near]
                        push(active, r)
    bounds = [0, *ends.tolist()]
    return [[i for i in ids[s:e] if i >= 0] for s, e in zip(bounds, bounds[1:], strict=False)]


def _occurrences(symbols: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[dict[int, list[int]], list[int]]:
    """The index: rank of each pair that can merge to all its positions; and those ranks as a heap."""
    keys = (symbols[:-1] << 20) + symbols[1:]
    slot = np.minimum(np.searchsorted(v.sorted_keys, keys), len(v.sorted_keys) - 1)
    real = v.sorted_keys[slot] == keys
    real[ends[:-1] - 1] = False  # not across words
    places = np.flatnonzero(real)
    ranks = v.sorted_ranks[slot[places]]
    order = np.argsort(ranks, kind="stable")
    places, ranks = places[order], ranks[order]
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    found = ranks[np.append(0, cuts)].tolist() if len(ranks) else []
    return {r: p.tolist() for r, p in zip(found, np.split(places, cuts), strict=False)}, found


def words_of(text: str) -> list[str]:
    """Normalised words: NFC, runs of white space to one space, each character to lower case by itself, then the word pattern."""
    if text.isascii():
        return _ASCII.findall(_SPACE.sub(" ", text).lower())
    text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
    return _ANY.findall(text.replace("Σ", "σ").lower())


class Encoder:
    """Remembers the ids of the words of one partition, as bytes."""

    def __init__(self, v: Vocabulary):
        self.v, self.special = v, re.compile("(" + "|".join(re.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.token = [v.tokens.get(i, "") for i in range(max(v.tokens) + 1)]
        self.forget()

    def forget(self) -> None:
        """Words that were met since the last time stay in the older memory, the others go. Special tokens stay known; a word can't be equal to one, as the pattern cuts those."""
        self.older = getattr(self, "ids", {})
        self.ids = {s: i.to_bytes(4, "little") for s, i in self.v.special.items()}

    def split(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.v.special):
            return words_of(text)
        parts = self.special.split(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else words_of(p))]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text: the tokens joined by spaces."""
        split = [self.split(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.forget()
        new = set().union(*split) - self.ids.keys()
        known = new & self.older.keys()
        self.ids.update((w, self.older[w]) for w in known)
        new = list(new - known)
        for k in range(0, len(new), BLOCK):
            block = new[k : k + BLOCK]
            for w, ids in zip(block, encode_words(block, self.v), strict=True):
                self.ids[w] = np.array(ids, "<u4").tobytes()
        for words in split:
            ids = b"".join(map(self.ids.__getitem__, words))
            yield ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch (doc_id, text) cut into slices of ROWS rows at most, and of CHARACTERS (bytes in UTF-8) at most unless one text is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        least = int(np.searchsorted(ends, (int(ends[k - 1]) if k else 0) + CHARACTERS, "right"))
        n = min(max(least - k, 1), ROWS)
        yield batch.slice(k, n)
        k += n


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, texts: bool = False, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; with ids also ids (array), with texts ids and decoded.

    A null text counts as empty: no tokens. Strings of special tokens in a text become those tokens. Repeated rows and null ids stay;
    extra columns are ignored; an empty table gives an empty result. The vocabulary (fixed size) is read on the driver and broadcast.
    A task holds the words of a bounded amount of text, and ids leave it as arrays, never as lists of numbers.
    """
    v = spark.sparkContext.broadcast(load(path))
    ids = ids or texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v.value)
        for batch in batches:
            for part in _portions(batch):
                rows, said = [], []
                for i, d in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    rows.append((len(i) // 4, sha256_hex(i), sha256_hex(d.encode()), i if ids else None))
                    if texts:
                        said.append(d)
                columns = [part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = np.cumsum([0, *(r[0] for r in rows)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(r[3] for r in rows), "<i4"))))
                    names.append("ids")
                if texts:
                    columns.append(pa.array(said, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long)", "cast(text as string)").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * texts)
