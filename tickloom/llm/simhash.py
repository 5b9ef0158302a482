"""SimHash fingerprints and all links within a Hamming radius, by bit-sliced comparison.

Fingerprints are made in Arrow batches. Equal fingerprints collapse first. Candidates share two of five
bit blocks: of two fingerprints that differ in at most three bits, at least two of the five blocks are
equal, so no link is lost. Inside a bucket the bit planes lie vertically, 64 fingerprints to a machine word;
carry-save counters add up the differing planes, and a block ends early once all its lanes are over the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Bit ranges of the five blocks that candidates are found by.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Fingerprints that one comparison task holds of one bucket; larger buckets are compared chunk by chunk, all pairs of chunks.
CHUNK = 8192
#: Buckets of up to this many are compared by shifting the planes, larger ones fingerprint by fingerprint.
SHIFTED = 16

def fingerprint(text: str | None) -> int:
    """Of the word shingles, repeats included: a bit is 1 if it is set in over half their hashes. No words: 0."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    stops = [*ends[SHINGLE - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp long) for every row of docs, and its digest where one is asked for; a null text counts as no words."""
    more = [] if digest is None else [digest.alias("digest")]
    names = ["doc_id", "fp", "digest"][: 2 + len(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, "doc_id long, fp long" + ", digest string" * len(more))


# Bit-sliced kernel


def planes_of(fps: np.ndarray, bits: int = 64) -> np.ndarray:
    """Vertical planes: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    rows = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(fetch: Callable[[int, np.ndarray], np.ndarray], words: int, radius: int, bits: int = 64) -> np.ndarray:
    """Lanes in which at most radius of the planes are set. fetch(b, at): plane b, of the words whose places are in at.

    Carry-save counters add the planes up; a word, a block of 64 lanes, is abandoned once all its lanes are over the radius.
    """
    at = np.arange(words)
    counters, over = [np.zeros(words, np.uint64) for _ in range(radius.bit_length())], np.zeros(words, np.uint64)
    for b in range(bits):
        carry = fetch(b, at)
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7:
            alive = over != ~np.uint64(0)
            if not alive.all():
                at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
                if not len(at):
                    break
    more, equal = over, ~over
    for i in reversed(range(len(counters))):  # the counters against the radius, from the top bit
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    out = np.zeros(words, np.uint64)
    out[at] = ~more
    return out


def near(planes: np.ndarray, fp: int, radius: int) -> np.ndarray:
    """Lanes within radius of one fingerprint."""
    return within(lambda b, at: planes[b, at] ^ (~np.uint64(0) if fp >> b & 1 else np.uint64(0)), planes.shape[1], radius)


def near_shifted(planes: np.ndarray, by: int, radius: int) -> np.ndarray:
    """Lanes i within radius of lane i + by, for by under 64."""
    padded = np.concatenate([planes, np.zeros((len(planes), 1), np.uint64)], axis=1)
    return within(lambda b, at: padded[b, at] ^ ((padded[b, at] >> np.uint64(by)) | (padded[b, at + 1] << np.uint64(64 - by))), planes.shape[1], radius)


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def _small_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small buckets at once: sorted by bucket, lane i meets lane i + k for k = 1, 2, ..."""
    left, right, k = [], [], 1
    places = np.arange(len(fps))
    while len(places) > k:
        same = keys[places[:-k]] == keys[places[k:]]
        if not same.any():
            break
        close = _lanes(near_shifted(planes_of(fps[places]), k, radius), len(places))[: len(same)] & same
        left.append(places[:-k][close])
        right.append(places[k:][close])
        k += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _large_links(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join all of a bucket that hang together: each reached fingerprint is compared with all not reached yet."""
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        planes = planes_of(fps[rest])
        alive = np.ones(len(rest), bool)
        while queue and len(rest):
            at = queue.pop()
            close = alive & _lanes(near(planes, int(fps[at]), radius), len(rest))
            for x in rest[close].tolist():
                yield at, x
                queue.append(x)
            alive &= ~close
            if 2 * alive.sum() < len(rest):
                rest = rest[alive]
                planes, alive = planes_of(fps[rest]), np.ones(len(rest), bool)
        rest = rest[alive] if len(rest) else rest


def _links_in(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """keys: bucket of each row, equal ones adjacent. Links between ids, at least one path for any two that hang together in a bucket."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= SHIFTED, sizes) & np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(small)
    a, b = _small_links(keys[at], fps[at], radius)
    left, right = [ids[at[a]]], [ids[at[b]]]
    for s, n in zip(starts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist(), strict=True):
        found = np.array(list(_large_links(fps[s : s + n], radius)), int).reshape(-1, 2)
        left.append(ids[s + found[:, 0]])
        right.append(ids[s + found[:, 1]])
    return np.concatenate(left), np.concatenate(right)


def hamming_links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """distinct: (fp, rep), one row for each fingerprint. Links (a, b) between the reps: any two fingerprints within the radius are joined by links."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("two equal blocks are sure only up to a radius of three")
    masks = [sum(((1 << b) - (1 << a)) for a, b in pair) for pair in combinations(BLOCKS, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("band", "bits"))
    keyed = keyed.withColumn("bucket", F.xxhash64("band", "bits"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    keyed = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    keyed = keyed.withColumn("bucket", F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links_in(rows[:, 0], rows[:, 1].view(np.uint64), rows[:, 2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if rows[0, 0] == rows[-1, 0]:
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1  # the last bucket may go on in the next batch
            held = [rows[cut:]]
            yield links(np.ascontiguousarray(rows[:cut]))
        if held:
            yield links(np.concatenate(held))

    return keyed.select("bucket", "fp", "rep").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for every row of docs: doc_id, fp (long), component_id: the smallest doc_id reachable by links, its own included.

    Nulls and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. Links join fingerprints, so rows without a
    doc_id join others like any other; a component is null only where no row of it has one. Extra columns are ignored; an empty table gives an empty result.
    """
    folder = shared_dir(spark)
    fps = stored(spark, fingerprints(docs), f"{folder}/fingerprints")
    distinct = stored(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    linked = connected_components(spark, hamming_links(spark, distinct.select("fp", F.col("fp").alias("rep")), radius))
    rows = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left")
    together = rows.where("component is not null")  # the others are their own components
    names = together.groupBy("component").agg(F.min("least").alias("name"))
    named = rows.where("component is null").select("fp", F.col("least").alias("component_id")).unionByName(together.join(names, "component").select("fp", F.col("name").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, digest: Column, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, n) of the row that stays of each component: smallest doc_id, nulls last, then smallest digest; n rows have both.

    Components hang on fingerprints alone, so rows that share a doc_id or have none are told apart by their text.
    """
    folder = shared_dir(spark)
    fps = stored(spark, fingerprints(docs, digest), f"{folder}/fingerprints")
    distinct = stored(spark, fps.select("fp", F.col("fp").alias("rep")).distinct(), f"{folder}/distinct")
    linked = connected_components(spark, hamming_links(spark, distinct, radius))
    least = lambda *n: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", *n))
    rows = fps.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n")).groupBy("fp").agg(least("n").alias("first"))
    named = rows.join(linked.withColumnRenamed("id", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("first").alias("first"))
    return named.select("first.doc_id", "first.digest", "first.n")
