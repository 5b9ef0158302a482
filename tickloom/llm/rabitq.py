"""Similar vectors by randomised-rotation binary codes: all pairs of a cosine threshold, links counted, components found.

Every vector is rotated by a random orthogonal matrix and stored as the signs of its coordinates with a correction
factor, its inner product with its own code. For a vector in few bits and the code of another these give an unbiased estimate of
the inner product, by counting bits, and a bound that holds with high confidence; only pairs whose upper bound reaches the
threshold are computed exactly, in double precision. Candidates meet where they share the largest coordinates (place and sign)
of several further rotations. Only codes are dealt to all these buckets; vectors follow to those buckets where their code has a
partner that the distance of the codes doesn't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .components import connected_components

THRESHOLD = 0.9
SEED = 20
#: Half-width of the confidence bound in standard errors of the estimate.
CONFIDENCE = 4.0
#: Wanted size of a bucket of unrelated vectors, and wanted recall of pairs exactly at the threshold; closer pairs are missed less. Measured in the tests.
BUCKET, RECALL = 64, 0.96
#: Vectors that a comparison task holds of one bucket on either side; larger buckets are compared chunk by chunk.
CHUNK = 4096
#: Rows that are held for small buckets, largest bucket that is compared by shifting, and pairs in one step of a larger one.
TOGETHER, SHIFTED, STEP = 8192, 64, 1 << 20
#: Bits of a coordinate on the side of an estimate that is not the code.
QUERY_BITS = 4
#: Large buckets whose sizes are broadcast; beyond, the join is left to Spark.
BROADCAST_BUCKETS = 100_000


_made: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of this seed."""
    if (dim, k) not in _made:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
        _made[dim, k] = q * np.sign(np.diag(r))
    return _made[dim, k]


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that neither large nor small numbers overflow."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes in the rotated space, packed to 64-bit words, and the correction factor of each: <vector, its code>."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0).T
    bits = np.zeros((len(unit), -(-dim // 64) * 64), bool)
    bits[:, :dim] = turned > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), np.abs(turned).sum(1) / math.sqrt(dim)


def keys_of(unit: np.ndarray, table: int, width: int) -> np.ndarray:
    """Bucket of each vector in a table: of width rotations, the place and sign of the largest coordinate."""
    key = np.full(len(unit), table, np.int64)
    dim = unit.shape[1]
    for k in range(width):
        turned = unit @ rotation(dim, 1 + table * width + k).T
        top = np.abs(turned).argmax(1)
        key = key * (2 * dim) + 2 * top + (turned[np.arange(len(unit)), top] > 0)
    return key


def tables_for(dim: int, threshold: float, width: int, recall: float = RECALL, pairs: int = 4000) -> int:
    """Tables that are needed: from how often random pairs exactly at the threshold meet in one rotation."""
    rng = np.random.default_rng(SEED)
    a, n = unit_rows(rng.standard_normal((pairs, dim))), rng.standard_normal((pairs, dim))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * unit_rows(n - (n * a).sum(1, keepdims=True) * a)
    met = min(0.999, max(0.01, float(np.mean([keys_of(a, t, 1) == keys_of(b, t, 1) for t in range(8)])))) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def query_planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in QUERY_BITS bits a coordinate, rounded at random so that they are right on average: bit planes (bit, row, word), lowest values, steps, and exact sums."""
    dim = turned.shape[1]
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    level = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng([SEED, dim]).random(turned.shape)).astype(np.uint8)
    np.minimum(level, (1 << QUERY_BITS) - 1, out=level)
    bits = np.zeros((QUERY_BITS, len(turned), -(-dim // 64) * 64), bool)
    for k in range(QUERY_BITS):
        bits[k, :, :dim] = level >> k & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8"), low, step, turned.sum(1)


def estimates(query: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, factors: np.ndarray, dim: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <query a, vector b> for pairs of rows, from the planes of a and the code of b, and the half-width of their bounds."""
    planes, low, step, total = query
    code = codes[b]
    dot = sum(np.bitwise_count(planes[k, a] & code).sum(1, dtype=np.int64) << k for k in range(len(planes)))
    scale = math.sqrt(dim) * factors[b]
    about = (2 * (low[a] * np.bitwise_count(codes).sum(1, dtype=np.int64)[b] + step[a] * dot) - total[a]) / scale
    error = np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(1, dim - 1))
    rounding = step[a] / 2 / factors[b]  # at most half a step for each coordinate, by the root of the mean square
    return about, CONFIDENCE * np.hypot(error[b], rounding) + 1e-9


def most_apart(dim: int, threshold: float) -> int:
    """Codes of two vectors at the threshold differ in no more bits, with the same confidence: each bit differs with the angle's share of a half turn."""
    p = math.acos(threshold) / math.pi
    return math.ceil(dim * p + CONFIDENCE * math.sqrt(dim * p * (1 - p)))


def close_pairs(keys: np.ndarray, sides: np.ndarray, codes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in one bucket, each once, whose codes differ in at most limit bits. keys: equal ones adjacent; side 2 meets its whole bucket, 0 only 1."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.flatnonzero(np.repeat((sizes <= SHIFTED) & (sizes > 1), sizes) & (sides == 2))
    k = 1
    while len(small) > k and (same := keys[small[:-k]] == keys[small[k:]]).any():
        a, b = small[:-k][same], small[k:][same]
        near = np.bitwise_count(codes[a] ^ codes[b]).sum(1, dtype=np.int64) <= limit
        yield a[near], b[near]
        k += 1
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        across = sides[s] != 2
        if n > SHIFTED or (n > 1 and across):
            at = np.arange(s, s + n)
            left, right = (at[sides[at] == 0], at[sides[at] == 1]) if across else (at, at)
            step = max(1, STEP // max(1, len(right)))
            for x in range(0, len(left), step):
                part = left[x : x + step]
                near = sum(np.bitwise_count(codes[part, w][:, None] ^ codes[right, w][None]).astype(np.int32) for w in range(codes.shape[1])) <= limit
                i, j = np.nonzero(near)
                a, b = part[i], right[j]
                yield (a, b) if across else (a[a < b], b[a < b])


def first_meeting(keys: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows meet in no table before theirs. keys: (table, row), computed from the vectors, for all tables before the last that occurs."""
    met = np.zeros(len(a), bool)
    for t, key in enumerate(keys):
        met |= (key[a] == key[b]) & (t < table[a])
    return ~met


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of rows a and b; the least row is a tree's root, and all rows point to it."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def similar(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row for every row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing, nor do vectors of different lengths.
    Equal vectors are one class, whose members all link to each other; classes are what links join, so a vector whose vec_id is null
    counts and joins others like any other. A component has its smallest vec_id, null only where no member has one. Repeated vec_ids
    are told apart only by their vectors, and equal rows stay. Extra columns are ignored; an empty table gives an empty result.
    """
    folder = shared_dir(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    numbers = F.col("embedding").cast("array<double>")
    real = F.coalesce((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0), F.lit(False))
    v = v.withColumn("real", real).withColumn("plain", F.when(F.col("real"), F.transform(numbers, lambda x: x + 0.0)))
    v = v.withColumn("class", F.sha2(F.to_json(F.struct("plain")), 256))
    classes = v.where("real").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    classes = stored(spark, classes.withColumn("rep", F.monotonically_increasing_id()), f"{folder}/classes")  # written, so the numbers stay
    longest = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = max(2, longest[1] or 2)
    width = max(1, math.ceil(math.log(max(1, longest[0] / BUCKET)) / math.log(2 * dim)))
    tables = tables_for(dim, threshold, width, recall)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table: bucket, table, vector's name, and a note of its length, table and code."""
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                part = batch.take(pa.array(rows))
                unit = unit_rows(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n))
                code = codes_of(unit)[0].view("<u2")
                for t in range(tables):
                    notes = np.ascontiguousarray(np.concatenate([np.full((len(rows), 1), x, "<u2") for x in (n & 65535, n >> 16, t)] + [code], axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys_of(unit, t, width) * 4096 + n % 4096), pa.array(np.full(len(rows), t, np.int32)), part.column(0), pa.array([x.tobytes() for x in notes], pa.binary())], ["key", "tab", "rep", "note"])

    keyed = classes.select("rep", "embedding").mapInArrow(dealt, "key long, tab int, rep long, note binary").select(F.xxhash64("key", "tab").alias("key"), "rep", "note")
    keyed = stored(spark, keyed, f"{folder}/keyed")  # keys are computed once, for the sizes and for the deal
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    large = stored(spark, large, f"{folder}/large")
    keyed = keyed.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, "key", "left")
    keyed = keyed.withColumn("chunks", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    keyed = keyed.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)  # 2: each row with all of its bucket or chunk
    keyed = keyed.select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi)).alias("key"), "rep", "note", side.alias("side"))

    def with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key to those whose code has a partner in the bucket."""
        for n, t in _whole_buckets(batches):
            keys, sides, _, codes = _noted(t)
            alive = np.zeros(len(keys), bool)
            for a, b in close_pairs(keys, sides, codes, most_apart(n, threshold)):
                alive[a] = alive[b] = True
            yield from t.take(pa.array(np.flatnonzero(alive))).to_batches()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their vectors, sorted by key. (a, b, n): a has n further links of its own found here; b joins a to what it hangs together with."""
        for n, t in _whole_buckets(batches):
            keys, sides, table, codes = _noted(t)
            reps, members = t["rep"].to_numpy(), t["members"].to_numpy()
            vectors = t["embedding"].combine_chunks()
            unit = unit_rows(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), n))
            before = np.array([keys_of(unit, k, width) for k in range(int(table.max(initial=0)))]).reshape(-1, len(keys))
            turned = unit @ rotation(n, 0).T
            query, factors = query_planes(turned), np.abs(turned).sum(1) / math.sqrt(n)
            counts, parent = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for a, b in close_pairs(keys, sides, codes, most_apart(n, threshold)):
                first = first_meeting(before, table, a, b)
                a, b = a[first], b[first]
                about, error = estimates(query, codes, factors, n, a, b)
                likely = about + error >= threshold
                a, b = a[likely], b[likely]
                exact = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
                a, b = a[exact >= threshold], b[exact >= threshold]
                np.add.at(counts, a, members[b])
                np.add.at(counts, b, members[a])
                joined(parent, a, b)
            some, led = np.flatnonzero(counts), np.flatnonzero(parent != np.arange(len(parent)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([reps[some], reps[led]])), pa.array(np.concatenate([reps[some], reps[parent[led]]])), pa.array(np.concatenate([counts[some], np.zeros(len(led), np.int64)]))], ["a", "b", "n"])

    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    partners = by_key(keyed).mapInArrow(with_partners, "key long, rep long, note binary, side int")
    rows = by_key(partners.join(classes.select("rep", "members", "embedding"), "rep").select("key", "rep", "note", "side", "members", "embedding"))
    found = stored(spark, rows.mapInArrow(compared, "a long, b long, n long"), f"{folder}/found")
    counted = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = connected_components(spark, found.where("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    named = classes.select("class", "rep", "least", "members").join(counted, "rep", "left").join(linked, "rep", "left")
    named = named.select("class", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    together = named.where("component is not null")  # the others are their own components
    names = together.groupBy("component").agg(F.min("least").alias("name"))
    named = named.where("component is null").select("class", "n_links", F.col("least").alias("component_id")).unionByName(together.join(names, "component").select("class", "n_links", F.col("name").alias("component_id")))
    named = named.withColumnRenamed("class", "c")
    out = v.select("vec_id", "real", F.when(F.col("real"), F.col("class")).alias("class")).join(named, F.col("class") == F.col("c"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("real"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by key as whole buckets, small ones many at a time, for each length of vectors."""
    held: list[pa.RecordBatch] = []

    def given(t: pa.Table) -> Iterator[tuple[int, pa.Table]]:
        lengths = np.array([int.from_bytes(x[:4], "little") for x in t["note"].to_pylist()])
        for n in np.unique(lengths).tolist():
            yield n, t.take(pa.array(np.flatnonzero(lengths == n)))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            cuts = np.flatnonzero(keys != keys[-1])
            if len(cuts):  # the last bucket may go on in the next batch
                yield from given(t.slice(0, int(cuts[-1]) + 1))
                held = t.slice(int(cuts[-1]) + 1).to_batches()
    if held:
        yield from given(pa.Table.from_batches(held))


def _noted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides, tables and codes of rows."""
    notes = np.frombuffer(b"".join(t["note"].to_pylist()), "<u2").reshape(t.num_rows, -1)
    return t["key"].to_numpy(), t["side"].to_numpy(), notes[:, 2], np.ascontiguousarray(notes[:, 3:]).view("<u8")
