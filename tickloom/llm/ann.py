"""Nearest neighbours by multiprobe p-stable hashing: exact inner products of what is found in the buckets that are likeliest to hold them.

Vectors get one more coordinate that makes all as long as the longest, so that the largest inner product is the smallest distance.
A table hashes a vector by several random directions, each cut into slots of one width. A query visits its own bucket and then
others in the order of their estimated success: where along each direction a neighbour lies is a normal distribution, so a bucket's
chance is a product over directions. How neighbours lie, and how many directions, tables and visits it takes, is fitted: the exact
neighbours of a few queries among all rows, and a sample of rows for the cost, both of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

NEAREST = 20
SEED = 11
#: Queries whose exact neighbours are found for the fit, rows that are sampled for it, and the share of those neighbours that visits must find.
FIT_QUERIES, FIT_ROWS, RECALL = 64, 8192, 0.95
#: What the fit chooses from: directions of a table, width of a slot in deviations, tables, and visits in each.
DIRECTIONS, WIDTHS, TABLES, VISITS = (4, 6, 8, 10, 12, 16, 20, 24), (0.7, 1.0, 1.5, 2.2), (1, 2, 4, 8), (1, 2, 4, 8, 16, 32, 64, 128)
#: Slots reach so many deviations to either side; what lies beyond is in the last ones.
REACH = 2.2
#: A row that is dealt costs as much as so many inner products.
DEALT = 100
#: Vectors of one bucket, and visitors of it, that meet in one task; rows that are held together; inner products in one step.
MEMBERS, VISITORS, TOGETHER, STEP = 2048, 4096, 8192, 1 << 22
#: Buckets over a chunk that are broadcast; beyond, the join is left to Spark.
BROADCAST_BUCKETS = 100_000


@dataclass(frozen=True)
class Index:
    """dim: longest vector; long: length of the longest; width, tables and so on as fitted; slope and spread: a neighbour lies around slope times where its query lies."""

    dim: int
    long: float
    scale: float
    directions: int
    width: float
    tables: int
    visits: int
    slope: float
    spread: float


def _random(dim: int, table: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of a table, for the vector and the coordinate that is added, and where slots begin, as a share of their width."""
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim + 1, 64))[:, :directions], rng.random(64)[:directions]


def lifted(x: np.ndarray, long: float) -> np.ndarray:
    """Rows scaled by the longest, with the coordinate that makes them of length one."""
    y = x.astype(np.float64) / long
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))[:, None]], axis=1)


def asked(x: np.ndarray) -> np.ndarray:
    """Queries of length one, without the added coordinate."""
    y = x.astype(np.float64) / np.abs(x).max(1, keepdims=True)
    return np.concatenate([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros((len(y), 1))], axis=1)


def places(lifted_rows: np.ndarray, dim: int, table: int, directions: int, scale: float) -> np.ndarray:
    """Where rows lie along the directions of a table, in deviations."""
    a = _random(dim, table, directions)[0]
    n = lifted_rows.shape[1] - 1
    return (lifted_rows[:, :n] @ a[:n] + lifted_rows[:, n:] @ a[dim:]) / scale


def _slots(width: float) -> int:
    """Slots to either side of the middle one."""
    return max(1, math.ceil(REACH / width))


def bucket_of(at: np.ndarray, width: float, begin: np.ndarray) -> np.ndarray:
    """Slots as one number for each row."""
    half = _slots(width)
    slot = np.clip(np.floor(at / width + begin).astype(np.int64), -half, half) + half
    key = np.zeros(len(at), np.int64)
    for k in range(slot.shape[1]):
        key = key * (2 * half + 1) + slot[:, k]
    return key


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function, by its logistic form: within 0.0002, which is enough for an order."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -500, 500)))


def visited(at: np.ndarray, width: float, begin: np.ndarray, slope: float, spread: float, visits: int) -> np.ndarray:
    """(row, visit): buckets of queries at these places, their own first, then by estimated success; -1 where there are no more.

    The best of a product over directions are products of the best of a product over fewer, so a list of fixed length goes from direction to direction.
    """
    half = _slots(width)
    edges = (np.arange(-half, half + 2)[None] - begin[:, None]) * width
    edges[:, 0], edges[:, -1] = -np.inf, np.inf
    chance, key = np.zeros((len(at), 1)), np.zeros((len(at), 1), np.int64)
    for k in range(at.shape[1]):
        part = np.diff(_below((edges[k][None] - slope * at[:, k : k + 1]) / spread), axis=1)
        both = (chance[:, :, None] + np.log(np.maximum(part, 1e-300))[:, None]).reshape(len(at), -1)
        keys = (key[:, :, None] * (2 * half + 1) + np.arange(2 * half + 1)).reshape(len(at), -1)
        best = np.argsort(-both, axis=1, kind="stable")[:, : visits + 1]
        chance, key = np.take_along_axis(both, best, 1), np.take_along_axis(keys, best, 1)
    own = bucket_of(at, width, begin)
    order = np.argsort(key != own[:, None], axis=1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    there = key[:, 0] == own
    key = np.where(there[:, None], key, np.concatenate([own[:, None], key[:, :-1]], axis=1))
    out = np.full((len(at), visits), -1, np.int64)
    out[:, : key.shape[1]] = key[:, :visits]
    return out


def fit(rows: np.ndarray, queries: np.ndarray, near: np.ndarray, of: np.ndarray, n: int, n_queries: int, long: float) -> Index:
    """rows: the sample; near: exact neighbours, of: each one's query. The cheapest choice whose visits find RECALL of them.

    Where no choice does, the one that finds most; the buckets of four directions with the widest slots are few enough to be visited whole.
    """
    dim = rows.shape[1]
    r, q, x = lifted(rows, long), asked(queries), lifted(near, long)
    scale = float(np.std(places(r, dim, 0, 24, 1.0))) or 1.0
    found: list[tuple[bool, float, Index]] = []
    for directions in DIRECTIONS:
        tables = [[places(v, dim, t, directions, scale) for v in (r, q, x)] for t in range(max(TABLES))]
        a, b = np.concatenate([t[1][of].ravel() for t in tables]), np.concatenate([t[2].ravel() for t in tables])
        slope = float(a @ b / max(a @ a, 1e-300))
        spread = max(1e-3, float(np.std(b - slope * a)))
        for width in WIDTHS:
            if directions * math.log2(2 * _slots(width) + 1) > 60:
                continue
            rank, scanned = [], []
            for t, (at_r, at_q, at_x) in enumerate(tables):
                begin = _random(dim, t, directions)[1]
                visit = visited(at_q, width, begin, slope, spread, max(VISITS))
                hit = visit[of] == bucket_of(at_x, width, begin)[:, None]
                rank.append(np.where(hit.any(1), hit.argmax(1), max(VISITS)))
                keys, counts = np.unique(bucket_of(at_r, width, begin), return_counts=True)
                place = np.minimum(np.searchsorted(keys, visit), len(keys) - 1)
                scanned.append(np.cumsum(np.where(keys[place] == visit, counts[place], 0), axis=1).mean(0) / len(rows))
            for t in TABLES:
                first = np.min(rank[:t], axis=0)
                for visits in VISITS:
                    recall = float((first < visits).mean()) if len(of) else 1.0
                    cost = n * sum(s[visits - 1] for s in scanned[:t]) + DEALT * t * (visits + n / max(1, n_queries))
                    found.append((recall >= RECALL, -cost if recall >= RECALL else recall, Index(dim, long, scale, directions, width, t, visits, slope, spread)))
    return max(found, key=lambda f: f[:2])[2]


def _best(scores: np.ndarray, ids: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k best of their query: highest score, then smallest id, nulls (the largest number) last."""
    order = np.lexsort((ids, -scores, of))
    starts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(order) else np.zeros(0, int)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < k]


def matched(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of the k best rows of each query, all in double precision.

    Blocks are multiplied first; what could be among the best by their rounding is computed again pair by pair, so that a score doesn't hang on its block.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    longest = float(np.linalg.norm(rows, axis=1).max()) if len(rows) else 0.0
    step = max(1, STEP // max(1, len(rows)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        about = q @ rows.T
        if len(rows) > k:
            least = np.partition(about, len(rows) - k, axis=1)[:, len(rows) - k] - 1e-12 * q.shape[1] * longest * np.linalg.norm(q, axis=1)
            i, j = np.nonzero(about >= least[:, None])
        else:
            i, j = (m.ravel() for m in np.indices(about.shape))
        score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], rows[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        best = _best(score, ids[j], i, k)
        out.append((i[best] + a, j[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(t: pa.Table, column: str) -> Iterator[pa.Table]:
    sizes = np.array([len(x) for x in t[column]])
    for n in np.unique(sizes).tolist():
        yield t.take(pa.array(np.flatnonzero(sizes == n)))


def usable(embedding: Column, kind: str = "double") -> Column:
    """As numbers of a kind; null where null, empty, zero or holding null or non-finite numbers."""
    numbers = embedding.cast("array<double>")
    real = (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    return F.when(real, F.transform(numbers, lambda x: x + 0.0).cast(f"array<{kind}>"))


def _exact(classes: DataFrame, queries: list[tuple[bytes, np.ndarray]], k: int) -> list[tuple[bytes, np.ndarray]]:
    """(query, vector) of the exact neighbours of a few queries, other than themselves, among all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _by_length(pa.Table.from_batches([batch]), "embedding"):
                m, names = _matrix(t["embedding"]), t["class"].to_pylist()
                for name, q in queries:
                    if len(q) == m.shape[1]:
                        other = np.flatnonzero(np.array([x != name for x in names]))
                        _, j, s = matched(q[None], m[other], other, k)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(j), pa.binary()), pa.array(s), t["embedding"].take(pa.array(other[j])).combine_chunks()], ["q", "score", "embedding"])

    found = classes.select("class", "embedding").mapInArrow(run, f"q binary, score double, embedding {classes.schema['embedding'].dataType.simpleString()}")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "embedding")
    best = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)  # few queries, k rows of each from a task
    return [(bytes(r.q), np.array(r.embedding)) for r in best.select("q", "embedding").collect()]


def fitted(classes: DataFrame, k: int = NEAREST) -> Index | None:
    """Index for classes (class, embedding, ids, queries); None if there are none. To the driver go FIT_QUERIES queries, k neighbours of each and FIT_ROWS rows."""
    totals = classes.agg(F.count("*"), F.count(F.when(F.col("queries") > 0, 1)), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double")))), F.max(F.size("embedding"))).first()
    if not totals[1]:
        return None
    top = totals[2]
    longest = classes.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") / top * (x.cast("double") / top))))).first()[0] * top
    mixed = F.xxhash64("class", F.lit(SEED))
    some = [np.array(r[0]) for r in classes.orderBy(mixed, "class").limit(FIT_ROWS).select("embedding").collect()]
    asking = [(bytes(r[0]), np.array(r[1])) for r in classes.where("queries > 0").orderBy(mixed, "class").limit(FIT_QUERIES).select("class", "embedding").collect()]
    near = _exact(classes, asking, k)
    place = {name: n for n, (name, _) in enumerate(asking)}
    wide = lambda rows: np.array([np.pad(x, (0, totals[3] - len(x))) for x in rows]).reshape(len(rows), totals[3])
    return fit(wide(some), wide([x for _, x in asking]), wide([x for _, x in near]), np.array([place[name] for name, _ in near], int), totals[0], totals[1], longest)


def _dealt(index: Index, visits: int | None):
    """For mapInArrow over (class, embedding, ids): a row for each table, or with visits, for each bucket visited. Buckets are apart by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _by_length(pa.Table.from_batches([batch]), "embedding"):
                m = _matrix(t["embedding"])
                rows = lifted(m, index.long) if visits is None else asked(m)
                for table in range(index.tables):
                    at, begin = places(rows, index.dim, table, index.directions, index.scale), _random(index.dim, table, index.directions)[1]
                    if visits is None:
                        buckets = bucket_of(at, index.width, begin)[:, None]
                    else:
                        buckets = visited(at, index.width, begin, index.slope, index.spread, visits)
                    row, which = np.nonzero(buckets >= 0)
                    for s in range(0, len(row), TOGETHER):
                        part = t.take(pa.array(row[s : s + TOGETHER])).combine_chunks()
                        n = part.num_rows
                        columns = [pa.array(np.full(n, table, np.int32)), pa.array(np.full(n, m.shape[1], np.int32)), pa.array(buckets[row[s : s + n], which[s : s + n]])]
                        yield from pa.Table.from_arrays([*columns, *[part[c] for c in ("class", "embedding", "ids")]], ["tab", "dim", "bucket", "class", "embedding", "ids"]).to_batches()

    return run


def _reranked(k: int):
    """For mapInArrow over rows sorted by key, visitors (asks) and members: a list of the k best members of each visitor in what is held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            keys, asks = t["key"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            found = []
            least = pc.fill_null(pc.list_element(t["ids"], 0), np.iinfo(np.int64).max).to_numpy()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                q, x = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if len(q) and len(x):
                    i, j, s = matched(_matrix(t["embedding"].take(pa.array(q))), _matrix(t["embedding"].take(pa.array(x))), least[x], k)
                    found.append((q[i], x[j], s))
            if found:
                i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
                names = t["class"].combine_chunks().dictionary_encode().indices.to_numpy()
                pairs = np.unique(np.stack([names[i], names[j]], axis=1), axis=0, return_index=True)[1]  # a pair that met in several tables
                i, j, s = i[pairs], j[pairs], s[pairs]
                best = _best(s, least[j], names[i], k)
                of = names[i[best]]  # lists are together, as the best are in the order of their queries
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                rows = pa.array(j[best])
                pairs = pa.StructArray.from_arrays([t["class"].take(rows).combine_chunks(), pa.array(s[best]), t["ids"].take(rows).combine_chunks()], ["x", "score", "ids"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), pairs)
                yield from pa.Table.from_arrays([t["class"].take(pa.array(i[best][starts])), pa.chunked_array([lists])], ["q", "found"]).to_batches()

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, as many at a time as make TOGETHER, keys whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            cuts = np.flatnonzero(keys != keys[-1])
            if len(cuts):
                yield t.slice(0, int(cuts[-1]) + 1)
                held = t.slice(int(cuts[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


FOUND = "array<struct<x:binary,score:double,ids:array<bigint>>>"


def _visits(spark: SparkSession, members: DataFrame, visitors: DataFrame, k: int, path: str) -> DataFrame:
    """(q, found: lists of x, score, ids) of members and visitors (tab, dim, bucket, class, embedding, ids) that meet.

    A bucket with over MEMBERS or VISITORS of them is a grid of chunks: members go to a row of its tasks, visitors to a column, so that all still meet.
    """
    at = ["tab", "dim", "bucket"]
    counted = members.select(*at, F.lit(1).alias("m"), F.lit(0).alias("v")).unionAll(visitors.select(*at, F.lit(0).alias("m"), F.lit(1).alias("v"))).groupBy(*at).agg(F.sum("m").alias("m"), F.sum("v").alias("v"))
    large = stored(spark, counted.where((F.col("m") > MEMBERS) | (F.col("v") > VISITORS)).select(*at, F.ceil(F.col("m") / MEMBERS).alias("m"), F.ceil(F.col("v") / VISITORS).alias("v")), f"{path}-large")
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large

    def grid(rows: DataFrame, asks: bool) -> DataFrame:
        of, other = ("v", "m") if asks else ("m", "v")
        many = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("long")
        mine, all_others = F.pmod(F.xxhash64("class"), many(F.col(of))), F.sequence(F.lit(0).cast("long"), many(F.col(other)) - 1)
        rows = rows.join(large, at, "left").withColumn("mine", mine).withColumn("theirs", F.explode(all_others))
        cell = ("theirs", "mine") if asks else ("mine", "theirs")
        return rows.select(F.xxhash64(*at, *cell).alias("key"), F.lit(asks).alias("asks"), "class", "embedding", (F.lit(None).cast("array<long>") if asks else F.col("ids")).alias("ids"))

    both = grid(members, False).unionByName(grid(visitors, True))
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(_reranked(k), f"q binary, found {FOUND}")


def nearest(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that queries holds for, the k rows of largest inner product found, its own row apart: query_id, rank from 1, vec_id, score.

    All candidates of the same length, if fewer. Ties go to the smaller vec_id, a null one last. Equal vectors are one class, compared once, and
    always found by one another; rows that repeat a vec_id are neighbours of each other, and each asks. Vectors that are null, empty, zero or hold
    null or non-finite numbers take no part, nor do those of other lengths than the query's. A query whose visits found too few visits every
    bucket of the first table. Extra columns are ignored; an empty table gives an empty result.
    """
    folder = shared_dir(spark)
    shape = "query_id long, rank int, vec_id long, score double"
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # single precision is sent as it is, and computed in double
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding"), kind).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks")).where("embedding is not null")
    v = v.withColumn("class", F.unhex(F.md5(F.to_json(F.struct("embedding")))))
    # an answer has at most k of a class and the query itself, so no class is held whole: the least of each are chosen before the shuffle
    first = v.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy(F.asc_nulls_last("vec_id")))).where(F.col("nth") <= k + 1)
    first = first.groupBy("class").agg(F.first("embedding").alias("embedding"), F.collect_list(F.struct("nth", "vec_id")).alias("ids"))
    asking = stored(spark, v.where("asks").select("class", "vec_id"), f"{folder}/asking")
    per_class = asking.groupBy("class").agg(F.count("*").alias("queries"))
    classes = first.join(per_class, "class", "left").select("class", "embedding", F.transform(F.array_sort("ids"), lambda s: s["vec_id"]).alias("ids"), F.coalesce("queries", F.lit(0).cast("long")).alias("queries"))
    classes = stored(spark, classes, f"{folder}/classes")
    index = fitted(classes, k)
    if index is None:
        return spark.createDataFrame([], shape)
    dealt = f"tab int, dim int, bucket long, class binary, embedding array<{kind}>, ids array<long>"
    rows = classes.select("class", "embedding", "ids")
    members = rows.mapInArrow(_dealt(index, None), dealt)
    visitors = classes.where("queries > 0").select("class", "embedding", "ids").mapInArrow(_dealt(index, index.visits), dealt)
    met = _visits(spark, members, visitors, k + 1, f"{folder}/visits")
    found = stored(spark, _merged(met, classes, k), f"{folder}/found")
    per_length = classes.groupBy(F.size("embedding").alias("dim")).agg(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("there"))
    lengths = classes.where("queries > 0").select("class", F.size("embedding").alias("dim")).join(per_length, "dim")
    short = stored(spark, found.join(lengths, "class").where(F.size("best") < F.col("there")).select("class"), f"{folder}/short")
    if not short.isEmpty():
        first_table = members.where("tab = 0")
        all_buckets = first_table.select("tab", "dim", "bucket").distinct()
        again = classes.join(short, "class", "left_semi").withColumn("dim", F.size("embedding")).join(all_buckets, "dim").select("tab", "dim", "bucket", "class", "embedding", "ids")
        more = _merged(_visits(spark, first_table, again, k + 1, f"{folder}/short-visits"), classes.join(short, "class", "left_semi"), k)
        found = found.join(short, "class", "left_anti").unionByName(more)
    asked_rows = asking.join(found, "class")
    own = F.array_position(F.transform("best", lambda b: F.coalesce(b["vec_id"].cast("string"), F.lit("-"))), F.coalesce(F.col("vec_id").cast("string"), F.lit("-"))).cast("int")
    others = F.when(own > 0, F.concat(F.slice("best", F.lit(1), own - 1), F.slice("best", own + 1, F.size("best")))).otherwise(F.col("best"))
    out = asked_rows.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _merged(met: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(class, best): the k + 1 best ids of each query, its own class always among what is found. A query has a list for each of its visits, or for several held together, each of k + 1."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    own = classes.where("queries > 0").select(F.col("class").alias("q"), F.array(F.struct(F.col("class").alias("x"), norm.alias("score"), F.col("ids"))).cast(FOUND).alias("found"))
    lists = met.unionByName(own).groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("f"))
    once = F.filter("f", lambda e, i: (i == 0) | (F.get("f", i - 1)["x"] != e["x"]))  # a pair that met in several tables; sorted by x
    one = F.flatten(F.transform(once, lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("minus"), i.isNull().alias("none"), i.alias("vec_id")))))
    best = F.slice(F.array_sort(one), 1, k + 1)
    return lists.select(F.col("q").alias("class"), F.transform(best, lambda b: F.struct(b["vec_id"].alias("vec_id"), (-b["minus"]).alias("score"))).alias("best"))
