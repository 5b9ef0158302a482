"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, queries

def asks():
    return F.col("vec_id") % 20 == 0


def brute(rows, k=20):
    """{(query row, id): [(score, id)]} by row; rows: (id, list or None)."""
    fit = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {}
    for n, (i, q) in enumerate(fit):
        if i is not None and i % 20 == 0:
            near = [(-float(q @ x), j is None, j or 0, j) for m, (j, x) in enumerate(fit) if m != n and len(x) == len(q)]
            out.setdefault(i, []).append([(-s, j) for s, _, _, j in sorted(near, key=lambda t: (round(t[0], 12), *t[1:3]))[:k]])
    return out


def answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = answers(queries.op11_nearest_neighbours(spark, f"/root/testdata/{sf}")), brute(rows)
    assert got.keys() == want.keys()
    hits = 0
    for q, (near,) in want.items():
        listed = sorted(got[q])
        assert [r for r, _, _ in listed] == list(range(1, 21)) and [(-s, i) for _, s, i in listed] == sorted((-s, i) for _, s, i in listed)
        hits += len({i for _, _, i in listed} & {i for _, i in near})
    assert hits / 20 / len(want) >= 0.93


def test_scores_ties_and_rows_that_take_no_part(spark, monkeypatch):
    """Every bucket of two tables is visited, so everything is found. Nulls, zeros, other lengths, copies, repeated and null ids."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(100)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(400, rows[3][1]), (400, rows[3][1]), (20, rows[20][1]), (20, rows[21][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(500, None), (520, []), (540, [0.0] * 8), (560, [None] + [1.0] * 7), (580, [float("nan")] * 8), (600, [float("inf")] * 8), (620, [1.0, 2.0, 3.0]), (621, [3.0, 2.0, 1.0]), (640, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"class": F.lit(1), "bucket": F.lit(2), "label": F.lit(3)})
    fitted = ann.fitted
    monkeypatch.setattr(ann, "fitted", lambda classes, k: (i := fitted(classes, k)) and ann.Index(**{**i.__dict__, "directions": 2, "width": 2.2, "tables": 2, "visits": 64}))
    got = {}
    for r in ann.nearest(spark, df.repartition(5), asks()).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(r.score, 9), r.vec_id))
    want = {i: sorted((n + 1, round(s, 9), j) for near in lists for n, (s, j) in enumerate(near)) for i, lists in brute(rows).items() if any(lists)}
    key = lambda t: tuple(map(repr, t))
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(v, key=key) for i, v in want.items()}
    assert ann.nearest(spark, df.where("false"), asks()).count() == 0 and ann.nearest(spark, df.where("vec_id = 3"), asks()).count() == 0


@pytest.mark.parametrize("chunk", [None, 16])
def test_buckets_in_chunks_and_queries_that_found_too_few(spark, monkeypatch, chunk):
    """Groups of near copies among vectors of very different lengths; also with buckets dealt in a grid, and with one visit, so that most must look again."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + 0.05 * rng.standard_normal((500, 16)), rng.standard_normal((100, 16)) * rng.lognormal(0, 1, (100, 1))])
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("MEMBERS", "VISITORS") if chunk else ():
        monkeypatch.setattr(ann, name, chunk)
    want = brute(rows)
    got = answers(ann.nearest(spark, df, asks()))
    assert np.mean([len({i for _, _, i in got[q]} & {i for _, i in near}) / 20 for q, (near,) in want.items()]) >= 0.93
    fitted = ann.fitted
    monkeypatch.setattr(ann, "fitted", lambda classes, k: ann.Index(**{**fitted(classes, k).__dict__, "directions": 12, "width": 0.7, "tables": 1, "visits": 1}))
    got = answers(ann.nearest(spark, df, asks()))
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()


def test_visits_go_by_estimated_success():
    """Against all buckets in order of their chance, the own one first."""
    rng = np.random.default_rng(5)
    at, begin, width = rng.standard_normal((6, 3)), rng.random(3), 1.5
    half = ann._slots(width)
    got = ann.visited(at, width, begin, 0.6, 0.8, 40)
    own = ann.bucket_of(at, width, begin)
    for row in range(6):
        chances = {}
        for slots in np.ndindex(*[2 * half + 1] * 3):
            p, key = 0.0, 0
            for k, s in enumerate(slots):
                lo = -np.inf if s == 0 else (s - half - begin[k]) * width
                hi = np.inf if s == 2 * half else (s - half + 1 - begin[k]) * width
                p += np.log(max(1e-300, float(ann._below(np.array((hi - 0.6 * at[row, k]) / 0.8)) - ann._below(np.array((lo - 0.6 * at[row, k]) / 0.8)))))
                key = key * (2 * half + 1) + s
            chances[key] = p
        order = [own[row], *[k for k in sorted(chances, key=lambda k: -chances[k]) if k != own[row]]]
        assert np.allclose([chances[k] for k in got[row]], [chances[k] for k in order[:40]]) and got[row, 0] == own[row]


def test_fit_scans_little_where_neighbours_are_near():
    """Near copies in 64 dimensions: a few visits find them, and a query's own share of the rows is small."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((400, 64))
    x = centres[rng.integers(0, 400, 8000)] + 0.1 * rng.standard_normal((8000, 64))
    q = x[:64]
    long = float(np.linalg.norm(x, axis=1).max())
    near = np.argsort(-(q @ x.T), axis=1)[:, 1:21]
    index = ann.fit(x[:4000], q, x[near.ravel()], np.repeat(np.arange(64), 20), 10**7, 10**5, long)
    at, begin = ann.places(ann.asked(q), 64, 0, index.directions, index.scale), ann._random(64, 0, index.directions)[1]
    visit = ann.visited(at, index.width, begin, index.slope, index.spread, index.visits)
    keys = ann.bucket_of(ann.places(ann.lifted(x, long), 64, 0, index.directions, index.scale), index.width, begin)
    assert np.mean([np.isin(keys, v).mean() for v in visit]) * index.tables < 0.35
