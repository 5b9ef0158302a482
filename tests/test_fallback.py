"""Forecast with missing inputs, native factor and registry checks, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import fallback as K
from tickloom.operators import forecast as R
from tickloom.operators import impute as I


def test_cholesky_and_definiteness(spark):
    rng = np.random.default_rng(1)
    good = [(lambda a: (a @ a.T + 0.1 * np.eye(n)).tolist())(rng.standard_normal((n, n))) for n in (1, 2, 5, 12)]
    bad = [[[1.0, 2.0], [2.0, 1.0]], [[0.0]], [[1.0, 0.0], [0.0, 0.0]], [[1.0, 0.5]], [[1.0, None], [0.5, 1.0]], [[float("nan")]], [[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]], None]
    df = spark.createDataFrame(list(enumerate(good + bad)), "k int, m array<array<double>>")
    got = {r.k: (r.l, r.ok) for r in df.select("k", F.when(F.col("k") < 4, R.cholesky(F.col("m"))).alias("l"), R.positive_definite(F.col("m")).alias("ok")).collect()}
    for k, m in enumerate(good):
        want = np.linalg.cholesky(np.array(m))
        assert got[k][1] and all(np.allclose(row, want[i, : i + 1]) for i, row in enumerate(got[k][0]))
    assert not any(got[k][1] for k in range(4, len(good + bad)))


def largest(mask, links):
    left, most = {i for i in range(11) if mask >> i & 1}, 0
    while left:
        part, queue = set(), [left.pop()]
        while queue:
            i = queue.pop()
            part.add(i)
            for a, b, _ in links:
                for x, y in ((a, b), (b, a)):
                    if x == i and y in left:
                        left.discard(y)
                        queue.append(y)
        most = max(most, len(part))
    return most


def test_set_tables_are_the_closure(spark):
    random.seed(2)
    graphs = {g: [(a, b, random.uniform(0.6, 1)) for a in range(11) for b in range(a) if random.random() < p] for g, p in (("thin", 0.12), ("thick", 0.5))}
    df = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "graph_id string, a int, b int, weight double")
    got = {r.graph_id: r for r in K.set_tables(df).collect()}
    for g, es in graphs.items():
        total = sum(w for *_, w in es)
        for mask in random.sample(range(2048), 300) + [0, 2047]:
            assert got[g].cluster[mask] == largest(mask, es)
            assert got[g].share[mask] == pytest.approx(sum(w for a, b, w in es if mask >> a & 1 and mask >> b & 1) / total)


def test_imputed_forecast_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    n = len(R.RAW_30)
    versions, links, models = {}, {}, {}
    for v in ("jan", "feb"):
        a = rng.standard_normal((n, 2 * n))
        cov = np.corrcoef(a + 0.8 * rng.standard_normal((1, 2 * n)))
        versions[v] = (rng.normal(0, 0.01, n), rng.uniform(0.5, 1, n), cov)
        links[v] = [(i, j, float(rng.uniform(0.6, 1))) for i in range(11) for j in range(i) if rng.random() < 0.3]
        for h in (30, 60):
            models[v, h] = (rng.normal(0, 0.1, 35), rng.uniform(0.5, 2, 35), rng.normal(0, 0.3, 36))
    draws = rng.standard_normal((32, 4))
    draws = np.concatenate([draws, -draws])
    rows = []
    for k in range(60):
        x = [float(t) for t in rng.standard_normal(n) * 0.7]
        gaps = [[], [4, 5], [8, 9, 20, 21], [28], [0], [4, 6, 8], [4, 5, 28, 29], [27], [5, 6]][k % 9]
        for i in gaps:
            x[i] = None if k % 2 else float("nan")
        rows.append((str(k), ("jan", "feb")[k % 2], x))
    rows.append(("far", "jan", [None if i == 4 else 50.0 for i in range(n)]))
    df = lambda data, schema: spark.createDataFrame(data, schema)
    order = list(R.FEATURES_35)
    got = K.imputed_forecast(
        df(rows, "row_id string, version_id string, x array<double>"),
        df([(v, v, m.tolist(), s.tolist(), c.tolist()) for v, (m, s, c) in versions.items()], "version_id string, graph_id string, mean array<double>, scale array<double>, cov array<array<double>>"),
        K.set_tables(df([(v, *e) for v, es in links.items() for e in es], "graph_id string, a int, b int, weight double")),
        df([(i, d.tolist()) for i, d in enumerate(draws)], "draw_id int, z array<double>"),
        K.linear(df([(v, h, order, m.tolist(), s.tolist(), b.tolist()) for (v, h), (m, s, b) in models.items()], "version_id string, horizon int, feature_order array<string>, mean array<double>, scale array<double>, beta array<double>")),
    ).collect()
    got = {(r.row_id, r.horizon): r for r in got}
    assert len(got) == 2 * len(rows)
    places = {f: i for i, f in enumerate((*R.RAW_30, *K.GRAPH_5))}
    reasons = set()
    for k, v, x in rows:
        m, s, c = versions[v]
        gaps = [i for i, t in enumerate(x) if t is None or math.isnan(t)]
        nodes = {(i - 4) // 2 for i in gaps}
        reason = "observed" if not gaps else "core input" if gaps[0] < 4 else "too many nodes" if len(nodes) > 2 else "too many features" if len(gaps) > 4 else None
        if reason is None:
            o = [i for i in range(n) if i not in gaps]
            z = np.array([(x[i] - m[i]) / s[i] for i in o])
            w = np.linalg.solve(c[np.ix_(o, o)] + 1e-8 * np.eye(len(o)), c[np.ix_(o, gaps)]).T
            mean, cond = w @ z, c[np.ix_(gaps, gaps)] - w @ c[np.ix_(o, gaps)]
            reason = "observed beyond guard" if abs(z).max() > 6 else "estimate beyond guard" if abs(mean).max() > 6 else None
        reasons.add(reason)
        for h in (30, 60):
            r = got[k, h]
            assert r.reason == reason
            if reason:
                assert r.p_up is None and r.direction is None
                continue
            low = np.linalg.cholesky((cond + cond.T) / 2)
            p = []
            for d in [np.zeros(4), *draws]:
                full = list(x)
                for i, value in zip(gaps, mean + low @ d[: len(gaps)], strict=True):
                    full[i] = m[i] + s[i] * value
                signs = [1 if full[4 + 2 * q] > 0 and full[5 + 2 * q] > 0 else -1 if full[4 + 2 * q] < 0 and full[5 + 2 * q] < 0 else 0 for q in range(11)]
                masks = [sum(1 << q for q in range(11) if signs[q] == g) for g in (1, -1)]
                share = [sum(e for a, b, e in links[v] if q >> a & 1 and q >> b & 1) / sum(e for *_, e in links[v]) for q in masks]
                full += [sum(signs) / 11, *[largest(q, links[v]) / 11 for q in masks], *share]
                mm, ss, bb = models[v, h]
                p.append(1 / (1 + math.exp(-(bb[0] + sum(bb[i + 1] * (full[places[f]] - mm[i]) / ss[i] for i, f in enumerate(order))))))
            want = (p[0], *np.quantile(p[1:], [0.1, 0.9]))
            assert (r.p_up, r.low, r.high) == pytest.approx(want, abs=1e-9)
            way = ["bullish" if q > 0.55 else "bearish" if q < 0.45 else "neutral" for q in want]
            assert r.direction == way[0] and r.stable == (len(set(way)) == 1)
    assert reasons == {None, "observed", "core input", "too many nodes", "observed beyond guard"}


def test_rows_go_through_their_own_graph(spark):
    """Two graphs: the same values, in one of which the two rising nodes are linked."""
    rows = [(k, g, s, 1.0 if i < 2 else -1.0, 1.0 if i < 2 else 0.0) for k, g in ((1, "a"), (2, "b")) for i, s in enumerate(("XLK", "XLF", "XLY"))]
    df = spark.createDataFrame(rows, "k int, graph_id string, symbol string, return_5 double, vwap_gap double")
    links = spark.createDataFrame([("a", "XLK", "XLF", 0.8), ("a", "XLF", "XLY", 0.6), ("b", "XLF", "XLY", 0.6)], "graph_id string, a string, b string, weight double")
    got = {r.k: (round(r.bullish_cluster_fraction * 11), round(r.bullish_edge_fraction, 6)) for r in I.rebuilt(df, links, ["k"]).collect()}
    assert got == {1: (2, round(0.8 / 1.4, 6)), 2: (1, 0.0)}
    with pytest.raises(ValueError):
        I.rebuilt(df.drop("graph_id"), links, ["k"])


def test_bands_are_those_of_the_draws_and_one_pattern_is_no_one_task(spark):
    rows = [(str(k), "v", [0.1 * (k % 7), None if k % 3 else 0.2, None if k % 2 else 0.3]) for k in range(60)]
    versions = spark.createDataFrame([("v", [0.0] * 3, [1.0] * 3, [[1.0, 0.6, 0.2], [0.6, 1.0, 0.1], [0.2, 0.1, 1.0]])], "version_id string, mean array<double>, scale array<double>, cov array<array<double>>")
    draws = spark.createDataFrame([(i, [math.sin(i), math.cos(i), 0.0, 0.0]) for i in range(8)], "draw_id int, z array<double>")
    got = I.conditioned(spark.createDataFrame(rows, "row_id string, version_id string, x array<double>"), versions)
    # half of all rows may share a pattern, so its weights go to them
    assert "SortMergeJoin LeftOuter" not in got._jdf.queryExecution().toString() and "LeftOuter, BuildRight" in got._jdf.queryExecution().toString()
    p = I.drawn(got, draws).select("row_id", (1 / (1 + F.exp(-F.aggregate("values", F.lit(-0.2), lambda a, v: a + 0.4 * v)))).alias("p"))
    show = lambda df: sorted((r.row_id, round(r.low, 9), round(r.high, 9)) for r in df.collect())
    assert show(I.drawn_band(got, draws, -0.2, 0.4)) == show(I.band(p, "row_id"))


def test_matrix_report_looks_at_each_matrix_where_it_lies(spark):
    rows = [("ok", [[2.0, 1.0], [1.0, 2.0]]), ("skew", [[2.0, 1.0], [0.0, 2.0]]), ("zero", [[0.0, 0.0], [0.0, 1.0]]), ("long", [[1.0, 0.0]]), ("gap", [[1.0, None], [None, 1.0]]), ("none", [])]
    got = R.matrix_report(spark.createDataFrame(rows, "version_id string, m array<array<double>>"))
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {"ok": (True, True, True, True), "skew": (True, False, True, True), "zero": (True, True, False, False), "long": (False, False, True, False), "gap": (True, False, True, False)}


def test_draws_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(R, "DEALT_DRAWS", 50)
    b = spark.range(10).selectExpr("id bundle_id", "explode(sequence(0, 63)) draw_id").selectExpr("bundle_id", "draw_id", "array(1d, 2d, 3d, 4d * if(draw_id < 32, 1, -1)) z")
    b = b.withColumn("z", F.when(F.col("draw_id") < 32, F.col("z")).otherwise(F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0), F.lit(-4.0))))
    got = R.draw_report(b)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    assert {tuple(r)[1:] for r in got.collect()} == {(True, True)}
