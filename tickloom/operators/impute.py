"""Missing inputs: observation status, conditional-Gaussian estimates and sensitivity bands.

The linear algebra is done once for each distinct pattern of missing features, in numpy; every row then takes dot products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .network import NODES, components, edge_participation, largest_clusters, macro_sign

RIDGE = 1e-8
GUARD = 6.0
MOST_FEATURES, MOST_NODES, LEAST_SECTORS = 4, 2, 9
#: Saved draws are broadcast.
MOST_DRAWS = 1024
#: Patterns of missing features, about 1 KB each, that are broadcast. Few patterns hold all rows, so a shuffle by them would give a task each.
BROADCAST_PATTERNS = 1 << 15


def status(present: Column, off_grid: Column, duplicate: Column, valid: Column) -> Column:
    """observed, missing, or fatal when what is there is corrupt."""
    return F.when(F.coalesce(off_grid | duplicate, F.lit(False)), "fatal").when(~F.coalesce(present, F.lit(False)), "missing").when(F.coalesce(valid, F.lit(False)), "observed").otherwise("fatal")


def conditioned(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows (row_id, version_id, x array with nulls) and versions (version_id, mean, scale, cov): estimates of the missing values.

    (row_id, version_id, x, missing, estimates, variances, explained, factor, reason): in standard units of the version; arrays over the missing
    places in order. reason says why a row has none: too many missing, or beyond six deviations.
    """
    rows = rows.withColumn("x", F.transform("x", lambda v: F.when(~F.isnan(v), v)))  # NaN is a gap like null
    gaps = F.filter(F.transform("x", lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())
    # written, as patterns and estimates both read them; else every place of a row would be worked out anew inside the next expression
    rows = written(rows.withColumn("missing", gaps).select("row_id", "version_id", "x", "missing"))
    z = F.zip_with(F.zip_with("x", "mean", lambda x, m: x - m), "scale", lambda v, s: v / s)
    # covariances join the distinct patterns, so that no row carries one
    patterns = rows.where(F.size("missing").between(1, MOST_FEATURES)).select("version_id", "missing").distinct().join(versions.select("version_id", "cov"), "version_id")
    rows = rows.join(versions.select("version_id", "mean", "scale"), "version_id").withColumn("z", z)

    def solve(batches):
        for pdf in batches:
            out = []
            for version, gaps, cov in zip(pdf.version_id, pdf.missing, pdf["cov"], strict=True):
                s = np.array([np.asarray(r) for r in cov])
                m = np.asarray(gaps, int)
                o = np.setdiff1d(np.arange(len(s)), m)
                weights = np.linalg.solve(s[np.ix_(o, o)] + RIDGE * np.eye(len(o)), s[np.ix_(o, m)]).T
                left = s[np.ix_(m, m)] - weights @ s[np.ix_(o, m)]
                left = (left + left.T) / 2
                full = np.zeros((len(m), len(s)))
                full[:, o] = weights
                try:
                    factor = np.linalg.cholesky(left).tolist()
                except np.linalg.LinAlgError:
                    factor = None
                out.append((version, list(map(int, m)), full.tolist(), np.diag(left).tolist(), np.clip(1 - np.diag(left) / np.diag(s)[m], 0, 1).tolist(), factor))
            yield pd.DataFrame(out, columns=["version_id", "missing", "weights", "variances", "explained", "factor"])

    solved = written(patterns.mapInPandas(solve, "version_id string, missing array<int>, weights array<array<double>>, variances array<double>, explained array<double>, factor array<array<double>>"))
    j = rows.join(F.broadcast(solved) if solved.count() <= BROADCAST_PATTERNS else solved, ["version_id", "missing"], "left")
    known = F.transform("z", lambda v: F.coalesce(v, F.lit(0.0)))
    estimate = F.transform("weights", lambda w: F.aggregate(F.zip_with(w, known, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    j = j.withColumn("_e", estimate)
    reason = F.when(F.size("missing") > MOST_FEATURES, "too many missing").when(F.exists("z", lambda v: F.abs(v) > GUARD), "observed beyond guard").when(F.exists("_e", lambda v: F.abs(v) > GUARD), "estimate beyond guard")
    j = j.withColumn("reason", reason)
    good = F.col("reason").isNull() & (F.size("missing") > 0)
    return j.select("row_id", "version_id", "x", "missing", *[F.when(good, F.col(a)).alias(b) for a, b in (("_e", "estimates"), ("variances", "variances"), ("explained", "explained"), ("factor", "factor"))], "reason")


def drawn(estimates: DataFrame, draws: DataFrame) -> DataFrame:
    """Every estimate under every saved normal draw (draw_id, z array): (row_id, version_id, draw_id, missing, values). Over MOST_DRAWS draws are an error."""
    if draws.count() > MOST_DRAWS:
        raise ValueError(f"at most {MOST_DRAWS} draws")
    rows = estimates.where("estimates is not null and factor is not null").join(F.broadcast(draws), F.lit(True))
    moved = F.zip_with("estimates", F.transform("factor", lambda r: F.aggregate(F.zip_with(r, F.slice("z", 1, F.size(r)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)), lambda a, b: a + b)
    return rows.select("row_id", "version_id", "draw_id", "missing", moved.alias("values"))


def band(probabilities: DataFrame, *keys: str) -> DataFrame:
    """10 % and 90 % quantiles, linearly interpolated, of the draws' probabilities p."""
    return probabilities.groupBy(*keys).agg(F.percentile("p", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def saved_draws(draws: DataFrame) -> np.ndarray:
    """Saved normal draws (draw_id, z array) in their order, a row each. None, or over MOST_DRAWS, are an error."""
    saved = [r.z for r in draws.orderBy("draw_id").limit(MOST_DRAWS + 1).select("z").collect()]
    if not 0 < len(saved) <= MOST_DRAWS:
        raise ValueError(f"from 1 to {MOST_DRAWS} draws")
    return np.array(saved, float)


def by_pattern(pdf: pd.DataFrame, z: np.ndarray):
    """Rows of conditioned that have estimates, all those of one version and pattern at once: their places in pdf, the missing features and, in standard units, the estimate and all draws (rows, 1 + draws, features); draws are NaN without a factor."""
    live = pdf[pdf["estimates"].notna() & (pdf["missing"].str.len() > 0)]
    for (_, gaps), part in live.groupby([live["version_id"], live["missing"].map(tuple)]):
        e, factor = np.vstack(part["estimates"].to_list()).astype(float), part["factor"].iloc[0]
        moves = np.full((len(z), len(gaps)), np.nan) if factor is None else z[:, : len(gaps)] @ np.array([list(r) for r in factor], float).T
        yield pdf.index.get_indexer(part.index), np.array(gaps, int), e[:, None, :] + np.vstack([np.zeros((1, len(gaps))), moves])


def quantiles(p: np.ndarray, at: tuple[float, ...] = (0.1, 0.9)) -> list[np.ndarray]:
    """Quantiles along the second axis, linearly interpolated."""
    p = np.sort(p, axis=1)
    out = []
    for q in at:
        place = (p.shape[1] - 1) * q
        lo = int(place)
        out.append(p[:, lo] + (p[:, min(lo + 1, p.shape[1] - 1)] - p[:, lo]) * (place - lo))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    """Stable at either end."""
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def drawn_band(estimates: DataFrame, draws: DataFrame, const: float, weight: float) -> DataFrame:
    """(row_id, low, high): the 10 % and 90 % quantiles of the probabilities of const + weight times the sum of a row's values under every saved draw.

    As drawn and band, but a row's draws stay in its task: nothing is repeated or shuffled for each draw.
    """
    z = saved_draws(draws)

    def scored(batches):
        for pdf in batches:
            for at, _, values in by_pattern(pdf, z):
                low, high = quantiles(logistic(const + weight * values[:, 1:].sum(axis=2)))
                yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[at], "low": low, "high": high})

    rows = estimates.where("estimates is not null and factor is not null").select("row_id", "version_id", "missing", "estimates", "factor")
    return rows.mapInPandas(scored, "row_id string, low double, high double")


def availability(statuses: DataFrame, *keys: str) -> DataFrame:
    """statuses (keys, feature, node, core, status): whether estimates may be made, and the first reason against."""
    bad = lambda c: F.count_if(c) > 0
    nodes = F.count_distinct(F.when(F.col("status") == "missing", F.col("node")))
    whole = F.count_distinct(F.when(F.col("status") == "observed", F.col("node")))
    return statuses.groupBy(*keys).agg(F.coalesce(F.when(bad(F.col("status") == "fatal"), "fatal input"), F.when(bad(F.col("core") & (F.col("status") != "observed")), "core input"), F.when(nodes > MOST_NODES, "too many nodes"), F.when(F.count_if(F.col("status") == "missing") > MOST_FEATURES, "too many features"), F.when(whole < LEAST_SECTORS, "too few sectors")).alias("reason"))


def rebuilt(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Graph features of drawn or imputed values: rows (keys, symbol, return_5, vwap_gap and, where links hold several graphs, graph_id), links (graph_id, a, b, weight).

    (keys, sector_signed_breadth, bullish/bearish cluster and edge-weight fractions): the same steps as for live nodes, keyed by row and draw; each row goes through its own graph.
    """
    s = rows.withColumn("sign", macro_sign(F.col("return_5"), F.col("vwap_gap"))).withColumnRenamed("symbol", "node")
    if "graph_id" not in s.columns:
        graphs = links.select("graph_id").distinct()
        if graphs.count() > 1:
            raise ValueError("rows need a graph_id, as links are of several graphs")
        s = s.join(graphs, F.lit(True))  # one row
    edges = edge_participation(links, s.select(*keys, "graph_id", "node", "sign"), keys)
    live = s.where("sign <> 0")
    a, b = live.select(*keys, "graph_id", "sign", F.col("node").alias("a")), live.select(*keys, "sign", F.col("node").alias("b"))
    same = a.join(links.select("graph_id", "a", "b"), ["graph_id", "a"]).join(b, [*keys, "sign", "b"]).drop("graph_id")
    sizes = largest_clusters(components(live.select(*keys, "sign", "node"), same, [*keys, "sign"]), [*keys, "sign"])
    most = lambda v: F.coalesce(F.max(F.when(F.col("sign") == v, F.col("size"))), F.lit(0)) / NODES
    k = sizes.groupBy(*keys).agg(most(1).alias("bullish_cluster_fraction"), most(-1).alias("bearish_cluster_fraction"))
    out = s.groupBy(*keys).agg((F.sum("sign") / NODES).alias("sector_signed_breadth")).join(k, keys, "left").join(edges, keys, "left")
    return out.na.fill(0.0, ["bullish_cluster_fraction", "bearish_cluster_fraction", "bullish_edge_fraction", "bearish_edge_fraction"])
