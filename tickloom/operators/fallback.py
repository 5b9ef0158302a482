"""Forecast from inputs some of which are missing: estimates and saved draws go through the graph of their month and the fitted model, and give a probability with a band.

A graph of eleven nodes has 2048 sets of active nodes, so what it says of each set is tabled once; a draw takes its features by looking its sets up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sign_label
from ..functions.shared import written
from .forecast import FEATURES_35, RAW_30
from .impute import LEAST_SECTORS, MOST_FEATURES, MOST_NODES, by_pattern, conditioned, logistic, quantiles, saved_draws
from .network import NODES

#: Features in the order of the scored vector: raw ones, then the graph's.
GRAPH_5 = ("sector_signed_breadth", "bullish_cluster_fraction", "bearish_cluster_fraction", "bullish_edge_weight_fraction", "bearish_edge_weight_fraction")
CORE = 4
_ALL = f"sequence(0, {NODES - 1})"
#: Rows of a version that meet its graph and models at once; a larger version is dealt to several groups.
GROUP_ROWS = 8192
#: Members of each set of nodes.
BITS = np.array([bin(m).count("1") for m in range(1 << NODES)])


def set_tables(links: DataFrame) -> DataFrame:
    """links (graph_id, a, b: places of nodes, weight) to (graph_id, cluster, share): for each set of nodes, as a number whose bits are its members, its largest connected part, and the weight of the links within it over all weight."""
    g = links.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "weight"))).alias("e"))
    g = g.withColumn("near", F.expr(f"transform({_ALL}, i -> aggregate(e, 0, (m, x) -> m | case when x.a = i then shiftleft(1, cast(x.b as int)) when x.b = i then shiftleft(1, cast(x.a as int)) else 0 end))"))
    g = g.withColumn("total", F.expr("aggregate(e, 0d, (s, x) -> s + x.weight)")).withColumn("mask", F.explode(F.expr(f"sequence(0, {(1 << NODES) - 1})")))
    reach = f"aggregate(sequence(1, {NODES - 1}), shiftleft(1, i), (r, k) -> r | (aggregate({_ALL}, 0, (m, j) -> m | if(getbit(r, j) = 1, near[j], 0)) & mask))"
    cluster = f"coalesce(array_max(transform(filter({_ALL}, i -> getbit(mask, i) = 1), i -> bit_count({reach}))), 0)"
    share = "if(total = 0, 0d, aggregate(e, 0d, (s, x) -> s + if(getbit(mask, cast(x.a as int)) = 1 and getbit(mask, cast(x.b as int)) = 1, x.weight, 0d)) / total)"
    rows = g.select("graph_id", "mask", F.expr(cluster).alias("cluster"), F.expr(share).alias("share"))
    return rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("mask", "cluster", "share"))).alias("t")).select("graph_id", F.expr("transform(t, x -> x.cluster)").alias("cluster"), F.expr("transform(t, x -> x.share)").alias("share"))


def linear(models: DataFrame) -> DataFrame:
    """models (version_id, horizon, feature_order, mean, scale, beta) to (version_id, horizon, const, w): the score as one sum over raw features and the graph's, in their order."""
    slope = F.expr("map_from_arrays(feature_order, transform(scale, (s, i) -> beta[i + 1] / s))")
    const = F.expr("aggregate(transform(scale, (s, i) -> beta[i + 1] * mean[i] / s), beta[0], (a, x) -> a - x)")
    order = F.array(*[F.lit(f) for f in (*RAW_30, *GRAPH_5)])
    m = models.select("version_id", "horizon", const.alias("const"), slope.alias("_slope"), order.alias("_order"))
    return m.select("version_id", "horizon", "const", F.expr("transform(_order, f -> _slope[f])").alias("w"))


def _scores(rows: pd.DataFrame, fixed: pd.DataFrame, z: np.ndarray) -> pd.DataFrame:
    """Rows of one version, as conditioned gives them, under its graph and models: a row for each horizon. Rows without a reason have p_up, low and high."""
    names = ["row_id", "version_id", "horizon", "reason", "p_up", "low", "high"]
    if not len(rows) or not len(fixed):
        return pd.DataFrame([], columns=names)
    f = fixed.iloc[0]
    mean, scale, cluster, share = (np.array(f[c], float) for c in ("mean", "scale", "cluster", "share"))
    const, w, raw = np.array(f["const"], float), np.array([list(x) for x in f["w"]], float), len(RAW_30)
    x = np.vstack(rows["x"].to_list()).astype(float)
    out = np.full((3, len(rows), len(const)), np.nan)
    for at, gaps, values in by_pattern(rows, z):
        v, known = mean[gaps] + scale[gaps] * values, x[at]
        places = {int(i): r for r, i in enumerate(gaps)}
        up = down = np.zeros(v.shape[:2], int)
        for s in range(NODES):
            a, b = (v[:, :, places[i]] if i in places else known[:, [i]] for i in (CORE + 2 * s, CORE + 2 * s + 1))
            up, down = up | ((a > 0) & (b > 0)) << s, down | ((a < 0) & (b < 0)) << s
        graph = np.stack([(BITS[up] - BITS[down]) / NODES, cluster[up] / NODES, cluster[down] / NODES, share[up], share[down]], axis=2)
        base = const + np.nan_to_num(known) @ w[:, :raw].T
        p = logistic(base[:, None, :] + v @ w[:, gaps].T + graph @ w[:, raw:].T)
        out[0, at], (out[1, at], out[2, at]) = p[:, 0], quantiles(p[:, 1:])
    n = len(const)
    repeat = lambda c: rows[c].to_numpy().repeat(n)
    return pd.DataFrame({"row_id": repeat("row_id"), "version_id": repeat("version_id"), "horizon": np.tile(np.array(f["horizon"], int), len(rows)), "reason": repeat("reason"), "p_up": out[0].ravel(), "low": out[1].ravel(), "high": out[2].ravel()})


def held_reason(x: str = "x") -> Column:
    """Why values that are missing in a row of RAW_30 can't be estimated, or null; observed where none is."""
    missing = f"filter(transform({x}, (v, i) -> if(v is null or isnan(v), i, null)), i -> i is not null)"
    nodes = f"array_distinct(transform({missing}, i -> cast(floor((i - {CORE}) / 2) as int)))"
    return F.expr(f"case when size({missing}) = 0 then 'observed' when exists({missing}, i -> i < {CORE}) then 'core input' when size({nodes}) > {MOST_NODES} then 'too many nodes' when size({missing}) > {MOST_FEATURES} then 'too many features' when {NODES} - size(filter({nodes}, s -> s < {NODES})) < {LEAST_SECTORS} then 'too few sectors' end")


def imputed_forecast(rows: DataFrame, versions: DataFrame, tables: DataFrame, draws: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each row and horizon: (row_id, version_id, horizon, reason, p_up, low, high, direction, stable).

    rows: (row_id, version_id, x: RAW_30 with nulls); versions: (version_id, graph_id, mean, scale, cov); tables: set_tables; draws: (draw_id, z), the same for
    all; models: linear. low and high are the 10 % and 90 % quantiles of the draws' probabilities, stable says that both and the estimate have one direction.
    With a reason (held_reason, or why a row can't be conditioned) the rest is null. Rows of a version without a model are left out.
    """
    z = saved_draws(draws)
    rows = written(rows.withColumn("held", held_reason()))  # read three times
    counts = rows.groupBy("version_id").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("n"))
    parts = counts.select("version_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("part"))
    fit = conditioned(rows.where("held is null").select("row_id", "version_id", "x"), versions)
    fit = fit.join(F.broadcast(counts), "version_id").withColumn("part", F.pmod(F.xxhash64("row_id"), "n").cast("int")).select("row_id", "version_id", "part", "reason", "x", "missing", "estimates", "factor")
    each = models.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("horizon", "const", "w"))).alias("m"))
    fixed = versions.select("version_id", "graph_id", "mean", "scale").join(tables, "graph_id").join(each, "version_id")
    fixed = fixed.join(parts, "version_id").select("version_id", "part", "mean", "scale", "cluster", "share", "m.horizon", "m.const", "m.w")
    kind = rows.schema["row_id"].dataType.simpleString()
    j = fit.groupBy("version_id", "part").cogroup(fixed.groupBy("version_id", "part")).applyInPandas(lambda a, b: _scores(a, b, z), f"row_id {kind}, version_id string, horizon int, reason string, p_up double, low double, high double")
    held = rows.where("held is not null").join(models.select("version_id", "horizon"), "version_id").select("row_id", "version_id", "horizon", F.col("held").alias("reason"), *[F.lit(None).cast("double").alias(c) for c in ("p_up", "low", "high")])
    out = j.unionByName(held)
    ways = [sign_label(F.col(c)) for c in ("p_up", "low", "high")]
    return out.withColumns({"direction": ways[0], "stable": (ways[0] == ways[1]) & (ways[1] == ways[2])})


assert set(RAW_30) | set(GRAPH_5) == set(FEATURES_35)
