"""Registry-driven logistic scoring: feature vectors, model choice by date, contributions, and the checks of a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid, sign_label
from ..functions.shared import dealt
from .bars import returns, strict_vwap, volatility
from .network import NODES, SECTORS

#: Feature orders.
FEATURES_10 = ("spx_return_5", "spx_return_15", "spx_return_volatility_30", "spy_vwap_gap", "sector_signed_breadth", "bullish_cluster_fraction", "bearish_cluster_fraction", "bullish_growth_5", "bearish_growth_5", "mean_correlation")
FEATURES_31 = (*FEATURES_10[:5], *(f"{s}_{k}" for s in SECTORS for k in ("return_5", "vwap_gap")), "bullish_cluster_fraction", "bearish_cluster_fraction", "bullish_edge_weight_fraction", "bearish_edge_weight_fraction")
FEATURES_35 = (*FEATURES_31, "USO_return_5", "USO_vwap_gap", "TNX_change_5_bps", "TNX_change_from_open_bps")
FEATURES_39 = (*FEATURES_35, "USO_sector_alignment", "USO_sector_propagated_pressure", "TNX_sector_alignment", "TNX_sector_propagated_pressure")
RAW_30 = tuple(f for f in FEATURES_35 if f not in ("sector_signed_breadth", "bullish_cluster_fraction", "bearish_cluster_fraction", "bullish_edge_weight_fraction", "bearish_edge_weight_fraction"))
HORIZONS = (30, 60)
WARM = 635


def feature_vector(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, feature, value) to a map, one row for each key; a feature given twice makes the map null."""
    rows = long.groupBy(*keys).agg(F.collect_list(F.struct("feature", "value")).alias("_e"))
    names = F.filter(F.array_distinct(F.transform("_e", lambda x: x["feature"])), lambda f: f.isNotNull())
    return rows.select(*keys, F.when(F.size(names) == F.size("_e"), F.map_from_entries("_e")).alias("features"))


def ordered(features: Column, order: Column) -> Column:
    """Values in the registry's order; null unless all are there and finite."""
    values = F.transform(order, lambda f: F.try_element_at(features, f))
    return F.when(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), values)


def usable_models(registry: DataFrame, least_rows: int = 350, least_days: int = 80) -> DataFrame:
    """Converged, enough rows and days, trained strictly before they are valid, deviations positive."""
    ok = F.col("converged") & (F.col("training_rows") >= least_rows) & (F.col("training_days") >= least_days) & (F.col("train_end") < F.col("valid_from")) & F.forall("scale", lambda s: s > 0) & (F.size("beta") == F.size("mean") + 1) & (F.size("mean") == F.size("feature_order")) & (F.size("scale") == F.size("mean"))
    return registry.where(F.coalesce(ok, F.lit(False)))


def valid_on(rows: DataFrame, models: DataFrame, date: str = "session_date", days: DataFrame | None = None) -> DataFrame:
    """rows x the model of each horizon that is valid on the date; a date with two of a horizon gets none.

    The interval join is made on the distinct dates, by month; the rows then meet one small row for each date and horizon.
    days, with all dates of rows or more, spares their computation from the rows, which would then be made twice.
    """
    m = models.withColumn("_month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc("valid_to", "month"), F.expr("interval 1 month"))))
    days = (rows if days is None else days).select(date).distinct().withColumn("_month", F.trunc(date, "month"))
    valid = days.join(m, "_month").where(F.col(date).between(F.col("valid_from"), F.col("valid_to")))
    values = [c for c in models.columns if c != "horizon"]
    single = valid.groupBy(date, "horizon").agg(F.count("*").alias("_n"), F.first(F.struct(*values)).alias("_m")).where("_n = 1")
    return rows.join(single.select(date, "horizon", "_m.*"), date)


def scored(rows: DataFrame) -> DataFrame:
    """rows with features, feature_order, mean, scale and beta: log_odds, p_up, direction and contributions by absolute log-odds."""
    values = rows.withColumn("_v", ordered(F.col("features"), F.col("feature_order")))
    parts = F.transform(F.arrays_zip(F.col("feature_order").alias("f"), F.col("_v").alias("v"), F.col("mean").alias("m"), F.col("scale").alias("s"), F.slice("beta", 2, F.size("beta") - 1).alias("b")), lambda x: F.struct(x["f"].alias("feature"), (x["b"] * (x["v"] - x["m"]) / x["s"]).alias("log_odds")))
    values = values.withColumn("_p", F.when(F.col("_v").isNotNull(), parts))
    total = F.aggregate("_p", F.element_at("beta", 1), lambda a, x: a + x["log_odds"])
    values = values.withColumn("log_odds", total).withColumn("p_up", sigmoid(F.col("log_odds")))
    order = F.transform(F.array_sort(F.transform("_p", lambda x: F.struct((-F.abs(x["log_odds"])).alias("k"), x["feature"].alias("feature"), x["log_odds"].alias("log_odds")))), lambda x: F.struct(x["feature"].alias("feature"), x["log_odds"].alias("log_odds")))
    return values.withColumns({"p_down": 1 - F.col("p_up"), "direction": sign_label(F.col("p_up")), "contributions": order}).drop("_v", "_p")


def node_contributions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Log-odds by node: the two features of each sector or macro symbol added up; interaction features belong to no node."""
    e = rows.select(*keys, F.explode("contributions").alias("c")).select(*keys, F.regexp_extract("c.feature", r"^([A-Z]{3,4})_(?:return_5|vwap_gap|change_5_bps|change_from_open_bps)$", 1).alias("node"), "c.log_odds")
    return e.where("node <> ''").groupBy(*keys, "node").agg(F.sum("log_odds").alias("log_odds"))


def interaction_scores(vectors: DataFrame, models: DataFrame, fresh: Column, close: Column, date: str = "session_date", days: DataFrame | None = None) -> DataFrame:
    """vectors (keys, date, minute, features) with the interaction model of each horizon that is valid on the date, and the additive one to compare with.

    Adds horizon, log_odds, p_up, direction, contributions, interaction_log_odds (what the interaction features add), additive_p_up, and reason: why there is no
    forecast (then all of these are null), in the order stale, incomplete, beyond the close, no additive model. A date without an interaction model has no row.
    """
    of = lambda family: models.where(F.col("family") == family).drop("family", "model_id")
    fit = ["feature_order", "mean", "scale", "beta", "valid_from", "valid_to", "train_end", "training_rows", "training_days", "converged"]
    rows = scored(valid_on(vectors.withColumn("_fresh", fresh), of("interaction"), date, days)).drop(*fit)
    pairs = F.filter("contributions", lambda x: x["feature"].isin(*FEATURES_39[35:]))
    rows = rows.withColumn("interaction_log_odds", F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["log_odds"]))
    kept = F.struct("log_odds", "p_up", "direction", "contributions", "interaction_log_odds")
    rows = rows.withColumns({"_full": kept, "_horizon": F.col("horizon")}).drop("log_odds", "p_up", "p_down", "direction", "contributions", "interaction_log_odds", "horizon")
    # the additive fits are few rows for each date: one map by horizon, so that a row without any stays
    few = [c for c in fit if c in ("feature_order", "mean", "scale", "beta")]
    dates = (vectors if days is None else days).select(date).distinct()
    additive = valid_on(dates, of("additive"), date).groupBy(date).agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.struct(*few)))).alias("_fits"))
    rows = rows.join(additive, date, "left").withColumn("_fit", F.try_element_at("_fits", F.col("_horizon"))).select("*", *[F.col(f"_fit.{c}").alias(c) for c in few])
    rows = scored(rows).withColumnsRenamed({"p_up": "additive_p_up"})
    reason = F.coalesce(F.when(~F.coalesce(F.col("_fresh"), F.lit(False)), "stale"), F.when(F.col("_full.log_odds").isNull(), "incomplete"), F.when(F.col("minute") + 1 + F.col("_horizon") > close, "beyond the close"), F.when(F.col("additive_p_up").isNull(), "no additive model"))
    rows = rows.withColumn("reason", reason)
    live = lambda c, name: F.when(F.col("reason").isNull(), F.col(c)).alias(name)
    return rows.select(*vectors.columns, F.col("_horizon").alias("horizon"), "reason", *[live(f"_full.{c}", c) for c in ("log_odds", "p_up", "direction", "contributions", "interaction_log_odds")], live("additive_p_up", "additive_p_up"))


def horizon_gate(minute: Column, horizon: Column, close: Column) -> Column:
    """First reason against a forecast, in the fixed order; null if there is none."""
    return F.coalesce(F.when(minute < WARM, "warming"), F.when(minute + 1 + horizon > close, "beyond the close"))


def chosen_view(interaction: Column, additive: Column, fallback: Column) -> Column:
    """The interaction estimate, else the additive, else the one for missing inputs, with its name."""
    pick = lambda c, n: F.when(c.isNotNull(), F.struct(F.lit(n).alias("model"), c.alias("p_up")))
    return F.coalesce(pick(interaction, "interaction"), pick(additive, "additive"), pick(fallback, "missing-input"))


def chosen_bundle(verified: Column, fresh: Column, missing: Column, interactions: Column, base: Column) -> Column:
    """Which installed bundle scores, and why none does: the one for missing inputs, else the one with interactions, else the base; held while the calendar is not verified or inputs are not fresh. All inputs are conditions; null is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    pick = lambda bundle, reason: F.struct(F.lit(bundle).cast("string").alias("bundle"), F.lit(reason).cast("string").alias("reason"))
    some = yes(missing) | yes(interactions) | yes(base)
    return F.when(~yes(verified), pick(None, "calendar")).when(~yes(fresh) & some, pick(None, "inputs not fresh")).when(yes(missing), pick("missing", None)).when(yes(interactions), pick("interactions", None)).when(yes(base), pick("base", None)).otherwise(pick(None, "no bundle"))


def view_source(show_interaction: Column, additive_status: Column) -> Column:
    """Model that is shown: interaction if asked for, the additive one while it is available or warming, else the one for missing inputs."""
    return F.when(show_interaction, "interaction").when(additive_status.isin("available", "warming"), "additive").otherwise("missing-input")


def view_reason(hold: Column, minute: Column, horizon: Column, close: Column, fallback_error: Column, own: Column) -> Column:
    """Reason that is shown for a horizon: a hold, then a horizon beyond the close, then an error of the fallback, then the model's own; null if there is none."""
    return F.coalesce(hold, F.when(minute + 1 + horizon > close, "beyond the close"), fallback_error, own)


def registry_report(registry: DataFrame) -> DataFrame:
    """One row for each model and rule: whether it holds."""
    c = F.col
    rules = {
        "month window": F.trunc("valid_from", "month") == F.trunc("valid_to", "month"),
        "prior training": c("train_end") < c("valid_from"),
        "enough rows": c("training_rows") >= 350,
        "enough days": c("training_days") >= 80,
        "converged": c("converged"),
        "sizes": (F.size("mean") == F.size("feature_order")) & (F.size("scale") == F.size("mean")) & (F.size("beta") == F.size("mean") + 1),
        "positive scale": F.forall("scale", lambda s: s > 0),
        "distinct features": F.size(F.array_distinct("feature_order")) == F.size("feature_order"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("holds")) for k, v in rules.items()])
    return registry.select("model_id", F.explode(entries).alias("r")).select("model_id", "r.rule", "r.holds")


def matrix_report(matrices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(version_id, m array of arrays): square, symmetric, with a positive diagonal, each entry held against its mirror; and positive definite, by its factor. A matrix is looked at where it lies; those without an entry are left out."""
    m = F.col("m")
    square = F.forall(m, lambda r: F.coalesce(F.size(r) == F.size(m), F.lit(False)))
    symmetric = F.forall(F.transform(m, lambda r, i: F.forall(F.transform(r, lambda x, j: F.coalesce(F.abs(x - F.get(F.get(m, j), i)) <= tolerance, F.lit(False))), lambda v: v)), lambda v: F.coalesce(v, F.lit(True)))
    known = F.filter(F.flatten(F.transform(m, lambda r, i: F.transform(F.coalesce(r, F.array().cast("array<double>")), lambda x, j: (i != j) | (x > 0)))), lambda v: v.isNotNull())
    positive = F.when(F.size(known) > 0, F.forall(known, lambda v: v))
    return matrices.where(F.exists("m", lambda r: F.size(r) > 0)).select("version_id", square.alias("square"), symmetric.alias("symmetric"), positive.alias("positive_diagonal"), positive_definite(m).alias("positive_definite"))


def cholesky(m: Column) -> Column:
    """Lower factor of a square array of arrays; from a pivot that isn't positive on, its entries are null. A fold over rows and, within, over columns."""

    def row(done: Column, i: Column) -> Column:
        def entry(own: Column, j: Column) -> Column:
            other = F.when(j == i, own).otherwise(F.get(done, j))
            rest = F.aggregate(F.zip_with(own, F.slice(other, 1, F.size(own)), lambda a, b: a * b), F.get(F.get(m, i), j), lambda a, x: a - x)
            return F.concat(own, F.array(F.when(j < i, rest / F.get(F.get(done, j), j)).when(rest > 0, F.sqrt(rest))))

        return F.concat(done, F.array(F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), entry)))

    steps = F.filter(F.transform(m, lambda r, i: i), lambda i: i >= 0)
    return F.aggregate(steps, F.array().cast("array<array<double>>"), row)


def positive_definite(m: Column) -> Column:
    """Whether every pivot of the factor is there; false where rows are not as long as there are rows, or hold null or NaN."""
    sound = F.forall(m, lambda r: (F.size(r) == F.size(m)) & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.when(F.coalesce(sound, F.lit(False)), F.forall(cholesky(m), lambda r: F.element_at(r, -1).isNotNull())).otherwise(F.lit(False))


#: Links that a saved graph may hold, and how closely its matrix and its list must agree.
LEAST_WEIGHT, MOST_LINKS, AGREE = 0.6, 55, 1e-12


def graph_report(graphs: DataFrame) -> DataFrame:
    """graphs (version_id, nodes, adjacency, edges of (source, target, weight), weight_sum) to (version_id, rule, holds).

    Edges join two different nodes of the list, each pair once, with a weight from 0.6 to 1; the matrix has the edges' weights on either side
    of its diagonal and zero elsewhere, so neither holds a link that the other lacks; the sum is that of the edges.
    """
    n = "size(nodes)"
    place = "transform(edges, e -> named_struct('a', array_position(nodes, e.source), 'b', array_position(nodes, e.target), 'w', e.weight))"
    g = graphs.withColumn("_e", F.expr(place))
    pairs = "transform(_e, e -> named_struct('a', least(e.a, e.b), 'b', greatest(e.a, e.b)))"
    stated = f"transform(sequence(1, {n}), i -> transform(sequence(1, {n}), j -> coalesce(get(filter(_e, e -> i <> j and least(e.a, e.b) = least(i, j) and greatest(e.a, e.b) = greatest(i, j)), 0).w, 0d)))"
    g = g.withColumn("_s", F.expr(stated))
    whole = f"size(adjacency) = {n} and forall(adjacency, r -> size(r) = {n} and forall(r, v -> v is not null and not isnan(v)))"
    rules = {
        "square": whole,
        "known ends": "forall(_e, e -> e.a > 0 and e.b > 0 and e.a <> e.b)",
        "distinct links": f"size(edges) <= {MOST_LINKS} and size(array_distinct({pairs})) = size(edges)",
        "weights": f"forall(edges, e -> e.weight between {LEAST_WEIGHT} and 1)",
        "edges in matrix": f"({whole}) and forall(sequence(0, {n} - 1), i -> forall(sequence(0, {n} - 1), j -> _s[i][j] = 0 or abs(get(get(adjacency, i), j) - _s[i][j]) <= {AGREE}))",
        "matrix in edges": f"({whole}) and forall(sequence(0, {n} - 1), i -> forall(sequence(0, {n} - 1), j -> _s[i][j] <> 0 or abs(get(get(adjacency, i), j)) <= {AGREE}))",
        "weight sum": "abs(aggregate(edges, 0d, (a, e) -> a + e.weight) - weight_sum) <= 1e-10",
    }
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.expr(v), F.lit(False)).alias("holds")) for k, v in rules.items()])
    return g.select("version_id", F.explode(entries).alias("r")).select("version_id", "r.rule", "r.holds")


#: Draws that a task of their join sorts.
DEALT_DRAWS = 500_000


def draw_report(draws: DataFrame, wanted: int = 64, width: int = 4) -> DataFrame:
    """draws (bundle_id, draw_id from 0, z) to (bundle_id, whole, antithetic): as many as wanted, each of width finite numbers; the second half is the first with its signs turned. Draws meet their partners by a join."""
    half = wanted // 2
    a = draws.withColumn("fine", F.coalesce((F.size("z") == width) & F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))
    partner = draws.select("bundle_id", (F.col("draw_id") - half).alias("draw_id"), F.col("z").alias("other"))
    at = ["bundle_id", "draw_id"]
    j = dealt(a, *at, rows=DEALT_DRAWS).join(dealt(partner, *at, rows=DEALT_DRAWS), at, "left")
    turned = (F.col("draw_id") >= half) | F.coalesce(F.forall(F.zip_with("z", "other", lambda x, y: x == -y), lambda v: v), F.lit(False))
    return j.groupBy("bundle_id").agg(((F.count("*") == wanted) & (F.count_distinct("draw_id") == wanted) & F.bool_and(F.col("draw_id").between(0, wanted - 1)) & F.bool_and("fine")).alias("whole"), F.bool_and(turned).alias("antithetic"))


# Feature vectors: long tables (keys, feature, value)


def core_features(spx: DataFrame, spy: DataFrame) -> DataFrame:
    """(session_date, minute, spx_return_5, spx_return_15, spx_return_volatility_30, spy_vwap_gap) from bars of the two symbols; null where an exact minute is missing."""
    a = volatility(returns(spx, (5, 15))).select("session_date", "minute", F.col("return_5").alias("spx_return_5"), F.col("return_15").alias("spx_return_15"), F.col("volatility").alias("spx_return_volatility_30"))
    b = strict_vwap(spy).select("session_date", "minute", (F.col("close") / F.col("strict_vwap") - 1).alias("spy_vwap_gap"))
    return a.join(b, ["session_date", "minute"])


def long_form(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return wide.select(*keys, pieces.alias("x")).select(*keys, "x.feature", "x.value")


def features_10(core: DataFrame, network: DataFrame) -> DataFrame:
    """The ten network features by minute, from core_features and the network's summary."""
    keys = ["session_date", "minute"]
    net = network.select(*keys, F.col("breadth").alias("sector_signed_breadth"), F.col("bullish_fraction").alias("bullish_cluster_fraction"), F.col("bearish_fraction").alias("bearish_cluster_fraction"), "bullish_growth_5", "bearish_growth_5", "mean_correlation")
    return long_form(core.join(net, keys), keys, list(FEATURES_10))


def features_35(core: DataFrame, sectors: DataFrame, clusters: DataFrame, edges: DataFrame, oil: DataFrame, rates: DataFrame) -> DataFrame:
    """The sector and macro features by minute. sectors: (keys, symbol, return_5, vwap_gap, sign); clusters: (keys, sign, size); edges: (keys, bullish_edge_fraction, bearish_edge_fraction);
    oil: (keys, return_5, vwap_gap); rates: (keys, change_5_bps, change_open_bps). Only fractions over eleven nodes are used."""
    keys = ["session_date", "minute"]
    size = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("size"))), F.lit(0)) / NODES
    one = sectors.groupBy(*keys).agg((F.sum("sign") / NODES).alias("sector_signed_breadth"))
    k = clusters.groupBy(*keys).agg(size(1).alias("bullish_cluster_fraction"), size(-1).alias("bearish_cluster_fraction"))
    wide = core.join(one, keys).join(k, keys, "left").na.fill({"bullish_cluster_fraction": 0.0, "bearish_cluster_fraction": 0.0})
    wide = wide.join(edges.withColumnsRenamed({"bullish_edge_fraction": "bullish_edge_weight_fraction", "bearish_edge_fraction": "bearish_edge_weight_fraction"}), keys)
    wide = wide.join(oil.select(*keys, F.col("return_5").alias("USO_return_5"), F.col("vwap_gap").alias("USO_vwap_gap")), keys).join(rates.select(*keys, F.col("change_5_bps").alias("TNX_change_5_bps"), F.col("change_open_bps").alias("TNX_change_from_open_bps")), keys)
    names = [c for c in FEATURES_35 if not c.startswith(SECTORS)]
    each = long_form(sectors, [*keys, "symbol"], ["return_5", "vwap_gap"]).select(*keys, F.concat_ws("_", "symbol", "feature").alias("feature"), "value")
    return long_form(wide, keys, names).unionByName(each)


def features_39(base: DataFrame, pressures: DataFrame) -> DataFrame:
    """Adds the interaction features; pressures: (keys, macro, alignment, pressure), macro named USO or TNX."""
    keys = ["session_date", "minute"]
    more = long_form(pressures.withColumnsRenamed({"alignment": "sector_alignment", "pressure": "sector_propagated_pressure"}), [*keys, "macro"], ["sector_alignment", "sector_propagated_pressure"])
    return base.unionByName(more.select(*keys, F.concat_ws("_", "macro", "feature").alias("feature"), "value"))
