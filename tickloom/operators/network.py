"""Sector network: node states, rolling correlation, same-sign components, summary, growth and macro nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import OPEN, valid_bar
from .bars import P, by_minute, at_offset, single_minutes, strict_vwap

#: The eleven sector nodes in their order.
SECTORS = ("XLK", "XLF", "XLY", "XLP", "XLE", "XLU", "XLV", "XLI", "XLB", "XLRE", "XLC")
NODES = 11
#: Pairs of thirteen nodes.
MOST_EDGES = 78


def quarantine_off_grid(bars: DataFrame, status: str = "grid_status") -> DataFrame:
    """A row off the minute grid removes its whole minute; rows without a time are dropped."""
    bad = F.max((F.col(status) == "off").cast("int")).over(Window.partitionBy(*P, "minute"))
    return bars.where(F.col(status) != "none").withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def without_mixed_providers(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of (symbol, session) with one provider, and the report of those with several."""
    per = bars.groupBy(*P).agg(F.count_distinct("provider").alias("providers"))
    mixed = per.where("providers > 1")
    return bars.join(mixed, list(P), "left_anti"), mixed


def node_states(bars: DataFrame) -> DataFrame:
    """(P, minute, close, strict_vwap, return_1, return_5, vwap_gap, sign, complete_prefix): sign needs the five-minute change and the side of VWAP to agree."""
    rows = strict_vwap(bars)
    r5, gap = F.col("close") / at_offset("close", 5) - 1, F.col("close") / F.col("strict_vwap") - 1
    rows = rows.withColumns({"return_1": F.col("close") / at_offset("close", 1) - 1, "return_5": r5, "vwap_gap": gap})
    sign = F.when((F.col("return_5") > 0) & (F.col("vwap_gap") > 0), 1).when((F.col("return_5") < 0) & (F.col("vwap_gap") < 0), -1).otherwise(0)
    return rows.select(*P, "minute", "close", "strict_vwap", "return_1", "return_5", "vwap_gap", sign.alias("sign"), F.col("strict_vwap").isNotNull().alias("complete_prefix"))


def pair_correlations(states: DataFrame, n: int = 60) -> DataFrame:
    """Pearson of the last n aligned one-minute returns of each two symbols of a session: (session_date, minute, a, b, corr, sign_a, sign_b).

    A self-join on the minute of at most eleven rows a side; null unless all n minutes are there for both.
    """
    s = states.select("session_date", "minute", "symbol", "return_1", "sign")
    left, right = s.toDF("session_date", "minute", "a", "ra", "sign_a"), s.toDF("session_date", "minute", "b", "rb", "sign_b")
    pairs = left.join(right, ["session_date", "minute"]).where("a < b")
    w = Window.partitionBy("session_date", "a", "b").orderBy("minute").rangeBetween(-(n - 1), 0)
    both = F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).over(w) == n
    r = F.corr("ra", "rb").over(w)
    return pairs.withColumn("corr", F.when(both & ~F.isnan(r), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))).select("session_date", "minute", "a", "b", "corr", "sign_a", "sign_b")


def links(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs at or over least; the link's sign is the common sign of both, or 0."""
    return pairs.where(F.col("corr") >= least).withColumn("sign", F.when(F.col("sign_a") == F.col("sign_b"), F.col("sign_a")).otherwise(0))


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components of many small graphs at once, one for each value of keys. nodes: (keys, node); edges: (keys, a, b). Label: least node.

    A graph has at most a few dozen nodes, so it fits in one row: a fold over its edges gives both sides of each the lesser label.
    """
    n = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", F.col("node").alias("label"))).alias("_n"))
    e = edges.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("_e"))
    rows = n.join(e, keys, "left").withColumn("_e", F.coalesce("_e", F.array().cast(e.schema["_e"].dataType)))

    def joined(acc, x):
        pair = F.filter(acc, lambda v: (v["node"] == x["a"]) | (v["node"] == x["b"]))
        low, high = F.array_min(F.transform(pair, lambda v: v["label"])), F.array_max(F.transform(pair, lambda v: v["label"]))
        return F.when(F.size(pair) < 2, acc).otherwise(F.transform(acc, lambda v: F.struct(v["node"].alias("node"), F.when(v["label"] == high, low).otherwise(v["label"]).alias("label"))))

    return rows.select(*keys, F.explode(F.aggregate("_e", F.col("_n"), joined)).alias("x")).select(*keys, "x.node", "x.label")


def largest_clusters(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the largest component, ties to the least label: (keys, label, size)."""
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("size"))
    return sizes.groupBy(*keys).agg(F.max("size").alias("size"), F.min_by("label", F.struct(-F.col("size"), "label")).alias("label"))


def summary(states: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per session and minute: eligible nodes, mean correlation, signed breadth and cluster fractions (always over eleven), status.

    clusters: (session_date, minute, sign, size).
    """
    s = states.groupBy("session_date", "minute").agg(F.count_if("complete_prefix").alias("eligible"), (F.sum("sign") / NODES).alias("breadth"), F.sum("sign").alias("_sum"), F.array_sort(F.collect_list(F.when(F.col("complete_prefix"), F.col("symbol")))).alias("_set"))
    c = pairs.groupBy("session_date", "minute").agg(F.avg("corr").alias("mean_correlation"))
    size = lambda v: F.coalesce(F.max(F.when(F.col("sign") == v, F.col("size"))), F.lit(0))
    k = clusters.groupBy("session_date", "minute").agg(size(1).alias("bullish"), size(-1).alias("bearish"))
    rows = s.join(c, ["session_date", "minute"], "left").join(k, ["session_date", "minute"], "left").na.fill({"bullish": 0, "bearish": 0})
    w = Window.partitionBy("session_date").orderBy("minute").rangeBetween(-5, -5)
    same = F.max(F.col("_set").cast("string")).over(w) == F.col("_set").cast("string")
    growth = lambda c: F.when(same, (F.col(c) - F.max(c).over(w)) / NODES)
    most = F.greatest("bullish", "bearish")
    status = F.when(F.col("minute") < OPEN, "premarket").when(F.col("minute") < OPEN + 60, "warming").when(F.col("eligible") < 9, "unavailable").when(F.col("bullish") >= 7, "bullish_coordinated").when(F.col("bearish") >= 7, "bearish_coordinated").when((most <= 3) & (F.abs("_sum") <= 3), "dispersed").otherwise("unresolved")
    rows = rows.withColumns({"bullish_fraction": F.col("bullish") / NODES, "bearish_fraction": F.col("bearish") / NODES, "bullish_growth_5": growth("bullish"), "bearish_growth_5": growth("bearish"), "status": status})
    return rows.drop("_sum", "_set")


def edge_participation(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the graph's edge weight whose ends both have a sign: edges (graph_id, a, b, weight), nodes (keys, graph_id, node, sign)."""
    a, b = nodes.select(*keys, "graph_id", F.col("node").alias("a"), F.col("sign").alias("sa")), nodes.select(*keys, "graph_id", F.col("node").alias("b"), F.col("sign").alias("sb"))
    rows = a.join(edges, ["graph_id", "a"]).join(b, [*keys, "graph_id", "b"])
    part = lambda s: F.coalesce(F.sum(F.when((F.col("sa") == s) & (F.col("sb") == s), F.col("weight"))) / F.sum("weight"), F.lit(0.0))
    return rows.groupBy(*keys).agg(part(1).alias("bullish_edge_fraction"), part(-1).alias("bearish_edge_fraction"))


def missing_nodes(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows without a present one."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def rates_node(bars: DataFrame) -> DataFrame:
    """Yield index (ten times the yield): percent, and basis points against exactly five minutes ago and the open minute."""
    rows = single_minutes(bars).where("single").withColumn("_open", F.max(F.when(F.col("minute") == OPEN, F.col("close"))).over(Window.partitionBy(*P)))
    rows = rows.where(valid_bar()).withColumns({"yield_percent": F.col("close") / 10, "change_5_bps": (F.col("close") - at_offset("close", 5)) * 10, "change_open_bps": (F.col("close") - F.col("_open")) * 10})
    return rows.select(*P, "minute", "yield_percent", "change_5_bps", "change_open_bps")


def macro_sign(a: Column, b: Column) -> Column:
    """Both inputs up, both down, or neither."""
    return F.when((a > 0) & (b > 0), 1).when((a < 0) & (b < 0), -1).otherwise(0)


def interactions(edges: DataFrame, nodes: DataFrame, keys: list[str], expected: int = 3) -> DataFrame:
    """edges (macro, sector, rho) of a graph, nodes (keys, node, sign): alignment and propagated pressure of each macro node, null unless expected edges count."""
    m, s = nodes.select(*keys, F.col("node").alias("macro"), F.col("sign").alias("sm")), nodes.select(*keys, F.col("node").alias("sector"), F.col("sign").alias("ss"))
    rows = m.join(edges, "macro").join(s, [*keys, "sector"])
    whole = F.count("*") == expected
    return rows.groupBy(*keys, "macro").agg(F.when(whole, F.sum(F.col("sm") * F.col("ss") * F.col("rho") / expected)).alias("alignment"), F.when(whole, F.sum(F.col("sm") * F.abs("ss") * F.col("rho") / expected)).alias("pressure"))


def edge_states(links: DataFrame, nodes: DataFrame, keys: list[str], fresh: Column, spread: int = 3) -> DataFrame:
    """Each edge at each minute: links (source, target, kind, rho, strength), nodes (keys, node, sign), fresh over the keys.

    active where both ends have a direction and the edge a strength; alignment of the two signs along rho, and what a macro node passes on, both divided
    by spread for macro-sector edges. An end that is missing, or inputs that are not fresh, leave the edge inactive and the rest null.
    """
    known = nodes.where("sign is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", "sign"))).alias("_signs"))  # thirteen nodes
    if links.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"one graph of thirteen nodes has {MOST_EDGES} edges at most")
    rows = known.crossJoin(F.broadcast(links))
    a, b = F.try_element_at("_signs", F.col("source")), F.try_element_at("_signs", F.col("target"))
    there = F.coalesce(fresh, F.lit(False)) & a.isNotNull() & b.isNotNull()
    macro = F.col("kind") == "macro-sector"
    return rows.select(*keys, "source", "target", "kind", F.coalesce(there & (a != 0) & (b != 0) & (F.col("strength") > 0), F.lit(False)).alias("active"), F.when(there, a * b * F.col("rho") / F.when(macro, spread).otherwise(1)).alias("alignment"), F.when(there & macro, a * F.abs(b) * F.col("rho") / spread).alias("pressure"))


def top_neighbours(training: DataFrame, k: int = 3) -> DataFrame:
    """training (macro, sector, nth, rho): the k strongest by absolute correlation, ties by the fixed order nth."""
    w = Window.partitionBy("macro").orderBy(F.desc(F.abs("rho")), "nth")
    return training.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def volume_runs(bars: DataFrame) -> DataFrame:
    """Minutes up to which every bar since the open is there and traded: (P, minute, traded_prefix)."""
    w = by_minute().rangeBetween(Window.unboundedPreceding, 0)
    ok = F.sum((valid_bar(True) & (F.col("volume") > 0)).cast("int")).over(w) == F.col("minute") - OPEN + 1
    return bars.where(F.col("minute") >= OPEN).select(*P, "minute", ok.alias("traded_prefix"))
