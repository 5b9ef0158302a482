"""Queries over all rows that they are for, with no cap on the way."""

import pytest

from tickloom.functions.shared import shared_dir
from tickloom.operators import forecast
from tickloom.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"


def test_read_rss_allows_any_number_of_hosts(spark, tmp_path):
    pages = spark.sql("select id * 3 page_id, concat('https://h', id, '.net/x') url from range(12000) union all select id * 3 + 2, concat('https://h', id, '.org/x') from range(200)")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    newest = sorted((-(3 * i * 37 % 86400), f"https://h{i}.net/x", f"page {3 * i}") for i in range(12000))[:100]
    got = [(r.link, r.title) for r in catalogue.QUERIES["read_rss"](spark, str(tmp_path)).collect()]
    assert got == [(u, t) for _, u, t in newest]


def test_sensitivity_band_has_every_line_with_a_gap(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(500)
    lines.unionAll(lines.limit(7)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue.QUERIES["sensitivity_band"](spark, str(tmp_path)).collect()
    want = [r for r in lines.collect() if r.l_partkey % 3 == 0 or r.l_suppkey % 4 == 0]
    assert len(got) == len({r.row_id for r in got}) == len(want) and all(r.low <= r.high for r in got)
    assert {int(r.row_id.split("-")[4]) for r in got} == {r.l_linenumber for r in want}


def test_shared_folder_is_never_local_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        shared_dir(Session())


@pytest.mark.parametrize("name", ["interaction_scores", "node_log_odds", "features_interaction", "features_network"])
def test_tape_of_features_is_read_once(spark, monkeypatch, name):
    """Bars are made of the ticks once and are a table from then on, whatever the number of their readers."""
    read, table = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda s, d, n: read.append(n) or table(s, d, n))
    got = catalogue.QUERIES[name](spark, SF)
    assert read == ["lineitem"] and not any("lineitem" in f for f in got.inputFiles())


def test_feature_given_twice_or_without_a_name_makes_the_map_null(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 1.0), (2, "a", 1.0), (3, "a", 1.0), (3, None, 2.0), (4, None, 1.0)], "k int, feature string, value double")
    got = {r.k: r.features for r in forecast.feature_vector(long, ["k"]).collect()}
    assert got == {1: {"a": 1.0, "b": None}, 2: None, 3: None, 4: None}
