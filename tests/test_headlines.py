"""Headlines are read in their rows: what is shuffled, and that hints lose no match."""

import random
import re

from tickloom.operators import news
from tickloom.operators import news_rules as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cues_and_mentions_are_found_without_joins(spark):
    heads = spark.createDataFrame([("a", "Nvidia cuts its outlook")], "article_id string, title string")
    plan = _plan(news.company_cues(spark, heads))
    assert "Join" not in plan and "Window" not in plan
    assert plan.count("Exchange") <= 1
    assert _plan(news.relevant_headlines(spark, heads)).count("Join") == 1


def test_mentions_inside_longer_ones_and_in_clauses(spark):
    texts = [("a", "Amazon Web Services and Amazon beat AWS"), ("b", "JPMorgan Chase; $JPM"), ("c", "Apple pie"), ("d", None), ("e", "x" * 590 + " Apple" * 2), ("f", "exxon mobil, NYSE: XOM")]
    got = {(r.key, r.ticker, r.start, r.end, r["name"]) for r in news.mentions(spark, spark.createDataFrame(texts * 2, "key string, text string")).collect()}
    assert got == {("a", "AMZN", 0, 19, "Amazon Web Services"), ("a", "AMZN", 24, 30, "Amazon"), ("a", "AMZN", 36, 39, "AWS"), ("b", "JPM", 0, 14, "JPMorgan Chase"), ("b", "JPM", 16, 20, "$JPM"), ("f", "XOM", 0, 11, "exxon mobil"), ("f", "XOM", 13, 22, "NYSE: XOM")}


def test_the_next_issuer_ends_a_tail(spark):
    titles = [("a", "Nvidia raises its outlook as Apple cuts its guidance"), ("b", "Nvidia beats estimates, Tesla misses estimates"), ("c", "Apple outlook for Tesla"), ("d", "Google holds a meeting; revenue beat forecasts"), ("e", "Google meets Apple; revenue beat forecasts"), ("f", "Tesla and Tesla could raise its outlook"), ("g", "Regulator fines Apple"), ("h", "Apple—its outlook disappoints")]
    got = {(r.article_id, r.ticker, r.rule.removeprefix("company-"), r.cue) for r in news.company_cues(spark, spark.createDataFrame(titles, "article_id string, title string")).collect()}
    assert got == {("a", "NVDA", "guidance-raised", "Nvidia raises its outlook"), ("a", "AAPL", "guidance-lowered", "Apple cuts its guidance"), ("b", "NVDA", "earnings-beat", "Nvidia beats estimates"), ("b", "TSLA", "earnings-miss", "Tesla misses estimates"), ("d", "GOOGL", "earnings-beat", "revenue beat forecasts"), ("g", "AAPL", "regulatory-action", "Regulator fines Apple")}


def test_no_match_without_a_hint():
    every = R.rule_rows() + R.rule_rows(R.PREFIX) + R.rule_rows(R.INDUSTRY)
    assert all(r["hints"] for r in every)
    pairs = [(r["pattern"], r["hints"]) for r in every] + [("(?i)" + p, h) for _, p, h in R.topic_rows()] + [("(?i)" + R.ECOSYSTEM, R.ECOSYSTEM_HINTS), (R.CLAUSES, R.CLAUSE_HINTS), (R.COMPANY_CLAUSES, R.COMPANY_CLAUSE_HINTS)]
    rng = random.Random(3)
    for pattern, hints in pairs:
        words = [*re.findall(r"[A-Za-z]+", re.sub(r"\\b|\\s|\(\?[i:]", " ", pattern)), ";"]
        assert len(words) > 1
        # every word of the pattern by itself and many short runs of them
        texts = words + [w + "s" for w in words] + [" ".join(rng.choices(words, k=rng.randint(2, 4))) for _ in range(4000)]
        missed = [t for t in texts if re.search(pattern, t) and not any(h in t.lower() for h in hints)]
        assert not missed, (pattern, missed[:3])
