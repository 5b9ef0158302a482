"""Headlines: macro rules, issuer mentions, company cues, routes, corrections, freshness and context. Rules are tables, whose rows become literal patterns.

The rule and route tables hold a few dozen rows, so every broadcast here has a fixed bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from . import news_rules as R

#: Age beyond which a snapshot or its provider is stale.
MOST_AGE = "5 minutes"
DASHES = "[‐-―]"
LONGEST = 600


def _plain(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(title, DASHES, "-"), "’", "'")


#: Rows of a rule or issuer table that are turned into expressions.
MOST_RULES = 1000


def _rows(table: DataFrame | list[dict]) -> list[dict]:
    """A rule table as literals, so that each pattern is compiled once for a task and not for each row."""
    if isinstance(table, list):
        return table
    rows = [r.asDict() for r in table.limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table may have {MOST_RULES} rows")
    return rows


def _held(low: str, hints: tuple[str, ...] | None) -> Column:
    """Whether a lower-case text holds one of the hints, without which a pattern can't match. Looking for them is much cheaper than the pattern."""
    return reduce(Column.__or__, [F.contains(F.col(low), F.lit(h)) for h in hints]) if hints else F.lit(True)


def _hits(text: str, low: str, rules: DataFrame | list[dict]) -> Column:
    """A struct (nth, rule, direction, cue) for each rule whose pattern is in the text; low is the text, or one that holds it, in lower case."""
    found = [F.when(_held(low, r.get("hints")) & F.col(text).rlike(r["pattern"]), F.struct(F.lit(r["nth"]).alias("nth"), F.lit(r["rule"]).alias("rule"), F.lit(r["direction"]).alias("direction"), F.regexp_extract(text, r["pattern"], 0).alias("cue"))) for r in _rows(rules)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _cut(text: str, low: str, pattern: str, hints: tuple[str, ...]) -> Column:
    """Clauses of a text. Only a text that may hold a separator is split, as Spark compiles that pattern for every row."""
    return F.when(_held(low, hints), F.split(text, pattern)).otherwise(F.array(text))


def _titles(headlines: DataFrame) -> DataFrame:
    return headlines.where("title is not null").select("article_id", "title")


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, as several branches use it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def macro_cues(spark: SparkSession, headlines: DataFrame, rules: DataFrame | list[dict] | None = None) -> DataFrame:
    """(article_id, rule, direction, cue): for each rule the first clause that matches it. Long titles and questions have none, nor do hedged clauses."""
    rules = _rows(rules if rules is not None else R.rule_rows())

    ok = headlines.select("article_id", F.regexp_replace("title", DASHES, "-").alias("title")).withColumn("low", F.lower("title"))
    may = _held("low", tuple(h for r in rules for h in r["hints"])) if all(r.get("hints") for r in rules) else F.lit(True)
    short = (F.length("title") <= LONGEST) & ~F.contains(F.col("title"), F.lit("?")) & may
    clauses = ok.select("article_id", F.posexplode(F.when(short, _cut("title", "low", R.CLAUSES, R.CLAUSE_HINTS))).alias("at", "clause"))
    rows = clauses.withColumn("low", F.lower("clause")).withColumn("_hits", _hits("clause", "low", rules))
    # inside the generator, where the optimizer leaves it: few clauses have a hit, and only those are asked whether they are hedged
    rows = rows.select("article_id", "at", F.inline(F.when(F.size("_hits") > 0, F.when(~F.col("clause").rlike("(?i)" + R.HEDGED), F.col("_hits")))))
    return rows.groupBy("article_id", "rule", "direction", "nth").agg(F.min_by("cue", "at").alias("cue")).drop("nth")


def _mentions(text: str, low: str, issuers: list[dict]) -> Column:
    """Issuer mentions in a text, in order, as structs (start, back, ticker, sector, end, name); back is the negative end. Those inside a longer one of the same issuer are left out."""
    # occurrence by occurrence: what precedes the n-th match is where the text splits
    found = [F.when(_held(low, r.get("hints")) & F.col(text).rlike(r["pattern"]), F.struct(F.lit(r["ticker"]).alias("ticker"), F.lit(r["sector"]).alias("sector"), F.regexp_extract_all(text, F.lit(r["pattern"]), 0).alias("found"), F.transform(F.split(text, r["pattern"], -1), lambda x: F.length(x)).alias("gaps"))) for r in issuers]
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    start = lambda m, n: total(m["gaps"], n + 1) + total(F.transform(m["found"], lambda x: F.length(x)), n)
    placed = lambda at, m, name: F.struct(at.alias("start"), (-at - F.length(name)).alias("back"), m["ticker"].alias("ticker"), m["sector"].alias("sector"), (at + F.length(name)).alias("end"), name.alias("name"))
    each = F.flatten(F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), lambda m: F.transform(m["found"], lambda name, n: placed(start(m, n), m, name))))
    before = lambda o, m: (o["ticker"] == m["ticker"]) & (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & ((o["start"] < m["start"]) | (o["end"] > m["end"]))
    # a list of one list, so that the lambda's variable stands for what is made once
    outer = F.transform(F.array(each), lambda a: F.when(F.size(a) < 2, a).otherwise(F.array_sort(F.array_distinct(F.filter(a, lambda m: ~F.exists(a, lambda o: before(o, m)))))))
    return outer[0]


def mentions(spark: SparkSession, texts: DataFrame, issuers: DataFrame | list[dict] | None = None) -> DataFrame:
    """texts (key, text): every issuer mention (key, ticker, sector, start, end, name), those inside a longer one of the same issuer left out."""
    found = _mentions("text", "_low", _rows(issuers if issuers is not None else R.issuer_rows()))
    low = texts.select("key", "text", F.lower("text").alias("_low"))
    rows = low.select("key", F.inline(F.when(F.length("text") <= LONGEST, found)))
    return rows.select("key", "ticker", "sector", "start", "end", "name").distinct()


def _names(found: str, what: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: m[what])))


def _read(headlines: DataFrame) -> DataFrame:
    """(article_id, title, low, technology, whole): plain titles, whether they speak of the technology sector, and the issuers that they name; long ones name none."""
    rows = headlines.select("article_id", _plain(F.col("title")).alias("title")).withColumn("low", F.lower("title"))
    technology = _held("low", R.ECOSYSTEM_HINTS) & F.col("title").rlike("(?i)" + R.ECOSYSTEM)
    return rows.select("article_id", "title", "low", technology.alias("technology"), F.when(F.length("title") <= LONGEST, _mentions("title", "low", R.issuer_rows())).alias("whole"))


def company_cues(spark: SparkSession, headlines: DataFrame) -> DataFrame:
    """(article_id, rule, direction, ticker, sector, scope, cue): cues about a named issuer, or the chip industry when a clause names none, each with the words of its first place.

    A headline that neither names an issuer nor speaks of the technology sector has none, whatever its words. A title is read in its row: clauses, mentions
    and hits are small arrays, and only the cues are shuffled, by article.
    """
    title = F.col("title")
    ok = (F.length("title") <= LONGEST) & ~F.contains(title, F.lit("?")) & (F.col("technology") | (F.size("whole") > 0))
    cut = F.when(ok, F.when(~title.rlike("(?i)" + R.RETROSPECTIVE), _cut("title", "low", R.COMPANY_CLAUSES, R.COMPANY_CLAUSE_HINTS)))
    rows = _read(headlines).select("article_id", "technology", "whole", F.posexplode(cut).alias("at", "text")).withColumn("text", F.trim("text"))
    rows = rows.withColumn("low", F.lower("text"))
    # where a title names nobody, none of its clauses does
    rows = rows.withColumn("found", F.when(F.size("whole") > 0, _mentions("text", "low", R.issuer_rows())).otherwise(F.slice("whole", 1, 0)))
    # next mention of a different issuer: the next start whose ticker is another
    later = lambda m, n: F.try_element_at(F.filter(F.slice("found", n + 2, F.greatest(F.size("found"), F.lit(1))), lambda o: o["ticker"] != m["ticker"]), F.lit(1))["start"]
    following = F.transform("found", lambda m, n: F.struct(m.alias("m"), later(m, n).alias("next")))
    # a row for each mention; a clause that names nobody has one row, where m is null
    rows = rows.select("article_id", "at", "technology", "whole", "text", "low", F.explode_outer(following).alias("_s")).select("article_id", "at", "technology", "whole", "text", "low", "_s.m", "_s.next")
    named = F.col("m").isNotNull()
    tail = F.substring(F.col("text"), F.col("m.end") + 1, F.coalesce("next", F.length("text")) - F.col("m.end"))
    tail = F.trim(F.regexp_replace(tail, r"^\s*(?:'s\s+)?(?:\([^)]*\)\s*)?", ""))
    own = (F.size(_names("whole", "ticker")) == 1) & F.col("text").rlike("(?i)" + R.OWN_CLAUSE)
    rows = rows.withColumns({"tail": F.when(named, tail).when(own, F.regexp_replace("text", r"(?i)^its\s+", "")), "prefix": F.when(named, F.trim(F.substring(F.col("text"), F.lit(1), F.col("m.start"))))})
    cue = lambda hits, text, scope, ticker, sector: F.transform(hits, lambda h: F.struct(h["rule"].alias("rule"), h["direction"].alias("direction"), ticker.alias("ticker"), sector.alias("sector"), F.lit(scope).alias("scope"), text(h["cue"]).alias("cue")))
    ticker, sector = F.coalesce("m.ticker", F.get("whole", 0)["ticker"]), F.when(named, F.col("m.sector")).otherwise(F.get(_names("whole", "sector"), 0))
    none = F.lit(None).cast("string")
    by_tail = cue(_hits("tail", "low", R.rule_rows(R.COMPANY)), lambda c: F.concat_ws(" ", "m.name", c), "company", ticker, sector)
    before = F.filter(_hits("prefix", "low", R.rule_rows(R.PREFIX)), lambda h: (h["rule"] != "company-export-restriction") | F.col("next").isNull())
    by_prefix = cue(before, lambda c: F.col("text"), "company", ticker, sector)
    industry = cue(_hits("text", "low", R.rule_rows(R.INDUSTRY)), lambda c: c, "industry", none, F.lit("XLK"))
    nothing = F.array().cast("array<struct<rule:string,direction:string,ticker:string,sector:string,scope:string,cue:string>>")
    rows = rows.withColumn("hits", F.concat(F.when(F.col("tail").isNotNull(), by_tail).otherwise(nothing), F.when(named, by_prefix).otherwise(industry)))
    hedged = lambda c: F.col(c).rlike("(?i)" + R.COMPANY_HEDGED)
    about = F.col("next").isNotNull() & F.col("tail").rlike(r"(?i)\b(?:forecast|outlook|estimate|rating|price target)s?\b") & F.col("tail").rlike(r"(?i)\b(?:for|on|about|at)\s*$")
    clear = F.when(named, ~hedged("tail") & ~hedged("prefix") & ~about).otherwise(~hedged("text"))
    place = F.struct("at", F.coalesce("m.start", F.lit(0)).alias("start")).alias("place")
    every = rows.select("article_id", place, F.inline(F.when(F.size("hits") > 0, F.when(clear, F.col("hits")))))
    # dealt by article, which also serves what is grouped by article later
    return every.repartition("article_id").groupBy("article_id", "rule", "direction", "ticker", "sector", "scope").agg(F.min_by("cue", "place").alias("cue"))


def _sorted_union(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))))


def relevant_headlines(spark: SparkSession, headlines: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """Headlines that name an issuer or the technology sector: (article_id, topics, tickers, sectors, classification, evidence).

    classification is UNCERTAIN where no cue says a direction; missing direction is not neutral. cues: as company_cues gives them, where they are there already.
    """
    cues = cues if cues is not None else company_cues(spark, headlines)
    said = cues.groupBy("article_id").agg(F.array_sort(F.collect_set("direction")).alias("directions"), F.collect_set("ticker").alias("_t"), F.collect_set("sector").alias("_s"), F.count("*").alias("evidence"))
    topics = F.filter(F.array(*[F.when(_held("low", h) & F.col("title").rlike("(?i)" + p), n) for n, p, h in R.topic_rows()]), lambda x: x.isNotNull())
    names = F.size("whole") > 0
    other = F.array(F.when(names, R.OTHER_COMPANY).otherwise(R.OTHER_TECHNOLOGY))
    row = F.struct(topics.alias("_topics"), other.alias("_other"), _names("whole", "ticker").alias("tickers"), _names("whole", "sector").alias("sectors"))
    rows = _read(headlines).select("article_id", F.inline(F.when((F.length("title") <= LONGEST) & (F.col("technology") | names), F.array(row))))
    rows = rows.join(said, "article_id", "left")
    directions = F.coalesce("directions", F.array().cast("array<string>"))
    return rows.select("article_id", F.when(F.size("_topics") > 0, F.col("_topics")).otherwise(F.col("_other")).alias("topics"), _sorted_union(F.col("tickers"), F.col("_t")).alias("tickers"), _sorted_union(F.col("sectors"), F.col("_s")).alias("sectors"), classification(directions).alias("classification"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def relevance_routes(spark: SparkSession, headlines: DataFrame) -> DataFrame:
    """(article_id, rule, target, tickers, topics): which sector a headline mentions, by its issuers, or by the computing topic where it names none. No direction."""
    title = _plain(F.col("title"))
    rows = headlines.select("article_id", title.rlike("(?i)" + R.COMPUTING).alias("computing"))
    found = mentions(spark, _titles(headlines).select(F.col("article_id").alias("key"), _plain(F.col("title")).alias("text")))
    issuers = found.groupBy(F.col("key").alias("article_id"), F.col("sector").alias("target")).agg(F.array_sort(F.collect_set("ticker")).alias("tickers")).where(F.col("target").isin(*R.ALL))
    words = F.when(F.col("computing"), F.array(F.lit("Company reference"), F.lit("AI / computing"))).otherwise(F.array(F.lit("Company reference")))
    company = rows.join(issuers, "article_id").select("article_id", F.lit("company-mentioned-sector").alias("rule"), "target", "tickers", words.alias("topics"))
    topic = rows.where("computing").join(issuers.select("article_id").distinct(), "article_id", "left_anti")
    return company.unionByName(topic.select("article_id", F.lit("explicit-computing-topic").alias("rule"), F.lit("XLK").alias("target"), F.array().cast("array<string>").alias("tickers"), F.array(F.lit("AI / computing")).alias("topics")))


def available(articles: DataFrame, cutoff: Column) -> DataFrame:
    """Articles published, retrieved and first seen by the cutoff; a time that is missing doesn't count against it, but publication must be there."""
    known = lambda c: F.coalesce(F.col(c) <= cutoff, F.lit(True))
    return articles.where((F.col("published_at") <= cutoff) & known("received_at") & known("first_observed_at"))


def latest_corrections(articles: DataFrame, cutoff: Column) -> DataFrame:
    """Of articles with one canonical url, known in order by the cutoff, the latest by received, first observed, published and id. Look-back comes after."""
    known = articles.where((F.col("published_at") <= F.col("received_at")) & (F.col("received_at") <= F.col("first_observed_at")) & (F.col("first_observed_at") <= F.col("assessed_at")) & (F.col("assessed_at") <= cutoff) & (F.col("published_at") <= cutoff))
    rank = F.struct("received_at", "first_observed_at", "published_at", "article_id")
    return known.groupBy("url").agg(F.max_by(F.struct(*known.columns), rank).alias("_r")).select("_r.*")


def safe_url(url: Column, hosts: Column) -> Column:
    """Canonical form of an article's url: https, an allowed host, no port or user; tracking parameters and fragment gone; else null."""
    host = F.parse_url(url, F.lit("HOST"))
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)(?<=[?&])(?:utm_[^&=]*|fbclid|gclid)(?:=[^&]*)?(?:&|$)", "")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    ok = (F.length(url) <= 2048) & url.rlike(r"^https://[^/@:?#]+(?:[/?#]|$)") & F.array_contains(hosts, host)
    return F.when(ok, bare)


def healthy_sources(health: DataFrame, cutoff: Column, observed: Column) -> DataFrame:
    """Sources that are ok and were checked and successful by the snapshot and within their own maximal age at the cutoff."""
    age = lambda c: (cutoff.cast("double") - F.col(c).cast("double")) * 1000 <= F.col("max_age_ms")
    return health.where((F.col("status") == "ok") & (F.col("checked_at") <= observed) & (F.col("last_success_at") <= observed) & age("checked_at") & age("last_success_at"))


def classification(directions: Column) -> Column:
    """Set of directions to one word."""
    return F.when(F.size(directions) > 1, "MIXED").when(F.size(directions) == 1, directions[0]).otherwise("UNCERTAIN")


def route_signs(spark: SparkSession, cues: DataFrame) -> DataFrame:
    """cues (article_id, rule, direction, sector) to (article_id, rule, target, expected): by the route table, or the issuer's sector."""
    routes = F.broadcast(R.route_table(spark))
    macro = cues.join(routes, "rule").select("article_id", "rule", "target", "expected")
    company = cues.where("sector is not null").select("article_id", "rule", F.col("sector").alias("target"), F.when(F.col("direction") == "TAILWIND", 1).otherwise(-1).alias("expected"))
    return macro.unionByName(company).distinct()


def agreement(routes: DataFrame, observed: DataFrame) -> DataFrame:
    """Adds what the target's node says against the expected sign: agrees, conflicts, mixed or unavailable. observed: (node, sign)."""
    o = observed.select(F.col("node").alias("target"), F.col("sign").alias("seen"))
    return routes.join(o, "target", "left").withColumn("reading", F.when(F.col("seen").isNull(), "unavailable").when(F.col("seen") == 0, "mixed").when(F.col("seen") == F.col("expected"), "agrees").otherwise("conflicts"))


#: Targets from which a route goes on along saved links.
MACRO_NODES = ("USO", "TNX")


def usable_links(links: DataFrame) -> DataFrame:
    """(macro, sector, rho) of saved links (source, target, rho, strength), whichever end is the macro node: those whose strength is the size of a correlation that isn't zero."""
    sound = (F.col("rho") != 0) & (F.abs("rho") <= 1) & (F.abs(F.col("strength") - F.abs("rho")) <= 1e-12)
    ends = lambda a, b: links.where(sound & F.col(a).isin(*MACRO_NODES) & F.col(b).isin(*R.ALL)).select(F.col(a).alias("macro"), F.col(b).alias("sector"), "rho")
    return ends("source", "target").unionAll(ends("target", "source"))


def onward(routes: DataFrame, links: DataFrame) -> DataFrame:
    """Second hop: from a macro target to the sectors that it is linked to, by links (macro, sector, rho)."""
    return routes.join(links.withColumnRenamed("macro", "target"), "target").select("article_id", "rule", F.col("target").alias("via"), F.col("sector").alias("target"), F.col("expected").alias("_first"), "rho").withColumn("expected", (F.col("_first") * F.signum("rho")).cast("int")).drop("_first")


def news_paths(routes: DataFrame, links: DataFrame, nodes: DataFrame, prices_held: bool = False) -> DataFrame:
    """Paths of routes (article_id, rule, target, expected) over saved links: (article_id, rule, path, expected, observed, state, rho).

    nodes: (node, sign, eligible). A node that isn't eligible or is missing is held: what is seen at it is unavailable, and so is what lies beyond it. Of
    paths that occur twice one stays, the one of the link that is least in correlation.
    """
    seen = nodes.select("node", F.when(F.col("eligible"), F.col("sign")).alias("_sign"))
    at = routes.join(seen.withColumnRenamed("node", "target").withColumnRenamed("_sign", "_first"), "target", "left")
    direct = at.select("article_id", "rule", F.array(F.lit("NEWS"), F.col("target")).alias("path"), F.col("expected").cast("int").alias("expected"), F.col("_first").alias("observed"), F.lit(None).cast("double").alias("rho"))
    hop = onward(routes, usable_links(links)).join(seen.select(F.col("node").alias("via"), F.col("_sign").alias("_first")), "via", "left").join(seen.select(F.col("node").alias("target"), F.col("_sign").alias("_second")), "target", "left")
    beyond = hop.select("article_id", "rule", F.array(F.lit("NEWS"), F.col("via"), F.col("target")).alias("path"), "expected", F.when(F.col("_first").isNotNull(), F.col("_second")).alias("observed"), "rho")
    rows = direct.unionByName(beyond).groupBy("article_id", "rule", "path").agg(F.min_by(F.struct("expected", "observed", "rho"), "rho").alias("a"), F.first(F.struct("expected", "observed", "rho")).alias("b"))
    rows = rows.select("article_id", "rule", "path", F.coalesce("a", "b").alias("r")).select("article_id", "rule", "path", "r.expected", F.when(F.lit(not prices_held), F.col("r.observed")).alias("observed"), "r.rho")
    state = F.when(F.col("observed").isNull(), "unavailable").when(F.col("observed") == 0, "mixed").when(F.col("observed") == F.col("expected"), "agrees").otherwise("conflicts")
    return rows.withColumn("state", state)


def scheduled_events(events: DataFrame, health: DataFrame, cutoff: Column, observed: Column, ahead_hours: int = 24) -> DataFrame:
    """Events (source_id, known_as_of, scheduled_at) of healthy sources that were known by the snapshot and come within the next hours."""
    soon = F.col("scheduled_at").between(cutoff, cutoff + F.make_interval(hours=F.lit(ahead_hours)))
    return events.where((F.col("known_as_of") <= F.least(cutoff, observed)) & soon).join(healthy_sources(health, cutoff, observed).select("source_id"), "source_id", "left_semi")


def context(spark: SparkSession, articles: DataFrame, health: DataFrame, cutoff: Column, lookback_hours: int = 24, observed: Column | None = None, provider_as_of: Column | None = None, provider_status: Column | None = None) -> DataFrame:
    """One row: status, classification, coverage and counts at the cutoff, from corrected articles of healthy sources inside the look-back.

    observed is the time of the snapshot, provider_as_of that of its recorder; both are the cutoff where not given. In order: a snapshot after the
    cutoff or a recorder that isn't ok make the row unavailable or stale, so does age over MOST_AGE, then sources that are all down, then a lack of evidence,
    which is UNCERTAIN while relevant headlines are there.
    """
    observed = cutoff if observed is None else observed
    provider_as_of = observed if provider_as_of is None else provider_as_of
    provider_status = F.lit("ok") if provider_status is None else provider_status
    good = healthy_sources(health, cutoff, observed)
    rows = latest_corrections(articles, F.least(cutoff, observed)).join(good.select("source_id"), "source_id", "left_semi").where(F.col("published_at") >= cutoff - F.make_interval(hours=F.lit(lookback_hours)))
    rows = _kept(rows.select("article_id", "title", "published_at", "assessed_at"))
    macro = macro_cues(spark, rows).select("article_id", "rule", "direction")
    known = rows.where((cutoff >= F.lit(R.REGISTRY_FROM).cast("timestamp")) & (F.col("assessed_at") >= F.lit(R.REGISTRY_FROM).cast("timestamp")))
    company = _kept(company_cues(spark, known))
    cues = macro.unionByName(company.select("article_id", "rule", "direction"))
    said = cues.agg(F.array_sort(F.collect_set("direction")).alias("directions"), F.count_distinct("article_id").alias("classified"), F.count("*").alias("evidence"))
    relevant = relevant_headlines(spark, known, company).agg(F.count("*").alias("relevant"), F.count_if(F.col("classification") == "UNCERTAIN").alias("uncertain"))
    counted = rows.agg(F.count("*").alias("considered"))
    covered = health.agg(F.count("*").alias("sources")).crossJoin(good.agg(F.count("*").alias("healthy")))
    out = said.crossJoin(counted).crossJoin(covered).crossJoin(relevant)  # one row each
    old = lambda t: t < cutoff - F.expr(f"interval {MOST_AGE}")
    stale = F.coalesce(old(observed) | (provider_as_of > observed) | old(provider_as_of), F.lit(True))
    status = F.when(observed > cutoff, "unavailable").when(provider_status != "ok", F.when(provider_status == "stale", "stale").otherwise("unavailable")).when(stale, "stale").when(F.col("healthy") == 0, "unavailable").when(F.col("evidence") > 0, "available").when(F.col("relevant") > 0, "available").otherwise("no_evidence")
    out = out.withColumn("status", status)
    live = lambda c: F.when(F.col("status").isin("available", "no_evidence"), F.col(c)).otherwise(0).alias(c)
    reading = F.when(F.col("status") != "available", "UNAVAILABLE").otherwise(classification(F.col("directions")))
    return out.withColumn("unclassified", F.col("considered") - F.col("classified")).select("status", reading.alias("classification"), *map(live, ("considered", "unclassified", "evidence", "relevant", "uncertain")), "sources", "healthy", (F.col("healthy") < F.col("sources")).alias("partial"))


#: What snapshot rows may hold.
MARKUP = r"[<>\x00-\x08\x0B\x0C\x0E-\x1F]"
SCHEDULED = "scheduled; outcome not inferred"
LONGEST_SUMMARY, LONGEST_FIGURE = 1600, 100


def _first_problem(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Adds problem: the name of the first test that holds or can't be answered."""
    return rows.withColumn("problem", F.coalesce(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests]))


def _common_problems(kind: str, key: str, hosts: Column, known: Column, times: tuple[str, ...]) -> list[tuple[str, Column]]:
    title = F.col("title")
    return [("id", ~F.col(key).rlike(f"^{kind}-[a-f0-9]{{64}}$")), ("title", (F.length(title) < 1) | (F.length(title) > LONGEST)), ("title markup", title.rlike(MARKUP)), ("url", safe_url(F.col("url"), hosts).isNull()), ("source", ~known), *[(t, F.col(t).isNull()) for t in times]]


def snapshot_problems(articles: DataFrame, hosts: Column, known: Column) -> DataFrame:
    """Adds problem: the first structural fault of an article row, or null. hosts are those that its source may link to, known whether the source is one of the snapshot's."""
    summary = F.col("summary")
    tests = _common_problems("news", "article_id", hosts, known, ("published_at", "received_at", "first_observed_at", "assessed_at"))
    return _first_problem(articles, [*tests, ("summary", F.length(summary) > LONGEST_SUMMARY), ("summary markup", summary.rlike(MARKUP))])


def event_problems(events: DataFrame, hosts: Column, known: Column) -> DataFrame:
    """Adds problem: the first structural fault of a scheduled event, or null. Forecast and previous figure may be missing."""
    figure = lambda c: F.coalesce(F.length(c) > LONGEST_FIGURE, F.lit(False))
    tests = _common_problems("event", "event_id", hosts, known, ("scheduled_at", "known_as_of"))
    return _first_problem(events, [*tests, ("status", F.col("status") != SCHEDULED), ("forecast", figure("forecast")), ("previous", figure("previous"))])
