"""Headlines. Titles are made from orders: a wording by key, an issuer by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import news as N
from ..operators import news_rules as R
from . import fixtures as X
from .registry import query, rounded

#: Wordings; @ is an issuer. Titles get their order's number, so hardly two are equal.
WORDINGS = (
    "Oil prices rise after a quiet week",
    "Brent crude fell while traders waited",
    "Treasury yields climbed; stocks steady",
    "Treasury yields may fall next month",
    "CPI comes in hotter than expected",
    "Consumer prices were lower than expected",
    "Fed raises its benchmark interest rate",
    "Fed cuts rates, but oil prices jumped",
    "Government imposes new import tariffs",
    "Parliament lifted existing tariffs",
    "@ raises full-year revenue guidance",
    "@ cuts its outlook",
    "@ reports strong cloud demand",
    "Regulator fines @",
    "@ could raise its guidance",
    "Is @ ready for winter?",
    "Rain expected in the north",
    "GPU demand surges",
    "Analysts say @ outlook disappoints",
    "@ quarterly earnings beat estimates in Europe",
    "@ revenue misses analyst expectations",
    "Rivals wait while @ sees slowing AI demand",
    "@ suffers major outage",
    "@ faces an antitrust probe",
    "@ restores cloud services after outage",
    "Government bans chip exports by @",
    "FDA approves @",
    "@ holds its meeting; its revenue beat forecasts",
    "Semiconductor demand slows",
    "Washington tightens AI chip export controls",
    "Ministry eases semiconductor export restrictions",
    "ChatGPT maker plans more data centers",
    "How @ lost its way last year",
)
NAMES = tuple(a[0] for _, _, a in R.ISSUERS)
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
HEADLINES = f"""heads as (select o_orderkey::varchar article_id, replace({_list(WORDINGS)}[(o_orderkey % {len(WORDINGS)})::int + 1], '@', {_list(NAMES)}[(o_custkey % {len(NAMES)})::int + 1]) || ' (no. ' || o_orderkey || ')' title, o_orderdate published_at, o_custkey, o_orderkey from orders)"""


def heads(spark, d) -> DataFrame:
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs)).cast("int") + 1)
    return X.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("article_id"), F.concat(F.replace(pick(WORDINGS, "o_orderkey"), F.lit("@"), pick(NAMES, "o_custkey")), F.lit(" (no. "), F.col("o_orderkey").cast("string"), F.lit(")")).alias("title"), F.col("o_orderdate").cast("timestamp").alias("published_at"), "o_custkey", "o_orderkey")


def _hits(table: str, text: str, rules) -> str:
    """Rows of a table for each rule whose pattern is in a text of theirs: with ruleid, direction and hit. The patterns are constants, so each is compiled once."""
    sql = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    each = ", ".join(f"case when regexp_matches({text}, {sql(p)}) then {{'ruleid': '{r}', 'direction': '{d}', 'hit': regexp_extract({text}, {sql(p)})}} end" for r, d, p in rules)
    return f"(select * exclude (r), r.ruleid ruleid, r.direction direction, r.hit hit from (select *, unnest(list_filter([{each}], lambda x: x is not null)) r from {table}))"


MACRO = f"""cl as (select article_id, unnest(c) clause, unnest(range(1, len(c) + 1)) i from (select article_id, regexp_split_to_array(title, '{R.CLAUSES}') c from heads where length(title) <= 600 and not contains(title, '?'))),
    ok as (select * from cl where not regexp_matches(clause, '(?i){R.HEDGED}')), macro as (select article_id, ruleid, direction, arg_min(hit, i) cue from {_hits("ok", "clause", R.MACRO)} group by article_id, ruleid, direction)"""


@query(f'with {HEADLINES}, {MACRO} select article_id, ruleid as "rule", direction, cue from macro')
def macro_headlines(spark, d):
    return N.macro_cues(spark, heads(spark, d))


_issuers = "(values " + ", ".join(f"('{t}', '{s}', '{a[0]}')" for t, s, a in R.ISSUERS) + ") t(ticker, sector, alias)"


@query(f"with {HEADLINES} select article_id \"key\", ticker, sector, (strpos(title, alias) - 1)::bigint \"start\", (strpos(title, alias) - 1 + length(alias))::bigint \"end\", alias as name from heads join {_issuers} on regexp_matches(title, '(^|[^A-Za-z0-9])' || alias || '($|[^A-Za-z0-9])') where length(title) <= 600")
def issuer_mentions(spark, d):
    h = heads(spark, d).select(F.col("article_id").alias("key"), F.col("title").alias("text"))
    return rounded(N.mentions(spark, h))


_q = lambda x: "'" + x.replace("'", "''") + "'"
#: Prefix and industry rules, as the company rules, on what comes before a mention and on clauses that name nobody.
COMPANY = f"""comp as (select article_id, title, i.ticker, i.sector, i.alias, regexp_matches(title, '(?i){R.ECOSYSTEM}') technology from heads left join {_issuers.replace(") t(", ") i(")} on contains(title, i.alias) and regexp_matches(title, '(^|[^A-Za-z0-9])' || i.alias || '($|[^A-Za-z0-9])') where length(title) <= 600),
    parts as (select article_id, ticker, sector, alias, technology, unnest(c) raw, unnest(range(1, len(c) + 1)) i from (select *, regexp_split_to_array(title, '{R.COMPANY_CLAUSES}') c from comp where not contains(title, '?') and not regexp_matches(title, '(?i){R.RETROSPECTIVE}'))),
    clause as (select *, trim(raw) t, coalesce(regexp_matches(trim(raw), '(^|[^A-Za-z0-9])' || alias || '($|[^A-Za-z0-9])'), false) names from parts),
    said as (select *, trim(substr(t, 1, strpos(t, alias) - 1)) prefix, trim(regexp_replace(substr(t, strpos(t, alias) + length(alias)), '^\\s*(?:''s\\s+)?(?:\\([^)]*\\)\\s*)?', '')) tail from clause where names),
    clear as (select * from said where not regexp_matches(tail, '(?i){R.COMPANY_HEDGED}') and not regexp_matches(prefix, '(?i){R.COMPANY_HEDGED}')), bare as (select * from clause where not names and not regexp_matches(t, '(?i){R.COMPANY_HEDGED}')),
    any_cue as (select article_id, i, strpos(t, alias) p, ruleid, direction, ticker, sector, 'company' "scope", alias || ' ' || hit cue from {_hits("clear", "tail", R.COMPANY)}
        union all select article_id, i, strpos(t, alias), ruleid, direction, ticker, sector, 'company', t from {_hits("clear", "prefix", R.PREFIX)}
        union all select article_id, i, 0, ruleid, direction, ticker, sector, 'company', hit from {_hits("(select *, regexp_replace(t, '(?i)^its\\s+', '') rest from bare)", "rest", R.COMPANY)} where alias is not null and regexp_matches(t, '(?i){R.OWN_CLAUSE}')
        union all select article_id, i, 0, ruleid, direction, null, 'XLK', 'industry', hit from {_hits("bare", "t", R.INDUSTRY)} where technology or alias is not null),
    cues as (select article_id, ruleid, direction, ticker, sector, "scope", arg_min(cue, (i, p)) cue from any_cue group by article_id, ruleid, direction, ticker, sector, "scope")"""


@query(f'with {HEADLINES}, {COMPANY} select article_id, ruleid as "rule", direction, ticker, sector, "scope", cue from cues')
def company_headlines(spark, d):
    """Every company and industry rule on titles that name one issuer at most; the SQL goes by the rules too."""
    return N.company_cues(spark, heads(spark, d))


RELEVANT = f"""rel as (select comp.article_id, list_filter([{", ".join(f"case when regexp_matches(title, '(?i){p}') then {_q(n)} end" for n, p in R.TOPICS)}], lambda x: x is not null) topics, alias is not null named, technology,
    regexp_matches(title, '(?i){R.COMPUTING}') computing, comp.ticker, comp.sector, cues.sector cue_sector, coalesce(direction, 'UNCERTAIN') classification, (direction is not null)::bigint evidence from comp left join cues using (article_id))"""


@query(f"""with {HEADLINES}, {COMPANY}, {RELEVANT} select article_id, array_to_string(case when len(topics) > 0 then topics when named then ['Company developments'] else ['AI / technology'] end, ', ') topics, case when named then ticker else '' end tickers, case when named then sector else coalesce(cue_sector, '') end sectors, classification, evidence from rel where named or technology""")
def relevant_headlines(spark, d):
    """Topics, issuers and reading of each relevant headline; without a cue it is UNCERTAIN."""
    r = N.relevant_headlines(spark, heads(spark, d))
    return rounded(r.withColumns({c: F.array_join(c, ", ") for c in ("topics", "tickers", "sectors")}))


@query(f"""with {HEADLINES}, {COMPANY}, {RELEVANT} select article_id, case when named then 'company-mentioned-sector' else 'explicit-computing-topic' end as "rule", case when named then sector else 'XLK' end target, case when named then ticker else '' end tickers, case when named and computing then 'Company reference, AI / computing' when named then 'Company reference' else 'AI / computing' end topics from rel where named or computing""")
def relevance_routes(spark, d):
    r = N.relevance_routes(spark, heads(spark, d))
    return r.withColumns({c: F.array_join(c, ", ") for c in ("topics", "tickers")})


_routes = "(values " + ", ".join(f"('{r}', '{t}', {s})" for r, ts, s in R.ROUTES for t in ts) + ") r(ruleid, target, expected)"
#: Saved links: either end may be the macro node; the last five are unsound or lead nowhere.
_links = [("USO", "XLE", 0.7, 0.7), ("XLI", "USO", -0.3, 0.3), ("TNX", "XLF", 0.5, 0.5), ("XLU", "TNX", -0.6, 0.6), ("TNX", "XLK", 0.4, 0.3), ("USO", "XLB", 0.0, 0.0), ("TNX", "XLV", 1.2, 1.2), ("USO", "TNX", 0.5, 0.5), ("XLK", "XLC", 0.9, 0.9)]
LINKS = f"""links as (select via, sector, rho from (select source via, target sector, rho, strength from (values {', '.join(f"('{a}', '{b}', {c}::double, {e}::double)" for a, b, c, e in _links)}) t(source, target, rho, strength)
    union all select target, source, rho, strength from (values {', '.join(f"('{a}', '{b}', {c}::double, {e}::double)" for a, b, c, e in _links)}) t(source, target, rho, strength)) where via in ('USO', 'TNX') and list_contains({_list(R.ALL)}, sector) and rho <> 0 and abs(rho) <= 1 and abs(strength - abs(rho)) <= 1e-12)"""


def saved_links(spark) -> DataFrame:
    return spark.createDataFrame(_links, "source string, target string, rho double, strength double")


ROUTED = f"""{HEADLINES}, {MACRO}, {COMPANY}, routed as (select distinct article_id, ruleid, target, expected from macro join {_routes} using (ruleid) union select article_id, ruleid, sector, case when direction = 'TAILWIND' then 1 else -1 end from cues)"""


def _routed(spark, d) -> DataFrame:
    h = heads(spark, d)
    cues = N.macro_cues(spark, h).select("article_id", "rule", "direction", F.lit(None).cast("string").alias("sector"))
    return N.route_signs(spark, cues.unionByName(N.company_cues(spark, h).select("article_id", "rule", "direction", "sector")))


@query(f'with {ROUTED} select article_id, ruleid as "rule", target, expected::bigint expected from routed')
def headline_routes(spark, d):
    return rounded(_routed(spark, d))


@query(f"""with {ROUTED}, o as (select {_list((*R.ALL, 'USO', 'TNX'))}[i + 1] target, (i % 3) - 1 seen from range(0, 12) t(i)) select article_id, ruleid as "rule", target, expected::bigint expected, case when seen is null then 'unavailable' when seen = 0 then 'mixed' when seen = expected then 'agrees' else 'conflicts' end reading from routed left join o using (target)""")
def route_agreement(spark, d):
    """Expected signs against node signs; one node is missing."""
    nodes = spark.createDataFrame([(n, i % 3 - 1) for i, n in enumerate((*R.ALL, "USO", "TNX")) if i < 12], "node string, sign int")
    return rounded(N.agreement(_routed(spark, d), nodes).drop("seen"))


@query(f"""with {ROUTED}, {LINKS} select article_id, ruleid as "rule", via, sector target, (expected * sign(rho))::bigint expected from routed join links on via = target""")
def second_hop(spark, d):
    return rounded(N.onward(_routed(spark, d), N.usable_links(saved_links(spark))).drop("rho"))


@query(f"""with {ROUTED}, {LINKS}, o as (select {_list((*R.ALL, 'USO', 'TNX'))}[i + 1] node, (i % 3) - 1 seen, i <> 4 and i <> 11 ok from range(0, 12) t(i)), e as (select node, case when ok then seen end seen from o),
    f as (select article_id, ruleid, 'NEWS,' || target path, expected, e.seen observed, null::double rho from routed left join e on e.node = target
        union all select article_id, ruleid, 'NEWS,' || via || ',' || sector, expected * sign(rho), case when a.seen is not null then b.seen end, rho from routed join links on via = target left join e a on a.node = via left join e b on b.node = sector)
    select article_id, ruleid as "rule", path, expected::bigint expected, observed::bigint observed, round(rho + 1e-9, 6) rho, case when observed is null then 'unavailable' when observed = 0 then 'mixed' when observed = expected then 'agrees' else 'conflicts' end state from f""")
def news_paths(spark, d):
    """Paths over saved links with what is seen at their ends; two nodes are held, one is missing."""
    nodes = spark.createDataFrame([(n, i % 3 - 1, i not in (4, 11)) for i, n in enumerate((*R.ALL, "USO", "TNX")) if i < 12], "node string, sign int, eligible boolean")
    return rounded(N.news_paths(_routed(spark, d), saved_links(spark), nodes).withColumn("path", F.array_join("path", ",")))


ARTICLES = f"""{HEADLINES}, arts as (select article_id, title, 'u' || (o_orderkey % 500) url, 's' || (o_custkey % 5) source_id, published_at, published_at + to_minutes((o_custkey % 7)::int) received_at, published_at + to_minutes((o_custkey % 11)::int) first_observed_at, published_at + interval 12 minute assessed_at from heads)"""


def articles(spark, d) -> DataFrame:
    mins = lambda n: F.make_dt_interval(mins=n)
    t = F.col("published_at")
    return heads(spark, d).select("article_id", "title", F.concat(F.lit("u"), (F.col("o_orderkey") % 500).cast("string")).alias("url"), F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source_id"), "published_at", (t + mins(F.col("o_custkey") % 7)).alias("received_at"), (t + mins(F.col("o_custkey") % 11)).alias("first_observed_at"), (t + mins(F.lit(12))).alias("assessed_at"))


LATEST = f"""{ARTICLES}, cut as (select max(published_at) - interval 30 day c from arts), latest as (select arts.* from arts, cut where published_at <= received_at and received_at <= first_observed_at and first_observed_at <= assessed_at and assessed_at <= c and published_at <= c
    qualify row_number() over (partition by url order by received_at desc, first_observed_at desc, published_at desc, article_id desc) = 1)"""


def _cut(spark, d) -> F.Column:
    """Thirty days before the last article: one number, the replay's clock."""
    return F.lit(articles(spark, d).agg(F.max("published_at")).first()[0]) - F.expr("interval 30 days")


@query(f"with {LATEST} select article_id, url, source_id from latest")
def latest_corrections(spark, d):
    return N.latest_corrections(articles(spark, d), _cut(spark, d)).select("article_id", "url", "source_id")


def _context_sql(years: int, company: bool, late: str = "available") -> str:
    """Context of the articles moved by years; with company also issuer cues and relevant headlines."""
    moved = LATEST.replace("o_orderdate published_at", f"o_orderdate + interval {years} year published_at")
    heads2 = MACRO.replace("from heads where", "from heads2 where")
    near = "near as (select latest.*, o_custkey, o_orderkey from latest join heads using (article_id), cut where source_id <> 's3' and latest.published_at >= c - interval 48000 hour), heads2 as (select article_id, title from near)"
    more = f", {COMPANY.replace('from heads left', 'from near left')}, {RELEVANT}, ev as (select distinct article_id, ruleid, direction from macro union all select article_id, ruleid, direction from cues), rh as (select * from rel where named or technology)" if company else ", ev as (select distinct article_id, ruleid, direction from macro), rh as (select 'UNCERTAIN' classification from near where false)"
    return f"""with {moved}, {near}, {heads2}{more} select 'available' status, case when count(distinct direction) > 1 then 'MIXED' else max(direction) end classification, (select count(*) from near) considered, (select count(*) from near) - count(distinct article_id) unclassified, count(*) evidence,
        (select count(*) from rh) relevant, (select count(*) from rh where classification = 'UNCERTAIN') uncertain, 5::bigint sources, 4::bigint healthy, true partial from ev"""


def _context(spark, d, years: int, **kwargs):
    moved = lambda t: t + F.make_ym_interval(years=F.lit(years))
    a = articles(spark, d)
    a = a.withColumns({c: moved(F.col(c)) for c in ("published_at", "received_at", "first_observed_at", "assessed_at")})
    cut = F.lit(a.agg(F.max("published_at")).first()[0]) - F.expr("interval 30 days")
    h = spark.range(5).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.when(F.col("id") == 3, "error").otherwise("ok").alias("status"), cut.alias("checked_at"), cut.alias("last_success_at"), F.lit(300000).alias("max_age_ms"))
    return N.context(spark, a, h, cut, lookback_hours=48000, **{k: f(cut) for k, f in kwargs.items()})


@query(_context_sql(0, False))
def news_context(spark, d):
    """Context at one cutoff before the issuer registry's date, so that only macro rules speak; one of five sources is down."""
    return _context(spark, d, 0)


@query(_context_sql(32, True))
def news_context_companies(spark, d):
    """Context after the registry's date: issuers' cues, relevant and uncertain headlines too."""
    return _context(spark, d, 32)


@query("select 'stale' status, 'UNAVAILABLE' classification, 0::bigint considered, 0::bigint unclassified, 0::bigint evidence, 0::bigint relevant, 0::bigint uncertain, 5::bigint sources, 0::bigint healthy, true partial")
def news_context_stale(spark, d):
    """A snapshot ten minutes before the cutoff is not carried forward; sources that were checked later don't count."""
    return _context(spark, d, 0, observed=lambda c: c - F.expr("interval 10 minutes"))


@query("""with c as (select max(o_orderdate) - interval 30 day c from orders) select o_orderkey from orders, c where o_custkey % 5 <> 3 and o_orderdate - to_minutes((o_custkey % 7)::int * 600) <= c and o_orderdate between c and c + interval 24 hour""")
def scheduled_events(spark, d):
    """Orders as events: those known by the cutoff and due within a day, of sources that are up."""
    o = X.table(spark, d, "orders")
    t = F.col("o_orderdate").cast("timestamp")
    cut = F.lit(o.agg(F.max(t)).first()[0]) - F.expr("interval 30 days")
    e = o.select("o_orderkey", F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source_id"), (t - F.make_dt_interval(mins=(F.col("o_custkey") % 7 * 600).cast("int"))).alias("known_as_of"), t.alias("scheduled_at"))
    h = spark.range(5).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.when(F.col("id") == 3, "error").otherwise("ok").alias("status"), cut.alias("checked_at"), cut.alias("last_success_at"), F.lit(300000).alias("max_age_ms"))
    return N.scheduled_events(e, h, cut, cut).select("o_orderkey")


@query(r"""with p as (select page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) host from pages), c as (select *, regexp_replace(url, '#.*$', '') b from p),
    q as (select *, case when contains(b, '?') then split_part(b, '?', 1) else b end base, case when contains(b, '?') then string_split(substr(b, strpos(b, '?') + 1), '&') else [] end prm from c), k as (select *, list_filter(prm, lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=|$)')) keep from q)
    select page_id, case when regexp_matches(url, '^https://[^/@:?#]+([/?#]|$)') and host like '%.example.com' then base || case when len(keep) > 0 then '?' || array_to_string(keep, '&') else '' end end canonical from k""")
def canonical_urls(spark, d):
    p = X.table(spark, d, "pages")
    host = F.parse_url("url", F.lit("HOST"))
    hosts = F.when(F.endswith(host, F.lit(".example.com")), F.array(host)).otherwise(F.array())
    return p.select("page_id", N.safe_url(F.col("url"), hosts).alias("canonical"))


@query(r"""with p as (select page_id, url, case when page_id % 11 = 0 then page_id::varchar else 'news-' || sha256(page_id::varchar) end id, regexp_extract(html, '<title>(.*?)</title>', 1) title, regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1) summary from pages)
    select page_id, case when coalesce(not regexp_matches(id, '^news-[a-f0-9]{64}$'), true) then 'id' when coalesce(length(title) < 1 or length(title) > 600, true) then 'title' when regexp_matches(title, '[<>\x00-\x08\x0B\x0C\x0E-\x1F]') then 'title markup'
    when not coalesce(length(url) <= 2048 and regexp_matches(url, '^https://[^/@:?#]*\.example\.(com|net)(?:[/?#]|$)'), false) then 'url' when page_id % 13 = 0 then 'source' when page_id % 17 = 0 then 'assessed_at' when coalesce(length(summary) > 1600, true) then 'summary' when regexp_matches(summary, '[<>\x00-\x08\x0B\x0C\x0E-\x1F]') then 'summary markup' end problem from p""")
def snapshot_checks(spark, d):
    """Structural faults of articles that are made of pages: their titles, first paragraphs and urls."""
    p, at = X.table(spark, d, "pages"), F.lit("2026-01-01").cast("timestamp")
    part = lambda pattern: F.coalesce(F.regexp_extract("html", pattern, 1), F.lit("")).alias
    n = F.col("page_id")
    rows = p.select("page_id", "url", F.when(n % 11 == 0, n.cast("string")).otherwise(F.concat(F.lit("news-"), F.sha2(n.cast("string"), 256))).alias("article_id"), part("<title>(.*?)</title>")("title"), part("(?s)<p[^>]*>(.*?)</p>")("summary"), *[at.alias(c) for c in ("published_at", "received_at", "first_observed_at")], F.when(n % 17 != 0, at).alias("assessed_at"))
    host = F.parse_url("url", F.lit("HOST"))
    hosts = F.when(host.rlike(r"\.example\.(com|net)$"), F.array(host)).otherwise(F.array())
    return N.snapshot_problems(rows, hosts, n % 13 != 0).select("page_id", "problem")


@query("""select o_orderkey, case when o_orderkey % 19 = 0 then 'id' when o_orderkey % 5 = 0 then 'url' when o_orderkey % 7 = 0 then 'source' when o_orderstatus <> 'F' then 'status' when o_orderkey % 120 > 100 then 'forecast' end problem from orders""")
def event_checks(spark, d):
    """Structural faults of scheduled events that are made of orders."""
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", F.concat(F.when(k % 19 == 0, "x-").otherwise("event-"), F.sha2(k.cast("string"), 256)).alias("event_id"), F.concat_ws(" ", "o_orderpriority", k).alias("title"), F.concat(F.when(k % 5 == 0, "http").otherwise("https"), F.lit("://calendar.example.com/"), k).alias("url"), F.to_timestamp("o_orderdate").alias("scheduled_at"), F.to_timestamp("o_orderdate").alias("known_as_of"), F.when(F.col("o_orderstatus") == "F", N.SCHEDULED).otherwise("released").alias("status"), F.repeat(F.lit("9"), (k % 120).cast("int")).alias("forecast"), F.lit(None).cast("string").alias("previous"))
    return N.event_problems(rows, F.array(F.lit("calendar.example.com")), k % 7 != 0).select("o_orderkey", "problem")


@query(f"with {ARTICLES}, cut as (select max(published_at) - interval 30 day c from arts) select article_id from arts, cut where published_at <= c and coalesce(received_at <= c, true) and coalesce(first_observed_at <= c, true)")
def news_availability(spark, d):
    return N.available(articles(spark, d), _cut(spark, d)).select("article_id")
