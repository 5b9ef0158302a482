"""Rule tables of the headline operators. Word lists, patterns, issuers and routes must be what users know.

Users extend behaviour by adding rows to these, or by giving DataFrames of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words of rising and falling, and subjects.
RISES = "(?:rise[sn]?|rose|rising|climbs?|climbed|climbing|surges?|surged|surging|jumps?|jumped|jumping|rallies|rallied|rally|gains?|gained)"
FALLS = "(?:falls?|fell|falling|drops?|dropped|dropping|declines?|declined|declining|slides?|slid|sliding|slumps?|slumped|retreats?|retreated)"
OIL = r"\b(?:oil(?: prices?)?|(?:brent|wti)(?: crude)?(?: prices?)?|crude(?: oil)?(?: prices?)?)\s+(?:(?:prices?|futures)\s+)?(?:(?:is|are|were|was)\s+)?"
YIELDS = r"\b(?:treasury|u\.?s\.? treasury|government bond) yields?\s+(?:(?:is|are|were|was)\s+)?"
PRICES = r"\b(?:inflation|cpi|pce|consumer prices?|producer prices?)\b[^;.!?]{0,45}\b"
FED = r"\b(?:fed|federal reserve|fomc)\s+"
RATES = r"\s+(?:(?:its|the|benchmark|interest|policy|key|federal|funds)\s+){0,5}rates?\b"

# Fixed values: (rule, direction, pattern), in order.
MACRO = (
    ("oil-rising-cost-pressure", "HEADWIND", OIL + RISES + r"\b"),
    ("oil-falling-cost-relief", "TAILWIND", OIL + FALLS + r"\b"),
    ("yields-rising-funding-pressure", "HEADWIND", YIELDS + "(?:" + RISES + r"|hits? (?:a )?(?:new )?(?:\d+-year high|highest level))\b"),
    ("yields-falling-funding-relief", "TAILWIND", YIELDS + FALLS + r"\b"),
    ("inflation-hotter-than-expected", "HEADWIND", PRICES + r"(?:hotter|higher|above)[ -]+(?:than[ -]+)?(?:expected|expectations|forecast)\b|\b(?:hotter|higher)[ -]+than[ -]+expected[ -]+(?:inflation|cpi|pce)\b"),
    ("inflation-cooler-than-expected", "TAILWIND", PRICES + r"(?:cooler|lower|below)[ -]+(?:than[ -]+)?(?:expected|expectations|forecast)\b|\b(?:cooler|lower)[ -]+than[ -]+expected[ -]+(?:inflation|cpi|pce)\b"),
    ("fed-actual-rate-hike", "HEADWIND", FED + "(?:raises?|raised|hikes?|hiked|increases?|increased)" + RATES),
    ("fed-actual-rate-cut", "TAILWIND", FED + "(?:cuts?|cut|lowers?|lowered|reduces?|reduced)" + RATES),
    ("tariffs-raised-cost-pressure", "HEADWIND", r"\b(?:raises?|raised|increases?|increased|hikes?|hiked|imposes?|imposed)\s+(?:(?:new|additional|higher|import)\s+){0,3}tariffs?\b|\btariffs?\s+(?:(?:are|were|have been)\s+)?(?:raised|increased|hiked|imposed)\b"),
    ("tariffs-reduced-cost-relief", "TAILWIND", r"\b(?:cuts?|cut|lowers?|lowered|reduces?|reduced|removes?|removed|lifts?|lifted)\s+(?:(?:the|existing|import)\s+){0,3}tariffs?\b|\btariffs?\s+(?:(?:are|were|have been)\s+)?(?:cut|lowered|reduced|removed|lifted)\b"),
)
HEDGED = r"\b(?:not|never|no longer|denies|denied|unlikely|without|may|might|could|would|will|should|if|predicts?|predicted|expects? to|expected to|forecasts? to|forecasted to|set to|poised to|likely to|hopes? to|seeks? to)\b"
CLAUSES = r"(?i);|\b(?:but|while|however|although)\b"

# Fixed values for company cues.
COMPANY_HEDGED = r"\b(?:not|never|no longer|denies?|denied|unlikely|without|may|might|could|would|will|should|if|rumou?rs?|reportedly|considers?|considering|plans? to|seeks? to|aims? to|expected to|expects? to|set to|poised to)\b"
RETROSPECTIVE = r"^(?:why|how|explainer|lessons? from|looking back)\b|\b(?:last year|last month|years? ago|historical|in retrospect|back in|in 20\d{2}|during 20\d{2})\b"
COMPANY_CLAUSES = r"(?i);|\b(?:but|while|however|although|whereas|despite|as)\b"
GUIDANCE = r"\s+(?:(?:its|full-year|quarterly|annual|revenue|profit|earnings|sales|EPS)\s+){0,5}(?:guidance|outlook|forecast)\b"
REPORTS = r"^(?:(?:reports?|reported|posts?|posted)\s+)?(?:(?:quarterly|annual|first-quarter|second-quarter|third-quarter|fourth-quarter|Q[1-4])\s+)?(?:earnings|revenue|profit|sales|EPS|results)\s+"
AGAINST = r"\s+(?:(?:analyst|analysts'|Wall Street)\s+)?(?:estimates|expectations|forecasts)\b"
DEMAND = r"(?:(?:AI|cloud|chip|data.center|customer)\s+){0,3}demand"
COMPANY = (
    ("company-guidance-raised", "TAILWIND", "^(?:raises?|raised|lifts?|lifted|increases?|increased|boosts?|boosted)" + GUIDANCE),
    ("company-guidance-lowered", "HEADWIND", "^(?:cuts?|cut|lowers?|lowered|reduces?|reduced|slashes?|slashed|withdraws?|withdrew)" + GUIDANCE),
    ("company-outlook-disappoints", "HEADWIND", r"^(?:(?:revenue|profit|earnings|sales|EPS)\s+)?(?:guidance|outlook|forecast)\s+(?:falls? short|disappoints?|misses? (?:estimates|expectations)|below (?:estimates|expectations))\b"),
    ("company-earnings-beat", "TAILWIND", REPORTS + "(?:beat|beats|exceed|exceeds|exceeded|above|ahead of)" + AGAINST + r"|^(?:beats?|beat)\s+(?:(?:earnings|revenue|profit|sales|EPS)\s+)?(?:estimates|expectations|forecasts)\b"),
    ("company-earnings-miss", "HEADWIND", REPORTS + "(?:miss|misses|missed|below|fall short of)" + AGAINST + r"|^(?:misses?|missed)\s+(?:(?:earnings|revenue|profit|sales|EPS)\s+)?(?:estimates|expectations|forecasts)\b"),
    ("company-demand-strength", "TAILWIND", r"^(?:reports?|reported|sees?|saw)\s+(?:stronger|strong|record|surging|growing|accelerating)\s+" + DEMAND + r"\b|^" + DEMAND + r"\s+(?:grows?|grew|surges?|surged|accelerates?|accelerated|strengthens?|strengthened)\b"),
    ("company-demand-weakness", "HEADWIND", r"^(?:reports?|reported|sees?|saw)\s+(?:weaker|weak|slowing|falling|declining|softening)\s+" + DEMAND + r"\b|^" + DEMAND + r"\s+(?:falls?|fell|weakens?|weakened|slows?|slowed|declines?|declined)\b"),
    ("company-operational-disruption", "HEADWIND", r"^(?:reports?|reported|confirms?|confirmed|suffers?|suffered|hit by|is hit by|faces?)\s+(?:(?:a|an|major|global|cloud|service|widespread|customer)\s+){0,4}(?:outage|cyberattack|ransomware attack|data breach|security breach|service disruption)\b|^(?:cloud|services?|platform)\s+(?:is |are )?(?:offline|down|hit by (?:an? )?outage)\b"),
    ("company-regulatory-pressure", "HEADWIND", r"^(?:faces?|faced|hit by|is hit by)\s+(?:(?:a|an|new|EU|US|U\.S\.|antitrust|regulatory|federal)\s+){0,4}(?:probe|investigation|lawsuit|fine|export ban|export restrictions?)\b|^(?:halts?|halted|suspends?|suspended|stops?|stopped)\s+(?:(?:its|AI|chip|GPU|China)\s+){0,4}(?:shipments|exports)\b"),
    ("company-operational-recovery", "TAILWIND", r"^(?:restores?|restored|resumes?|resumed)\s+(?:(?:its|cloud|online|customer|normal)\s+){0,3}(?:services?|operations|shipments)\s+(?:after|following)\s+(?:(?:a|an|the|major|global)\s+){0,3}(?:outage|disruption|halt)\b"),
)
PREFIX = (
    ("company-export-restriction", "HEADWIND", r"\b(?:bans?|banned|restricts?|restricted|blocks?|blocked)\s+(?:(?:AI|chip|semiconductor)\s+)?exports?\s+(?:by|from|of)\s*$"),
    ("company-regulatory-action", "HEADWIND", r"\b(?:fines?|fined|sues?|sued|investigates?|investigated)\s*$"),
    ("company-regulatory-approval", "TAILWIND", r"\b(?:FDA|regulator)\s+(?:approves?|approved)\s*$"),
)
INDUSTRY = (
    ("industry-ai-chip-demand-strength", "TAILWIND", r"\b(?:AI chip|semiconductor|GPU) demand\s+(?:grows?|grew|surges?|surged|accelerates?|accelerated)\b"),
    ("industry-ai-chip-demand-weakness", "HEADWIND", r"\b(?:AI chip|semiconductor|GPU) demand\s+(?:weakens?|weakened|slows?|slowed|falls?|fell|declines?|declined)\b"),
    ("industry-chip-export-restriction", "HEADWIND", r"\b(?:tightens?|tightened|imposes?|imposed|expands?|expanded)\s+(?:new\s+)?(?:(?:AI|chip|semiconductor)\s+){1,3}export (?:controls?|restrictions?|ban)\b"),
    ("industry-chip-export-relief", "TAILWIND", r"\b(?:eases?|eased|lifts?|lifted|removes?|removed)\s+(?:(?:AI|chip|semiconductor)\s+){1,3}export (?:controls?|restrictions?|ban)\b"),
)
OWN_CLAUSE = r"^(?:its\s+)?(?:earnings|revenue|profit|sales|EPS|results|guidance|outlook|AI demand|cloud demand)\b"
# Topics of company headlines (name, pattern) in order, and what makes a headline relevant or a computing topic without an issuer.
TOPICS = (
    ("Earnings / guidance", r"\b(?:earnings|revenue|profit|sales|EPS|guidance|outlook|results|forecast)\b"),
    ("AI / computing", r"\b(?:AI|artificial intelligence|generative AI|data centers?|datacenters?|GPU|GPUs|accelerators?|chatgpt|openai)\b"),
    ("Semiconductors", r"\b(?:chips?|semiconductors?|GPU|GPUs|accelerators?|chipmaking|foundry)\b"),
    ("Investment / spending", r"\b(?:capex|capital expenditure|spending|investment|invests?|investing|funding)\b"),
    ("Cyber / outages", r"\b(?:cyberattack|ransomware|data breach|security breach|outage|offline|service disruption)\b"),
    ("Regulation / trade", r"\b(?:regulator|regulatory|antitrust|lawsuit|fines?|FDA|approval|export (?:ban|controls?|restrictions?|licenses?)|tariffs?)\b"),
    ("Company developments", r"\b(?:acquisition|acquires?|merger|deal|contract|orders?|shipments?|demand|launch(?:es)?|unveils?|recall|bankruptcy|dividend|buyback|repurchase|CEO|resigns?|layoffs?)\b"),
)
OTHER_COMPANY, OTHER_TECHNOLOGY = "Company developments", "AI / technology"
ECOSYSTEM = r"\b(?:AI|artificial intelligence|OpenAI|ChatGPT|Anthropic|semiconductors?|chipmakers?|technology sector|tech sector|cloud computing)\b"
COMPUTING = r"\b(?:AI|artificial intelligence|OpenAI|ChatGPT|Anthropic|machine learning|semiconductors?|chipmakers?|GPUs?|cloud computing|technology sector|tech sector)\b"

# Issuers (ticker, sector, aliases), and what must not follow a mention of one.
ISSUERS = (
    ("NVDA", "XLK", ("Nvidia",)),
    ("AAPL", "XLK", ("Apple",)),
    ("MSFT", "XLK", ("Microsoft",)),
    ("AMZN", "XLY", ("Amazon", "Amazon Web Services", "AWS")),
    ("GOOGL", "XLC", ("Alphabet", "Google")),
    ("META", "XLC", ("Meta Platforms", "Facebook", "Instagram")),
    ("TSLA", "XLY", ("Tesla",)),
    ("JPM", "XLF", ("JPMorgan", "JPMorgan Chase")),
    ("XOM", "XLE", ("ExxonMobil", "Exxon Mobil")),
    ("WMT", "XLP", ("Walmart",)),
    ("CAT", "XLI", ("Caterpillar",)),
    ("LLY", "XLV", ("Eli Lilly",)),
)
FALSE_FRIENDS = {
    "AAPL": r"\s+(?:growers?|orchards?|crops?|harvest|pie|juice|cider|fruit)\b",
    "AMZN": r"\s+(?:river|rainforest|basin|jungle)\b",
    "META": r"-(?:analysis|analyses|study|data)\b",
    "CAT": r"\s+(?:infestation|larvae|larva|insects?)\b",
}
#: Registry facts may not be used before this time.
REGISTRY_FROM = "2026-10-01 00:00:00"

# Routes (rule, targets, expected sign); company and industry rules go to the issuer's sector.
ALL = ("XLK", "XLF", "XLY", "XLP", "XLE", "XLU", "XLV", "XLI", "XLB", "XLRE", "XLC")
ROUTES = (
    ("oil-rising-cost-pressure", ("USO",), 1),
    ("oil-falling-cost-relief", ("USO",), -1),
    ("yields-rising-funding-pressure", ("TNX",), 1),
    ("yields-falling-funding-relief", ("TNX",), -1),
    ("inflation-hotter-than-expected", ALL, -1),
    ("inflation-cooler-than-expected", ALL, 1),
    ("fed-actual-rate-hike", ALL, -1),
    ("fed-actual-rate-cut", ALL, 1),
    ("tariffs-raised-cost-pressure", ("XLI", "XLY", "XLB"), -1),
    ("tariffs-reduced-cost-relief", ("XLI", "XLY", "XLB"), 1),
)


#: Lower-case letters one of which any match of a pattern must hold, by the start of a rule's name; rules without hints are tried on every text.
HINTS = {
    "oil-": ("oil", "brent", "wti", "crude"),
    "yields-": ("yield",),
    "inflation-": ("inflation", "cpi", "pce", "price"),
    "fed-": ("fed", "fomc"),
    "tariffs-": ("tariff",),
    "company-export-restriction": ("export",),
    "company-regulatory-action": ("fine", "sue", "investigate"),
    "company-regulatory-approval": ("approve",),
    "industry-ai-chip-demand": ("demand",),
    "industry-chip-export": ("export",),
}
TOPIC_HINTS = (
    ("earnings", "revenue", "profit", "sales", "eps", "guidance", "outlook", "results", "forecast"),
    ("ai", "artificial", "data", "gpu", "accelerator", "chatgpt"),
    ("chip", "semiconductor", "gpu", "accelerator", "foundry"),
    ("cap", "spending", "invest", "funding"),
    ("attack", "ransomware", "breach", "outage", "offline", "disruption"),
    ("regulator", "antitrust", "lawsuit", "fine", "fda", "approval", "export", "tariff"),
    ("acqui", "merger", "deal", "contract", "order", "shipment", "demand", "launch", "unveil", "recall", "bankruptcy", "dividend", "buyback", "repurchase", "ceo", "resign", "layoff"),
)
ECOSYSTEM_HINTS = ("ai", "artificial", "chatgpt", "anthropic", "semiconductor", "chipmaker", "sector", "cloud")
CLAUSE_HINTS = (";", "but", "while", "however", "although")
COMPANY_CLAUSE_HINTS = (*CLAUSE_HINTS, "whereas", "despite", "as")


def rule_rows(rules=MACRO) -> list[dict]:
    """Rules as rows; a DataFrame with these columns (hints may be missing) serves as well wherever rows are taken."""
    hints = lambda r: next((h for k, h in HINTS.items() if r.startswith(k)), None)
    return [{"nth": k, "rule": r, "direction": d, "pattern": f"(?i){p}", "hints": hints(r)} for k, (r, d, p) in enumerate(rules)]


def topic_rows() -> list[tuple[str, str, tuple[str, ...]]]:
    return [(n, p, h) for (n, p), h in zip(TOPICS, TOPIC_HINTS, strict=True)]


def issuer_rows() -> list[dict]:
    rows = []
    for ticker, sector, aliases in ISSUERS:
        names = [(rf"\Q{a}\E", a.lower()) for a in aliases] + [(rf"(?:\$|(?:NASDAQ|NYSE|AMEX)\s*:\s*)\Q{ticker}\E", ticker.lower())]
        stop = f"(?!{FALSE_FRIENDS[ticker]})" if ticker in FALSE_FRIENDS else ""
        rows += [{"ticker": ticker, "sector": sector, "pattern": rf"(?i)(?<![A-Za-z0-9])(?:{n})(?![A-Za-z0-9]){stop}", "hints": (hint,)} for n, hint in names]
    return rows


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t, s) for r, ts, s in ROUTES for t in ts], "rule string, target string, expected int")
