"""Queries over documents and a few sentences that set off every arm of every classifier and extractor.

The SQL is written by hand from the rules as they are specified, not made from the library's tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import dates, html, text
from sedimenta.operators import articles, quality, rules, series
from sedimenta.operators import collections as coll

SENTENCES = [
    "Confirmed list sites of the GLS programme: 1,200 residential units and 3,500 sqm of commercial GFA, with 250 hotel rooms and 480 EC units for 1H2025",
    "Tender launch at Punggol Road: tender closes on 15 March 2025, 99 years, 12,500 sq ft of state property, 3+2 years",
    "Tender award for a site tender, 60+30 years lease until 2040", "Quarterly statistics show a price index of 187.5, up 1.5%, in Q3 2024", "Flash estimates: price update of -0.4%",
    "Private residential data", "Commercial space for business, shop and office", "Past sites", "Current GLS sites", "Master plan for urban planning", "Cooling measures and a policy change on ABSD and SSD stamp duty",
    "Build to order exercise: ballot of 4,000 flats", "Fresh start housing grant of $35,000 or $1,000, subsidy for families", "Enhanced grant of $80,000 for first-time buyers", "Proximity housing is near", "Resale transaction and selling", "Rental scheme",
    "Executive condominium in Tengah", "Community event for 300 residents and 20 households", "Land sales programme supply", "Upgrading, HIP and EASE improvement", "Compulsory acquisition of 3.5 hectares in Tampines Town with compensation by 2027",
    "Land betterment charge LBC revised", "Market data and statistics", "Private housing of 1,500 new units, completion expected in 2029", "Industrial area", "Costs are rising: 12.5% increase in steel, cement and labour costs from a supply chain under inflation",
    "Falling demand is a decrease of 3 change", "Improving at 0.75 m2 per manday, HDB at 0.82 m² per manday, private non-landed residential 0.61 m² per manday by automation and technology", "Declining productivity", "Mandatory requirement under the regulation", "Green Mark and Zero Energy standard BCA 2024_15",
    "Ang Mo Hawker Centre, Bedok Food Court and Pasir Panjang Wholesale Centre in Jurong Region", "Agricultural land parcel for farming in Lim Chu Kang and Sungei Tengah", "Jurong Fishery Port lease extension to 2031", "Land allocation by licensing SFA_2024_7 and SFA 2023 0123",
    "TDSR and LTV framework for a property loan, MSR too", "Bank and finance companies are prudent about risk; effective from 9 May 2024", "Lending by a bank, effective 31 February 2024", "Housing loan investor in private property", "Block 5 SG(238841)",
    "on 31 Feb 2024 and 2024-03-05", "on 2024-1-5", "on 15 jan 2024", "on 5/3/2024", "on 05-03-2024", "on 2024-01-05 or 1/2", "on Jan 5, 2024", "on 7 March 2023", "on 7 march 2023 and 3 Apr 2022", "on 12 September 2021 and 1999-12-31", "on 99/99/2024",
    "BTO flats", "Lease extension", "Licensing of stalls", "Tiong Hawker Centre", "Cooling of the market", "sfa_2024_7 in small letters", "Zero energy building", "hdb flats at 0.9 m2 per manday",
]
_ROWS = ", ".join(f"({-i - 1}, '{x}')" for i, x in enumerate(SENTENCES))
_ALL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_ROWS}) v(doc_id, text))"


def _few(s):
    return s.createDataFrame([(-i - 1, x) for i, x in enumerate(SENTENCES)], "doc_id long, text string")


def _texts(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").unionByName(_few(s))


def _field(name):
    return lambda s, d: _texts(s, d).select("doc_id", text.extract(F.col("text"), name).alias("value")).where("value is not null")


def _value(f):
    return lambda s, d: _texts(s, d).select("doc_id", f(F.col("text")).alias("value")).where("value is not null")


def _set(f):
    return lambda s, d: _texts(s, d).select("doc_id", F.array_join(f(F.col("text")), "|").alias("value")).where("value <> ''")


def _labels(name):
    return lambda s, d: coll.counts(_texts(s, d), rules.classify(F.col("text"), name), "label")


def _sql(expression: str, column: str = "text") -> str:
    return f"SELECT * FROM (SELECT doc_id, {expression} AS value FROM (SELECT doc_id, text, lower(text) AS low FROM {_ALL})) WHERE value IS NOT NULL AND value::VARCHAR <> ''"


def _group(pattern: str, kind: str = "VARCHAR", column: str = "text", g: int = 1) -> str:
    return f"try_cast(replace(nullif(regexp_extract({column}, '{pattern}', {g}), ''), ',', '') AS {kind})"


def _count(case: str) -> str:
    return f"SELECT coalesce(CASE {case} END, 'unknown') AS label, count(*) AS n FROM (SELECT coalesce(lower(text), '') AS l FROM {_ALL}) GROUP BY 1"


def _any(*terms: str) -> str:
    return "(" + " OR ".join(f"l LIKE '%{t}%'" for t in terms) + ")"


#: label by label, as the rules are written down
_CLASSES = {
    "ura_policy_type": f"WHEN {_any('gls', 'government land sales', 'land sales programme')} THEN 'gls_programme' WHEN {_any('tender launch', 'tender award', 'site tender')} THEN 'site_tender' WHEN {_any('quarterly statistics', 'price index', 'market data')} THEN 'market_statistics' WHEN {_any('flash estimates', 'price update')} THEN 'flash_estimates' WHEN {_any('master plan', 'urban planning')} THEN 'urban_planning' ELSE 'general_announcement'",
    "ura_category": f"WHEN {_any('land sales', 'gls', 'tender')} THEN 'land_supply' WHEN {_any('statistics', 'price index', 'market data')} THEN 'market_data' WHEN {_any('planning', 'master plan')} THEN 'urban_planning' ELSE 'policy_announcement'",
    "ura_data_subtype": f"WHEN {_any('quarterly')} THEN 'quarterly_statistics' WHEN {_any('flash')} THEN 'flash_estimates' WHEN {_any('private residential')} THEN 'private_residential_data' WHEN {_any('commercial')} THEN 'commercial_data' ELSE 'general_data'",
    "ura_land_subtype": f"WHEN {_any('current', 'gls sites')} THEN 'current_sites' WHEN {_any('tender')} THEN 'sites_for_tender' WHEN {_any('past')} THEN 'past_sites' ELSE 'general_land_sales'",
    "ura_sentiment": f"WHEN {_any('gls programme', 'land sales programme', 'quarterly statistics', 'price index')} THEN 'market_wide' WHEN {_any('tender launch', 'tender award')} THEN 'location_specific' WHEN {_any('cooling measures', 'policy change')} THEN 'policy_driven' ELSE 'moderate'",
    "hdb_policy_type": f"WHEN {_any('bto', 'build to order', 'ballot', 'launch')} THEN 'bto_launch' WHEN {_any('grant', 'subsidy', 'fresh start', 'enhanced')} THEN 'housing_grant' WHEN {_any('resale', 'selling', 'transaction')} THEN 'resale_policy' WHEN {_any('rental', 'rent', 'lease')} THEN 'rental_policy' WHEN {_any('ec', 'executive condominium', 'tender')} THEN 'ec_development' WHEN {_any('community', 'neighborhood', 'resident')} THEN 'community_development' WHEN {_any('commercial', 'business', 'shop')} THEN 'commercial_development' ELSE 'general_housing'",
    "hdb_grant_type": f"WHEN {_any('fresh start')} THEN 'fresh_start' WHEN {_any('enhanced')} AND {_any('grant')} THEN 'enhanced_grant' WHEN {_any('proximity')} THEN 'proximity_grant'",
    "mnd_policy_type": f"WHEN {_any('stamp duty', 'ssd', 'absd', 'cooling')} THEN 'cooling_measures' WHEN {_any('bto', 'ballot', 'launch')} THEN 'bto_policy' WHEN {_any('grant', 'subsidy', 'assistance')} THEN 'housing_grants' WHEN {_any('gls', 'land sales', 'supply')} THEN 'land_supply' WHEN {_any('upgrading', 'hip', 'ease', 'improvement')} THEN 'estate_upgrading' ELSE 'general_housing'",
    "sla_category": f"WHEN {_any('land acquisition', 'compulsory acquisition')} THEN 'land_acquisition' WHEN {_any('tender')} AND {_any('state property')} THEN 'state_property_development' WHEN {_any('land betterment charge', 'lbc')} THEN 'regulatory_update' WHEN {_any('statistics', 'data')} THEN 'market_data' ELSE 'general_announcement'",
    "sla_development": f"WHEN {_any('bto')} THEN 'BTO' WHEN {_any('private')} AND {_any('housing')} THEN 'private_housing' WHEN {_any('commercial')} THEN 'commercial' WHEN {_any('industrial')} THEN 'industrial'",
    "bca_outlook": f"WHEN {_any('increase', 'rising')} THEN 'inflationary_pressure' WHEN {_any('decrease', 'falling')} THEN 'deflationary_pressure' ELSE 'stable'",
    "bca_trend": f"WHEN {_any('improving', 'increase')} THEN 'improving' WHEN {_any('declining', 'decrease')} THEN 'declining' ELSE 'stable'",
    "bca_compliance": f"WHEN {_any('mandatory', 'requirement', 'standard', 'regulation')} THEN 'mandatory' ELSE 'voluntary'",
    "sfa_category": f"WHEN {_any('hawker centre', 'food court')} THEN 'food_infrastructure' WHEN {_any('agricultural land', 'farming')} THEN 'agricultural_land' WHEN {_any('wholesale centre', 'fishery port')} THEN 'wholesale_infrastructure' WHEN {_any('lease extension')} THEN 'lease_extension' ELSE 'general_announcement'",
    "sfa_policy_type": f"WHEN {_any('lease extension')} THEN 'lease_extension' WHEN {_any('land allocation', 'tender')} THEN 'land_allocation' WHEN {_any('licensing')} THEN 'licensing' ELSE 'announcement'",
    "sfa_policy_subtype": f"WHEN {_any('wholesale')} THEN 'wholesale_facilities' WHEN {_any('farming')} THEN 'farming_development' WHEN {_any('hawker')} THEN 'hawker_development' ELSE 'general'",
    "mas_subtype": f"WHEN {_any('absd')} THEN 'absd_adjustment' WHEN {_any('tdsr')} THEN 'tdsr_framework' WHEN {_any('cooling')} THEN 'cooling_measures' WHEN {_any('lending')} THEN 'lending_measures'",
}
_FLAGS = f"SELECT count_if({_any('bto', 'build to order', 'ballot', 'application', 'launch', 'exercise')})::BIGINT AS bto_related, count_if({_any('prudent', 'risk', 'stability', 'sustainable')})::BIGINT AS risk_management, count_if({_any('green mark')})::BIGINT AS green_building, count_if({_any('zero energy')})::BIGINT AS zero_energy FROM (SELECT lower(text) AS l FROM {_ALL})"

_NUMBER = r"(\d+(?:,\d+)*)"
_FIELDS = {
    "price_change_any": _group(r"(?i)(\d+\.?\d*)%?\s*(?:increase|decrease|change)", "DOUBLE"),
    "index_value": _group(r"(?i)index.*?(\d+\.?\d*)", "DOUBLE"),
    "overall_productivity": _group(r"(?i)(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"),
    "hdb_productivity": _group(r"(?i)hdb.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"),
    "private_productivity": _group(r"(?i)private.*?residential.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"),
    "land_size_hectares": _group(r"(\d+(?:\.\d+)?)\s*hectares?", "DOUBLE", "low"),
    "projected_units": _group(r"(\d+(?:,\d+)?)\s*(?:new\s+)?(?:bto\s+)?units?", "BIGINT", "low"),
    "completion_timeline": _group(r"(?:by\s+|completion\s+.*?)(\d{4})", "VARCHAR", "low"),
    "affected_residents": _group(r"(\d+)\s*(?:residents?|households?|families)", "BIGINT", "low"),
    "gfa_sqft": "CASE WHEN low LIKE '%tender%' THEN " + _group(r"(\d+(?:,\d+)?)\s*(?:sq\s*ft|square\s*feet)", "BIGINT", "low") + " END",
    "residential_units": _group(_NUMBER + r"\s*(?:private\s*)?residential\s*units?", "BIGINT", "low"),
    "commercial_gfa": _group(_NUMBER + r"\s*(?:sq\s*m|sqm|square\s*metres?)\s*(?:of\s*)?(?:commercial\s*)?gfa", "BIGINT", "low"),
    "hotel_rooms": _group(_NUMBER + r"\s*hotel\s*rooms?", "BIGINT", "low"),
    "ec_units": _group(_NUMBER + r"\s*ec\s*units?", "BIGINT", "low"),
    "price_change_percent": _group(r"([+-]?\d+\.?\d*)\s*%", "DOUBLE"),
    "tender_closing": _group(r"tender\s*(?:closes?|closing)\s*(?:on\s*)?(\d{1,2}\s+\w+\s+\d{4})", "VARCHAR", "low"),
    "lease_until": _group(r"(?i)(?:to|until)\s+(\d{4})"),
    "postal_code": _group(r"SG\((\d{6})\)"),
}
_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({0}[1:3]))"


def _day(pattern: str, y: int, m: int, d: int, flags: str = "(?i)", exact: bool = False, named: bool = False) -> str:
    part = lambda g: f"regexp_extract(text, '{flags}{pattern}', {g})"
    month = f"lpad({_MONTH.format(part(m))}::VARCHAR, 2, '0')" if named else f"lpad({part(m)}, 2, '0')"
    day = f"try_cast({part(y)} || '-' || {month} || '-' || lpad({part(d)}, 2, '0') AS DATE)"
    return f"CASE WHEN {part(m)} = upper({part(m)}[1:1]) || lower({part(m)}[2:]) THEN {day} END" if exact else f"CASE WHEN {part(0)} <> '' THEN {day} END"


_S, _L = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "(January|February|March|April|May|June|July|August|September|October|November|December)"
_SHORT, _LONG, _TIGHT, _LOOSE = rf"(\d{{1,2}})\s+{_S}\s+(\d{{4}})", rf"(\d{{1,2}})\s+{_L}\s+(\d{{4}})", r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
_SLASH, _DASH = r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{1,2})-(\d{1,2})-(\d{4})"
_DAYS = {
    "five": [_day(_SHORT, 3, 2, 1, named=True), _day(_LONG, 3, 2, 1, named=True), _day(_TIGHT, 1, 2, 3), _day(_SLASH, 3, 2, 1), _day(_DASH, 3, 2, 1)],
    "strict": [_day(_SHORT, 3, 2, 1, "", named=True), _day(_LONG, 3, 2, 1, "", named=True), _day(_TIGHT, 1, 2, 3, ""), _day(_SLASH, 3, 2, 1, "")],
    "titled": [_day(_SHORT, 3, 2, 1, exact=True, named=True), f"CASE WHEN NOT contains(text, '/') THEN {_day(_LOOSE, 1, 2, 3)} END", _day(_SLASH, 3, 2, 1), _day(_LONG, 3, 2, 1, exact=True, named=True)],
}


def _dated(dialect):
    return lambda s, d: _texts(s, d).select("doc_id", dates.find_date(F.col("text"), dialect).cast("string").alias("value")).where("value is not null")


def _hits(*patterns: str) -> str:
    """All matches of all patterns as a sorted set."""
    each = [f"regexp_extract_all(text, '{p}', {g})" for p, g in patterns]
    joined = each[0]
    for e in each[1:]:
        joined = f"list_concat({joined}, {e})"
    return f"array_to_string(list_sort(list_distinct({joined})), '|')"


def _terms(list_: str) -> str:
    return f"nullif(array_to_string(list_transform(list_filter({list_}, lambda k: contains(low, k)), lambda k: replace(k, ' ', '_')), '|'), '')"


def _found(terms):
    return lambda s, d: _texts(s, d).select("doc_id", F.array_join(text.found_terms(F.col("text"), terms), "|").alias("value")).where("value is not null")


def _article(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    url = F.concat(F.lit("https://a.b/"), F.col("doc_id").cast("string"))
    made = articles.article(docs, "URA", F.col("text"), url, F.lit("2025-01-01T00:00:00"), {"category": F.col("source"), "policy_type": rules.classify(F.col("text"), "ura_policy_type")})
    out = articles.completed(articles.recategorised(made, "press"), 500)
    return out.select("id", "source", "language", "extraction_method", "content_length", "word_count", "is_truncated", "original_length", F.md5("text").alias("text_md5"), "metadata.agency", "metadata.category", "metadata.policy_type")


_ARTICLE = f"""SELECT 'ura_' || substr(md5('https://a.b/' || doc_id), 1, 8) AS id, 'URA' AS source, 'en' AS language, 'web_scraping' AS extraction_method, coalesce(length(substr(text, 1, 500)), 0)::BIGINT AS content_length,
  coalesce(len(list_filter(regexp_split_to_array(substr(text, 1, 500), '\\s+'), lambda w: w <> '')), 0)::BIGINT AS word_count, coalesce(length(text) > 500, false) AS is_truncated, coalesce(length(text), 0)::BIGINT AS original_length, md5(substr(text, 1, 500)) AS text_md5,
  'URA' AS agency, 'press' AS category, CASE {_CLASSES['ura_policy_type']} END AS policy_type FROM (SELECT *, coalesce(lower(text), '') AS l FROM documents)"""


def _posts(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet").where("turn = 0 or turn = 1")
    rows = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.lit(1704067200) + F.col("conv_id") * 3600).cast("double").alias("created_utc"), F.concat(F.lit("/r/"), "conv_id").alias("permalink"), F.when(F.col("turn") == 0, F.col("role")).alias("author"))
    return articles.post(rows, "https://x.y", "forum", F.lit("2025-01-01")).select("id", "created_date", "permalink", "author", "source", "scraped_at")


def _children(s, d):
    nested = coll.nest(s.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", ["role"], 10, lambda c: c["role"] != "system")
    return nested.agg(F.sum(F.size("children")).cast("long").alias("n_children"), F.count(F.lit(1)).alias("n_parents"))


def _numbered(s, d):
    year = F.year("ts")
    return coll.numbered(s.read.parquet(f"{d}/events.parquet").select("event_id", "ts"), "event_id", year, "EV").select("event_id", "release_id")


def _series(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    return orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def _changes(s, d):
    rows = series.changes(_series(s, d), ["o_orderpriority"], "month", "v", 4)
    return rows.select("o_orderpriority", "month", F.round("change", 9).alias("change"))


def _union(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    both = coll.union_all(docs.select(F.col("doc_id").alias("id"), "lang"), s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), "url"))
    return both.groupBy("lang").agg(F.count("id").alias("n"), F.count("url").alias("urls"), F.count_distinct("id").alias("ids"))


def _target(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") % 7).alias("section"), "conv_id", "turn")
    more = turns.select((F.col("section") + 7).alias("section"), "conv_id", "turn")
    rows = coll.until_target(turns.where("section < 3").select("section", (F.col("conv_id") * 100 + F.col("turn")).alias("at")), more.select("section", (F.col("conv_id") * 100 + F.col("turn")).alias("at")), "section", "at", 400)
    return rows.groupBy("section", "part").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))


_TARGET = """WITH t AS (SELECT conv_id % 7 AS section, conv_id * 100 + turn AS pos FROM conversations), a AS (SELECT * FROM t WHERE section < 3), n AS (SELECT section, sum(count(*)) OVER (ORDER BY section) - count(*) AS b FROM a GROUP BY section),
u AS (SELECT  a.section, pos, 0 AS part FROM a JOIN n USING (section) WHERE b < 400 UNION ALL SELECT section + 7, pos, 1 FROM t WHERE (SELECT count(*) FROM a) < 400), k AS (SELECT * FROM u ORDER BY part, section, pos LIMIT 400)
SELECT section, part, count(*) AS n, max(pos) AS last FROM k GROUP BY ALL"""


def _pages_until(s, d):
    sizes = s.read.parquet(f"{d}/conversations.parquet").groupBy((F.col("conv_id") % 5).alias("section"), F.col("turn").alias("page")).agg(F.count_if(F.col("turn") % 4 != 3).alias("n"))
    return coll.until_empty(sizes, "section", "page", "n").select("section", "page", "n")


def _top(s, d):
    return s.read.parquet(f"{d}/documents.parquet").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


def _measured(s, d):
    t = F.col("text")
    return _texts(s, d).select("doc_id", text.slug(t).alias("slug"), F.md5(text.squeeze(t)).alias("squeezed"), F.array_join(text.places(t, ["ang mo", "bedok", "jurong"]), "|").alias("places"))


def _groups(s, d):
    g = rules.field_groups(F.col("text"))
    return _texts(s, d).select(g.alias("g")).agg(*[F.count_if(f"g.{k}").alias(k) for k in ("infrastructure", "land", "amenity")])


def _subtypes(s, d):
    kind = rules.classify(F.col("text"), "ura_policy_type")
    return coll.counts(_texts(s, d), rules.subtype(F.col("text"), kind), "label")


_SUBTYPES = f"""SELECT CASE kind WHEN 'gls_programme' THEN CASE WHEN {_any('confirmed list')} THEN 'confirmed_list' WHEN {_any('reserve list')} THEN 'reserve_list' ELSE 'programme_announcement' END
  WHEN 'site_tender' THEN CASE WHEN {_any('tender launch')} THEN 'tender_launch' WHEN {_any('tender award')} THEN 'tender_award' ELSE 'tender_update' END
  WHEN 'market_statistics' THEN CASE WHEN {_any('quarterly')} THEN 'quarterly_release' WHEN {_any('flash')} THEN 'flash_estimate' ELSE 'market_update' END ELSE 'general' END AS label, count(*) AS n
FROM (SELECT l, CASE {_CLASSES['ura_policy_type']} END AS kind FROM (SELECT coalesce(lower(text), '') AS l FROM {_ALL})) GROUP BY 1"""
def table() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    for name, case in _CLASSES.items():
        q[f"classify_{name}"] = (_labels(name), _count(case))
    q["flags"] = (lambda s, d: _texts(s, d).agg(*[F.count_if(text.keyword_any(F.col("text"), t)).alias(k) for k, t in rules.FLAGS.items()]), _FLAGS)
    q["classify_ura_subtype"] = (_subtypes, _SUBTYPES)
    q["classify_sla_policy"] = (lambda s, d: coll.counts(_texts(s, d), rules.sla_policy(F.col("text")), "label"), _count(f"WHEN {_any('land acquisition', 'compulsory acquisition')} THEN 'public_development' WHEN {_any('tender')} AND {_any('state property')} THEN 'adaptive_reuse' WHEN {_any('land betterment charge', 'lbc')} THEN 'fee_revision' WHEN {_any('statistics', 'data')} THEN 'statistical_release' ELSE 'information_update'"))
    q["field_groups"] = (_groups, f"SELECT count_if({_any('lease extension', 'wholesale centre', 'fishery port')})::BIGINT AS infrastructure, count_if({_any('agricultural land', 'farming', 'land parcel')})::BIGINT AS land, count_if({_any('hawker centre', 'food court', 'hdb')})::BIGINT AS amenity FROM (SELECT lower(text) AS l FROM {_ALL})")
    for name, sql in _FIELDS.items():
        q[f"extract_{name}"] = (_field(name), _sql(sql))
    q["extract_bca_id"] = (_value(lambda t: text.release_id(t, "BCA")), _sql(r"'BCA_' || nullif(regexp_extract(text, '(?i)BCA[_\s]*(\d{4})[_\s]*(\d+)', 1), '') || '_' || regexp_extract(text, '(?i)BCA[_\s]*(\d{4})[_\s]*(\d+)', 2)"))
    q["extract_sfa_id"] = (_value(lambda t: text.release_id(t, "SFA", r"[_\s]", 3, any_case=False)), _sql(r"CASE WHEN regexp_matches(text, 'SFA[_\s]\d{4}[_\s]\d+') THEN 'SFA_' || regexp_extract(text, 'SFA[_\s](\d{4})[_\s](\d+)', 1) || '_' || CASE WHEN length(regexp_extract(text, 'SFA[_\s](\d{4})[_\s](\d+)', 2)) < 3 THEN lpad(regexp_extract(text, 'SFA[_\s](\d{4})[_\s](\d+)', 2), 3, '0') ELSE regexp_extract(text, 'SFA[_\s](\d{4})[_\s](\d+)', 2) END END"))
    q["extract_reporting_period"] = (_value(text.reporting_period), _sql(r"'Q' || nullif(regexp_extract(text, 'Q(\d)\s*(\d{4})', 1), '') || '_' || regexp_extract(text, 'Q(\d)\s*(\d{4})', 2)"))
    q["extract_tenure_years"] = (_value(text.tenure_years), _sql(r"CASE WHEN low LIKE '%tender%' THEN nullif(concat_ws('+', nullif(regexp_extract(low, '(\d+)(?:\+(\d+))?\s*years?', 1), ''), nullif(regexp_extract(low, '(\d+)(?:\+(\d+))?\s*years?', 2), '')), '') END"))
    q["extract_gls_period"] = (_value(text.gls_period), _sql(r"upper(nullif(regexp_extract(low, '(\d+h\d{4})', 1), ''))"))
    q["extract_largest_amount"] = (_value(text.largest_amount), _sql(r"list_max(list_transform(regexp_extract_all(text, '\$(\d{1,3}(?:,\d{3})*)', 1), lambda x: replace(x, ',', '')::BIGINT))"))
    q["extract_location"] = (_value(text.location), _sql(r"coalesce(nullif(regexp_extract(text, '(?:at\s+|in\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)(?:\s+(?:Road|Street|Avenue|Drive|Lane|Park|Estate|Town|Area))', 1), ''), nullif(regexp_extract(text, '([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)\s+(?:development|project|site|area)', 1), ''))"))
    q["extract_effective_date"] = (_value(text.effective_date), _sql(r"strftime(try_strptime(regexp_replace(regexp_extract(low, 'effective\s+(?:from\s+)?(\d{1,2}\s+\w+\s+\d{4})', 1), '\s+', ' ', 'g'), '%d %B %Y'), '%Y-%m-%dT00:00:00+08:00')"))
    q["extract_facilities"] = (_set(lambda t: text.every(t, text.FACILITIES)), _sql(_hits((r"(?i)Pasir Panjang Wholesale Centre", 0), (r"(?i)Jurong Fishery Port", 0), (r"(?i)([A-Z][a-z]+ (?:Hawker Centre|Food Court|Market))", 1))))
    q["extract_regions"] = (_set(lambda t: text.every(t, text.REGIONS)), _sql(_hits((r"(?i)Pasir Panjang", 0), (r"(?i)Jurong", 0), (r"(?i)Lim Chu Kang", 0), (r"(?i)Sungei Tengah", 0), (r"(?i)([A-Z][a-z]+ (?:Town|Area|Region))", 1))))
    q["extract_named_places"] = (_set(lambda t: text.every(t, text.NAMED_PLACES)), _sql(_hits(("Lim Chu Kang", 0), ("Sungei Tengah", 0), ("Pasir Panjang", 0), ("Jurong", 0), ("[A-Z][a-z]+ [A-Z][a-z]+", 0))))
    q["found_materials"] = (_found(rules.MATERIALS), _sql(_terms("['steel', 'concrete', 'cement', 'sand', 'timber', 'labor', 'labour']")))
    q["found_cost_drivers"] = (_found(rules.COST_DRIVERS), _sql(_terms("['supply chain', 'material shortage', 'labor costs', 'inflation', 'demand']")))
    q["found_impacts"] = (_found(rules.IMPACTS), _sql(_terms("['developers', 'contractors', 'buyers', 'construction industry']")))
    q["found_efficiency"] = (_found(rules.EFFICIENCY), _sql(_terms("['automation', 'prefabrication', 'digitalization', 'planning', 'technology']")))
    q["institutions"] = (_value(lambda t: F.array_join(rules.institutions(t), "|")), _sql("CASE WHEN low LIKE '%bank%' AND low LIKE '%finance companies%' THEN 'banks|finance_companies' WHEN low LIKE '%bank%' THEN 'banks' END"))
    q["affected_measures"] = (_set(lambda t: text.labels(t, rules.MEASURES)), _sql("concat_ws('|', CASE WHEN low LIKE '%absd%' THEN 'ABSD' END, CASE WHEN low LIKE '%tdsr%' THEN 'TDSR' END, CASE WHEN low LIKE '%ltv%' THEN 'LTV' END, CASE WHEN low LIKE '%msr%' THEN 'MSR' END)"))
    q["borrower_segments"] = (_set(lambda t: text.labels(t, rules.BORROWERS)), _sql("concat_ws('|', CASE WHEN low LIKE '%private property%' THEN 'private_property' END, CASE WHEN low LIKE '%hdb%' THEN 'hdb_upgraders' END, CASE WHEN low LIKE '%first-time%' THEN 'first_time_buyers' END, CASE WHEN low LIKE '%investor%' THEN 'investors' END)"))
    q["compensation"] = (lambda s, d: _texts(s, d).where(text.keyword_any(F.col("text"), ["compensation"])).select("doc_id"), f"SELECT doc_id FROM {_ALL} WHERE lower(text) LIKE '%compensation%'")
    for dialect, days in _DAYS.items():
        q[f"date_{dialect}"] = (_dated(dialect), _sql(f"coalesce({', '.join(days)})::VARCHAR"))
    q["article_records"] = (_article, _ARTICLE)
    q["post_records"] = (_posts, "SELECT conv_id || '-' || turn AS id, strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id::BIGINT), '%Y-%m-%dT%H:%M:%S') AS created_date, 'https://x.y/r/' || conv_id AS permalink, CASE WHEN turn = 0 THEN coalesce(role, '[deleted]') ELSE '[deleted]' END AS author, 'forum' AS source, '2025-01-01' AS scraped_at FROM conversations WHERE turn IN (0, 1)")
    q["children_total"] = (_children, "SELECT count_if(role <> 'system')::BIGINT AS n_children, count(DISTINCT conv_id) AS n_parents FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) WHERE rn <= 10")
    q["numbered"] = (_numbered, "SELECT event_id, printf('EV_%d_%03d', year(ts), row_number() OVER (ORDER BY event_id)) AS release_id FROM events")
    q["series_changes"] = (_changes, "WITH v AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS v FROM orders GROUP BY ALL), b AS (SELECT *, lag(v, 4) OVER (PARTITION BY o_orderpriority ORDER BY month) AS b FROM v) SELECT o_orderpriority, month, round((v - b) / b, 9) AS change FROM b")
    q["series_summary"] = (lambda s, d: series.summary(_series(s, d), ["o_orderpriority"], "month", "v").select("o_orderpriority", F.round("average", 9).alias("average"), "last"), "WITH v AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, round(avg(v), 9) AS average, arg_max(v, month) AS last FROM v GROUP BY 1")
    q["distinct_files"] = (lambda s, d: series.distinct_files(s.read.parquet(f"{d}/pages.parquet").select("url", F.coalesce("html", F.lit("")).alias("content")), "content", "url").select("sha256", "url"), "SELECT sha256(coalesce(html, '')) AS sha256, min(url) AS url FROM pages GROUP BY 1")
    q["union_of_sources"] = (_union, "SELECT lang, count(id) AS n, count(url) AS urls, count(DISTINCT id) AS ids FROM (SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages) GROUP BY lang")
    q["until_target"] = (_target, _TARGET)
    q["until_empty_page"] = (_pages_until, "WITH p AS (SELECT conv_id % 5 AS section, turn AS page, count_if(turn % 4 <> 3)::BIGINT AS n FROM conversations GROUP BY ALL) SELECT section, page, n FROM p WHERE page < coalesce((SELECT min(page) FROM p x WHERE x.section = p.section AND x.n = 0), 1000000)")
    q["top_k"] = (_top, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
    q["measures"] = (_measured, r"SELECT doc_id, substr(lower(regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g')), 1, 30) AS slug, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, array_to_string(list_transform(list_filter(['ang mo', 'bedok', 'jurong'], lambda k: contains(lower(text), k)), lambda k: CASE k WHEN 'ang mo' THEN 'Ang Mo' WHEN 'bedok' THEN 'Bedok' ELSE 'Jurong' END), '|') AS places FROM " + _ALL)
    return q
