"""Queries whose inputs are made by Spark from the given tables: addresses, stamps, periods, series and records in many forms.

Forms vary with the row, so that every form meets every kind of value; the SQL goes back to the plain values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import dates, dom, html, text
from sedimenta.operators import articles, quality, rules, series
from sedimenta.plans.samples import _ALL, _CLASSES, _DAYS, _any, _group, _hits, _terms, _texts
from sedimenta.sources import sinks


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _form(key, n, *forms):
    """The form that the key picks; the last if it picks none."""
    out = forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        out = F.when(F.col(key) % n == i, f).otherwise(out)
    return out


_URLS = ["/news/1", "/notice/2", "/macroprudential", "/speech", "/parliamentary", "/NEWS", "/x"]


def _mas(s, d):
    rows = _texts(s, d).select(F.explode(F.array(*map(F.lit, _URLS))).alias("url"), "text")
    return rows.groupBy("url", rules.mas_policy(F.col("url"), F.col("text")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


_MAS = f"""SELECT url, CASE WHEN url LIKE '%media-release%' OR url LIKE '%news%' THEN concat_ws('/', 'policy_announcement', CASE {_CLASSES['mas_subtype']} END)
  WHEN url LIKE '%regulation%' OR url LIKE '%notice%' THEN concat_ws('/', 'regulatory_requirement', CASE WHEN {_any('tdsr')} THEN 'tdsr_computation' WHEN {_any('property loan')} THEN 'property_lending' WHEN {_any('housing loan')} THEN 'housing_lending' END)
  WHEN url LIKE '%macroprudential%' THEN 'macroprudential_policy/policy_framework' WHEN url LIKE '%parliamentary%' THEN 'policy_explanation/parliamentary_reply' WHEN url LIKE '%speech%' THEN 'policy_explanation/speech' END AS policy, count(*) AS n
FROM (SELECT coalesce(lower(text), '') AS l, unnest({_URLS}) AS url FROM {_ALL}) GROUP BY ALL"""
_KEYS = ["sfa_newsroom_1", "sfa_food_retail_2", "wholesale_3", "agricultural_4", "other"]


def _routes(s, d):
    rows = _texts(s, d).select("doc_id", rules.classify(F.col("text"), "sfa_category").alias("category"), F.explode(F.array(*map(F.lit, _KEYS))).alias("key"))
    return rows.select("doc_id", "key", rules.route(F.col("category"), F.col("key")).alias("bucket"))


_ROUTES = f"""SELECT doc_id, key, CASE WHEN c LIKE '%food_infrastructure%' OR key LIKE '%newsroom%' THEN 'newsroom' WHEN key LIKE '%food_retail%' THEN 'food_retail' WHEN c LIKE '%wholesale%' OR key LIKE '%wholesale%' THEN 'wholesale_markets'
  WHEN c LIKE '%agricultural%' OR key LIKE '%agricultural%' THEN 'agricultural_land' ELSE 'newsroom' END AS bucket FROM (SELECT doc_id, CASE {_CLASSES['sfa_category']} END AS c, unnest({_KEYS}) AS key FROM (SELECT doc_id, coalesce(lower(text), '') AS l FROM {_ALL}))"""
_KINDS = ["media_releases", "construction_data", "productivity_reports", "regulatory_updates", "other"]
_LISTS = ("key_materials", "cost_drivers", "industry_impact", "efficiency_factors")


def _bca(s, d):
    rows = _texts(s, d).select("doc_id", "text", F.explode(F.array(*map(F.lit, _KINDS))).alias("category")).select("doc_id", "category", rules.bca_fields(F.col("text"), F.col("category")).alias("m")).select("doc_id", "category", "m.*")
    return rows.withColumns({c: F.array_join(c, "|") for c in _LISTS})


def _if(kind: str, value: str, name: str) -> str:
    return f"CASE WHEN category = '{kind}' THEN {value} END AS {name}"


_BCA = "SELECT doc_id, category, " + ", ".join([
    "CASE category WHEN 'media_releases' THEN 'industry_announcement' WHEN 'construction_data' THEN 'market_data' WHEN 'productivity_reports' THEN 'industry_metrics' WHEN 'regulatory_updates' THEN 'regulatory_update' END AS policy_type",
    "CASE category WHEN 'media_releases' THEN 'media_release' WHEN 'construction_data' THEN 'price_index' WHEN 'productivity_reports' THEN 'productivity_index' WHEN 'regulatory_updates' THEN 'building_standards' END AS policy_subtype",
    _if(_KINDS[0], r"'BCA_' || nullif(regexp_extract(text, '(?i)BCA[_\s]*(\d{4})[_\s]*(\d+)', 1), '') || '_' || regexp_extract(text, '(?i)BCA[_\s]*(\d{4})[_\s]*(\d+)', 2)", "press_release_id"), _if(_KINDS[0], _group(r"(?i)(\d+\.?\d*)%?\s*(?:increase|decrease|change)", "DOUBLE"), "price_change_percent"),
    _if(_KINDS[0], _terms("['steel', 'concrete', 'cement', 'sand', 'timber', 'labor', 'labour']"), "key_materials"), _if(_KINDS[0], _terms("['supply chain', 'material shortage', 'labor costs', 'inflation', 'demand']"), "cost_drivers"), _if(_KINDS[0], _terms("['developers', 'contractors', 'buyers', 'construction industry']"), "industry_impact"),
    _if(_KINDS[1], r"'Q' || nullif(regexp_extract(text, 'Q(\d)\s*(\d{4})', 1), '') || '_' || regexp_extract(text, 'Q(\d)\s*(\d{4})', 2)", "reporting_period"), _if(_KINDS[1], _group(r"(?i)index.*?(\d+\.?\d*)", "DOUBLE"), "index_value"), _if(_KINDS[1], f"CASE {_CLASSES['bca_outlook']} END", "market_outlook"),
    _if(_KINDS[2], _group(r"(?i)(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"), "overall_productivity"), _if(_KINDS[2], _group(r"(?i)hdb.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"), "hdb_productivity"), _if(_KINDS[2], _group(r"(?i)private.*?residential.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", "DOUBLE"), "private_residential_productivity"),
    _if(_KINDS[2], f"CASE {_CLASSES['bca_trend']} END", "productivity_trend"), _if(_KINDS[2], _terms("['automation', 'prefabrication', 'digitalization', 'planning', 'technology']"), "efficiency_factors"),
    _if(_KINDS[3], f"CASE WHEN {_any('green mark')} THEN 'green_mark' END", "green_building_program"), _if(_KINDS[3], f"CASE WHEN {_any('zero energy')} THEN 'zero_energy_building' END", "sustainability_program"), _if(_KINDS[3], f"CASE {_CLASSES['bca_compliance']} END", "compliance_type"),
]) + f" FROM (SELECT doc_id, text, coalesce(lower(text), '') AS l, lower(text) AS low, unnest({_KINDS}) AS category FROM {_ALL})"


def _sfa(s, d):
    rows = _texts(s, d).select("doc_id", rules.sfa_fields(F.col("text"), F.col("doc_id") % 2 == 0).alias("m")).select("doc_id", "m.*")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("facilities", "regional_impact", "locations")})


_A, _B, _C = _any("lease extension", "wholesale centre", "fishery port"), _any("agricultural land", "farming", "land parcel"), _any("hawker centre", "food court", "hdb")
_ID = r"SFA[_\s](\d{4})[_\s](\d+)"
_SFA = "SELECT doc_id, " + ", ".join([
    f"CASE {_CLASSES['sfa_category']} END AS category", f"CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, '{_ID}') THEN 'SFA_' || regexp_extract(text, '{_ID}', 1) || '_' || CASE WHEN length(regexp_extract(text, '{_ID}', 2)) < 3 THEN lpad(regexp_extract(text, '{_ID}', 2), 3, '0') ELSE regexp_extract(text, '{_ID}', 2) END END AS press_release_id",
    f"CASE WHEN doc_id % 2 = 0 THEN CASE {_CLASSES['sfa_policy_type']} END END AS policy_type", f"CASE WHEN doc_id % 2 = 0 THEN CASE {_CLASSES['sfa_policy_subtype']} END END AS policy_subtype",
    f"{_A} AS infrastructure", f"CASE WHEN {_A} THEN " + _hits((r"(?i)Pasir Panjang Wholesale Centre", 0), (r"(?i)Jurong Fishery Port", 0), (r"(?i)([A-Z][a-z]+ (?:Hawker Centre|Food Court|Market))", 1)) + " END AS facilities", f"CASE WHEN {_A} THEN {_group(r'(?i)(?:to|until)\s+(\d{4})')} END AS lease_duration",
    f"CASE WHEN {_A} THEN 'food_distribution' END AS infrastructure_type", f"CASE WHEN {_A} THEN " + _hits((r"(?i)Pasir Panjang", 0), (r"(?i)Jurong", 0), (r"(?i)Lim Chu Kang", 0), (r"(?i)Sungei Tengah", 0), (r"(?i)([A-Z][a-z]+ (?:Town|Area|Region))", 1)) + " END AS regional_impact",
    f"CASE WHEN {_A} THEN true END AS supply_chain_security", f"CASE WHEN {_A} THEN true END AS long_term_commitment", f"{_B} AS land", f"CASE WHEN {_B} THEN " + _hits(("Lim Chu Kang", 0), ("Sungei Tengah", 0), ("Pasir Panjang", 0), ("Jurong", 0), ("[A-Z][a-z]+ [A-Z][a-z]+", 0)) + " END AS locations",
    f"CASE WHEN {_B} THEN 'agricultural' END AS land_use", *[f"CASE WHEN {_B} THEN true END AS {c}" for c in ("food_security", "rural_development", "regional_planning")], f"{_C} AS amenity", f"CASE WHEN {_C} THEN 'food_facility' END AS amenity_type",
    *[f"CASE WHEN {_C} THEN true END AS {c}" for c in ("residential_impact", "community_facilities", "quality_of_life")],
]) + f" FROM (SELECT doc_id, text, coalesce(lower(text), '') AS l FROM {_ALL})"


def _stamps(s, d):
    """Every event's time as four kinds of day, five of feed time, as epoch and as stored text."""
    at, wall = F.col("ts"), F.date_format("ts", "d MMM yyyy HH:mm:ss")
    day = _form("event_id", 5, F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "d MMMM yyyy"), F.date_format(at, "MMMM d, yyyy"), F.date_format(at, "d/M/yyyy"), F.lit("soon"))
    feed = _form("event_id", 6, F.concat(F.lit("Mon, "), wall, F.lit(" +0800")), F.concat(wall, F.lit(" GMT")), wall, F.concat(wall, F.lit(" -0330")), F.concat(wall, F.lit(" PDT")), F.concat(F.lit("Feb "), wall))
    iso = _form("event_id", 4, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("x"))
    epoch = F.unix_timestamp(at.cast("timestamp")).cast("double")
    rows = _read(s, d, "events").select("event_id", day.alias("day"), feed.alias("feed"), iso.alias("iso"), F.when(F.col("event_id") % 7 > 0, epoch).alias("epoch"))
    return rows.select("event_id", dates.parse_formats(F.col("day")).cast("string").alias("parsed"), dates.feed_time(F.col("feed")).alias("fed"), dates.from_epoch(F.col("epoch")).alias("created"), F.date_format(dates.wall_clock(F.col("iso")), "yyyy-MM-dd HH:mm:ss").alias("wall"))


_STAMPS = """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN ts::DATE::VARCHAR END AS parsed, strftime(ts + to_minutes(CASE event_id % 6 WHEN 0 THEN -480 WHEN 3 THEN 210 WHEN 4 THEN 420 ELSE 0 END), '%Y-%m-%dT%H:%M:%S+08:00') AS fed,
  CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS wall FROM events"""


def _slugs(s, d):
    slug = F.concat(F.lit("/pr-"), (2022 + F.col("page_id") % 4).cast("string"), F.lit("-"), F.col("page_id").cast("string"))
    page = F.concat("html", _form("page_id", 3, F.lit("<p>Mar 5, 2021</p>"), F.lit("<p>5 Mar 2021</p>"), F.lit("")))
    return _read(s, d, "pages").select("page_id", dates.slug_date(page, slug, F.lit("2025-01-01").cast("date")).cast("string").alias("day"))


def _periods(s, d):
    at = F.col("o_orderdate")
    form = _form("o_orderkey", 6, F.date_format(at, "yyyy-'Q'q"), F.date_format(at, "yyyyq'Q'"), F.date_format(at, "yyyy-MM"), F.date_format(at, "yyyy"), F.lit("na"), F.concat(F.date_format(at, "yyyy"), F.lit("-Q5")))
    return _read(s, d, "orders").select("o_orderkey", dates.period(form).cast("string").alias("day"))


def _spans(s, d):
    first, last = F.date_format("o_orderdate", "yyyy"), _form("o_orderkey", 4, F.lit("2001"), F.lit("1996"), F.lit("na"), F.date_format("o_orderdate", "yyyy"))
    return _read(s, d, "orders").select("o_orderkey", F.size(dates.year_span(first, last)).cast("long").alias("years"), F.get(dates.year_span(first, last), 0).alias("first"))


def _ingested(s, d):
    """Dates found in texts and sentences; the day of the run where there is none."""
    return _texts(s, d).select("doc_id", dates.find_date(F.col("text"), "five", F.lit("2025-01-01").cast("date")).cast("string").alias("day"))


_HREFS = ["/q", "e.html", "../e", "?p=2", "#top", "//x.y/z", "http://x.y/w", ""]


def _absolute(s, d):
    rows = _read(s, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, _HREFS))).alias("href"))
    return rows.select("page_id", "href", html.absolute(F.col("href"), F.col("url")).alias("absolute"))


_ABSOLUTE = f"""SELECT page_id, href, CASE href WHEN '/q' THEN root || '/q' WHEN 'e.html' THEN folder || 'e.html' WHEN '../e' THEN CASE WHEN folder = root || '/' THEN root || '/../e' ELSE regexp_replace(folder, '[^/]+/$', '') || 'e' END WHEN '?p=2' THEN path || '?p=2' WHEN '#top' THEN page || '#top'
  WHEN '//x.y/z' THEN scheme || '//x.y/z' WHEN '' THEN page ELSE href END AS absolute FROM (SELECT *, CASE WHEN path = root THEN root || '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM (SELECT page_id, unnest({_HREFS}) AS href, regexp_extract(url, '^https?:') AS scheme,
  regexp_extract(url, '^https?://[^/?#]*') AS root, regexp_replace(url, '#.*$', '') AS page, regexp_replace(url, '[?#].*$', '') AS path FROM pages))"""


def _selected(s, d):
    """What the flat expressions find in each page: anchors by their text, a string node, the first and all selectors, containers by class, kinds of links."""
    h = F.col("html")
    hrefs, saying = F.transform(html.anchors(h), lambda a: a["href"]), F.transform(html.anchors_saying(h, "(?i)^(the|de|la)"), lambda a: a["href"])
    none = F.array().cast("array<string>")
    return _read(s, d, "pages").select(
        "page_id", F.array_join(saying, "|").alias("saying"), F.array_join(html.first_selector([none, saying, hrefs]), "|").alias("first"), F.array_join(html.every_selector([saying, hrefs]), "|").alias("every"), F.md5(F.get(html.by_class(h, "AD"), 0)).alias("boxed"),
        html.text_node(h, "^(The|De|La) ").alias("node"), html.link_kind(F.concat(F.get(hrefs, 0), _form("page_id", 2, F.lit(".PDF"), F.lit("")))).alias("kind"), F.md5(html.blocks(h, "li|h1", 3)).alias("blocks"), F.md5(html.blocks(h, "table", 3, 5)).alias("fallback"),
    )


_LINKS = r"list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>'), lambda x: {{'href': regexp_extract(x, 'href=\"([^\"]*)\"', 1), 'text': regexp_extract(x, '>([^<]*)<', 1)}})".replace("{{", "{").replace("}}", "}").replace('\\"', '"')
_PLAIN = r"list_filter(list_transform({0}, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) > {1})"
_SELECTED = rf"""SELECT page_id, array_to_string(saying, '|') AS saying, array_to_string(CASE WHEN len(saying) > 0 THEN saying ELSE hrefs END, '|') AS first, array_to_string(list_concat(d, list_filter(hrefs_d, lambda x: NOT list_contains(d, x))), '|') AS every,
  md5(regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1)) AS boxed, list_filter(regexp_split_to_array(html, '<[^>]*>'), lambda x: regexp_matches(x, '^(The|De|La) '))[1] AS node, CASE WHEN page_id % 2 = 0 THEN 'PDF' ELSE 'webpage' END AS kind,
  md5(array_to_string({_PLAIN.format(r"regexp_extract_all(html, '(?is)<(?:li>.*?</li>|h1>.*?</h1>)')", 3)}, chr(10) || chr(10))) AS blocks, md5(array_to_string({_PLAIN.format(r"regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)", 5)}, chr(10) || chr(10))) AS fallback
FROM (SELECT *, list_transform(range(1, len(saying) + 1), lambda i: CASE WHEN list_position(saying, saying[i]) = i THEN saying[i] END) AS d0, list_filter(list_transform(range(1, len(saying) + 1), lambda i: CASE WHEN list_position(saying, saying[i]) = i THEN saying[i] END), lambda x: x IS NOT NULL) AS d,
  list_filter(list_transform(range(1, len(hrefs) + 1), lambda i: CASE WHEN list_position(hrefs, hrefs[i]) = i THEN hrefs[i] END), lambda x: x IS NOT NULL) AS hrefs_d
  FROM (SELECT *, list_transform(a, lambda x: x.href) AS hrefs, list_transform(list_filter(a, lambda x: regexp_matches(x.text, '(?i)^(the|de|la)')), lambda x: x.href) AS saying FROM (SELECT *, {_LINKS} AS a FROM pages)))"""


def _meta(s, d):
    """A description whose attributes stand in either order, and dates in an attribute, a text, or in no format that is known."""
    about = _form("page_id", 2, F.concat(F.lit('<meta name="description" content="'), "url", F.lit('">')), F.concat(F.lit('<meta content="'), "url", F.lit("\" name='description'>")))
    dated = _form("page_id", 4, F.lit('<div class="news date">7 March 2023</div>'), F.lit('<span class="date">soon</span><time datetime="2024-02-29">x</time>'), F.lit("<time>March 9, 2022</time>"), F.lit(""))
    n = F.col("nodes")
    rows = dom.with_nodes(_read(s, d, "pages").select("page_id", F.concat(about, "html", dated).alias("html")))
    found = dom.stamps(n, [dom.Selector(cls="date"), dom.Selector(cls="publish-date"), dom.Selector(("time",)), dom.Selector(attr="datetime")])
    days = F.filter(F.transform(found, lambda t: dates.parse_formats(F.trim(t))), lambda x: x.isNotNull())
    return rows.select("page_id", dom.attribute(n, dom.Selector(("meta",), attr="name", value="description"), "content").alias("about"), F.get(days, 0).cast("string").alias("day"))


_META = "SELECT page_id, url AS about, CASE page_id % 4 WHEN 0 THEN '2023-03-07' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '2022-03-09' END AS day FROM pages"


def _wide(s, d):
    """Counts of orders by priority (with their total), a column for each quarter; na for none, separators in numbers."""
    rows = _read(s, d, "orders").withColumn("q", F.date_format("o_orderdate", "yyyyq'Q'"))
    quarters = [r.q for r in rows.select("q").distinct().orderBy("q").collect()]  # headers of the table: one for each quarter
    counts = rows.withColumn("o_orderpriority", F.explode(F.array("o_orderpriority", F.lit("Total")))).groupBy("o_orderpriority").pivot("q", quarters).agg(F.sum(F.when(F.col("o_totalprice") > 300000, F.round("o_totalprice").cast("long"))).alias("v"))
    shown = [F.coalesce(F.format_number(F.col(q), 0), F.lit("na")).alias(q) for q in quarters]
    return counts.select(F.when(F.col("o_orderpriority") == "Total", "Total").otherwise(F.concat(F.lit("    "), "o_orderpriority")).alias("DataSeries"), *shown)


def _unpivoted(s, d):
    return series.unpivoted(_wide(s, d), "DataSeries").select(F.trim("DataSeries").alias("name"), "period", F.col("first_day").cast("string").alias("day"), "value")


_UNPIVOTED = """WITH o AS (SELECT o_orderpriority, year(o_orderdate) || '' || quarter(o_orderdate) || 'Q' AS period, CASE WHEN o_totalprice > 300000 THEN round(o_totalprice) END AS v FROM orders),
 q AS (SELECT DISTINCT period FROM o), n AS (SELECT DISTINCT o_orderpriority AS p FROM o UNION ALL SELECT NULL) SELECT coalesce(p, 'Total') AS name, period, make_date(period[1:4]::INTEGER, period[5:5]::INTEGER * 3 - 2, 1)::VARCHAR AS day,
 (SELECT sum(v) FROM o WHERE o.period = q.period AND (p IS NULL OR o_orderpriority = p)) AS value FROM q, n"""


def _lines(s, d):
    """A file for each brand: its parts below their types, indented; subtotals between."""
    parts = _read(s, d, "part").select("p_brand", "p_type", "p_name").distinct()
    types = parts.select("p_brand", "p_type", F.lit("").alias("p_name")).distinct()
    brands = parts.select("p_brand", F.lit("").alias("p_type"), F.lit("").alias("p_name")).distinct()
    rows = parts.unionByName(types).unionByName(brands)
    label = F.when(F.col("p_type") == "", F.concat(F.lit("All "), "p_brand")).when(F.col("p_name") == "", F.concat(F.lit("    "), "p_type")).otherwise(F.concat(F.lit("        "), "p_name"))
    return rows.select(F.col("p_brand").alias("file"), F.concat_ws("/", "p_type", "p_name").alias("row_no"), label.alias("DataSeries"))


_LINES = "l AS (SELECT DISTINCT p_brand AS file, p_type, p_name FROM part UNION SELECT p_brand, p_type, '' FROM part UNION SELECT p_brand, '', '' FROM part)"


def _tree(s, d):
    return series.hierarchy(_lines(s, d), "DataSeries", "row_no", file="file").select("file", "row_no", "level", "name", "parent")


def _drift(s, d):
    rows = _read(s, d, "orders").groupBy(F.year("o_orderdate").alias("shs")).agg(F.count(F.lit(1)).alias("old_age_depndency_ratio"))
    return series.renamed(rows)


def _violations(s, d):
    k = F.col("doc_id")
    rows = _read(s, d, "documents").select(
        "doc_id", F.when(k % 20 == 0, k + 1).when(k % 33 == 0, None).otherwise(k).cast("string").alias("id"), F.lit("web").alias("source"), F.concat(_form("doc_id", 7, F.lit("ftp://x/"), F.lit("https://x/")), k.cast("string")).alias("url"), F.when(k % 41 != 0, F.col("text")).alias("content"),
        F.when(k % 3 > 0, (k % 9).cast("double")).alias("rating"), F.when(k % 5 > 0, (k % 50) / 20 - 1.1).alias("score"), _form("doc_id", 13, F.lit("soon"), F.lit("2024-02-29T10:00:00")).alias("scraped_at"), F.when(k % 4 > 0, (k % 12) / 10).alias("quality_score"),
    )
    flags = quality.flags(F.col("id").isNull(), F.length("content") < 200, F.contains("content", F.lit("the")), F.lit(False))
    return quality.violations(rows).select("doc_id", F.array_join(F.array_sort("violations"), "|").alias("violations"), F.array_join(flags, "|").alias("flags"))


_VIOLATIONS = """WITH r AS (SELECT doc_id AS k, CASE WHEN doc_id % 20 = 0 THEN doc_id + 1 WHEN doc_id % 33 = 0 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 41 <> 0 THEN text END AS content FROM documents)
SELECT k AS doc_id, concat_ws('|', CASE WHEN k % 13 = 0 THEN 'date' END, CASE WHEN NOT coalesce(length(content) >= 20, false) THEN 'length' END, CASE WHEN k % 4 > 0 AND k % 12 = 11 THEN 'quality' END, CASE WHEN k % 3 > 0 AND k % 9 NOT BETWEEN 1 AND 5 THEN 'rating' END,
  CASE WHEN id IS NULL OR content IS NULL THEN 'required' END, CASE WHEN k % 5 > 0 AND (k % 50 < 2 OR k % 50 > 42) THEN 'sentiment' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'unique_id' END, CASE WHEN k % 7 = 0 THEN 'url' END) AS violations,
  concat_ws('|', CASE WHEN id IS NULL THEN 'duplicate' END, CASE WHEN length(content) < 200 THEN 'low_length' END, CASE WHEN content LIKE '%the%' THEN 'keyword_match' END) AS flags FROM r"""


def _maps(s, d):
    base = F.create_map(F.lit("type"), "event_type", F.lit("k"), F.lit("none"))
    later = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string")))
    rows = _read(s, d, "events").select("event_id", articles.merged_metadata(base, later).alias("m"))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("merged"), articles.map_get(F.col("m"), "user", "nobody").alias("user"), F.to_json(F.struct(articles.map_get(F.col("m"), "k", "0").alias("k"))).alias("k"))


_MAPS = """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'k=' || json_extract_string(props, '$.k') || '|type=' || event_type || '|user=' || user_id ELSE 'k=none|type=' || event_type END AS merged,
  CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR ELSE 'nobody' END AS user, '{"k":"' || CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') ELSE 'none' END || '"}' AS k FROM events"""


def _kept(s, d):
    """Records with what they must have: fields, least lengths by source, an address of a pattern; a missing time stays, a wrong one goes."""
    t, k = F.col("text"), F.col("doc_id")
    least = F.when(F.col("source") == "web", 200).when(F.col("lang") == "en", 100).otherwise(20)
    url = F.concat(_form("doc_id", 3, F.lit("/press-release/"), F.lit("/news/"), F.lit("/about/")), k.cast("string"))
    day = F.when(k % 17 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")))
    rows = _read(s, d, "documents").select("doc_id", t, "source", "lang", url.alias("url"), day.alias("day"))
    return rows.where(F.col("source").isNotNull() & (t != "") & (F.length(t) >= least) & F.col("url").rlike("/(press-release|news)/") & dates.in_range(F.col("day"), "2024-01-05", "2024-02-10")).select("doc_id", F.col("day").cast("string").alias("day"))


_KEPT = """SELECT doc_id, CASE WHEN doc_id % 17 > 0 THEN (DATE '2024-01-01' + (doc_id % 60)::INTEGER)::VARCHAR END AS day FROM documents WHERE source IS NOT NULL AND text <> '' AND length(text) >= CASE WHEN source = 'web' THEN 200 WHEN lang = 'en' THEN 100 ELSE 20 END
  AND doc_id % 3 < 2 AND (doc_id % 17 = 0 OR doc_id % 60 BETWEEN 4 AND 40)"""


def _named(s, d):
    """Ids of each form: dated, long, and the names of a run's outputs."""
    names = sinks.run_names("web", "20250921_174426")
    rows = _read(s, d, "pages").select("page_id", text.stable_id("hdb", F.col("url"), day=F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))).alias("dated"), text.stable_id("mnd", F.col("url"), 16).alias("long"))
    return rows.withColumn("files", F.lit("|".join(names.values())))


_NAMED = "SELECT page_id, 'hdb_' || strftime(DATE '2024-01-01' + (page_id % 366)::INTEGER, '%Y%m%d') || '_' || substr(md5(url), 1, 8) AS dated, 'mnd_' || substr(md5(url), 1, 16) AS long, 'web_20250921_174426|web_20250921|web_stats' AS files FROM pages"


def table() -> dict[str, tuple]:
    return {
        "mas_policy": (_mas, _MAS),
        "route": (_routes, _ROUTES),
        "bca_fields": (_bca, _BCA),
        "sfa_fields": (_sfa, _SFA),
        "stamps": (_stamps, _STAMPS),
        "slug_dates": (_slugs, "SELECT page_id, CASE page_id % 4 WHEN 1 THEN '2023-06-01' WHEN 2 THEN '2024-06-01' ELSE '2025-01-01' END AS day FROM pages"),
        "periods": (_periods, "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 1 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 2 THEN date_trunc('month', o_orderdate)::DATE WHEN 3 THEN date_trunc('year', o_orderdate)::DATE END::VARCHAR AS day FROM orders"),
        "year_spans": (_spans, "SELECT o_orderkey, coalesce(greatest(b - a + 1, 0), 0) AS years, CASE WHEN a <= b THEN a END::INTEGER AS first FROM (SELECT o_orderkey, year(o_orderdate) AS a, CASE o_orderkey % 4 WHEN 0 THEN 2001 WHEN 1 THEN 1996 WHEN 2 THEN NULL ELSE year(o_orderdate) END AS b FROM orders)"),
        "date_or_run": (_ingested, f"SELECT doc_id, coalesce({', '.join(_DAYS['five'])}, DATE '2025-01-01')::VARCHAR AS day FROM (SELECT doc_id, text, lower(text) AS low FROM {_ALL})"),
        "absolute_links": (_absolute, _ABSOLUTE),
        "page_selectors": (_selected, _SELECTED),
        "page_meta": (_meta, _META),
        "unpivoted": (_unpivoted, _UNPIVOTED),
        "hierarchy": (_tree, f"WITH {_LINES} SELECT file, CASE WHEN p_name = '' THEN p_type || '/' ELSE p_type || '/' || p_name END AS row_no, (CASE WHEN p_type = '' THEN 0 WHEN p_name = '' THEN 1 ELSE 2 END)::INTEGER AS level, CASE WHEN p_type = '' THEN 'All ' || file WHEN p_name = '' THEN p_type ELSE p_name END AS name, CASE WHEN p_type = '' THEN NULL WHEN p_name = '' THEN 'All ' || file ELSE p_type END AS parent FROM l"),
        "detail_rows": (lambda s, d: series.detail(_lines(s, d), "DataSeries").groupBy("file").agg(F.count(F.lit(1)).alias("n")), f"WITH {_LINES} SELECT file, count(*) AS n FROM l WHERE p_type <> '' GROUP BY file"),
        "header_drift": (_drift, "SELECT year(o_orderdate)::INTEGER AS shs_year, count(*) AS old_age_dependency_ratio FROM orders GROUP BY 1"),
        "violations": (_violations, _VIOLATIONS),
        "map_fields": (_maps, _MAPS),
        "kept_records": (_kept, _KEPT),
        "names": (_named, _NAMED),
    }
