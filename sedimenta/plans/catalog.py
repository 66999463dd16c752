"""The registered queries over the reference's operators, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import dates, html, text
from sedimenta.operators import collections as coll
from sedimenta.operators import grouped, quality, rules
from sedimenta.plans import derived, pages, records, samples, scale

VOCABULARY = ["license", "apache", "rent", "ec", "ease", "token", "reserved", "lease", "data", "condo"]
TIERS = [("high", ["license", "apache"]), ("medium", ["reserved", "token"]), ("low", ["rent", "ease"])]
GAZETTEER = ["rent", "eden", "erin", "tines", "otation", "mit"]
CLASSES = [("legal", ["license", "apache", "reserved"]), ("housing", ["rent", "lease", "ease"]), ("estate", ["ec"])]
LABELS = {"legal": ["license", "reserved"], "rental": ["rent", "lease"], "digital": ["token", "data"]}
_LIST = "[" + ", ".join(f"'{t}'" for t in VOCABULARY) + "]"
_TAGS = f"list_filter({_LIST}, lambda k: contains(lower(text), k))"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _T():
    """The column text; made when asked for, as columns need a session."""
    return F.col("text")


def _minimum(s, d):
    rows = _docs(s, d).where(text.keyword_any(_T(), VOCABULARY)).select(rules.first_match(_T(), CLASSES, "other").alias("class"), F.length("text").alias("n"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_length"))


def _followed(s, d):
    """A link list in which addresses repeat and some lead nowhere, then the pages."""
    pages = _pages(s, d)
    links = pages.where("page_id % 3 <> 0").select("url")
    return coll.follow_links(links.unionByName(links).unionByName(links.select(F.concat("url", F.lit("#gone")).alias("url"))), pages, "url").select("page_id", "url")


def _truncated(cut, m=300):
    return lambda s, d: _docs(s, d).select("doc_id", F.md5(getattr(text, cut)(_T(), m)).alias("cut_md5"), (F.length("text") > m).alias("is_truncated"))


def _links(s, d):
    return _pages(s, d).select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("seq", "a")).select("page_id", "url", "seq", "a.href", "a.text")


_ANCHORS = """SELECT page_id, url, unnest(range(len(m))) AS seq, unnest(list_transform(m, lambda x: regexp_extract(x, '(?is)href="([^"]*)"', 1))) AS href
FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS m FROM pages)"""
_CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _t in html.DROPPED:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', ' ', 'g')"
_PLAIN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _quality(s, d):
    """Length from the text, source from its name, sentiment from marks, location from the gazetteer, recency from the id."""
    n, low = F.length("text"), F.coalesce(F.regexp_count("text", F.lit("[!?]")), F.lit(0))
    length = quality.steps(n, [(1000, 1.0), (200, 0.7), (20, 0.3)], 0.0)
    source = quality.steps(F.length("source"), [(5, 1.0), (4, 0.8)], 0.5)
    sentiment, location = quality.steps(-low, [(0, 1.0), (-3, 0.6)], 0.2), F.when(text.keyword_any(_T(), GAZETTEER), 1.0).otherwise(0.0)
    recency = quality.steps(F.col("doc_id") % 100, [(66, 1.0), (33, 0.5)], 0.1)
    return _docs(s, d).select("doc_id", F.round(quality.quality_score(length, source, sentiment, location, recency), 6).alias("quality_score"))


def _nested(s, d):
    rows = coll.nest(_turns(s, d), "conv_id", "turn", ["role", "text"], 10, lambda c: c["text"] != "[deleted]")
    return rows.select("conv_id", F.size("children").cast("long").alias("n_children"), F.get("children", 0)["role"].alias("first_role"))


def _early(s, d):
    sizes = _turns(s, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.col("conv_id") % 5)
    return grouped.until_enough(sizes, "section", "conv_id", "n", 50).select("section", "conv_id", "n")


def _events_deduped(s, d):
    rows = coll.last_value_first_place(_events(s, d).select("user_id", "event_id", "value"), "user_id", "event_id")
    return rows.select("user_id", "value", "place")


def _dates(s, d):
    line = F.concat(F.lit("Posted on "), F.date_format("ts", "d MMM yyyy"), F.lit(" by x"))
    return _events(s, d).select("event_id", dates.find_date(line).cast("string").alias("day"), dates.find_date(F.date_format("ts", "dd/MM/yyyy"), "strict").cast("string").alias("slashed"))


_RATIO = "CASE WHEN length(text) >= 1000 THEN 1.0 WHEN length(text) >= 200 THEN 0.7 WHEN length(text) >= 20 THEN 0.3 ELSE 0.0 END"


def _table():
    q: dict[str, tuple] = {}
    q["minimum_slice"] = (_minimum, f"SELECT {rules.case_sql('text', CLASSES, 'other')} AS class, count(*) AS n_docs, avg(length(text)) AS avg_length FROM documents WHERE {rules.any_sql('text', VOCABULARY)} GROUP BY 1")
    q["keyword_filter"] = (lambda s, d: _docs(s, d).where(text.keyword_any(_T(), VOCABULARY)).select("doc_id"), f"SELECT doc_id FROM documents WHERE {rules.any_sql('text', VOCABULARY)}")
    q["keyword_tiers"] = (lambda s, d: _docs(s, d).select("doc_id", text.tier(_T(), TIERS).alias("tier")), f"SELECT doc_id, {rules.case_sql('text', TIERS, 'none')} AS tier FROM documents")
    q["ordered_tags"] = (lambda s, d: _docs(s, d).select("doc_id", F.array_join(text.tags(_T(), VOCABULARY, 3), "|").alias("tags")), f"SELECT doc_id, array_to_string({_TAGS}[1:3], '|') AS tags FROM documents")
    q["tag_set"] = (lambda s, d: _docs(s, d).select("doc_id", F.array_join(text.tag_set(_T(), VOCABULARY), "|").alias("tags")), f"SELECT doc_id, array_to_string(list_sort({_TAGS}), '|') AS tags FROM documents")
    q["first_place"] = (lambda s, d: _docs(s, d).select("doc_id", text.first_place(_T(), GAZETTEER).alias("place")), f"SELECT doc_id, CASE {' '.join(f'''WHEN contains(lower(text), '{g}') THEN '{g.title()}' ''' for g in GAZETTEER)} END AS place FROM documents")
    q["label_set"] = (lambda s, d: _docs(s, d).select("doc_id", F.array_join(text.labels(_T(), LABELS), "|").alias("labels")), "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {rules.any_sql('text', t)} THEN '{k}' END" for k, t in LABELS.items()) + ") AS labels FROM documents")
    q["tag_counts"] = (lambda s, d: coll.array_counts(_docs(s, d), text.tags(_T(), VOCABULARY, None), "tag"), f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM documents) GROUP BY tag")
    q["length_stats"] = (
        lambda s, d: _docs(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_length"), F.sum(F.length("text")).alias("total_length"), F.sum(text.word_count(_T())).alias("words"), F.count_if(F.length("text") > 3000).alias("long_docs")),
        f"SELECT lang, count(*) AS n, avg(length(text)) AS avg_length, sum(length(text))::BIGINT AS total_length, sum({_WORDS})::BIGINT AS words, count_if(length(text) > 3000)::BIGINT AS long_docs FROM documents GROUP BY lang",
    )
    q["source_totals"] = (lambda s, d: coll.with_total(_docs(s, d), "source"), "SELECT source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
    q["truncate_sentences"] = (_truncated("cut_sentences"), r"""SELECT doc_id, length(text) > 300 AS is_truncated, md5(CASE WHEN length(text) <= 300 THEN text WHEN regexp_extract(substr(text, 1, 300), '(?s)^.*\. ') <> ''
      THEN regexp_replace(regexp_extract(substr(text, 1, 300), '(?s)^.*\. '), '^\s+|\s+$', '', 'g') ELSE regexp_replace(substr(text, 1, 297) || '...', '^\s+|\s+$', '', 'g') END) AS cut_md5 FROM documents""")
    stop = r"length(regexp_extract(substr(text, 201, 100), '(?s)^[^.!?]*[.!?]'))"
    q["truncate_late_stop"] = (_truncated("cut_late_stop"), rf"SELECT doc_id, length(text) > 300 AS is_truncated, md5(CASE WHEN length(text) <= 300 THEN text WHEN {stop} > 0 THEN regexp_replace(substr(text, 1, 200 + {stop}), '^\s+|\s+$', '', 'g') ELSE regexp_replace(substr(text, 1, 300), '^\s+|\s+$', '', 'g') END) AS cut_md5 FROM documents")
    p, sp = r"(length(regexp_extract(substr(text, 1, 300), '(?s)^.*\. ')) - 2)", "(length(regexp_extract(substr(text, 1, 300), '(?s)^.* ')) - 1)"
    q["truncate_late_sentence"] = (_truncated("cut_late_sentence"), f"SELECT doc_id, length(text) > 300 AS is_truncated, md5(CASE WHEN length(text) <= 300 THEN text WHEN {p} > 240 THEN substr(text, 1, {p} + 1) WHEN {sp} > 0 THEN substr(text, 1, {sp}) ELSE substr(text, 1, 300) END) AS cut_md5 FROM documents")
    q["exact_dedup"] = (lambda s, d: coll.first_value(_docs(s, d).select("doc_id", F.md5("text").alias("text_md5")), "text_md5", "doc_id"), "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY 2")
    q["title_cascade"] = (lambda s, d: _pages(s, d).select("page_id", html.first_element(F.col("html"), ("h1", "title", "h2")).alias("title")), "SELECT page_id, coalesce(" + ", ".join(f"nullif(regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '')" for t in ("h1", "title", "h2")) + ") AS title FROM pages")
    q["page_text"] = (lambda s, d: _pages(s, d).select("page_id", F.md5(html.text(html.drop(F.col("html")))).alias("text_md5")), f"SELECT page_id, md5({_PLAIN}) AS text_md5 FROM pages")
    q["page_parts"] = (lambda s, d: _pages(s, d).agg(F.count_if(html.has(F.col("html"), "table")).alias("tables"), F.count_if(html.has(F.col("html"), "img")).alias("images")), r"SELECT count_if(regexp_matches(html, '(?i)<table\b'))::BIGINT AS tables, count_if(regexp_matches(html, '(?i)<img\b'))::BIGINT AS images FROM pages")
    q["anchors"] = (lambda s, d: _links(s, d).select("page_id", F.col("seq").cast("long").alias("seq"), "href"), f"SELECT page_id, seq, href FROM ({_ANCHORS})")
    q["limit_then_filter"] = (lambda s, d: coll.limit_then_filter(_links(s, d), ["page_id"], "seq", 4, F.contains("href", F.lit("th"))).select("page_id", "href"), f"SELECT page_id, href FROM ({_ANCHORS}) WHERE seq < 4 AND contains(href, 'th')")
    q["filter_then_limit"] = (lambda s, d: coll.filter_then_limit(_links(s, d), ["page_id"], "seq", 2, F.contains("href", F.lit("th"))).select("page_id", "href"), f"SELECT page_id, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS rn FROM ({_ANCHORS}) WHERE contains(href, 'th')) WHERE rn <= 2")
    q["stable_ids"] = (lambda s, d: _pages(s, d).select("page_id", text.stable_id("web", F.col("url")).alias("id")), "SELECT page_id, 'web_' || substr(md5(url), 1, 8) AS id FROM pages")
    q["date_range"] = (lambda s, d: _events(s, d).where(dates.in_range(F.col("ts").cast("date"), "2024-01-05", "2024-01-09")).select("event_id"), "SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
    q["find_dates"] = (_dates, "SELECT event_id, ts::DATE::VARCHAR AS day, ts::DATE::VARCHAR AS slashed FROM events")
    q["json_fields"] = (lambda s, d: _events(s, d).groupBy(F.coalesce(F.get_json_object("props", "$.k").cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n")), "SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS k, count(*) AS n FROM events GROUP BY 1")
    q["monthly_trend"] = (lambda s, d: _events(s, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts")), "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM events GROUP BY 1, 2")
    q["keyed_dedup"] = (_events_deduped, "SELECT user_id, arg_max(value, event_id) AS value, min(event_id) AS place FROM events GROUP BY user_id")
    q["weighted_limit"] = (lambda s, d: grouped.weighted_limit(_docs(s, d), "lang", "doc_id", {"en": 0.4, "fr": 0.35, "de": 0.15, "es": 0.1}).select("lang", "doc_id"), "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= floor(20 * CASE lang WHEN 'en' THEN 0.4::DOUBLE WHEN 'fr' THEN 0.35::DOUBLE WHEN 'de' THEN 0.15::DOUBLE WHEN 'es' THEN 0.1::DOUBLE ELSE 0 END)")
    q["early_stop"] = (_early, "SELECT section, conv_id, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY section ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT conv_id, conv_id % 5 AS section, count(*) AS n FROM conversations GROUP BY conv_id)) WHERE b < 50")
    q["nested_children"] = (_nested, "SELECT conv_id, count(*) AS n_children, arg_min(role, turn) AS first_role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 10 GROUP BY conv_id")
    q["quality_score"] = (_quality, f"""SELECT doc_id, round({_RATIO} * 0.2::DOUBLE + CASE WHEN length(source) >= 5 THEN 1.0 WHEN length(source) >= 4 THEN 0.8 ELSE 0.5 END * 0.3::DOUBLE
      + CASE WHEN n = 0 THEN 1.0 WHEN n <= 3 THEN 0.6 ELSE 0.2 END * 0.2::DOUBLE + CASE WHEN {rules.any_sql('text', GAZETTEER)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN doc_id % 100 >= 66 THEN 1.0 WHEN doc_id % 100 >= 33 THEN 0.5 ELSE 0.1 END * 0.15::DOUBLE, 6) AS quality_score
      FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[!?]')), 0) AS n FROM documents)""")
    q["follow_links"] = (_followed, "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 <> 0)")
    return q | samples.table() | pages.table() | scale.table() | records.table() | derived.table()


def queries():
    return {k: v[0] for k, v in _table().items()}


def oracle_sql():
    return {k: v[1] for k, v in _table().items() if v[1]}


def flagship(spark, sf_dir):
    return _minimum(spark, sf_dir)
