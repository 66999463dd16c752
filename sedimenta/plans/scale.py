"""Queries over large vocabularies, link fixpoints and running sums in hot groups, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import frontier, grouped, vocabulary


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _words(s, d):
    """Every word of the conversations with six letters or more, the longest first."""
    words = _read(s, d, "conversations").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("length(term) >= 6").distinct()
    return words.withColumn("rank", -F.length("term").cast("long"))


_WORDS = r"words AS MATERIALIZED (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM conversations) WHERE length(term) >= 6)"
_PAIRS = "pairs AS MATERIALIZED (SELECT doc_id, term FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN words ON contains(low, term))"


def _docs(s, d):
    return _read(s, d, "documents").select("doc_id", "text")


def _tags(s, d):
    rows = vocabulary.with_terms(_docs(s, d), _words(s, d), name="tags", most=10)
    return rows.select("doc_id", F.array_join("tags", "|").alias("tags"))


def _name(word):
    """The name under which a page or a link is known: a word's letters in lower case."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}]", "")


def _graph(s, d):
    """Links found in the pages, by the word at the end of their absolute address; pages are known by the first word of their title."""
    pages = _read(s, d, "pages")
    links = frontier.links_of(pages, "page_id", "url", name=lambda url: _name(F.regexp_extract(url, "[^/]*$", 0)), keep=lambda url: url.rlike("^https?://[^/]+/[^/]+$"))
    title = F.regexp_extract("html", r"(?is)<h1\b[^>]*>\s*(\S*?)(?:\s|</h1>)", 1)
    return pages, links, frontier.known_pages(pages, "page_id", _name(title))


def _followed(s, d):
    """Anchor, absolute address, page: a row for each link that leads to a page."""
    _, links, known = _graph(s, d)
    return links.join(known.withColumnRenamed("page", "to_page"), "target").select("page", "target", "to_page")


def _crawl(s, d):
    """From all pages of the first host by name."""
    pages, links, known = _graph(s, d)
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    hosts = pages.select(F.col("page_id").alias("page"), host.alias("host"))
    first = hosts.agg(F.min("host").alias("host"))
    return frontier.crawl(hosts.join(F.broadcast(first), "host"), links, known, 12)


_GRAPH = r"""links AS MATERIALIZED (
  SELECT DISTINCT page_id AS page, target FROM (SELECT page_id, regexp_replace(lower(regexp_extract(h, '[^/]*$')), '[^\p{L}]', '', 'g') AS target FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS h FROM pages) WHERE regexp_matches(h, '^/[^/]+$')) WHERE target <> ''
), known AS MATERIALIZED (
  SELECT target, min(page_id) AS page FROM (SELECT page_id, regexp_replace(lower(regexp_extract(html, '(?is)<h1\b[^>]*>\s*(\S*?)(?:\s|</h1>)', 1)), '[^\p{L}]', '', 'g') AS target FROM pages) WHERE target <> '' GROUP BY target
)"""


def _events(s, d):
    return _read(s, d, "events").select("event_id", "event_type", "ts", "value")


def _numbered(s, d):
    return grouped.numbered_in(_events(s, d), ["event_type"], "event_id", start=0).select("event_id", F.concat_ws("_", "event_type", "turn").alias("id"))


def _running(s, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return grouped.running(_events(s, d), ["event_type"], "event_id", {"before": cents}).select("event_id", "event_type", "before")


def table() -> dict[str, tuple]:
    return {
        "vocabulary_rows": (lambda s, d: vocabulary.term_rows(_docs(s, d), _words(s, d)), f"WITH {_WORDS}, {_PAIRS} SELECT doc_id, term FROM pairs"),
        "vocabulary_tags": (_tags, f"WITH {_WORDS}, {_PAIRS} SELECT doc_id, coalesce(array_to_string(list(term ORDER BY length(term) DESC, term) FILTER (term IS NOT NULL), '|'), '') AS tags FROM documents LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) <= 10) USING (doc_id) GROUP BY doc_id"),
        "vocabulary_counts": (lambda s, d: vocabulary.term_counts(_docs(s, d), _words(s, d)), f"WITH {_WORDS}, {_PAIRS} SELECT term, count(doc_id) AS n FROM words LEFT JOIN pairs USING (term) GROUP BY term"),
        "followed_links": (_followed, f"WITH {_GRAPH} SELECT links.page, target, known.page AS to_page FROM links JOIN known USING (target)"),
        "crawl": (_crawl, f"""WITH RECURSIVE {_GRAPH}, edges AS MATERIALIZED (SELECT DISTINCT links.page, known.page AS next FROM links JOIN known USING (target)), hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages),
  walk AS (SELECT page_id AS page, 0 AS depth FROM hosts WHERE host = (SELECT min(host) FROM hosts) UNION SELECT next, depth + 1 FROM walk JOIN edges USING (page) WHERE depth < 12) SELECT page, min(depth) AS depth FROM walk GROUP BY page"""),
        "numbered_in_group": (_numbered, "SELECT event_id, event_type || '_' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS id FROM events"),
        "running_in_group": (_running, "SELECT event_id, event_type, coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM events"),
    }
