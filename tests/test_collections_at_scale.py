"""Vocabularies, crawls and running sums against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import frontier, grouped, vocabulary


def test_terms_equal_containment(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4))) for _ in range(200)] + ["A b", "É", "", None, "abc", "ABC"]
    texts = [(i, "".join(rnd.choice("abcéÉA b") for _ in range(rnd.choice([0, 5, 60])))) for i in range(60)] + [(60, None), (61, "abc" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, term string, rank int")
    vocab = spark.createDataFrame([(w, -len(w or "")) for w in words], "term string, rank long")
    known = sorted({(-len(w), w.lower()) for w in words if w}, key=lambda p: (p[0], p[1].encode()))
    want = {i: [w for _, w in known if w in (t or "").lower()] for i, t in texts}
    for block in (100_000, 37):
        monkeypatch.setattr(vocabulary, "BLOCK", block)
        got = {r.doc_id: r.terms for r in vocabulary.with_terms(docs, vocab).collect()}
        assert got == want
    assert {r.doc_id: r.terms for r in vocabulary.with_terms(docs, vocab, most=3).collect()} == {i: x[:3] for i, x in want.items()}
    assert {r.doc_id for r in vocabulary.with_any(docs, vocab).collect()} == {i for i, x in want.items() if x}
    counts = {r.term: r.n for r in vocabulary.term_counts(docs, vocab).collect()}
    assert counts == {w: sum(w in x for x in want.values()) for _, w in known}
    assert vocabulary.term_rows(docs.limit(0), vocab).count() == 0 and vocabulary.term_rows(docs, vocab.limit(0)).count() == 0


def test_crawl(spark):
    """A random graph with circles, loops, two pages of one name and links to nowhere."""
    rnd = random.Random(8)
    rows = [(i, f"https://a.b/{i}", "".join(f'<a href="/{rnd.choice([i, rnd.randint(0, 80), 999])}#x">l</a>' for _ in range(rnd.randint(1, 2)))) for i in range(70)] + [(70, "https://a.b/5", '<a href="/69">l</a>'), (71, None, None)]
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    links = frontier.links_of(pages, "id", "url")
    known = frontier.known_pages(pages, "id", F.col("url"))
    out, names = {}, {f"https://a.b/{i}": i for i in range(70)}
    for i, url, html in rows:
        out[i] = {names[x] for x in ("https://a.b/" + p for p in re.findall(r'href="/(\d+)', html or "")) if x in names} - {i}
    for most in (10, 2):
        depth, fresh = {0: 0, 70: 0}, {0, 70}
        for d in range(1, most + 1):
            fresh = {t for i in fresh for t in out[i]} - set(depth)
            depth |= dict.fromkeys(fresh, d)
        seeds = spark.createDataFrame([(0,), (0,), (70,)], "page long")
        assert {r.page: r.depth for r in frontier.crawl(seeds, links, known, most).collect()} == depth
    assert len(depth) > 3


def test_running_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 30 + ["a", "b", None]), i, rnd.choice([None, 1, 5])) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, n long")
    sums, want = {}, {}
    for g, at, n in sorted(rows, key=lambda r: r[1]):
        want[at] = sums.get(g, (0, 0))
        sums[g] = (want[at][0] + (n or 0), want[at][1] + 1)
    got = grouped.running(df, ["g"], "at", {"before": F.col("n"), "turn": F.lit(1)})
    assert got.columns == ["g", "at", "n", "before", "turn"]
    assert {r["at"]: (r.before, r.turn) for r in got.collect()} == want
    held = df.repartitionByRange(4, "g", "at").groupBy("g", F.spark_partition_id()).count().where("g = 'hot'").count()
    assert held > 1  # the hot group is split
    assert {r["at"]: r.turn for r in grouped.numbered_in(df, ["g"], "at", start=0).collect()} == {k: v[1] for k, v in want.items()}
    assert {r["at"] for r in grouped.until_enough(df, "g", "at", "n", 50).collect()} == {k for k, v in want.items() if v[0] < 50}
    assert grouped.running(df.limit(0), ["g"], "at", {"x": F.lit(1)}).count() == 0


def test_weighted_limit_before_the_exchange(spark):
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("g"), "id")
    weights = {"0": 0.4, "1": 0.35}
    new = grouped.weighted_limit(df, "g", "id", weights)
    assert sorted((r.g, r.id) for r in new.collect()) == [("0", 3 * i) for i in range(8)] + [("1", 3 * i + 1) for i in range(7)]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the exchange


def test_listing(spark):
    sizes = [(s, p, 0 if (s, p) in ((0, 3), (1, 0)) else 4) for s in range(3) for p in range(6)]
    got = frontier.listing(spark.createDataFrame(sizes, "s int, p int, n int"), "s", "p", "n", 14).collect()
    assert sorted((r.s, r.p) for r in got) == [(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (2, 2), (2, 3)]


@pytest.mark.parametrize("name", ["vocabulary_rows", "vocabulary_tags", "vocabulary_counts", "crawl", "followed_links", "numbered_in_group", "running_in_group"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and name in entry.oracle_sql()
