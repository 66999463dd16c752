"""Hand-derived expectations for the quirks of each operator, and the catalog against SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import dates, html, text
from sedimenta.operators import collections as coll
from sedimenta.operators import quality, rules, series
from sedimenta.plans import catalog, samples
from sedimenta.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t"))).first()[0]


def test_keyword_has_no_word_boundary(spark):
    assert one(spark, "security", lambda c: text.keyword_any(c, ["ec"])) is True
    assert one(spark, None, lambda c: text.keyword_any(c, ["ec"])) is False


def test_truncations(spark):
    assert one(spark, "One two. Three four five six.", lambda c: text.cut_sentences(c, 20)) == "One two."
    assert one(spark, "x" * 30, lambda c: text.cut_sentences(c, 20)) == "x" * 17 + "..."
    assert one(spark, "a" * 250 + ". " + "b" * 100, lambda c: text.cut_late_stop(c, 300)) == "a" * 250 + "."
    assert one(spark, "a" * 250 + " " + "b" * 100, lambda c: text.cut_late_sentence(c, 300)) == "a" * 250


@pytest.mark.parametrize(("value", "dialect", "day"), [("31 Feb 2024 and 2024-03-05", "five", dt.date(2024, 3, 5)), ("Jan 5, 2024", "strict", None), ("15 jan 2024", "titled", None), ("15 jan 2024", "five", dt.date(2024, 1, 15)), ("5/3/2024", "strict", dt.date(2024, 3, 5)), ("2024-1-5", "five", None), ("2024-1-5", "strict", None), ("2024-1-5", "titled", dt.date(2024, 1, 5)), ("", "five", None)])
def test_dates(spark, value, dialect, day):
    assert one(spark, value, lambda c: dates.find_date(c, dialect)) == day


def test_extractors(spark):
    assert one(spark, "$1,000 then $80,000", text.largest_amount) == 80000
    assert one(spark, "lease until 2040", lambda c: text.extract(c, "lease_until")) == "2040"
    assert one(spark, "246,800", text.number) == 246800
    assert one(spark, "state tender for 3+2 years", text.tenure_years) == "3+2"
    assert one(spark, "SFA_2024_7", lambda c: text.release_id(c, "SFA", r"[_\s]", 3)) == "SFA_2024_007"
    assert one(spark, "Q3 2024", text.reporting_period) == "Q3_2024"
    assert one(spark, "up 1.5%", lambda c: text.extract(c, "price_change_percent")) == 1.5


def test_periods(spark):
    for value, day in (("2008-Q2", dt.date(2008, 4, 1)), ("20253Q", dt.date(2025, 7, 1)), ("2017-12", dt.date(2017, 12, 1)), ("2020", dt.date(2020, 1, 1)), ("na", None)):
        assert one(spark, value, dates.period) == day


def test_limits_and_dedup(spark):
    ids = spark.range(10).select("id", F.lit(1).alias("g"))
    odd = F.col("id") % 4 == 3
    assert coll.limit_then_filter(ids, ["g"], "id", 3, odd).count() == 0
    assert coll.filter_then_limit(ids, ["g"], "id", 3, odd).count() == 2
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "k string, v int, seq int")
    assert [(r.k, r.v) for r in coll.last_value_first_place(rows, "k", "seq").orderBy("place").collect()] == [("a", 3), ("b", 2)]


def test_html(spark):
    page = '<html><title>T</title><nav>x</nav><p>One <b>two</b></p><a href="/q">Go</a></html>'
    assert one(spark, page, lambda c: html.first_element(c, ("h1", "title"))) == "T"
    assert one(spark, page, lambda c: html.text(html.drop(c))) == "T One two Go"
    assert one(spark, page, lambda c: html.anchors(c)[0]["href"]) == "/q"
    assert one(spark, "/q", lambda c: html.absolute(c, F.lit("https://a.b/c/d"))) == "https://a.b/q"


def test_rules(spark):
    assert one(spark, "Quarterly statistics of GLS", lambda c: rules.classify(c, "ura_policy_type")) == "gls_programme"
    assert one(spark, "x", lambda c: rules.classify(c, "hdb_grant_type")) is None
    assert one(spark, "Proximity housing", lambda c: rules.classify(c, "hdb_grant_type")) == "proximity_grant"
    assert one(spark, "https://x/NEWS", lambda c: rules.mas_policy(c, F.lit("absd"))) is None
    assert one(spark, "https://x/news/1", lambda c: rules.mas_policy(c, F.lit("absd up"))) == "policy_announcement/absd_adjustment"


def test_series(spark):
    wide = spark.createDataFrame([("Total", 0, "1,000", "na"), ("    Shops", 1, "5", "6")], ["DataSeries", "row_no", "20251Q", "20252Q"])
    tree = series.hierarchy(wide, "DataSeries", "row_no").where("row_no = 1").first()
    assert (tree.level, tree.parent) == (1, "Total")
    long = series.unpivoted(wide, "DataSeries").where("row_no = 0").orderBy("period").collect()
    assert [r.value for r in long] == [1000.0, None]


def test_quality(spark):
    row = spark.createDataFrame([("1", "s", "ftp://x", "short", 9.0, 0.0)], "id string, source string, url string, content string, rating double, score double")
    assert quality.violations(row).first().violations == ["url", "length", "rating"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert sinks.fan_out(df, str(tmp_path / "f"), "k") and not sinks.json_lines(df.limit(0), str(tmp_path / "e"))
    assert sinks.json_lines(df, str(tmp_path / "j"), run_id="1")
    assert readers.jsonl(spark, str(tmp_path / "j/run=1"), "k string, v string").count() == 2


def test_catalog_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "labels", "orders"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    sql = catalog.oracle_sql()
    few = ["minimum_slice", "ordered_tags", "truncate_sentences", "page_text", "anchors", "find_dates", "nested_children", "early_stop", "quality_score", "keyed_dedup"]
    for name in few + [n for n in samples.table() if n.split("_")[0] in ("extract", "date", "article", "numbered", "until")]:
        mine, other = catalog.queries()[name](spark, DATA).toPandas(), con.sql(sql[name]).df()
        rows = [sorted(map(repr, x[sorted(x.columns)].astype(str).values.tolist())) for x in (mine, other)]
        assert rows[0] == rows[1], name


def test_html_blocks(spark):
    page = "<p>This block has more than twenty characters</p><p>short</p>"
    assert one(spark, page, html.blocks) == "This block has more than twenty characters"
    assert one(spark, page, lambda c: html.long_enough(c, ("p",), 10)).startswith("This block")


def test_every_arm_fires(spark):
    """Each classifier gives each of its labels on the sample sentences, by rules written out in SQL."""
    con = duckdb.connect()
    con.sql(f"create view documents as from '{DATA}/documents.parquet'")
    for name, (arms, default) in rules.RULES.items():
        found = {x for (x,) in con.sql(f"select label from ({samples.table()[f'classify_{name}'][1]})").fetchall()}
        assert found == {a[0] for a in arms} | {default or "unknown"}, name
    for name in samples._FIELDS:
        assert con.sql(samples.table()[f"extract_{name}"][1]).fetchall(), name


def test_places_and_sections(spark):
    rows = spark.range(50).select((49 - F.col("id")).alias("seq"))
    assert sorted((r.seq, r.place) for r in coll.place(rows, "seq").collect()) == [(i, i + 1) for i in range(50)]
    one_ = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(3)] + [(3, 0)], "s int, i int")
    assert [(r.s, r.i) for r in coll.until_target(one_, one_, "s", "i", 4).collect()] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert [r.part for r in coll.until_target(one_, one_, "s", "i", 9).collect()] == [0] * 7 + [1] * 2


def test_json_array_is_bounded(spark):
    df = spark.range(5)
    assert sinks.json_array(df).first().value.count("id") == 5
    with pytest.raises(Exception, match="more than 3 rows"):
        sinks.json_array(df, 3).collect()
