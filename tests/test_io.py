"""Readers, writers and the stream of repeated runs."""

import json

from pyspark.sql import functions as F

from sedimenta.operators import quality
from sedimenta.operators import collections as coll
from sedimenta.sources import readers, sinks
from sedimenta.streaming import runs


def lines(folder):
    return [json.loads(x) for f in sorted(folder.rglob("part-*.json")) for x in f.read_text().splitlines()]


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>u</link><pubDate>Mon, 05 Feb 2024 08:30:00 +0800</pubDate></item><item><title>C</title></item></channel></rss>")
    got = readers.feed(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()
    assert [(r.title, r.link) for r in got] == [("A & B", "u"), ("C", None)]
    (tmp_path / "a.csv").write_text('name,n\n"x, y","1,000"\nz,na\n')
    assert [(r.name, r.n) for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == [("x, y", "1,000"), ("z", "na")]
    (tmp_path / "j.jsonl").write_text('{"id": "1", "text": "é"}\n{broken\n')
    rows = readers.jsonl(spark, str(tmp_path / "j.jsonl")).cache().orderBy("id").collect()
    assert [(r.id, r._corrupt_record) for r in rows] == [(None, "{broken"), ("1", None)]
    assert [r.url for r in readers.requests(spark, "https://a.b/x", 2).collect()] == ["https://a.b/x?page=1", "https://a.b/x?page=2"]
    assert readers.fixed(spark, ["u", "v"]).count() == 2
    spark.createDataFrame([("u", 2024), ("v", 2023)], "url string, year int").write.partitionBy("year").parquet(str(tmp_path / "p"))
    assert [r.url for r in readers.pages(spark, str(tmp_path / "p"), 2024).collect()] == ["u"]
    both = readers.hot_and_new(spark.range(5), spark.range(10, 15), "id", 4)
    assert sorted(r.id for r in both.collect()) == [0, 1, 10, 11]
    assert readers.setting(spark, "no_such_name", "d") == "d"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "xx"), ("b", None), ("a", "y")], "source string, text string")
    sinks.combined_and_parts(df, str(tmp_path / "c"), "source")
    assert len(lines(tmp_path / "c/all")) == 3 and len(lines(tmp_path / "c/by_source/source=a")) == 2
    assert {"source": "b", "text": None} in lines(tmp_path / "c/all")
    sinks.envelope(df, str(tmp_path / "e"), spark.createDataFrame([("r1", 3)], "run string, n int"))
    assert lines(tmp_path / "e/scraping_metadata") == [{"run": "r1", "n": 3}] and len(lines(tmp_path / "e/articles")) == 3
    sinks.json_lines(df, str(tmp_path / "g"), gzip=True, by=["source"])
    assert list((tmp_path / "g").rglob("*.json.gz"))
    for _ in range(2):
        sinks.statistics(df, str(tmp_path / "s"), "source")
    stats = {r["source"]: r for r in lines(tmp_path / "s")}
    assert stats[None]["n"] == 3 and stats["a"]["total_length"] == 3 and stats["b"]["avg_length"] is None
    sinks.report(df)


def test_stream_passes_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, ids in enumerate(("ab", "bc")):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps({"id": x, "timestamp": f"2025-01-0{i + 1}T00:00:00Z"}) + "\n" for x in ids))
    rows = runs.new_records(spark, str(tmp_path / "in"), "id string, timestamp string", per_trigger=1)
    q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_quality_rules(spark):
    df = spark.createDataFrame([("1", "s", "https://x", "c" * 20, 5.0, -1.0, "2024-01-01", 1.0)], "id string, source string, url string, content string, rating double, score double, scraped_at string, quality_score double")
    assert quality.violations(df).first().violations == []
    assert coll.follow_links(df.select("url"), df, "url").count() == 1
