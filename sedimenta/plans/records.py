"""Queries over damaged records, open metadata and trends, with SQL written by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sedimenta.operators import metadata, trend
from sedimenta.session import shared_folder
from sedimenta.sources import fetch, quarantine
from sedimenta.streaming import keyed


def _damaged(s, d):
    """events.props as a careless feed would deliver it: some texts cut off, of another type, empty, missing, or with more keys."""
    how, props = F.col("event_id") % 11, F.col("props")
    bad = F.when(how == 0, F.substring(props, 1, 4)).when(how == 1, F.lit('{"k": "x"}')).when(how == 2, F.lit("{}")).when(how == 4, F.lit('{"k": null, "note": "none"}')).when(how == 5, F.concat(F.substring(props, F.lit(1), F.length(props) - 1), F.lit(', "note": null, "tags": ["a"]}')))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.when(how == 3, None).otherwise(F.coalesce(bad, props)).alias("props"))


_DAMAGED = """damaged AS (SELECT event_id, event_type, CASE event_id % 11 WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{}' WHEN 3 THEN NULL WHEN 4 THEN '{"k": null, "note": "none"}'
  WHEN 5 THEN substr(props, 1, length(props) - 1) || ', "note": null, "tags": ["a"]}' ELSE props END AS props FROM events)"""
_ERROR = "CASE WHEN props IS NULL THEN 'empty' WHEN NOT json_valid(props) THEN 'corrupt' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'type_k' END"


def _errors(s, d):
    rows, rules = quarantine.lines(_damaged(s, d), "props", "k bigint, note string")
    return quarantine.error_counts(rows, rules)


def _isolated(s, d):
    """What was written as good and as bad, beside the counters observed while it was written."""
    rows, rules = quarantine.lines(_damaged(s, d), "props", "k bigint, note string")
    out = quarantine.isolate(rows, f"{shared_folder(s)}/isolated-{uuid.uuid4().hex}", rules)
    good = out.good.select(F.lit("good").alias("outcome"), F.lit(None).cast("string").alias("error"), F.col("record.k").alias("k"))
    both = good.unionByName(out.bad.select(F.lit("bad").alias("outcome"), "error", F.col("record.k").alias("k")))
    counted = F.create_map(*[F.lit(x) for kv in out.counts.items() for x in kv])
    n = F.when(F.col("outcome") == "good", counted["records"] - counted["errors"]).otherwise(counted[F.col("error")])
    return both.groupBy("outcome", "error").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k")).withColumn("observed", n)


def _fetched(s, d):
    """Parts 1 and up of the archive of pages, a hundred to a part: every seventh page is busy at first, the last part has pages that are not there."""
    last = s.read.parquet(f"{d}/pages.parquet").agg(F.max("page_id")).first()[0]
    rows = fetch.fetched(s, url="https://archive/{part}/{page}", parts=f"0-{last // 100}", pages="0-99", fetcher="sedimenta.sources.fetch:archive", archive=f"{d}/pages.parquet", size=100, fails_every=7, backoff=0)
    return rows.where("part >= 1").select("part", "page", "status", "error", "attempts", F.md5("body").alias("body_md5"))


def _bags(s, d):
    return _damaged(s, d).withColumn("bag", metadata.bag(F.col("props")))


def _presence(s, d):
    b = F.col("bag")
    return _bags(s, d).groupBy(metadata.presence(b, "$.k").alias("k"), metadata.presence(b, "$.note").alias("note")).agg(F.count(F.lit(1)).alias("n"), F.sum(metadata.field(b, "$.k", "bigint")).alias("sum_k"))


def _typed(s, d):
    rows = metadata.typed(_bags(s, d), "bag", {"k": "bigint"})
    return rows.select("event_id", "metadata.k", F.array_join(F.array_sort(F.map_keys("extra")), "|").alias("extra_keys"))


def _streamed(s, d):
    """events in four files, in no order of time, taken up one by one by a stream that keeps state; the same as keyed_dedup."""
    folder = f"{shared_folder(s)}/streamed-{uuid.uuid4().hex}"
    events = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value", "ts")
    events.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    updates = keyed.run_available(keyed.last_values(stream, "user_id", "event_id", "value", "ts"), folder)
    return keyed.latest(updates, "user_id").select("user_id", "value", "place")


_STATE = "CASE WHEN NOT coalesce(json_valid(props), false) THEN NULL WHEN json_type(props, '$.{0}') IS NULL THEN 'absent' WHEN json_type(props, '$.{0}') = 'NULL' THEN 'null' ELSE 'value' END"
_KIND = "CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(json_type(props, '$.' || key)) END"


def _large(s, d):
    """Orders so large that most months have none of a priority."""
    return s.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 450000")


def _periods(s, d):
    rows = trend.periods(_large(s, d), ["o_orderpriority"], "o_orderdate", "month", {"most": F.max("o_totalprice")})
    rows = trend.sliding(trend.filled(rows, ["o_orderpriority"], "most", "last_most"), ["o_orderpriority"], "n", 3, "mean3")
    return rows.select("o_orderpriority", F.col("period").cast("string").alias("period"), "n", "most", "last_most", F.round("mean3", 9).alias("mean3"))


def _slopes(s, d):
    rows = trend.periods(_large(s, d), ["o_orderpriority"], "o_orderdate", "month")
    return trend.slopes(rows, ["o_orderpriority"], "n").select("o_orderpriority", F.round("slope", 9).alias("slope"), "periods")


_SPINE = """o AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS period, o_totalprice FROM orders WHERE o_totalprice > 450000),
spine AS (SELECT o_orderpriority, period::DATE AS period FROM (SELECT DISTINCT o_orderpriority FROM o), generate_series((SELECT min(period) FROM o), (SELECT max(period) FROM o), INTERVAL 1 MONTH) g(period)),
m AS (SELECT o_orderpriority, period, count(o_totalprice) AS n, max(o_totalprice) AS most FROM spine LEFT JOIN o USING (o_orderpriority, period) GROUP BY ALL)"""


def table() -> dict[str, tuple]:
    return {
        "error_counts": (_errors, f"WITH {_DAMAGED} SELECT error, count(*) AS n FROM (SELECT coalesce({_ERROR}, 'ok') AS error FROM damaged) GROUP BY ROLLUP (error)"),
        "isolated_records": (_isolated, f"""WITH {_DAMAGED}, e AS (SELECT {_ERROR} AS error, CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM damaged)
SELECT CASE WHEN error IS NULL THEN 'good' ELSE 'bad' END AS outcome, error, count(*) AS n, sum(k)::BIGINT AS sum_k, count(*) AS observed FROM e GROUP BY ALL"""),
        "streamed_dedup": (_streamed, "SELECT user_id, arg_max(value, event_id) AS value, min(event_id) AS place FROM events GROUP BY user_id"),
        "fetched_pages": (_fetched, """WITH n AS (SELECT id, p.* FROM range((SELECT (max(page_id) // 100 + 1) * 100 FROM pages)) r(id) LEFT JOIN pages p ON p.page_id = id)
SELECT (id // 100)::INTEGER AS part, (id % 100)::INTEGER AS page, (CASE WHEN page_id IS NULL THEN 404 ELSE 200 END)::INTEGER AS status, CASE WHEN page_id IS NULL THEN 'page ' || id END AS error, (CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END)::INTEGER AS attempts, md5(html) AS body_md5 FROM n WHERE id >= 100"""),
        "metadata_keys": (lambda s, d: metadata.key_types(_bags(s, d).where("bag is not null"), "bag").where("key is not null"), f"WITH {_DAMAGED}, k AS (SELECT props, unnest(json_keys(props)) AS key FROM damaged WHERE json_valid(props)) SELECT key, {_KIND} AS kind, count(*) AS n FROM k GROUP BY ALL"),
        "metadata_presence": (_presence, f"WITH {_DAMAGED} SELECT {_STATE.format('k')} AS k, {_STATE.format('note')} AS note, count(*) AS n, sum(CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS sum_k FROM damaged GROUP BY ALL"),
        "metadata_typed": (_typed, f"WITH {_DAMAGED} SELECT event_id, CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN json_valid(props) THEN array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), '|') END AS extra_keys FROM damaged"),
        "periods_without_gaps": (_periods, f"""WITH {_SPINE} SELECT o_orderpriority, period::VARCHAR AS period, n, most, last_value(most IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_most,
  round(avg(n) OVER (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS mean3 FROM m"""),
        "trend_slopes": (_slopes, f"WITH {_SPINE} SELECT o_orderpriority, round(regr_slope(n, year(period) * 12 + month(period)), 9) AS slope, count(*) AS periods FROM m GROUP BY o_orderpriority"),
    }
