"""Error isolation, open metadata and trends against plain versions."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import metadata, trend
from sedimenta.sources import quarantine, sinks

TEXTS = ['{"k": 1, "s": "a"}', '{"k": null}', "{}", '{"k": "x"}', '{"s": 5}', '{"k": 1.5}', "{bad", "", None, '{"k": 2, "m": {"n": [1, null]}}', "[1]", '{"k": 9223372036854775807}', '{"k": 1, "k": 2}']


def test_lines_and_isolation(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, props string")
    rows, rules = quarantine.lines(df, "props", "k bigint, s string")
    got = {r.i: (r.e, r.k) for r in rows.select("i", quarantine.first_error(rules).alias("e"), "record.k").collect()}
    assert got[0] == (None, 1) and got[1] == (None, None) == got[2] and got[9] == (None, 2) and got[11] == (None, 2**63 - 1)
    assert got[3][0] == "type_k" and got[6][0] == got[7][0] == "corrupt" and got[8][0] == "empty"
    out = quarantine.isolate(rows, f"{tmp_path}/x", rules)
    bad = {r.i: r.error for r in out.bad.collect()}
    assert bad == {i: e for i, (e, _) in got.items() if e} and {r.i for r in out.good.collect()} == {i for i, (e, _) in got.items() if not e}
    assert out.counts["records"] == len(TEXTS) and out.counts["errors"] == len(bad) and out.counts["corrupt"] == sum(e == "corrupt" for e in bad.values())
    assert "PartitionFilters: [isnotnull(outcome" in out.bad._jdf.queryExecution().executedPlan().toString()
    counts = {r.error: r.n for r in quarantine.error_counts(rows, rules).collect()}
    assert counts[None] == len(TEXTS) and counts["ok"] == len(TEXTS) - len(bad)
    none = quarantine.isolate(rows.limit(0), f"{tmp_path}/none", rules)
    assert none.good.count() == none.bad.count() == none.counts["records"] == 0
    with pytest.raises(ValueError, match="taken"):
        quarantine.isolate(rows.withColumn("Error", F.lit(1)), f"{tmp_path}/y", rules)


def test_bags(spark):
    texts = [t for t in TEXTS if t != '{"k": 1, "k": 2}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, props string").withColumn("bag", metadata.bag(F.col("props")))

    def loaded(t):
        try:
            return json.loads(t)
        except (TypeError, ValueError):
            return None

    bags = {i: loaded(t) for i, t in enumerate(texts)}
    states = {r.i: r.s for r in df.select("i", metadata.presence(F.col("bag"), "$.k").alias("s")).collect()}
    for i, b in bags.items():
        assert states[i] == (None if b is None else "absent" if not isinstance(b, dict) or "k" not in b else "null" if b["k"] is None else "value"), (texts[i], states[i])
    kinds = {type(None): "null", int: "number", float: "number", str: "string", dict: "object", list: "array"}
    want = {}
    for b in bags.values():
        for k, v in (b if isinstance(b, dict) else {}).items():
            want[k, kinds[type(v)]] = want.get((k, kinds[type(v)]), 0) + 1
    assert {(r.key, r.kind): r.n for r in metadata.key_types(df.where("props like '{%'"), "bag").where("key is not null").collect()} == want
    rows = {r.i: r for r in metadata.typed(df, "bag", {"k": "bigint"}).collect()}
    assert rows[0].metadata.k == 1 and rows[0].extra == {"s": '"a"'} and rows[8].metadata is None and rows[9].extra == {"m": '{"n":[1,null]}'} and rows[3].metadata.k is None
    assert metadata.schema_of(df.where("props like '{%'"), "bag").first().schema.startswith("OBJECT<k: ")


def test_trend(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice("ab"), dt.datetime(2020 + m // 12, m % 12 + 1, rnd.randint(1, 28)), float(rnd.randint(0, 9))) for m in rnd.sample(range(30), 12) for _ in range(3)] + [("a", None, 1.0), (None, dt.datetime(2020, 3, 3), 2.0)]
    df = spark.createDataFrame(rows, "g string, at timestamp, v double")
    months = [(at.year, at.month) for _, at, _ in rows if at]
    first, last = min(months), max(months)
    spine = [(y, m) for y in range(first[0], last[0] + 1) for m in range(1, 13) if first <= (y, m) <= last]
    out = trend.sliding(trend.filled(trend.periods(df, ["g"], "at", "month", {"total": F.sum("v")}), ["g"], "total"), ["g"], "n", 4)
    got = {(r.g, r.period.year, r.period.month): r for r in out.collect()}
    assert len(got) == 3 * len(spine)
    for g in ("a", "b", None):
        known, counts = None, []
        for y, m in spine:
            own = [v for x, at, v in rows if x == g and at and (at.year, at.month) == (y, m)]
            known, counts = (sum(own) if own else known), [*counts, len(own)]
            r = got[g, y, m]
            assert (r.n, r.total, r.filled) == (len(own), sum(own) if own else None, known) and r.sliding == pytest.approx(np.mean(counts[-4:]))
        slope = {r.g: r.slope for r in trend.slopes(out, ["g"], "n").collect()}[g]
        assert slope == pytest.approx(np.polyfit(range(len(counts)), counts, 1)[0], abs=1e-9)
    assert trend.periods(df.limit(0), ["g"], "at").count() == 0
    weeks = trend.periods(df, ["g"], "at", "week").select("period").distinct().collect()
    assert all(r.period.weekday() == 0 for r in weeks)


def test_statistics_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "xx"), ("b", "xxxx"), ("b", None)], "k string, text string")
    stats = sinks.statistics(df, f"{tmp_path}/s", "k")
    assert {(r.k, r.n, r.total_length) for r in stats.collect()} == {("a", 1, 2), ("b", 2, 4), (None, 3, 6)}
    assert "json" in stats._jdf.queryExecution().executedPlan().toString().lower()
