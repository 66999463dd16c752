"""Stateful dedup of a stream over several runs, with rows out of order, repeated and late, against plain Python."""

import datetime as dt
import random

from sedimenta.streaming import keyed

SCHEMA = "k string, n long, v double, at timestamp"
DAY = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_two_runs_equal_one_pass(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]), i, rnd.choice([None, float(i)]), DAY + dt.timedelta(hours=i)) for i in range(60)]
    rnd.shuffle(rows)
    parts = [rows[:20], rows[10:40], rows[40:]]  # some rows come twice
    for i, part in enumerate(parts[:2]):
        write(spark, tmp_path / "in", f"f{i}", part)
    run = lambda: keyed.run_available(keyed.last_values(stream(spark, tmp_path / "in"), "k", "n", "v", "at"), f"file://{tmp_path}/out")
    for seen in (rows[:40], rows):
        if seen is rows:
            write(spark, tmp_path / "in", "f2", parts[2])
        got = {r.k: (r.seq, r.value, r.place) for r in keyed.latest(run(), "k").collect()}
        own = {k: [r for r in seen if r[0] == k] for k in {r[0] for r in seen}}
        assert got == {k: (max(x[1] for x in r), max(r, key=lambda x: x[1])[2], min(x[1] for x in r)) for k, r in own.items()}
    assert {r.batch for r in run().collect()} == {0, 1, 2}


def test_idle_keys_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    hours = lambda h: DAY + dt.timedelta(hours=h)
    for i, rows in enumerate(([("a", 5, 1.0, hours(0)), ("b", 6, 2.0, hours(1))], [("b", 7, 3.0, hours(30))], [("b", 8, 4.0, hours(60))], [("a", 1, 9.0, hours(2)), ("a", 9, 5.0, hours(61))])):
        write(spark, tmp_path / "in", f"f{i}", rows)
    updates = keyed.last_values(stream(spark, tmp_path / "in"), "k", "n", "v", "at", idle="20 hours", delay="1 hour")
    rows = keyed.run_available(updates, f"file://{tmp_path}/out").collect()
    own = {k: sorted((r.batch, r.seq, r.value, r.place, r.final) for r in rows if r.k == k) for k in "ab"}
    assert [r[1:] for r in own["a"]][:2] == [(5, 1.0, 5, False), (5, 1.0, 5, True)]  # given out, then given out as final
    assert all(r[3] != 1 for r in own["a"])  # hour 2 is late two batches after hour 30 was seen
    assert own["a"][2][1:4] == (9, 5.0, 9)  # begun anew
    assert [r[1:4] for r in own["b"] if not r[4]][-1][:2] == (8, 4.0)
