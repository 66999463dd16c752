"""What the findings of round 3 named: addresses with ids like years, workers that held all of a batch or of a vocabulary."""

import duckdb
import pyarrow as pa

from sedimenta.functions import dom
from sedimenta.operators import vocabulary


def equals_sql(spark, folder, name, table, rows, kind):
    """Whether a query gives what its SQL gives over a table of these rows."""
    import __spark_entry__ as entry

    spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = sorted(db.sql(entry.oracle_sql()[name]).fetchall())
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()) == want


def test_ids_like_years_are_no_years(spark, tmp_path):
    rows = [(i, "https://a.b/c", "<p>x</p>") for i in [*range(2010, 2040), 12_023, 20_231, 20_242, 202_400]]
    assert equals_sql(spark, tmp_path, "slug_dates", "pages", rows, "page_id long, url string, html string")


def test_pages_are_parsed_in_parts_of_a_batch():
    """A batch of 10,000 pages: no result holds the nodes of more than a part of it; a page larger than a part is one."""
    page = "<p>" + "<b>one</b>" * 100 + "</p>"
    pages = [page] * 4_000 + [None, "", page * 700] + [None] * 5_997
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(10_000), pa.int64()), "html": pa.array(pages, pa.string())})
    out = list(dom._parsed(iter([batch]), 1, "nodes"))
    assert max(len(b.column(2).flatten()) for b in out if 4_002 not in b.column(0).to_pylist()) < 120_000
    whole = pa.Table.from_batches(out)
    assert whole.column(0).to_pylist() == list(range(10_000)) and whole.column(1).to_pylist() == pages
    sizes = [len(x) for x in whole.column(2).to_pylist()]
    assert sizes == [201] * 4_000 + [0, 0, 201 * 700] + [0] * 5_997


def test_a_pass_holds_one_block_of_terms(spark, monkeypatch):
    """No task runs two Python workers of a vocabulary one after the other, however many blocks it has."""
    monkeypatch.setattr(vocabulary, "BLOCK", 10)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}x" for j in range(i, i + 9)) if i % 5 else None, "row") for i in range(40)], "doc_id long, text string, terms string")
    words = spark.createDataFrame([(f"w{j}x", -(j % 3)) for j in range(60)], "term string, rank long")
    want = {i: sorted((f"w{j}x" for j in range(i, i + 9)), key=lambda w: (-(int(w[1:-1]) % 3), w)) if i % 5 else [] for i in range(40)}
    for most in (None, 4):
        got = vocabulary.with_terms(docs, words, most=most)
        assert got.columns == ["doc_id", "text", "terms"] and {r.doc_id: r.terms for r in got.collect()} == {i: x[:most] for i, x in want.items()}
    rows = vocabulary.term_rows(docs.drop("terms"), words)
    assert sorted(map(tuple, rows.collect())) == sorted((i, w) for i, x in want.items() for w in x)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    depths = [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "MapInArrow" in line]
    assert len(depths) > 2 and len(set(depths)) == 1
