"""The source of fetched pages: pruning, retries, failures."""

from sedimenta.sources import fetch


def counting(options, part):
    def get(url):
        page = int(url.rsplit("/", 1)[1])
        if page == 3:
            raise ConnectionError("down")
        if page == 4:
            raise fetch.NotThere
        return 200, f"{part}/{page}"

    return get


def test_retries_and_backoff():
    waits, calls = [], []

    def busy(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError("busy")
        return 200, "ok"

    assert fetch.with_retries(busy, "u", 5, 0.5, waits.append) == {"status": 200, "body": "ok", "error": None, "attempts": 3} and waits == [0.5, 1.0]
    calls.clear()
    assert fetch.with_retries(busy, "u", 2, 1, waits.append) == {"status": None, "body": None, "error": "TimeoutError: busy", "attempts": 2} and waits == [0.5, 1.0, 1]
    assert fetch.with_retries(counting({}, 1), "x/4", 3, 1, waits.append)["status"] == 404 and len(waits) == 3


def test_filters_prune_parts(spark):
    pages = lambda: fetch.fetched(spark, url="https://a.b/{part}/{page}", parts="2019-2024", pages="1-5", fetcher="tests.test_fetch:counting", backoff=0)
    some = pages().where("part >= 2022 and page in (2, 3, 4) and part <> 2023")
    kept = [x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if " Filter " in x]
    assert len(kept) == 1 and "2023" in kept[0] and "2022" not in kept[0] and " IN " not in kept[0]  # what was pushed isn't repeated
    assert pages().where("part = 2020").rdd.getNumPartitions() == 1 and pages().rdd.getNumPartitions() == 6 and pages().count() == 30
    got = sorted((r.part, r.page, r.status, r.body, r.error, r.attempts) for r in some.collect() if r.status)
    assert got == sorted([(p, 2, 200, f"{p}/2", None, 1) for p in (2022, 2024)] + [(p, 4, 404, None, "not there", 1) for p in (2022, 2024)])
    failed = some.where("status is null").collect()
    assert {(r.part, r.page, r.error, r.attempts) for r in failed} == {(p, 3, "ConnectionError: down", 3) for p in (2022, 2024)}
    assert pages().where("part = 1").count() == 0 and pages().where("body = '2020/1'").count() == 1
