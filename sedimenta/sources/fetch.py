"""Fetching pages as a Spark source: a partition for each part of a listing, filters that prune parts and pages, retries, failures as rows.

The fetcher is named by an option, so tests and archives stand in for the network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from importlib import import_module
from operator import ge, gt, le, lt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from sedimenta.session import send_code

SCHEMA = "part int, page int, url string, status int, body string, error string, attempts int"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ORDER = {GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}


class NotThere(Exception):
    """The page does not exist; asking again is of no use."""


def with_retries(get: Callable[[str], tuple[int, str]], url: str, tries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """status, body, error and attempts of a page; each wait is twice the one before, and none follows the last try."""
    error = None
    for attempt in range(1, tries + 1):
        try:
            status, body = get(url)
            return {"status": status, "body": body, "error": None, "attempts": attempt}
        except NotThere as e:
            return {"status": 404, "body": None, "error": str(e) or "not there", "attempts": attempt}
        except Exception as e:  # a failed fetch is a row, not a failed job
            error = f"{type(e).__name__}: {e}"
            if attempt < tries:
                sleep(backoff * 2 ** (attempt - 1))
    return {"status": None, "body": None, "error": error, "attempts": tries}


def span(text: str) -> range:
    """first-last, or one number."""
    first, _, last = text.partition("-")
    return range(int(first), int(last or first) + 1)


class Part(InputPartition):
    def __init__(self, part: int, pages: list[int]):
        super().__init__(part)
        self.part, self.pages = part, pages


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.parts, self.pages = list(span(options["parts"])), list(span(options.get("pages", "1")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of part and page with constants; gives back the rest."""
        for f in filters:
            name = next(iter(getattr(f, "attribute", ())), None)
            if name not in ("part", "page") or not isinstance(f, (EqualTo, In, IsNotNull, *_ORDER)):
                yield f
                continue
            keep = (lambda x: True) if isinstance(f, IsNotNull) else (lambda x, v=set(f.value): x in v) if isinstance(f, In) else (lambda x, v=f.value, op=_ORDER.get(type(f)): op(x, v) if op else x == v)
            if name == "part":
                self.parts = [x for x in self.parts if keep(x)]
            else:
                self.pages = [x for x in self.pages if keep(x)]

    def partitions(self) -> list[Part]:
        return [Part(p, self.pages) for p in self.parts if self.pages]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not hasattr(partition, "part"):
            return
        module, _, name = self.options["fetcher"].partition(":")
        get = getattr(import_module(module), name)(self.options, partition.part)
        tries, backoff = int(self.options.get("tries", "3")), float(self.options.get("backoff", "1"))
        for page in partition.pages:
            url = self.options["url"].format(part=partition.part, page=page)
            got = with_retries(get, url, tries, backoff)
            yield partition.part, page, url, got["status"], got["body"], got["error"], got["attempts"]


class FetchedPages(DataSource):
    """Options: url (a pattern with {part} and {page}), parts and pages (first-last), fetcher (module:function), tries, backoff in seconds.

    The fetcher function is called once for each partition, with the options and the part, and gives a function from an
    address to status and body.
    """

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def fetched(spark: SparkSession, **options: str) -> DataFrame:
    """The pages as a DataFrame; nothing is fetched before an action, and only what its filters leave.

    Spark 4.1 keeps one reader for each loaded frame and prunes it by the filters of the query planned last. So a frame
    from here is for one query, in which it occurs once: call again for the next. The filter that is always true makes a
    query without filters ask the source anew.
    """
    send_code(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FetchedPages)
    return spark.read.format("fetched_pages").options(**{k: str(v) for k, v in options.items()}).load().where("part is not null")


def archive(options: dict[str, str], part: int) -> Callable[[str], tuple[int, str]]:
    """A fetcher that serves a Parquet archive of pages (page_id, url, html): page n of a part is page_id part * size + n.

    Only row groups with the part's ids are read. Every fails_every-th page fails at the first try, as a busy site would.
    """
    import pyarrow.dataset as ds

    size, every = int(options["size"]), int(options.get("fails_every", "0"))
    ids = ds.field("page_id")
    own = ds.dataset(options["archive"].removeprefix("file://")).to_table(["page_id", "html"], filter=(ids >= part * size) & (ids < (part + 1) * size))
    bodies, failed = dict(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)), set()

    def get(url: str) -> tuple[int, str]:
        page = part * size + int(url.rsplit("/", 1)[1])
        if every and page % every == 0 and page not in failed:
            failed.add(page)
            raise TimeoutError("busy")
        if page not in bodies:
            raise NotThere(f"page {page}")
        return 200, bodies[page]

    return get
