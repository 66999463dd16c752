"""HTML by regular expressions: flat selectors, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "header", "footer")
# The five common entities.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}


def element(html: Column, tag: str) -> Column:
    """The inside of the first such element, null if none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))


def first_element(html: Column, tags: tuple[str, ...]) -> Column:
    return F.coalesce(*[element(html, t) for t in tags])


def long_enough(html: Column, tags: tuple[str, ...], least: int = 100) -> Column:
    """The text of all elements of the first tag that gives more than least characters, else the whole text."""
    each = [F.array_join(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), F.lit(1)), lambda x: text(x)), "") for t in tags]
    return F.coalesce(*[F.when(F.length(x) > least, x) for x in each], text(html))


def drop(html: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    return reduce(lambda h, t: F.regexp_replace(h, rf"(?is)<{t}\b[^>]*>.*?</{t}>", " "), tags, out)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def text(html: Column, mode: str = "space") -> Column:
    """Tags stripped: to a space (and white space squeezed), raw (to nothing) or glued (text nodes trimmed and joined)."""
    if mode == "raw":
        return F.regexp_replace(html, "<[^>]*>", "")
    if mode == "glued":
        return F.regexp_replace(F.regexp_replace(html, r"\s*<[^>]*>\s*", ""), r"^\s+|\s+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def blocks(html: Column, tags: str = "p|div|li|td|th", least: int = 20, fallback: int | None = 30) -> Column:
    """The texts of blocks longer than least, a blank line between; if there are none, of paragraphs longer than fallback."""

    def of(kinds: str, n: int) -> Column:
        each = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<({kinds})\b[^>]*>(.*?)</\1>"), F.lit(2)), lambda x: text(x))
        return F.array_join(F.filter(each, lambda x: F.length(x) > n), "\n\n")

    own = of(tags, least)
    return own if fallback is None else F.when(own != "", own).otherwise(of("p", fallback))


def anchors(html: Column) -> Column:
    """An array of (href, text), in page order."""
    pattern = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>"""
    href, inner = (F.regexp_extract_all(html, F.lit(pattern), F.lit(g)) for g in (1, 2))
    bare = lambda h: F.regexp_replace(h, r"""^["']|["']$""", "")
    return F.transform(F.arrays_zip(href.alias("href"), inner.alias("inner")), lambda a: F.struct(bare(a["href"]).alias("href"), text(a["inner"]).alias("text")))


def anchors_saying(html: Column, pattern: str) -> Column:
    """The anchors whose text matches."""
    return F.filter(anchors(html), lambda a: a["text"].rlike(pattern))


def text_node(html: Column, pattern: str) -> Column:
    """The first run of text between tags in which the pattern is found, null if none."""
    nodes = F.split(html, "<[^>]*>")
    return F.get(F.filter(nodes, lambda x: x.rlike(pattern)), 0)


def first_selector(found: list[Column]) -> Column:
    """Of arrays of matches by several selectors the first that is not empty."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<string>"))


def every_selector(found: list[Column]) -> Column:
    """Matches of all selectors, each once."""
    return F.array_distinct(F.concat(*found))


def absolute(href: Column, base: Column) -> Column:
    """The address that href names on the page base; "../" climbs, "?" and "#" keep the page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    path = F.regexp_replace(page, r"\?.*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    joined = F.when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"(?<=[^:/])/(?!\.\./)[^/]+/\.\./", "/")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href == "", page).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("?"), F.concat(path, href)).when(href.startswith("#"), F.concat(page, href)).otherwise(joined)
    )


def by_class(html: Column, part: str) -> Column:
    """The insides of flat elements whose class contains part, in any case."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<(\w+)\b[^>]*class="[^"]*{part}[^"]*"[^>]*>(.*?)</\1>'), F.lit(2))


def description(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)"', 1), F.lit(""))


def date_text(html: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, r'(?is)<time\b[^>]*datetime="([^"]*)"', 1), F.lit("")), element(html, "time"))


def has(html: Column, tag: str) -> Column:
    return html.rlike(rf"(?i)<{tag}\b")


def link_kind(href: Column) -> Column:
    return F.when(F.lower(href).endswith(".pdf"), "PDF").otherwise("webpage")
