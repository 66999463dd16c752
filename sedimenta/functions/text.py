"""Text predicates, tagging, truncation and typed extraction, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_any(text: Column, terms: list[str]) -> Column:
    """True if any term is a substring of the lower-cased text; no word boundaries. Null text: false."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t.lower())) for t in terms), F.lit(False))


def tier(text: Column, tiers: list[tuple[str, list[str]]]) -> Column:
    """The name of the first tier with a match, else none."""
    out = F.lit("none")
    for name, terms in reversed(tiers):
        out = F.when(keyword_any(text, terms), name).otherwise(out)
    return out


def tags(text: Column, terms: list[str], most: int | None = 10) -> Column:
    """Terms found, in vocabulary order and spelling, the first most of them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(low, F.lower(k)))
    return found if most is None else F.slice(found, 1, most)


def tag_set(text: Column, terms: list[str]) -> Column:
    return F.array_sort(F.array_distinct(tags(text, terms, None)))


def places(text: Column, gazetteer: list[str]) -> Column:
    """Every place found, in title case."""
    return F.transform(tags(text, gazetteer, None), F.initcap)


def first_place(text: Column, gazetteer: list[str]) -> Column:
    """The first place by list order, else null."""
    return F.get(places(text, gazetteer), 0)


def labels(text: Column, terms: dict[str, list[str]]) -> Column:
    """Labels that have any of their terms in the text, in the order given."""
    return F.filter(F.array(*[F.when(keyword_any(text, t), k) for k, t in terms.items()]), lambda x: x.isNotNull())


def found_terms(text: Column, terms: list[str]) -> Column:
    """Terms found with spaces as underscores; null if there are none."""
    found = F.transform(tags(text, terms, None), lambda k: F.replace(k, F.lit(" "), F.lit("_")))
    return F.when(F.size(found) > 0, found)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def slug(text: Column, n: int = 30) -> Column:
    return F.substring(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", "_")), 1, n)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cut_sentences(t: Column, m: int) -> Column:
    """Whole sentences that fit m, else a hard cut with an ellipsis."""
    whole = F.regexp_extract(F.substring(t, 1, m), r"(?s)^.*\. ", 0)
    return F.when(F.length(t) <= m, t).when(whole != "", _strip(whole)).otherwise(_strip(F.concat(F.substring(t, 1, m - 3), F.lit("..."))))


def cut_late_stop(t: Column, m: int) -> Column:
    """Up to the first stop in the last hundred characters of the limit, else at the limit."""
    stop = F.length(F.regexp_extract(F.substring(t, m - 99, 100), r"(?s)^[^.!?]*[.!?]", 0))
    return F.when(F.length(t) <= m, t).when(stop > 0, _strip(F.substring(t, F.lit(1), m - 100 + stop))).otherwise(_strip(F.substring(t, 1, m)))


def cut_late_sentence(t: Column, m: int) -> Column:
    """At the last sentence end beyond four fifths of the limit, else at the last space, else at the limit."""
    head = F.substring(t, 1, m)
    stop = F.length(F.regexp_extract(head, r"(?s)^.*\. ", 0)) - 2
    space = F.length(F.regexp_extract(head, r"(?s)^.* ", 0)) - 1
    return F.when(F.length(t) <= m, t).when(stop > 0.8 * m, F.substring(t, F.lit(1), stop + 1)).when(space > 0, F.substring(t, F.lit(1), space)).otherwise(head)


def number(text: Column, kind: str = "bigint") -> Column:
    """A number with thousands separators; null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(kind)


def group(text: Column, pattern: str, g: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, g), F.lit("")))


def every(text: Column, patterns: list[str]) -> Column:
    """All matches of all patterns (group 1 where there is one), as a sorted set."""
    each = [F.regexp_extract_all(text, F.lit(p), F.lit(1 if "(" in p.replace("(?", "") else 0)) for p in patterns]
    return F.array_sort(F.array_distinct(F.concat(*each)))


# Patterns of the typed extractors. "low" ones run on the lower-cased text.
EXTRACTORS: dict[str, tuple[str, bool, str]] = {
    "price_change_any": (r"(?i)(\d+\.?\d*)%?\s*(?:increase|decrease|change)", False, "double"),
    "index_value": (r"(?i)index.*?(\d+\.?\d*)", False, "double"),
    "overall_productivity": (r"(?i)(\d+\.?\d*)\s*m²?\s*per\s*manday", False, "double"),
    "hdb_productivity": (r"(?i)hdb.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", False, "double"),
    "private_productivity": (r"(?i)private.*?residential.*?(\d+\.?\d*)\s*m²?\s*per\s*manday", False, "double"),
    "land_size_hectares": (r"(\d+(?:\.\d+)?)\s*hectares?", True, "double"),
    "projected_units": (r"(\d+(?:,\d+)?)\s*(?:new\s+)?(?:bto\s+)?units?", True, "bigint"),
    "completion_timeline": (r"(?:by\s+|completion\s+.*?)(\d{4})", True, "string"),
    "affected_residents": (r"(\d+)\s*(?:residents?|households?|families)", True, "bigint"),
    "gfa_sqft": (r"(\d+(?:,\d+)?)\s*(?:sq\s*ft|square\s*feet)", True, "bigint"),
    "residential_units": (r"(\d+(?:,\d+)*)\s*(?:private\s*)?residential\s*units?", True, "bigint"),
    "commercial_gfa": (r"(\d+(?:,\d+)*)\s*(?:sq\s*m|sqm|square\s*metres?)\s*(?:of\s*)?(?:commercial\s*)?gfa", True, "bigint"),
    "hotel_rooms": (r"(\d+(?:,\d+)*)\s*hotel\s*rooms?", True, "bigint"),
    "ec_units": (r"(\d+(?:,\d+)*)\s*ec\s*units?", True, "bigint"),
    "price_change_percent": (r"([+-]?\d+\.?\d*)\s*%", False, "double"),
    "tender_closing": (r"tender\s*(?:closes?|closing)\s*(?:on\s*)?(\d{1,2}\s+\w+\s+\d{4})", True, "string"),
    "lease_until": (r"(?i)(?:to|until)\s+(\d{4})", False, "string"),
    "postal_code": (r"SG\((\d{6})\)", False, "string"),
}


#: Fields that count only where a word is in the text.
GUARDS = {"gfa_sqft": "tender"}
# Patterns of names, in order of preference, and of names that are all collected.
LOCATION = [r"(?:at\s+|in\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)(?:\s+(?:Road|Street|Avenue|Drive|Lane|Park|Estate|Town|Area))", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*?)\s+(?:development|project|site|area)"]
FACILITIES = [r"(?i)Pasir Panjang Wholesale Centre", r"(?i)Jurong Fishery Port", r"(?i)([A-Z][a-z]+ (?:Hawker Centre|Food Court|Market))"]
REGIONS = [r"(?i)(Pasir Panjang)", r"(?i)(Jurong)", r"(?i)(Lim Chu Kang)", r"(?i)(Sungei Tengah)", r"(?i)([A-Z][a-z]+ (?:Town|Area|Region))"]
NAMED_PLACES = [r"(Lim Chu Kang)", r"(Sungei Tengah)", r"(Pasir Panjang)", r"(Jurong)", r"([A-Z][a-z]+ [A-Z][a-z]+)"]


def location(text: Column) -> Column:
    """The place by the first pattern that matches, else null."""
    return F.coalesce(*[group(text, p) for p in LOCATION])


def effective_date(text: Column) -> Column:
    """The day from which something is effective, as a time stamp of midnight at +08:00; an impossible day is null."""
    found = group(F.lower(text), r"effective\s+(?:from\s+)?(\d{1,2}\s+\w+\s+\d{4})")
    day = F.try_to_timestamp(F.initcap(F.regexp_replace(found, r"\s+", " ")), F.lit("d MMMM yyyy"))
    return F.date_format(day, "yyyy-MM-dd'T00:00:00+08:00'")


def extract(text: Column, field: str) -> Column:
    pattern, low, kind = EXTRACTORS[field]
    found = group(F.lower(text) if low else text, pattern)
    if field in GUARDS:
        found = F.when(F.contains(F.lower(text), F.lit(GUARDS[field])), found)
    return found if kind == "string" else number(found, kind)


def release_id(text: Column, agency: str, sep: str = r"[_\s]*", pad: int = 0, any_case: bool = True) -> Column:
    """AGENCY_year_number; the number padded with zeros, never cut."""
    p = rf"{'(?i)' if any_case else ''}{agency}{sep}(\d{{4}}){sep}(\d+)"
    n = group(text, p, 2)
    n = F.when(F.length(n) < pad, F.lpad(n, pad, "0")).otherwise(n) if pad else n
    return F.concat(F.lit(f"{agency}_"), group(text, p, 1), F.lit("_"), n)


def reporting_period(text: Column) -> Column:
    return F.concat(F.lit("Q"), group(text, r"Q(\d)\s*(\d{4})", 1), F.lit("_"), group(text, r"Q(\d)\s*(\d{4})", 2))


def tenure_years(text: Column) -> Column:
    low, p = F.lower(text), r"(\d+)(?:\+(\d+))?\s*years?"
    return F.when(F.contains(low, F.lit("tender")), F.nullif(F.concat_ws("+", group(low, p, 1), group(low, p, 2)), F.lit("")))


def gls_period(text: Column) -> Column:
    return F.upper(group(F.lower(text), r"(\d+h\d{4})"))


def largest_amount(text: Column) -> Column:
    """The largest dollar amount."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\$(\d{1,3}(?:,\d{3})*)"), F.lit(1)), lambda x: number(x)))


def stable_id(prefix: str, url: Column, n: int = 8, day: Column | None = None) -> Column:
    key = F.substring(F.md5(url), 1, n)
    return F.concat_ws("_", F.lit(prefix), *([F.date_format(day, "yyyyMMdd")] if day is not None else []), key)
