"""Date dialects: ordered patterns, the first whose match is a date wins; no pattern gives null or a given day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
_SHORT, _LONG = "|".join(m[:3].title() for m in MONTHS), "|".join(m.title() for m in MONTHS)
_DMON, _DMONTH = rf"(\d{{1,2}})\s+({_SHORT})\s+(\d{{4}})", rf"(\d{{1,2}})\s+({_LONG})\s+(\d{{4}})"
_LOOSE_YMD = r"(\d{4})-(\d{1,2})-(\d{1,2})"
_YMD, _DMY_SLASH, _DMY_DASH = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{1,2})-(\d{1,2})-(\d{4})"
#: Each dialect: patterns with the groups of year, month and day; whether case matters in the pattern, in month names.
DIALECTS = {
    "five": ([(_DMON, 3, 2, 1), (_DMONTH, 3, 2, 1), (_YMD, 1, 2, 3), (_DMY_SLASH, 3, 2, 1), (_DMY_DASH, 3, 2, 1)], False, False),
    "strict": ([(_DMON, 3, 2, 1), (_DMONTH, 3, 2, 1), (_YMD, 1, 2, 3), (_DMY_SLASH, 3, 2, 1)], True, True),
    "titled": ([(_DMON, 3, 2, 1), (_LOOSE_YMD, 1, 2, 3), (_DMY_SLASH, 3, 2, 1), (_DMONTH, 3, 2, 1)], False, True),
}


def _day(text: Column, pattern: str, y: int, m: int, d: int, exact_months: bool) -> Column:
    """The date of the first match: the match is found once, and taken apart in its own few characters."""
    found = F.regexp_extract(text, pattern, 0)
    year, month, day = (F.regexp_extract(found, pattern, g) for g in (y, m, d))
    if _SHORT[:3] in pattern:
        names = "".join(m[:3].title() for m in MONTHS)
        at = F.instr(F.lit(names if exact_months else names.lower()), F.substring(month if exact_months else F.lower(month), 1, 3))
        month = F.when(at > 0, (at + 2).cast("int") / 3).cast("int").cast("string")
    return F.when(found != "", F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


#: Whatever any pattern can match lies in a run of digits, slashes and dashes, with month names between digits.
_REGION = rf"(?i)\d(?:[\d/-]|\s+(?:{_LONG}|{_SHORT})\s+(?=\d))*"


def find_date(text: Column, dialect: str = "five", otherwise: Column | None = None) -> Column:
    """The first date by the dialect's pattern order; an impossible day goes on to the next pattern.

    The text is scanned once for places where a date can be; the patterns are matched in these few characters.
    """
    patterns, case, exact = DIALECTS[dialect]
    slashed = F.contains(text, F.lit("/"))

    def day(places: Column) -> Column:
        days = [_day(places, p if case else f"(?i){p}", y, m, d, exact) for p, y, m, d in patterns]
        if dialect == "titled":  # a slash anywhere makes year-first dates read as day-first, which they are not
            days[1] = F.when(~slashed, days[1])
        return F.coalesce(*days)

    places = F.array_join(F.regexp_extract_all(text, F.lit(_REGION), F.lit(0)), "|")
    found = F.get(F.transform(F.array(places), day), 0)
    return found if otherwise is None else F.coalesce(found, otherwise)


def parse_formats(text: Column, otherwise: Column | None = None) -> Column:
    """A whole string in one of four formats."""
    forms = ["yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms], *([otherwise] if otherwise is not None else []))


def wall_clock(stamp: Column) -> Column:
    """A stored time stamp as local wall clock; a zone label at the end is dropped."""
    return F.regexp_replace(stamp, r"(Z|\+08:00)$", "").try_cast("timestamp_ntz")


def in_range(day: Column, first: str, last: str, keep_null: bool = True) -> Column:
    inside = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.coalesce(inside, F.lit(keep_null))


def year_span(first: Column, last: Column) -> Column:
    """Every year from first to last; empty if either is no number or last is before first."""
    a, b = first.try_cast("int"), last.try_cast("int")
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def period(text: Column) -> Column:
    """2008-Q1, 20252Q, 2017-12 or a year, as its first day."""
    year = F.substring(text, 1, 4).try_cast("int")
    quarter = F.coalesce(F.nullif(F.regexp_extract(text, r"^\d{4}-Q([1-4])$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^\d{4}([1-4])Q$", 1), F.lit(""))).try_cast("int")
    month = F.nullif(F.regexp_extract(text, r"^\d{4}-(0[1-9]|1[0-2])$", 1), F.lit("")).try_cast("int")
    first = F.coalesce((quarter - 1) * 3 + 1, month, F.when(text.rlike(r"^\d{4}$"), 1))
    return F.when(first.isNotNull(), F.make_date(year, first, F.lit(1)))


def slug_date(text: Column, slug: Column, otherwise: Column) -> Column:
    """A page's date: a month-first date is looked for but not read by the strict dialect, so the year in the address decides.

    That year is the first number of the address that begins with 20 and two more digits; an id after it is none.
    """
    near = F.regexp_extract(text, r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}\b", 0)
    named = F.regexp_extract(slug, r"(?:^|\D)(20\d{2})", 1)
    year = F.when(named.isin("2023", "2024"), F.concat(named, F.lit("-06-01")).try_cast("date"))
    return F.coalesce(F.when(near != "", find_date(near, "strict")), year, otherwise)


def from_epoch(seconds: Column) -> Column:
    """ISO form of an epoch in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


# Zones that RFC 822 names, in minutes from UTC.
ZONES = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def feed_time(stamp: Column) -> Column:
    """A feed's time (RFC 822) in UTC, with the label +08:00 put to it; null if it is none. Unknown and missing zones count as UTC."""
    p = r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})(?:\s+([+-]\d{4}|[A-Z]{1,4}))?"
    wall, zone = F.try_to_timestamp(F.regexp_extract(stamp, p, 1), F.lit("d MMM yyyy HH:mm:ss")), F.regexp_extract(stamp, p, 2)
    digits = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone)
    minutes = F.coalesce(F.when(zone.startswith("-"), -digits).when(zone.startswith("+"), digits), named, F.lit(0))
    return F.date_format(F.timestamp_add("MINUTE", -minutes, wall), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
