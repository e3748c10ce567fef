"""Identity keys and small text builders, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not distinguish one company from another.
GENERIC_WORDS = [
    "hotel", "hotels", "resort", "resorts", "spa", "and", "the", "travels", "travel", "tours", "tour",
    "holidays", "holiday", "pvt", "ltd", "private", "limited", "llp", "inc", "group", "dmc", "company",
    "services", "service", "trip", "trips", "stay", "stays", "inn", "rates", "rate",
]

# Words that name an edition of a package rather than the package.
EDITION_WORDS = [
    "off", "on", "season", "seasonal", "peak", "lean", "high", "low", "shoulder", "summer", "winter", "spring",
    "autumn", "monsoon", "festive", "festival", "diwali", "christmas", "xmas", "newyear", "holi", "puja", "pooja",
    "special", "offer", "offers", "deal", "deals", "promo", "promotional", "early", "bird", "revised", "revision",
    "updated", "update", "new", "latest", "final", "rates", "rate", "tariff", "tariffs", "price", "prices",
    "pricing", "package", "packages", "pkg", "tour", "tours", "holiday", "holidays", "trip", "b2b", "net", "rack",
    "edition", "version", "ver", "sheet", "card", "cost", "costing", "quote", "quotation", "valid", "validity",
    "from", "till", "to", "and", "the", "of", "for", "with", "nights", "night", "days", "day",
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "january",
    "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
]

# What years and night or day counts, versions and ordinals look like in a title.
YEARS = r"\b(19|20)\d{2}(\s*\d{2,4})?\b"
COUNTS = r"\b\d+\s*n\s*\d+\s*d\b|\b\d+\s*[nd]\b|\bv\d+\b|\b\d+(st|nd|rd|th)?\b"

# Order of occupancies on a rate card.
OCCUPANCY_ORDER = ["single", "double", "triple", "extra_adult", "child_with_bed", "child_without_bed", "per_person"]

WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def name_key(c) -> Column:
    """Lower case, anything but letters and digits becomes one space."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9 ]+", " "), " +", " "))


def core_title(title, base_name=None) -> Column:
    """A package title without years, night/day counts, ordinals and edition words."""
    base = F.nullif(F.trim(col(base_name)), F.lit("")) if base_name is not None else F.lit(None).cast("string")
    k = name_key(F.coalesce(base, col(title)))
    k = F.regexp_replace(F.regexp_replace(k, YEARS, " "), COUNTS, " ")
    stop = F.array(*[F.lit(w) for w in EDITION_WORDS])
    words = F.filter(F.split(F.trim(F.regexp_replace(k, " +", " ")), " "), lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(name_key(title))


def weekday(d) -> Column:
    """mon..sun of a date."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(col(d)) + 1)


def sold_on_weekday(weekdays, d) -> Column:
    """No restriction, or the date's weekday is one of the listed days."""
    return col(weekdays).isNull() | F.array_contains(F.split(col(weekdays), ","), weekday(d))


def occupancy_rank(c) -> Column:
    pos = F.array_position(F.array(*[F.lit(o) for o in OCCUPANCY_ORDER]), col(c))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(9))


def overlaps(a_from, a_to, b_from, b_to) -> Column:
    return (col(a_from) <= col(b_to)) & (col(b_from) <= col(a_to))


def overlap_days(a_from, a_to, b_from, b_to) -> Column:
    days = F.datediff(F.least(col(a_to), col(b_to)), F.greatest(col(a_from), col(b_from))) + 1
    return F.greatest(F.lit(0), days)


def year_later(d) -> Column:
    return F.add_months(col(d), 12)


def active_on(d, status="status", start="valid_from", end="valid_to") -> Column:
    return (col(status) == "active") & (col(start) <= d) & (col(end) >= d)


def contains_text(needle, *columns) -> Column:
    """Case-insensitive literal substring in any of the columns (wildcards in the needle mean themselves)."""
    low = F.lower(col(needle) if isinstance(needle, Column) else F.lit(needle))
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(col(c)), low), F.lit(False)) for c in columns])


def rate_state(status, start, end, today) -> Column:
    return (
        F.when(col(status) != "active", "replaced")
        .when(col(end) < today, "expired")
        .when(col(start) > today, "upcoming")
        .otherwise("current")
    )


def emails(c) -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda e: F.lower(F.trim(e)))
    return F.array_distinct(F.filter(parts, lambda e: e != ""))


def phone_keys(c) -> Column:
    digits = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.regexp_replace(p, r"\D", ""))
    return F.array_distinct(F.transform(F.filter(digits, lambda p: F.length(p) >= 8), lambda p: F.right(p, F.lit(10))))


def fill(old, new) -> Column:
    """Keep what is there, fill what is blank."""
    return F.coalesce(F.nullif(col(old), F.lit("")), col(new))


def cell_text(c) -> Column:
    """A cell on one line: runs of white space become one space, missing is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def number_text(c) -> Column:
    """Whole numbers without a decimal point."""
    x = col(c)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
