"""Dates and periods in text, and the freshness grade."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from evipack.functions.text import let
from evipack.schema import DEFAULTS

# What a date must not touch (letters, numbers and underscores of any script, whatever `\b` means to the engine); how dates,
# months, years and quarters are written; which years are plausible.
WORD = r"[\p{L}\p{N}_]"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
FULL_DATE = rf"({MONTHS})\.? (\d{{1,2}}), (20\d\d)"
MONTH_DATE = rf"({MONTHS}) (20\d\d)"
YEAR = r"(20[12]\d)"
QUARTER = r"(Q[1-4])\s+(\d{4})"
PROSE_QUARTER = r"(?i)(first|second|third|fourth)\s+quarter\s+of\s+(\d{4})"
FIRST_YEAR, LAST_YEAR = 2019, 2026
# Typical month and day on which a quarter's results appear; the fourth quarter's in the next year.
REPORTED = {"Q1": (5, 15), "Q2": (8, 10), "Q3": (11, 10), "Q4": (2, 25)}
# Quarters in prose.
PROSE = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}


def alone(pattern: str) -> str:
    """`pattern` where no letter, number or underscore touches it."""
    return rf"(?<!{WORD}){pattern}(?!{WORD})"


#: Any of FULL_DATE, MONTH_DATE and a year of this century, alone. Looking for a sign that one can begin with spares the rest at all others.
MENTION = rf"(?=[ADFJMNOS2]){alone(rf'(?:(?:{MONTHS})(?:\.? \d{{1,2}},)? )?20\d\d')}"


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, alone(pattern), group), F.lit(""))


def _parsed(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")


def commonest(values: Column) -> Column:
    """The value that occurs most often; of equals, the one seen first."""

    def best(own: Column) -> Column:
        counted = F.transform(
            F.array_distinct(own),
            lambda y: F.struct(F.size(F.filter(own, lambda z: z == y)).alias("n"), (-F.array_position(own, y)).alias("at"), y.alias("value")),
        )
        return F.array_max(counted).getField("value")

    return let(values, best)


def find_date(text: Column) -> Column:
    """struct(observed_at, precision): a full date, else a month, else the commonest plausible year, else nothing.

    A date that is not in the calendar counts as absent. The text is read once, for all years with what stands before them: a full date
    and a month end in a year and hold nothing that another one could begin with, so the first of each kind is among them.
    """

    def dated(own: Column) -> Column:
        day = _parsed(F.translate(F.get(F.filter(own, lambda m: m.contains(",")), F.lit(0)), ".,", ""), "MMMM d yyyy")
        month = _parsed(F.get(F.filter(own, lambda m: ~m.contains(",") & m.contains(" ")), F.lit(0)), "MMMM yyyy")
        years = F.filter(F.transform(own, lambda m: F.right(m, F.lit(4))), lambda y: y.cast("int").between(FIRST_YEAR, LAST_YEAR))
        year = F.make_date(commonest(years).cast("int"), F.lit(7), F.lit(1)).cast("timestamp_ntz")
        return let(
            F.struct(day.alias("day"), month.alias("month"), year.alias("year")),
            lambda d: F.struct(
                F.coalesce(d.day, d.month, d.year).alias("observed_at"),
                F.when(d.day.isNotNull(), "day").when(d.month.isNotNull(), "month").when(d.year.isNotNull(), "year").otherwise("unknown").alias("precision"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), dated)


def infer_quarter(text: Column) -> Column:
    """`Qn yyyy` of a text, as written or in prose; null if there is none."""
    word = F.lower(_first(text, PROSE_QUARTER, 1))
    named = F.lit(None).cast("string")
    for spelling, quarter in PROSE.items():
        named = F.when(word == spelling, quarter).otherwise(named)
    blank = F.lit(" ")
    return F.coalesce(F.concat(_first(text, QUARTER, 1), blank, _first(text, QUARTER, 2)), F.concat(named, blank, _first(text, PROSE_QUARTER, 2)))


def report_date(quarter: Column) -> Column:
    """The day on which the results of `Qn yyyy` typically appear."""
    name, year = F.substring(quarter, 1, 2), F.substring(quarter, 4, 4).cast("int")
    found = F.lit(None).cast("date")
    for q, (month, day) in REPORTED.items():
        found = F.when(name == q, F.make_date(year + (1 if q == "Q4" else 0), F.lit(month), F.lit(day))).otherwise(found)
    return found.cast("timestamp_ntz")


def freshness(observed: Column, as_of: Column, fresh: int = DEFAULTS.fresh_days, stale: int = DEFAULTS.stale_days) -> Column:
    """Grade by whole days of age; what lies in the future is fresh."""
    age = F.floor(F.timestamp_diff("SECOND", observed, as_of) / 86400)
    return F.when(observed.isNull(), "unknown").when(age <= fresh, "fresh").when(age <= stale, "aging").otherwise("stale")


def periods(task: Column) -> Column:
    """Periods that a task names, written alike, each once."""
    found = F.regexp_extract_all(task, F.lit(r"(?i)\b((?:Q[1-4]|FY)\s?20\d\d)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(F.upper(p), r"^(Q[1-4]|FY)\s*", "$1 ")))


def years(task: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(task, F.lit(r"\b20\d\d\b"), F.lit(0)))
