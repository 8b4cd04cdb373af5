"""Results tables that come as text with one cell to a line: detection, columns, rows. Each works inside one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from evipack.functions.text import let, lines

# What a line of such a table looks like.
NUMERIC = r"^-?[\d,]+\.?\d*\s*[%€$]?$|^-?\d+\.\d+p?$|^n\.a\.$"
PERIOD = r"(?i)^(Q[1-4][\s-]Q[1-4]\s*\d{4}|Q[1-4]\s*\d{4}|FY\s*\d{4})$"
DATE_HEADER = r"^[A-Z][a-z]+\.?\s+\d{1,2},\s+\d{4}$"
PERIOD_START = r"(?i)^(Q[1-4][- ]Q[1-4]|Q[1-4]|FY)$"
YEAR = r"^20\d{2}$"
UNIT_LINE = r"(?i)^(millions of\s*[€$]?|in\s+EUR|in\s+USD|thousands)\s*$"
NOISE = ["Change", "%", "millions of €", "in EUR", "in USD", "EUR", "USD", "thousands", "Q1-Q3", "Q1-Q2", "Q1", "Q2", "Q3", "Q4"]
UNITS = ("millions of", "thousands", "in eur", "in usd")
#: A unit in upper or lower case; of letters that are not ASCII none has a lower case that stands in one.
UNIT = rf"(?i)(?=[{''.join(sorted({u[0] for u in UNITS}))}])(?:{'|'.join(UNITS)})"
ENDINGS = ("forward-looking statements", "comments on the table")
MIN_LINES, MIN_NUMERIC = 20, 0.2


def has_table(text: Column) -> Column:
    def numeric(own: Column) -> Column:
        share = F.size(F.filter(own, lambda x: x.rlike(NUMERIC))) / F.size(own)
        return F.when(F.size(own) >= MIN_LINES, share >= MIN_NUMERIC).otherwise(False)

    return F.when(text.rlike(UNIT), let(lines(text), numeric)).otherwise(False)


def _from(own: Column, head) -> Column:
    """The lines from the first one that `head` takes for a header; none if there is no such line."""
    at = F.array_position(F.transform(own, head), True)
    return F.when(at > 0, F.slice(own, at.cast("int"), F.greatest(F.size(own), F.lit(1)))).otherwise(F.slice(own, 1, 0))


def _is_head(x: Column) -> Column:
    return x.rlike(PERIOD) | x.rlike(DATE_HEADER) | (x == "millions of €")


def table_start(own: Column) -> Column:
    """Position (from 0) of the first header line; null if there is none."""
    return let(F.array_position(F.transform(own, _is_head), True), lambda at: F.when(at > 0, at - 1))  # nullif would have it looked for in texts without a table too


def narrative(raw: Column, cleaned: Column) -> Column:
    """The lines of `cleaned` before the table of `raw`; all of them without a table, or if it starts at once."""
    own = F.filter(F.split(cleaned, "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    start = table_start(lines(cleaned))
    return F.when(has_table(raw) & (start > 0), F.array_join(F.slice(own, 1, F.greatest(start, F.lit(1)).cast("int")), "\n")).otherwise(cleaned)


def parse_rows(text: Column) -> Column:
    """array of struct(metric, values): each label with the numbers that follow it."""
    kind = "struct<label:string,vals:array<string>,found:array<struct<metric:string,values:array<string>>>,ended:boolean>"
    start = F.struct(F.lit(None).alias("label"), F.array().alias("vals"), F.array().alias("found"), F.lit(False).alias("ended")).cast(kind)

    def state(label, vals, found, ended) -> Column:
        return F.struct(label.alias("label"), vals.alias("vals"), found.alias("found"), ended.alias("ended")).cast(kind)

    def closed(s: Column) -> Column:
        return F.when(s.label.isNotNull() & (F.size(s.vals) > 0), F.array_append(s.found, F.struct(s.label.alias("metric"), s.vals.alias("values")))).otherwise(s.found)

    def step(s: Column, x: Column) -> Column:
        ends = F.lit(False)
        for ending in ENDINGS:
            ends = ends | F.lower(x).contains(ending)
        skipped = x.rlike(PERIOD) | x.rlike(DATE_HEADER) | x.isin(NOISE) | x.rlike(YEAR) | x.rlike(r"^Q\d-Q\d$")
        labels = F.length(x).between(2, 90) & ~x.endswith(".")
        return (
            F.when(s.ended, s)
            .when(ends, state(s.label, s.vals, s.found, F.lit(True)))
            .when(skipped, s)
            .when(x.rlike(NUMERIC), state(s.label, F.array_append(s.vals, x), s.found, s.ended))
            .when(labels, state(x, F.array(), closed(s), s.ended))
            .otherwise(s)
        )

    return F.aggregate(_from(lines(text), _is_head), start, step, closed)


def parse_columns(text: Column) -> Column:
    """Labels of the table's columns, from its header lines, as they are spaced there.

    A bare year after a bare quarter counts as a number and ends the header, so such a column is named by its quarter.
    """
    kind = "struct<cols:array<string>,cur:string,ended:boolean>"
    start = F.struct(F.array().alias("cols"), F.lit(None).alias("cur"), F.lit(False).alias("ended")).cast(kind)

    def head(x: Column) -> Column:
        return x.rlike(PERIOD) | x.rlike(DATE_HEADER) | x.rlike(PERIOD_START) | x.rlike(UNIT_LINE)

    def flushed(s: Column) -> Column:
        return F.when(s.cur.isNotNull(), F.array_append(s.cols, s.cur)).otherwise(s.cols)

    def state(cols, cur, ended=None) -> Column:
        return F.struct(cols.alias("cols"), cur.alias("cur"), (F.lit(False) if ended is None else ended).alias("ended")).cast(kind)

    none = F.lit(None).cast("string")

    def step(s: Column, x: Column) -> Column:
        return (
            F.when(s.ended, s)
            .when(x.rlike(NUMERIC), state(s.cols, s.cur, F.lit(True)))
            .when(x.rlike(PERIOD), state(F.array_append(flushed(s), F.upper(x)), none))
            .when(x.rlike(PERIOD_START), state(flushed(s), F.replace(F.upper(x), F.lit(" "), F.lit("-"))))
            .when(x == "Change", state(flushed(s), F.lit("Change")))
            .when((x == "%") & (s.cur == "Change"), state(s.cols, F.lit("Change %")))
            .when(x.rlike(UNIT_LINE), state(flushed(s), none))
            .when(x.rlike(DATE_HEADER), state(F.array_append(flushed(s), x), none))
            .otherwise(state(s.cols, s.cur, F.lit(True)))
        )

    return F.aggregate(_from(lines(text), head), start, step, flushed)


def facts(text: Column) -> Column:
    """array of struct(metric, period, value): value i belongs to column i; change columns are left out, and of a metric
    and period that come again, the first counts."""

    def cells(t: Column) -> Column:
        return F.flatten(F.transform(t.found, lambda r: F.transform(t.cols, lambda c, i: F.struct(r.metric.alias("metric"), c.alias("period"), F.get(r["values"], i).alias("value")))))

    def firsts(kept: Column) -> Column:
        # Keys in order of first appearance; each takes the first of its values.
        keys = F.transform(kept, lambda x: F.struct(x.metric.alias("metric"), x.period.alias("period")))
        return let(keys, lambda k: F.filter(kept, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1))

    each = let(F.struct(parse_rows(text).alias("found"), parse_columns(text).alias("cols")), cells)
    return let(F.filter(each, lambda x: x.value.isNotNull() & ~x.period.startswith("Change")), firsts)
