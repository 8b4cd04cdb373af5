"""Scalars on small literals: known answers and quirks."""

import datetime as dt

from pyspark.sql import functions as F

from evipack.functions import dates, tables, text
from evipack.sources import normalize

TABLE = "\n".join(["Narrative first.", "Q1 2024", "Q1 2023", "Change", "%", "FY 2023", "millions of €", "Net revenue", "27,942", "27,839", "0.4", "111,970", "EBITDA", "10.5", "9.9", "6.1", "40.0", "2050", "Staff", "7", "8", "Net revenue", "1", "2", "3", "4"])


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_dates(spark):
    day = lambda t: tuple(one(spark, t, dates.find_date))
    assert day("Bonn, March 5, 2024. In 2022") == (dt.datetime(2024, 3, 5), "day")
    assert day("In March 2024 the company") == (dt.datetime(2024, 3, 1), "month")
    assert day("No date here at all") == (None, "unknown")
    assert day("2021 then 2022 then 2022, by 2029") == (dt.datetime(2022, 7, 1), "year")
    assert day("2021 and 2020") == (dt.datetime(2021, 7, 1), "year")
    assert day("February 30, 2023") == (dt.datetime(2023, 7, 1), "year")
    assert one(spark, "the Fourth quarter of 2023", dates.infer_quarter) == "Q4 2023"
    assert one(spark, "Q4 2023", dates.report_date) == dt.datetime(2024, 2, 25)
    assert one(spark, "fy2022 or Q1 2024, FY 2022", dates.periods) == ["FY 2022", "Q1 2024"]


def test_freshness_counts_whole_days(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' AS o, timestamp_ntz'2024-03-31 23:00:00' AS on_time, timestamp_ntz'2024-04-01 23:00:00' AS late, timestamp_ntz'2023-01-01' AS past")
    found = rows.select(*[dates.freshness(F.col("o"), F.col(c)) for c in ("on_time", "late", "past")], dates.freshness(F.lit(None).cast("timestamp_ntz"), F.col("o"))).first()
    assert tuple(found) == ("fresh", "aging", "fresh", "unknown")


def test_terms(spark):
    assert one(spark, "The revenue. Revenue of Q1 in full-year AI a-b", text.terms) == ["revenue.", "revenue", "q1", "fy", "ai", "a-b"]


def test_chunks(spark):
    chunks = lambda t: one(spark, t, lambda c: text.chunks(c, 10))
    assert chunks("aaaaa\n\n  bbbbb \nc") == ["aaaaa\nbbbbb", "c"]
    assert chunks("x" * 30) == ["x" * 30] and chunks("") == [] and chunks(" \n\t") == []


def test_boilerplate_and_hash(spark):
    assert one(spark, "a  \t b Drop this. c", lambda c: text.strip_boilerplate(c, [r"Drop this\."])) == "a b c"
    hashed = one(spark, "t", lambda c: text.content_hash(c, c, F.lit(None), F.lit("unknown"), F.lit("public"), F.lit(0.9)))
    import hashlib

    assert hashed == hashlib.sha256(b"t|t|None|unknown|public|0.9").hexdigest()


def test_texts_are_read_once(spark):
    """One pattern finds all dates; pieces are formed once, and the start of a table is looked for only where there is one."""
    docs, titles = (spark.createDataFrame([("1", "a. In May 2021")], f"doc_id string, {c} string") for c in ("text", "title"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(docs.select(dates.find_date(F.col("text")).alias("found"))).count("regexp_extract") == 1
    pieces = plan(normalize.press_releases(docs, titles, [r"Drop this\."]))
    assert pieces.count("aggregate(") == 1 and "common_expr" not in pieces


def test_dates_that_meet(spark):
    """Dates beside, after and within one another: the first of each kind counts, and all years."""
    of = lambda x: tuple(one(spark, x, dates.find_date))
    day = dt.datetime
    assert of("In March 2021, May. 7, 2022 or May 8, 2023") == (day(2022, 5, 7), "day") and of("May 20, 20211 and June 2020") == (day(2020, 6, 1), "month")
    assert of("xMay 5, 2021") == (day(2021, 7, 1), "year") and of("May 32, 2024; May. 2020; 2020") == (day(2020, 7, 1), "year")
    assert of("February 30, 2022, March 4, 2023") == (day(2022, 7, 1), "year") and of("2018 2027 2050 20199") == (None, "unknown") and of("May 2020, 2021 2021") == (day(2020, 5, 1), "month")


def test_table(spark):
    assert one(spark, TABLE, tables.has_table) is True
    assert one(spark, TABLE, tables.parse_columns) == ["Q1 2024", "Q1 2023", "Change %", "FY 2023"]
    facts = [tuple(x) for x in one(spark, TABLE, tables.facts)]
    assert facts[:3] == [("Net revenue", "Q1 2024", "27,942"), ("Net revenue", "Q1 2023", "27,839"), ("Net revenue", "FY 2023", "111,970")]
    assert ("EBITDA", "FY 2023", "40.0") in facts and len(facts) == 8  # 2050 counts as a header, the second Net revenue is left out
    assert one(spark, TABLE, lambda c: tables.narrative(c, c)) == "Narrative first."
    starts = TABLE.split("\n", 1)[1]
    assert one(spark, starts, lambda c: tables.narrative(c, c)) == starts  # a table at the start is not cut
    assert one(spark, "Q1\n2024\n5", tables.parse_columns) == ["Q1"]
    assert one(spark, "FY2022\n5", tables.parse_columns) == ["FY2022"]
    assert one(spark, "no table", tables.facts) == []


def test_record_text(spark):
    row = spark.sql("SELECT 'T' AS t, 'Sum.' AS s, array('a', 'b') AS m, array() AS o, CAST(NULL AS array<string>) AS p")
    found = row.select(text.record_text(*[F.col(c) for c in "tsmop"], F.lit(None).cast("array<string>"))).first()[0]
    assert found == "T. Sum. Key metrics: a; b."
