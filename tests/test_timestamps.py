"""Written times against cases worked out by hand, and the operator on awkward tables."""

from __future__ import annotations

import pytest

from corpusloom.functions.dateparse import parse_written
from corpusloom.operators.timestamps import TimestampDictionary, host, publication_times
from corpusloom.plans.staging import Stage

CASES = [
    ("2019-05-19", None, False, ("2019-05-19T00:00:00Z", "day")),
    ("2013-04", None, False, ("2013-04-01T00:00:00Z", "month")),
    ("2011", None, False, ("2011-01-01T00:00:00Z", "year")),
    ("'17", None, False, None),
    ("17", None, False, None),
    ("20110202", None, False, ("2011-02-02T00:00:00Z", "day")),
    ("1301189382", None, False, ("2011-03-27T01:29:42Z", "time")),
    ("1303288180575", None, False, ("2011-04-20T08:29:40Z", "time")),
    ("3/4/11", None, False, ("2011-03-04T00:00:00Z", "day")),
    ("3/4/11", None, True, ("2011-04-03T00:00:00Z", "day")),
    ("13/08/2015", None, False, None),
    ("04.05.2019", None, True, ("2019-05-04T00:00:00Z", "day")),
    ("Apr. 5, 2024", None, False, ("2024-04-05T00:00:00Z", "day")),
    ("August 31st, 2021", None, False, ("2021-08-31T00:00:00Z", "day")),
    ("1-Apr-2012", None, False, ("2012-04-01T00:00:00Z", "day")),
    ("Sept 2014", None, False, ("2014-09-01T00:00:00Z", "month")),
    ("01/2014", None, False, ("2014-01-01T00:00:00Z", "month")),
    ("Fri, 01 Jul 2016 03:53:55 +0200", None, False, ("2016-07-01T01:53:55Z", "time")),
    ("2016-05-04T07:00:05.999-04:00", None, False, ("2016-05-04T11:00:05Z", "time")),
    ("2014-10-31 09:42:12 America/New_York", None, False, ("2014-10-31T13:42:12Z", "time")),
    ("April 3, 2016 12:05 AM", "America/Phoenix", False, ("2016-04-03T07:05:00Z", "time")),
    ("Apr 6 2014, 3:16 PM AEST", None, False, ("2014-04-06T05:16:00Z", "time")),
    # a doubled time: the first one, unless the zone says otherwise
    ("2017-11-05 01:30", "America/New_York", False, ("2017-11-05T05:30:00Z", "time")),
    ("2017-11-05 01:30:00 EST", "America/New_York", False, ("2017-11-05T06:30:00Z", "time")),
    # a skipped time: the offset before the change
    ("2017-03-12 02:30", "America/New_York", False, ("2017-03-12T07:30:00Z", "time")),
    ("2017-03-12 02:30:00 ET", None, False, ("2017-03-12T07:30:00Z", "time")),
    ("2017-02-29", None, False, None),
    ("0000-00-00", None, False, None),
    ("2014-14-32", None, False, None),
    ("n.d.", None, False, None),
    ("????-??-??", None, False, None),
    ("", None, False, None),
    (None, None, None, None),
    ("x" * 100_000, None, False, None),
]


@pytest.mark.parametrize(("raw", "zone", "day_first", "expected"), CASES)
def test_written(raw, zone, day_first, expected):
    assert parse_written(raw, zone, day_first) == expected


SCHEMA = "id bigint, source_pub_date string, fullcite string, source_url string, tz string, utc string"
OUTLETS = [("alder.example", "America/New_York", False), ("brack.example", "Europe/London", True)]


def _run(spark, rows):
    cards = spark.createDataFrame(rows, SCHEMA)
    outlets = spark.createDataFrame(OUTLETS, "domain string, tz string, day_first boolean")
    return sorted((r.id, r.pub_utc, r.grain) for r in publication_times(cards, outlets).collect())


def test_citation_where_the_date_tells_nothing(spark):
    cite = "Dov Zan – Staff Writer – Brack Courier, 7-8-2014 – A title of 1999 – https://brack.example/2001/1, Accessed: 1-2-2020"
    got = _run(spark, [
        (1, None, cite, "https://www.brack.example/a", "x", "y"),
        (2, "2017-02-29", 'A B (C). "Title 1998." Herald. 2018. https://x.example/2020, DOA: 1-1-2021', None, None, None),
        (3, "  03/04/2018 ", cite, "http://ALDER.example:80/a", None, None),
        (4, "no date", "A B, Staff Writer, no address, accessed 1-2-2020", None, None, None),
        (5, None, "Kessler 2026", None, None, None),
        (6, None, "Kessler ’26", None, None, None),
        (7, None, None, None, None, None),
        (8, "", "", "", "", ""),
        (9, "2018-01-01 10:00", None, "https://unknown.example", None, None),
        (9, "2018-01-01 10:00", None, "https://unknown.example", None, None),
    ])
    assert got == [
        (1, "2014-08-07T00:00:00Z", "day"), (2, "2018-01-01T00:00:00Z", "year"), (3, "2018-03-04T00:00:00Z", "day"),
        (5, "2026-01-01T00:00:00Z", "year"), (9, "2018-01-01T10:00:00Z", "time"), (9, "2018-01-01T10:00:00Z", "time"),
    ]


def test_a_year_in_a_title_is_no_date(spark):
    dashed = "Quell Ketlen – Senior Fellow – Ostrey Ledger, {} – A voluntary interconnector across the substation by 2030 – https://o.example/a/19, Accessed: 3-3-2026"
    cites = [dashed.format("no date"), dashed.format("n.d."), dashed.format("2016"), dashed.format("March 2016"), "Kessler and Zan 2016", "Kessler et al. 2016, Fellow",
             "[A B, Staff; n.d.; 'A levy by 2035'; Herald; https://x.example]", "A B, Staff, 2019, “Plans of 2035,” Herald, no address", "the plan for 2040 of the ledger", ", 2016"]
    got = _run(spark, [(k, None, c, None, None, None) for k, c in enumerate(cites)])
    assert [(i, u[:7], g) for i, u, g in got] == [(2, "2016-01", "year"), (3, "2016-03", "month"), (4, "2016-01", "year"), (5, "2016-01", "year"), (7, "2019-01", "year"), (9, "2016-01", "year")]


def test_no_length_is_too_long():
    raw = "Wednesday, 30th of September 2020 at 12:00:00.{} America/Argentina/ComodRivadavia"
    for digits in ("0", "0" * 40, "0" * 5000):
        assert parse_written(raw.format(digits), None, None) == ("2020-09-30T15:00:00Z", "time")
    assert parse_written("2020 " * 50_000, None, None) is None and parse_written("12:00:00 " + "a" * 200_000, None, None) is None


def test_empty_and_hot(spark):
    assert _run(spark, []) == []
    rows = [(k, "2015" if k % 3 else f"2015-01-{1 + k % 28:02d}", None, None, None, None) for k in range(3000)]
    got = _run(spark, rows)
    assert len(got) == 3000
    assert {g for i, _, g in got if i % 3} == {"year"}


def test_dictionary_grows_only_by_new_strings(spark):
    stage = Stage(spark, "test")
    words = TimestampDictionary(spark, stage.path("d"))
    rows = spark.createDataFrame([("2015", None, False), ("2016", "UTC", True), (None, None, None)], "raw string, zone string, day_first boolean")
    first = words.update(rows, stage)
    assert sorted((r.raw, r.n) for r in first.collect()) == [("2015", 1), ("2016", 1)]
    later = words.update(spark.createDataFrame([("2017", None, False)] + [("2015", None, False)] * 5, rows.schema), stage)
    assert sorted((r.raw, r.n, r.utc[:4]) for r in later.collect()) == [("2015", 5, "2015"), ("2017", 1, "2017")]  # counted anew
    assert sorted(r.raw for r in words.read().collect()) == ["2015", "2016", "2017"]


def test_host(spark):
    df = spark.createDataFrame([("https://u:p@www.A.example:8080/x",), ("a.example",), (None,), ("",)], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(host(F.col("u"))).collect()] == ["a.example", None, None, None]
