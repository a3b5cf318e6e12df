"""Free-form dates, held against the parser of the standard Python date library."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from dateutil.parser import parse
from pyspark.sql import functions as F

from tablewright.functions.convert import to_date_column
from tablewright.functions.dates import free_date

DEFAULT = datetime(2031, 5, 30)
DAYS = ("2003-9-25", "2003/09/25", "2003.09.25", "09/25/2003", "25.09.2003", "9-25-03", "10/11/12", "99-12-31", "31/12/99", "13/5/04",
        "25 Sep 2003", "Sep 25 2003", "September 25, 2003", "25-SEP-2003", "2003 Sept 25", "3rd of May 2001", "2003-Sep-25", "Sep-25-2003",
        "Thu, 25 Sep 2003", "Thursday, September 25, 2003", "sat 5 jan 68", "20030925", "030925", "991231", "Feb 2003", "Sep 03", "2003", "07", "99", "5/2003",
        "2003-02", "February", "9 Feb", "feb. 9, 2003", "1 jan '99", "2003 25 Sep", "May 5 2001 AD", "0099-01-02")
CLOCKS = ("", " 10:36", " 10:36:28", " 10:36:28.5", " 10:36:28,123456", "T10:36:28Z", " 10:36:28 +0300", " 1:05 pm", " 12:01am", " at 9 p.m.", " 10pm", " 12 AM",
          " 10h36m28.5s", " 10:36:28 GMT", " 10:36 EST", " 23:59:59.999999")


def expected(text: str):
    try:
        return parse(text, default=DEFAULT).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def read(spark, texts):
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", free_date(F.col("t"), F.to_date(F.lit("2031-05-30"))).alias("d")).collect()
    return {r.t: r.d for r in rows}


@pytest.mark.filterwarnings("ignore")
def test_layouts_agree_with_the_plain_parser(spark):
    texts = [d + c for d, c in itertools.product(DAYS, CLOCKS)]
    texts += ["Thu Sep 25 10:36:28 2003", "Thu Sep 25 10:36:28 BRST 2003", "10:36:28 25 Sep 2003", "10am 2003-09-25", "10:36", "5pm", "20030925T104941", "20030925T1049",
              "20030925104941", "200309251049", "2003-09-25T10", "2003-09-25 1049", "2003-09-25 104941", "20030925 104941", "Wed, July 10, '96",
              "Fri, 11 Nov 2011 03:18:09 -0400", "2012-04-23T18:25:43.511Z", "June 3rd, 2010 at 4:15 PM", "31/2/2003", "2003-13-01", "25:10", "10:61"]
    got = read(spark, texts)
    wrong = {t: (got[t], expected(t)) for t in got if got[t] != expected(t)}
    assert not wrong
    assert sum(d is not None for d in got.values()) > 550
    assert read(spark, ["2003-09-25 10 h"]) == {"2003-09-25 10 h": datetime(2003, 9, 25, 10)}


@pytest.mark.filterwarnings("ignore")
def test_random_dates_agree_with_the_plain_parser(spark):
    draw = random.Random(5)
    shapes = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%y", "%m-%d-%y", "%B %d, %Y", "%d %b %y", "%b %d %Y", "%Y%m%d", "%a %b %d %Y", "%y%m%d", "%d-%b-%Y", "%Y/%d/%m")
    tails = ("", " %H:%M", " %H:%M:%S", "T%H:%M:%S.%f", " %I:%M %p", " %I%p", " %I:%M:%S %p")
    texts = []
    for _ in range(3000):
        at = datetime(draw.randint(1985, 2075), draw.randint(1, 12), draw.randint(1, 28), draw.randint(0, 23), draw.randint(0, 59), draw.randint(0, 59), draw.randint(0, 999999))
        texts.append(at.strftime(draw.choice(shapes) + draw.choice(tails)))
    got = read(spark, texts)
    assert not {t: (got[t], expected(t)) for t in got if got[t] != expected(t)}


def test_what_is_no_date(spark):
    texts = ["hello", "12 monkeys", "2003-09-25 and more", "1 2 3 4 5", "jan feb 2003", "", " ", "-", "10:36 13pm", "13 pm", "£5", "2003-09-25 10:36 11:12", "x" * 100_000, "1" * 100_000, "1/" * 50_000]
    assert set(read(spark, texts).values()) == {None}
    df = spark.createDataFrame([(None,), ("NaT",), ("",), ("3 May 2001",)], "t string")
    assert [r.d for r in df.select(to_date_column(F.col("t")).alias("d")).collect()] == [None, None, None, datetime(2001, 5, 3)]
    with pytest.raises(Exception, match="not a date"):
        spark.createDataFrame([("12 monkeys",)], "t string").select(to_date_column(F.col("t")).alias("d")).collect()
