"""Times that texts name, rule by rule."""

from datetime import datetime

from pyspark.sql import functions as F

from colloquy.functions import dates

NOW = datetime(2024, 3, 1, 10, 30, 20)  # a Friday
#: Text, and day and time of March 2024 where not given as a whole.
CASES = {
    "tomorrow at 3pm": (2, 15), "day after tomorrow": (3, 9), "next monday": (4, 9), "friday": (8, 9), "this fri": (8, 9), "mon, please": (4, 9), "tue, please": None, "tue": (5, 9),
    "thu, please": None, "tonight": (1, 20), "this evening": (1, 20), "tonight at 9pm": (1, 21), "end of day": (1, 17), "EOD": (1, 17), "this weekend": (2, 9), "next week": (11, 9),
    "next month": datetime(2024, 4, 1, 9), "end of month": (31, 9), "eow": (8, 9), "in 2 hours": datetime(2024, 3, 1, 12, 30, 20), "in an hour": datetime(2024, 3, 1, 11, 30, 20),
    "in 1 hour or in 5 days": datetime(2024, 3, 1, 11, 30, 20), "in 2 days at 5pm": (3, 17), "in  2 days": None, "in 3weeks": datetime(2024, 3, 22, 10, 30, 20), "in 9999999999999 weeks": None,
    "in 99999999999999999999 weeks": None, "tomorrow in 99999999999999999999 weeks": (2, 9), "again in 20 min": None, "call in 20 min": datetime(2024, 3, 1, 10, 50, 20),
    "at 9:15am": (2, 9, 15), "at 11am": (1, 11), "at 10:30": (2, 10, 30), "at 10:31": (1, 10, 31), "at 12 am": (2, 0), "at 12pm": (1, 12), "at 25": None, "at 10:60": None, "at 13pm": (1, 13),
    "at ten, or 3pm": None, "2:30p.m. sharp": (1, 14, 30), "room 12 3pm": (1, 15), "noon": (1, 12), "afternoon": (1, 12), "midnight": (2, 0), "morning": (2, 9), "evening": (1, 18),
    "at 9:1:5": (2, 9, 15), "at 11:1:5": (1, 11, 15), "at 11:99999999999": (1, 11), "Jan 5": datetime(2025, 1, 5, 9), "March 1": (1, 9), "may 18th": datetime(2024, 5, 18, 9),
    "maybe 5 in June 6": datetime(2024, 6, 6, 9), "Feb 29": datetime(2024, 2, 29, 9), "Feb 30": None, "april": None, "5/18": datetime(2024, 5, 18, 9), "1/2": datetime(2024, 1, 2, 9),
    "5/18/2026 at 8pm": datetime(2026, 5, 18, 20), "5/18/26": datetime(26, 5, 18, 9), "99/5/6": datetime(2024, 5, 6, 9), "2/30 or 5/6": datetime(2024, 5, 6, 9), "9999999999/1 or 5/6": None, "5/18/": datetime(2024, 5, 18, 9),
    "5/18/99999999999": datetime(2024, 5, 18, 9), "5/18/99999": None, "2024-05-06": datetime(2024, 5, 6, 9), " 2024-5-6　": datetime(2024, 5, 6, 9), "on 2024-05-06": None,
    "明天": (2, 9), "后天下午": (3, 9), "大后天": (4, 9), "今晚": (1, 9), "5月18日": datetime(2024, 5, 18, 9), "12月3": datetime(2024, 12, 3, 9), "月5月18日": None, "昨天": None,
    "yesterday": None, "tomorrow, not yesterday": None, "yesterdays tomorrow": (2, 9), "no time": None, "": None, None: None, "x" * 200_000 + " tomorrow": (2, 9),
}


def test_each_rule(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k long, t string").withColumn("due", dates.resolved(F.col("t"), NOW))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {r.k: r.due for r in rows.collect()}
    for k, (text, want) in enumerate(CASES.items()):
        want = datetime(2024, 3, *want) if isinstance(want, tuple) else want
        assert found[k] == want, (text and text[:40], found[k], want)


def test_now_of_each_row(spark):
    rows = spark.sql("SELECT * FROM VALUES ('end of month', TIMESTAMP_NTZ '2023-02-03 00:00:00'), ('next month', TIMESTAMP_NTZ '2023-12-31 23:59:00'), ('feb 29', TIMESTAMP_NTZ '2024-03-01 00:00:00'), ('at 5', NULL) AS (t, now)")
    found = [str(r.due) for r in rows.select(dates.resolved(F.col("t"), F.col("now")).alias("due")).collect()]
    assert found == ["2023-02-28 09:00:00", "2024-01-01 09:00:00", "2024-02-29 09:00:00", "None"]
