"""Scalar helpers on inputs that look alike, against plain Python."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from storelens.functions import scalar as S

TIMES = ["2026-01-01", "2026-01-01T10:15:00", "2026-01-01 10:15:00.5", "2026-01-01T10", "2026-01-01T10:15", "20260101", "20260101T101500",
         "20260101T1015", "2026-W01-1", "2026-W53-1", "2020-W53-7", "2026W011", "2026-W01", "2026-01-01T10:15:00Z", "2026-01-01T10:15:00+05:30",
         "2026-01-01T10:15:00-0530", "2026-01-01T10:15:00+05", "2026-01-01T10:15:00,123456789", "2026", "2026-01", "2026-1-1", "10:15:00", "T10:15",
         "2026-01-01T10:15:00 Europe/Paris", "2026-13-01", "2026-02-30", "2026-01-01T25:00:00", "2026-01-01x10:15:00", "unknown", "", "  ", None,
         "2026-01-01T10:15:00+24:00", "2026-W00-1", "2026-W01-8", "0001-01-01", "0000-01-01", "2026-01-01T101500.25+01:00"]


def _python_time(text):
    text = (text or "").strip()
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def test_parse_timestamp_equals_python(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "i int, t string")
    got = {r["i"]: r["us"] for r in df.select("i", S.to_micros(S.parse_timestamp("t")).alias("us")).collect()}
    assert {TIMES[i]: v for i, v in got.items()} == {t: _python_time(t) for t in TIMES}


NUMBERS = ["1", " 2.50 ", "1d", "1f", "1.5D", "0x1", "1_000", "1__0", "_1", "1e3", "1E-2", ".5", "5.", ".", "", None, "abc", "-7", "+7", "1,5", "1 2"]


def test_to_number_equals_python(spark):
    def want(t):
        try:
            return None if t in (None, "") else float(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERS)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", S.to_number("t").alias("v")).collect()}
    assert {NUMBERS[i]: v for i, v in got.items()} == {t: want(t) for t in NUMBERS}


FLOATS = [0.0, 10.0, -3.0, 0.5, 12345678.5, -12345678.25, 1e15 + 0.5, 123456789012.125, 1e16, 1e20, 0.0001, 0.00012345, 0.00001, 1.5e-7, None]


def test_fmt_number_equals_python(spark):
    def want(x):
        return "None" if x is None else str(int(x)) if x == int(x) else repr(x)

    df = spark.createDataFrame([(i, x) for i, x in enumerate(FLOATS)], "i int, x double")
    got = {r["i"]: r["s"] for r in df.select("i", S.fmt_number("x").alias("s")).collect()}
    assert got == {i: want(x) for i, x in enumerate(FLOATS)}


def test_record_hash_blanks_numeric_zero_only(spark):
    import hashlib

    row = spark.range(1).select(S.record_hash16(F.lit("0"), F.lit(0), F.lit("0.0"), F.lit("false"), F.lit(False), F.lit(0.0), F.lit(None).cast("string"),
                                                F.lit("")).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"0||0.0|false||||").hexdigest()[:16]
