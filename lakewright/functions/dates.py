"""Date and time expressions with the reference dialect's rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)


def add_months(d: Column, n: Column | int) -> Column:
    """Month arithmetic that clamps to the month end."""
    return F.add_months(d, n)


def add_years(d: Column, n: Column | int) -> Column:
    return F.add_months(d, n * 12)


def days_between(first: Column, second: Column) -> Column:
    """Days from the first to the second date."""
    return F.datediff(second, first)


def diff_days(first: Column, second: Column) -> Column:
    """First minus second, the helper-library sign."""
    return F.datediff(first, second)


def seconds_between(first: Column, second: Column) -> Column:
    """Fractional seconds from the first to the second timestamp."""
    micros = F.unix_micros(second.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return micros / F.lit(1000000.0)


def months_between(first: Column, second: Column) -> Column:
    """Calendar months from first to second plus the day difference over 31."""
    return (F.lit(12) * (F.year(second) - F.year(first)) + (F.month(second) - F.month(first))
            + (F.dayofmonth(second) - F.dayofmonth(first)) / F.lit(31.0))


def diff_months(first: Column, second: Column) -> Column:
    """Calendar months, days ignored, first minus second."""
    return (F.year(first) - F.year(second)) * 12 + F.month(first) - F.month(second)


def diff_years(first: Column, second: Column) -> Column:
    return F.year(first) - F.year(second)


def date_difference(start: Column, end: Column, unit: Column) -> Column:
    """Whole difference in a named unit; unknown units count days."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))

    def whole(size: int) -> Column:
        return (F.signum(micros) * F.floor(F.abs(micros) / F.lit(size))).cast("long")

    name = F.lower(unit)
    return (F.when(name == "years", diff_years(end, start).cast("long"))
            .when(name == "months", diff_months(end, start).cast("long"))
            .when(name == "hours", whole(3_600_000_000))
            .when(name == "minutes", whole(60_000_000))
            .when(name == "seconds", F.round(micros / F.lit(1000000.0)).cast("long"))
            .otherwise(whole(86_400_000_000)))


def extract(part: str, ts: Column) -> Column:
    """Date parts; day of week counts from Sunday = 0."""
    parts = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "doy": F.dayofyear,
        "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
        "dow": lambda c: F.dayofweek(c) - 1,
        "epoch": lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1000000.0),
    }
    return parts[part](ts)


def trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def time_bucket(width: str, ts: Column, origin: str | None = None) -> Column:
    """Start of the bucket of ``width`` holding ``ts``.

    Month and year widths truncate the calendar; others divide the time since
    the epoch, shifted by ``origin`` (an interval) for multi-day buckets.
    """
    count, unit = width.split()
    if unit.rstrip("s") in ("month", "year"):
        if int(count) != 1:
            raise ValueError("calendar buckets are one month or one year wide")
        return trunc(unit.rstrip("s"), ts)
    size = _micros(width)
    shift = _micros(origin) if origin else 0
    # Subtracting keeps the type of ``ts`` and a null; a window would drop rows without a time.
    into = F.pmod(F.unix_micros(ts.cast("timestamp")) - F.lit(shift), F.lit(size))
    seconds = (into.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


_UNIT_MICROS = {"microsecond": 1, "millisecond": 10 ** 3, "second": 10 ** 6, "minute": 60 * 10 ** 6, "hour": 3600 * 10 ** 6,
                "day": 86400 * 10 ** 6, "week": 7 * 86400 * 10 ** 6}


def _micros(interval: str) -> int:
    """Length of an interval of one number and one unit below a month."""
    count, unit = interval.split()
    return int(count) * _UNIT_MICROS[unit.lower().rstrip("s")]


def age_months(later: Column, earlier: Column) -> Column:
    """Whole months between two timestamps, the total behind the month part of an age."""
    back = F.dayofmonth(later) < F.dayofmonth(earlier)
    return diff_months(later, earlier) - F.when(back, 1).otherwise(0)


def age_month_part(later: Column, earlier: Column) -> Column:
    return age_months(later, earlier) % 12


# Date format letters of the reference dialect and of Spark.
FORMAT_LETTERS = {
    "YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q",
}
_TOKEN = re.compile("|".join(["'(?:[^']|'')*'", '"[^"]*"', *sorted(FORMAT_LETTERS, key=len, reverse=True), "[A-Z]+", "."]),
                    re.IGNORECASE | re.DOTALL)


def spark_format(fmt: str) -> str:
    """A format of the reference dialect in Spark's letters, the longest token first.

    Text in single or double quotes stays as it is. Names come out as Spark
    spells them, so only their capitalised spelling (Mon, Month, Dy, Day) is
    accepted. Unknown letters raise an error instead of giving another text.
    """
    out = []
    for token in _TOKEN.findall(fmt):
        known = FORMAT_LETTERS.get(token.upper())
        if token[0] == '"':
            out.append("'" + token[1:-1].replace("'", "''") + "'")
        elif token[0] == "'":
            out.append(token)
        elif known and token.upper() in ("MONTH", "MON", "DAY", "DY") and token != token.capitalize():
            raise ValueError(f"only the spelling {token.capitalize()} of {token} is supported in {fmt!r}")
        elif known:
            out.append(known)
        elif token[0].isalpha():
            raise ValueError(f"unknown letters {token!r} in format {fmt!r}")
        else:
            out.append(token)
    return "".join(out)


def to_date(text: Column, fmt: str) -> Column:
    return F.to_date(text, spark_format(fmt))


def to_timestamp(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(spark_format(fmt)))


def format_date(d: Column, fmt: str) -> Column:
    return F.date_format(d, spark_format(fmt))


# The accepted timestamp spellings, tried in this order.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy")


def parse_timestamp(text: Column) -> Column:
    """First of the accepted formats that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def batch_id(as_of: Column) -> Column:
    """Epoch second of the start of the day."""
    return F.unix_timestamp(F.date_trunc("day", as_of))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """A row per day between the first and last value of ``ts``, with calendar columns."""
    span = df.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date_actual"))
    d = F.col("date_actual")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date_actual",
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.weekofyear(d).alias("week"), F.dayofyear(d).alias("day_of_year"), F.dayofmonth(d).alias("day_of_month"),
        (F.dayofweek(d) - 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("weekday_name"),
        F.date_format(d, "MMMM").alias("month_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.lit(False).alias("is_holiday"))
