"""Trading calendar as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MON, THU = 0, 3


def _day(y: Column, month: int, day: int = 1) -> Column:
    return F.make_date(y, F.lit(month), F.lit(day))


def _observed(d: Column) -> Column:
    wd = F.weekday(d)
    return F.when(wd == 5, F.date_sub(d, 1)).when(wd == 6, F.date_add(d, 1)).otherwise(d)


def _nth(y: Column, month: int, weekday: int, n: int) -> Column:
    first = _day(y, month)
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def _last(y: Column, month: int, weekday: int) -> Column:
    end = F.last_day(_day(y, month))
    return F.date_sub(end, F.pmod(F.weekday(end) - F.lit(weekday), F.lit(7)))


def easter(y: Column) -> Column:
    """Easter Sunday from the golden number, the epact and the Sunday after the paschal full moon (Knuth, vol. 1)."""
    def idiv(a, b):
        return F.floor(a / b).cast("int")

    golden = y % 19 + 1
    century = idiv(y, 100) + 1
    leap_fix = idiv(3 * century, 4) - 12
    moon_fix = idiv(8 * century + 5, 25) - 5
    sunday = idiv(5 * y, 4) - leap_fix - 10
    raw = F.pmod(11 * golden + 20 + moon_fix - leap_fix, F.lit(30))
    epact = F.when(((raw == 25) & (golden > 11)) | (raw == 24), raw + 1).otherwise(raw)
    moon = F.when(44 - epact < 21, 74 - epact).otherwise(44 - epact)
    return F.date_add(_day(y, 3), (moon + 7 - F.pmod(sunday + moon, F.lit(7)) - 1).cast("int"))


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """(year, holiday, date): the ten standard market holidays of each distinct year."""
    y = F.col(year)
    rules = {
        "New Year": _observed(_day(y, 1, 1)), "Martin Luther King": _nth(y, 1, MON, 3), "Presidents": _nth(y, 2, MON, 3),
        "Good Friday": F.date_sub(easter(y), 2), "Memorial": _last(y, 5, MON), "Juneteenth": _observed(_day(y, 6, 19)),
        "Independence": _observed(_day(y, 7, 4)), "Labor": _nth(y, 9, MON, 1), "Thanksgiving": _nth(y, 11, THU, 4),
        "Christmas": _observed(_day(y, 12, 25)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("holiday"), d.alias("date")) for n, d in rules.items()])
    return years.select(y.cast("int").alias(year)).distinct().select(year, F.inline(rows))


def trading_calendar(days: DataFrame) -> DataFrame:
    """(date, is_holiday, is_trading_day, last_trading_day) for every day from a little before the first to the last of ``days``.

    The table has one row per calendar day; the running "last trading day" is a window over it.
    """
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence(F.date_sub("a", 14), F.col("b"))).alias("date"))
    # A year's New Year may be observed on the last day of the year before.
    years = span.select(F.explode(F.array(F.year("date"), F.year("date") + 1)).alias("year"))
    hol = holidays(years).select("date").distinct().withColumn("_h", F.lit(True))
    flagged = span.join(hol, "date", "left").select("date", F.coalesce("_h", F.lit(False)).alias("is_holiday"))
    flagged = flagged.withColumn("is_trading_day", (F.weekday("date") < 5) & ~F.col("is_holiday"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("last_trading_day", F.last(F.when(F.col("is_trading_day"), F.col("date")), True).over(w))


def last_closed_day(df: DataFrame, ts: str, close_hour: int = 16) -> DataFrame:
    """Add ``last_closed``: the newest trading day whose 16:00 New York close is past at UTC time ``ts`` (timestamp_ntz)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col(ts))
    day = F.when(F.hour(local) < close_hour, F.date_sub(local.cast("date"), 1)).otherwise(local.cast("date"))
    keyed = df.withColumn("_day", day)
    cal = trading_calendar(keyed.select(F.col("_day").alias("date"))).select(
        F.col("date").alias("_day"), F.col("last_trading_day").alias("last_closed"))
    return keyed.join(cal, "_day").drop("_day")
