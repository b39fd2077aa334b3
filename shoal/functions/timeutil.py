"""Calendar parts, epochs and amortisation, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd HH:mm:ss"


def parts(ts: Column) -> Column:
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), F.dayofyear(ts).alias("day_of_year"))


def seconds_since_epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def from_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_zone(ts: Column, zone: str) -> Column:
    """The UTC time of what a clock of the zone shows, a name or an offset such as +05:30."""
    return F.to_utc_timestamp(ts, zone)


def days_between(a: Column, b: Column) -> Column:
    """Whole periods of 24 hours from a to b, with sign."""
    return F.timestamp_diff("DAY", a, b)


def amortize(df: DataFrame, start: str, end: str, amount: str) -> DataFrame:
    """A row for each whole day from start, the amount in equal parts; the row itself if there is none."""
    days = days_between(F.col(start), F.col(end))
    n = F.greatest(days, F.lit(1))
    spread = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return spread.withColumn("day", F.timestamp_add("DAY", F.col("_i").cast("int"), F.col(start))).withColumn("part", F.col(amount) / F.col("_n")).drop("_n", "_i")


def parse(text: Column) -> Column:
    """A timestamp of the form 2016-01-01 01:23:45; other text is an error."""
    return F.to_timestamp(text, FORMAT)


def render(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def year_and_day(seconds: Column) -> Column:
    ts = F.timestamp_seconds(seconds)
    return F.struct(F.year(ts).alias("year"), F.dayofyear(ts).alias("day"))
