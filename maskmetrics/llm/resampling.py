"""Irregular series, resampled into calendar buckets through a time-bin equi-join: DataFrame functions only, no windows.

Points of a key are put into bins as wide as the cap, the longest time that a value lasts. A point's successor within the cap
is then in its own bin or in the following one, so each bin meets these two by an equality of (key, bin): its own points in the
order of their time, and the earliest point of the following bin. The least later timestamp of both is the successor; where
there is none, or it is over the cap away, the value is capped. Each segment is split at the borders of buckets and added up.

A key's bins are rows of their own, so a key with most of the rows is dealt out like any other. A bin holds at most `cap`
points, since those of one second have become one before, by a partial aggregate; no pairs of points are made. What is added
up at last are integers. Nothing is broadcast and nothing comes to the driver.

All arithmetic is exact. Values are integers (`scale` times the input, rounded half up), and twice the integral over the first u
of a segment's d seconds is 2*v*u + floor((w-v)*u*u/d), with w the value at the segment's end. Longs are used as long as
they suffice, decimals of 38 digits where they may not.

Cases: rows whose key, time or value is null go first; so do values that are no number, infinite, or beyond a long once scaled.
Of the rows of one key and second the largest `tie` stays; among equal ones (repeated rows) the largest value. Times may lie
before 1970. A timestamp without a zone is read as UTC, whatever the session's zone is. An `area2` that no long holds is null,
its average is right all the same. An empty table gives no bucket. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column

DAY = 86_400
#: Values up to this, divided by the cap, leave all products and sums of a piece within a long.
EXACT = 1 << 60
_LONG = float(1 << 63)


def _floored(x: Column, by: Column) -> Column:
    """floor(x / by) of integers, by > 0, as a long."""
    return F.call_function("div", x - F.pmod(x, by), by)


def seconds_of(time: Column, kind: T.DataType) -> Column:
    """Whole seconds since 1970, floored; a timestamp without a zone is UTC's."""
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(time.cast("date")).cast("bigint") * DAY
        return day + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.unix_seconds(time)


class Buckets:
    """Buckets of time: calendar days of a zone, or a fixed number of seconds counted from 1970."""

    def __init__(self, width: str | int = "day", zone: str = "UTC"):
        if width != "day" and (not isinstance(width, int) or width < 1):
            raise ValueError("a bucket is 'day' or a whole number of seconds")
        self.width, self.zone = width, zone

    def of(self, t: Column) -> Column:
        """The number of the bucket that second t is in."""
        if self.width != "day":
            return _floored(t, F.lit(self.width).cast("bigint"))
        return _floored(F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(t), self.zone)), F.lit(DAY).cast("bigint"))

    def start(self, number: Column) -> Column:
        """The first second of a bucket."""
        if self.width != "day":
            return number * self.width
        return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(number * DAY), self.zone))


def points(rows: DataFrame, key: str, time: str, value: str, tie: str, scale: int) -> DataFrame:
    """(k, t, v): a point for each key and second, its value scaled to an integer."""
    scaled = F.floor(F.lit(float(scale)) * F.col("x") + F.lit(0.5))
    kept = rows.select(
        column(key).alias("k"), seconds_of(column(time), rows.schema[time].dataType).cast("bigint").alias("t"), column(tie).alias("tie"), column(value).cast("double").alias("x")
    ).where(F.col("k").isNotNull() & F.col("t").isNotNull() & (F.abs(F.col("x") * scale) < _LONG) & ~F.isnan("x"))
    return kept.groupBy("k", "t").agg(F.max(F.struct("tie", scaled.cast("bigint").alias("v"))).alias("best")).select("k", "t", "best.v")


def segments(found: DataFrame, cap: int, signal: str) -> DataFrame:
    """(k, t, v, d, w) of points (k, t, v): the signal goes from v to w in the d seconds from t on; d is 0 where nothing is covered."""
    bins = found.groupBy("k", _floored(F.col("t"), F.lit(cap).cast("bigint")).alias("bin")).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("own"))
    # the earliest point of a bin, under the number of the bin before; <=> infers no filter, so both sides share one shuffle of points
    following = bins.select(F.col("k").alias("same"), (F.col("bin") - 1).alias("before"), F.col("own")[0].alias("later"))
    met = bins.join(following, (F.col("k") == F.col("same")) & F.col("bin").eqNullSafe(F.col("before")), "left")
    with_next = F.transform("own", lambda p, i: F.struct(p["t"].alias("t"), p["v"].alias("v"), F.coalesce(F.get("own", i + 1), F.col("later")).alias("s")))
    out = met.select("k", F.inline(with_next))
    away = F.col("s.t") - F.col("t")
    if signal == "step":
        return out.select("k", "t", "v", F.least(F.coalesce(away, F.lit(cap)), F.lit(cap)).cast("bigint").alias("d"), F.col("v").alias("w"))
    near = F.coalesce(away <= cap, F.lit(False))
    return out.select("k", "t", "v", F.when(near, away).otherwise(0).cast("bigint").alias("d"), F.when(near, F.col("s.v")).otherwise(F.col("v")).alias("w"))


def _area2(u: Column, cap: int) -> Column:
    """Twice the integral over the first u seconds of a segment (v, w, d), exactly, as decimal(38, 0)."""
    v, w, d = F.col("v"), F.col("w"), F.greatest(F.col("d"), F.lit(1).cast("bigint"))

    def at(v: Column, w: Column) -> Column:
        # (w-v) = q*d + r: floor((w-v)*u*u/d) is q*u*u + floor(r*u*u/d), and r*u*u stays small
        rest = F.pmod(w - v, d)
        return v * u * 2 + F.call_function("div", w - v - rest, d) * u * u + F.call_function("div", rest * u * u, d)

    wide = lambda x: x.cast("decimal(20,0)")
    large_rest = F.pmod(wide(w) - wide(v), wide(d))
    large = (wide(v) * u.cast("decimal(10,0)") * F.lit(2).cast("decimal(1,0)")).cast("decimal(37,0)") + (
        F.call_function("div", wide(w) - wide(v) - large_rest, wide(d)).cast("decimal(20,0)") * (u * u).cast("decimal(14,0)")
        + F.call_function("div", large_rest.cast("bigint") * u * u, d).cast("decimal(20,0)")
    ).cast("decimal(37,0)")
    small = (F.abs(v) < EXACT // cap) & (F.abs(w) < EXACT // cap)
    return F.when(small, at(v, w).cast("decimal(38,0)")).otherwise(large.cast("decimal(38,0)"))


def resampled(
    rows: DataFrame, key: str = "client_id", time: str = "ts", value: str = "value", tie: str = "click_id",
    signal: str = "linear", cap: int = 900, bucket: str | int = "day", zone: str = "UTC", scale: int = 100,
) -> DataFrame:
    """(key, bucket_start, n_points, covered_seconds, area2, avg) of each bucket that holds points or covered time.

    signal "step": a value lasts until the next point, at most cap seconds, and the last one cap seconds; "linear": it runs
    straight to the next point's if that is at most cap seconds away, else nothing is covered. avg is floor(area2 /
    (2 * covered_seconds)), null where nothing is covered.
    """
    if signal not in ("step", "linear"):
        raise ValueError("signal is 'step' or 'linear'")
    if not 1 <= cap <= DAY:
        raise ValueError("cap is between a second and a day")
    by = Buckets(bucket, zone)
    parts = segments(points(rows, key, time, value, tie, scale), cap, signal)
    first, last = by.of(F.col("t")), by.of(F.col("t") + F.greatest(F.col("d") - 1, F.lit(0)))
    split = parts.withColumn("first", first).withColumn("b", F.explode(F.sequence("first", last)))
    begin = F.greatest(F.col("t"), by.start(F.col("b"))) - F.col("t")
    end = F.least(F.col("t") + F.col("d"), by.start(F.col("b") + 1)) - F.col("t")
    split = split.withColumns({"u0": F.when(F.col("b") == F.col("first"), F.lit(0).cast("bigint")).otherwise(begin), "u1": F.when(F.col("d") > 0, end).otherwise(0).cast("bigint")})
    pieces = split.select(
        "k", "b", (F.col("b") == F.col("first")).cast("int").alias("n"), (F.col("u1") - F.col("u0")).alias("covered"), (_area2(F.col("u1"), cap) - F.when(F.col("u0") > 0, _area2(F.col("u0"), cap)).otherwise(0)).cast("decimal(38,0)").alias("area")
    ).where((F.col("n") == 1) | (F.col("covered") > 0))
    sums = pieces.groupBy("k", "b").agg(F.sum("n").alias("n_points"), F.sum("covered").alias("covered_seconds"), F.sum("area").alias("area"))
    twice = (F.col("covered_seconds") * 2).cast("decimal(20,0)")
    return sums.select(
        F.col("k").alias(key), by.start(F.col("b")).alias("bucket_start"), "n_points", "covered_seconds", F.col("area").try_cast("bigint").alias("area2"),
        F.when(F.col("covered_seconds") > 0, _floored(F.col("area"), twice)).alias("avg"),
    )
