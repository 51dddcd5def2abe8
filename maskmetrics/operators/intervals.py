"""Half-open intervals by document: islands, and joins by overlap or containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 256


def islands(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end) of the unions of intervals that overlap or touch."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = intervals.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.when(before >= F.col(start), 0).otherwise(1).alias("_new"))
    numbered = begun.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def within_text(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Islands but those that reach their text's end: the measures of preserved terms leave them out."""
    return found.join(documents.select("doc_id", "n_chars"), "doc_id").where("end < n_chars").drop("n_chars")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Callable[[str, str, str, str], Column], bin_size: int = BIN) -> DataFrame:
    """Pairs of intervals (l_start, l_end, r_start, r_end) with equal keys that touch or overlap and satisfy the condition.

    Both sides are dealt into bins of positions, so a pair is looked for in its first common bin only, and a long document
    costs its intervals and not their product. Other columns must differ in name.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)
        return df.withColumn(f"{side}_bin", first).withColumn("_bin", F.explode(F.sequence(first, last))).withColumnsRenamed({"start": f"{side}_start", "end": f"{side}_end"})

    pairs = binned(left, "l").join(binned(right, "r"), [*keys, "_bin"])
    pairs = pairs.where(F.col("_bin") == F.greatest("l_bin", "r_bin"))
    return pairs.where(condition("l_start", "l_end", "r_start", "r_end")).drop("_bin", "l_bin", "r_bin")


def endpoint_hit(ls: str, le: str, rs: str, re: str) -> Column:
    """The right interval begins or ends within the left one: a left one strictly inside the right isn't hit."""
    return F.expr(f"({ls} <= {rs} AND {rs} < {le}) OR ({ls} < {re} AND {re} <= {le})")


def overlap(ls: str, le: str, rs: str, re: str) -> Column:
    return F.expr(f"{ls} < {re} AND {rs} < {le}")


def inside(ls: str, le: str, rs: str, re: str) -> Column:
    """The left interval lies in the right one."""
    return F.expr(f"{rs} <= {ls} AND {le} <= {re}")


HITS = {"endpoint": endpoint_hit, "true": overlap}


def masked_lengths(maskings: DataFrame, documents: DataFrame) -> DataFrame:
    """(anon_name, doc_id, n_masked): characters under any mask."""
    clipped = maskings.join(documents.select("doc_id", "n_chars"), "doc_id").withColumn("end", F.least("end", "n_chars"))
    return islands(clipped, ["anon_name", "doc_id"]).groupBy("anon_name", "doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_masked"))
