"""Overlapping and gapped intervals: a sweep line whose prefix sums are built in levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 14


def boundary_events(intervals: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """(key, pos, delta): plus one where an interval starts, minus one where it stops, summed by place.

    Rows that are no interval (null key, start or stop, or stop not above start) make no event.
    """
    rows = intervals.select(F.col(key).alias("key"), F.col(start).cast("bigint").alias("a"), F.col(stop).cast("bigint").alias("b"))
    rows = rows.where(F.col("key").isNotNull() & (F.col("b") > F.col("a")))
    ends = F.array(
        F.struct(F.col("a").alias("pos"), F.lit(1).cast("bigint").alias("d")),
        F.struct(F.col("b").alias("pos"), F.lit(-1).cast("bigint").alias("d")),
    )
    events = rows.select("key", F.inline(ends))
    return events.groupBy("key", "pos").agg(F.sum("d").alias("delta")).where("delta <> 0")


def _frame(intervals: DataFrame, start: str, stop: str, bits: int) -> tuple[int, int]:
    """(least position, how often distances from it must be shifted by ``bits`` to become zero)."""
    span = intervals.agg(F.min(F.col(start).cast("bigint")).alias("lo"), F.max(F.col(stop).cast("bigint")).alias("hi")).first()
    if span is None or span.lo is None or span.hi is None or span.hi <= span.lo:
        return 0, 0
    return span.lo, (max(1, (span.hi - span.lo).bit_length()) - 1) // bits


def _sweep(items: DataFrame, bits: int, levels: int) -> DataFrame:
    """items(key, at, first, total) -> the same with ``before``, the sum of all totals ahead of the
    row within its key, and ``next_first``, the ``first`` of the row after it.

    A window only ever covers the rows of one bucket of 2**bits places, at most 2**bits rows, so no
    key is gathered in one task. What lies ahead of a bucket comes from the buckets, handled alike.
    """
    # never null, and said so: the join would else look for nulls on one side only, and the events be made twice
    bucket = F.coalesce(F.shiftright("at", bits), F.lit(0).cast("bigint"))
    rows = items.withColumn("bucket", bucket)
    own = Window.partitionBy("key", "bucket").orderBy("at")
    rows = rows.withColumn("inner", F.sum("total").over(own) - F.col("total")).withColumn("near", F.lead("first").over(own))
    if levels == 0:
        return rows.select("key", "at", "first", "total", F.col("inner").alias("before"), F.col("near").alias("next_first"))
    buckets = items.groupBy("key", bucket.alias("at")).agg(F.min("first").alias("first"), F.sum("total").alias("total"))
    ahead = _sweep(buckets, bits, levels - 1).select("key", F.col("at").alias("bucket"), "before", "next_first")
    return rows.join(ahead, ["key", "bucket"]).select(
        "key", "at", "first", "total", (F.col("before") + F.col("inner")).alias("before"), F.coalesce("near", "next_first").alias("next_first")
    )


def _step_function(intervals: DataFrame, key: str, start: str, stop: str, bits: int) -> tuple[DataFrame, int, int]:
    lo, levels = _frame(intervals, start, stop, bits)
    events = boundary_events(intervals, key, start, stop)
    swept = _sweep(events.select("key", (F.col("pos") - lo).alias("at"), F.col("pos").alias("first"), F.col("delta").alias("total")), bits, levels)
    steps = swept.select("key", F.col("first").alias("pos"), F.col("next_first").alias("next_pos"), "before", (F.col("before") + F.col("total")).alias("active"))
    return steps, lo, levels


def active_counts(intervals: DataFrame, key: str, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Step function of the number of active intervals: (key, pos, next_pos, before, active).

    ``active`` intervals cover [pos, next_pos), ``before`` the stretch that ends at pos. next_pos is
    null at the last boundary of a key, where active is 0.
    """
    return _step_function(intervals, key, start, stop, bits)[0]


def gaps(intervals: DataFrame, key: str, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Maximal stretches that no interval of the key covers, between intervals: (key, gap_start, gap_stop).

    Touching intervals leave none. Rows that are no interval are passed over; repeated rows change
    nothing; an empty table gives no row.
    """
    steps = active_counts(intervals, key, start, stop, bits)
    return steps.where((F.col("active") == 0) & F.col("next_pos").isNotNull()).select(
        F.col("key").alias(key), F.col("pos").alias("gap_start"), F.col("next_pos").alias("gap_stop")
    )


def covered(intervals: DataFrame, key: str, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Maximal continuous covered stretches: (key, cover_start, cover_stop).

    Only the places where the count leaves or reaches zero matter; each start is followed by its
    stop, so a second sweep over these few places pairs them.
    """
    steps, lo, levels = _step_function(intervals, key, start, stop, bits)
    turns = steps.where((F.col("before") == 0) | (F.col("active") == 0)).select(
        "key", (F.col("pos") - lo).alias("at"), F.col("pos").alias("first"), F.when(F.col("before") == 0, 1).otherwise(0).cast("bigint").alias("total")
    )
    paired = _sweep(turns, bits, levels)
    return paired.where("total = 1").select(F.col("key").alias(key), F.col("first").alias("cover_start"), F.col("next_first").alias("cover_stop"))


def covered_length(intervals: DataFrame, key: str, start: str, stop: str, bits: int = BITS) -> DataFrame:
    """Bases covered at least once, and the sum of depths: (key, covered, depth_sum)."""
    steps = active_counts(intervals, key, start, stop, bits).where(F.col("next_pos").isNotNull())
    size = F.col("next_pos") - F.col("pos")
    return steps.groupBy(F.col("key").alias(key)).agg(
        F.sum(F.when(F.col("active") > 0, size).otherwise(0)).alias("covered"), F.sum(size * F.col("active")).alias("depth_sum")
    )
