"""Joins that Spark does not plan by itself: intervals by bins, and the latest row before a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: How much wider the bins of a level are than those of the level below, and how many levels there are.
WIDER, LEVELS = 16, 14


def stab_join(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, stop: str, width: int = 4096) -> DataFrame:
    """Points with every interval of their key that holds them: an equi-join on key, level and bin, then a filter.

    An interval lies on the level whose bins are as wide as it is long, in one bin or two, however
    long it is; the bins of the lowest level are ``width`` wide. A point lies in one bin of each
    level that is in use, so no pair comes out twice. Nulls meet nothing; intervals that are none ([stop <= start])
    hold nothing.
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(float(WIDER)), level)
    bin_of = lambda place, level: F.floor(place / size(level))
    fit = F.ceil(F.log((F.col(stop) - F.col(start)).cast("double") / width) / F.log(F.lit(float(WIDER))))
    i = intervals.where((F.col(stop) > F.col(start)) & F.col(key).isNotNull())
    i = i.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), fit)).cast("int"))
    used = sorted(r.level for r in i.select("level").distinct().collect()) or [0]  # LEVELS numbers at most
    i = i.withColumn("bin", F.explode(F.sequence(bin_of(F.col(start), F.col("level")), bin_of(F.col(stop) - 1, F.col("level")))))
    p = points.where(F.col(pos).isNotNull() & F.col(key).isNotNull()).withColumn("level", F.explode(F.array(*[F.lit(n) for n in used])))
    p = p.withColumn("bin", bin_of(F.col(pos), F.col("level")))
    return p.join(i, [key, "level", "bin"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(stop))).drop("bin", "level")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """left plus ``value`` of the latest row of right with the same key and no later ``at``; null if none.

    Of several rows at the same time the greatest value counts. Rows meet in buckets of time, so a
    hot key is spread over many tasks; what a bucket has no answer for comes from the last value of
    the buckets before it, of which there is one row each. Null keys and times get null.
    """
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    bucket = F.floor(second / bucket_seconds)
    l = left.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("l"), F.col(key).alias("k"), F.col(at).alias("t"), bucket.alias("b"))
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), bucket.alias("b"), F.col(value).alias("v"))
    r = r.groupBy("k", "b", "t").agg(F.max("v").alias("v"))
    lasts = r.groupBy("k", "b").agg(F.max_by("v", "t").alias("v"))
    asked = l.groupBy("k", "b").agg(F.lit(None).cast(dict(r.dtypes)["v"]).alias("v"))
    ahead = lasts.withColumn("own", F.lit(True)).unionByName(asked.withColumn("own", F.lit(False)))
    ahead = ahead.groupBy("k", "b").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("v"))
    carried = ahead.select("k", "b", F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    both = l.select("k", "b", "t", F.lit(1).alias("side"), "row", "l", F.lit(None).cast(dict(r.dtypes)["v"]).alias("v")).unionByName(
        r.select("k", "b", "t", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast(l.schema["l"].dataType).alias("l"), "v")
    )
    w = Window.partitionBy("k", "b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    return near.join(carried, ["k", "b"], "left").select("l.*", F.coalesce("near", "carry").alias(f"latest_{value}"))
