"""Length statistics, sliding windows, probability: reductions that never order a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_counts(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., len, n): how often each length occurs; null lengths left out.

    What follows orders distinct lengths, of which there are few, instead of rows.
    """
    return df.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def nx_table(df: DataFrame, length: str, by: Sequence[str] = (), steps: Sequence[int] = tuple(range(10, 100, 10)), size: int | None = None) -> DataFrame:
    """(by..., x, len): the length at which the longest pieces first make up x percent of the total.

    With ``size`` the percentages are of that size, and len is null where the pieces do not reach it.
    """
    w = Window.partitionBy(*by).orderBy(F.col("len").desc())
    sums = length_counts(df, length, by).withColumn("upto", F.sum(F.col("len") * F.col("n")).over(w))
    whole = F.lit(size) if size is not None else F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(*by))
    rows = sums.withColumn("whole", whole).select(*by, "len", "upto", "whole", F.explode(F.array(*[F.lit(x) for x in steps])).alias("x"))
    return rows.groupBy(*by, "x").agg(F.max(F.when(F.col("upto") * 100 >= F.col("whole") * F.col("x"), F.col("len"))).alias("len"))


def n50(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n50) from the short end: the length at which half the total is reached.

    Where a piece ends exactly at half the total and is not the last, the whole-number mean of its
    length and the next one's. No lengths give no row; only lengths of 1 or more count.
    """
    w = Window.partitionBy(*by).orderBy("len")
    rows = length_counts(df.where(F.col(length) >= 1), length, by).select(
        *by, "len", "n", F.sum(F.col("len") * F.col("n")).over(w).alias("upto"), F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(*by)).alias("whole"), F.lead("len").over(w).alias("nxt")
    )
    # half is reached among the n equal pieces of a length: at the end of the last of them, or before
    at = rows.where(F.col("upto") * 2 >= F.col("whole")).withColumn("first", F.row_number().over(Window.partitionBy(*by).orderBy("len"))).where("first = 1")
    exact_end = (F.col("upto") * 2 == F.col("whole")) & F.col("nxt").isNotNull()
    return at.select(*by, F.when(exact_end, F.floor((F.col("len") + F.col("nxt")) / 2)).otherwise(F.col("len")).cast("bigint").alias("n50"))


def row_ranks(df: DataFrame, key: str, at: str, tie: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Adds ``rank``: the place of a row, from 1, within its key by time and then by ``tie``.

    Rows are ranked within buckets of time and the sizes of the buckets are summed, of which a key
    has one for each day with rows; so a key that holds a third of all rows is many tasks' work.
    Null times come first, as one bucket.
    """
    rows = df.withColumn("__b", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / bucket_seconds))
    sizes = rows.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = sizes.withColumn("__ahead", F.sum("__n").over(Window.partitionBy("__k").orderBy("__c")) - F.col("__n"))
    inner = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(at, tie)))
    met = inner.join(ahead, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c")))
    return met.withColumn("rank", F.col("__r") + F.col("__ahead")).drop("__b", "__k", "__c", "__n", "__r", "__ahead")


def sliding(df: DataFrame, key: str, at: str, tie: str, value: str, radius: int) -> DataFrame:
    """(key, tie, w_min, w_max, w_sum, w_mean) of the value over ``radius`` rows on either side, by key and time.

    Each row hands its value to the ranks around it, and these meet by key and rank: a hot key is
    spread evenly, at the price of 2*radius+1 small rows for each.
    """
    ranked = row_ranks(df, key, at, tie).select(F.col(key).alias("k"), F.col(tie).alias("t"), F.col(value).alias("v"), "rank")
    given = ranked.select("k", "t", "v", "rank", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o"))
    met = given.groupBy("k", (F.col("rank") + F.col("o")).alias("rank")).agg(
        F.max(F.when(F.col("o") == 0, F.col("t"))).alias("t"), F.max(F.col("o") == 0).alias("own"), F.min("v").alias("w_min"), F.max("v").alias("w_max"), F.sum("v").alias("w_sum"), F.avg("v").alias("w_mean")
    )
    return met.where("own").select(F.col("k").alias(key), F.col("t").alias(tie), "w_min", "w_max", "w_sum", "w_mean")


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) for a Poisson variable; terms are made from one another."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * mean / i
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.when(k < 0, 0.0).otherwise(F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"]))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) of n trials, summed from the likeliest terms made from one another; p strictly between 0 and 1."""
    odds = p / (1 - p)
    start = F.struct(F.pow(F.lit(1 - p), n).alias("term"), F.when(k <= 0, F.pow(F.lit(1 - p), n)).otherwise(F.lit(0.0)).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i * odds
        return F.struct(term.alias("term"), (s["total"] + F.when(i >= k, term).otherwise(F.lit(0.0))).alias("total"))

    return F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"])


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of n trials, k being small; terms are made from one another, p strictly between 0 and 1."""
    odds, first = p / (1 - p), F.pow(F.lit(1 - p), n)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i * odds
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    top = F.least(k, n)
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.aggregate(F.when(top >= 1, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"]))


def normal_cdf(x: Column) -> Column:
    """P(X <= x) for a standard normal variable, by the series of the density's integral; exact to 1e-9 within 6 of 0."""
    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * x * x / (2 * i + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["total"])
    return F.when(x > 6, 1.0).when(x < -6, 0.0).otherwise(0.5 + total * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()))


# Coefficients of a published rational approximation to the inverse normal distribution, good to 1e-9.
_CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_inverse(p: Column) -> Column:
    """x with P(X <= x) = p for a standard normal variable; null outside (0, 1)."""

    def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    q = p - 0.5
    centre = polynomial(q * q, _CENTRE_TOP) * q / polynomial(q * q, _CENTRE_BOTTOM)
    far = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(far, _TAIL_TOP) / polynomial(far, _TAIL_BOTTOM)
    return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.47575, centre).when(q < 0, tail).otherwise(-tail)


def poisson_inverse(p: Column, mean: float, most: int = 10_000) -> Column:
    """Least k with P(X <= k) >= p for a Poisson variable; null where p is not below 1 or k would exceed ``most``."""
    start = F.struct(F.lit(0.0).alias("total"), F.exp(F.lit(-mean)).alias("term"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("found"))

    def step(s: Column, i: Column) -> Column:
        total = s["total"] + s["term"]
        found = F.when(s["found"].isNotNull(), s["found"]).when(total >= p, i)
        return F.struct(total.alias("total"), (s["term"] * mean / (i + 1)).alias("term"), i.alias("k"), found.alias("found"))

    top = min(most, int(mean + 40 * mean**0.5 + 60))
    return F.when(p < 1, F.aggregate(F.sequence(F.lit(0), F.lit(top)), start, step, lambda s: s["found"]))


def binomial_interval(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Struct(low, high): confidence interval of a share by the score method; nulls where n is 0."""
    share, z2 = hits / n, z * z
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    wide = F.lit(z) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(F.when(n > 0, centre - wide).alias("low"), F.when(n > 0, centre + wide).alias("high"))


def phred(p: Column, most: int = 60) -> Column:
    """Quality of an error of probability p, whole, ``most`` at most."""
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(F.lit(most), F.floor(-10 * F.log10(p) + 0.5))).cast("int")


def combined_normals(df: DataFrame, by: Sequence[str], mean: str, sd: str) -> DataFrame:
    """(by..., mean, sd, n): independent estimates of one value joined by the inverse of their variances.

    Rows with a null, or an sd that is not above 0, are left out.
    """
    ok = df.where(F.col(mean).isNotNull() & (F.col(sd) > 0)).withColumn("__w", 1 / (F.col(sd) * F.col(sd)))
    sums = ok.groupBy(*by).agg(F.sum(F.col(mean) * F.col("__w")).alias("__m"), F.sum("__w").alias("__w"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, (F.col("__m") / F.col("__w")).alias("mean"), F.sqrt(1 / F.col("__w")).alias("sd"), "n")


def best_cutoff(df: DataFrame, value: str, good: str) -> DataFrame:
    """(cutoff, wrong): the value at which to part good (at or above) from bad rows with fewest wrong ones; ties to the least.

    Distinct values are ordered, not rows; the running sums are built in buckets of their own
    quantiles' width, of which there are a thousand, so no task holds all values.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b")
    )
    span = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("b").alias("bad"))  # one row
    placed = counts.join(F.broadcast(span)).withColumn("bucket", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 999)).otherwise(F.lit(0)).cast("int"))
    buckets = placed.groupBy("bucket").agg(F.sum("g").alias("bg"), F.sum("b").alias("bb"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a thousand rows
    ahead = buckets.select("bucket", F.coalesce(F.sum("bg").over(w), F.lit(0)).alias("ag"), F.coalesce(F.sum("bb").over(w), F.lit(0)).alias("ab"))
    inner = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(F.broadcast(ahead), "bucket")
    below_good = F.coalesce(F.sum("g").over(inner), F.lit(0)) + F.col("ag")
    below_bad = F.coalesce(F.sum("b").over(inner), F.lit(0)) + F.col("ab")
    wrong = met.select("v", (below_good + F.col("bad") - below_bad).cast("bigint").alias("wrong"))
    return wrong.agg(F.min(F.struct("wrong", "v")).alias("s")).where("s is not null").select(F.col("s.v").alias("cutoff"), "s.wrong")


def reservoir(df: DataFrame, by: Sequence[str], key: str, size: int) -> DataFrame:
    """An even sample of ``size`` rows of each group (all of a smaller one), the same on every run: those of the least hash of ``key``.

    Each row has the chance of any other; a group is cut to its sample before it is shuffled a
    second time, so a group that holds a third of all rows is never in one place.
    """
    hashed = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__part", F.substring("__h", 32, 1))
    near = hashed.withColumn("__chunk", F.spark_partition_id())
    first = Window.partitionBy(*by, "__chunk", "__part").orderBy("__h", key)
    few = near.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= size)
    last = Window.partitionBy(*by).orderBy("__h", key)
    return few.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= size).drop("__h", "__part", "__r", "__chunk")


def whole_number_share(df: DataFrame, value: str, width: float = 0.1, least: str | None = None) -> DataFrame:
    """(n, near, share): of the values above 0.5 those within ``width`` of a whole number, weighted by ``least`` if it is named."""
    weight = F.col(least) if least else F.lit(1)
    ok = df.where(F.col(value) > 0.5)
    near = F.abs(F.col(value) - F.round(F.col(value))) <= width
    sums = ok.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum(F.when(near, weight).otherwise(0)), F.lit(0)).cast("bigint").alias("near"))
    return sums.select("n", "near", F.when(F.col("n") > 0, F.round(F.col("near") / F.col("n"), 6)).alias("share"))


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[int] = (5, 25, 50, 75, 95)) -> DataFrame:
    """(by..., n, mean, variance, q05...): moments and quantiles of whole numbers, from how often each stands.

    A quantile is the least value that the stated percentage of rows does not exceed.
    """
    counts = length_counts(df, value, by)
    w = Window.partitionBy(*by).orderBy("len")
    whole = Window.partitionBy(*by)
    rows = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(whole))
    mean = F.sum(F.col("len") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("len") * F.col("len") * F.col("n")) / F.sum("n")
    picks = [F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("len"))).alias(f"q{q:02d}") for q in quantiles]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.round(mean, 4).alias("mean"), F.round(square - mean * mean, 4).alias("variance"), *picks)
