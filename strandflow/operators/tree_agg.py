"""Per-key results although a handful of keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    chunks: int | None = None,
    fan_in: int = 16,
) -> DataFrame:
    """One row per key with the merged measures; no reducer ever takes all partials of a hot key.

    ``measures``: name -> ("sum" | "min" | "max", column of a row's own state). The input's
    partitions, which Spark cuts to a fixed size, are the chunks: each is combined where it lies
    (the partial aggregate), and the states of one key then meet in rounds, ``fan_in`` of them at
    most in each group of a round. ``chunks`` is a bound on the number of partitions, by default the
    one that ``expected_chunks`` reads off the plan; the number of rounds is its logarithm to the
    base ``fan_in``, at least two. Were there more, they would wrap around.

    Null keys are a key of their own. Null states are passed over, as SUM, MIN and MAX do. An empty
    table gives an empty result. Columns other than the keys and measures are not read; a column of
    the input named like a measure is not disturbed by it.
    """
    chunks = max(2, chunks or expected_chunks(df))
    rounds = max(2, math.ceil(math.log(chunks) / math.log(fan_in)))
    fan = max(2, math.ceil(chunks ** (1 / rounds)))
    kind = {f"m{i}": how for i, (how, _) in enumerate(measures.values())}
    states = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        *[state.alias(f"m{i}") for i, (_, state) in enumerate(measures.values())],
        F.pmod(F.spark_partition_id(), F.lit(fan**rounds)).alias("chunk"),
    )
    own = [f"k{i}" for i in range(len(keys))]
    for level in range(1, rounds + 1):
        group = [*own, F.floor(F.col("chunk") / F.lit(fan)).cast("int").alias("chunk")] if level < rounds else own
        states = states.groupBy(*group).agg(*[_MERGE[how](m).alias(m) for m, how in kind.items()])
    return states.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"m{i}").alias(name) for i, name in enumerate(measures)],
    )


def expected_chunks(df: DataFrame) -> int:
    """Number of partitions of ``df`` by its plan, without running anything; no less than the shuffle partitions.

    A narrow plan has those of its scan, which Spark cuts by bytes; behind an exchange there are as
    many as it names, or the session's shuffle partitions.
    """
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    shuffled = conf.numShufflePartitions()

    def count(node) -> int:
        name = node.nodeName()
        if name in ("Project", "Filter", "Generate", "MapInArrow", "MapInPandas"):
            return count(node.children().apply(0))
        if name == "Union":
            return sum(count(node.children().apply(i)) for i in range(node.children().size()))
        if name == "LogicalRelation":
            files = len(df.inputFiles())
            size = int(str(node.stats().sizeInBytes())) + files * conf.filesOpenCostInBytes()
            cut_at = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // spark.sparkContext.defaultParallelism))
            return max(files, -(-size // cut_at))
        if name in ("LogicalRDD", "Scan ExistingRDD"):
            return node.rdd().getNumPartitions()
        if name.startswith("Repartition"):
            return max(shuffled, node.numPartitions())
        return shuffled

    return max(shuffled, count(df._jdf.queryExecution().optimizedPlan()))


def key_figures(df: DataFrame, key: str, member: str | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows, distinct members and sums for each key: (key, n_rows[, n_members], sums...).

    Distinct members of a hot key are counted without a set per key: rows first meet by (key,
    member), which spreads a hot key over all tasks, and the counts go up the tree. A null member
    is not counted as one, as COUNT(DISTINCT) does.
    """
    sums = dict(sums or {})
    if member is None:
        return tree_aggregate(df, [key], {"n_rows": ("sum", F.lit(1).cast("bigint"))} | {n: ("sum", c) for n, c in sums.items()})
    met = df.select(F.col(key).alias("k"), F.col(member).alias("m"), *[c.alias(f"s{i}") for i, c in enumerate(sums.values())])
    met = met.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))])
    return tree_aggregate(
        met,
        ["k"],
        {"n_rows": ("sum", F.col("n")), "n_members": ("sum", F.col("m").isNotNull().cast("bigint"))} | {n: ("sum", F.col(f"s{i}")) for i, n in enumerate(sums)},
    ).withColumnRenamed("k", key)
