"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which every executor shares.

    Only where that is unset (tests, a local bench) a folder of this machine is set.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="strandflow-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: A guessed size of more bits than this (a petabyte) is no guess any more.
LARGEST_GUESS_BITS = 50
_WRITTEN: dict[tuple, tuple[DataFrame, ...]] = {}


def written_once(spark: SparkSession, key: tuple, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """What ``make`` gives, checkpointed, and the same again for the same key as long as the application runs.

    For tables that many queries of a session read, such as the graph of one folder of reads, which
    must not change meanwhile.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        _WRITTEN[key] = tuple(cut_large(df) for df in make())
    return _WRITTEN[key]


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size that the optimizer had guessed for its plan. A guess for a join is
    the product of its sides, so over rounds of joins it grows without bound, and so does the time
    spent on it. Where it is past any real size the rows are taken without it; sizes are then
    measured at run time.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager)
    plan = out._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()).bit_length() <= LARGEST_GUESS_BITS:
        return out
    return _sizeless(out)


def _sizeless(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def cut_large(df: DataFrame) -> DataFrame:
    """``cut`` for tables that grow with the data, such as reads, edges and paths: no join broadcasts them.

    The optimizer's guess takes what is exploded for as small as it was before, and the size measured at
    run time is that of compressed rows, which lists of equal qualities make many times smaller than they
    are. By either such tables went whole through the driver. Joins with them, or with what
    projections, filters and aggregates make of them, are sorted merges.
    """
    return sort_merged(_sizeless(cut(df)))


def spread(df: DataFrame) -> DataFrame:
    """df over all shuffle partitions; few bytes that grow to many would else be gathered in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sort_merged(df: DataFrame) -> DataFrame:
    """df, whose next join is a sorted merge, never a broadcast."""
    return df.hint("merge")
