"""Votes of read paths for ways through the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_votes(paths: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, n_for, n_partial, n_against): how reads speak on each way; each read is heard once on it.

    paths: read_id, edges. ways: way, edges, of two edges or more. A read is for a way if it runs
    over all of it in order; against it if it starts on one of its edges and leaves it for another
    edge within; partial if it runs over two edges of it or more without leaving. Meetings are by
    edge, so reads that touch no edge of a way are not looked at.
    """
    steps = paths.select("read_id", F.col("edges").alias("path"), F.posexplode("edges").alias("at", "edge"))
    way_steps = ways.select("way", F.col("edges").alias("goal"), F.posexplode("edges").alias("to", "edge"))
    met = steps.join(way_steps, "edge")
    here = F.slice("path", F.col("at") + 1, F.size("path"))
    there = F.slice("goal", F.col("to") + 1, F.size("goal"))
    n = F.least(F.size(here), F.size(there))
    alike = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.forall(F.sequence(F.lit(1), i), lambda j: F.get(here, j - 1) == F.get(there, j - 1))))
    first = (F.col("at") == 0) | (F.col("to") == 0) | (F.get("path", F.col("at") - 1) != F.get("goal", F.col("to") - 1))
    judged = met.where(first).select("way", "read_id", alike.alias("alike"), n.alias("n"), ((F.col("to") == 0) & (alike == F.size("goal"))).alias("whole"))
    heard = judged.groupBy("way", "read_id").agg(F.max("whole").alias("whole"), F.max((F.col("alike") < F.col("n"))).alias("left"), F.max("alike").alias("alike"))
    votes = heard.groupBy("way").agg(F.count_if("whole").alias("n_for"), F.count_if(~F.col("whole") & ~F.col("left") & (F.col("alike") >= 2)).alias("n_partial"), F.count_if(~F.col("whole") & F.col("left")).alias("n_against"))
    return ways.select("way").join(votes, "way", "left").na.fill(0)


def perfect_matching(crossings: DataFrame, least: int = 1) -> DataFrame:
    """(region, came, goes): regions whose ways in and out pair one to one by the reads that cross them.

    crossings: region, came, goes, n. A region is solved if every way in has exactly one way out of
    ``least`` reads or more, and every way out one way in.
    """
    seen = crossings.where(F.col("n") >= least).select("region", "came", "goes").distinct()
    ins = seen.groupBy("region", "came").agg(F.count(F.lit(1)).alias("n"))
    outs = seen.groupBy("region", "goes").agg(F.count(F.lit(1)).alias("n"))
    torn = ins.where("n > 1").select("region").unionByName(outs.where("n > 1").select("region")).distinct()
    return seen.join(torn, "region", "left_anti")
