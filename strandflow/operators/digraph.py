"""General graph algorithms over edges(src, dst[, n_kmers]) as rounds of joins, each checkpointed.

Bounds on hops or lengths are part of the questions asked here, as in the cleaning rules that ask
them; questions without a bound run until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut


def sources(edges: DataFrame) -> DataFrame:
    """(vertex) of vertices that no edge enters."""
    return edges.select(F.col("src").alias("vertex")).distinct().join(edges.select(F.col("dst").alias("vertex")), "vertex", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    """(vertex) of vertices that no edge leaves."""
    return edges.select(F.col("dst").alias("vertex")).distinct().join(edges.select(F.col("src").alias("vertex")), "vertex", "left_anti")


def hops_from(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, vertex, hops): fewest edges from each start (vertex) to what it reaches, itself at 0."""
    step = edges.select(F.col("src").alias("vertex"), F.col("dst").alias("next")).distinct()
    known = cut(starts.select(F.col("vertex").alias("start"), "vertex", F.lit(0).alias("hops")).distinct())
    front, n = known, 0
    while (most is None or n < most) and not front.isEmpty():
        n += 1
        ahead = front.join(step, "vertex").select("start", F.col("next").alias("vertex")).distinct()
        front = cut(ahead.join(known.select("start", "vertex"), ["start", "vertex"], "left_anti").withColumn("hops", F.lit(n)))
        known = cut(known.unionByName(front))
    return known


def shortest(edges: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, vertex, length): least sum of n_kmers from each start, up to ``limit``."""
    step = edges.groupBy(F.col("src").alias("vertex"), F.col("dst").alias("next")).agg(F.min("n_kmers").alias("w"))
    known = cut(starts.select(F.col("vertex").alias("start"), "vertex", F.lit(0).cast("bigint").alias("length")).distinct())
    front = known
    while not front.isEmpty():
        ahead = front.join(step, "vertex").select("start", F.col("next").alias("vertex"), (F.col("length") + F.col("w")).alias("length"))
        ahead = ahead.groupBy("start", "vertex").agg(F.min("length").alias("length"))
        if limit is not None:
            ahead = ahead.where(F.col("length") <= limit)
        old = known.select("start", "vertex", F.col("length").alias("old"))
        front = cut(ahead.join(old, ["start", "vertex"], "left").where("old is null or length < old").select("start", "vertex", "length"))
        known = cut(known.unionByName(front).groupBy("start", "vertex").agg(F.min("length").alias("length")))
    return known


def on_circles(edges: DataFrame) -> DataFrame:
    """(vertex) of the cyclic core: what is left when sources and sinks are taken off until none is left."""
    left = cut(edges.select("src", "dst").distinct())
    while True:
        able = left.select(F.col("src").alias("v")).intersect(left.select(F.col("dst").alias("v")))
        inner = left.join(able.withColumnRenamed("v", "src"), "src", "left_semi").join(able.withColumnRenamed("v", "dst"), "dst", "left_semi")
        fewer = cut(inner)
        if fewer.count() == left.count():
            return left.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
        left = fewer


def is_acyclic(edges: DataFrame) -> bool:
    return on_circles(edges).isEmpty()


def walks(edges: DataFrame, starts: DataFrame, ends: DataFrame, most_hops: int) -> DataFrame:
    """(start, end, path): every way of 1 to ``most_hops`` edges from a start to an end, none through a vertex twice.

    edges also has edge, its name.
    """
    step = edges.select(F.col("src").alias("at"), "edge", F.col("dst").alias("to"))
    goal = ends.select(F.col("vertex").alias("at")).distinct()
    front = starts.select(F.col("vertex").alias("start"), F.col("vertex").alias("at"), F.array().cast("array<string>").alias("path"), F.array("vertex").alias("seen")).distinct()
    found = None
    for _ in range(most_hops):
        grown = front.join(step, "at").where(~F.array_contains("seen", F.col("to")))
        front = cut(grown.select("start", F.col("to").alias("at"), F.concat("path", F.array("edge")).alias("path"), F.concat("seen", F.array("to")).alias("seen")))
        hit = front.join(goal, "at", "left_semi").select("start", F.col("at").alias("end"), "path")
        found = hit if found is None else found.unionByName(hit)
        if front.isEmpty():
            break
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): least vertex of each strongly connected component.

    The cyclic core is split by what its least vertices reach and are reached from, again and again.
    """
    every = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    core = on_circles(edges)
    left = cut(edges.select("src", "dst").distinct().join(core.withColumnRenamed("vertex", "src"), "src", "left_semi").join(core.withColumnRenamed("vertex", "dst"), "dst", "left_semi"))
    done = None
    while not left.isEmpty():
        low_fw, low_bw = _least_label(left), _least_label(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = cut(low_fw.withColumnRenamed("low", "a").join(low_bw.withColumnRenamed("low", "b"), "vertex"))
        same = both.where("a = b").select("vertex", F.col("a").alias("component"))
        done = cut(same) if done is None else cut(done.unionByName(same))
        rest = both.where("a <> b")
        src = rest.select(F.col("vertex").alias("src"), F.col("a").alias("sa"), F.col("b").alias("sb"))
        dst = rest.select(F.col("vertex").alias("dst"), F.col("a").alias("da"), F.col("b").alias("db"))
        left = cut(left.join(src, "src").join(dst, "dst").where("sa = da and sb = db").select("src", "dst"))
    if done is None:
        return every.select("vertex", F.col("vertex").alias("component"))
    return every.join(done, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _least_label(edges: DataFrame) -> DataFrame:
    """(vertex, low): least vertex from which the vertex can be reached."""
    low = cut(edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().select("vertex", F.col("vertex").alias("low")))
    while True:
        given = edges.join(low.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("low").alias("new"))
        new = cut(low.join(given, "vertex", "left").select("vertex", F.least("low", "new").alias("low"), F.coalesce(F.col("new") < F.col("low"), F.lit(False)).alias("changed")))
        low = new.drop("changed")
        if new.where("changed").isEmpty():
            return low


def closure(pairs: DataFrame) -> DataFrame:
    """(a, b) of the transitive closure, by squaring; its size is that of the answer."""
    known = cut(pairs.select("a", "b").distinct())
    n = known.count()
    while True:
        two = known.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        known = cut(known.unionByName(two).distinct())
        more = known.count()
        if more == n:
            return known
        n = more
