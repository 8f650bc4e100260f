"""Links between far edges that pairs of reads give, and the clusters they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.digraph import hops_from
from strandflow.operators.graph import components


def line_tours(steps: DataFrame, of: DataFrame, least_length: int = 500) -> DataFrame:
    """(read_id, pos, line): the lines a read runs over in order, each once in a row, those of
    ``least_length`` or less left out. of: edge, line, len.
    """
    w = Window.partitionBy("read_id").orderBy("pos")
    named = steps.join(of.where(F.col("len") > least_length).select("edge", "line"), "edge")
    kept = named.withColumn("prev", F.lag("line").over(w)).where(F.col("prev").isNull() | (F.col("prev") != F.col("line")))
    return kept.select("read_id", (F.row_number().over(w) - 1).alias("pos"), "line")


def near_pairs(tours: DataFrame) -> DataFrame:
    """(l1, l2, n): over pairs of reads, lines x of mate 1 and y of mate 2 where neither mate has the other's.

    A read runs over few lines, so the meeting by pair stays small.
    """
    on = tours.select(F.shiftright("read_id", 1).alias("pair"), F.col("read_id").bitwiseAND(F.lit(1)).alias("mate"), "line").distinct()
    both = on.groupBy("pair", "line").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair", "line")
    alone = on.join(both, ["pair", "line"], "left_anti")
    a = alone.where("mate = 0").select("pair", F.col("line").alias("l1"))
    b = alone.where("mate = 1").select("pair", F.col("line").alias("l2"))
    return a.join(b, "pair").groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n"))


def far_links(links: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Links (e1, e2, n) whose ends are not within ``hops`` edges of each other, in either direction."""
    ends = links.select(F.explode(F.array("e1", "e2")).alias("edge")).distinct()
    starts = edges.join(ends, "edge", "left_semi").select("edge", F.col("dst").alias("vertex"))
    near = hops_from(edges, starts.select("vertex"), hops)
    ahead = starts.join(near.select(F.col("start").alias("vertex"), F.col("vertex").alias("src")), "vertex").join(edges.select("src", F.col("edge").alias("other")), "src").select("edge", "other").distinct()
    fw = ahead.select(F.col("edge").alias("e1"), F.col("other").alias("e2"))
    bw = ahead.select(F.col("other").alias("e1"), F.col("edge").alias("e2"))
    return links.join(fw.unionByName(bw).distinct(), ["e1", "e2"], "left_anti")


def link_clusters(links: DataFrame, most_edges: int = 20) -> DataFrame:
    """(cluster, edge): edges that links tie together; clusters of more than ``most_edges`` are given up, as the rule says."""
    found = components(links.select(F.col("e1").alias("a"), F.col("e2").alias("b")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_edges)
    return found.join(sizes.select("component"), "component", "left_semi").select(F.col("component").alias("cluster"), F.col("node").alias("edge"))


def with_gap_edges(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """edges plus an empty edge from the end of e1 to the start of e2 for each row of joined(e1, e2)."""
    a = edges.select(F.col("edge").alias("e1"), F.col("dst").alias("src"), F.col("inv").alias("i1"))
    b = edges.select(F.col("edge").alias("e2"), F.col("src").alias("dst"), F.col("inv").alias("i2"))
    gap = joined.select("e1", "e2").join(a, "e1").join(b, "e2")
    name = lambda x, y: F.concat(F.lit("gap:"), F.col(x), F.lit(":"), F.col(y))
    rows = gap.select(name("e1", "e2").alias("edge"), "src", "dst", F.lit("").alias("seq"), F.lit(0).alias("n_kmers"), name("i2", "i1").alias("inv"))
    return edges.select("edge", "src", "dst", "seq", "n_kmers", "inv").unionByName(rows)


def copy_number_peak(hist: DataFrame, drop: int = 5) -> float | None:
    """Coverage of single-copy sequence from hist(cov, mass): the peak that best explains its multiples.

    hist holds one row per step of coverage, a few thousand at most, and is read by the driver.
    A step is a candidate if its neighbours have less and the highest has no more than ``drop``
    times it. Of the candidates the one wins whose multiples 1/2, 1, 2, 3 and 4 gather most mass;
    ties go to the lower.
    """
    rows = sorted((float(r.cov), float(r.mass)) for r in hist.select("cov", "mass").collect())
    if not rows:
        return None
    top = max(m for _, m in rows)
    tops = [c for i, (c, m) in enumerate(rows) if m * drop >= top and (i == 0 or rows[i - 1][1] < m) and (i + 1 == len(rows) or rows[i + 1][1] <= m)]

    def gathered(c: float) -> float:
        weights = {0.5: 0.5, 1: 1.0, 2: 0.5, 3: 0.25, 4: 0.25}
        return sum(w * sum(m for x, m in rows if abs(x - f * c) <= 0.08 * f * c) for f, w in weights.items())

    return min(tops, key=lambda c: (-gathered(c), c), default=None)
