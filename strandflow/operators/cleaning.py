"""Evidence-based graph cleaning: tables of edges in, tables of edges (or decisions) out.

``edges`` has edge, src, dst, inv and n_kmers; ``support`` has edge and support. Thresholds are
keyword parameters with the usual defaults. Every deletion takes an edge together with its inverse.
A vertex has at most four edges on either side, so the joins on vertices do not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.graph import components, vertex_degrees
from strandflow.session import cut_large, sort_merged


def delete_edges(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """edges without those in ``doomed`` (edge) and their inverses."""
    doomed = cut_large(doomed.select("edge"))  # read twice
    gone = doomed.unionByName(doomed.join(edges.select("edge", "inv"), "edge").select(F.col("inv").alias("edge"))).distinct()
    return edges.join(gone, "edge", "left_anti")


def unsupported_branches(edges: DataFrame, support: DataFrame, most: int = 0, least: int = 10) -> DataFrame:
    """(edge) to delete: of exactly two edges out of (or into) a vertex the one with at most ``most``
    support, where the other has at least ``least`` times the larger of that and 1.
    """
    rows = edges.join(support, "edge", "left").withColumn("s", F.coalesce("support", F.lit(0)))
    out = None
    for side in ("src", "dst"):
        w = Window.partitionBy(side)
        two = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("other", F.sum("s").over(w) - F.col("s")).where("n = 2")
        weak = two.where((F.col("s") <= most) & (F.col("other") >= least * F.greatest(F.col("s"), F.lit(1)))).select("edge")
        out = weak if out is None else out.unionByName(weak)
    return out.distinct()


def branch_scores(votes: DataFrame, top: int = 100, weak: int = 50, ratio: int = 5, deepest: int = 15, branches: DataFrame | None = None) -> DataFrame:
    """(vertex, branch) to delete from votes(vertex, branch, score), one row per read.

    For a depth d from 0 to ``deepest`` the sum of the scores above d is at least ``top`` for the
    best branch, at most ``weak`` for this one, and the best is ``ratio`` times it or more. The least
    such d of a vertex decides. ``branches`` (vertex, branch) names those without a vote too.
    """
    at = votes.select("vertex", "branch", "score", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("d"))
    sums = at.groupBy("vertex", "branch", "d").agg(F.sum(F.when(F.col("score") > F.col("d"), F.col("score")).otherwise(0)).alias("q"))
    if branches is not None:
        every = branches.join(votes.select("vertex").distinct(), "vertex", "left_semi").select("vertex", "branch", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("d"))
        sums = every.join(sums, ["vertex", "branch", "d"], "left").select("vertex", "branch", "d", F.coalesce("q", F.lit(0)).alias("q"))
    best = sums.withColumn("best", F.max("q").over(Window.partitionBy("vertex", "d")))
    lost = best.where((F.col("best") >= top) & (F.col("q") <= weak) & (F.col("best") >= ratio * F.col("q")) & (F.col("q") < F.col("best")))
    return lost.withColumn("least", F.min("d").over(Window.partitionBy("vertex"))).where("d = least").select("vertex", "branch").distinct()


def distance_to_end(edges: DataFrame, limit: int) -> DataFrame:
    """(vertex, reach, complete): longest way in k-mers from a vertex to a sink, up to ``limit``.

    ``complete`` is false where a way goes on beyond the limit or in a circle. Rounds of relaxation,
    at most as many as edges fit in the limit; each round is one join, checkpointed.
    """
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    known = cut_large(vertices.join(edges.select(F.col("src").alias("vertex")), "vertex", "left_anti").select("vertex", F.lit(0).alias("reach")))
    total = vertices.count()
    done = known.count()
    while done < total:
        ahead = edges.join(known.select(F.col("vertex").alias("dst"), "reach"), "dst", "left")
        ready = ahead.groupBy(F.col("src").alias("vertex")).agg(F.max(F.col("reach").isNull()).alias("open"), F.max(F.col("reach") + F.col("n_kmers")).alias("reach"))
        fresh = ready.where(~F.col("open") & (F.col("reach") <= limit)).join(known.select("vertex"), "vertex", "left_anti").select("vertex", "reach")
        known = cut_large(known.unionByName(fresh))
        now = known.count()
        if now == done:
            break
        done = now
    return vertices.join(known, "vertex", "left").select("vertex", F.coalesce("reach", F.lit(limit)).alias("reach"), F.col("reach").isNotNull().alias("complete"))


def hanging_ends(edges: DataFrame, max_del: int = 100, ratio: int = 10) -> DataFrame:
    """(edge) to delete: a branch that ends within ``max_del`` k-mers beside one that reaches ``ratio`` times as far."""
    reach = distance_to_end(edges, max_del * ratio)
    far = edges.join(reach.withColumnRenamed("vertex", "dst"), "dst").withColumn("d", F.col("n_kmers") + F.col("reach"))
    w = Window.partitionBy("src")
    ranked = far.withColumn("best", F.max("d").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("n") > 1) & F.col("complete") & (F.col("d") <= max_del) & (F.col("best") >= ratio * F.col("d"))).select("edge")


def small_components(edges: DataFrame, max_edge: int = 1000, max_total: int = 200) -> DataFrame:
    """(edge) to delete: of components without an edge above ``max_edge`` k-mers those of fewer than
    ``max_total`` in all, and those that hold no circle and no way of more than ``max_edge``.
    """
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = cut_large(edges.join(found.withColumnRenamed("node", "src"), "src"))
    sums = placed.groupBy("component").agg(F.max("n_kmers").alias("top"), F.sum("n_kmers").alias("total")).where(F.col("top") <= max_edge)
    tiny = sums.where(F.col("total") < max_total).select("component")
    rest = cut_large(placed.join(sums.where(F.col("total") >= max_total).select("component"), "component", "left_semi"))
    # a way is incomplete where it is longer than that or turns in a circle
    long_ = distance_to_end(rest, max_edge).where(~F.col("complete")).select(F.col("vertex").alias("src"))
    kept = rest.join(long_, "src", "left_semi").select("component").distinct()
    short = rest.select("component").distinct().join(kept, "component", "left_anti")
    return placed.join(tiny.unionByName(short), "component", "left_semi").select("edge")


def simple_bubbles(edges: DataFrame) -> DataFrame:
    """(src, dst, e1, e2): vertices joined by exactly two edges, which are all that leave or enter them."""
    deg = vertex_degrees(edges)
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2")).where("n = 2")
    a = deg.select(F.col("vertex").alias("src"), F.col("n_out").alias("o"))
    b = deg.select(F.col("vertex").alias("dst"), F.col("n_in").alias("i"))
    return pairs.join(a, "src").join(b, "dst").where("o = 2 and i = 2 and src <> dst").select("src", "dst", "e1", "e2")


def popped_bubbles(bubbles: DataFrame, edges: DataFrame, weights: DataFrame, p: float = 0.25, tail: float = 1e-5, most: int = 10) -> DataFrame:
    """(edge) to delete: the arm with less weight on both strands together, if on each strand with any
    weight so few of all would be chance below ``tail`` and its weight is under ``most``.

    weights: edge, weight (expected reads). An arm that is the inverse of the other stays.
    """
    from strandflow.operators.stats import binomial_cdf

    rows = bubbles.select("e1", "e2")
    for c, i in (("e1", "i1"), ("e2", "i2")):
        rows = rows.join(edges.select(F.col("edge").alias(c), F.col("inv").alias(i)), c)
    rows = rows.where("i1 <> e2")
    for c in ("e1", "e2", "i1", "i2"):
        rows = rows.join(weights.select(F.col("edge").alias(c), F.col("weight").alias(f"w_{c}")), c, "left")
    rows = rows.na.fill(0.0, ["w_e1", "w_e2", "w_i1", "w_i2"])
    one, two = F.col("w_e1") + F.col("w_i1"), F.col("w_e2") + F.col("w_i2")
    first = (two > one) | ((two == one) & (F.col("w_e2") > F.col("w_e1")))

    def weak(a: str, b: str) -> Column:
        less, n = F.when(first, F.col(a)).otherwise(F.col(b)), F.floor(2 * (F.col(a) + F.col(b))).cast("int")
        return (n == 0) | ((less < most) & (binomial_cdf(n, F.ceil(less).cast("int"), p) < tail))

    gone = rows.where((one + two > 0) & weak("w_e1", "w_e2") & weak("w_i1", "w_i2"))
    return gone.select(F.when(first, F.col("e1")).otherwise(F.col("e2")).alias("edge"))


def canonical_repeats(edges: DataFrame) -> DataFrame:
    """(repeat, in1, in2, out1, out2): an edge that alone joins two edges in to two edges out."""
    deg = cut_large(vertex_degrees(edges))
    mid = edges.join(deg.select(F.col("vertex").alias("src"), F.col("n_in").alias("li"), F.col("n_out").alias("lo")), "src").join(deg.select(F.col("vertex").alias("dst"), F.col("n_in").alias("ri"), F.col("n_out").alias("ro")), "dst")
    mid = mid.where("li = 2 and lo = 1 and ri = 1 and ro = 2 and src <> dst").select(F.col("edge").alias("repeat"), "src", "dst")
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.min("edge").alias("in1"), F.max("edge").alias("in2"))
    onto = edges.groupBy(F.col("src").alias("dst")).agg(F.min("edge").alias("out1"), F.max("edge").alias("out2"))
    return cut_large(mid.join(into, "src").join(onto, "dst").select("repeat", "in1", "in2", "out1", "out2"))


def separated_repeats(scores: DataFrame, least: int = 5, ratio: int = 5) -> DataFrame:
    """(repeat, straight) of repeats to pull apart from scores(repeat, s11, s12, s21, s22).

    sij: pairs that run from in i to out j. The two best must be a matching, reach ``least``
    together, and ``ratio`` times each of the others. straight: 1-1 and 2-2 belong together.
    """
    a, b = F.col("s11") + F.col("s22"), F.col("s12") + F.col("s21")
    weak = lambda total, x, y: (total >= least) & (total >= ratio * F.col(x)) & (total >= ratio * F.col(y))
    top = F.greatest("s12", "s21") <= F.least("s11", "s22")
    other = F.greatest("s11", "s22") <= F.least("s12", "s21")
    straight = top & weak(a, "s12", "s21") & (F.col("s11") > 0) & (F.col("s22") > 0)
    crossed = other & weak(b, "s11", "s22") & (F.col("s12") > 0) & (F.col("s21") > 0)
    return scores.select("repeat", F.when(straight, True).when(crossed, False).alias("straight")).where("straight is not null")


def unrollable_loops(edges: DataFrame, size: int = 800) -> DataFrame:
    """(prev, repeat, loop, next): prev -> R -> next with one edge back from R's end to its start; both ends long."""
    deg = vertex_degrees(edges)
    back = edges.select(F.col("edge").alias("loop"), F.col("src").alias("r_dst"), F.col("dst").alias("r_src"))
    run = edges.select(F.col("edge").alias("repeat"), F.col("src").alias("r_src"), F.col("dst").alias("r_dst"))
    prev = edges.where(F.col("n_kmers") >= size).select(F.col("edge").alias("prev"), F.col("dst").alias("r_src"))
    nxt = edges.where(F.col("n_kmers") >= size).select(F.col("edge").alias("next"), F.col("src").alias("r_dst"))
    rows = run.join(back, ["r_src", "r_dst"]).join(prev, "r_src").join(nxt, "r_dst").where("prev <> loop and next <> loop and prev <> next")
    rows = rows.join(deg.select(F.col("vertex").alias("r_src"), F.col("n_in").alias("li"), F.col("n_out").alias("lo")), "r_src").join(deg.select(F.col("vertex").alias("r_dst"), F.col("n_in").alias("ri"), F.col("n_out").alias("ro")), "r_dst")
    return rows.where("li = 2 and lo = 1 and ri = 1 and ro = 2").select("prev", "repeat", "loop", "next")


def plasmid_patterns(edges: DataFrame, pairs: DataFrame, links: DataFrame, least_pairs: int = 10, least_links: int = 2) -> DataFrame:
    """(e1, e2, back): components of two vertices with e1 and e2 one way and ``back`` the other way,
    at least ``least_pairs`` pairs on each and ``least_links`` links between e1 and e2.
    """
    deg = vertex_degrees(edges)
    two = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2")).where("n = 2 and src <> dst")
    one = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("back")).where("n = 1").select(F.col("src").alias("dst"), F.col("dst").alias("src"), "back")
    d1 = deg.select(F.col("vertex").alias("src"), F.col("n_in").alias("a"), F.col("n_out").alias("b"))
    d2 = deg.select(F.col("vertex").alias("dst"), F.col("n_in").alias("c"), F.col("n_out").alias("d"))
    found = two.join(one, ["src", "dst"]).join(d1, "src").join(d2, "dst").where("a = 1 and b = 2 and c = 2 and d = 1")
    for name in ("e1", "e2", "back"):
        found = found.join(pairs.select(F.col("edge").alias(name), F.col("pairs").alias(f"p_{name}")), name)
    found = found.where(" and ".join(f"p_{n} >= {least_pairs}" for n in ("e1", "e2", "back")))
    tied = sort_merged(links.select(F.least("e1", "e2").alias("e1"), F.greatest("e1", "e2").alias("e2"), "n").groupBy("e1", "e2").agg(F.sum("n").alias("n")))
    return found.join(tied, ["e1", "e2"]).where(F.col("n") >= least_links).select("e1", "e2", "back") if "n" not in found.columns else found.drop("n").join(tied, ["e1", "e2"]).where(F.col("n") >= least_links).select("e1", "e2", "back")


def mergeable(edges: DataFrame) -> DataFrame:
    """(u, v): edge u runs on to v alone, v comes from u alone, through a vertex that is not their own loop."""
    deg = vertex_degrees(edges).where("n_in = 1 and n_out = 1").select("vertex")
    whole = edges.where("src <> dst and n_kmers > 0")  # gap edges stay
    a = whole.select(F.col("edge").alias("u"), F.col("dst").alias("vertex"))
    b = whole.select(F.col("edge").alias("v"), F.col("src").alias("vertex"))
    return a.join(deg, "vertex", "left_semi").join(b, "vertex").select("u", "v")


def merge_chains(edges: DataFrame, k: int) -> DataFrame:
    """(old, edge, offset): which new edge each edge becomes part of, and where in it, in k-mers.

    Chains of edges through vertices of degree one and one become one edge named by their first.
    """
    from strandflow.operators.graph import chains

    placed = chains(edges.select(F.col("edge").alias("node")), mergeable(edges))
    sized = placed.join(edges.select(F.col("edge").alias("node"), "n_kmers"), "node")
    w = Window.partitionBy("head").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select(F.col("node").alias("old"), F.col("head").alias("edge"), F.coalesce(F.sum("n_kmers").over(w), F.lit(0)).alias("offset"))


def moved_paths(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """(read_id, pos, edge): path steps on merged edges; steps that fall on the same new edge in a row are one."""
    w = Window.partitionBy("read_id").orderBy("pos")
    new = steps.join(moves.select(F.col("old").alias("edge"), F.col("edge").alias("new")), "edge").select("read_id", "pos", F.col("new").alias("edge"))
    kept = new.withColumn("prev", F.lag("edge").over(w)).where(F.col("prev").isNull() | (F.col("prev") != F.col("edge")))
    return kept.select("read_id", (F.row_number().over(w) - 1).alias("pos"), "edge")
