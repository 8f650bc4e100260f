"""Lines: edges in a row, with cells of alternative paths between them; their statistics and links.

A line is held as rows (line, seg, alt, step, edge): even segments are single edges, odd ones cells
with one ``alt`` per path; a path of no step is a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.graph import chains, vertex_degrees
from strandflow.session import cut_large, sort_merged


def find_cells(edges: DataFrame, max_paths: int = 50, max_depth: int = 10) -> DataFrame:
    """(entry, exit, paths): bounded stretches where the graph parts and comes together again.

    From an entry (one edge in, several out) all paths are followed for at most ``max_depth`` edges;
    the exit is the nearest vertex (one edge out, several in) that all of them pass, provided that
    no inner vertex is entered from elsewhere and none comes back. Entries with more than
    ``max_paths`` paths, or with a dead end before the exit, have no cell: that is the definition,
    not a sample.
    """
    deg = cut_large(vertex_degrees(edges))
    out = edges.select(F.col("src").alias("end"), F.col("edge").alias("next"), F.col("dst").alias("to"))
    entries = deg.where("n_in = 1 and n_out > 1").select(F.col("vertex").alias("entry"))
    exits = deg.where("n_out = 1 and n_in > 1").select(F.col("vertex").alias("end"), F.lit(True).alias("stop"))
    paths = entries.select("entry", F.col("entry").alias("end"), F.array().cast("array<string>").alias("path"), F.array("entry").alias("seen"))
    found = None
    for _ in range(max_depth):
        grown = paths.join(out, "end").select("entry", F.col("to").alias("end"), F.concat("path", F.array("next")).alias("path"), "seen")
        loops = grown.where(F.array_contains("seen", F.col("end"))).select("entry").distinct()
        grown = grown.withColumn("seen", F.concat("seen", F.array("end"))).join(sort_merged(loops), "entry", "left_anti")
        n = F.count(F.lit(1)).over(Window.partitionBy("entry"))
        paths = cut_large(grown.withColumn("n", n).where(F.col("n") <= max_paths).drop("n"))
        if paths.isEmpty():
            break
        longest = paths if found is None else found.unionByName(paths)
        found = cut_large(longest)
    if found is None:
        return entries.select("entry", F.col("entry").alias("exit"), F.array().cast("array<array<string>>").alias("paths")).where("false")
    # paths cut at each exit they pass, in all ways to get there
    cut_off = found.join(exits, "end").select("entry", F.col("end").alias("exit"), "path", "seen")
    cells = cut_off.groupBy("entry", "exit").agg(
        F.array_sort(F.collect_set("path")).alias("paths"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("inner"), F.max(F.size("path")).alias("depth")
    )
    cells = cells.where(F.size("paths").between(2, max_paths)).withColumn("own", F.array_distinct(F.flatten("paths")))
    # inner vertices: all that is entered or left there must belong to the cell
    spots = cells.select("entry", "exit", "own", F.explode(F.array_except("inner", F.array("entry", "exit"))).alias("vertex"))
    touch = edges.select(F.col("edge"), F.inline(F.array(F.struct(F.col("src").alias("vertex")), F.struct(F.col("dst").alias("vertex")))))
    open_ = spots.join(touch, "vertex").where(~F.array_contains("own", F.col("edge"))).select("entry", "exit").distinct()
    ends = deg.select(F.col("vertex").alias("exit"), F.col("n_in"))
    last = cells.select("entry", "exit", "paths", "depth", F.size(F.array_distinct(F.transform("paths", lambda p: F.element_at(p, -1)))).alias("ways")).join(ends, "exit").where("ways = n_in")
    firsts = deg.select(F.col("vertex").alias("entry"), "n_out")
    whole = last.join(firsts, "entry").where(F.size(F.array_distinct(F.transform("paths", lambda p: p[0]))) == F.col("n_out")).join(sort_merged(open_), ["entry", "exit"], "left_anti")
    near = whole.groupBy("entry").agg(F.min_by(F.struct("exit", "paths"), F.struct("depth", "exit")).alias("c"))
    return near.select("entry", "c.exit", "c.paths")


def find_lines(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(line, seg, alt, step, edge): edges outside cells chained through cells and plain vertices.

    A line is named by its first edge; on a circle, by its least. Every edge is on one line.
    """
    inside = cells.select(F.explode(F.flatten("paths")).alias("edge")).distinct()
    units = sort_merged(edges.join(inside, "edge", "left_anti"))
    deg = vertex_degrees(edges)
    plain = deg.where("n_in = 1 and n_out = 1").select(F.col("vertex").alias("entry"), F.col("vertex").alias("exit"))
    steps = plain.unionByName(cells.select("entry", "exit"))
    link = (
        units.select(F.col("edge").alias("u"), F.col("dst").alias("entry")).join(steps, "entry").join(units.select(F.col("edge").alias("v"), F.col("src").alias("exit")), "exit").where("u <> v").select("u", "v", "entry", "exit")
    )
    once = cut_large(link.distinct())
    placed = cut_large(chains(units.select(F.col("edge").alias("node")), once.select("u", "v")))
    singles = placed.select(F.col("head").alias("line"), (F.col("rank") * 2).cast("int").alias("seg"), F.lit(0).alias("alt"), F.lit(0).alias("step"), F.col("node").alias("edge"))
    through = once.join(placed.select(F.col("node").alias("u"), "head", "rank"), "u").join(placed.select(F.col("node").alias("v"), F.col("rank").alias("next")), "v").where("next = rank + 1")
    alts = through.join(cells, ["entry", "exit"]).select(F.col("head").alias("line"), (F.col("rank") * 2 + 1).cast("int").alias("seg"), F.posexplode("paths").alias("alt", "path"))
    return singles.unionByName(alts.select("line", "seg", "alt", F.posexplode("path").alias("step", "edge")))


def segment_length(lengths) -> object:
    """Length of a segment from the array of its paths' lengths: the one, the whole mean of two, else
    the median, of an even number the whole mean of the middle two.
    """
    s, n = F.array_sort(lengths), F.size(lengths)
    half = F.floor(n / 2).cast("int")
    middle = F.floor((F.element_at(s, half) + F.element_at(s, half + 1)) / 2)
    return F.when(n == 0, 0).when(n % 2 == 0, middle).otherwise(F.element_at(s, half + 1)).cast("bigint")


def line_lengths(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(line, len) in k-mers."""
    paths = lines.join(edges.select("edge", "n_kmers"), "edge").groupBy("line", "seg", "alt").agg(F.sum("n_kmers").alias("len"))
    segs = paths.groupBy("line", "seg").agg(F.collect_list("len").alias("l"))
    return segs.groupBy("line").agg(F.sum(segment_length(F.col("l"))).alias("len"))


def line_pairs(lines: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(line, npairs): distinct pairs with a read on some edge of the line or on its inverse."""
    of = lines.select("line", "edge").distinct()
    both = of.unionByName(of.join(edges.select("edge", "inv"), "edge").select("line", F.col("inv").alias("edge"))).distinct()
    on = both.join(steps.select("edge", F.shiftright("read_id", 1).alias("pair")).distinct(), "edge").select("line", "pair").distinct()
    return on.groupBy("line").agg(F.count(F.lit(1)).alias("npairs"))


def sorted_lines(lengths: DataFrame) -> DataFrame:
    """Longest first, then by name."""
    return lengths.orderBy(F.desc("len"), "line")


def coverage_mass(cov: DataFrame, tolerance: float = 0.08, width: float = 0.01) -> DataFrame:
    """(line, mass): total length of the lines whose coverage lies within a share of this one's.

    cov: line, cov, len. Lines meet in steps of the logarithm of the coverage as wide as the
    tolerance; what a step holds is summed first where it lies within reach as a whole.
    """
    import math

    step = math.log1p(tolerance)
    rows = cov.where("cov > 0").select("line", "cov", "len", F.floor(F.log("cov") / step).alias("b"))
    same = rows.groupBy("b", F.col("cov").alias("c")).agg(F.sum("len").alias("l"))
    near = same.select(F.explode(F.array(F.col("b") - 2, F.col("b") - 1, "b", F.col("b") + 1, F.col("b") + 2)).alias("b"), "c", "l")
    asked = rows.select("b", "cov").distinct()
    mass = asked.join(near, "b").where((F.col("c") >= F.col("cov") * (1 - tolerance)) & (F.col("c") <= F.col("cov") * (1 + tolerance))).groupBy("cov").agg(F.sum("l").alias("mass"))
    return rows.join(mass, "cov").select("line", "mass")


def accepted_gaps(links: DataFrame, lines: DataFrame, least: int = 3, min_line: int = 5000, ratio: float = 1.2) -> DataFrame:
    """(e1, e2, n): directed links strong enough to join two lines.

    At least ``least`` pairs; both lines of ``min_line`` or more with coverages within ``ratio``; no
    stronger link from e1 nor into e2, and no equal one. lines: edge, len, cov.
    """
    a = lines.select(F.col("edge").alias("e1"), F.col("len").alias("l1"), F.col("cov").alias("c1"))
    b = lines.select(F.col("edge").alias("e2"), F.col("len").alias("l2"), F.col("cov").alias("c2"))
    fit = links.join(a, "e1").join(b, "e2").where((F.col("n") >= least) & (F.least("l1", "l2") >= min_line) & (F.greatest("c1", "c2") <= ratio * F.least("c1", "c2")))
    rank = lambda c, o: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("n"), o))
    again = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c, "n"))
    ranked = fit.withColumn("r1", rank("e1", "e2")).withColumn("r2", rank("e2", "e1")).withColumn("t1", again("e1")).withColumn("t2", again("e2"))
    return ranked.where("r1 = 1 and r2 = 1 and t1 = 1 and t2 = 1").select("e1", "e2", "n")


def symmetric(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links together with those of the inverse edges, (inv e2, inv e1)."""
    inv = edges.select("edge", "inv")
    back = links.join(inv.select(F.col("edge").alias("e1"), F.col("inv").alias("i1")), "e1").join(inv.select(F.col("edge").alias("e2"), F.col("inv").alias("i2")), "e2")
    return links.unionByName(back.select(F.col("i2").alias("e1"), F.col("i1").alias("e2"), "n")).groupBy("e1", "e2").agg(F.max("n").alias("n"))


def line_sequences(lines: DataFrame, edges: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """(line, seq): letters of each line, of every cell the path with most support, ties to the first; edges overlap by k-1."""
    sup = lines.join(support, "edge", "left").groupBy("line", "seg", "alt").agg(F.min(F.coalesce("support", F.lit(0))).alias("s"))
    best = sup.groupBy("line", "seg").agg(F.min_by("alt", F.struct(-F.col("s"), "alt")).alias("alt"))
    parts = lines.join(best, ["line", "seg", "alt"]).join(edges.select("edge", "seq"), "edge")
    steps = parts.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("seg", "step", "seq"))).alias("p"))
    rest = F.transform(F.col("p"), lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], F.lit(k), F.length(x["seq"]))))
    return steps.select("line", F.array_join(rest, "").alias("seq"))


def one_of_two(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): of each line and that of its inverse edges the one that is not after the other by name."""
    single = lines.where("seg % 2 = 0").select("line", "edge")
    back = single.join(edges.select("edge", "inv"), "edge").select("line", F.col("inv").alias("edge")).join(single.withColumnRenamed("line", "other"), "edge")
    return back.groupBy("line").agg(F.min("other").alias("other")).where("line <= other").select("line")


def stats_lines(stats: DataFrame, lines: DataFrame) -> DataFrame:
    """(text) of each line: ``line[name] first..last len=L npairs=N cov=C``, of stats(line, len, npairs, cov)."""
    ends = lines.where("seg % 2 = 0").groupBy("line").agg(F.min_by("edge", "seg").alias("a"), F.max_by("edge", "seg").alias("b"))
    rows = stats.join(ends, "line")
    return rows.select(F.format_string("line[%s] %s..%s len=%d npairs=%d cov=%.3f", "line", "a", "b", "len", "npairs", "cov").alias("text"))
