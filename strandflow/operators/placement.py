"""Where reads lie on paths, and what pairs of reads say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.dna import kmers_of
from strandflow.operators.kmers import read_kmers
from strandflow.session import spread


def edge_kmers(edges: DataFrame, k: int) -> DataFrame:
    """(fwd, edge, off): every k-mer of every edge; each oriented k-mer lies on one edge only."""
    return edges.select("edge", F.posexplode(kmers_of(F.col("seq"), k)).alias("off", "fwd"))


def place_reads(reads: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, edge, off, n_kmers): maximal exact runs of a read along an edge, pos on the read.

    An equi-join of k-mers, then gaps and islands within each read.
    """
    hits = read_kmers(reads, k).join(edge_kmers(edges, k), "fwd").select("read_id", "pos", "edge", "off")
    w = Window.partitionBy("read_id").orderBy("pos", "edge")
    before = (F.lag("edge").over(w) == F.col("edge")) & (F.lag("off").over(w) == F.col("off") - 1) & (F.lag("pos").over(w) == F.col("pos") - 1)
    marked = hits.withColumn("fresh", F.when(before, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("read_id", "run", "edge").agg(F.min("pos").alias("pos"), F.min("off").alias("off"), F.count(F.lit(1)).cast("int").alias("n_kmers")).drop("run")


def read_paths(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(read_id, off, edges): the steps of each read in order, cut at the first that does not adjoin.

    off is where the read starts on the first edge (negative if before it); an edge repeated in a
    row is one step.
    """
    ends = edges.select("edge", "src", "dst")
    w = Window.partitionBy("read_id").orderBy("pos")
    steps = parts.join(ends, "edge").withColumn("prev", F.lag("edge").over(w)).withColumn("from", F.lag("dst").over(w))
    steps = steps.withColumn("bad", F.when(F.col("prev").isNotNull() & (F.col("prev") != F.col("edge")) & (F.col("from") != F.col("src")), 1).otherwise(0))
    kept = steps.withColumn("broken", F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("broken = 0")
    kept = kept.where(F.col("prev").isNull() | (F.col("prev") != F.col("edge")))
    return kept.groupBy("read_id").agg(
        F.min_by(F.col("off") - F.col("pos"), "pos").cast("int").alias("off"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge"))), lambda s: s["edge"]).alias("edges")
    )


def text_paths(reads: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(read_id, off, edges): as ``read_paths`` of ``place_reads``, but reads of one text are placed once.

    Where a read lies depends on its letters alone. Ids must be unique.
    """
    texts = spread(reads.select("seq").distinct()).select(F.col("seq").alias("read_id"), "seq")
    paths = read_paths(place_reads(texts, edges, k), edges).select(F.col("read_id").alias("seq"), "off", "edges")
    return reads.select("read_id", "seq").join(paths, "seq").select("read_id", "off", "edges")


def path_steps(paths: DataFrame) -> DataFrame:
    """(read_id, pos, edge)."""
    return paths.select("read_id", F.posexplode("edges").alias("pos", "edge"))


def path_index(steps: DataFrame) -> DataFrame:
    """(edge, n_reads): how many reads run over each edge; counted after a meeting by edge and read."""
    return steps.groupBy("edge", "read_id").agg(F.lit(1).alias("one")).groupBy("edge").agg(F.count(F.lit(1)).alias("n_reads"))


def edge_support(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, support): steps that enter the edge after a path's first step, on it or on its inverse."""
    entered = steps.where("pos > 0").select("edge")
    last = steps.groupBy("read_id").agg(F.max("pos").alias("last"))
    mirrored = steps.join(last, "read_id").where("pos < last").join(edges.select("edge", "inv"), "edge").select(F.col("inv").alias("edge"))
    return entered.unionByName(mirrored).groupBy("edge").agg(F.count(F.lit(1)).alias("support"))


def pair_coverage(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, pairs, cov): distinct pairs on an edge or its inverse, and by k-mer, six digits."""
    on = steps.select("edge", F.shiftright("read_id", 1).alias("pair")).distinct()
    mirrored = on.join(edges.select("edge", "inv"), "edge").select(F.col("inv").alias("edge"), "pair")
    pairs = on.unionByName(mirrored).distinct().groupBy("edge").agg(F.count(F.lit(1)).alias("pairs"))
    return edges.select("edge", "n_kmers").join(pairs, "edge", "left").select("edge", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.round(F.coalesce("pairs", F.lit(0)) / F.col("n_kmers"), 6).alias("cov"))


def fragment_distribution(locs: DataFrame, uid: str, start: str, rid: str, rc: str, length: int = 0, limit: int = 1000, width: int = 10) -> DataFrame:
    """(bin_center, n, mass): distances of mates placed on one path facing each other, below ``limit``.

    locs holds one row per placement. Mates are rid 2p and 2p+1; the forward one starts first.
    """
    rows = locs.where(F.col(uid).isNotNull() & F.col(start).isNotNull() & F.col(rid).isNotNull()).select(
        F.col(uid).alias("u"), F.shiftright(F.col(rid), 1).alias("pair"), F.col(rid).bitwiseAND(F.lit(1)).alias("mate"), F.col(start).alias("at"), F.col(rc).alias("rc")
    )
    fwd = rows.where("not rc").select("u", "pair", F.col("mate").alias("m1"), F.col("at").alias("a"))
    bwd = rows.where("rc").select("u", "pair", F.col("mate").alias("m2"), F.col("at").alias("b"))
    size = F.col("b") + length - F.col("a")
    frags = fwd.join(bwd, ["u", "pair"]).where((F.col("m1") != F.col("m2")) & (size >= 0) & (size < limit)).select((F.floor(size / width) * width + width / 2).alias("bin_center"))
    counted = frags.groupBy("bin_center").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("bin_center", "n", F.round(F.col("n") / F.col("total"), 6).alias("mass"))


def pair_links(locs: DataFrame, uid: str, rid: str) -> DataFrame:
    """(u1, u2, n): distinct pairs with one mate on u1 and the other on u2, u1 < u2.

    Placements meet by pair, of which there are a few each; a path that holds a third of all
    placements is no hot key here. The counts are combined before they are shuffled.
    """
    on = locs.where(F.col(uid).isNotNull() & F.col(rid).isNotNull()).select(F.shiftright(F.col(rid), 1).alias("pair"), F.col(rid).bitwiseAND(F.lit(1)).alias("mate"), F.col(uid).alias("u")).distinct()
    one = on.where("mate = 0").select("pair", F.col("u").alias("a"))
    two = on.where("mate = 1").select("pair", F.col("u").alias("b"))
    met = one.join(two, "pair").where("a <> b").select("pair", F.least("a", "b").alias("u1"), F.greatest("a", "b").alias("u2")).distinct()
    return met.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n"))


def accepted_links(links: DataFrame, least: int = 3) -> DataFrame:
    """Links of at least ``least`` pairs that are the one strongest on both their ends."""
    ends = links.select(F.inline(F.array(F.struct(F.col("u1").alias("u"), "n"), F.struct(F.col("u2").alias("u"), "n"))))
    best = ends.groupBy("u").agg(F.max("n").alias("best"))
    ties = ends.join(best, "u").where("n = best").groupBy("u", "best").agg(F.count(F.lit(1)).alias("ties")).where("ties = 1")
    a = ties.select(F.col("u").alias("u1"), F.col("best").alias("best1"))
    b = ties.select(F.col("u").alias("u2"), F.col("best").alias("best2"))
    return links.where(F.col("n") >= least).join(a, "u1").join(b, "u2").where("n = best1 and n = best2").select("u1", "u2", "n")


def consensus_columns(locs: DataFrame, reads: DataFrame) -> DataFrame:
    """(uid, col, base, top, second): quality sums of the bases that placed reads put on each column.

    A quality of 0 to 2 counts 0.2 at most. Ties go to the base that comes first. locs: uid,
    start_pos, rid, rc; a reverse placement counts the reverse complement of the read.
    """
    from strandflow.functions.dna import revcomp

    n = F.length("seq")
    full = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.col("qual"), i), F.lit(0)))
    placed = locs.join(reads.select(F.col("read_id").alias("rid"), "seq", full.alias("q")), "rid")
    laid = placed.select("uid", "start_pos", F.when(F.col("rc"), revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("s"), F.when(F.col("rc"), F.reverse("q")).otherwise(F.col("q")).alias("q"))
    cells = laid.select("uid", "start_pos", F.posexplode(F.arrays_zip(F.split("s", "").alias("base"), F.col("q").alias("q"))).alias("i", "c"))
    tenths = F.when(F.col("c.q") <= 2, F.least(F.col("c.q") * 10, F.lit(2))).otherwise(F.col("c.q") * 10)
    sums = cells.select("uid", (F.col("start_pos") + F.col("i")).alias("col"), F.col("c.base").alias("base"), tenths.alias("w"))
    wide = sums.groupBy("uid", "col").agg(*[(F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0)) / 10).alias(b) for b in "ACGT"])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("w"), F.lit(b).alias("base")) for b in "ACGT"]))
    return wide.select("uid", "col", ranked.alias("r")).select("uid", "col", F.col("r")[0]["base"].alias("base"), (-F.col("r")[0]["w"]).alias("top"), (-F.col("r")[1]["w"]).alias("second"))
