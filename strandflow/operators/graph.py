"""Sequence graph: unipaths by pointer doubling, vertices, involution, components, checks.

Keys are natural: an oriented k-mer is a node, a unipath is named by its first k-mer, a vertex by
its (k-1)-mer. They do not depend on timing, partitioning or engine, and need no global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.dna import kmers_of, revcomp
from strandflow.operators.kmers import AT_BITS, complement_bits, placed_kmers
from strandflow.session import cut_large, sort_merged


def oriented(kmers: DataFrame) -> DataFrame:
    """(node, pred, succ, palindrome): both strands of each canonical k-mer; a palindrome once."""
    rev = revcomp(F.col("kmer"))
    fwd = F.struct(F.col("kmer").alias("node"), "pred", "succ", (rev == F.col("kmer")).alias("palindrome"))
    bwd = F.struct(rev.alias("node"), complement_bits(F.col("succ")).alias("pred"), complement_bits(F.col("pred")).alias("succ"), F.lit(False).alias("palindrome"))
    # one pass: a union would make the k-mers twice
    return kmers.select(F.inline(F.when(rev == F.col("kmer"), F.array(fwd)).otherwise(F.array(fwd, bwd))))


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): u runs on to v alone, v comes from u alone, and neither is a palindrome."""
    only = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.log2(F.col("succ")) + 1).cast("int"))
    k = F.length("node")
    ahead = nodes.where((F.bit_count("succ") == 1) & ~F.col("palindrome")).select(F.col("node").alias("u"), F.concat(F.substring(F.col("node"), F.lit(2), k), only).alias("v"))
    able = nodes.where((F.bit_count("pred") == 1) & ~F.col("palindrome")).select(F.col("node").alias("v"))
    return ahead.join(able, "v", "left_semi").select("u", "v")


def chains(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """(node, head, rank, circle): the chain each node lies on and its place there.

    Pointer jumping: every round each node looks three times as far towards its head, so the rounds
    are the logarithm of the longest chain. Each round is a self-join done twice, checkpointed. A round in which
    no further node reaches a head leaves only circles; these carry the least node they have seen,
    are cut there, and ranked in the same way.
    """
    back = nodes.select("node").join(link.select(F.col("v").alias("node"), F.col("u").alias("anc")), "node", "left")
    return _rank(back, circles_too=True)


def _rank(back: DataFrame, circles_too: bool) -> DataFrame:
    state = cut_large(
        back.select(
            "node",
            F.coalesce("anc", "node").alias("anc"),
            F.when(F.col("anc").isNull(), 0).otherwise(1).cast("bigint").alias("rank"),
            F.col("anc").isNull().alias("done"),
            F.least("node", "anc").alias("low"),
        )
    )
    open_before = state.where(~F.col("done")).count()
    while open_before:
        far = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        moved = state.where(~F.col("done"))
        for _ in range(2):  # what an ancestor that is a head adds is nothing
            moved = moved.join(far, "anc").select("node", F.col("anc2").alias("anc"), (F.col("rank") + F.col("rank2")).alias("rank"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        state = cut_large(state.where("done").unionByName(moved))
        still = state.where(~F.col("done")).count()
        if still == open_before:
            break
        open_before = still
    out = state.where("done").select("node", F.col("anc").alias("head"), "rank", F.lit(not circles_too).alias("circle"))
    if not circles_too or not open_before:
        return out
    rings = _lows(state.where(~F.col("done")).select("node", "anc", "low"))
    prev = back.join(rings, "node").select("node", F.when(F.col("node") != F.col("low"), F.col("anc")).alias("anc"))
    return out.unionByName(_rank(prev, circles_too=False))


def _lows(rings: DataFrame) -> DataFrame:
    """(node, low): least node of the circle each node lies on, by further doubling until nothing changes."""
    while True:
        far = rings.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        grown = cut_large(rings.join(far, "anc").select("node", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        rings = grown.drop("changed")
        if grown.where("changed").isEmpty():
            return rings.select("node", "low")


def unipaths(kmers: DataFrame) -> DataFrame:
    """(edge, seq, n_kmers, circle): every maximal unbranched path, both strands; edge is its first k-mer.

    The letters of one path are gathered to one string, which is the record put out.
    """
    nodes = cut_large(oriented(kmers))
    placed = chains(nodes, links(nodes))
    last = F.substring(F.col("node"), -1, 1)
    return (
        placed.groupBy(F.col("head").alias("edge"), "circle")
        .agg(F.array_sort(F.collect_list(F.struct("rank", last.alias("letter")))).alias("steps"))
        .select("edge", F.concat("edge", F.array_join(F.transform(F.filter("steps", lambda s: s["rank"] > 0), lambda s: s["letter"]), "")).alias("seq"), F.size("steps").alias("n_kmers"), "circle")
    )


def text_unipaths(texts: DataFrame, k: int) -> DataFrame:
    """As ``unipaths`` of all k-mers of texts(seq), which are taken as they stand in a row on one text.

    Each k-mer is left at one of its places. There neighbours that are linked make up a piece of a
    path without any join, so only pieces are chained, of which there are a few for each text. What
    stands at neighbouring places is a piece only where the k-mers are linked, so a place that two
    texts share cuts pieces short and no more. A circle is turned to its least k-mer, as there.
    """
    at = F.col("at")
    line, place, turned = F.shiftright(at, AT_BITS + 1), F.shiftright(at, 1).bitwiseAND(F.lit((1 << AT_BITS) - 1)), at.bitwiseAND(F.lit(1))
    side = lambda back: F.when(turned == (0 if back else 1), -place).otherwise(place)
    lies = lambda back: [(line * 2 + (1 - turned if back else turned)).alias("line"), side(back).alias("place")]
    rev = revcomp(F.col("kmer"))
    fwd = F.struct(F.col("kmer").alias("node"), "pred", "succ", (rev == F.col("kmer")).alias("palindrome"), *lies(False))
    bwd = F.struct(rev.alias("node"), complement_bits(F.col("succ")).alias("pred"), complement_bits(F.col("pred")).alias("succ"), F.lit(False).alias("palindrome"), *lies(True))
    nodes = placed_kmers(texts, k).select(F.inline(F.when(rev == F.col("kmer"), F.array(fwd)).otherwise(F.array(fwd, bwd))))
    only = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.log2(F.col("succ")) + 1).cast("int"))
    on = F.when((F.bit_count("succ") == 1) & ~F.col("palindrome"), F.concat(F.substring("node", 2, k - 1), only))
    able = (F.bit_count("pred") == 1) & ~F.col("palindrome")
    w = Window.partitionBy("line").orderBy("place", "node")
    rows = nodes.select("line", "place", "node", on.alias("on"), able.alias("able"))
    rows = rows.withColumn("fresh", F.when(F.col("able") & (F.lag("on").over(w) == F.col("node")), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = rows.groupBy("line", "run").agg(F.array_sort(F.collect_list(F.struct("place", "node", "able", "on"))).alias("s"))
    last = F.array_join(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), lambda x: F.substring(x["node"], -1, 1)), "")
    pieces = cut_large(steps.select(F.col("s")[0]["node"].alias("node"), F.concat(F.col("s")[0]["node"], last).alias("seq"), F.col("s")[0]["able"].alias("able"), F.element_at("s", -1)["on"].alias("on"), F.size("s").alias("n")))
    link = pieces.where("on is not null").select(F.col("node").alias("u"), F.col("on").alias("v")).join(pieces.where("able").select(F.col("node").alias("v")), "v", "left_semi")
    joined = (
        chains(pieces.select("node"), link).join(pieces.select("node", "seq", "n"), "node").groupBy("head", "circle").agg(F.array_sort(F.collect_list(F.struct("rank", "seq"))).alias("s"), F.sum("n").cast("int").alias("n_kmers"))
    )
    tails = F.transform("s", lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], F.lit(k), F.length(x["seq"]))))
    whole = joined.select("head", F.array_join(tails, "").alias("seq"), "n_kmers", "circle")
    least = F.when(F.col("circle"), F.array_min(kmers_of(F.col("seq"), k))).otherwise(F.col("head"))
    twice = F.concat(F.substring(F.col("seq"), F.lit(1), F.col("n_kmers")), "seq")
    seq = F.when(F.col("circle"), F.substring(twice, F.instr("seq", F.col("edge")), F.length("seq"))).otherwise(F.col("seq"))
    return whole.withColumn("edge", least).select("edge", seq.alias("seq"), "n_kmers", "circle")


def graph_edges(paths: DataFrame, k: int) -> DataFrame:
    """(edge, src, dst, seq, n_kmers, circle, inv): unipaths as edges between their end (k-1)-mers.

    inv is the edge of the reverse complement. A circle is cut at its least k-mer on either strand,
    so its inverse starts at another k-mer than the reverse complement of its last one.
    """
    rows = paths.select(
        "edge", F.substring("seq", 1, k - 1).alias("src"), F.substring("seq", -(k - 1), k - 1).alias("dst"), "seq", "n_kmers", "circle", revcomp(F.substring("seq", -k, k)).alias("opposite")
    )
    straight = rows.where(~F.col("circle")).withColumn("inv", F.col("opposite"))
    round_ = sort_merged(rows.where("circle"))
    on = round_.select(F.col("edge").alias("inv"), F.explode(kmers_of(F.col("seq"), k)).alias("opposite"))
    return straight.unionByName(round_.join(on, "opposite")).drop("opposite")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One of each edge and its inverse: the one whose sequence is not the greater."""
    return edges.where(F.col("edge") <= F.col("inv"))


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """(vertex, n_in, n_out)."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("vertex").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): least node reachable through undirected pairs (a, b).

    Labels are pulled over the pairs and then shortened by pointer jumping, so rounds grow with the
    logarithm of the diameter on paths. Each round is checkpointed.
    """
    both = cut_large(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_large(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        pulled = label.join(near, "node").select("node", "component", F.least("component", "seen").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = cut_large(pulled.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("changed")))
        label = new.drop("changed")
        if new.where("changed").isEmpty():
            return label


def involution_violations(edges: DataFrame) -> DataFrame:
    """(rule, n): how many edges break each invariant; 0 everywhere in a sound graph."""
    inv = edges.select(F.col("edge").alias("inv"), F.col("inv").alias("back"), F.col("seq").alias("inv_seq"), F.col("src").alias("inv_src"), F.col("dst").alias("inv_dst"))
    pairs = edges.join(inv, "inv", "left")
    straight = ~F.col("circle")
    rules = {
        "inverse missing": F.col("back").isNull(),
        "inverse of inverse": F.col("back") != F.col("edge"),
        "sequence": straight & (F.col("inv_seq") != revcomp(F.col("seq"))),
        "ends": straight & ((F.col("inv_src") != revcomp(F.col("dst"))) | (F.col("inv_dst") != revcomp(F.col("src")))),
    }
    counts = pairs.agg(*[F.coalesce(F.count_if(c), F.lit(0)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])))
