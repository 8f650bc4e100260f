"""What reads say about branches, bubbles and repeats, and the graph after it is rewritten by that.

``edges`` has edge, src, dst, seq, n_kmers and inv; ``paths`` has read_id, off and edges, ``off`` being
where the read starts on its first edge. Neighbouring edges overlap by k-1 letters. Whatever is
done to an edge is done to its inverse in the same table, so the involution holds after each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.dna import revcomp
from strandflow.operators.graph import vertex_degrees
from strandflow.operators.repath import path_sequences
from strandflow.session import cut_large, sort_merged


def mismatch_cost(read: Column, qual: Column, text: Column, at: Column) -> Column:
    """Sum of the read's qualities where it differs from a text that begins at letter ``at`` of the read (may
    be negative). Read and text are arrays of letters, as a letter of a string is found by counting.
    """
    low, high = F.greatest(at, F.lit(0)), F.least(F.size(read), at + F.size(text))
    wrong = F.filter(F.sequence(low, F.greatest(high - 1, low)), lambda i: F.get(read, i) != F.get(text, i - at))
    return F.when(high > low, F.aggregate(wrong, F.lit(0), lambda s, i: s + F.coalesce(F.get(qual, i), F.lit(0)))).otherwise(F.lit(0))


def both_strands(paths: DataFrame, edges: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(read_id, turned, off, edges, seq, qual): each placed read as it is, and its reverse complement on the inverse edges."""
    steps = paths.select("read_id", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", "inv", "n_kmers"), "edge")
    sums = steps.groupBy("read_id").agg(F.sum("n_kmers").alias("n"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("pos", "inv")))), lambda x: x["inv"]).alias("back"))
    rows = paths.select("read_id", "off", "edges").join(sums, "read_id").join(reads.select("read_id", "seq", "qual"), "read_id")
    fw = rows.select("read_id", F.lit(False).alias("turned"), "off", "edges", "seq", "qual")
    off = (F.col("n") + (k - 1) - F.col("off") - F.length("seq")).cast("int")
    return fw.unionByName(rows.select("read_id", F.lit(True).alias("turned"), off.alias("off"), F.col("back").alias("edges"), revcomp(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")))


def step_starts(strands: DataFrame, edges: DataFrame) -> DataFrame:
    """(read_id, turned, step, edge, src, dst, n_kmers, at): at which letter of the read each edge of its path begins."""
    steps = strands.select("read_id", "turned", "off", F.posexplode("edges").alias("step", "edge")).join(edges.select("edge", "src", "dst", "n_kmers"), "edge")
    ahead = Window.partitionBy("read_id", "turned").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.coalesce(F.sum("n_kmers").over(ahead), F.lit(0)) - F.col("off")).cast("int")
    return steps.select("read_id", "turned", "step", "edge", "src", "dst", "n_kmers", at.alias("at"))


def layout(paths: DataFrame, edges: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(edge, at, turned, read_id): reads on their first edge, and turned on the inverse of their last, by where they start there."""
    return both_strands(paths, edges, reads, k).select(F.col("edges")[0].alias("edge"), F.col("off").alias("at"), "turned", "read_id")


def path_violations(paths: DataFrame, edges: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(rule, n): paths whose edges do not adjoin, lie on no edge, or do not meet the read; 0 everywhere in a sound set."""
    w = Window.partitionBy("read_id").orderBy("step")
    steps = paths.select("read_id", F.posexplode("edges").alias("step", "edge")).join(edges.select("edge", "src", "dst", F.length("seq").alias("size")), "edge", "left")
    torn = steps.withColumn("from", F.lag("dst").over(w)).select("read_id", (F.col("from").isNotNull() & (F.col("from") != F.col("src"))).alias("torn"), F.col("src").isNull().alias("lost"))
    first = paths.select("read_id", "off", F.col("edges")[0].alias("edge")).join(edges.select("edge", F.length("seq").alias("size")), "edge").join(reads.select("read_id", F.length("seq").alias("n")), "read_id")
    off = first.agg(F.count_if((F.col("off") >= F.col("size")) | (F.col("off") + F.col("n") <= 0)).alias("n")).select(F.lit("offset").alias("rule"), "n")
    sums = torn.agg(F.count_if("torn").alias("t"), F.count_if("lost").alias("l"))
    return sums.select(F.inline(F.array(F.struct(F.lit("adjacency").alias("rule"), F.col("t").alias("n")), F.struct(F.lit("missing edge").alias("rule"), F.col("l").alias("n"))))).unionByName(off)


def path_fragments(paths: DataFrame, edges: DataFrame, least: int = 10_000, limit: int = 1000, width: int = 10) -> DataFrame:
    """(bin_center, n, mass): lengths of fragments both of whose mates begin on one edge of ``least`` letters
    or more, the second through the inverse.
    """
    size = edges.where(F.length("seq") >= least).select("edge", "inv", F.length("seq").alias("size"))
    first = paths.select(F.shiftright("read_id", 1).alias("pair"), F.col("read_id").bitwiseAND(F.lit(1)).alias("mate"), "off", F.col("edges")[0].alias("edge"))
    one = first.where("mate = 0").join(size, "edge").select("pair", "edge", F.col("off").alias("a"))
    two = first.where("mate = 1").join(size, "edge").select("pair", F.col("inv").alias("edge"), (F.col("size") - F.col("off")).alias("b"))
    frags = sort_merged(one).join(two, ["pair", "edge"]).select((F.col("b") - F.col("a")).alias("len")).where((F.col("len") >= 0) & (F.col("len") < limit))
    counted = frags.groupBy((F.floor(F.col("len") / width) * width + width / 2).alias("bin_center")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("bin_center", "n", F.round(F.col("n") / F.col("total"), 6).alias("mass"))


def branch_extensions(edges: DataFrame, k: int, depth: int = 250, most: int = 10) -> DataFrame:
    """(vertex, branch, text): ways out of each vertex that has an edge in and several out, ``depth`` k-mers far.

    Where a way ends earlier, all of its vertex are cut to the shortest of those. Vertices with more
    than ``most`` ways have none, as the rule says.
    """
    forks = vertex_degrees(edges).where("n_in >= 1 and n_out >= 2").select(F.col("vertex").alias("src"))
    ahead = edges.select(F.col("src").alias("end"), "seq", F.col("n_kmers").alias("more"), F.col("dst").alias("to"))
    live = cut_large(edges.join(forks, "src", "left_semi").select(F.col("src").alias("vertex"), F.col("edge").alias("branch"), F.col("dst").alias("end"), F.col("n_kmers").cast("bigint").alias("n"), F.col("seq").alias("text"), F.lit(False).alias("dead")))
    while not live.where((F.col("n") < depth) & ~F.col("dead")).isEmpty():
        open_ = (F.col("n") < depth) & ~F.col("dead")
        letters = F.concat("text", F.substring(F.col("seq"), F.lit(k), F.length("seq")))
        grown = live.where(open_).join(ahead, "end", "left").select(
            "vertex", "branch", F.coalesce("to", "end").alias("end"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce(letters, F.col("text")).alias("text"), F.col("to").isNull().alias("dead")
        )
        both = live.where(~open_).unionByName(grown)
        live = cut_large(both.withColumn("ways", F.count(F.lit(1)).over(Window.partitionBy("vertex"))).where(F.col("ways") <= most).drop("ways"))
    reach = live.withColumn("depth", F.least(F.lit(depth), F.min(F.when(F.col("dead"), F.col("n"))).over(Window.partitionBy("vertex"))))
    return reach.select("vertex", "branch", F.substring(F.col("text"), F.lit(1), (F.col("depth") + (k - 1)).cast("int")).alias("text")).distinct()


def branch_votes(edges: DataFrame, paths: DataFrame, reads: DataFrame, k: int, depth: int = 250, most: int = 10) -> DataFrame:
    """(vertex, branch, score): for each read at a fork, on either strand, the branch it differs least from
    and by how much less than from the next one; reads that do not decide have no vote.
    """
    strands = cut_large(both_strands(paths, edges, reads, k).withColumn("letters", F.split("seq", "")))
    starts = cut_large(step_starts(strands, edges))
    at = starts.select("read_id", "turned", F.col("src").alias("vertex"), "at").unionByName(starts.select("read_id", "turned", F.col("dst").alias("vertex"), (F.col("at") + F.col("n_kmers")).cast("int").alias("at"))).distinct()
    ways = cut_large(branch_extensions(edges, k, depth, most).select("vertex", "branch", F.split("text", "").alias("way")))
    met = at.join(ways, "vertex").join(strands.select("read_id", "turned", "letters", "qual"), ["read_id", "turned"])
    cost = met.select("vertex", "branch", "read_id", "turned", "at", mismatch_cost(F.col("letters"), F.col("qual"), F.col("way"), F.col("at")).alias("cost"))
    least = cost.groupBy("vertex", "read_id", "turned", "at", "branch").agg(F.min("cost").alias("cost"))
    best = least.groupBy("vertex", "read_id", "turned", "at").agg(F.array_sort(F.collect_list(F.struct("cost", "branch"))).alias("c"))
    return cut_large(best.select("vertex", F.col("c")[0]["branch"].alias("branch"), (F.get(F.col("c"), 1)["cost"] - F.col("c")[0]["cost"]).alias("score")).where("score > 0"))


def flanked_bubbles(edges: DataFrame) -> DataFrame:
    """(src, dst, e1, e2): two edges side by side, one edge in before them and one out behind that leads elsewhere."""
    deg = cut_large(vertex_degrees(edges))
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2")).where("n = 2").drop("n")
    left = deg.where("n_in = 1 and n_out = 2").select(F.col("vertex").alias("src"))
    right = deg.where("n_out = 1").select(F.col("vertex").alias("dst"))
    own = edges.where("src = dst").select(F.col("src").alias("dst"))
    return cut_large(pairs.join(left, "src", "left_semi").join(right, "dst", "left_semi").join(own, "dst", "left_anti").select("src", "dst", "e1", "e2"))


def bubble_weights(bubbles: DataFrame, edges: DataFrame, paths: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(edge, weight): reads expected on each arm. A read on an arm is laid along its path and along the
    same path over the other arm; by the difference q of the two it is on the better one with
    probability 1 - 10^(-q/10), one half at least, and on the other with the rest.
    """
    arms = bubbles.select(F.col("e1").alias("edge"), F.col("e2").alias("alt")).unionByName(bubbles.select(F.col("e2").alias("edge"), F.col("e1").alias("alt")))
    size = edges.select("edge", "n_kmers")
    arms = arms.join(size, "edge").join(size.select(F.col("edge").alias("alt"), F.col("n_kmers").alias("alt_kmers")), "alt")
    on = paths.select("read_id", "off", "edges", F.posexplode("edges").alias("step", "edge")).join(arms, "edge")
    id_ = lambda side: F.concat_ws(":", F.col("read_id").cast("string"), F.col("step").cast("string"), F.lit(side))
    other = F.transform("edges", lambda x, i: F.when(i == F.col("step"), F.col("alt")).otherwise(x))
    shift = F.when(F.col("step") == 0, F.col("off") + F.col("alt_kmers") - F.col("n_kmers")).otherwise(F.col("off")).cast("int")
    rows = cut_large(on.select("read_id", "step", "edge", "alt", id_("own").alias("own"), id_("alt").alias("via"), "edges", other.alias("others"), F.col("off").cast("int").alias("off"), shift.alias("alt_off")))
    texts = cut_large(path_sequences(rows.select(F.col("own").alias("id"), "edges").unionByName(rows.select(F.col("via").alias("id"), F.col("others").alias("edges"))), edges, k).select("id", F.split("seq", "").alias("seq")))
    laid = rows.join(texts.select(F.col("id").alias("own"), F.col("seq").alias("t1")), "own").join(texts.select(F.col("id").alias("via"), F.col("seq").alias("t2")), "via").join(reads.select("read_id", F.split("seq", "").alias("seq"), "qual"), "read_id")
    costs = laid.select("edge", "alt", mismatch_cost(F.col("seq"), F.col("qual"), F.col("t1"), -F.col("off")).alias("q"), mismatch_cost(F.col("seq"), F.col("qual"), F.col("t2"), -F.col("alt_off")).alias("q_alt"))
    p = F.greatest(F.lit(0.5), 1 - F.pow(F.lit(10.0), -F.abs(F.col("q") - F.col("q_alt")) / 10))
    worse = F.col("q") > F.col("q_alt")
    parts = costs.select(F.inline(F.array(F.struct(F.when(worse, F.col("alt")).otherwise(F.col("edge")).alias("edge"), p.alias("w")), F.struct(F.when(worse, F.col("edge")).otherwise(F.col("alt")).alias("edge"), (1 - p).alias("w")))))
    return cut_large(parts.groupBy("edge").agg(F.sum("w").alias("weight")))


def pair_edges(paths: DataFrame, edges: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(pair, turned, edge): the edges of both mates of a pair as one strand sees them, and as the other does."""
    strands = both_strands(paths, edges, reads, k)
    mate = F.col("read_id").bitwiseAND(F.lit(1)) == 1
    return strands.select(F.shiftright("read_id", 1).alias("pair"), (F.col("turned") != mate).alias("turned"), F.explode("edges").alias("edge")).distinct()


def repeat_scores(repeats: DataFrame, seen: DataFrame) -> DataFrame:
    """(repeat, s11, s12, s21, s22): pairs that hold way in i and way out j of a repeat. seen: as ``pair_edges`` gives it."""
    ends = repeats.select("repeat", F.inline(F.array(*[F.struct(F.col(c).alias("edge"), F.lit(c).alias("as")) for c in ("in1", "in2", "out1", "out2")])))
    flags = ends.join(seen, "edge").groupBy("repeat", "pair", "turned").agg(*[F.max(F.col("as") == c).alias(c) for c in ("in1", "in2", "out1", "out2")])
    counts = flags.groupBy("repeat").agg(*[F.count_if(F.col(f"in{i}") & F.col(f"out{j}")).alias(f"s{i}{j}") for i in (1, 2) for j in (1, 2)])
    return cut_large(repeats.select("repeat").join(counts, "repeat", "left").na.fill(0))


def repeat_copies(repeats: DataFrame, decided: DataFrame, edges: DataFrame) -> DataFrame:
    """(repeat, came, goes, copy, inv): the two copies of each repeat that is pulled apart, named by what they join."""
    both = repeats.join(decided, "repeat").select("repeat", F.inline(F.array(F.struct(F.col("in1").alias("came"), F.when(F.col("straight"), F.col("out1")).otherwise(F.col("out2")).alias("goes")), F.struct(F.col("in2").alias("came"), F.when(F.col("straight"), F.col("out2")).otherwise(F.col("out1")).alias("goes")))))
    inv = edges.select("edge", "inv")
    for c in ("repeat", "came", "goes"):
        both = both.join(inv.select(F.col("edge").alias(c), F.col("inv").alias(f"i_{c}")), c)
    return cut_large(both.select("repeat", "came", "goes", F.concat_ws("|", "repeat", "came", "goes").alias("copy"), F.concat_ws("|", "i_repeat", "i_goes", "i_came").alias("inv")))


def pulled_apart(edges: DataFrame, copies: DataFrame) -> DataFrame:
    """edges with each repeat replaced by its copies, one between each way in and its way out."""
    own = cut_large(edges.select(F.col("edge").alias("repeat"), "src", "dst", "seq", "n_kmers").join(copies, "repeat"))
    name = lambda end: F.concat_ws("|", F.col(end), F.col("copy"))
    new = own.select(F.col("copy").alias("edge"), name("src").alias("src"), name("dst").alias("dst"), "seq", "n_kmers", "inv")
    into = own.select(F.col("came").alias("edge"), name("src").alias("new_dst"))
    onto = own.select(F.col("goes").alias("edge"), name("dst").alias("new_src"))
    rest = edges.join(copies.select(F.col("repeat").alias("edge")), "edge", "left_anti").join(into, "edge", "left").join(onto, "edge", "left")
    return rest.select("edge", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "seq", "n_kmers", "inv").unionByName(new)


def paths_through_copies(paths: DataFrame, copies: DataFrame) -> DataFrame:
    """paths on the copies: a step on a repeat goes to the copy that its neighbours in the path name, the
    first by name where they name none; a path whose neighbours name two copies is cut before that step.
    """
    w = Window.partitionBy("read_id").orderBy("step")
    steps = paths.select("read_id", "off", F.posexplode("edges").alias("step", "edge")).withColumn("prev", F.lag("edge").over(w)).withColumn("next", F.lead("edge").over(w))
    found = copies.select(F.col("repeat").alias("edge"), "came", "goes", "copy")
    tried = steps.join(found, "edge", "left").withColumn("no", F.col("copy").isNotNull() & ((F.coalesce(F.col("prev") != F.col("came"), F.lit(False))) | F.coalesce(F.col("next") != F.col("goes"), F.lit(False))))
    best = tried.groupBy("read_id", "off", "step", "edge").agg(F.min(F.when(~F.col("no"), F.col("copy"))).alias("copy"), F.max(F.col("copy").isNotNull()).alias("split"))
    torn = best.withColumn("torn", F.max(F.when(F.col("split") & F.col("copy").isNull(), 1).otherwise(0)).over(w)).where("torn = 0")
    return torn.groupBy("read_id", "off").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", F.coalesce("copy", "edge").alias("e")))), lambda s: s["e"]).alias("edges"))


def unrolled(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """edges with each loop of loops(prev, repeat, loop, next) run once: prev, repeat, loop, repeat again, next.

    The second run is a new edge, the repeat's name with ' behind it. Seen from the other strand the
    runs change places, so the first run's inverse is the second run of the inverse.
    """
    again = lambda c: F.concat(F.col(c), F.lit("'"))
    own = cut_large(edges.join(loops.select(F.col("repeat").alias("edge"), "loop", "next"), "edge"))
    second = own.select(again("edge").alias("edge"), again("src").alias("src"), again("dst").alias("dst"), "seq", "n_kmers", "inv")
    back = own.select(F.col("loop").alias("edge"), again("src").alias("new_dst"))
    out = own.select(F.col("next").alias("edge"), again("dst").alias("new_src"))
    first = own.select("edge", again("inv").alias("new_inv"))
    rest = edges.join(back, "edge", "left").join(out, "edge", "left").join(first, "edge", "left")
    return rest.select("edge", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "seq", "n_kmers", F.coalesce("new_inv", "inv").alias("inv")).unionByName(second)


def merged_edges(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(edges, moves): chains of edges through vertices of one way in and one out as one edge each, and
    (old, edge, offset) of every old edge. Gap edges, which have no letters, stay apart.
    """
    from strandflow.operators.cleaning import merge_chains

    moves = cut_large(merge_chains(edges, k))
    parts = moves.join(edges.select(F.col("edge").alias("old"), "src", "dst", "seq", "n_kmers", F.col("inv").alias("old_inv")), "old")
    w = F.struct("offset", "n_kmers")
    joined = parts.groupBy("edge").agg(
        F.min_by("src", w).alias("src"), F.max_by("dst", w).alias("dst"), F.array_sort(F.collect_list(F.struct("offset", "seq"))).alias("s"), F.sum("n_kmers").alias("n_kmers"), F.max_by("old_inv", w).alias("last_inv")
    )
    text = F.array_join(F.transform("s", lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], F.lit(k), F.length(x["seq"])))), "")
    of = moves.select(F.col("old").alias("last_inv"), F.col("edge").alias("inv"))
    return joined.join(of, "last_inv").select("edge", "src", "dst", text.alias("seq"), "n_kmers", "inv"), moves


def merged_paths(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """paths(read_id, off, edges) on merged edges; those cut at the first edge that is gone."""
    w = Window.partitionBy("read_id").orderBy("step")
    steps = paths.select("read_id", "off", F.posexplode("edges").alias("step", "old")).join(moves, "old", "left")
    kept = steps.withColumn("gone", F.max(F.col("edge").isNull().cast("int")).over(w)).where("gone = 0").withColumn("prev", F.lag("edge").over(w)).withColumn("before", F.lag("offset").over(w))
    # the same merged edge goes on; on a circle it starts anew where the offset falls back
    fresh = kept.where((F.col("step") == 0) | (F.col("prev") != F.col("edge")) | (F.col("offset") <= F.col("before")))
    first = F.min_by(F.col("off") + F.col("offset"), "step").cast("int")
    return fresh.groupBy("read_id").agg(first.alias("off"), F.transform(F.array_sort(F.collect_list(F.struct("step", "edge"))), lambda s: s["edge"]).alias("edges"))


def plasmids_unwound(edges: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """edges with each pattern(e1, e2, back) replaced by one loop e1, back, e2, back at its first vertex."""
    seq = edges.select("edge", "src", "seq", "n_kmers", "inv")
    rows = patterns
    for c in ("e1", "e2", "back"):
        rows = rows.join(seq.select(F.col("edge").alias(c), F.col("src").alias(f"v_{c}"), F.col("seq").alias(f"s_{c}"), F.col("n_kmers").alias(f"n_{c}"), F.col("inv").alias(f"i_{c}")), c)
    tail = lambda c: F.substring(F.col(c), F.lit(k), F.length(c))
    name = lambda p, a, b, c: F.concat(F.lit("loop:"), F.least(F.col(a), F.col(b)), F.lit(":"), F.col(c))
    loop = rows.select(
        name("", "e1", "e2", "back").alias("edge"), F.col("v_e1").alias("src"), F.col("v_e1").alias("dst"), F.concat("s_e1", tail("s_back"), tail("s_e2"), tail("s_back")).alias("seq"),
        (F.col("n_e1") + F.col("n_e2") + 2 * F.col("n_back")).alias("n_kmers"), name("", "i_e1", "i_e2", "i_back").alias("inv"),
    )
    gone = patterns.select(F.explode(F.array("e1", "e2", "back")).alias("edge"))
    return edges.select("edge", "src", "dst", "seq", "n_kmers", "inv").join(gone, "edge", "left_anti").unionByName(loop)


def lone_edges(edges: DataFrame, most: int) -> DataFrame:
    """(edge) of at most ``most`` k-mers that touches no other edge."""
    deg = vertex_degrees(edges)
    a, b = deg.select(F.col("vertex").alias("src"), F.col("n_in").alias("i"), F.col("n_out").alias("o")), deg.select(F.col("vertex").alias("dst"), F.col("n_in").alias("i2"), F.col("n_out").alias("o2"))
    return edges.where((F.col("src") != F.col("dst")) & (F.col("n_kmers") <= most)).join(a, "src").join(b, "dst").where("i = 0 and o = 1 and i2 = 1 and o2 = 0").select("edge")


def weak_branches(edges: DataFrame, coverage: DataFrame, most: float = 2.0, ratio: float = 5.0) -> DataFrame:
    """(edge) to delete: coverage of ``most`` or less beside a branch of the same vertex with ``ratio`` times it or more, on either side."""
    rows = cut_large(edges.select("edge", "src", "dst").join(coverage, "edge", "left").withColumn("c", F.coalesce("cov", F.lit(0.0))))
    out = None
    for side in ("src", "dst"):
        top = rows.withColumn("top", F.max("c").over(Window.partitionBy(side)))
        weak = top.where((F.col("c") <= most) & (F.col("top") > 0) & (F.col("top") >= ratio * F.col("c"))).select("edge")
        out = weak if out is None else out.unionByName(weak)
    return cut_large(out.distinct())
