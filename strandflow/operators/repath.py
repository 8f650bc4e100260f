"""Paths of reads taken to a graph of larger k, and paths extended where the graph leaves no doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import graph, kmers, placement
from strandflow.session import cut


def path_sequences(paths: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, seq): letters of each path(id, edges); neighbours overlap by k-1."""
    steps = paths.select("id", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", "seq"), "edge")
    joined = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("s"))
    parts = F.transform("s", lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], F.lit(k), F.length(x["seq"]))))
    return joined.select("id", F.array_join(parts, "").alias("seq"))


def places(paths: DataFrame, edges: DataFrame, k: int, k2: int) -> DataFrame:
    """(read_id, id, flipped): for paths of k2 letters or more, the lesser of the path and its inverse as a text."""
    steps = paths.select("read_id", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", "inv", "n_kmers"), "edge")
    both = steps.groupBy("read_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge"))), lambda x: x["edge"]), " ").alias("fw"),
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("pos", "inv")))), lambda x: x["inv"]), " ").alias("bw"),
        F.sum("n_kmers").alias("n"),
    )
    return both.where(F.col("n") + (k - 1) >= k2).select("read_id", F.least("fw", "bw").alias("id"), (F.col("bw") < F.col("fw")).alias("flipped"))


def repath(paths: DataFrame, edges: DataFrame, k: int, k2: int) -> tuple[DataFrame, DataFrame]:
    """(edges of the k2 graph, (read_id, edges)): the distinct places of the paths give the new graph,
    and each read follows its place. Paths shorter than k2 letters have none.
    """
    at = cut(places(paths, edges, k, k2))
    texts = cut(path_sequences(at.select("id", F.split("id", " ").alias("edges")).distinct(), edges, k))
    as_reads = texts.select(F.col("id").alias("read_id"), "seq")
    new = cut(graph.graph_edges(graph.unipaths(kmers.prune_adjacencies(kmers.kmer_table(as_reads, k2))), k2))
    followed = placement.read_paths(placement.place_reads(as_reads, new, k2), new).select(F.col("read_id").alias("id"), "edges")
    moved = at.join(followed, "id").select("read_id", "flipped", F.posexplode("edges").alias("pos", "edge")).join(new.select("edge", "inv"), "edge")
    step = F.when(F.col("flipped"), F.struct((-F.col("pos")).alias("p"), F.col("inv").alias("e"))).otherwise(F.struct(F.col("pos").alias("p"), F.col("edge").alias("e")))
    return new, moved.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["e"]).alias("edges"))


def extend_paths(paths: DataFrame, edges: DataFrame, reads: DataFrame, k: int, min_gain: int = 20) -> DataFrame:
    """(read_id, off, edges): paths carried on to the right until the read ends or no edge is taken.

    An only way on is always taken. Of several, the best is taken if it has no mismatch and the next
    best costs ``min_gain`` or more, by the qualities of the read at its mismatches. Each round adds
    an edge to every path that still grows, and every edge covers a letter of the read at least.
    """
    text = reads.select("read_id", F.col("seq").alias("read"), "qual")
    last = edges.select(F.col("edge").alias("tail"), F.col("dst").alias("src"))
    ahead = edges.select("src", F.col("edge").alias("next"), F.substring(F.col("seq"), F.lit(k), F.length("seq")).alias("more"), F.col("n_kmers").alias("added"))
    sizes = paths.select("read_id", F.explode("edges").alias("edge")).join(edges.select("edge", "n_kmers"), "edge").groupBy("read_id").agg(F.sum("n_kmers").alias("n"))
    # `to`: letters of the read that the path covers
    now = cut(paths.join(sizes, "read_id").join(text, "read_id").select("read_id", "off", "edges", "read", "qual", (F.col("n") + (k - 1) - F.col("off")).cast("int").alias("to")))
    finished = None
    while not now.isEmpty():
        short = now.where(F.col("to") < F.length("read")).withColumn("tail", F.element_at("edges", -1))
        over = F.least(F.length("more"), F.length("read") - F.col("to"))
        wrong = F.filter(F.sequence(F.lit(1), over), lambda i: F.substring("more", i, F.lit(1)) != F.substring("read", F.col("to") + i, F.lit(1)))
        cost = F.aggregate(wrong, F.lit(0), lambda s, i: s + F.coalesce(F.get("qual", F.col("to") + i - 1), F.lit(0)))
        tried = short.join(last, "tail").join(ahead, "src").withColumn("cost", cost)
        best = tried.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("cost", "next", "added"))).alias("c"))
        take = (F.size("c") == 1) | ((F.col("c")[0]["cost"] == 0) & (F.get(F.col("c"), 1)["cost"] >= min_gain))
        picked = best.where(take).select("read_id", F.col("c")[0].alias("c"))
        grown = now.join(picked, "read_id").select("read_id", "off", F.concat("edges", F.array("c.next")).alias("edges"), "read", "qual", (F.col("to") + F.col("c.added")).cast("int").alias("to"))
        still = now.join(picked, "read_id", "left_anti").select("read_id", "off", "edges")
        finished = still if finished is None else finished.unionByName(still)
        now = cut(grown)
        finished = cut(finished)
    return now.select("read_id", "off", "edges") if finished is None else finished
