"""The staged pipeline: reads in, graph, placement, lines and statistics out, resumable at any stage.

Every stage is a function of DataFrames and writes parquet below one folder, which stands for the
intermediate files; a later run may begin at any stage whose inputs lie there. Writing also cuts
the lineage, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import cleaning, evidence, graph, kmers, lines, placement, repath, stats
from strandflow.sources import sinks


@dataclass(frozen=True)
class Settings:
    """Thresholds of the stages."""

    k: int = 60
    k2: int = 200
    min_qual: int = 7
    min_freq: int = 4
    max_hang: int = 100
    hang_ratio: int = 10
    min_component: int = 200
    max_component_edge: int = 1000
    min_links: int = 3
    path_qual: int = 30
    min_line: int = 1000


@dataclass
class Pipeline:
    """Runs stages 1 to 7; ``out`` is a folder that all executors share."""

    spark: SparkSession
    out: str
    settings: Settings = field(default_factory=Settings)
    times: list[tuple[str, float]] = field(default_factory=list)

    STAGES = ("reads", "graph", "places", "clean", "lines", "links", "final")

    def _path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def load(self, name: str) -> DataFrame:
        """A table that an earlier stage wrote."""
        return self.spark.read.parquet(self._path(name))

    def _save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name))

    def run(self, oreads: DataFrame | None = None, from_stage: int = 1, to_stage: int = 7) -> None:
        """Runs stages from_stage..to_stage; stage 1 needs ``oreads`` (read_id, seq, qual, sample)."""
        if not 1 <= from_stage <= to_stage <= len(self.STAGES):
            raise ValueError("stages run from 1 to 7")
        if from_stage == 1 and oreads is None:
            raise ValueError("stage 1 needs reads")
        for number in range(from_stage, to_stage + 1):
            name, began = self.STAGES[number - 1], time.time()
            getattr(self, f"_{name}")(oreads) if name == "reads" else getattr(self, f"_{name}")()
            self.times.append((name, time.time() - began))

    def _reads(self, oreads: DataFrame) -> None:
        self._save("reads", kmers.clean_reads(oreads))

    def _graph(self) -> None:
        s = self.settings
        table = kmers.kmer_table(self.load("reads"), s.k, s.min_qual, s.min_freq)
        self._save("kmers", kmers.prune_adjacencies(table))
        self._save("edges", graph.graph_edges(graph.unipaths(self.load("kmers")), s.k))

    def _places(self) -> None:
        edges = self.load("edges").where("not circle")
        self._save("parts", placement.place_reads(self.load("reads"), edges, self.settings.k))
        self._save("paths", placement.read_paths(self.load("parts"), edges))
        # all later stages stand on the graph of the larger k; paths of fewer letters than that end here
        larger, moved = repath.repath(self.load("paths"), edges, self.settings.k, self.settings.k2)
        self._save("edges_k2", larger)
        self._save("paths_k2", moved)

    def _clean(self) -> None:
        s = self.settings
        edges = self.load("edges_k2").where("not circle")
        steps = placement.path_steps(self.load("paths_k2"))
        edges = cleaning.delete_edges(edges, cleaning.unsupported_branches(edges, placement.edge_support(steps, edges)))
        self._save("clean_supported", edges)
        edges = self.load("clean_supported")
        edges = cleaning.delete_edges(edges, self._popped(edges))
        self._save("clean_popped", edges)
        edges = self.load("clean_popped")
        edges = cleaning.delete_edges(edges, cleaning.hanging_ends(edges, s.max_hang, s.hang_ratio))
        self._save("clean_unhung", edges)
        edges = self.load("clean_unhung")
        edges = cleaning.delete_edges(edges, cleaning.small_components(edges, s.max_component_edge, s.min_component))
        self._save("clean_edges", edges)

    def _popped(self, edges: DataFrame) -> DataFrame:
        """(edge): arms of bubbles that reads speak against; the repathed reads begin at the start of their path."""
        paths = self.load("paths_k2").withColumn("off", F.lit(0))
        bubbles = evidence.flanked_bubbles(edges)
        texts = repath.path_sequences(paths.select(F.col("read_id").alias("id"), "edges"), self.load("edges_k2"), self.settings.k2)
        reads = texts.select(F.col("id").alias("read_id"), "seq", F.array_repeat(F.lit(self.settings.path_qual), F.length("seq")).alias("qual"))
        return cleaning.popped_bubbles(bubbles, edges, evidence.bubble_weights(bubbles, edges, paths, reads, self.settings.k2))

    def _lines(self) -> None:
        edges = self.load("clean_edges")
        self._save("cells", lines.find_cells(edges))
        self._save("lines", lines.find_lines(edges, self.load("cells")))
        steps = placement.path_steps(self.load("paths_k2"))
        sizes = lines.line_lengths(self.load("lines"), edges).join(lines.line_pairs(self.load("lines"), edges, steps), "line", "left")
        self._save("line_stats", sizes.select("line", "len", F.coalesce("npairs", F.lit(0)).alias("npairs"), F.round(F.coalesce("npairs", F.lit(0)) / F.col("len"), 6).alias("cov")))

    def _links(self) -> None:
        of = self.load("lines").select("edge", "line").distinct()
        steps = placement.path_steps(self.load("paths_k2")).join(of, "edge").select("read_id", "line").distinct()
        self._save("line_links", placement.pair_links(steps, "line", "read_id"))
        self._save("links_accepted", placement.accepted_links(self.load("line_links"), self.settings.min_links))

    def _final(self) -> None:
        edges = self.load("clean_edges")
        support = placement.edge_support(placement.path_steps(self.load("paths_k2")), edges)
        one = lines.one_of_two(self.load("lines"), edges)
        seqs = lines.line_sequences(self.load("lines").join(one, "line", "left_semi"), edges, support, self.settings.k2)
        sinks.fasta_lines(seqs, "line", "seq").write.mode("overwrite").text(self._path("lines.fasta"))
        sinks.gfa_segments(edges).unionByName(sinks.gfa_links(edges)).write.mode("overwrite").text(self._path("graph.gfa"))
        sinks.histogram_lines(kmers.histogram(self.load("kmers"))).write.mode("overwrite").text(self._path("kmers.freqs"))
        sizes = self.load("line_stats").withColumn("bases", F.col("len") + self.settings.k2 - 1)
        self._save("n50", stats.n50(sizes.where(F.col("len") >= self.settings.min_line), "bases"))
        # each line stands there twice, once for each strand
        totals = [F.floor(F.coalesce(F.sum(F.when(F.col("len") >= n, F.col("bases"))), F.lit(0)) / 2).alias(f"total_{n}") for n in (1_000, 10_000, 100_000)]
        self._save("totals", sizes.agg(*totals))
        self.spark.createDataFrame([(n, float(t)) for n, t in self.times] or [("final", 0.0)], "section string, wall double").write.mode("overwrite").parquet(self._path("times"))
