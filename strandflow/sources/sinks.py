"""Text forms of graphs, lines and variants, one row per line of the file; write with ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: letters of an uncaptured gap in a sequence of lines.
GAP = "N" * 100


def gfa_header() -> str:
    return "H\tVN:Z:1.0"


def gfa_segments(edges: DataFrame, colour: str | None = None) -> DataFrame:
    """(line): one S line per edge that is not after its inverse."""
    tag = [F.concat(F.lit("CL:z:"), F.col(colour))] if colour else []
    return edges.where("edge <= inv").select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("edge"), F.col("edge")), "seq", *tag).alias("line"))


def gfa_links(edges: DataFrame) -> DataFrame:
    """(line): one L line for each adjacency of edges, given once for it and its inverse."""
    a = edges.select(F.col("edge").alias("e1"), F.col("inv").alias("i1"), F.col("dst").alias("v"))
    b = edges.select(F.col("edge").alias("e2"), F.col("inv").alias("i2"), F.col("src").alias("v"))
    pairs = a.join(b, "v")
    # the inverse adjacency runs from i2 to i1; the lesser of the two is kept
    kept = pairs.where((F.col("e1") < F.col("i2")) | ((F.col("e1") == F.col("i2")) & (F.col("e2") <= F.col("i1"))))
    name = lambda e, i: F.concat(F.lit("edge"), F.least(e, i))
    sign = lambda e, i: F.when(F.col(e) <= F.col(i), "+").otherwise("-")
    return kept.select(F.concat_ws("\t", F.lit("L"), name("e1", "i1"), sign("e1", "i1"), name("e2", "i2"), sign("e2", "i2"), F.lit("0M")).alias("line"))


def fasta_lines(records: DataFrame, name: str, seq: str, width: int = 80) -> DataFrame:
    """(line): heading and sequence of each record as one text with line breaks."""
    n = F.greatest(F.ceil(F.length(seq) / width), F.lit(1)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(seq), i * width + 1, F.lit(width)))
    return records.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.array_join(rows, "\n")).alias("line"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): edges in the graph language of DOT, without its frame."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "edge").alias("line"))


def histogram_lines(hist: DataFrame, cap: int = 100) -> DataFrame:
    """(line) ``i, count`` for i from 1 to cap, absent ones as 0."""
    spark = hist.sparkSession
    every = spark.range(1, cap + 1).select(F.col("id").alias("n"))
    return every.join(hist, "n", "left").select(F.concat_ws(", ", F.col("n").cast("string"), F.coalesce("kmers", F.lit(0)).cast("string")).alias("line"))


def distribution_lines(dist: DataFrame) -> DataFrame:
    """(line) ``bin_center mass`` of a fragment distribution."""
    return dist.select(F.concat_ws(" ", F.col("bin_center").cast("string"), F.col("mass").cast("string")).alias("line"))


def vcf_lines(variants: DataFrame) -> DataFrame:
    """(line) of variants(chrom, pos, id, ref, alts, qual, filter, info as a list): tab-separated, . for none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return variants.select(F.concat_ws("\t", text("chrom"), text("pos"), text("id"), text("ref"), F.array_join("alts", ","), text("qual"), text("filter"), F.array_join("info", ";")).alias("line"))


def efasta(variant_sites: DataFrame, ref: str, alts: str) -> DataFrame:
    """Adds ``bubble``: {ref,alt1,alt2...} in the notation of bubble FASTA."""
    return variant_sites.withColumn("bubble", F.concat(F.lit("{"), F.array_join(F.concat(F.array(F.col(ref)), F.col(alts)), ","), F.lit("}")))
