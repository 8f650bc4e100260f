"""Column expressions over sequences of A C G T N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; N and any other letter stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def canonical_form(kmer: Column) -> Column:
    """FWD, REV or PALINDROME."""
    rc = revcomp(kmer)
    return F.when(kmer < rc, "FWD").when(kmer > rc, "REV").otherwise("PALINDROME")


def reverse_byte(bits: Column) -> Column:
    """The eight low bits in reversed order: bit i of the result is bit 7-i."""
    out = F.lit(0)
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(bits, i).bitwiseAND(F.lit(1)), 7 - i))
    return out


def kmers_of(seq: Column, k: int) -> Column:
    """Array of the k-mers of a sequence, in order; empty where it is shorter than k."""
    n = F.length(seq) - (k - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k))))


def gc_count(seq: Column) -> Column:
    """Letters G and C."""
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def trim_cat(left: Column, right: Column, overlap: int) -> Column:
    """Concatenation of two sequences whose ends overlap by ``overlap`` letters."""
    return F.concat(left, F.substring(right, F.lit(overlap + 1), F.greatest(F.length(right) - overlap, F.lit(0))))


def counted_kmer_nodes(nodes: DataFrame, k: int = 24) -> DataFrame:
    """The entries of kmer_nodes that count: (node_id, batch_id, kmer, kc, n), canonical, once each.

    An entry counts if kc is not null and kmer is k letters ACGT in either case. n null or below 1
    counts as 1. Redelivered entries (same node_id) count once; entries without a node_id are each
    counted, save exact repeats.
    """
    usable = nodes.where(F.col("kc").isNotNull() & F.col("kmer").rlike(rf"^[ACGTacgt]{{{k}}}\z")).select(
        "node_id",
        "batch_id",
        F.upper("kmer").alias("fwd"),
        F.col("kc").bitwiseAND(F.lit(255)).alias("kc"),
        F.greatest(F.coalesce(F.col("n"), F.lit(1)), F.lit(1)).alias("n"),
    )
    turned = usable.withColumn("rev", revcomp(F.col("fwd"))).select(
        "node_id",
        "batch_id",
        F.least("fwd", "rev").alias("kmer"),
        F.when(F.col("rev") < F.col("fwd"), reverse_byte(F.col("kc"))).otherwise(F.col("kc")).cast("int").alias("kc"),
        "n",
    )
    return turned.distinct()
