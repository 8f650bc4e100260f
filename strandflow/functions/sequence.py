"""Column expressions that measure or search a sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(seq: Column, word: Column) -> Column:
    """Places (from 0) at which a word stands in a sequence, overlapping ones too; empty where there is none."""
    n, m = F.length(seq), F.length(word)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.substring(seq, i + 1, m) == word)
    return F.when((m > 0) & (n >= m), places).otherwise(F.array().cast("array<int>"))


def longest_overlap(left: Column, right: Column) -> Column:
    """Greatest length, up to that of the shorter, at which the end of ``left`` is the beginning of ``right``; 0 if none."""
    n = F.least(F.length(left), F.length(right))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(left, F.length(left) - i + 1, i) == F.substring(right, F.lit(1), i))
    return F.when(n >= 1, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))


def overlaps_by(left: Column, right: Column, size: int) -> Column:
    """Whether the last ``size`` letters of ``left`` are the first of ``right``."""
    return (F.length(left) >= size) & (F.length(right) >= size) & (F.right(left, F.lit(size)) == F.left(right, F.lit(size)))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one of the letters A C G T; 0 in an empty sequence."""
    runs = F.transform(F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def commonest_share(seq: Column) -> Column:
    """Share of the letter of A C G T that stands most often; null in an empty sequence."""
    counts = [F.length(seq) - F.length(F.translate(seq, b, "")) for b in "ACGT"]
    return F.when(F.length(seq) > 0, F.greatest(*counts) / F.length(seq))


def entropy(seq: Column) -> Column:
    """Entropy in bits of the letters A C G T of a sequence; null where it has none."""
    counts = [F.length(seq) - F.length(F.translate(seq, b, "")) for b in "ACGT"]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, parts[0] + parts[1] + parts[2] + parts[3])


def window_gc(seq: Column, width: int) -> Column:
    """G and C in each window of ``width`` letters, by its place; empty for a shorter sequence."""
    n = F.length(seq) - (width - 1)
    counts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.lit(width) - F.length(F.translate(F.substring(seq, i, F.lit(width)), "GC", "")))
    return F.when(n >= 1, counts).otherwise(F.array().cast("array<int>"))


def middle_canonical(kmer: Column, k: int) -> Column:
    """Representative of a k-mer and its reverse complement by the middle letter: for odd k the one whose
    middle is A or C, for even k the lesser of the two.
    """
    from strandflow.functions.dna import canonical, revcomp

    if k % 2 == 0:
        return canonical(kmer)
    return F.when(F.substring(kmer, k // 2 + 1, 1).isin("A", "C"), kmer).otherwise(revcomp(kmer))


def palindromic(kmer: Column, k: int) -> Column:
    """Whether a k-mer blocks extension: it is its own reverse complement, or, k being odd, its first or last k-1 letters are."""
    from strandflow.functions.dna import revcomp

    if k % 2 == 0:
        return kmer == revcomp(kmer)
    first, last = F.substring(kmer, 1, k - 1), F.substring(kmer, 2, k - 1)
    return (first == revcomp(first)) | (last == revcomp(last))
