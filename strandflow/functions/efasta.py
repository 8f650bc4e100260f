"""Sequences with bubbles {alternative,alternative...} as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blocks(text: Column) -> Column:
    """Array of alternatives by block: plain stretches have one, bubbles several, an empty one allowed."""
    parts = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\}|[^{}]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith("{"), F.split(F.substring(p, F.lit(2), F.length(p) - 2), ",", -1)).otherwise(F.array(p)))


def is_valid(text: Column) -> Column:
    """Braces close, do not nest, and hold two alternatives or more; letters A C G T N elsewhere."""
    return text.rlike(r"^(?:[ACGTNacgtn]++|\{[ACGTNacgtn]*+(?:,[ACGTNacgtn]*+)++\})*+\z")


def expand(text: Column) -> Column:
    """All plain sequences, in order of the alternatives; the number is their product."""
    return F.aggregate(blocks(text), F.array(F.lit("")), lambda have, alts: F.flatten(F.transform(have, lambda h: F.transform(alts, lambda a: F.concat(h, a)))))


def flatten_first(text: Column) -> Column:
    """The sequence that takes the first alternative everywhere."""
    return F.aggregate(blocks(text), F.lit(""), lambda s, alts: F.concat(s, alts[0]))


def length_range(text: Column) -> Column:
    """(min, max) of the lengths of its expansions."""
    size = lambda alts: F.transform(alts, lambda a: F.length(a))
    both = F.transform(blocks(text), lambda alts: F.struct(F.array_min(size(alts)).alias("lo"), F.array_max(size(alts)).alias("hi")))
    return F.aggregate(
        both, F.struct(F.lit(0).alias("min"), F.lit(0).alias("max")), lambda s, b: F.struct((s["min"] + b["lo"]).alias("min"), (s["max"] + b["hi"]).alias("max"))
    )


def ambiguities(text: Column) -> Column:
    """(snps, indels): bubbles whose alternatives are all single letters, and the others."""
    bubbles = F.filter(blocks(text), lambda a: F.size(a) > 1)
    snp = F.size(F.filter(bubbles, lambda alts: F.forall(alts, lambda a: F.length(a) == 1)))
    return F.struct(snp.alias("snps"), (F.size(bubbles) - snp).alias("indels"))
