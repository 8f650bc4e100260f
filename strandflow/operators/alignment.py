"""Pairwise alignment of two text columns, in batches of arrays; a row's matrix is as large as its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _affine(a: str, b: str, mismatch: int, gap_open: int, gap_extend: int, free_ends: bool) -> tuple[int, int]:
    """(least penalty, place in b where it starts) of all of a within b; with ``free_ends`` b may hang over."""
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    m = len(y)
    big = 1 << 40
    steps = np.arange(m + 1, dtype=np.int64) * gap_extend
    best = np.zeros(m + 1, dtype=np.int64) if free_ends else np.where(np.arange(m + 1) == 0, 0, gap_open + steps)
    start = np.arange(m + 1) if free_ends else np.zeros(m + 1, dtype=np.int64)
    down, down_start = np.full(m + 1, big, dtype=np.int64), start.copy()
    for c in a:
        opened, longer = best + gap_open + gap_extend, down + gap_extend
        down_start = np.where(opened <= longer, start, down_start)
        down = np.minimum(opened, longer)
        diag = np.full(m + 1, big, dtype=np.int64)
        diag[1:] = best[:-1] + np.where(y == ord(c), 0, mismatch)
        diag_start = np.zeros(m + 1, dtype=np.int64)
        diag_start[1:] = start[:-1]
        here = np.where(diag <= down, diag, down)
        here_start = np.where(diag <= down, diag_start, down_start)
        # gaps along b: the least of here[j] + open + (i-j)*extend over j < i, by a running least
        base = here - steps
        run = np.minimum.accumulate(base)
        at = np.maximum.accumulate(np.where(base == run, np.arange(m + 1), 0))
        across = np.full(m + 1, big, dtype=np.int64)
        across[1:] = run[:-1] + steps[1:] + gap_open
        across_start = np.zeros(m + 1, dtype=np.int64)
        across_start[1:] = here_start[at[:-1]]
        best = np.where(here <= across, here, across)
        start = np.where(here <= across, here_start, across_start)
    end = int(np.argmin(best)) if free_ends else m
    return int(best[end]), int(start[end])


def align(df: DataFrame, a: str, b: str, mismatch: int = 3, gap_open: int = 12, gap_extend: int = 1, free_ends: bool = True) -> DataFrame:
    """Adds ``penalty`` and ``start``: least penalty of aligning all of ``a`` within ``b``, and where in b it begins.

    With ``free_ends`` false b must be used whole. A gap of n costs gap_open + n*gap_extend. A null
    text gives nulls; the empty text aligns anywhere for nothing.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(None, None) if x is None or y is None else _affine(x, y, mismatch, gap_open, gap_extend, free_ends) for x, y in zip(part[a], part[b])]
            part["penalty"] = pd.array([p for p, _ in found], dtype="Int64")
            part["start"] = pd.array([s for _, s in found], dtype="Int64")
            yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, penalty long, start long")


def edit_distance(a: Column, b: Column) -> Column:
    """Substitutions, insertions and deletions at unit cost."""
    return F.levenshtein(a, b)


def exact_matches(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id1, id2, start1, start2, length): maximal exact matches of k letters or more between two sets (id, seq)."""
    from pyspark.sql import Window

    from strandflow.functions.dna import kmers_of

    seeds = lambda df, n: df.where(F.length("seq") >= k).select(F.col("id").alias(f"id{n}"), F.posexplode(kmers_of(F.col("seq"), k)).alias(f"p{n}", "kmer"))
    met = seeds(left, 1).join(seeds(right, 2), "kmer").withColumn("diagonal", F.col("p1") - F.col("p2"))
    w = Window.partitionBy("id1", "id2", "diagonal").orderBy("p1")
    runs = met.withColumn("run", F.col("p1") - F.row_number().over(w))
    return runs.groupBy("id1", "id2", "diagonal", "run").agg(F.min("p1").alias("start1"), F.min("p2").alias("start2"), (F.count(F.lit(1)) + k - 1).cast("int").alias("length")).drop("diagonal", "run")
