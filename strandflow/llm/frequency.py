"""How often every value or term occurs, and in how many records: a suffix array with common-prefix intervals.

The suffixes of all records, cut to the longest term wanted, are brought into one global order:
range partitions, each sorted. Neighbours in that order give the common-prefix lengths; a maximal
run of suffixes that agree in m tokens is the interval of one m-gram, its size is the number of
occurrences, and the number of records is that size less the neighbours of the same record in it.
An interval that reaches the edge of a block may go on in the next one. Only such an interval is
handed on by record and finished by an aggregate; so a term that fills many partitions costs each
of them one row per record of theirs, and no task ever holds a whole term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut


def token_suffixes(df: DataFrame, tokens: str, record: str, n_max: int) -> DataFrame:
    """(t1..tn, rec, weight, spread): the suffixes of an array of tokens, cut to ``n_max`` tokens.

    t2..tn are null beyond the end. Null arrays and null tokens give no suffix.
    """
    own = df.select(F.col(record).alias("rec"), F.filter(F.col(tokens), lambda x: x.isNotNull()).alias("tokens"))
    heads = F.transform(F.col("tokens"), lambda x, i: F.struct(*[F.get(F.col("tokens"), i + j).alias(f"t{j + 1}") for j in range(n_max)], i.alias("spread")))
    return own.select("rec", F.inline(heads)).withColumn("weight", F.lit(1).cast("bigint"))


def term_suffixes(df: DataFrame, terms: Sequence[Column], record: Column, weight: Column, spread: Column) -> DataFrame:
    """The same for rows that hold one term each, its tokens in columns."""
    return df.select(*[t.alias(f"t{j + 1}") for j, t in enumerate(terms)], record.alias("rec"), weight.cast("bigint").alias("weight"), spread.alias("spread"))


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it, null being equal to null."""
    column = column.dictionary_encode(null_encoding="encode")
    codes = column.indices.to_numpy(zero_copy_only=False)
    out = np.zeros(len(codes), dtype=bool)
    out[1:] = codes[1:] == codes[:-1]
    return out


def _scan(lengths: Sequence[int], n_max: int, schema: pa.Schema):
    """Intervals of sorted blocks. Output: m, t1..tn, rec, total, records (null: the interval may go on)."""

    def one(batch: pa.RecordBatch, m: int, common: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(common < m)
        run = np.cumsum(common < m) - 1
        total = np.add.reduceat(weight, starts)
        order = np.lexsort((rec, run))  # a no-op order where m is the full length
        again = np.zeros(len(run), dtype=np.int64)
        again[1:] = (run[order][1:] == run[order][:-1]) & (rec[order][1:] == rec[order][:-1])
        known = rec[order] >= 0
        records = np.bincount(run[order], weights=known & (again == 0), minlength=len(starts)).astype(np.int64)
        inner = np.arange(1, max(1, len(starts) - 1))
        edge = order[np.isin(run[order], [0, len(starts) - 1])]  # by run and record
        fresh = np.ones(len(edge), dtype=bool)
        fresh[1:] = (run[edge][1:] != run[edge][:-1]) | (rec[edge][1:] != rec[edge][:-1])
        heads = edge[fresh]
        sums = np.add.reduceat(weight[edge], np.flatnonzero(fresh))
        take = pa.array(np.concatenate([starts[inner], heads]))
        gap = len(heads)
        columns = [pa.array(np.full(len(take), m, dtype=np.int32))]
        for j in range(1, n_max + 1):
            column = batch.column(f"t{j}").take(take)
            columns.append(column if j <= m else pa.nulls(len(take), column.type))
        own = batch.column("rec").take(pa.array(heads))
        columns.append(pa.concat_arrays([pa.nulls(len(inner), own.type), own]))
        columns.append(pa.array(np.concatenate([total[inner], sums]).astype(np.int64)))
        columns.append(pa.concat_arrays([pa.array(records[inner]), pa.nulls(gap, pa.int64())]))
        out = pa.RecordBatch.from_arrays(columns, names=schema.names)
        return out.filter(pc.is_valid(out.column(f"t{m}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            common = np.zeros(batch.num_rows, dtype=np.int64)
            alike = np.ones(batch.num_rows, dtype=bool)
            for j in range(1, n_max + 1):
                alike &= _same(batch.column(f"t{j}"))
                common += alike
            rec = batch.column("rec").dictionary_encode()
            rec = pc.fill_null(rec.indices, -1).to_numpy(zero_copy_only=False)
            for m in lengths:
                yield one(batch, m, common, rec)

    return run


def term_counts(suffixes: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(m, t1..tn, total, records) of every term of each length in ``lengths``.

    ``suffixes`` as the two functions above make them; tokens may be of any type that sorts, and
    need not be of one. ``total`` sums the weights, ``records`` counts distinct records, a null
    record being none. ``spread`` is any value that differs among the rows of one term and record;
    it lets even these lie in several partitions. An empty table gives an empty result.
    """
    tokens = [c for c in suffixes.columns if c.startswith("t") and c[1:].isdigit()]
    n_max = len(tokens)
    usable = suffixes.where(F.col("t1").isNotNull()).select(*tokens, "rec", "weight", "spread")
    order = [*tokens, "rec", "spread"]
    array = usable.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    kinds = dict(array.dtypes)
    names = ["m", *tokens, "rec", "total", "records"]
    ddl = ", ".join(["m int", *[f"{t} {kinds[t]}" for t in tokens], f"rec {kinds['rec']}", "total bigint", "records bigint"])
    found = cut(array.mapInArrow(_scan(list(lengths), n_max, pa.schema([pa.field(n, pa.null()) for n in names])), ddl))
    whole = found.where("records is not null").select("m", *tokens, "total", "records")
    open_ = found.where("records is null").groupBy("m", *tokens, "rec").agg(F.sum("total").alias("total"))
    closed = open_.groupBy("m", *tokens).agg(F.sum("total").alias("total"), F.count("rec").alias("records"))
    return whole.unionByName(closed)


def mark(counts: DataFrame, least_total: int, most_records: int) -> DataFrame:
    """Adds too_rare (total below ``least_total``) and too_common (more than ``most_records`` records)."""
    return counts.withColumn("too_rare", F.col("total") < least_total).withColumn("too_common", F.col("records") > most_records)
