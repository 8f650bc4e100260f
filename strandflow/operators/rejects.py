"""Rows that fail to parse: strict load plus anti-join.

The raw records keep their offset. A strict load brings only the conforming records, as typed
columns. What the load brought is subtracted from the raw offsets; the remainder, and only the
remainder, is looked at again to name the reason. Load, subtraction and diagnosis are narrow
expressions inside the JVM; the single shuffle is that of the anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX = 2147483647

# One field of a quoted record, after the comma put before it. All repetitions are possessive, so
# a long field neither backtracks nor recurses.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=,|\z)|[^",]*+(?=,|\z))'
_RECORD = rf"^(?:,{_FIELD})++\z"


def whole_number(text: Column) -> Column:
    """The value of one or more digits 0-9 and nothing else, at most 2147483647; null otherwise."""
    value = F.when(text.rlike(r"^0*[0-9]{1,10}\z"), text.try_cast("bigint"))
    return F.when(value <= INT_MAX, value.cast("int"))


def signed_number(text: Column) -> Column:
    """Like whole_number, with at most one minus before it."""
    minus = text.startswith("-")
    size = whole_number(F.when(minus, F.substring(text, 2, INT_MAX)).otherwise(text))
    return F.when(minus, -size).otherwise(size)


@dataclass(frozen=True)
class RecordFormat:
    """How one kind of record is split, typed and judged.

    ``split`` gives the fields, or null where no split exists. ``columns`` gives the typed columns
    from the fields; ``rules`` gives (reason, condition that it fails) in order of precedence, over
    the array column ``f`` of the fields and the typed columns.
    """

    header: str
    split: object
    columns: Sequence[tuple[str, object]]
    rules: Sequence[tuple[str, object]]


def _at(i: int) -> Column:
    return F.get(F.col("f"), i)


def _sam_fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"\r\z", ""), "\t", -1)


def _quoted_fields(line: Column) -> Column:
    whole = F.concat(F.lit(","), line)
    raw = F.regexp_extract_all(whole, F.lit(f",({_FIELD})"), F.lit(1))
    bare = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, 2, F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(whole.rlike(_RECORD), bare)


SAM = RecordFormat(
    header="@",
    split=_sam_fields,
    columns=[
        ("qname", lambda: _at(0)),
        ("flag", lambda: whole_number(_at(1))),
        ("rname", lambda: _at(2)),
        ("pos", lambda: whole_number(_at(3))),
        ("mapq", lambda: whole_number(_at(4))),
        ("cigar", lambda: _at(5)),
        ("rnext", lambda: _at(6)),
        ("pnext", lambda: whole_number(_at(7))),
        ("tlen", lambda: signed_number(_at(8))),
        ("seq", lambda: _at(9)),
        ("qual", lambda: _at(10)),
        ("tags", lambda: F.slice(F.col("f"), 12, F.greatest(F.size("f") - 11, F.lit(0)))),
    ],
    rules=[
        ("too few fields", lambda: F.size("f") < 11),
        ("FLAG is no whole number", lambda: F.col("flag").isNull()),
        ("POS is no whole number", lambda: F.col("pos").isNull()),
        ("MAPQ is no whole number", lambda: F.col("mapq").isNull()),
        ("PNEXT is no whole number", lambda: F.col("pnext").isNull()),
        ("TLEN is no number", lambda: F.col("tlen").isNull()),
        ("POS is 0 in a mapped record", lambda: (F.col("pos") == 0) & (F.col("flag").bitwiseAND(F.lit(4)) == 0)),
    ],
)

VARIANT = RecordFormat(
    header="#",
    split=_quoted_fields,
    columns=[
        ("chrom", lambda: _at(0)),
        ("pos1", lambda: whole_number(_at(1))),
        ("id", lambda: _at(2)),
        ("ref", lambda: _at(3)),
        ("alts", lambda: F.split(_at(4), ",", -1)),
        ("qual", lambda: F.when(_at(5).rlike(r"^[0-9]++(?:\.[0-9]++)?\z"), _at(5).try_cast("double"))),
        ("filters", lambda: _at(6)),
        ("infos", lambda: F.split(_at(7), ";", -1)),
        ("gtfs", lambda: F.split(_at(8), r"\|", -1)),
    ],
    rules=[
        ("quoting is broken", lambda: F.col("f").isNull()),
        ("not nine fields", lambda: F.size("f") != 9),
        ("CHROM is empty", lambda: _at(0) == ""),
        ("POS1 is no whole number of at least 1", lambda: F.col("pos1").isNull() | (F.col("pos1") < 1)),
        ("REF is not letters of ACGTN", lambda: ~_at(3).rlike(r"^[ACGTNacgtn]++\z")),
        ("QUAL is neither a point nor a number", lambda: (_at(5) != ".") & F.col("qual").isNull()),
    ],
)


def records(raw: DataFrame, fmt: RecordFormat, offset: str = "line_id", line: str = "line") -> DataFrame:
    """The records among raw lines: (offset, line, print). Null, blank and header lines are none.

    Columns beyond the two are left out here, so names of theirs cannot clash with typed columns.
    ``print`` is a fingerprint of the line: the offset is unique in a well-made table, and where it
    is null or repeated the pair still tells apart records that differ.
    """
    own = raw.select(F.col(offset).alias("offset"), F.col(line).alias("line"))
    kept = own.where(F.col("line").isNotNull() & F.col("line").rlike(r"\S") & ~F.col("line").startswith(fmt.header))
    return kept.withColumn("print", F.xxhash64("line"))


def load_strict(found: DataFrame, fmt: RecordFormat) -> DataFrame:
    """Only the conforming records, typed: (offset, print, columns of the format)."""
    typed = _typed(found, fmt)
    broken = F.lit(False)
    for _, rule in fmt.rules:
        broken = broken | F.coalesce(rule(), F.lit(True))
    return typed.where(~broken).select("offset", "print", *[name for name, _ in fmt.columns])


def _typed(found: DataFrame, fmt: RecordFormat) -> DataFrame:
    """The records cut to fields and typed. Generators of one row keep the fields and the typed columns
    in place: a plain projection would be put in again for each use of a column in the rules.
    """
    cut_up = found.select("offset", "print", F.explode(F.array(fmt.split(F.col("line")))).alias("f"))
    return cut_up.select("offset", "print", "f", F.inline(F.array(F.struct(*[make().alias(name) for name, make in fmt.columns]))))


def diagnosed(rest: DataFrame, fmt: RecordFormat) -> DataFrame:
    """(offset, line, reason) of records that did not load; who asks for no reason does not even carry the line."""
    cut_up = rest.withColumn("f", fmt.split(F.col("line")))
    typed = cut_up.select("offset", "line", "f", *[make().alias(name) for name, make in fmt.columns])
    return typed.select("offset", "line", F.coalesce(*[F.when(F.coalesce(rule(), F.lit(True)), F.lit(name)) for name, rule in fmt.rules]).alias("reason"))


def load_or_reject(raw: DataFrame, fmt: RecordFormat, offset: str = "line_id", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): typed conforming records, and (offset, line, reason) of every other one.

    Nulls: a null line is no record; a null offset is kept as it is on both sides. Repeated lines
    count each. An empty table gives two empty results. Lines of any length are split whole.
    """
    found = records(raw, fmt, offset, line)
    loaded = load_strict(found, fmt)
    came = loaded.select(F.col("offset").alias("o"), F.col("print").alias("p"))
    rest = found.join(came, F.col("offset").eqNullSafe(F.col("o")) & (F.col("print") == F.col("p")), "left_anti")
    return loaded.drop("print").withColumnRenamed("offset", offset), diagnosed(rest, fmt).withColumnRenamed("offset", offset)
