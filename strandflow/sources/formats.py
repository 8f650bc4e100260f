"""Readers of sequence files as DataFrames: read sets, FASTQ, FASTA, BAM, VCF, bubble FASTA.

Text formats are read as whole lines by Spark; only what spans lines (a FASTQ record, a FASTA
sequence) is put together, per file. Compressed files are not splittable and make one task each.
"""

from __future__ import annotations

import glob as globbing
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".bam", ".fastq", ".fastq.gz", ".fq", ".fq.gz", ".parquet")
MAX_QUAL = 63


@dataclass(frozen=True)
class ReadSet:
    """One group of input files and what is known of it."""

    files: tuple[str, ...]
    type: str = "frag"
    sample: str = "C"
    lib: str = "1"
    frac: float = 1.0


def _split_outside_braces(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p for p in [*parts, text[start:]] if p]


def _braces(text: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", text)
    if not m:
        return [text]
    return [x for alt in m.group(1).split(",") for x in _braces(text[: m.start()] + alt + text[m.end() :])]


def read_sets(spec: str, expand: bool = True) -> list[ReadSet]:
    """Parses ``[type:frag,sample:S,lib:L,frac:f::]f1,f2[+group...]``; groups of one sample come together.

    ValueError on an empty spec, an unknown field, a type other than frag, a frac outside (0, 1],
    an unknown suffix, a pattern without a file, or a file named twice (also with and without .gz).
    """
    groups = []
    for group in spec.split("+"):
        head, sep, names = group.rpartition("::")
        options = dict(type="frag", sample="C", lib="1", frac="1")
        for item in filter(None, head.split(",")) if sep else ():
            key, colon, value = item.partition(":")
            if key not in options or not colon or not value:
                raise ValueError(f"unknown or empty field {item!r}")
            options[key] = value
        if options["type"] != "frag":
            raise ValueError(f"type {options['type']!r} is not supported")
        try:
            frac = float(options["frac"])
        except ValueError:
            raise ValueError(f"frac {options['frac']!r} is no number") from None
        if not 0 < frac <= 1:
            raise ValueError("frac must lie above 0 and not above 1")
        files: list[str] = []
        for pattern in _split_outside_braces(names):
            for p in _braces(pattern):
                found = sorted(globbing.glob(p)) if expand else [p]
                if not found:
                    raise ValueError(f"no file matches {p!r}")
                files += found
        if not files:
            raise ValueError("a group names no file")
        groups.append(ReadSet(tuple(files), options["type"], options["sample"], options["lib"], frac))
    seen: set[str] = set()
    for f in (f for g in groups for f in g.files):
        if not f.endswith(SUFFIXES):
            raise ValueError(f"{f!r} is of no known type")
        bare = f.removesuffix(".gz")
        if bare in seen:
            raise ValueError(f"{f!r} is named twice")
        seen.add(bare)
    order = {s: i for i, s in reversed(list(enumerate(g.sample for g in groups)))}
    return sorted(groups, key=lambda g: order[g.sample])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line_no from 0 within each file.

    Files are taken whole, one task each, as line numbers within a file need all lines before.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content):
                raw = zlib.decompress(content, 47) if name.endswith(".gz") else bytes(content)
                lines = raw.decode("utf-8").splitlines()
                for at in range(0, len(lines), 50_000):
                    some = lines[at : at + 50_000]
                    yield pd.DataFrame({"file": name, "line_no": range(at, at + len(some)), "line": some})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, line_no long, line string")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, seq, qual): four lines a record; N is read as A, qualities are code less 33.

    The query fails on a heading without @, a third line without +, a sequence and quality list of
    different lengths, a quality above 63, or a record that does not end.
    """
    lines = numbered_lines(spark, path).where((F.col("line") != "") | (F.col("line_no") % 4 != 0))
    rows = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("record")).agg(
        *[F.max(F.when(F.col("line_no") % 4 == i, F.col("line"))).alias(f"l{i}") for i in range(4)]
    )
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("l3"), F.lit(1))), lambda i: F.ascii(F.substring("l3", i, F.lit(1))) - 33)
    qual = F.when(F.length("l3") == 0, F.array().cast("array<int>")).otherwise(codes)
    wrong = (
        F.when(F.col("l3").isNull(), "a record does not end")
        .when(~F.col("l0").startswith("@"), "a heading does not begin with @")
        .when(~F.col("l2").startswith("+"), "a third line does not begin with +")
        .when(F.length("l1") != F.length("l3"), "bases and qualities differ in number")
        .when(F.exists(qual, lambda q: (q > MAX_QUAL) | (q < 0)), "a quality is out of range")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("FASTQ: "), wrong)).cast("string")).otherwise(F.substring(F.col("l0"), F.lit(2), F.length("l0")))
    return rows.select("file", "record", checked.alias("name"), F.translate(F.upper("l1"), "N", "A").alias("seq"), qual.alias("qual"))


def pair_name(name: Column) -> Column:
    """A read's name up to the first blank or slash."""
    return F.regexp_extract(name, r"^([^ /]*)", 1)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files in lockstep -> (pair, mate, seq, qual); mate 0 and 1; fails where one file is longer."""
    both = first.select("record", F.struct("seq", "qual").alias("a")).join(second.select("record", F.struct("seq", "qual").alias("b")), "record", "full")
    whole = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("paired files differ in length")).cast("bigint")).otherwise(F.col("record"))
    rows = both.select(whole.alias("pair"), F.posexplode(F.array("a", "b")).alias("mate", "r"))
    return rows.select("pair", "mate", "r.seq", "r.qual")


def interlaced(records: DataFrame) -> DataFrame:
    """One file of mates in turn -> (pair, mate, seq, qual); fails where the number is odd."""
    rows = records.select(F.floor(F.col("record") / 2).alias("pair"), (F.col("record") % 2).cast("int").alias("mate"), "seq", "qual")
    odd = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select(F.raise_error(F.lit("odd number of records")).cast("bigint").alias("pair"))
    return rows.join(odd, "pair", "left_anti")


def in_fraction(number: Column, frac: float) -> Column:
    """Whether the pair of this number (from 1) is kept of a fraction.

    Taking pairs in turn, one is skipped while more than ``frac`` of those before it, in terms of
    its own number, are taken. After pair i that makes floor(frac*i) + 1 pairs, so each row can
    tell by itself and no order is needed.
    """
    if frac >= 1:
        return F.lit(True)
    return (number == 1) | (F.floor(number * frac) > F.floor((number - 1) * frac))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, seq): headings begin with >, sequences may run over many lines."""
    from pyspark.sql import Window

    lines = numbered_lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("record", F.sum(F.col("line").startswith(">").cast("int")).over(w) - 1).where("record >= 0")
    grouped = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return grouped.select("file", "record", F.substring(F.col("l")[0]["line"], F.lit(2), F.length(F.col("l")[0]["line"])).alias("name"), F.array_join(F.transform(F.filter("l", lambda x: ~x["line"].startswith(">")), lambda x: F.trim(x["line"])), "").alias("seq"))


def fasta_region(records: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Letters [start, stop) of one record."""
    return records.where(F.col("name") == name).select("name", F.substring("seq", start + 1, stop - start).alias("seq"))


# Bases of the four-bit code of BAM; a code for several bases gives the lowest of them.
_NIBBLES = "=ACAGACATACAGACA"


def _bam_records(raw: bytes) -> Iterator[tuple]:
    blocks, at = [], 0
    while at < len(raw):
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        size = struct.unpack_from("<H", raw, at + 16)[0] + 1
        blocks.append(zlib.decompress(raw[at + 12 + extra : at + size - 8], -15))
        at += size
    data = b"".join(blocks)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    refs = []
    for _ in range(n_ref):
        (n,) = struct.unpack_from("<i", data, at)
        refs.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    turn = str.maketrans("ACGT", "TGCA")
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        ref, pos, l_name, mapq, _, n_cigar, flag, n_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p = at + 36
        name = data[p : p + l_name - 1].decode()
        p += l_name + 4 * n_cigar
        packed = data[p : p + (n_seq + 1) // 2]
        seq = "".join(_NIBBLES[(packed[i // 2] >> (4 if i % 2 == 0 else 0)) & 15] for i in range(n_seq)).replace("=", "A")
        p += (n_seq + 1) // 2
        qual = list(data[p : p + n_seq])
        p += n_seq
        end = at + 4 + size
        while p < end:
            tag, kind = data[p : p + 2], chr(data[p + 2])
            p += 3
            if kind in "ZH":
                stop = data.index(b"\0", p)
                if tag == b"OQ":
                    qual = [c - 33 for c in data[p:stop]]
                p = stop + 1
            elif kind == "B":
                sub, n = chr(data[p]), struct.unpack_from("<i", data, p + 1)[0]
                p += 5 + n * struct.calcsize({"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[sub])
            else:
                p += {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}[kind]
        if flag & 16:
            seq, qual = seq[::-1].translate(turn), qual[::-1]
        yield name, flag, refs[ref] if ref >= 0 else None, pos + 1, mapq, seq, qual
        at = end


def bam(spark: SparkSession, path: str, passed_only: bool = False) -> DataFrame:
    """(file, name, flag, rname, pos, mapq, seq, qual): primary records; reads as they came off the machine.

    Secondary and supplementary records are skipped, and with ``passed_only`` those that failed the
    quality check. The OQ tag replaces the qualities. A file is one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["name", "flag", "rname", "pos", "mapq", "seq", "qual"]
        for part in parts:
            for name, content in zip(part.path, part.content):
                rows = []
                for r in _bam_records(bytes(content)):
                    if r[1] & 0x900 or (passed_only and r[1] & 0x200):
                        continue
                    rows.append(r)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=columns).assign(file=name)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns).assign(file=name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "name string, flag int, rname string, pos int, mapq int, seq string, qual array<int>, file string")


def named_mates(records: DataFrame) -> DataFrame:
    """(name, seq1, qual1, seq2, qual2): only names with exactly a first and a second mate."""
    mates = records.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, F.struct("seq", "qual"))).alias("a"),
        F.max(F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, F.struct("seq", "qual"))).alias("b"),
    )
    return mates.where("n = 2 and a is not null and b is not null").select("name", F.col("a.seq").alias("seq1"), F.col("a.qual").alias("qual1"), F.col("b.seq").alias("seq2"), F.col("b.qual").alias("qual2"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info, genotypes) of the records of a VCF file; info as a map."""
    f = F.split("value", "\t", -1)
    info = F.map_from_entries(
        F.transform(F.array_distinct(F.filter(F.split(f[7], ";"), lambda x: (x != ".") & (x != ""))), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.get(F.split(x, "=", 2), 1).alias("value")))
    )
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(
        f[0].alias("chrom"), f[1].cast("int").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.when(f[5] != ".", f[5].try_cast("double")).alias("qual"), f[6].alias("filter"),
        info.alias("info"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("genotypes"),
    )


def parse_set(text: str) -> list[int]:
    """``{1,2,5-7}``, ``[3,9)`` and plain numbers -> sorted distinct integers."""
    text = text.strip()
    m = re.fullmatch(r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*([)\]])", text)
    if m:
        return list(range(int(m[1]), int(m[2]) + (m[3] == "]")))
    body = text[1:-1] if text.startswith("{") and text.endswith("}") else text
    out: set[int] = set()
    for item in filter(None, (x.strip() for x in body.split(","))):
        m = re.fullmatch(r"(-?\d+)(?:-(-?\d+))?", item)
        if not m:
            raise ValueError(f"{item!r} is neither a number nor a range")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)
