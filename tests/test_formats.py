import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandflow.functions import efasta
from strandflow.sources import formats, sinks


def write(tmp_path, name, text, zipped=False):
    p = tmp_path / (name + (".gz" if zipped else ""))
    p.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return str(p)


def test_read_sets(tmp_path):
    a, b, c = (write(tmp_path, n, "") for n in ("a_1.fastq", "a_2.fastq", "b.bam"))
    got = formats.read_sets(f"sample:X,lib:L,frac:0.5::{tmp_path}/a_{{1,2}}.fastq+sample:Y::{c}")
    assert [(g.sample, g.lib, g.frac, len(g.files)) for g in got] == [("X", "L", 0.5, 2), ("Y", "1", 1.0, 1)]
    order = formats.read_sets("sample:B::x.fq+sample:A::y.fq+sample:B::z.fq", expand=False)
    assert [g.sample for g in order] == ["B", "B", "A"]
    for bad in ("type:jump::x.fq", "frac:0::x.fq", "frac:1.5::x.fq", "frac:a::x.fq", "odd:1::x.fq", "x.txt", "x.fq,x.fq", "x.fq,x.fq.gz", "sample:::x.fq"):
        with pytest.raises(ValueError):
            formats.read_sets(bad, expand=False)
    with pytest.raises(ValueError):
        formats.read_sets(f"{tmp_path}/none*.fq")


FQ = "@r0/1 x\nACGN\n+\nIIII\n@r1/1\nGG\n+\n!!\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_fastq(spark, tmp_path, rows, zipped):
    one = formats.fastq(spark, write(tmp_path, "a_1.fastq", FQ, zipped))
    got = rows(one.select("record", "name", formats.pair_name(F.col("name")), "seq", "qual"))
    assert got == [(0, "r0/1 x", "r0", "ACGA", [40] * 4), (1, "r1/1", "r1", "GG", [0, 0])]
    two = formats.fastq(spark, write(tmp_path, "a_2.fastq", FQ.replace("/1", "/2"), zipped))
    assert [(r.pair, r.mate) for r in formats.paired(one, two).orderBy("pair", "mate").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [(r.pair, r.mate) for r in formats.interlaced(one).orderBy("mate").collect()] == [(0, 0), (0, 1)]


@pytest.mark.parametrize("text", ["r\nAC\n+\nII\n", "@r\nAC\n-\nII\n", "@r\nAC\n+\nI\n", "@r\nA\n+\n" + chr(33 + 64) + "\n", "@r\nAC\n+\n"])
def test_broken_fastq(spark, tmp_path, text):
    with pytest.raises(Exception, match="FASTQ"):
        formats.fastq(spark, write(tmp_path, "x.fastq", text)).collect()


def test_uneven_pairs(spark, tmp_path):
    one = formats.fastq(spark, write(tmp_path, "a.fastq", FQ))
    short = formats.fastq(spark, write(tmp_path, "b.fastq", FQ[: FQ.index("@r1")]))
    with pytest.raises(Exception, match="differ in length"):
        formats.paired(one, short).collect()
    with pytest.raises(Exception, match="odd number"):
        formats.interlaced(short).collect()


@pytest.mark.parametrize("frac,want", [(0.5, [1, 2, 4, 6, 8]), (0.25, [1, 4, 8]), (1.0, [1, 2, 3, 4, 5, 6, 7, 8])])
def test_fraction(spark, frac, want):
    assert [r.id for r in spark.range(1, 9).where(formats.in_fraction(F.col("id"), frac)).orderBy("id").collect()] == want


def test_fraction_follows_the_recurrence(spark):
    for frac in (0.1, 0.3, 1 / 3, 0.77):
        taken, want = 0, []
        for i in range(1, 300):
            if taken / i <= frac:
                taken += 1
                want.append(i)
        assert [r.id for r in spark.range(1, 300).where(formats.in_fraction(F.col("id"), frac)).orderBy("id").collect()] == want


def test_fasta(spark, tmp_path, rows):
    df = formats.fasta(spark, write(tmp_path, "x.fasta", ">a one\nACG\nT\n\n>b\n>c\nGG\n"))
    assert rows(df.select("record", "name", "seq")) == [(0, "a one", "ACGT"), (1, "b", ""), (2, "c", "GG")]
    assert formats.fasta_region(df, "a one", 1, 3).first().seq == "CG"
    back = "\n".join(r.line for r in sinks.fasta_lines(df, "name", "seq", 3).collect())
    assert rows(formats.fasta(spark, write(tmp_path, "y.fasta", back)).select("name", "seq")) == rows(df.select("name", "seq"))


def bgzf(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(name, flag, seq, qual, tags=b""):
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    packed = bytes((code[seq[i]] << 4) | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name) + 1, 60, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path, rows):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 100)
    recs = [
        bam_record("p", 64, "ACGTN", [1, 2, 3, 4, 5]),
        bam_record("p", 128 | 16, "AAC", [1, 2, 3], b"NMi" + struct.pack("<i", 2) + b"OQZIJK\0"),
        bam_record("q", 256, "ACG", [1, 2, 3]),
        bam_record("s", 64 | 512, "RYM", [1, 2, 3], b"XBBc" + struct.pack("<ibb", 2, 1, 2)),
    ]
    data = head + b"".join(recs)
    p = tmp_path / "x.bam"
    p.write_bytes(bgzf(data[:90]) + bgzf(data[90:]) + bgzf(b""))
    df = formats.bam(spark, str(p))
    assert rows(df.select("name", "seq", "qual", "rname", "pos")) == [("p", "ACGTA", [1, 2, 3, 4, 5], "chr", 10), ("p", "GTT", [42, 41, 40], "chr", 10), ("s", "ACA", [1, 2, 3], "chr", 10)]
    assert formats.bam(spark, str(p), passed_only=True).count() == 2
    assert [(r.name, r.seq1, r.seq2) for r in formats.named_mates(df).collect()] == [("p", "ACGTA", "GTT")]


def test_vcf(spark, tmp_path, rows):
    path = write(tmp_path, "x.vcf", "##x\n#CHROM\nchr1\t5\t.\tA\tT,G\t9.5\tPASS\tDP=3;FLAG\tGT\t0/1\nchr2\t6\tid\tC\tG\t.\tq10\t.\n")
    got = rows(formats.vcf(spark, path).select("chrom", "pos", "alts", "qual", "info", "genotypes"))
    assert got == [("chr1", 5, ["T", "G"], 9.5, {"DP": "3", "FLAG": None}, ["0/1"]), ("chr2", 6, ["G"], None, {}, [])]


def test_parse_set():
    assert formats.parse_set("{1,5-7,2}") == [1, 2, 5, 6, 7] and formats.parse_set("[3,6)") == [3, 4, 5] and formats.parse_set("4") == [4]
    with pytest.raises(ValueError):
        formats.parse_set("a-b")


def test_gfa_and_dot(spark, rows):
    e = [("AC", "A", "C", "AC", "GT"), ("CA", "C", "A", "CA", "TG"), ("GT", "G", "T", "GT", "AC"), ("TG", "T", "G", "TG", "CA")]
    df = spark.createDataFrame(e, "edge string, src string, dst string, seq string, inv string")
    assert rows(sinks.gfa_segments(df)) == [("S\tedgeAC\tAC",), ("S\tedgeCA\tCA",)]
    links = [r.line for r in sinks.gfa_links(df).collect()]
    assert sorted(links) == ["L\tedgeAC\t+\tedgeCA\t+\t0M", "L\tedgeCA\t+\tedgeAC\t+\t0M"]
    assert '  "A" -> "C" [label="AC"];' in {r.line for r in sinks.dot_lines(df).collect()}


def test_efasta(spark):
    df = spark.createDataFrame([("AC{G,T}A{,C}",), ("ACGT",), ("A{C",), ("A{C}G",), ("",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(efasta.is_valid(t), efasta.expand(t), efasta.length_range(t), efasta.flatten_first(t), efasta.ambiguities(t)).collect()]
    assert got[0] == (True, ["ACGA", "ACGAC", "ACTA", "ACTAC"], (4, 5), "ACGA", (1, 1))
    assert got[1][:2] == (True, ["ACGT"]) and not got[2][0] and not got[3][0] and got[4][:2] == (True, [""])


def test_histogram_lines(spark):
    h = spark.createDataFrame([(1, 7), (3, 2)], "n long, kmers long")
    assert sorted(r.line for r in sinks.histogram_lines(h, 3).collect()) == ["1, 7", "2, 0", "3, 2"]
