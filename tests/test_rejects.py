from strandflow.operators.rejects import SAM, VARIANT, load_or_reject

GOOD = ["r1", "0", "c", "5", "60", "4M", "*", "0", "-7", "ACGT", "IIII"]


def sam(**changes):
    f = list(GOOD)
    for i, v in changes.items():
        f[int(i[1:])] = v
    return "\t".join(f)


def check(spark, fmt, lines):
    """line -> reason, or None where it loads; absent where it is no record."""
    raw = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    good, bad = load_or_reject(raw, fmt)
    out = {r.line_id: r.reason for r in bad.collect()}
    loaded = [r.line_id for r in good.select("line_id").collect()]
    assert not set(out) & set(loaded) and len(loaded) == len(set(loaded))
    return out | dict.fromkeys(loaded)


def test_sam_lines(spark):
    cases = [
        (sam(), None),
        (sam() + "\tXX:Z:anything\t\t", None),
        (sam() + "\r", None),
        (sam(_8="0") + "\r", None),
        ("\t".join(GOOD[:10]), "too few fields"),
        (sam(_1="x"), "FLAG is no whole number"),
        (sam(_1="+1"), "FLAG is no whole number"),
        (sam(_1=" 1"), "FLAG is no whole number"),
        (sam(_1="-1"), "FLAG is no whole number"),
        (sam(_1="٣"), "FLAG is no whole number"),
        (sam(_3="2147483648"), "POS is no whole number"),
        (sam(_3="2147483647"), None),
        (sam(_3="00000000000002147483647"), None),
        (sam(_3="5\n"), "POS is no whole number"),
        (sam(_4=""), "MAPQ is no whole number"),
        (sam(_7="1.0"), "PNEXT is no whole number"),
        (sam(_8="--7"), "TLEN is no number"),
        (sam(_8="-"), "TLEN is no number"),
        (sam(_3="0"), "POS is 0 in a mapped record"),
        (sam(_3="0", _1="4"), None),
        (sam(_3="0", _1="3"), "POS is 0 in a mapped record"),
    ]
    got = check(spark, SAM, [c for c, _ in cases] + ["@HD\tx", "", "   ", None, "\t\t"])
    assert got == {i: r for i, (_, r) in enumerate(cases)}


def test_variant_lines(spark):
    cases = [
        ("chr1,5,.,A,T,.,PASS,X,0/1", None),
        ('"chr1","5","a ""b"", c","a","T,G","12.5","x\ny","X,Y","0/1"', None),
        ("chr1,5,.,A,T,12,PASS,X,", None),
        (",5,.,A,T,.,PASS,X,0/1", "CHROM is empty"),
        ('"",5,.,A,T,.,PASS,X,0/1', "CHROM is empty"),
        ('chr1,5,"open,A,T,.,PASS,X,0/1', "quoting is broken"),
        ('chr1,5,"a"b,A,T,.,PASS,X,0/1', "quoting is broken"),
        ('chr1,5,a"b,A,T,.,PASS,X,0/1', "quoting is broken"),
        ('chr1,5,.,A,T,.,PASS,X,"0/1"\r', "quoting is broken"),
        ("chr1,5,.,A,T,.,PASS,X", "not nine fields"),
        ("chr1,5,.,A,T,.,PASS,X,0/1,", "not nine fields"),
        ("chr1,0,.,A,T,.,PASS,X,0/1", "POS1 is no whole number of at least 1"),
        ("chr1,x,.,A,T,.,PASS,X,0/1", "POS1 is no whole number of at least 1"),
        ("chr1,5,.,AX,T,.,PASS,X,0/1", "REF is not letters of ACGTN"),
        ("chr1,5,.,,T,.,PASS,X,0/1", "REF is not letters of ACGTN"),
        ("chr1,5,.,A,T,1e3,PASS,X,0/1", "QUAL is neither a point nor a number"),
        ("chr1,5,.,A,T,-1,PASS,X,0/1", "QUAL is neither a point nor a number"),
        ("chr1,5,.,A,T,,PASS,X,0/1", "QUAL is neither a point nor a number"),
    ]
    got = check(spark, VARIANT, [c for c, _ in cases] + ["#CHROM", "", " \n", None])
    assert got == {i: r for i, (_, r) in enumerate(cases)}


def test_long_fields_do_not_overflow(spark):
    long = '"' + 'x""' * 200_000 + '"'
    got = check(spark, VARIANT, [f"chr1,5,{long},A,T,.,PASS,X,0/1", f"chr1,5,{long[:-1]},A,T,.,PASS,X,0/1"])
    assert got == {0: None, 1: "quoting is broken"}


def test_empty_table_null_offsets_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "line_id long, line string")
    assert [x.count() for x in load_or_reject(empty, SAM)] == [0, 0]
    raw = spark.createDataFrame([(None, sam(), 1), (None, "bad", 1), (3, "bad", 1), (3, sam(), 2), (4, sam(), 2), (4, sam(), 2)], "line_id long, line string, flag int")
    good, bad = load_or_reject(raw, SAM)
    assert sorted(str(r.line_id) for r in good.collect()) == ["3", "4", "4", "None"]
    assert sorted((str(r.line_id), r.line) for r in bad.collect()) == [("3", "bad"), ("None", "bad")]
