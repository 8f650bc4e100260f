import random

from pyspark.sql import functions as F

from strandflow.operators import alignment, correction, pathfinder


def penalty(a, b, mismatch, open_, extend, free):
    big = 1 << 30
    n, m = len(a), len(b)
    best = [[big] * (m + 1) for _ in range(n + 1)]
    down = [[big] * (m + 1) for _ in range(n + 1)]
    over = [[big] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                down[i][j] = min(best[i - 1][j] + open_ + extend, down[i - 1][j] + extend)
            if j:
                over[i][j] = min(best[i][j - 1] + open_ + extend, over[i][j - 1] + extend) if i or not free else big
            start = 0 if (i == 0 and (free or j == 0)) else big
            diag = best[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else mismatch) if i and j else big
            best[i][j] = min(start, diag, down[i][j], over[i][j])
    return min(best[n]) if free else best[n][m]


def test_alignment_against_plain_programming(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    data = [(word(rng.randint(0, 12)), word(rng.randint(0, 15))) for _ in range(150)] + [("ACGT", "TTACGTTT"), (None, "A"), ("A", None)]
    df = spark.createDataFrame(data, "a string, b string")
    for free in (True, False):
        got = [(r.a, r.b, r.penalty) for r in alignment.align(df, "a", "b", 3, 4, 1, free).collect()]
        for a, b, p in got:
            assert p == (None if a is None or b is None else penalty(a, b, 3, 4, 1, free)), (a, b)
    assert alignment.align(df.where("a = 'ACGT' and b = 'TTACGTTT'"), "a", "b").first().start == 2


def test_exact_matches(spark):
    left = spark.createDataFrame([(1, "AAACCCGGGTTT")], "id int, seq string")
    right = spark.createDataFrame([(7, "TTCCCGGGAACCC")], "id int, seq string")
    got = sorted((r.start1, r.start2, r.length) for r in alignment.exact_matches(left, right, 4).collect())
    assert got == [(1, 8, 5), (3, 2, 6)]


def test_correction(spark):
    genome = "ACGTTGCAACGGTCATTGCA"
    bad = genome[:9] + "T" + genome[10:]
    data = [(i, genome, [30] * 20) for i in range(5)] + [(9, bad, [30] * 20)]
    reads = spark.createDataFrame(data, "read_id long, seq string, qual array<int>")
    cells = correction.stacks(reads, correction.friends(reads, 8))
    assert cells.where("stack = 9 and col = 3").count() == 6
    fixed = sorted((r.col, r.base, r.q, r.changed) for r in correction.corrected(cells).where("stack = 9").collect())
    assert "".join(x[1] for x in fixed) == genome and [x for x in fixed if x[3]] == [(9, "C" if genome[9] == "C" else genome[9], 0, True)]
    assert {(r.stack, r.of) for r in correction.high_quality_conflicts(cells).collect()} == {(9, i) for i in range(5)} | {(i, 9) for i in range(5)}
    called = {r.col: (r.base, r.q) for r in correction.consensus(cells.where("stack = 9")).collect()}
    assert called[9] == (genome[9], 50) and called[0] == ("A", 50)
    lone = spark.createDataFrame([(1, 0, 0, 1, "A", 30), (1, 1, 0, 1, "C", 60)], "stack int, col int, member int, of int, base string, q int")
    assert correction.corrected(lone).count() == 0


def test_quality_changes(spark):
    df = spark.createDataFrame([(1, "ACGTA", [9, 9, 2, 9, 9]), (2, "", [])], "read_id int, seq string, qual array<int>")
    assert [list(r.qual) for r in correction.capped_qualities(df, 1).orderBy("read_id").collect()] == [[9, 2, 2, 2, 9], []]
    after = df.withColumn("seq", F.regexp_replace("seq", "G", "C"))
    assert [list(r.qual) for r in correction.zeroed_where_changed(df, after).orderBy("read_id").collect()] == [[9, 9, 0, 9, 9], []]


def test_votes(spark):
    paths = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["b", "c"]), (3, ["a", "b", "x"]), (4, ["q"]), (5, ["c"])], "read_id long, edges array<string>")
    ways = spark.createDataFrame([("w", ["a", "b", "c"]), ("none", ["y", "z"])], "way string, edges array<string>")
    got = {r.way: (r.n_for, r.n_partial, r.n_against) for r in pathfinder.path_votes(paths, ways).collect()}
    assert got == {"w": (1, 1, 1), "none": (0, 0, 0)}


def test_matching(spark):
    data = [("r", "i1", "o1", 3), ("r", "i2", "o2", 2), ("s", "i1", "o1", 3), ("s", "i1", "o2", 1), ("t", "i1", "o1", 0)]
    df = spark.createDataFrame(data, "region string, came string, goes string, n int")
    assert sorted(map(tuple, pathfinder.perfect_matching(df).collect())) == [("r", "i1", "o1"), ("r", "i2", "o2")]


def test_set_sizes_are_one_aggregate(spark, tmp_path):
    """Sets joined with each other were sent to the driver as broadcasts."""
    from strandflow.plans.sequence_queries import kmer_setops

    a, b, shared = "ACGTTGCAAGCTTACGGATCCAGT", "TTGACCATGGCATTCAGGACATCA", "GGATTACAGGCATTACCAGATTAC"
    rows = [(1, a, "smpA1"), (2, shared, "smpA2"), (3, shared, "smpB1"), (4, b, "smpB1"), (5, b, "smpB1"), (6, a[:20], "smpA1"), (7, "A" * 24, None), (8, "C" * 24, "other")]
    spark.createDataFrame([(i, s, [30] * len(s), x) for i, s, x in rows], "read_id long, seq string, qual array<int>, sample string").write.parquet(f"{tmp_path}/oreads.parquet")
    df = kmer_setops(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.part: r.kmers for r in df.collect()} == {"both": 1, "a_only": 1, "b_only": 1, "any": 3}
