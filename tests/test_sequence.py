import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions.dna import canonical, revcomp
from strandflow.operators import graph, kmers, placement, stats

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(TURN)


def letters(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def reads_of(spark, seqs, quals=None):
    data = [(i, s, quals[i] if quals else [40] * len(s), "s") for i, s in enumerate(seqs)]
    return spark.createDataFrame(data, "read_id long, seq string, qual array<int>, sample string")


def table(spark, seqs, k):
    return kmers.prune_adjacencies(kmers.kmer_table(reads_of(spark, seqs), k))


def brute_unipaths(seqs, k):
    """(straight sequences, nodes on circles) by walking."""
    nodes = {x for s in seqs for i in range(len(s) - k + 1) for x in (s[i : i + k], rc(s[i : i + k]))}
    edges = {(s[i : i + k], s[i + 1 : i + k + 1]) for s in seqs for i in range(len(s) - k)}
    edges |= {(rc(b), rc(a)) for a, b in edges}
    # an edge is known by its canonical (k+1)-mer; contexts joined by k-mer give the same
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    into = {n: [a for a, b in edges if b == n] for n in nodes}
    pal = {n for n in nodes if n == rc(n)}
    link = {u: out[u][0] for u in nodes if u not in pal and len(out[u]) == 1 and out[u][0] not in pal and len(into[out[u][0]]) == 1}
    heads = nodes - set(link.values())
    paths, seen = set(), set()
    for h in heads:
        s, n = h, h
        seen.add(n)
        while n in link:
            n = link[n]
            seen.add(n)
            s += n[-1]
        paths.add(s)
    return paths, nodes - seen


@pytest.mark.parametrize(
    "seqs,k",
    [(["AACAGTCTTGG"], 4), (["AACAGTCTTGG", "AACAGACTTGG"], 4), (["CAAGACAAGAC"], 4), (["ACGT"], 4), ([letters(5, 400)], 6)],
)
def test_unipaths_by_brute_force(spark, seqs, k):
    want, ring = brute_unipaths(seqs, k)
    got = graph.unipaths(table(spark, seqs, k)).collect()
    assert {r.seq for r in got if not r.circle} == want
    assert sum(r.n_kmers for r in got if r.circle) == len(ring)
    for r in got:
        assert len(r.seq) == r.n_kmers + k - 1 and r.edge == r.seq[:k]
    edges = graph.graph_edges(graph.unipaths(table(spark, seqs, k)), k)
    assert all(r.n == 0 for r in graph.involution_violations(edges).collect())


def test_known_unipaths(spark):
    one = graph.unipaths(table(spark, ["AACAGTCTTGG"], 4)).collect()
    assert sorted(r.seq for r in one) == ["AACAGTCTTGG", "CCAAGACTGTT"]
    two = {min(r.seq, rc(r.seq)) for r in graph.unipaths(table(spark, ["AACAGTCTTGG", "AACAGACTTGG"], 4)).collect()}
    assert two == {"AACAG", "AAGA", "AAGT", "ACTG", "AGACT", "CAGA", "CCAAG"}
    ring = graph.unipaths(table(spark, ["CAAGACAAGAC"], 4)).collect()
    assert all(r.circle for r in ring) and "AAGACAAG" in {r.seq for r in ring}


def test_same_graph_from_permuted_and_reversed_reads(spark, rows):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = [genome[i : i + 60] for i in range(0, 240, 7)]
    flipped = [rc(s) for s in seqs]
    rng.shuffle(flipped)
    key = lambda s: sorted(min(r.seq, rc(r.seq)) for r in graph.unipaths(table(spark, s, 12)).collect())
    assert key(seqs) == key(flipped)


def test_counts_and_context(spark):
    t = {r.kmer: r for r in kmers.kmer_table(reads_of(spark, ["ACGTAC"]), 4).collect()}
    assert {k: v.n for k, v in t.items()} == {"ACGT": 1, "CGTA": 1, "GTAC": 1}
    assert (t["CGTA"].pred, t["CGTA"].succ) == (1, 2)
    assert kmers.kmer_table(reads_of(spark, []), 4).count() == 0
    counts = {r.kmer: r.n for r in kmers.kmer_table(reads_of(spark, ["ACGTACGT", "TTTT"]), 3).collect()}
    assert sum(counts.values()) == 8


def test_good_length(spark):
    quals = [[9, 9, 9, 2, 9, 9, 9, 9, 1], [9, 9, 9, 2, 9, 9], [9, 2, 9, 2, 9], [9, 9, 9, 9], []]
    df = reads_of(spark, ["A" * len(q) for q in quals], quals)
    assert [r.g for r in df.orderBy("read_id").select(kmers.good_length(F.col("qual"), 3, 7).alias("g")).collect()] == [8, 3, 0, 4, 0]
    assert sorted(r.read_id for r in kmers.trimmed(df, 3, 7).collect()) == [0, 3]


def test_clean_reads(spark, rows):
    data = [(1, "ACN", [1, 2, 3], "a", 1), (1, "ACN", [1, 2, 3], "a", 2), (2, None, None, "a", 1), (3, "", [], None, 1), (4, "acg", None, None, 1), (None, "A", [], "x", 1)]
    df = spark.createDataFrame(data, "read_id long, seq string, qual array<int>, sample string, loaded_at int")
    assert rows(kmers.clean_reads(df)) == [(1, "ACA", [1, 2, 3], "a"), (4, "ACG", [], None)]


def test_dna_expressions(spark):
    r = spark.createDataFrame([("AACG", "acN")], "a string, b string").select(revcomp(F.col("a")), revcomp(F.col("b")), canonical(F.lit("GGG"))).first()
    assert tuple(r) == ("CGTT", "Ngt", "CCC")


def test_components(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60) if i != 40] + [("x", "x")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and {got[f"n{i:03}"] for i in range(41, 61)} == {"n041"} and got["x"] == "x"


def n50_of(v):
    v, total, c = sorted(v), sum(v), 0
    for i, x in enumerate(v):
        c += x
        if 2 * c == total and i < len(v) - 1:
            return (x + v[i + 1]) // 2
        if 2 * c >= total:
            return x


def test_n50_and_nx(spark):
    rng = random.Random(3)
    cases = [[1, 2, 3, 4], [2, 2], [1, 3, 4], [5], [1, 1, 1, 1], [1, 1, 2, 2, 6], [3, 3, 3, 9], *[[rng.randint(1, 9) for _ in range(rng.randint(1, 9))] for _ in range(60)]]
    df = spark.createDataFrame([(i, x) for i, c in enumerate(cases) for x in c], "g int, x int")
    got = {r.g: r.n50 for r in stats.n50(df, "x", ["g"]).collect()}
    assert got == {i: n50_of(c) for i, c in enumerate(cases)}
    nx = {r.x: r.len for r in stats.nx_table(spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "l int"), "l").collect()}
    assert [nx[x] for x in range(10, 100, 10)] == [40, 40, 40, 40, 30, 30, 30, 20, 20]
    ng = {r.x: r.len for r in stats.nx_table(spark.createDataFrame([(10,)], "l int"), "l", size=25).collect()}
    assert ng[40] == 10 and ng[50] is None


def test_fragments(spark):
    locs = [(1, 1000, 0, False), (1, 1300, 1, True), (1, 5, 2, False), (2, 9, 3, True), (None, 1, 4, False), (1, 1, None, True)]
    df = spark.createDataFrame(locs, "uid long, s int, rid long, rc boolean")
    assert [tuple(r) for r in placement.fragment_distribution(df, "uid", "s", "rid", "rc").collect()] == [(305.0, 1, 1.0)]


def test_place_reads_and_paths(spark, rows):
    genome = letters(8, 120)
    seqs = [genome[:70], genome[40:], rc(genome[20:90])]
    reads = reads_of(spark, seqs)
    edges = graph.graph_edges(graph.unipaths(table(spark, seqs, 12)), 12)
    parts = placement.place_reads(reads, edges, 12)
    assert {r.read_id: r.n_kmers for r in parts.collect()} == {0: 59, 1: 69, 2: 59}
    paths = {r.read_id: (r.off, len(r.edges)) for r in placement.read_paths(parts, edges).collect()}
    assert paths == {0: (0, 1), 1: (40, 1), 2: (30, 1)}


def test_genome_size_counts_hot_kmers_in_full(spark, tmp_path):
    from strandflow.plans import sequence_queries

    seqs = [letters(71, 30)] + [letters(72, 60)] * 150 + [letters(73, 30)] * 400
    reads_of(spark, seqs).write.parquet(str(tmp_path / "oreads.parquet"))
    total = 7 + 37 * 150 + 7 * 400
    assert tuple(sequence_queries.genome_size(spark, str(tmp_path)).first()) == (150, total, total // 150)
    assert sorted(map(tuple, sequence_queries.kmer_histogram(spark, str(tmp_path)).collect())) == [(1, 7), (100, 44)]


def test_exact_bispectrum_keeps_high_counts_apart(spark, tmp_path):
    from strandflow.plans import sequence_queries

    x, y = letters(81, 30), letters(82, 30)
    data = [(i, x if i < 55 else y, [40] * 30, "smpA1" if i < 25 or 55 <= i < 85 else "smpB1") for i in range(90)]
    spark.createDataFrame(data, "read_id long, seq string, qual array<int>, sample string").write.parquet(str(tmp_path / "oreads.parquet"))
    assert sorted(map(tuple, sequence_queries.kmer_bispectrum_exact(spark, str(tmp_path)).collect())) == [(25, 30, 7), (30, 5, 7)]
    assert sorted(map(tuple, sequence_queries.kmer_bispectrum(spark, str(tmp_path)).collect())) == [(20, 5, 7), (20, 20, 7)]
