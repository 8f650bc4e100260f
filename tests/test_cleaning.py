import pytest

from strandflow.operators import cleaning, lines


def graph(spark, rows):
    """rows: (edge, src, dst, n_kmers); every edge is its own inverse here."""
    return spark.createDataFrame([(e, a, b, n, e, "A" * (n + 3)) for e, a, b, n in rows], "edge string, src string, dst string, n_kmers int, inv string, seq string")


def names(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("s,want", [((0, 10), ["a"]), ((0, 9), []), ((1, 20), [])])
def test_unsupported_branch(spark, s, want):
    edges = graph(spark, [("a", "1", "2", 5), ("b", "1", "3", 5)])
    support = spark.createDataFrame([("a", s[0]), ("b", s[1])], "edge string, support int")
    assert names(cleaning.unsupported_branches(edges, support)) == want


def test_branch_scores(spark):
    votes = [("v", "1", 60), ("v", "1", 50), ("v", "2", 10), ("w", "1", 60), ("w", "1", 50), ("w", "2", 30)]
    got = cleaning.branch_scores(spark.createDataFrame(votes, "vertex string, branch string, score int"))
    assert [tuple(r) for r in got.collect()] == [("v", "2")]


@pytest.mark.parametrize("reach,want", [(500, ["h"]), (499, [])])
def test_hanging_end(spark, reach, want):
    edges = graph(spark, [("h", "1", "2", 50), ("g", "1", "3", reach - 10), ("t", "3", "4", 10)])
    assert names(cleaning.hanging_ends(edges)) == want


def test_hanging_end_keeps_circles(spark):
    edges = graph(spark, [("h", "1", "2", 50), ("loop", "2", "2", 5), ("g", "1", "3", 900)])
    assert names(cleaning.hanging_ends(edges)) == []


@pytest.mark.parametrize("s,want", [((4, 0, 0, 3), True), ((0, 4, 3, 0), False), ((4, 1, 0, 3), True), ((4, 2, 0, 3), None)])
def test_pull_apart(spark, s, want):
    got = [r.straight for r in cleaning.separated_repeats(spark.createDataFrame([("r", *s)], "repeat string, s11 int, s12 int, s21 int, s22 int")).collect()]
    assert got == ([] if want is None else [want])


def test_bubbles_repeats_loops_plasmid(spark):
    bubble = graph(spark, [("in", "0", "1", 9), ("a", "1", "2", 5), ("b", "1", "2", 6), ("out", "2", "3", 9)])
    assert [tuple(r) for r in cleaning.simple_bubbles(bubble).collect()] == [("1", "2", "a", "b")]
    weights = spark.createDataFrame([("a", 2.0), ("b", 60.0)], "edge string, weight double")
    assert names(cleaning.popped_bubbles(cleaning.simple_bubbles(bubble), bubble, weights)) == ["a"]
    even = spark.createDataFrame([("a", 9.0), ("b", 12.0)], "edge string, weight double")
    assert names(cleaning.popped_bubbles(cleaning.simple_bubbles(bubble), bubble, even)) == []
    rep = graph(spark, [("i1", "0", "2", 9), ("i2", "1", "2", 9), ("r", "2", "3", 5), ("o1", "3", "4", 9), ("o2", "3", "5", 9)])
    assert [tuple(r) for r in cleaning.canonical_repeats(rep).collect()] == [("r", "i1", "i2", "o1", "o2")]
    loop = graph(spark, [("p", "0", "1", 900), ("r", "1", "2", 50), ("l", "2", "1", 60), ("n", "2", "3", 900)])
    assert [tuple(r) for r in cleaning.unrollable_loops(loop).collect()] == [("p", "r", "l", "n")]
    plasmid = graph(spark, [("e1", "v", "w", 9), ("e2", "v", "w", 9), ("f", "w", "v", 9)])
    pairs = spark.createDataFrame([("e1", 10), ("e2", 12), ("f", 30)], "edge string, pairs int")
    links = spark.createDataFrame([("e2", "e1", 2)], "e1 string, e2 string, n int")
    assert [tuple(r) for r in cleaning.plasmid_patterns(plasmid, pairs, links).collect()] == [("e1", "e2", "f")]
    assert cleaning.plasmid_patterns(plasmid, pairs, links, least_pairs=11).count() == 0


def test_small_components(spark):
    edges = graph(spark, [("a", "1", "2", 50), ("b", "3", "4", 1500), ("c", "5", "5", 300), ("d", "6", "6", 100)])
    assert names(cleaning.small_components(edges)) == ["a", "d"]


def test_merge_and_paths(spark):
    edges = graph(spark, [("a", "1", "2", 5), ("b", "2", "3", 7), ("c", "3", "4", 2), ("d", "4", "5", 1), ("e", "4", "6", 1)])
    moves = cleaning.merge_chains(edges, 4)
    assert sorted(map(tuple, moves.collect())) == [("a", "a", 0), ("b", "a", 5), ("c", "a", 12), ("d", "d", 0), ("e", "e", 0)]
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "e")], "read_id long, pos int, edge string")
    assert sorted(map(tuple, cleaning.moved_paths(steps, moves).collect())) == [(1, 0, "a"), (1, 1, "e")]
    gone = cleaning.delete_edges(edges, spark.createDataFrame([("b",)], "edge string"))
    assert names(gone) == ["a", "c", "d", "e"]


def test_cells_and_lines(spark):
    edges = graph(spark, [("in", "0", "1", 100), ("a", "1", "2", 30), ("b1", "1", "x", 10), ("b2", "x", "2", 30), ("mid", "2", "3", 50), ("c", "3", "4", 7), ("d", "3", "4", 8), ("e", "3", "4", 12), ("out", "4", "5", 9), ("other", "8", "9", 3)])
    cells = lines.find_cells(edges)
    assert sorted((r.entry, r.exit, [list(p) for p in r.paths]) for r in cells.collect()) == [("1", "2", [["a"], ["b1", "b2"]]), ("3", "4", [["c"], ["d"], ["e"]])]
    found = lines.find_lines(edges, cells)
    assert sorted({r.seg for r in found.where("line = 'in'").collect()}) == [0, 1, 2, 3, 4]
    assert found.count() == len({r.edge for r in found.collect()}) == 10
    assert {r.line: r.len for r in lines.line_lengths(found, edges).collect()} == {"in": 100 + 35 + 50 + 8 + 9, "other": 3}


def test_open_cell_is_none(spark):
    edges = graph(spark, [("in", "0", "1", 1), ("a", "1", "2", 3), ("b1", "1", "x", 1), ("b2", "x", "2", 3), ("leak", "7", "x", 1), ("out", "2", "3", 5)])
    assert lines.find_cells(edges).count() == 0


@pytest.mark.parametrize("n,cov,want", [(2, 10, 0), (3, 12, 1), (3, 12.5, 0)])
def test_scaffold_acceptance(spark, n, cov, want):
    links = spark.createDataFrame([("a", "b", n)], "e1 string, e2 string, n int")
    ends = spark.createDataFrame([("a", 5000, 10.0), ("b", 6000, float(cov))], "edge string, len int, cov double")
    assert lines.accepted_gaps(links, ends).count() == want


def test_coverage_mass(spark):
    data = [(f"l{i}", 10.0 + 0.37 * i, 100 + i) for i in range(40)] + [("z", 0.0, 5)]
    got = {r.line: r.mass for r in lines.coverage_mass(spark.createDataFrame(data, "line string, cov double, len int")).collect()}
    want = {a: sum(m for _, d, m in data if c * 0.92 <= d <= c * 1.08) for a, c, _ in data if c > 0}
    assert got == want


def test_small_components_keep_circles_and_long_ways(spark):
    circle = [("a", "1", "2", 90), ("b", "2", "3", 100), ("c", "3", "2", 100)]  # a source and a circle
    long_ = [("d", "5", "6", 600), ("e", "6", "7", 600)]
    short = [("f", "8", "9", 300), ("g", "9", "10", 400)]
    tiny = [("h", "11", "11", 50)]
    assert names(cleaning.small_components(graph(spark, circle + long_ + short + tiny))) == ["f", "g", "h"]
