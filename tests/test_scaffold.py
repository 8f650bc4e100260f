from strandflow.operators import scaffold


def test_tours_pairs_and_clusters(spark):
    of = spark.createDataFrame([("a", "A", 900), ("b", "A", 900), ("c", "B", 900), ("d", "C", 100)], "edge string, line string, len int")
    steps = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "d"), (1, 0, "c"), (2, 0, "a"), (3, 0, "a"), (3, 1, "c")], "read_id long, pos int, edge string")
    tours = scaffold.line_tours(steps, of)
    assert sorted(map(tuple, tours.collect())) == [(0, 0, "A"), (1, 0, "B"), (2, 0, "A"), (3, 0, "A"), (3, 1, "B")]
    assert [tuple(r) for r in scaffold.near_pairs(tours).collect()] == [("A", "B", 1)]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")] + [("h", f"n{i}") for i in range(25)], "e1 string, e2 string")
    got = {(r.cluster, r.edge) for r in scaffold.link_clusters(links).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}


def test_far_links_and_gaps(spark):
    e = [("a", "1", "2"), ("b", "2", "3"), ("c", "3", "4"), ("d", "4", "5"), ("z", "8", "9")]
    edges = spark.createDataFrame([(n, s, t, "AC", 1, n) for n, s, t in e], "edge string, src string, dst string, seq string, n_kmers int, inv string")
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 3), ("d", "a", 3), ("a", "z", 3), ("b", "a", 1)], "e1 string, e2 string, n int")
    far = scaffold.far_links(links, edges, 1)
    assert sorted((r.e1, r.e2) for r in far.collect()) == [("a", "z"), ("d", "a")]
    more = scaffold.with_gap_edges(edges, far.where("e2 = 'z'"))
    gap = more.where("n_kmers = 0").first()
    assert (gap.src, gap.dst, gap.seq, gap.inv) == ("2", "8", "", "gap:z:a")


def test_copy_number_peak(spark):
    rows = [(c / 2, 100 - abs(c - 40) * 9) for c in range(30, 51)] + [(40 + c / 2, 30 - abs(c) * 2) for c in range(-6, 7)]
    hist = spark.createDataFrame([(float(c), float(max(m, 0))) for c, m in rows], "cov double, mass double")
    assert scaffold.copy_number_peak(hist) == 20.0 and scaffold.copy_number_peak(hist.where("false")) is None
