import random

from strandflow.operators import digraph, graph, kmers, placement, repath


def frame(spark, pairs):
    return spark.createDataFrame([(a + b, a, b, w) for a, b, w in pairs], "edge string, src string, dst string, n_kmers int")


def brute_reach(pairs):
    out = {}
    for a, b, _ in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for v in out:
        seen, todo = set(), [v]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[v] = seen
    return reach


def test_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(a, b, w) for a, b, w in {(rng.choice("abcdefghij"), rng.choice("abcdefghij"), 1) for _ in range(16)}]
    edges, reach = frame(spark, pairs), brute_reach(pairs)
    assert {(r.a, r.b) for r in digraph.closure(edges.selectExpr("src a", "dst b")).collect()} == {(a, b) for a in reach for b in reach[a]}
    want = {v: min([v, *[u for u in reach if u in reach[v] and v in reach[u]]]) for v in reach}
    assert {r.vertex: r.component for r in digraph.strong_components(edges).collect()} == want
    got = {(r.start, r.vertex) for r in digraph.hops_from(edges, edges.selectExpr("src vertex")).collect()}
    assert got == {(a, b) for a in {p[0] for p in pairs} for b in reach[a] | {a}}
    assert {r.vertex for r in digraph.sources(edges).collect()} == {p[0] for p in pairs} - {p[1] for p in pairs}
    assert {r.vertex for r in digraph.sinks(edges).collect()} == {p[1] for p in pairs} - {p[0] for p in pairs}


def test_ways_and_lengths(spark):
    edges = frame(spark, [("a", "b", 5), ("b", "d", 5), ("a", "c", 1), ("c", "d", 2), ("d", "e", 1), ("e", "b", 1)])
    a, e = edges.where("src = 'a'").selectExpr("src vertex").distinct(), edges.where("dst = 'e'").selectExpr("dst vertex")
    assert {r.vertex: r.length for r in digraph.shortest(edges, a).collect()} == {"a": 0, "b": 5, "c": 1, "d": 3, "e": 4}
    assert {r.vertex for r in digraph.shortest(edges, a, 3).collect()} == {"a", "c", "d"}
    assert sorted(list(r.path) for r in digraph.walks(edges, a, e, 5).collect()) == [["ab", "bd", "de"], ["ac", "cd", "de"]]
    assert {r.vertex for r in digraph.on_circles(edges).collect()} == {"b", "d", "e"} and not digraph.is_acyclic(edges)
    assert digraph.is_acyclic(edges.where("src <> 'e'"))


def test_repath_and_extend(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared, seqs = text(20), []
    for _ in range(2):
        seqs.append(text(60) + shared + text(60))
    data = [(i, s, [40] * len(s)) for i, s in enumerate(seqs)]
    reads = spark.createDataFrame(data, "read_id long, seq string, qual array<int>")
    edges = graph.graph_edges(graph.unipaths(kmers.prune_adjacencies(kmers.kmer_table(reads, 12))), 12)
    edges.cache()
    paths = placement.read_paths(placement.place_reads(reads, edges, 12), edges)
    assert all(len(r.edges) == 3 for r in paths.collect())
    new, moved = repath.repath(paths, edges, 12, 30)
    assert sorted(len(r.seq) for r in new.collect()) == [140] * 4 and all(len(r.edges) == 1 for r in moved.collect())
    named = {r.edge: r.seq for r in new.collect()}
    assert {r.read_id: named[r.edges[0]] for r in moved.collect()} == dict(enumerate(seqs))
    cut_short = paths.selectExpr("read_id", "off", "slice(edges, 1, 1) edges")
    back = {r.read_id: list(r.edges) for r in repath.extend_paths(cut_short, edges, reads, 12).collect()}
    assert back == {r.read_id: list(r.edges) for r in paths.collect()}
