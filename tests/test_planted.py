"""Queries over planted graphs send no table through the driver, at Spark's own broadcast bound."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import graph, kmers, placement
from strandflow.plans import planted_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("planted")
    spark.range(24).select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    return str(d)


@pytest.mark.parametrize(
    "name",
    (
        "chains_merged", "loops_unrolled", "line_stats", "path_violations", "planted_steps", "plasmids_unwound", "repeat_scores", "unrollable_loops",
        "lone_edges", "merged_read_paths", "repeats_apart", "unsupported_branches", "canonical_repeats", "read_layout", "bubbles_popped", "planted_support",
    ),
)
def test_no_table_goes_through_the_driver(spark, folder, monkeypatch, name):
    kind, seen = type(spark.range(1)), []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    checkpoint = kind.checkpoint

    def watched(df, *args, **kwargs):
        out = checkpoint(df, *args, **kwargs)
        seen.append(plan(df))
        return out

    monkeypatch.setattr(kind, "checkpoint", watched)
    df = planted_queries.QUERIES[name](spark, folder)
    assert df.collect()
    assert not [p for p in [*seen, plan(df)] if "BroadcastExchange" in p]


def test_a_text_is_placed_once(spark, rows):
    text = "ACGTTGCATTAGCCGATAGGCTTACA"
    reads = spark.createDataFrame([(i, text[i % 3 :]) for i in range(30)] + [(30, "TTT"), (31, None)], "read_id long, seq string")
    edges = graph.graph_edges(graph.unipaths(kmers.prune_adjacencies(kmers.kmer_table(reads, 7))), 7)
    paths = placement.text_paths(reads, edges, 7)
    assert len(paths.collect()) == 30
    assert rows(paths) == rows(placement.read_paths(placement.place_reads(reads, edges, 7), edges))


def test_both_strands_are_made_in_one_pass(spark, rows):
    table = spark.createDataFrame([("AACC", 1, 8), ("ACGT", 2, 4)], "kmer string, pred int, succ int")
    both = graph.oriented(table)
    assert rows(both) == [("AACC", 1, 8, False), ("ACGT", 2, 4, True), ("GGTT", 1, 8, False)]
    assert "Union" not in both._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_texts_give_the_same_unipaths(spark, rows):
    rng = random.Random(5)
    long = "".join(rng.choice("ACGT") for _ in range(90))
    ring = "".join(rng.choice("ACGT") for _ in range(31))
    texts = [long[i : i + 40] for i in range(0, 51, 7)] + [long[:30] + "T" + long[30:50], long[20:70][::-1].translate(str.maketrans("ACGT", "TGCA")), ring * 3, ring[5:] + ring[:20], "A" * 12, "ACG" * 9, "ACGTACGTACGT", "AACGTT", "TTNACGGAC", "ACGT", None]
    texts += ["".join(rng.choice("AC") for _ in range(14)) for _ in range(6)]
    table = spark.createDataFrame([(t,) for t in texts], "seq string")
    for k in (6, 12):
        want = graph.unipaths(kmers.prune_adjacencies(kmers.kmer_table(table, k)))
        got = graph.text_unipaths(table, k)
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want)
        assert any(r[3] for r in rows(got))


def test_only_pieces_of_texts_are_chained(spark, folder, monkeypatch):
    chained, chains = [], graph.chains
    monkeypatch.setattr(graph, "chains", lambda nodes, link: (chained.append(nodes.count()), chains(nodes, link))[1])
    edges = planted_queries._circled(planted_queries._reads(spark, folder))
    assert chained[0] * 5 < edges.selectExpr("sum(n_kmers)").first()[0]
