"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__

DATA = os.environ.get("STRANDFLOW_TEST_DATA", "/root/testdata/sf0.001")
QUICK = (
    "p1_found", "p1_loaded_sam", "p1_loaded_variants", "p4_found", "p4_figures", "p5_found", "p5_covered", "kmer_histogram", "kmer_context", "kmer_good_context", "quality_trim",
    "kmer_bispectrum", "palindromes", "homopolymer_runs", "n50_by_sample", "nx_table", "ngx_table", "interval_depths", "interval_stab_counts", "latest_view_before_purchase",
    "sliding_event_values", "coverage_rollup", "placed_reads_index", "reads_placed_or_not", "fragment_distribution", "pair_links", "pair_mismatch_score", "probability_tails", "efasta_sites",
    "fraction_subsample", "document_tokens", "reads_with_library", "p1_reasons", "genome_size", "edge_support", "edge_coverage", "small_components", "involution_violations", "streamed_event_windows", "streamed_kmer_counts",
    "kmer_range_clean", "kmer_saturated", "kmer_odd_canonical", "kmer_locations", "sequence_features", "mate_overlaps", "read_length_distribution", "probability_table", "combined_estimates", "best_price_cutoff",
    "sampled_orders", "linear_fits", "coverage_cube", "coverage_grouping_sets", "event_properties", "widest_names", "nearest_band", "plain_sql", "n50_by_function", "expanded_ranges", "copy_number_share", "shared_pairs",
    "simple_bubbles", "canonical_repeats", "unrollable_loops", "circle_sequences", "planted_steps", "path_violations", "read_layout", "path_fragments", "branch_votes", "branches_cut", "bubbles_popped", "repeat_scores",
    "repeats_apart", "repeat_paths", "loops_unrolled", "chains_merged", "merged_read_paths", "plasmids_unwound", "lone_edges", "planted_support", "unsupported_branches", "line_stats",
)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect()) == want


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert {f"p{n}_found" for n in (1, 4, 5)} <= set(names)
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).columns == ["gid", "gap_start", "gap_stop"]
