"""Queries over the structure of the sequence graph, text forms, parsing helpers and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import efasta
from strandflow.operators import cleaning, lines, placement
from strandflow.operators.kmers import clean_reads
from strandflow.operators.rejects import VARIANT, load_or_reject
from strandflow.plans.core_problems import _VAR_OK
from strandflow.plans.sequence_queries import _GRAPH, COMPONENTS, K, READS, _edges, _reads, kmer_cte
from strandflow.sources import sinks
from strandflow.sources.formats import in_fraction
from strandflow.streaming import counts
from strandflow.tables import table


def _straight(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("not circle").select("edge", "src", "dst", "seq", "n_kmers", "inv")


def gfa_links(spark: SparkSession, d: str) -> DataFrame:
    return sinks.gfa_links(_straight(spark, d))


def edge_support(spark: SparkSession, d: str) -> DataFrame:
    edges = _straight(spark, d)
    steps = placement.path_steps(placement.read_paths(placement.place_reads(_reads(spark, d), edges, K), edges))
    return placement.edge_support(steps, edges)


def hanging_ends(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.hanging_ends(_straight(spark, d), max_del=60, ratio=2)


def small_components(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.small_components(_straight(spark, d), max_edge=60, max_total=100)


def merged_chains(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after unsupported short branches go and chains of the rest merge: name and k-mers."""
    edges = _straight(spark, d)
    short = cleaning.hanging_ends(edges, max_del=60, ratio=2)
    kept = cleaning.delete_edges(edges, short)
    moves = cleaning.merge_chains(kept, K)
    return moves.join(kept.select(F.col("edge").alias("old"), "n_kmers"), "old").groupBy("edge").agg(F.sum("n_kmers").cast("bigint").alias("n_kmers"), F.count(F.lit(1)).alias("parts"))


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    edges = _straight(spark, d)
    return lines.line_lengths(lines.find_lines(edges, lines.find_cells(edges)), edges)


def efasta_sites(spark: SparkSession, d: str) -> DataFrame:
    """Every valid variant as a bubble, with its expansions, length range and kind."""
    good, _ = load_or_reject(table(spark, d, "variant_lines"), VARIANT)
    rows = sinks.efasta(good.where(F.forall("alts", lambda a: a.rlike("^[ACGTN]+$"))), "ref", "alts")
    b = F.col("bubble")
    return rows.select(
        "line_id", "bubble", F.array_join(efasta.expand(b), "|").alias("expanded"), efasta.length_range(b)["min"].alias("shortest"), efasta.length_range(b)["max"].alias("longest"), efasta.ambiguities(b)["snps"].alias("snps")
    )


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokenizing: pieces between blanks by document source."""
    rows = table(spark, d, "documents").where("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)"), F.lit(1))).alias("t"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("t").alias("distinct_tokens"))


def reads_with_library(spark: SparkSession, d: str) -> DataFrame:
    """Left outer join of reads to their libraries, a default where there is none."""
    libs = table(spark, d, "read_groups").groupBy("sample").agg(F.min("lib").alias("lib"), F.max("frac").alias("frac"))
    rows = _reads(spark, d).join(F.broadcast(libs), "sample", "left")  # read_groups is fixed at 18 rows
    return rows.groupBy("sample", F.coalesce("lib", F.lit("none")).alias("lib"), F.coalesce("frac", F.lit(1.0)).alias("frac")).agg(F.count(F.lit(1)).alias("reads"))


def streamed_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """One pass over all events, which lie in order of time, so that no row is late; lateness is tested on made-up files."""
    stream = counts.event_windows(counts.streamed(spark, f"{d}/events.parquet"), late="10 minutes")
    return counts.run_to_end(stream, ["start", "event_type"])


def streamed_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """12-mers of the reads; reads delivered again up to 90 days later count once."""
    reads = counts.once(counts.streamed(spark, f"{d}/oreads.parquet").where("read_id is not null"), "read_id", "loaded_at", "90 days")
    return counts.run_to_end(counts.kmer_counts(reads, 12), ["kmer"])


def fraction_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Pairs kept of a quarter, pair numbers from 1."""
    pairs = _reads(spark, d).select((F.shiftright("read_id", 1) + 1).alias("pair")).distinct()
    return pairs.where(in_fraction(F.col("pair"), 0.25))


QUERIES = {
    f.__name__: f
    for f in (
        fraction_subsample, gfa_links, edge_support, hanging_ends, small_components, merged_chains, line_lengths, efasta_sites, document_tokens, reads_with_library,
        streamed_event_windows, streamed_kmer_counts,
    )
}



def far_cte(limit: int) -> str:
    """far: ways from a vertex to a sink, up to a limit; bad: vertices with a longer way or one in a circle."""
    return f"""far(vertex, reach) as (select distinct dst, 0 from edges where dst not in (select src from edges) union
          select src, reach + n_kmers from far join edges on dst = vertex where reach + n_kmers <= {limit}),
        bad(vertex) as (select v from (select src v from edges union select dst from edges) where v not in (select vertex from far)
          union select src from edges join far on dst = vertex where reach + n_kmers > {limit} union select src from edges join bad on dst = vertex)"""


_HANGING = f"""{far_cte(120)},
        r as (select v, case when v in (select vertex from bad) then 120 else (select max(reach) from far where vertex = v) end reach, v not in (select vertex from bad) complete from (select src v from edges union select dst from edges)),
        f as (select edge, src, n_kmers + reach dist, complete, max(n_kmers + reach) over (partition by src) best, count(*) over (partition by src) n from edges join r on r.v = dst),
        hang as (select edge from f where n > 1 and complete and dist <= 60 and best >= 2 * dist)"""
_DEG = "d as (select vertex v, n_in i, n_out o from deg)"
SQL = {
    "fraction_subsample": f"with {READS} select distinct (read_id >> 1) + 1 pair from reads where read_id < 2 or floor(((read_id >> 1) + 1) * 0.25) > floor((read_id >> 1) * 0.25)",
    "gfa_links": f"""{_GRAPH} select 'L' || chr(9) || 'edge' || least(a.edge, a.inv) || chr(9) || case when a.edge <= a.inv then '+' else '-' end || chr(9) || 'edge' || least(b.edge, b.inv) || chr(9)
        || case when b.edge <= b.inv then '+' else '-' end || chr(9) || '0M' line from edges a join edges b on a.dst = b.src where a.edge < b.inv or (a.edge = b.inv and b.edge <= a.inv)""",
    "hanging_ends": f"{_GRAPH}, {_HANGING} select edge from hang",
    "merged_chains": f"""{_GRAPH}, {_HANGING}, kept as (select * from edges where edge not in (select edge from hang) and inv not in (select edge from hang)),
        kdeg as (select vertex, sum(i) i, sum(o) o from (select src vertex, 0 i, 1 o from kept union all select dst, 1, 0 from kept) group by 1),
        mlink as (select a.edge u, b.edge v from kept a join kept b on a.dst = b.src join kdeg on vertex = a.dst where i = 1 and o = 1 and a.src <> a.dst and b.src <> b.dst),
        mwalk(head, edge) as (select edge, edge from kept where edge not in (select v from mlink) union all select head, v from mwalk join mlink on edge = u)
        select head edge, cast(sum(n_kmers) as bigint) n_kmers, count(*) parts from mwalk join kept using (edge) group by head""",
    "small_components": f"""{_GRAPH}, {COMPONENTS}, {far_cte(60)}, p as (select edge, src, dst, n_kmers, component from edges join comp on vertex = src),
        s as (select component, max(n_kmers) top, sum(n_kmers) total, max(case when src in (select vertex from bad) then 1 else 0 end) long from p group by 1)
        select edge from p join s using (component) where top <= 60 and (total < 100 or long = 0)""",
    "efasta_sites": f"""with v as (select line_id, v[4] ref, string_split(v[5], ',') alts from ({_VAR_OK}) where ok), g as (select line_id, list_concat([ref], alts) a from v where len(list_filter(alts, lambda x: not regexp_full_match(x, '[ACGTN]+'))) = 0)
        select line_id, '{{' || array_to_string(a, ',') || '}}' bubble, array_to_string(a, '|') expanded, cast(list_min(list_transform(a, lambda x: length(x))) as int) shortest,
          cast(list_max(list_transform(a, lambda x: length(x))) as int) longest, case when list_max(list_transform(a, lambda x: length(x))) = 1 then 1 else 0 end snps from g""",
    "document_tokens": r"select source, count(*) tokens, count(distinct t) distinct_tokens from (select source, unnest(regexp_extract_all(text, '[^ \t\r\n]+')) t from documents where text is not null) group by 1",
    "reads_with_library": f"""with {READS}, l as (select sample, min(lib) lib, max(frac) frac from read_groups group by 1)
        select sample, coalesce(lib, 'none') lib, coalesce(frac, 1.0) frac, count(*) reads from reads left join l using (sample) group by 1, 2, 3""",
    "streamed_event_windows": "select cast(time_bucket(interval 1 hour, ts) as timestamp) start, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2",
    "streamed_kmer_counts": f"with reads as (select distinct read_id, replace(seq, 'N', 'A') seq from oreads where read_id is not null), {kmer_cte('kt', 'reads', 12)} select kmer, n from kt",
}
