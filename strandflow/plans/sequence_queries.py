"""Queries over reads, k-mers and the sequence graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.dna import canonical_form, gc_count, revcomp
from strandflow.operators import graph, kmers
from strandflow.session import written_once
from strandflow.tables import table

K = 24
MIN_FREQ = 2
MIN_QUAL = 20


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return kmers.clean_reads(table(spark, d, "oreads"))


def _table(spark: SparkSession, d: str, min_freq: int = MIN_FREQ) -> DataFrame:
    return kmers.kmer_table(_reads(spark, d), K, min_freq=min_freq)


def kmer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kmers.histogram(_table(spark, d, 1))


def kmer_histogram_25(spark: SparkSession, d: str) -> DataFrame:
    return kmers.histogram(kmers.kmer_table(_reads(spark, d), 25))


def kmer_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, 4).select("kmer", "n")


def kmer_context(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d)


def kmer_good_context(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_table(_reads(spark, d), K, min_qual=MIN_QUAL, min_freq=MIN_FREQ)


def kmer_adjacency_pruned(spark: SparkSession, d: str) -> DataFrame:
    return kmers.prune_adjacencies(_table(spark, d))


def quality_trim(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_id", kmers.good_length(F.col("qual"), K, MIN_QUAL).alias("good"))


def kmer_quality_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return kmers.quality_spectrum(_reads(spark, d), K)


def _bispectrum(spark: SparkSession, d: str, cap: int | None) -> DataFrame:
    reads = _reads(spark, d)
    return kmers.bispectrum(kmers.kmer_table(reads.where("sample like 'smpA%'"), K), kmers.kmer_table(reads.where("sample like 'smpB%'"), K), cap)


def kmer_bispectrum(spark: SparkSession, d: str) -> DataFrame:
    return _bispectrum(spark, d, 20)


def kmer_bispectrum_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same with a bin for every pair of counts."""
    return _bispectrum(spark, d, None)


def kmer_affix_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return kmers.affix_spectrum(_table(spark, d, 1))


def kmer_setops(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the intersection, the differences and the union of two samples' k-mer sets."""
    rows = _reads(spark, d).select("read_id", "seq", *[F.col("sample").like(f"smp{x}%").alias(x) for x in "AB"]).where("A or B")
    return kmers.set_sizes(rows, K)


def shaped_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = kmers.shaped_kmers(_reads(spark, d), "110110110110")
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def genome_size(spark: SparkSession, d: str) -> DataFrame:
    return kmers.genome_size(kmers.histogram(_table(spark, d, 1), cap=None))


def canonical_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many k-mer entries of kmer_nodes stand on which strand."""
    rows = table(spark, d, "kmer_nodes").where(F.col("kmer").rlike(r"^[ACGTacgt]{24}\z")).select(canonical_form(F.upper("kmer")).alias("form"))
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def palindromes(spark: SparkSession, d: str) -> DataFrame:
    """Palindromic words of eight bases in the reads, with how often each stands there."""
    rows = kmers.read_kmers(_reads(spark, d), 8)
    return rows.where(F.col("fwd") == revcomp(F.col("fwd"))).groupBy(F.col("fwd").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def read_gc(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_id", F.length("seq").alias("len"), gc_count(F.col("seq")).alias("gc"))


def homopolymer_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one base by base and length, over all reads."""
    runs = F.regexp_extract_all(F.col("seq"), F.lit(r"(A+|C+|G+|T+)"), F.lit(1))
    rows = _reads(spark, d).select(F.explode(runs).alias("run"))
    return rows.groupBy(F.substring("run", 1, 1).alias("base"), F.length("run").alias("len")).agg(F.count(F.lit(1)).alias("runs"))


def homopolymer_capped(spark: SparkSession, d: str) -> DataFrame:
    """Every read with runs of more than three of a base cut to three."""
    seq = F.col("seq")
    for base in "ACGT":
        seq = F.regexp_replace(seq, f"{base}{{4,}}", base * 3)
    return _reads(spark, d).select("read_id", seq.alias("capped"))


def unipath_heads(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.oriented(kmers.prune_adjacencies(_table(spark, d)))
    return nodes.join(graph.links(nodes).select(F.col("v").alias("node")), "node", "left_anti").select("node")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the reads of one folder; built once a session, as many queries stand on it."""
    return written_once(spark, ("edges", d), lambda: (graph.graph_edges(graph.unipaths(kmers.prune_adjacencies(_table(spark, d))), K),))[0]


def unipaths(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("not circle").select("edge", "seq", "n_kmers", "inv")


def unipath_circles(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("circle").agg(F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("nodes"))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertex_degrees(_edges(spark, d).where("not circle"))


def fork_classes(spark: SparkSession, d: str) -> DataFrame:
    """Edges and k-mers by how the vertex at their end branches."""
    edges = _edges(spark, d).where("not circle")
    deg = graph.vertex_degrees(edges)
    o, i = F.col("n_out"), F.col("n_in")
    name = F.when(o == 0, "nothing_fw").when((o == 1) & (i == 1), "line_fw").when(o == 1, "split_fw").when(i == 1, "join_fw").otherwise("join_split_fw")
    rows = edges.join(deg, edges.dst == deg.vertex).select(name.alias("fork"), "n_kmers")
    return rows.groupBy("fork").agg(F.count(F.lit(1)).alias("edges"), F.sum("n_kmers").cast("bigint").alias("kmers"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected components of the edges, joined with their inverses, by number of edges."""
    edges = _edges(spark, d).where("not circle")
    found = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    sized = edges.join(found, edges.src == found.node).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    return sized.groupBy("edges").agg(F.count(F.lit(1)).alias("components"))


def involution_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.involution_violations(_edges(spark, d))


def gfa_segments(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.canonical_edges(_edges(spark, d).where("not circle"))
    return edges.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("edge"), F.col("edge")), "seq").alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        kmer_histogram, kmer_histogram_25, kmer_filtered, kmer_context, kmer_good_context, kmer_adjacency_pruned, quality_trim, kmer_quality_spectrum, kmer_bispectrum, kmer_bispectrum_exact, kmer_affix_spectrum,
        kmer_setops, shaped_kmer_counts, genome_size, canonical_forms, palindromes, read_gc, homopolymer_runs, homopolymer_capped, unipath_heads, unipaths, unipath_circles, graph_vertices,
        fork_classes, component_sizes, involution_violations, gfa_segments,
    )
}

READS = "reads as (select distinct read_id, translate(upper(seq), 'N', 'A') seq, coalesce(qual, []::int[]) qual, sample from oreads where read_id is not null and length(seq) > 0)"
_BIT = "(case {0} when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 else 0 end)"
_CBIT = "(case {0} when 'T' then 1 when 'G' then 2 when 'C' then 4 when 'A' then 8 else 0 end)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def kmer_cte(name: str, source: str, k: int, having: str = "true") -> str:
    return f"""{name} as (select least(fwd, rev) kmer, count(*) n,
      bit_or(case when rev < fwd then {_CBIT.format('a')} else {_BIT.format('b')} end) pred, bit_or(case when rev < fwd then {_CBIT.format('b')} else {_BIT.format('a')} end) succ
      from (select fwd, {rc('fwd')} rev, b, a from (select substr(seq, p + 1, {k}) fwd, case when p > 0 then substr(seq, p, 1) else '' end b, substr(seq, p + {k + 1}, 1) a
        from (select seq, unnest(range(length(seq) - {k - 1})) p from {source} where length(seq) >= {k}))) group by 1 having {having})"""


_GOOD = f"""good as (select read_id, cast(coalesce(max(case when i - bad >= {K} then i end), 0) as int) good from (
    select read_id, i, max(case when q >= {MIN_QUAL} then 0 else i end) over (partition by read_id order by i rows unbounded preceding) bad
    from (select read_id, unnest(range(1, len(qual) + 1)) i, unnest(qual) q from reads)) group by read_id)"""
_TRIMMED = "cutreads as (select reads.read_id, substr(seq, 1, least(good, length(seq))) seq from reads join good using (read_id))"
_CIRC = "(case when {0} = 1 then 'A' when {0} = 2 then 'C' when {0} = 4 then 'G' else 'T' end)"
_PRUNED = f"""letters as (select unnest(['A','C','G','T']) letter, unnest([1,2,4,8]) bit),
  nb as (select kmer, 'succ' side, bit, least(o, {rc('o')}) other from (select kmer, bit, substr(kmer, 2) || letter o from kt, letters where succ & bit > 0)
    union all select kmer, 'pred', bit, least(o, {rc('o')}) from (select kmer, bit, letter || substr(kmer, 1, {K - 1}) o from kt, letters where pred & bit > 0)),
  pr as (select kt.kmer, kt.n, coalesce(bit_or(case when side = 'pred' then bit end), 0) pred, coalesce(bit_or(case when side = 'succ' then bit end), 0) succ
    from kt left join (select * from nb where other in (select kmer from kt)) x using (kmer) group by kt.kmer, kt.n)"""
_CB = "((({0} & 1) << 3) | (({0} & 2) << 1) | (({0} & 4) >> 1) | (({0} & 8) >> 3))"
_GRAPH = f"""with recursive {READS}, {kmer_cte('kt', 'reads', K, f'count(*) >= {MIN_FREQ}')}, {_PRUNED},
  nodes as (select kmer node, pred, succ, kmer = {rc('kmer')} pal from pr union all select {rc('kmer')}, {_CB.format('succ')}, {_CB.format('pred')}, false from pr where kmer <> {rc('kmer')}),
  links as (select u, v from (select node u, substr(node, 2) || {_CIRC.format('succ')} v from nodes where bit_count(succ) = 1 and not pal)
    where v in (select node from nodes where bit_count(pred) = 1 and not pal)),
  heads as (select node from nodes where node not in (select v from links)),
  walk(head, node, rank) as (select node, node, 0 from heads union all select head, v, rank + 1 from walk join links on node = u),
  paths as (select head edge, head || coalesce(string_agg(case when rank > 0 then substr(node, {K}) end, '' order by rank), '') seq, cast(count(*) as int) n_kmers, {rc('arg_max(node, rank)')} inv from walk group by head),
  edges as (select *, substr(seq, 1, {K - 1}) src, substr(seq, length(seq) - {K - 2}) dst from paths),
  deg as (select vertex, sum(i) n_in, sum(o) n_out from (select src vertex, 0 i, 1 o from edges union all select dst, 1, 0 from edges) group by vertex)"""

COMPONENTS = """und as (select src a, dst b from edges union select dst, src from edges), reach(a, b) as (select a, a from und union select reach.a, und.b from reach join und on reach.b = und.a),
  comp as (select a vertex, min(b) component from reach group by a)"""
_A = "select * from reads where sample like 'smpA%'"
_B = "select * from reads where sample like 'smpB%'"
_AB = f"with {READS}, ra as ({_A}), rb as ({_B}), {kmer_cte('a', 'ra', K)}, {kmer_cte('b', 'rb', K)}"
_ONE = f"with {READS}, {kmer_cte('kt', 'reads', K)}"
_TWO = f"with {READS}, {kmer_cte('kt', 'reads', K, f'count(*) >= {MIN_FREQ}')}"

SQL = {
    "kmer_histogram": f"{_ONE} select least(n, 100) n, count(*) kmers from kt group by 1",
    "kmer_histogram_25": f"with {READS}, {kmer_cte('kt', 'reads', 25)} select least(n, 100) n, count(*) kmers from kt group by 1",
    "kmer_filtered": f"{_ONE} select kmer, n from kt where n >= 4",
    "kmer_context": f"{_TWO} select * from kt",
    "kmer_good_context": f"with {READS}, {_GOOD}, {_TRIMMED}, longer as (select * from cutreads where length(seq) > {K}), {kmer_cte('kt', 'longer', K, f'count(*) >= {MIN_FREQ}')} select * from kt",
    "kmer_adjacency_pruned": f"{_TWO}, {_PRUNED} select kmer, n, pred, succ from pr",
    "quality_trim": f"with {READS}, {_GOOD} select read_id, coalesce(good, 0) good from (select read_id from reads) left join good using (read_id)",
    "kmer_quality_spectrum": f"""with {READS} select min_qual, count(*) kmers from (select case when len(qual) >= p + {K} then list_min(qual[p + 1 : p + {K}]) else 0 end min_qual
        from (select qual, unnest(range(length(seq) - {K - 1})) p from reads where length(seq) >= {K})) group by 1""",
    "kmer_bispectrum": f"{_AB} select least(coalesce(a.n, 0), 20) na, least(coalesce(b.n, 0), 20) nb, count(*) kmers from a full join b using (kmer) group by 1, 2",
    "kmer_bispectrum_exact": f"{_AB} select coalesce(a.n, 0) na, coalesce(b.n, 0) nb, count(*) kmers from a full join b using (kmer) group by 1, 2",
    "kmer_affix_spectrum": f"{_ONE} select bit_count(pred) n_pred, bit_count(succ) n_succ, count(*) kmers, cast(sum(n) as bigint) total from kt group by 1, 2",
    "kmer_setops": f"""{_AB} select 'both' part, count(*) kmers from (select kmer from a intersect select kmer from b) union all select 'a_only', count(*) from (select kmer from a except select kmer from b)
        union all select 'b_only', count(*) from (select kmer from b except select kmer from a) union all select 'any', count(*) from (select kmer from a union select kmer from b)""",
    "shaped_kmer_counts": f"""with {READS} select kmer, count(*) n from (select {' || '.join(f'substr(seq, p + {i}, 1)' for i in (1, 2, 4, 5, 7, 8, 10, 11))} kmer
        from (select seq, unnest(range(length(seq) - 11)) p from reads where length(seq) >= 12)) group by 1""",
    "genome_size": f"""{_ONE}, h as (select n, count(*) kmers from kt group by 1), x as (select *, lead(kmers) over (order by n) nxt from h), v as (select coalesce(min(n) filter (nxt >= kmers), 1) valley from x)
        select arg_max(n, (kmers, -n)) peak, cast(sum(n * kmers) as bigint) total, cast(floor(sum(n * kmers) / arg_max(n, (kmers, -n))) as bigint) size from h, v where n >= valley""",
    "canonical_forms": f"""select case when u < {rc('u')} then 'FWD' when u > {rc('u')} then 'REV' else 'PALINDROME' end form, count(*) n
        from (select upper(kmer) u from kmer_nodes where regexp_full_match(kmer, '[ACGTacgt]{{24}}')) group by 1""",
    "palindromes": f"with {READS} select fwd kmer, count(*) n from (select substr(seq, p + 1, 8) fwd from (select seq, unnest(range(length(seq) - 7)) p from reads where length(seq) >= 8)) where fwd = {rc('fwd')} group by 1",
    "read_gc": f"with {READS} select read_id, cast(length(seq) as int) len, cast(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) as int) gc from reads",
    "homopolymer_runs": f"with {READS} select run[1] base, cast(length(run) as int) len, count(*) runs from (select unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) run from reads) group by 1, 2",
    "homopolymer_capped": f"with {READS} select read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A{{4,}}', 'AAA', 'g'), 'C{{4,}}', 'CCC', 'g'), 'G{{4,}}', 'GGG', 'g'), 'T{{4,}}', 'TTT', 'g') capped from reads",
    "unipath_heads": f"{_GRAPH} select node from heads",
    "unipaths": f"{_GRAPH} select edge, seq, n_kmers, inv from edges",
    "unipath_circles": f"{_GRAPH} select count(*) nodes from nodes where node not in (select node from walk)",
    "graph_vertices": f"{_GRAPH} select vertex, n_in, n_out from deg",
    "fork_classes": f"""{_GRAPH} select case when n_out = 0 then 'nothing_fw' when n_out = 1 and n_in = 1 then 'line_fw' when n_out = 1 then 'split_fw' when n_in = 1 then 'join_fw' else 'join_split_fw' end fork,
        count(*) edges, cast(sum(n_kmers) as bigint) kmers from edges join deg on dst = vertex group by 1""",
    "component_sizes": f"{_GRAPH}, {COMPONENTS} select edges, count(*) components from (select component, count(*) edges from edges join comp on vertex = src group by 1) group by 1",
    "involution_violations": f"""{_GRAPH}, v as (select e.edge, b.edge twin, b.inv back, b.seq <> {rc('e.seq')} other, b.src <> {rc('e.dst')} or b.dst <> {rc('e.src')} torn from edges e left join edges b on b.edge = e.inv)
        select 'inverse missing' rule, count(*) filter (twin is null) n from v union all select 'inverse of inverse', count(*) filter (back <> edge) from v
        union all select 'sequence', count(*) filter (other) from v union all select 'ends', count(*) filter (torn) from v""",
    "gfa_segments": f"{_GRAPH} select 'S' || chr(9) || 'edge' || edge || chr(9) || seq line from edges where edge <= inv",
}
