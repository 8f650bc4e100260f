"""Queries over graphs with known features, made of every supplier's key, and their SQL.

Of each supplier a few sequences are made from digests of its key; together they hold a bubble, a
repeat, a loop, a tip, a plasmid or a circle. Pairs of reads are taken from them, more from the true
sequence than from the false one. Both engines make them by the same SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import cleaning, evidence, graph, lines, placement
from strandflow.plans.sequence_queries import _GRAPH, MIN_FREQ, READS, K, rc
from strandflow.plans.structure_queries import far_cte
from strandflow.session import cut_large, sort_merged, spread, written_once
from strandflow.tables import table

QUAL = 30
_COPIES = "cast(30 + s_suppkey % 5 * 6 as int)"
#: Of each kind its sequences as blocks of 32 letters, with how many pairs of reads each has.
KINDS = (
    (("x0, x1, 'A', x2, x3", _COPIES), ("x0, x1, 'C', x2, x3", "cast(1 + s_suppkey % 3 as int)")),  # bubble
    (("x0, x1, x2, x3, x4", "6"), ("x5, x6, x2, x7, x8", "7")),  # repeat
    (("x0, x1, x2, x5, x2, x3, x4", "9"),),  # loop
    (("x0, x1, x2, x3", _COPIES), ("x0, x1, substr(x5, 1, 30)", "1")),  # tip
    (("x0, x1, x2, x3, x0, x1, x4, x5, x0, x1", "14"),),  # plasmid
    (("x0, x1, x0", "5"),),  # circle
)


def _planted(each: str, kinds: tuple[int, ...]) -> str:
    """SQL of haps(k, hap, seq, copies) and reads(read_id, seq). each: how the dialect makes rows 0..copies-1."""
    blocks = ", ".join(f"translate(md5(concat(s_suppkey, ':{i}')), '0123456789abcdef', 'ACGTACGTACGTACGT') x{i}" for i in range(9))
    haps = " union all ".join(
        f"select s_suppkey k, {h} hap, concat({blocks_}) seq, {copies} copies from blocks where s_suppkey % {len(kinds)} = {i}" for i, kind in enumerate(kinds) for h, (blocks_, copies) in enumerate(KINDS[kind])
    )
    part = "cast(floor(length(seq) * 0.7) as int)"
    return f"""blocks as (select s_suppkey, {blocks} from supplier where s_suppkey is not null), haps as ({haps}), drawn as (select k, hap, seq, {each} j from haps),
      reads as (select ((k * 2 + hap) * 64 + j) * 2 read_id, substr(seq, 1, {part}) seq from drawn union all select ((k * 2 + hap) * 64 + j) * 2 + 1, {rc(f"substr(seq, length(seq) - {part} + 1)")} from drawn)"""


ALL = tuple(range(len(KINDS)))


def _reads(spark: SparkSession, d: str, kinds: tuple[int, ...] = ALL) -> DataFrame:
    rows = spark.sql(f"with {_planted('explode(sequence(0, copies - 1))', kinds)} select * from reads".replace("from supplier", "from {supplier}"), supplier=table(spark, d, "supplier"))
    return rows.select("read_id", "seq", F.array_repeat(F.lit(QUAL), F.length("seq")).alias("qual"))


def _circled(reads: DataFrame) -> DataFrame:
    """Edges, circles too; the graph does not ask how often a text or a k-mer occurs, so each text is cut up once."""
    return graph.graph_edges(graph.text_unipaths(spread(reads.select("seq").distinct()), K), K)


def _graph(spark: SparkSession, d: str, kinds: tuple[int, ...] = ALL) -> tuple[DataFrame, DataFrame]:
    """(reads, edges without circles), built once a session."""
    reads = written_once(spark, ("planted reads", d, kinds), lambda: (_reads(spark, d, kinds),))[0]
    edges = written_once(spark, ("planted edges", d, kinds), lambda: (_circled(reads),))[0]
    return reads, edges.where("not circle").select("edge", "src", "dst", "seq", "n_kmers", "inv")


def _laid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, edges, paths) of all kinds, built once a session."""
    reads, edges = _graph(spark, d)
    return reads, edges, written_once(spark, ("planted paths", d), lambda: (placement.text_paths(reads, edges, K),))[0]


def simple_bubbles(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.simple_bubbles(_graph(spark, d)[1])


def canonical_repeats(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.canonical_repeats(_graph(spark, d)[1])


def unrollable_loops(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.unrollable_loops(_graph(spark, d)[1], size=30)


def circle_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Smooth circles, each cut at its least k-mer, with the circle of the other strand."""
    edges = written_once(spark, ("planted edges", d, ALL), lambda: (_circled(_reads(spark, d)),))[0]
    return edges.where("circle").select("edge", "seq", "n_kmers", "inv")


def planted_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of all read paths, with where each edge begins on the read."""
    reads, edges, paths = _laid(spark, d)
    return evidence.step_starts(evidence.both_strands(paths, edges, reads, K), edges).select("read_id", "turned", "step", "edge", "at")


def path_violations(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    return evidence.path_violations(paths, edges, reads, K)


def read_layout(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    return evidence.layout(paths, edges, reads, K)


def path_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments on edges of sixty letters or more, the second mate through the inverse."""
    reads, edges, paths = _laid(spark, d)
    return evidence.path_fragments(paths, edges, least=60)


def branch_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of the reads at forks: how many each branch has and their sum."""
    reads, edges, paths = _laid(spark, d)
    votes = evidence.branch_votes(edges, paths, reads, K)
    return votes.groupBy("vertex", "branch").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("total"))


def branches_cut(spark: SparkSession, d: str) -> DataFrame:
    """Branches that lose by the votes; the bounds are those of reads without a low quality."""
    reads, edges, paths = _laid(spark, d)
    votes = evidence.branch_votes(edges, paths, reads, K)
    ways = evidence.branch_extensions(edges, K).select("vertex", "branch").distinct()
    return cleaning.branch_scores(votes, top=5000, weak=2500, branches=ways)


def bubbles_popped(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    bubbles = evidence.flanked_bubbles(edges)
    return cleaning.popped_bubbles(bubbles, edges, evidence.bubble_weights(bubbles, edges, paths, reads, K))


def _apart(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads, edges, paths = _laid(spark, d)
    repeats = cleaning.canonical_repeats(edges)
    scores = evidence.repeat_scores(repeats, evidence.pair_edges(paths, edges, reads, K))
    return edges, paths, evidence.repeat_copies(repeats, cleaning.separated_repeats(scores), edges)


def repeat_scores(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    return evidence.repeat_scores(cleaning.canonical_repeats(edges), evidence.pair_edges(paths, edges, reads, K))


def repeats_apart(spark: SparkSession, d: str) -> DataFrame:
    """The edges after repeats are pulled apart."""
    edges, _, copies = _apart(spark, d)
    return evidence.pulled_apart(edges, copies).select("edge", "src", "dst", "n_kmers", "inv")


def repeat_paths(spark: SparkSession, d: str) -> DataFrame:
    """Read paths over the copies of repeats."""
    _, paths, copies = _apart(spark, d)
    moved = evidence.paths_through_copies(paths, copies)
    return moved.select("read_id", F.posexplode("edges").alias("step", "edge")).where(F.col("edge").contains("|"))


def loops_unrolled(spark: SparkSession, d: str) -> DataFrame:
    edges = _graph(spark, d)[1]
    return evidence.unrolled(edges, cleaning.unrollable_loops(edges, size=30)).select("edge", "src", "dst", "n_kmers", "inv")


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads, edges, paths = _laid(spark, d)
    coverage = cut_large(placement.pair_coverage(placement.path_steps(paths), edges))
    kept = cleaning.delete_edges(edges, evidence.weak_branches(edges, coverage, most=0.3))
    merged, moves = evidence.merged_edges(cut_large(kept), K)
    return merged, moves, paths


def chains_merged(spark: SparkSession, d: str) -> DataFrame:
    """The edges after branches of little coverage go and chains become one edge each."""
    return _merged(spark, d)[0]


def merged_read_paths(spark: SparkSession, d: str) -> DataFrame:
    """Read paths on the merged edges, cut where an edge is gone."""
    merged, moves, paths = _merged(spark, d)
    moved = evidence.merged_paths(paths, moves)
    return moved.select("read_id", "off", F.posexplode("edges").alias("step", "edge"))


def plasmids_unwound(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    on = cut_large(evidence.pair_edges(paths, edges, reads, K))
    pairs = on.select("pair", "edge").distinct().groupBy("edge").agg(F.count(F.lit(1)).alias("pairs"))
    met = on.join(on.select("pair", "turned", F.col("edge").alias("e2")), ["pair", "turned"]).where("edge < e2").select(F.col("edge").alias("e1"), "e2", "pair").distinct()
    links = met.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    return evidence.plasmids_unwound(edges, cleaning.plasmid_patterns(edges, pairs, links), K).where("edge like 'loop:%'")


def lone_edges(spark: SparkSession, d: str) -> DataFrame:
    """Short edges of the merged graph that touch no other."""
    return evidence.lone_edges(cut_large(_merged(spark, d)[0]), 105)


def planted_support(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    return placement.edge_support(placement.path_steps(paths), edges)


def unsupported_branches(spark: SparkSession, d: str) -> DataFrame:
    reads, edges, paths = _laid(spark, d)
    return cleaning.unsupported_branches(edges, placement.edge_support(placement.path_steps(paths), edges), most=3, least=10)


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lines through a bubble for every supplier: length over the cell, and pairs of reads on the line or its inverse."""
    reads, edges = _graph(spark, d, (0,))
    paths = cut_large(placement.text_paths(reads, edges, K))
    found = cut_large(lines.find_lines(edges, cut_large(lines.find_cells(edges))))
    sizes = sort_merged(lines.line_lengths(found, edges))
    return sizes.join(lines.line_pairs(found, edges, placement.path_steps(paths)), "line", "left").select("line", "len", "npairs")


QUERIES = {
    f.__name__: f
    for f in (
        simple_bubbles, canonical_repeats, unrollable_loops, circle_sequences, planted_steps, path_violations, read_layout, path_fragments, branch_votes, branches_cut, bubbles_popped, repeat_scores,
        repeats_apart, repeat_paths, loops_unrolled, chains_merged, merged_read_paths, plasmids_unwound, lone_edges, planted_support, unsupported_branches, line_stats,
    )
}


def planted_graph(kinds: tuple[int, ...] = ALL) -> str:
    return _GRAPH.replace(READS, _planted("unnest(range(copies))", kinds)).replace(f"having count(*) >= {MIN_FREQ}", "having true")


def paths_cte() -> str:
    """steps(read_id, step, edge, st, n_kmers, src, dst, inv): read paths on the graph, cut where they do not adjoin."""
    return f"""ek as (select edge, o off, substr(seq, o + 1, {K}) fwd from (select edge, seq, unnest(range(n_kmers)) o from edges)),
      rk as (select read_id, p pos, substr(seq, p + 1, {K}) fwd from (select read_id, seq, unnest(range(length(seq) - {K - 1})) p from reads where length(seq) >= {K})),
      hit as (select read_id, pos, edge, off, case when lag(edge) over w = edge and lag(off) over w = off - 1 and lag(pos) over w = pos - 1 then 0 else 1 end fresh from rk join ek using (fwd) window w as (partition by read_id order by pos, edge)),
      parts as (select read_id, edge, min(pos) pos, min(off) off from (select *, sum(fresh) over (partition by read_id order by pos, edge rows unbounded preceding) run from hit) group by read_id, run, edge),
      joined as (select p.*, e.src, e.dst, e.n_kmers, e.inv, lag(p.edge) over w prev, lag(e.dst) over w came from parts p join edges e using (edge) window w as (partition by read_id order by pos)),
      sound as (select *, sum(case when prev <> edge and came <> src then 1 else 0 end) over (partition by read_id order by pos rows unbounded preceding) broken from joined),
      steps as (select read_id, row_number() over (partition by read_id order by pos) - 1 step, edge, cast(pos - off as int) st, n_kmers, src, dst, inv from sound where broken = 0 and (prev is null or prev <> edge))"""


_P = f"{planted_graph()}, {paths_cte()}"
_D = "d as (select vertex v, n_in i, n_out o from deg)"
_BOTH = f"""ends as (select read_id, max(step) last from steps group by read_id), len as (select read_id, length(seq) l from reads),
  bo as (select read_id, false turned, step, edge, st, n_kmers, src, dst from steps union all
    select s.read_id, true, last - step, s.inv, cast(l - st - s.n_kmers - {K - 1} as int), s.n_kmers, e.src, e.dst from steps s join ends using (read_id) join len using (read_id) join edges e on e.edge = s.inv),
  seqs as (select read_id, false turned, seq from reads union all select read_id, true, {rc('seq')} from reads)"""
_WAYS = f"""ext(vertex, branch, tip, n, txt) as (select src, edge, dst, n_kmers, seq from edges join deg on vertex = src where n_in >= 1 and n_out >= 2 union all
    select x.vertex, x.branch, e.dst, x.n + e.n_kmers, x.txt || substr(e.seq, {K}) from ext x join edges e on e.src = x.tip where x.n < 250),
  grown as (select * from ext where n >= 250 or tip not in (select src from edges)), few as (select vertex, least(250, min(case when n < 250 then n end)) depth from grown group by vertex having count(*) <= 10),
  ways as (select distinct vertex, branch, substr(txt, 1, coalesce(depth, 250) + {K - 1}) txt from grown join few using (vertex))"""
_VOTES = f"""{_BOTH}, {_WAYS}, spot as (select read_id, turned, src vertex, st from bo union select read_id, turned, dst, st + n_kmers from bo),
  cost as (select vertex, branch, read_id, turned, st, {QUAL} * len(list_filter(range(greatest(st, 0), least(length(seq), st + length(txt))), lambda i: seq[i + 1] <> txt[i - st + 1])) c from spot join ways using (vertex) join seqs using (read_id, turned)),
  per as (select vertex, branch, read_id, turned, st, min(c) c from cost group by all), ranked as (select *, row_number() over w r, lead(c) over w - c score from per window w as (partition by vertex, read_id, turned, st order by c, branch)),
  votes as (select vertex, branch, score from ranked where r = 1 and score > 0)"""
_REPEATS = """rep as (select edge repeat, e.src rsrc, e.dst rdst, e.inv rinv, (select min(x.edge) from edges x where x.dst = e.src) in1, (select max(x.edge) from edges x where x.dst = e.src) in2,
  (select min(x.edge) from edges x where x.src = e.dst) out1, (select max(x.edge) from edges x where x.src = e.dst) out2 from edges e join d a on a.v = e.src join d b on b.v = e.dst
  where a.i = 2 and a.o = 1 and b.i = 1 and b.o = 2 and e.src <> e.dst)"""
_SEEN = f"{_BOTH}, seen as (select distinct read_id >> 1 pair, turned <> (read_id & 1 = 1) turned, edge from bo)"
_SCORES = "sc as (select repeat, " + ", ".join(f"(select count(*) from seen a join seen b using (pair, turned) where a.edge = in{i} and b.edge = out{j}) s{i}{j}" for i in (1, 2) for j in (1, 2)) + " from rep)"
_COPIED = """dec as (select repeat, case when s11 > 0 and s22 > 0 and greatest(s12, s21) <= least(s11, s22) and s11 + s22 >= greatest(5, 5 * s12, 5 * s21) then true
    when s12 > 0 and s21 > 0 and greatest(s11, s22) <= least(s12, s21) and s12 + s21 >= greatest(5, 5 * s11, 5 * s22) then false end straight from sc),
  cp as (select repeat, rsrc, rdst, rinv, came, goes, repeat || '|' || came || '|' || goes copy from (select *, in1 came, case when straight then out1 else out2 end goes from rep join dec using (repeat) where straight is not null
    union all select *, in2, case when straight then out2 else out1 end from rep join dec using (repeat) where straight is not null))"""
_APART = f"{_P}, {_D}, {_REPEATS}, {_SEEN}, {_SCORES}, {_COPIED}"
_LOOPS = """lp as (select p.edge prev, r.edge repeat, l.edge loop, n.edge next from edges r join edges l on l.src = r.dst and l.dst = r.src join edges p on p.dst = r.src join edges n on n.src = r.dst
  join d a on a.v = r.src join d b on b.v = r.dst where p.edge <> l.edge and n.edge <> l.edge and p.edge <> n.edge and a.i = 2 and a.o = 1 and b.i = 1 and b.o = 2 and p.n_kmers >= 30 and n.n_kmers >= 30)"""
_KEPT = f"""{_BOTH}, cov as (select e.edge, round(coalesce(p, 0) / n_kmers, 6) cov from edges e left join (select edge, count(distinct read_id >> 1) p from bo group by 1) using (edge)),
  weak as (select edge from (select e.edge, cov, max(cov) over (partition by src) a, max(cov) over (partition by dst) b from edges e join cov using (edge)) where cov <= 0.3 and ((a > 0 and a >= 5 * cov) or (b > 0 and b >= 5 * cov))),
  kept as (select * from edges where edge not in (select edge from weak) and inv not in (select edge from weak)),
  kdeg as (select vertex, sum(i) i, sum(o) o from (select src vertex, 0 i, 1 o from kept union all select dst, 1, 0 from kept) group by 1),
  mlink as (select a.edge u, b.edge v from kept a join kept b on a.dst = b.src join kdeg on vertex = a.dst where i = 1 and o = 1 and a.src <> a.dst and b.src <> b.dst),
  lead_ as (select edge from kept where edge not in (select v from mlink)),
  mwalk(head, edge, r, plus) as (select edge, edge, 0, 0 from lead_ union all select head, v, r + 1, plus + n_kmers from mwalk join mlink on edge = u join kept using (edge))"""

_REAL = f"{_GRAPH}, {paths_cte()}"
SQL = {
    "edge_support": f"{_REAL}, e as (select read_id, max(step) last from steps group by 1) select edge, count(*) support from (select edge from steps where step > 0 union all select inv from steps join e using (read_id) where step < last) group by 1",
    "edge_coverage": f"""{_REAL}, p as (select edge, count(distinct read_id >> 1) n from (select edge, read_id from steps union all select inv, read_id from steps) group by 1)
        select edge, coalesce(n, 0) pairs, round(coalesce(n, 0) / n_kmers, 6) cov from edges left join p using (edge)""",
    "line_stats": f"""{planted_graph((0,))}, {paths_cte()}, {_D}, c as (select src v, dst w, min(edge) e1, max(edge) e2, sum(n_kmers) n from edges where src <> dst group by 1, 2 having count(*) = 2),
        l as (select a.edge line, a.n_kmers + cast(floor(n / 2) as bigint) + z.n_kmers len, [a.edge, e1, e2, z.edge] parts from c join d p on p.v = c.v join d q on q.v = w join edges a on a.dst = c.v join edges z on z.src = w where p.i = 1 and p.o = 2 and q.i = 2 and q.o = 1),
        o as (select line, unnest(parts) edge from l), b as (select * from o union select line, inv from o join edges using (edge))
        select line, cast(len as bigint) len, (select count(distinct read_id >> 1) from b join steps using (edge) where b.line = l.line) npairs from l""",
    "simple_bubbles": f"""{_P}, {_D}, p as (select src, dst, count(*) n, min(edge) e1, max(edge) e2 from edges group by 1, 2)
        select src, dst, e1, e2 from p join d a on a.v = src join d b on b.v = dst where n = 2 and a.o = 2 and b.i = 2 and src <> dst""",
    "canonical_repeats": f"{_P}, {_D}, {_REPEATS} select repeat, in1, in2, out1, out2 from rep",
    "unrollable_loops": f"{_P}, {_D}, {_LOOPS} select * from lp",
    "circle_sequences": f"""with {_planted('unnest(range(copies))', ALL)}, c as (select seq[1:64] s from haps where length(seq) = 96 union all select {rc('seq[1:64]')} from haps where length(seq) = 96),
        t as (select s, unnest(range(64)) i from c), l as (select s, min(substr(s || s, i + 1, {K})) edge from t group by s), m as (select l.s, edge, substr(s || s || s, cast(strpos(s || s, edge) as bigint), {64 + K - 1}) seq from l)
        select a.edge, a.seq, cast(64 as int) n_kmers, b.edge inv from m a join m b on {rc('a.s')} = b.s""",
    "planted_steps": f'{_P}, {_BOTH} select read_id, turned, cast(step as int) step, edge, st "at" from bo',
    "path_violations": f"""{_P}, x as (select s.*, lag(s.dst) over (partition by read_id order by step) came from steps s)
        select 'adjacency' rule, count(*) filter (came <> src) n from x union all select 'missing edge', count(*) from steps where edge not in (select edge from edges)
        union all select 'offset', count(*) from steps join reads using (read_id) where step = 0 and (-st >= n_kmers + {K - 1} or length(seq) - st <= 0)""",
    "read_layout": f'{_P}, {_BOTH} select edge, cast(-st as int) "at", turned, read_id from bo where step = 0',
    "path_fragments": f"""{_P}, f as (select read_id >> 1 pair, read_id & 1 m, -st pf, edge, inv, n_kmers + {K - 1} size from steps where step = 0 and n_kmers + {K - 1} >= 60),
        g as (select b.size - b.pf - a.pf l from f a join f b on a.pair = b.pair and a.m = 0 and b.m = 1 and b.inv = a.edge), h as (select floor(l / 10) * 10 + 5.0 c from g where l >= 0 and l < 1000)
        select cast(c as double) bin_center, count(*) n, round(count(*) / sum(count(*)) over (), 6) mass from h group by c""",
    "branch_votes": f"{_P}, {_VOTES} select vertex, branch, count(*) votes, cast(sum(score) as bigint) total from votes group by 1, 2",
    "branches_cut": f"""{_P}, {_VOTES}, q as (select vertex, branch, dd, coalesce(sum(score) filter (score > dd), 0) q from (select vertex, branch, dd from (select distinct vertex, branch from ways where vertex in (select vertex from votes)), (select unnest(range(16)) dd)) left join votes using (vertex, branch) group by vertex, branch, dd),
        b as (select *, max(q) over (partition by vertex, dd) best from q), l as (select * from b where best >= 5000 and q <= 2500 and best >= 5 * q and q < best)
        select vertex, branch from (select *, min(dd) over (partition by vertex) m from l) where dd = m""",
    "bubbles_popped": f"""{_P}, {_D}, p as (select src, dst, count(*) n, min(edge) e1, max(edge) e2 from edges where src <> dst group by 1, 2),
        b as (select e1, e2, x.inv i1, y.inv i2 from p join d s on s.v = src join d t on t.v = dst join edges x on x.edge = e1 join edges y on y.edge = e2 where n = 2 and s.i = 1 and s.o = 2 and t.o = 1 and x.inv <> e2),
        n as (select edge, count(*) n from steps group by 1), w as (select e1, e2, i1, i2, {', '.join(f"coalesce((select n from n where edge = {c}), 0) n_{c}" for c in ('e1', 'e2', 'i1', 'i2'))} from b),
        f as (select e1, e2, n_e1 * 0.999 + n_e2 * 0.001 f1, n_e2 * 0.999 + n_e1 * 0.001 f2, n_i1 * 0.999 + n_i2 * 0.001 r1, n_i2 * 0.999 + n_i1 * 0.001 r2 from w),
        g as (select case when f2 + r2 > f1 + r1 or (f2 + r2 = f1 + r1 and f2 > f1) then e1 else e2 end edge, f1 + f2 nf, r1 + r2 nr, case when f2 + r2 > f1 + r1 then f1 else f2 end lf, case when f2 + r2 > f1 + r1 then r1 else r2 end lr from f),
        c as (select edge, nf, nr, lf, lr, {', '.join(f"list_sum(list_transform(range(0, cast(ceil({low}) as int) + 1), lambda i: exp(lgamma(floor(2 * {n}) + 1) - lgamma(i + 1) - lgamma(floor(2 * {n}) - i + 1) + i * ln(0.25) + (floor(2 * {n}) - i) * ln(0.75)))) {t}" for low, n, t in (('lf', 'nf', 'tf'), ('lr', 'nr', 'tr')))} from g where nf >= 0.5 and nr >= 0.5 and lf < 10 and lr < 10)
        select edge from c where tf < 1e-5 and tr < 1e-5""",
    "repeat_scores": f"{_P}, {_D}, {_REPEATS}, {_SEEN}, {_SCORES} select * from sc",
    "repeats_apart": f"""{_APART}, cv as (select a.*, (select b.copy from cp b join edges x on x.edge = a.goes join edges y on y.edge = a.came where b.repeat = a.rinv and b.came = x.inv and b.goes = y.inv) icopy from cp a)
        select edge, coalesce((select rdst || '|' || copy from cp where goes = e.edge), src) src, coalesce((select rsrc || '|' || copy from cp where came = e.edge), dst) dst, n_kmers, inv from edges e where edge not in (select repeat from cp)
        union all select copy, rsrc || '|' || copy, rdst || '|' || copy, n_kmers, icopy from cv join edges on edge = repeat""",
    "repeat_paths": f"""{_APART}, s as (select read_id, step, edge, lag(edge) over w p, lead(edge) over w n from steps window w as (partition by read_id order by step)),
        t as (select read_id, step, min(copy) filter (coalesce(p = came, true) and coalesce(n = goes, true)) copy from s join cp on repeat = edge group by 1, 2)
        select read_id, cast(step as int) step, copy edge from t where copy is not null and not exists (select 1 from t u where u.read_id = t.read_id and u.step <= t.step and u.copy is null)""",
    "loops_unrolled": f"""{_P}, {_D}, {_LOOPS}, o as (select e.*, l.loop, l.next from edges e join lp l on l.repeat = e.edge)
        select edge, coalesce((select dst || '''' from o where next = e.edge), src) src, coalesce((select src || '''' from o where loop = e.edge), dst) dst, n_kmers, case when edge in (select edge from o) then inv || '''' else inv end inv from edges e
        union all select edge || '''', src || '''', dst || '''', n_kmers, inv from o""",
    "chains_merged": f"""{_P}, {_KEPT}, m as (select head edge, arg_min(src, r) src, arg_max(dst, r) dst, string_agg(case when r = 0 then seq else substr(seq, {K}) end, '' order by r) seq, cast(sum(n_kmers) as bigint) n_kmers, arg_max(inv, r) li from mwalk join kept using (edge) group by head)
        select m.edge, src, dst, seq, n_kmers, w.head inv from m join mwalk w on w.edge = m.li""",
    "merged_read_paths": f"""{_P}, {_KEPT}, a as (select s.read_id, s.step, s.st, w.head, w.plus, sum(case when w.head is null then 1 else 0 end) over (partition by s.read_id order by s.step rows unbounded preceding) gone from steps s left join mwalk w using (edge)),
        b as (select *, lag(head) over (partition by read_id order by step) p, lag(plus) over (partition by read_id order by step) q from a where gone = 0), c as (select * from b where step = 0 or p <> head or plus <= q)
        select read_id, cast(first_value(plus - st) over w as int) off, cast(row_number() over w - 1 as int) step, head edge from c window w as (partition by read_id order by step)""",
    "plasmids_unwound": f"""{_P}, {_D}, {_SEEN}, two as (select src, dst, min(edge) e1, max(edge) e2 from edges where src <> dst group by 1, 2 having count(*) = 2), one as (select src, dst, min(edge) back from edges group by 1, 2 having count(*) = 1),
        pt as (select e1, e2, back, t.src from two t join one o on o.src = t.dst and o.dst = t.src join d a on a.v = t.src join d b on b.v = t.dst where a.i = 1 and a.o = 2 and b.i = 2 and b.o = 1),
        pn as (select edge, count(distinct pair) n from seen group by 1), ok as (select pt.* from pt where (select min(coalesce(n, 0)) from pn where edge in (e1, e2, back)) >= 10 and (select count(distinct a.pair) from seen a join seen b using (pair, turned) where a.edge = e1 and b.edge = e2) >= 2)
        select 'loop:' || e1 || ':' || back edge, ok.src src, ok.src dst, a.seq || substr(f.seq, {K}) || substr(b.seq, {K}) || substr(f.seq, {K}) seq, cast(a.n_kmers + b.n_kmers + 2 * f.n_kmers as int) n_kmers, 'loop:' || least(a.inv, b.inv) || ':' || f.inv inv
        from ok join edges a on a.edge = e1 join edges b on b.edge = e2 join edges f on f.edge = back""",
    "lone_edges": f"""{_P}, {_KEPT}, m as (select head edge, arg_min(src, r) src, arg_max(dst, r) dst, sum(n_kmers) n_kmers from mwalk join kept using (edge) group by head)
        select edge from m where src <> dst and n_kmers <= 105 and src not in (select dst from m) and dst not in (select src from m) and src in (select src from m group by 1 having count(*) = 1) and dst in (select dst from m group by 1 having count(*) = 1)""",
    "planted_support": f"{_P}, {_BOTH} select edge, count(*) support from bo where step > 0 group by 1",
    "unsupported_branches": f"""{_P}, {_BOTH}, s as (select e.edge, src, dst, coalesce(n, 0) n from edges e left join (select edge, count(*) n from bo where step > 0 group by 1) using (edge)),
        t as (select edge, n, count(*) over a ca, sum(n) over a - n oa, count(*) over b cb, sum(n) over b - n ob from s window a as (partition by src), b as (partition by dst))
        select edge from t where n <= 3 and ((ca = 2 and oa >= 10 * greatest(n, 1)) or (cb = 2 and ob >= 10 * greatest(n, 1)))""",
}
