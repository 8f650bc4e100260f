"""Queries over placements, pairs, intervals and lengths, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import intervals, joins, placement, stats
from strandflow.operators.kmers import clean_reads
from strandflow.plans.core_problems import _LOC_ROWS, _glocs, placed_rows
from strandflow.plans.sequence_queries import _GRAPH, K, READS, _edges, _reads, rc
from strandflow.tables import table


def n50_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.n50(_reads(spark, d).where("sample is not null").withColumn("len", F.length("seq")), "len", ["sample"])


def nx_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _glocs(spark, d).select((F.col("stop_pos") - F.col("start_pos")).alias("size"))
    return stats.nx_table(rows, "size")


def ngx_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _glocs(spark, d).select((F.col("stop_pos") - F.col("start_pos")).alias("size"))
    return stats.nx_table(rows, "size", size=1_000_000)


def nx_unipaths(spark: SparkSession, d: str) -> DataFrame:
    return stats.nx_table(_edges(spark, d).where("not circle and edge <= inv"), "n_kmers")


def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covered_length(_glocs(spark, d), "gid", "start_pos", "stop_pos")


def interval_depths(spark: SparkSession, d: str) -> DataFrame:
    """Bases by the number of intervals that cover them, over all gids."""
    steps = intervals.active_counts(_glocs(spark, d), "gid", "start_pos", "stop_pos").where("next_pos is not null")
    return steps.groupBy("active").agg(F.sum(F.col("next_pos") - F.col("pos")).alias("bases"))


def interval_stab_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many intervals hold the places where uncovered stretches end, by gid."""
    points = intervals.gaps(_glocs(spark, d), "gid", "start_pos", "stop_pos").select("gid", F.col("gap_stop").alias("pos"))
    met = joins.stab_join(points, _glocs(spark, d).select("gid", "start_pos", "stop_pos"), "gid", "pos", "start_pos", "stop_pos")
    return met.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))


def latest_view_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: for each purchase the id of the user's latest view up to then."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.latest_before(bought, viewed, "user_id", "ts", "view_id").select("event_id", "latest_view_id")


def sliding_event_values(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.sliding(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 2)
    return rows.select("event_id", *[F.round(c, 4).alias(c) for c in ("w_min", "w_max", "w_sum", "w_mean")])


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Reads and bases by kind and sample, with subtotals."""
    kinds = table(spark, d, "read_groups").groupBy("sample").agg(F.max("read_type").alias("read_type"))
    rows = _reads(spark, d).join(F.broadcast(kinds), "sample")  # read_groups is fixed at 18 rows
    return rows.rollup("read_type", "sample").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"), F.grouping_id().cast("int").alias("level"))


def placed_reads_index(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reads and distinct pairs on each unipath of read_locs."""
    rows = placed_rows(spark, d).where("rid is not null").select("uid", "rid").distinct()
    pairs = rows.select("uid", F.shiftright("rid", 1).alias("pair"), F.lit(1).alias("one")).groupBy("uid", "pair").agg(F.count("one").alias("n"))
    return pairs.groupBy("uid").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("pairs"))


def reads_placed_or_not(spark: SparkSession, d: str) -> DataFrame:
    """Semi- and anti-join: reads of each sample with and without a placement."""
    reads = _reads(spark, d).select("read_id", "sample")
    placed = placed_rows(spark, d).select(F.col("rid").alias("read_id"))
    semi = reads.join(placed, "read_id", "left_semi").groupBy("sample").agg(F.count(F.lit(1)).alias("reads")).withColumn("placed", F.lit(True))
    anti = reads.join(placed, "read_id", "left_anti").groupBy("sample").agg(F.count(F.lit(1)).alias("reads")).withColumn("placed", F.lit(False))
    return semi.unionByName(anti)


def fragment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return placement.fragment_distribution(placed_rows(spark, d), "uid", "start_pos", "rid", "rc", limit=1000)


def pair_links(spark: SparkSession, d: str) -> DataFrame:
    return placement.pair_links(placed_rows(spark, d), "uid", "rid")


def links_accepted(spark: SparkSession, d: str) -> DataFrame:
    return placement.accepted_links(placement.pair_links(placed_rows(spark, d), "uid", "rid"))


def top_unipaths(spark: SparkSession, d: str) -> DataFrame:
    """The fifty unipaths with most placements."""
    return placed_rows(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "uid").limit(50)


def column_consensus(spark: SparkSession, d: str) -> DataFrame:
    """By unipath: columns with reads on them, and those whose winning base stands by the correction rule."""
    locs = placed_rows(spark, d).where("start_pos >= 0 and rid is not null and rc is not null")
    cells = placement.consensus_columns(locs, _reads(spark, d))
    ok = (F.col("top") >= 50) & (F.col("top") >= 10 * F.col("second")) & (F.col("second") <= 100)
    return cells.groupBy("uid").agg(F.count(F.lit(1)).alias("columns"), F.count_if(ok).alias("called"))


def placed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Where every read runs along the unipaths of the reads themselves."""
    return placement.place_reads(_reads(spark, d), _edges(spark, d).where("not circle"), K)


def edge_coverage(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).where("not circle")
    parts = placement.place_reads(_reads(spark, d), edges, K)
    return placement.pair_coverage(placement.path_steps(placement.read_paths(parts, edges)), edges)


def pair_mismatch_score(spark: SparkSession, d: str) -> DataFrame:
    """For each pair: mismatches of mate 1 against the reverse complement of mate 2, and the qualities there."""
    from strandflow.functions.dna import revcomp

    reads = _reads(spark, d)
    one = reads.where("read_id % 2 = 0").select(F.shiftright("read_id", 1).alias("pair"), F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    two = reads.where("read_id % 2 = 1").select(F.shiftright("read_id", 1).alias("pair"), revcomp(F.col("seq")).alias("s2"))
    n = F.least(F.length("s1"), F.length("s2"))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring("s1", i, F.lit(1)) != F.substring("s2", i, F.lit(1)))
    rows = one.join(two, "pair").withColumn("at", places)
    return rows.select("pair", F.size("at").alias("mismatches"), F.aggregate("at", F.lit(0), lambda s, i: s + F.coalesce(F.get("q1", i - 1), F.lit(0))).alias("score"))


def unique_seed_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Reads without a placement whose first 20-mer stands in exactly one placed read."""
    reads = _reads(spark, d).where("length(seq) >= 20")
    placed = placed_rows(spark, d).select(F.col("rid").alias("read_id"))
    lost = reads.join(placed, "read_id", "left_anti").select("read_id", F.substring("seq", 1, 20).alias("fwd"))
    found = reads.join(placed, "read_id", "left_semi")
    from strandflow.operators.kmers import read_kmers

    seeds = read_kmers(found, 20).join(lost.select("fwd").distinct(), "fwd", "left_semi").groupBy("fwd").agg(F.min("read_id").alias("host"), F.max("read_id").alias("other"))
    return lost.join(seeds.where("host = other"), "fwd").select("read_id", "host")


def probability_tails(spark: SparkSession, d: str) -> DataFrame:
    """For every part size: Poisson and binomial tails, six digits."""
    sizes = table(spark, d, "part").select(F.col("p_size").alias("n")).where("n is not null").distinct()
    return sizes.select("n", F.round(stats.poisson_cdf(F.col("n"), F.lit(20.0)), 6).alias("poisson"), F.round(stats.binomial_tail(F.col("n"), F.lit(5), 0.25), 6).alias("binomial"))


QUERIES = {
    f.__name__: f
    for f in (
        n50_by_sample, nx_table, ngx_table, nx_unipaths, interval_coverage, interval_depths, interval_stab_counts, latest_view_before_purchase, sliding_event_values, coverage_rollup,
        placed_reads_index, reads_placed_or_not, fragment_distribution, pair_links, links_accepted, top_unipaths, column_consensus, placed_parts, edge_coverage, pair_mismatch_score,
        unique_seed_rescue, probability_tails,
    )
}

_G = "select * from read_glocs where gid is not null and start_pos >= 0 and stop_pos > start_pos"
_EV = f"""ev as (select gid, pos, sum(dl) dl from (select gid, start_pos pos, 1 dl from ({_G}) union all select gid, stop_pos, -1 from ({_G})) group by 1, 2),
  st as (select gid, pos, lead(pos) over (partition by gid order by pos) nxt, sum(dl) over (partition by gid order by pos) active from ev)"""
_NX = """with s as (select stop_pos - start_pos len, count(*) n from ({g}) group by 1), c as (select len, sum(len * n) over (order by len desc) upto, (select {whole} from s) whole from s)
  select x, cast(max(case when upto * 100 >= whole * x then len end) as bigint) len from c, (select unnest(range(10, 100, 10)) x) group by x"""
_PAIRS = f"select distinct rid >> 1 pair, rid & 1 mate, uid u from ({_LOC_ROWS}) where rid is not null"
_LINKS = f"""lk as (select u1, u2, count(*) n from (select distinct a.pair, least(a.u, b.u) u1, greatest(a.u, b.u) u2 from ({_PAIRS}) a join ({_PAIRS}) b on a.pair = b.pair and a.mate = 0 and b.mate = 1 and a.u <> b.u) group by 1, 2)"""

SQL = {
    "n50_by_sample": f"""with {READS}, e as (select sample, length(seq) l, row_number() over (partition by sample order by length(seq)) i, sum(length(seq)) over (partition by sample order by length(seq), read_id rows unbounded preceding) upto,
          sum(length(seq)) over (partition by sample) whole, lead(length(seq)) over (partition by sample order by length(seq), read_id) nxt from reads where sample is not null)
        select sample, cast(arg_min(case when upto * 2 = whole and nxt is not null then (l + nxt) // 2 else l end, upto) as bigint) n50 from e where upto * 2 >= whole group by sample""",
    "nx_table": _NX.format(g=_G, whole="sum(len * n)"),
    "ngx_table": _NX.format(g=_G, whole="max(1000000)"),
    "nx_unipaths": f"""{_GRAPH}, s as (select n_kmers len, count(*) n from edges where edge <= inv group by 1), c as (select len, sum(len * n) over (order by len desc) upto, (select sum(len * n) from s) whole from s)
        select x, cast(max(case when upto * 100 >= whole * x then len end) as bigint) len from c, (select unnest(range(10, 100, 10)) x) group by x""",
    "interval_coverage": f"with {_EV} select gid, cast(sum(case when active > 0 then nxt - pos else 0 end) as bigint) covered, cast(sum(active * (nxt - pos)) as bigint) depth_sum from st where nxt is not null group by gid",
    "interval_depths": f"with {_EV} select cast(active as bigint) active, cast(sum(nxt - pos) as bigint) bases from st where nxt is not null group by 1",
    "interval_stab_counts": f"with {_EV}, g as (select gid, nxt pos from st where active = 0 and nxt is not null) select g.gid, count(*) n from g join ({_G}) r on r.gid = g.gid and r.start_pos <= g.pos and r.stop_pos > g.pos group by 1",
    "latest_view_before_purchase": """select event_id, view_id latest_view_id from (select event_id, user_id, ts from events where event_type = 'purchase') p
        asof left join (select user_id, ts, max(event_id) view_id from events where event_type = 'view' group by 1, 2) v on p.user_id = v.user_id and p.ts >= v.ts""",
    "sliding_event_values": """select event_id, round(min(value) over w, 4) w_min, round(max(value) over w, 4) w_max, round(sum(value) over w, 4) w_sum, round(avg(value) over w, 4) w_mean
        from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""",
    "coverage_rollup": f"""with {READS}, k as (select sample, max(read_type) read_type from read_groups group by 1)
        select read_type, sample, count(*) reads, cast(sum(length(seq)) as bigint) bases, cast(grouping_id(read_type, sample) as int) level from reads join k using (sample) group by rollup (read_type, sample)""",
    "placed_reads_index": f"select uid, count(distinct rid) reads, count(distinct rid >> 1) pairs from ({_LOC_ROWS}) where rid is not null group by 1",
    "reads_placed_or_not": f"with {READS} select sample, count(*) reads, read_id in (select rid from ({_LOC_ROWS}) where rid is not null) placed from reads group by sample, placed",
    "fragment_distribution": f"""with l as (select uid, rid >> 1 pair, rid & 1 m, start_pos p, rc from ({_LOC_ROWS}) where start_pos is not null and rid is not null),
        f as (select floor((b.p - a.p) / 10) * 10 + 5.0 bin_center from l a join l b on a.uid = b.uid and a.pair = b.pair and a.m <> b.m and not a.rc and b.rc and b.p - a.p >= 0 and b.p - a.p < 1000)
        select cast(bin_center as double) bin_center, count(*) n, round(count(*) / sum(count(*)) over (), 6) mass from f group by 1""",
    "pair_links": f"with {_LINKS} select * from lk",
    "links_accepted": f"""with {_LINKS}, e as (select u1 u, n from lk union all select u2, n from lk), t as (select u, n best from (select u, n, max(n) over (partition by u) b from e) where n = b group by u, n having count(*) = 1)
        select u1, u2, n from lk join t a on a.u = u1 and a.best = n join t b on b.u = u2 and b.best = n where n >= 3""",
    "top_unipaths": f"select uid, count(*) n from ({_LOC_ROWS}) group by 1 order by 2 desc, 1 limit 50",
    "column_consensus": f"""with {READS}, l as (select * from ({_LOC_ROWS}) where start_pos >= 0 and rid is not null and rc is not null),
        c as (select uid, start_pos, rc, case when rc then {rc('seq')} else seq end s, qual, length(seq) n, unnest(range(1, length(seq) + 1)) i from l join reads on rid = read_id),
        q as (select uid, start_pos + i - 1 col, s[i] base, coalesce(qual[case when rc then n - i + 1 else i end], 0) q from c),
        w as (select uid, col, base, sum(cast(case when q <= 2 then least(q, 0.2) else q end as decimal(20,1))) w from q group by 1, 2, 3),
        r as (select uid, col, list(w order by w desc) ws from w group by 1, 2)
        select uid, count(*) "columns", count(*) filter (ws[1] >= 50 and ws[1] >= 10 * coalesce(ws[2], 0) and coalesce(ws[2], 0) <= 100) called from r group by 1""",
    "placed_parts": f"""{_GRAPH}, ek as (select edge, o off, substr(seq, o + 1, {K}) fwd from (select edge, seq, unnest(range(n_kmers)) o from edges)),
        rk as (select read_id, p pos, substr(seq, p + 1, {K}) fwd from (select read_id, seq, unnest(range(length(seq) - {K - 1})) p from reads where length(seq) >= {K})),
        h as (select read_id, pos, edge, off, case when lag(edge) over w = edge and lag(off) over w = off - 1 and lag(pos) over w = pos - 1 then 0 else 1 end fresh from rk join ek using (fwd) window w as (partition by read_id order by pos, edge)),
        g as (select *, sum(fresh) over (partition by read_id order by pos, edge rows unbounded preceding) run from h)
        select read_id, edge, min(pos) pos, cast(min(off) as int) off, cast(count(*) as int) n_kmers from g group by read_id, run, edge""",
    "pair_mismatch_score": f"""with {READS}, p as (select a.read_id >> 1 pair, a.seq s1, a.qual q1, {rc('b.seq')} s2, unnest(range(1, least(length(a.seq), length(b.seq)) + 1)) i from reads a join reads b on a.read_id + 1 = b.read_id and a.read_id % 2 = 0)
        select pair, cast(count(*) filter (s1[i] <> s2[i]) as int) mismatches, cast(coalesce(sum(coalesce(q1[i], 0)) filter (s1[i] <> s2[i]), 0) as int) score from p group by pair""",
    "unique_seed_rescue": f"""with {READS}, pl as (select distinct rid from ({_LOC_ROWS}) where rid is not null), lost as (select read_id, seq[1:20] fwd from reads where length(seq) >= 20 and read_id not in (select rid from pl)),
        s as (select fwd, min(read_id) host, max(read_id) other from (select read_id, substr(seq, p + 1, 20) fwd from (select read_id, seq, unnest(range(length(seq) - 19)) p from reads where length(seq) >= 20 and read_id in (select rid from pl))) where fwd in (select fwd from lost) group by 1)
        select read_id, host from lost join s using (fwd) where host = other""",
    "probability_tails": """with n as (select distinct p_size n from part where p_size is not null), i as (select unnest(range(0, 200)) i)
        select n, round(sum(case when i <= n then exp(-20.0 + i * ln(20.0) - lgamma(i + 1)) else 0 end), 6) poisson,
          round(sum(case when i <= n and i >= 5 then exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75)) else 0 end), 6) binomial from n, i where i <= n group by n""",
}
