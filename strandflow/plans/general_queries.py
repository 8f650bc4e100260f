"""Queries over sequences, statistics and plain relations, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import sequence
from strandflow.operators import kmers, stats
from strandflow.plans.core_problems import _LOC_ROWS, placed_rows
from strandflow.plans.sequence_queries import _PRUNED, K, READS, _reads, kmer_cte, rc
from strandflow.tables import table


def kmer_range_clean(spark: SparkSession, d: str) -> DataFrame:
    """24-mers of 2 to 20 occurrences, context bits kept only to neighbours among them."""
    kept = kmers.kmer_table(_reads(spark, d), K).where("n between 2 and 20")
    return kmers.prune_adjacencies(kept)


def kmer_saturated(spark: SparkSession, d: str) -> DataFrame:
    """12-mers with their counts saturated at 255, and how many passed that."""
    rows = kmers.read_kmers(_reads(spark, d), 12).groupBy(F.least("fwd", F.reverse(F.translate("fwd", "ACGT", "TGCA"))).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.least("n", F.lit(255)).cast("int").alias("n")).agg(F.count(F.lit(1)).alias("kmers"))


def kmer_odd_canonical(spark: SparkSession, d: str) -> DataFrame:
    """25-mers by the representative with A or C in the middle, and whether they end an extension."""
    rows = kmers.read_kmers(_reads(spark, d), 25).groupBy(sequence.middle_canonical(F.col("fwd"), 25).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("kmer", "n", sequence.palindromic(F.col("kmer"), 25).alias("ends"))


def kmer_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where the 24-mers of 2 to 5 places stand: read, place and whether reversed there."""
    rows = kmers.read_kmers(_reads(spark, d), K).select("read_id", "pos", "fwd", F.reverse(F.translate("fwd", "ACGT", "TGCA")).alias("rev"))
    rows = rows.select(F.least("fwd", "rev").alias("kmer"), "read_id", "pos", (F.col("rev") < F.col("fwd")).alias("rc"))
    few = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 5").select("kmer")
    return rows.join(few, "kmer", "left_semi")


def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    """Of each read: longest run, share of the commonest letter, entropy, places of TATA, most G and C in 20 letters."""
    seq = F.col("seq")
    return _reads(spark, d).select(
        "read_id", sequence.longest_run(seq).alias("run"), F.round(sequence.commonest_share(seq), 6).alias("commonest"), F.round(sequence.entropy(seq), 6).alias("entropy"),
        F.array_join(sequence.find_all(seq, F.lit("TATA")).cast("array<string>"), ",").alias("tata"), F.array_max(sequence.window_gc(seq, 20)).alias("gc20"),
    )


def mate_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For each pair the longest end of mate 1 with which the reverse complement of mate 2 begins."""
    reads = _reads(spark, d)
    one = reads.where("read_id % 2 = 0").select(F.shiftright("read_id", 1).alias("pair"), F.col("seq").alias("s1"))
    two = reads.where("read_id % 2 = 1").select(F.shiftright("read_id", 1).alias("pair"), F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("s2"))
    return one.join(two, "pair").select("pair", sequence.longest_overlap(F.col("s1"), F.col("s2")).alias("overlap"), sequence.overlaps_by(F.col("s1"), F.col("s2"), 3).alias("by_three"))


def read_length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(_reads(spark, d).where("sample is not null").withColumn("len", F.length("seq")), "len", ["sample"])


def probability_table(spark: SparkSession, d: str) -> DataFrame:
    """For every part size n: normal distribution and its inverse, Poisson inverse, interval of a share, quality."""
    sizes = table(spark, d, "part").select(F.col("p_size").cast("double").alias("n")).where("n > 0").distinct()
    p = F.col("n") / 64
    share = stats.binomial_interval(F.floor(F.col("n") / 3), F.col("n"))
    return sizes.select(
        "n", F.round(stats.normal_cdf((F.col("n") - 25) / 8), 6).alias("cdf"), F.round(stats.normal_cdf(stats.normal_inverse(p)), 6).alias("back"), stats.poisson_inverse(p, 20.0).alias("poisson"),
        F.round(share["low"], 6).alias("low"), F.round(share["high"], 6).alias("high"), stats.phred(1 / (F.col("n") * F.col("n"))).alias("phred"),
    )


def combined_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Extended prices by ship month, each with a spread of its quantity, as one estimate."""
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_quantity")
    return stats.combined_normals(rows, ["month"], "l_extendedprice", "l_quantity").select("month", F.round("mean", 3).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def best_price_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The retail price that best parts parts of size 25 or more from the rest."""
    return stats.best_cutoff(table(spark, d, "part").select("p_retailprice", (F.col("p_size") >= 25).alias("large")), "p_retailprice", "large")


def sampled_orders(spark: SparkSession, d: str) -> DataFrame:
    """Twenty orders of each priority, drawn evenly."""
    return stats.reservoir(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 20).select("o_orderpriority", "o_orderkey")


def linear_fits(spark: SparkSession, d: str) -> DataFrame:
    """Least squares of price on quantity by line status, from the normal equations, with their determinant."""
    rows = table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("xx"),
        F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("xy"),
    )
    det = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / det
    return rows.select("l_linestatus", F.round(slope, 4).alias("slope"), F.round((F.col("y") - slope * F.col("x")) / F.col("n"), 4).alias("intercept"), (det > 0).alias("solvable"))


def coverage_cube(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority, over all four sets of the two."""
    rows = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.count(F.lit(1)).alias("orders"), F.grouping_id().cast("int").alias("level"))


def coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and language and by source alone, not by language."""
    docs = table(spark, d, "documents").select("source", "lang")
    return docs.groupingSets([["source", "lang"], ["source"]], "source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.grouping("lang").cast("int").alias("lang_open"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events from their JSON, as key and value, by event type; broken JSON has none."""
    props = F.from_json("props", "map<string,string>")
    rows = table(spark, d, "events").select("event_type", F.explode(props).alias("name", "held"))
    return rows.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held").try_cast("bigint")).alias("total"), F.max(F.col("held").try_cast("bigint")).alias("top"))


def widest_names(spark: SparkSession, d: str) -> DataFrame:
    """First and last part name by brand: aggregates over text, which Spark sorts for."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), F.max(F.struct("p_retailprice", "p_name"))["p_name"].alias("dearest"))


def nearest_band(spark: SparkSession, d: str) -> DataFrame:
    """Non-equal join: suppliers of each nation with customers of the same nation whose balance differs by at most 50.

    The band is an equal join on steps of its width, each row of one side laid into three of them.
    """
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal", F.explode(F.array(*[F.floor(F.col("s_acctbal") / 50) + i for i in (-1, 0, 1)])).alias("step"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal", F.floor(F.col("c_acctbal") / 50).alias("step"))
    met = s.join(c, ["nation", "step"]).where(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) <= 50)
    return met.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("near"), F.min("c_custkey").alias("first_customer"))


def plain_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same engine through its SQL: a catalogue view, a common table expression, a window and a SQL function."""
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"strandflow_{name}")
    spark.sql("create or replace temporary function strandflow_band(x double) returns bigint return cast(floor(x / 50000) as bigint)")
    return spark.sql("""
      with spent as (select o_custkey, sum(o_totalprice) total, count(*) orders from strandflow_orders group by o_custkey)
      select c_mktsegment, c_custkey, orders, strandflow_band(total) band, rank() over (partition by c_mktsegment order by total desc, c_custkey) place
      from spent join strandflow_customer on o_custkey = c_custkey""")


def n50_by_function(spark: SparkSession, d: str) -> DataFrame:
    """A user's aggregate over Arrow batches beside the built-in ones: of each sample the longest half of its reads' letters.

    What the function gets is the lengths of a sample and how often each stands, not its reads.
    """

    @F.pandas_udf("long")
    def half(lengths: pd.Series, n: pd.Series) -> int:
        both = pd.DataFrame({"len": lengths, "n": n}).sort_values("len", ascending=False)
        upto = (both["len"] * both["n"]).cumsum()
        return int(both["len"][upto * 2 >= upto.iloc[-1]].iloc[0])

    rows = stats.length_counts(_reads(spark, d).where("sample is not null").withColumn("size", F.length("seq")), "size", ["sample"])
    return rows.groupBy("sample").agg(half("len", "n").alias("half"))


def expanded_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A user's table function: sets of numbers such as {1,2,5-7}, made of each part's size, as rows."""
    from strandflow.sources.formats import parse_set

    @F.udtf(returnType="member int")
    class Members:
        def eval(self, text: str) -> Iterator[tuple[int]]:
            yield from ((n,) for n in parse_set(text))

    spark.udtf.register("strandflow_members", Members)
    parts = table(spark, d, "part").select(F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 2).cast("string"), F.lit("-"), (F.col("p_size") + 4).cast("string"), F.lit("}")).alias("text"))
    return spark.sql("select member, count(*) n from {parts} p, lateral strandflow_members(p.text) group by member", parts=parts)


def copy_number_share(spark: SparkSession, d: str) -> DataFrame:
    """Unipaths whose placements lie within a tenth of a multiple of 12, weighted by placements."""
    rows = placed_rows(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("placements"))
    return stats.whole_number_share(rows.withColumn("copies", F.col("placements") / 12), "copies", 0.1, "placements")


def shared_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unipaths that one read is placed on together, twice or more often: triangles of read and two paths."""
    on = placed_rows(spark, d).where("rid is not null").select("rid", "uid").distinct()
    other = on.select("rid", F.col("uid").alias("uid2"))
    return on.join(other, "rid").where("uid < uid2").groupBy("uid", "uid2").agg(F.count(F.lit(1)).alias("reads")).where("reads >= 2")


QUERIES = {
    f.__name__: f
    for f in (
        kmer_range_clean, kmer_saturated, kmer_odd_canonical, kmer_locations, sequence_features, mate_overlaps, read_length_distribution, probability_table, combined_estimates, best_price_cutoff,
        sampled_orders, linear_fits, coverage_cube, coverage_grouping_sets, event_properties, widest_names, nearest_band, plain_sql, n50_by_function, expanded_ranges, copy_number_share, shared_pairs,
    )
}

_R12 = f"(select substr(seq, p + 1, 12) f from (select seq, unnest(range(length(seq) - 11)) p from reads where length(seq) >= 12))"
_R25 = "(select substr(seq, p + 1, 25) f from (select seq, unnest(range(length(seq) - 24)) p from reads where length(seq) >= 25))"
_H = " + ".join(f"case when {b} > 0 then -({b} / t) * log2({b} / t) else 0 end" for b in "acgt")
_CDF = "(0.5 + {x} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 121), lambda i: exp(i * ln({x} * {x} + 1e-300) - coalesce(list_sum(list_transform(range(1, i + 1), lambda j: ln(2 * j + 1.0))), 0))))) "

SQL = {
    "kmer_range_clean": f"with {READS}, {kmer_cte('kt', 'reads', K, 'count(*) between 2 and 20')}, {_PRUNED} select kmer, n, pred, succ from pr",
    "kmer_saturated": f"with {READS}, c as (select least(f, {rc('f')}) kmer, count(*) n from {_R12} group by 1) select cast(least(n, 255) as int) n, count(*) kmers from c group by 1",
    "kmer_odd_canonical": f"""with {READS}, c as (select case when f[13] in ('A', 'C') then f else {rc('f')} end kmer, count(*) n from {_R25} group by 1)
        select kmer, n, kmer[1:24] = {rc('kmer[1:24]')} or kmer[2:25] = {rc('kmer[2:25]')} ends from c""",
    "kmer_locations": f"""with {READS}, k as (select read_id, cast(p as int) pos, substr(seq, p + 1, {K}) f from (select read_id, seq, unnest(range(length(seq) - {K - 1})) p from reads where length(seq) >= {K})),
        c as (select least(f, {rc('f')}) kmer, read_id, pos, {rc('f')} < f rc from k) select * from c where kmer in (select kmer from c group by kmer having count(*) between 2 and 5)""",
    "sequence_features": f"""with {READS}, c as (select read_id, seq, length(seq) n, {', '.join(f"cast(length(seq) - length(replace(seq, '{b}', '')) as double) {b.lower()}" for b in 'ACGT')} from reads),
        e as (select *, a + c + g + t t4 from c)
        select read_id, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: cast(length(x) as int))), 0) run, round(greatest(a, c, g, t) / n, 6) commonest, round({_H.replace('/ t)', '/ t4)')}, 6) entropy,
          array_to_string(list_filter(range(0, greatest(n - 3, 0)), lambda i: seq[i + 1 : i + 4] = 'TATA'), ',') tata,
          list_max(list_transform(range(0, greatest(n - 19, 0)), lambda i: cast(20 - length(replace(replace(seq[i + 1 : i + 20], 'G', ''), 'C', '')) as int))) gc20 from e""",
    "mate_overlaps": f"""with {READS}, p as (select a.read_id >> 1 pair, a.seq s1, {rc('b.seq')} s2 from reads a join reads b on b.read_id = a.read_id + 1 and a.read_id % 2 = 0)
        select pair, coalesce(list_max(list_transform(list_filter(range(1, least(length(s1), length(s2)) + 1), lambda i: right(s1, i) = left(s2, i)), lambda x: cast(x as int))), 0) overlap,
          length(s1) >= 3 and length(s2) >= 3 and right(s1, 3) = left(s2, 3) by_three from p""",
    "read_length_distribution": f"""with {READS}, r as (select sample, length(seq) l from reads where sample is not null)
        select sample, count(*) n, round(avg(l), 4) mean, round(sum(l * l) / count(*) - avg(l) * avg(l), 4) variance, {', '.join(f'cast(quantile_disc(l, {q / 100}) as bigint) q{q:02d}' for q in (5, 25, 50, 75, 95))} from r group by sample""",
    "probability_table": f"""with s as (select distinct cast(p_size as double) n from part where p_size > 0), x as (select *, (n - 25) / 8 x from s),
        po as (select n, min(k) poisson from s, (select k, sum(exp(-20.0 + k * ln(20.0) - lgamma(k + 1))) over (order by k) c from (select unnest(range(0, 300)) k)) where c >= n / 64 and n < 64 group by n)
        select n, round({_CDF.format(x='x')}, 6) cdf, case when n < 64 then round(n / 64, 6) end back, cast(poisson as int) poisson,
          round((h / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) low,
          round((h / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) high,
          cast(least(60, floor(-10 * log10(1 / (n * n)) + 0.5)) as int) phred
        from (select *, floor(n / 3) h from x) left join po using (n)""",
    "combined_estimates": """with r as (select strftime(l_shipdate, '%Y-%m') "month", l_extendedprice m, 1 / (l_quantity * l_quantity) w from lineitem where l_extendedprice is not null and l_quantity > 0)
        select "month", round(sum(m * w) / sum(w), 3) mean, round(sqrt(1 / sum(w)), 6) sd, count(*) n from r group by 1""",
    "best_price_cutoff": """with p as (select p_retailprice v, p_size >= 25 g from part where p_retailprice is not null and p_size is not null), d as (select v, count(*) filter (g) g, count(*) filter (not g) b from p group by v),
        c as (select v, coalesce(sum(g) over w, 0) + (select sum(b) from d) - coalesce(sum(b) over w, 0) wrong from d window w as (order by v rows between unbounded preceding and 1 preceding))
        select v cutoff, cast(wrong as bigint) wrong from c order by wrong, v limit 1""",
    "sampled_orders": "select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by md5(cast(o_orderkey as varchar)), o_orderkey) r from orders) where r <= 20",
    "linear_fits": "select l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, var_pop(l_quantity) > 0 solvable from lineitem group by 1",
    "coverage_cube": "select o_orderstatus, o_orderpriority, count(*) orders, cast(grouping_id(o_orderstatus, o_orderpriority) as int) as level from orders group by cube (o_orderstatus, o_orderpriority)",
    "coverage_grouping_sets": "select source, lang, count(*) documents, cast(grouping(lang) as int) lang_open from documents group by grouping sets ((source, lang), (source))",
    "event_properties": """with p as (select event_type, unnest(json_keys(props)) name, props from events where json_valid(props)), v as (select event_type, name, try_cast(json_extract_string(props, '$.' || name) as bigint) h from p)
        select event_type, name, count(*) n, cast(sum(h) as bigint) total, max(h) top from v group by 1, 2""",
    "widest_names": "select p_brand, min(p_name) first_name, max(p_name) last_name, arg_max(p_name, (p_retailprice, p_name)) dearest from part group by 1",
    "nearest_band": "select s_suppkey, count(*) near, min(c_custkey) first_customer from supplier join customer on s_nationkey = c_nationkey and abs(s_acctbal - c_acctbal) <= 50 group by 1",
    "plain_sql": """with spent as (select o_custkey, sum(o_totalprice) total, count(*) orders from orders group by o_custkey)
        select c_mktsegment, c_custkey, orders, cast(floor(total / 50000) as bigint) band, cast(rank() over (partition by c_mktsegment order by total desc, c_custkey) as int) place from spent join customer on o_custkey = c_custkey""",
    "n50_by_function": f"""with {READS}, r as (select sample, length(seq) l from reads where sample is not null), c as (select sample, l, sum(l) over (partition by sample order by l desc range unbounded preceding) u, sum(l) over (partition by sample) t from r)
        select sample, cast(max(case when u * 2 >= t then l end) as bigint) half from c group by 1""",
    "expanded_ranges": "select cast(unnest([p_size, p_size + 2, p_size + 3, p_size + 4]) as int) member, count(*) n from part where p_size is not null group by 1",
    "copy_number_share": f"""with u as (select uid, count(*) n from ({_LOC_ROWS}) group by 1), k as (select n, n / 12.0 c from u where n / 12.0 > 0.5)
        select cast(sum(n) as bigint) n, cast(sum(case when abs(c - round(c)) <= 0.1 then n else 0 end) as bigint) near, round(sum(case when abs(c - round(c)) <= 0.1 then n else 0 end) / sum(n), 6) share from k""",
    "shared_pairs": f"""with o as (select distinct rid, uid from ({_LOC_ROWS}) where rid is not null) select a.uid, b.uid uid2, count(*) reads from o a join o b on a.rid = b.rid and a.uid < b.uid group by 1, 2 having count(*) >= 2""",
}
