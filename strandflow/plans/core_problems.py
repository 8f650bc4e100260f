"""Queries p1, p4 and p5: the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.dna import counted_kmer_nodes
from strandflow.operators.intervals import covered, gaps
from strandflow.operators.rejects import SAM, VARIANT, load_or_reject
from strandflow.operators.tree_agg import key_figures, tree_aggregate
from strandflow.session import cut
from strandflow.tables import table


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for src, fmt in (("sam_lines", SAM), ("variant_lines", VARIANT)):
        _, bad = load_or_reject(table(spark, d, src), fmt)
        parts.append(bad.select(F.lit(src).alias("src"), "line_id", "reason"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, d).select("src", "line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, d).groupBy("src", "reason").agg(F.count(F.lit(1)).alias("n"))


def p1_loaded_sam(spark: SparkSession, d: str) -> DataFrame:
    good, _ = load_or_reject(table(spark, d, "sam_lines"), SAM)
    return good.select("line_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", F.size("tags").cast("bigint").alias("n_tags"))


def p1_loaded_variants(spark: SparkSession, d: str) -> DataFrame:
    good, _ = load_or_reject(table(spark, d, "variant_lines"), VARIANT)
    return good.select("line_id", "chrom", "pos1", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", "filters", F.size("infos").cast("bigint").alias("n_infos"))


def placed_rows(spark: SparkSession, d: str) -> DataFrame:
    """read_locs rows that count: distinct in (uid, start_pos, rid, rc), uid of 0 or more."""
    return table(spark, d, "read_locs").where("uid >= 0").select("uid", "start_pos", "rid", "rc").distinct()


def p4_figures(spark: SparkSession, d: str) -> DataFrame:
    """Per-key figures of both tables: rows, reads (read_locs) or batches (kmer_nodes), summed counts."""
    locs = key_figures(placed_rows(spark, d), "uid", member="rid")
    nodes = key_figures(counted_kmer_nodes(table(spark, d, "kmer_nodes")), "kmer", member="batch_id", sums={"total": F.col("n").cast("bigint")})
    return locs.select(F.lit("read_locs").alias("src"), F.col("uid").cast("string").alias("key_val"), "n_rows", "n_members", F.lit(None).cast("bigint").alias("total")).unionByName(
        nodes.select(F.lit("kmer_nodes").alias("src"), F.col("kmer").alias("key_val"), "n_rows", "n_members", "total")
    )


def p4_found(spark: SparkSession, d: str, share: int = 100) -> DataFrame:
    """Keys that hold at least 1/share of the rows of their table."""
    locs = key_figures(placed_rows(spark, d), "uid")
    nodes = key_figures(counted_kmer_nodes(table(spark, d, "kmer_nodes")), "kmer")
    both = cut(
        locs.select(F.lit("read_locs").alias("src"), F.col("uid").cast("string").alias("key_val"), "n_rows").unionByName(
            nodes.select(F.lit("kmer_nodes").alias("src"), F.col("kmer").alias("key_val"), "n_rows")
        )
    )
    totals = tree_aggregate(both, ["src"], {"rows_in_all": ("sum", F.col("n_rows"))})  # two rows
    return both.join(F.broadcast(totals), "src").where(F.col("n_rows") * share >= F.col("rows_in_all")).select("src", "key_val")


def _glocs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_glocs").where("start_pos >= 0 and stop_pos > start_pos and gid is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return gaps(_glocs(spark, d), "gid", "start_pos", "stop_pos")


def p5_covered(spark: SparkSession, d: str) -> DataFrame:
    return covered(_glocs(spark, d), "gid", "start_pos", "stop_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded_sam, p1_loaded_variants, p4_found, p4_figures, p5_found, p5_covered)}

_F = '(?:"(?:[^"]|"")*"|[^",]*)'


def _int(x: str) -> str:
    # evaluated stepwise: the cast only sees digits
    return f"(case when regexp_full_match({x}, '0*[0-9]{{1,10}}') then cast({x} as bigint) <= 2147483647 else false end)"


_SAM_OK = f"""
  select line_id, f, len(f) >= 11 and {_int('f[2]')} and {_int('f[4]')} and {_int('f[5]')} and {_int('f[8]')}
    and (case when starts_with(f[9], '-') then {_int('f[9][2:]')} else {_int('f[9]')} end)
    and not (case when {_int('f[4]')} and {_int('f[2]')} then cast(f[4] as bigint) = 0 and (cast(f[2] as bigint) & 4) = 0 else true end) as ok
  from (select line_id, string_split(regexp_replace(line, '\\r$', ''), chr(9)) f from sam_lines
        where line is not null and regexp_matches(line, '\\S') and not starts_with(line, '@'))"""
_G = '("(?:[^"]|"")*"|[^",]*)'
_NINE = ",".join([_G] * 9)
_UNQ = "case when starts_with({0}, '\"') then replace({0}[2:len({0})-1], '\"\"', '\"') else {0} end"
_VAR_OK = f"""
  select line_id, v, nine, nine and v[1] <> '' and {_int('v[2]')} and (case when {_int('v[2]')} then cast(v[2] as bigint) >= 1 else false end)
    and regexp_full_match(v[4], '[ACGTNacgtn]+') and (v[6] = '.' or regexp_full_match(v[6], '[0-9]+(\\.[0-9]+)?')) as ok
  from (select line_id, nine, case when nine then list_transform(g, lambda x: {_UNQ.format('x')}) else ['','','','','','','','',''] end v
    from (select line_id, regexp_full_match(line, '(?s){_NINE}') nine,
            [{', '.join(f"regexp_extract(line, '^(?s:{_NINE})$', {i})" for i in range(1, 10))}] g
          from variant_lines where line is not null and regexp_matches(line, '\\S') and not starts_with(line, '#')))"""

_KMER_ROWS = """
  select distinct node_id, batch_id, least(u, r) kmer, n,
    case when r < u then ((kc&1)<<7)|((kc&2)<<5)|((kc&4)<<3)|((kc&8)<<1)|((kc&16)>>1)|((kc&32)>>3)|((kc&64)>>5)|((kc&128)>>7) else kc end kc
  from (select node_id, batch_id, upper(kmer) u, reverse(translate(upper(kmer), 'ACGT', 'TGCA')) r, kc, greatest(coalesce(n, 1), 1) n
        from kmer_nodes where kc is not null and regexp_full_match(kmer, '[ACGTacgt]{24}'))"""
_LOC_ROWS = "select distinct uid, start_pos, rid, rc from read_locs where uid >= 0"
_MERGED = """
  select gid, min(start_pos) a, max(stop_pos) b from (
    select *, sum(case when start_pos <= reach then 0 else 1 end) over (partition by gid order by start_pos, stop_pos rows unbounded preceding) island from (
      select gid, start_pos, stop_pos, max(stop_pos) over (partition by gid order by start_pos, stop_pos rows between unbounded preceding and 1 preceding) reach
      from read_glocs where gid is not null and start_pos >= 0 and stop_pos > start_pos))
  group by gid, island"""

_SAM_WHY = f"""case when len(f) < 11 then 'too few fields' when not {_int('f[2]')} then 'FLAG is no whole number' when not {_int('f[4]')} then 'POS is no whole number' when not {_int('f[5]')} then 'MAPQ is no whole number'
  when not {_int('f[8]')} then 'PNEXT is no whole number' when not (case when starts_with(f[9], '-') then {_int('f[9][2:]')} else {_int('f[9]')} end) then 'TLEN is no number' else 'POS is 0 in a mapped record' end"""
_VAR_WHY = f"""case when not regexp_full_match(line, '(?s){_F}(,{_F})*') then 'quoting is broken' when not nine then 'not nine fields' when v[1] = '' then 'CHROM is empty'
  when not (case when {_int('v[2]')} then cast(v[2] as bigint) >= 1 else false end) then 'POS1 is no whole number of at least 1' when not regexp_full_match(v[4], '[ACGTNacgtn]+') then 'REF is not letters of ACGTN' else 'QUAL is neither a point nor a number' end"""
SQL = {
    "p1_reasons": f"""select src, reason, count(*) n from (select 'sam_lines' src, {_SAM_WHY} reason from ({_SAM_OK}) where not ok
        union all select 'variant_lines', {_VAR_WHY} from (select x.*, l.line from ({_VAR_OK}) x join variant_lines l using (line_id)) where not ok) group by 1, 2""",
    "p1_found": f"select 'sam_lines' src, line_id from ({_SAM_OK}) where not ok union all select 'variant_lines', line_id from ({_VAR_OK}) where not ok",
    "p1_loaded_sam": f"""select line_id, f[1] qname, cast(f[2] as int) flag, f[3] rname, cast(f[4] as int) pos, cast(f[5] as int) mapq, f[6] cigar, f[7] rnext,
        cast(f[8] as int) pnext, cast(f[9] as int) tlen, f[10] seq, cast(len(f) - 11 as bigint) n_tags from ({_SAM_OK}) where ok""",
    "p1_loaded_variants": f"""select line_id, v[1] chrom, cast(v[2] as int) pos1, v[3] id, v[4] "ref", v[5] alts, case when v[6] = '.' then null else cast(v[6] as double) end qual, v[7] filters,
        cast(len(string_split(v[8], ';')) as bigint) n_infos from ({_VAR_OK}) where ok""",
    "p4_found": f"""with l as (select cast(uid as varchar) k, count(*) n from ({_LOC_ROWS}) group by 1), m as (select kmer k, count(*) n from ({_KMER_ROWS}) group by 1)
        select 'read_locs' src, k key_val from l where n * 100 >= (select sum(n) from l) union all select 'kmer_nodes', k from m where n * 100 >= (select sum(n) from m)""",
    "p4_figures": f"""select 'read_locs' src, cast(uid as varchar) key_val, count(*) n_rows, count(distinct rid) n_members, cast(null as bigint) total from ({_LOC_ROWS}) group by uid
        union all select 'kmer_nodes', kmer, count(*), count(distinct batch_id), cast(sum(n) as bigint) from ({_KMER_ROWS}) group by kmer""",
    "p5_found": f"select gid, b gap_start, nxt gap_stop from (select gid, b, lead(a) over (partition by gid order by a) nxt from ({_MERGED})) where nxt is not null",
    "p5_covered": f"select gid, a cover_start, b cover_stop from ({_MERGED})",
}
