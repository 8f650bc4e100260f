"""Queries p2, p3, p6, p7 and p8, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.dna import counted_kmer_nodes
from strandflow.llm import bpe, frequency, leaks, spans, stuffing
from strandflow.tables import table

TOKENIZERS = os.environ.get("STRANDFLOW_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "oreads"), "read_id", "seq", least=50)


def p2_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "oreads"), "read_id", "seq", least=50)


def _node_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = counted_kmer_nodes(table(spark, d, "kmer_nodes"))
    suffixes = frequency.term_suffixes(nodes, [F.col("kmer"), F.col("kc")], F.col("batch_id"), F.col("n"), F.col("node_id"))
    counts = frequency.term_counts(suffixes, [2])
    return frequency.mark(counts, least_total=4, most_records=20).select(F.col("t1").alias("kmer"), F.col("t2").alias("kc"), "total", "records", "too_rare", "too_common")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _node_counts(spark, d).where("too_rare or too_common").select("kmer", "kc")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _node_counts(spark, d)


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words of all documents, with occurrences and documents."""
    docs = table(spark, d, "documents").select("doc_id", leaks.words(F.col("text")).alias("w"))
    counts = frequency.term_counts(frequency.token_suffixes(docs, "w", "doc_id", 2), [1, 2])
    return frequency.mark(counts, least_total=4, most_records=2000)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", PATTERN)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), 12)


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The longest overlap of document and item, of eight words or more, a changed word or two being tolerated."""
    return leaks.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"), masks=leaks.PAIR_MASKS, most_changed=2).where("overlap >= 8").drop("run")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of stuffed characters of every document."""
    return stuffing.page_shares(table(spark, d, "documents")).select("doc_id", F.round("stuffed_share", 6).alias("stuffed_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_share, p3_found, p3_counts, p3_terms, p6_ids, p7_found, p7_overlaps, p8_found, p8_shares)}

_NODES = """
  select distinct node_id, batch_id, least(u, r) kmer, n,
    case when r < u then ((kc&1)<<7)|((kc&2)<<5)|((kc&4)<<3)|((kc&8)<<1)|((kc&16)>>1)|((kc&32)>>3)|((kc&64)>>5)|((kc&128)>>7) else kc end kc
  from (select node_id, batch_id, upper(kmer) u, reverse(translate(upper(kmer), 'ACGT', 'TGCA')) r, kc, greatest(coalesce(n, 1), 1) n
        from kmer_nodes where kc is not null and regexp_full_match(kmer, '[ACGTacgt]{24}'))"""
_SHARED = """
  with r as (select distinct read_id, seq from oreads where read_id is not null and length(seq) >= 50),
  w as (select read_id, p, substr(seq, p + 1, 50) s from (select read_id, seq, unnest(range(length(seq) - 49)) p from r)),
  hit as (select read_id, p from w where s in (select s from w group by s having min(read_id) < max(read_id))),
  isl as (select read_id, p, sum(case when p <= prev + 50 then 0 else 1 end) over (partition by read_id order by p) g
          from (select read_id, p, lag(p) over (partition by read_id order by p) prev from hit)),
  span as (select read_id, cast(min(p) as int) span_start, cast(max(p) + 50 as int) span_stop from isl group by read_id, g)"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"

SQL = {
    "p2_found": f"{_SHARED} select read_id, span_start, span_stop from span",
    "p2_share": f"""{_SHARED}, len as (select read_id, max(length(seq)) n_letters from (select distinct read_id, seq from oreads where read_id is not null and seq is not null) group by 1),
        size as (select cast(50 * pow(2, i) as int) z from range(12) t(i)), wz as (select distinct read_id, z, substr(seq, p + 1, z) s from (select read_id, seq, z, unnest(range(length(seq) - z + 1)) p from r join size on length(seq) >= z)),
        top as (select read_id, max(z) longest from wz where (z, s) in (select (z, s) from wz group by z, s having count(*) > 1) group by 1),
        sh as (select read_id, sum(span_stop - span_start) n_shared from span group by 1)
        select read_id, cast(n_letters as int) n_letters, cast(coalesce(n_shared, 0) as bigint) n_shared, coalesce(longest, 0) longest from len left join sh using (read_id) left join top using (read_id)""",
    "p3_found": f"select kmer, kc from ({_NODES}) group by kmer, kc having sum(n) < 4 or count(distinct batch_id) > 20",
    "p3_counts": f"select kmer, kc, cast(sum(n) as bigint) total, count(distinct batch_id) records, sum(n) < 4 too_rare, count(distinct batch_id) > 20 too_common from ({_NODES}) group by kmer, kc",
    "p3_terms": f"""with w as (select doc_id, {_WORDS} w from documents), s as (select doc_id, unnest(range(1, len(w) + 1)) i, w from w),
        t as (select doc_id, cast(1 as int) m, w[i] t1, cast(null as varchar) t2 from s union all select doc_id, 2, w[i], w[i+1] from s where i < len(w))
        select m, t1, t2, count(*) total, count(distinct doc_id) records, count(*) < 4 too_rare, count(distinct doc_id) > 2000 too_common from t group by m, t1, t2""",
    "p7_found": f"""with d as (select doc_id, unnest(range(1, len(w) - 10)) i, w from (select doc_id, {_WORDS} w from documents) where len(w) >= 12),
        e as (select item_id, unnest(range(1, len(w) - 10)) i, w from (select item_id, {_WORDS} w from eval_items) where len(w) >= 12),
        dh as (select doc_id, array_to_string(w[i:i+11], ' ') s from d), eh as (select item_id, array_to_string(w[i:i+11], ' ') s from e)
        select distinct doc_id, item_id from dh join eh using (s)""",
    "p7_overlaps": f"""with d as (select doc_id, w, unnest(range(1, len(w))) i from (select doc_id, {_WORDS} w from documents)), e as (select item_id, w, unnest(range(1, len(w))) j from (select item_id, {_WORDS} w from eval_items)),
        a as (select distinct doc_id, item_id, i - j s, d.w dw, e.w ew from d join e on d.w[i] = e.w[j] and d.w[i + 1] = e.w[j + 1]),
        q as (select doc_id, item_id, s, dw, ew, unnest(range(greatest(1, 1 + s), least(len(dw), len(ew) + s) + 1)) p from a),
        m as (select doc_id, item_id, s, p, p - row_number() over (partition by doc_id, item_id, s order by p) g from q where dw[p] = ew[p - s]),
        r as (select doc_id, item_id, s, min(p) a, max(p) + 1 b, count(*) n from m group by doc_id, item_id, s, g),
        l as (select doc_id, item_id, a, b, n, lead(b) over w b1, lead(n) over w n1, lead(b, 2) over w b2, lead(n, 2) over w n2 from r window w as (partition by doc_id, item_id, s order by a)),
        o as (select doc_id, item_id, b - a len, 0 c from l union all select doc_id, item_id, b1 - a, b1 - a - n - n1 from l where b1 - a - n - n1 <= 2
          union all select doc_id, item_id, b2 - a, b2 - a - n - n1 - n2 from l where b2 - a - n - n1 - n2 <= 2)
        select doc_id, item_id, cast(max(len) as int) overlap, cast(arg_min(c, (-len, c)) as int) changed from o where len >= 8 group by doc_id, item_id""",
}
