"""Read correction by columns of stacked reads.

``cells`` has stack, col, member, base and q: for each stack (a read and its friends) the letter and
quality that each member puts on a column; member 0 is the read itself. A stack is as large as a
read has friends, and heavy k-mers are cut before stacks are made, as their definition says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.dna import kmers_of


def friends(reads: DataFrame, k: int, most: int = 1000) -> DataFrame:
    """(read_id, friend, offset, seeds): reads that share k-mers, by the offset of the friend.

    k-mers in more than ``most`` places are no seeds. That cut is part of the rule, and what keeps
    the join from multiplying.
    """
    rows = reads.where(F.length("seq") >= k).select("read_id", F.posexplode(kmers_of(F.col("seq"), k)).alias("pos", "kmer"))
    usable = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("kmer")
    seeds = rows.join(usable, "kmer")
    other = seeds.select("kmer", F.col("read_id").alias("friend"), F.col("pos").alias("there"))
    met = seeds.join(other, "kmer").where("read_id <> friend")
    return met.groupBy("read_id", "friend", (F.col("pos") - F.col("there")).alias("offset")).agg(F.count(F.lit(1)).alias("seeds"))


def stacks(reads: DataFrame, found: DataFrame) -> DataFrame:
    """cells of every read with its friends, cut to the columns of the read."""
    own = reads.select(F.col("read_id").alias("stack"), F.lit(0).alias("offset"), F.col("read_id").alias("of"), F.lit(0).alias("member"), F.length("seq").alias("width"))
    width = reads.select(F.col("read_id").alias("stack"), F.length("seq").alias("width"))
    met = found.select(F.col("read_id").alias("stack"), "offset", F.col("friend").alias("of"), F.lit(1).alias("member")).join(width, "stack")
    text = reads.select(F.col("read_id").alias("of"), "seq", "qual")
    laid = own.unionByName(met).join(text, "of")
    each = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.struct(F.substring("seq", i, F.lit(1)).alias("base"), F.coalesce(F.get("qual", i - 1), F.lit(0)).alias("q")))
    rows = laid.select("stack", "member", "of", "offset", "width", F.posexplode(each).alias("i", "c"))
    return rows.select("stack", (F.col("offset") + F.col("i")).alias("col"), "member", "of", "c.base", "c.q", "width").where("col >= 0 and col < width").drop("width")


def corrected(cells: DataFrame, top: int = 50, ratio: int = 10, most: int = 100) -> DataFrame:
    """(stack, col, base, q, changed): what each column of a read becomes, up to its trim point.

    Qualities are summed by base, those of 2 or less as 0.2 at most; each losing base loses its
    single best quality again. A column stands if the winner has ``top``, ``ratio`` times the
    runner-up, which has at most ``most``. A changed base gets quality 0. The first column that
    does not stand, and all after it, are cut off.
    """
    tenths = F.when(F.col("q") <= 2, F.least(F.col("q") * 10, F.lit(2))).otherwise(F.col("q") * 10)
    sums = cells.withColumn("w", tenths).groupBy("stack", "col", "base").agg(F.sum("w").alias("w"), F.max("w").alias("best"))
    rank = Window.partitionBy("stack", "col").orderBy(F.desc("w"), "base")
    ranked = sums.withColumn("r", F.row_number().over(rank)).withColumn("w", F.when(F.col("r") == 1, F.col("w")).otherwise(F.col("w") - F.col("best")))
    won = ranked.groupBy("stack", "col").agg(F.max(F.when(F.col("r") == 1, F.struct("base", "w"))).alias("a"), F.coalesce(F.max(F.when(F.col("r") > 1, F.col("w"))), F.lit(0)).alias("second"))
    stands = (F.col("a.w") >= 10 * top) & (F.col("a.w") >= ratio * F.col("second")) & (F.col("second") <= 10 * most)
    own = cells.where("member = 0").select("stack", "col", F.col("base").alias("was"), "q")
    rows = own.join(won, ["stack", "col"]).select("stack", "col", "was", "q", F.col("a.base").alias("base"), stands.alias("stands"))
    cut = rows.groupBy("stack").agg(F.min(F.when(~F.col("stands"), F.col("col"))).alias("trim"))
    kept = rows.join(cut, "stack").where(F.col("trim").isNull() | (F.col("col") < F.col("trim")))
    changed = F.col("base") != F.col("was")
    return kept.select("stack", "col", "base", F.when(changed, 0).otherwise(F.col("q")).alias("q"), changed.alias("changed"))


def high_quality_conflicts(cells: DataFrame, least: int = 30) -> DataFrame:
    """(stack, of): friends with a letter unlike the read's where both qualities reach ``least``."""
    own = cells.where("member = 0").select("stack", "col", F.col("base").alias("mine"), F.col("q").alias("mq"))
    return cells.where("member > 0").join(own, ["stack", "col"]).where((F.col("base") != F.col("mine")) & (F.col("q") >= least) & (F.col("mq") >= least)).select("stack", "of").distinct()


def consensus(cells: DataFrame) -> DataFrame:
    """(stack, col, base, q): summed call of each column; quality is the lead over the runner-up, 50 at most.

    A quality of 0 counts 0.1, of 1 or 2 at most 0.2. Where the runner-up exceeds 100 and two
    members of 30 or more put it there, the quality is 0.
    """
    tenths = F.when(F.col("q") == 0, 1).when(F.col("q") <= 2, 2).otherwise(F.col("q") * 10)
    sums = cells.withColumn("w", tenths).groupBy("stack", "col", "base").agg(F.sum("w").alias("w"), F.count_if(F.col("q") >= 30).alias("sure"))
    rank = Window.partitionBy("stack", "col").orderBy(F.desc("w"), "base")
    two = sums.withColumn("r", F.row_number().over(rank)).where("r <= 2").groupBy("stack", "col").agg(
        F.max(F.when(F.col("r") == 1, F.struct("base", "w"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("w", "sure"))).alias("b")
    )
    second = F.coalesce(F.col("b.w"), F.lit(0))
    q = F.when((second > 1000) & (F.col("b.sure") >= 2), 0).otherwise(F.least(F.lit(50), F.round((F.col("a.w") - second) / 10))).cast("int")
    return two.select("stack", "col", F.col("a.base").alias("base"), q.alias("q"))


def capped_qualities(reads: DataFrame, radius: int) -> DataFrame:
    """Reads with each quality lowered to the least within ``radius`` of it."""
    n = F.size("qual")
    low = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice("qual", F.greatest(i - radius, F.lit(1)), F.least(i + radius, n) - F.greatest(i - radius, F.lit(1)) + 1)))
    return reads.withColumn("qual", F.when(n > 0, low).otherwise(F.col("qual")))


def zeroed_where_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(read_id, seq, qual): the later reads, quality 0 wherever a letter differs from the earlier read."""
    a = before.select("read_id", F.col("seq").alias("was"))
    same = lambda i: F.substring("seq", i + 1, F.lit(1)) == F.substring("was", i + 1, F.lit(1))
    return after.join(a, "read_id").select("read_id", "seq", F.transform("qual", lambda q, i: F.when(same(i), q).otherwise(F.lit(0))).alias("qual"))
