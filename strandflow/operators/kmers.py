"""k-mers of reads: trimming by quality, counting with context, filters, spectra.

All of it is column expressions and hash aggregates inside the JVM; a heavy k-mer is combined on the
map side, so it is one row per task when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.dna import canonical, kmers_of, revcomp
from strandflow.session import cut_large

#: Bits of ``at`` for the place on a read; longer reads count anew.
AT_BITS = 20


def clean_reads(oreads: DataFrame) -> DataFrame:
    """(read_id, seq, qual, sample): each read once, N read as A, unreadable rows left out.

    Rows without an id or with a null or empty sequence are no reads. A null quality list is empty.
    """
    rows = oreads.where("read_id is not null and length(seq) > 0").select(
        "read_id", F.translate(F.upper("seq"), "N", "A").alias("seq"), F.coalesce("qual", F.array().cast("array<int>")).alias("qual"), "sample"
    )
    return rows.distinct()


def good_length(qual: Column, k: int, min_qual: int) -> Column:
    """Length of the prefix that ends with the right-most window of k qualities of at least min_qual; 0 if none."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def step(state: Column, q: Column) -> Column:
        run = F.when(q >= min_qual, state["run"] + 1).otherwise(F.lit(0))
        at = state["at"] + 1
        return F.struct(run.alias("run"), F.when(run >= k, at).otherwise(state["best"]).alias("best"), at.alias("at"))

    return F.aggregate(qual, start, step, lambda s: s["best"])


def trimmed(reads: DataFrame, k: int, min_qual: int) -> DataFrame:
    """Reads cut to their good prefix; kept only where it is longer than k."""
    good = F.least(good_length(F.col("qual"), k, min_qual), F.length("seq"))
    return reads.withColumn("good", good).where(F.col("good") > k).withColumn("seq", F.substring(F.col("seq"), F.lit(1), F.col("good")))


def read_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, fwd): every k-mer of every read as it stands, pos from 0."""
    return reads.where(F.length("seq") >= k).select("read_id", F.posexplode(kmers_of(F.col("seq"), k)).alias("pos", "fwd"))


def base_bit(letter: Column) -> Column:
    """A C G T -> 1 2 4 8; 0 for none."""
    return F.when(letter == "A", 1).when(letter == "C", 2).when(letter == "G", 4).when(letter == "T", 8).otherwise(0)


def complement_bits(bits: Column) -> Column:
    """The bit of each letter moved to that of its complement."""
    out = F.lit(0)
    for i in range(4):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(bits, i).bitwiseAND(F.lit(1)), 3 - i))
    return out


def context_kmers(reads: DataFrame, k: int, placed: bool = False) -> DataFrame:
    """(kmer, pred, succ): canonical k-mers with the bits of the letters before and after, one row each time.

    placed: also ``at``, where it stands: ``AT_BITS`` bits of the place on the read, one for a k-mer that
    is turned there, and above them what is left of a hash of the read. Unlike reads may share it.
    """
    seq = F.col("seq")
    around = F.transform(
        F.sequence(F.lit(1), F.length(seq) - (k - 1)),
        lambda i: F.struct(
            F.substring(seq, i, F.lit(k)).alias("fwd"), F.when(i > 1, F.substring(seq, i - 1, F.lit(1))).alias("b"), F.substring(seq, i + k, F.lit(1)).alias("a"), *([i.cast("bigint").alias("i")] if placed else [])
        ),
    )
    text = [F.shiftleft(F.xxhash64(seq), AT_BITS + 1).alias("text")] if placed else []
    own = ["text", "i"] if placed else []
    rows = reads.where(F.length("seq") >= k).select(*text, F.inline(around)).select("fwd", revcomp(F.col("fwd")).alias("rev"), base_bit(F.col("b")).alias("b"), base_bit(F.col("a")).alias("a"), *own)
    turned = F.col("rev") < F.col("fwd")
    at = F.col("text").bitwiseOR(F.shiftleft(F.col("i").bitwiseAND(F.lit((1 << AT_BITS) - 1)), 1)).bitwiseOR(turned.cast("bigint"))
    return rows.select(
        F.least("fwd", "rev").alias("kmer"),
        F.when(turned, complement_bits(F.col("a"))).otherwise(F.col("b")).alias("pred"),
        F.when(turned, complement_bits(F.col("b"))).otherwise(F.col("a")).alias("succ"),
        *([at.alias("at")] if placed else []),
    )


def placed_kmers(texts: DataFrame, k: int) -> DataFrame:
    """(kmer, pred, succ, at): all canonical k-mers of texts(seq), contexts joined, each with one of its places.

    As none is left out, every neighbour that a bit names is among them: there is nothing to prune.
    """
    return context_kmers(texts, k, placed=True).groupBy("kmer").agg(F.bit_or("pred").alias("pred"), F.bit_or("succ").alias("succ"), F.min("at").alias("at"))


def count_kmers(rows: DataFrame) -> DataFrame:
    """(kmer, n, pred, succ): occurrences summed, contexts joined."""
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.bit_or("pred").alias("pred"), F.bit_or("succ").alias("succ"))


def kmer_table(reads: DataFrame, k: int, min_qual: int | None = None, min_freq: int = 1) -> DataFrame:
    """Canonical k-mers of at least min_freq occurrences; with min_qual, of the good prefixes only."""
    used = trimmed(reads, k, min_qual) if min_qual is not None else reads
    return count_kmers(context_kmers(used, k)).where(F.col("n") >= min_freq)


def neighbours(kmers: DataFrame) -> DataFrame:
    """(kmer, side, letter, other): each context bit as a row, with the canonical neighbour it names."""
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    bits = F.flatten(
        F.array(
            *[
                F.filter(F.transform(letters, lambda x, i: F.when(F.shiftright(F.col(side), 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0, F.struct(F.lit(side).alias("side"), x.alias("letter")))), lambda x: x.isNotNull())
                for side in ("pred", "succ")
            ]
        )
    )
    rows = kmers.select("kmer", F.inline(bits))
    k = F.length("kmer")
    other = F.when(F.col("side") == "succ", F.concat(F.substring(F.col("kmer"), F.lit(2), k), F.col("letter"))).otherwise(F.concat(F.col("letter"), F.substring(F.col("kmer"), F.lit(1), k - 1)))
    return rows.select("kmer", "side", "letter", canonical(other).alias("other"))


def prune_adjacencies(kmers: DataFrame) -> DataFrame:
    """The same k-mers with the context bits dropped whose neighbour is not among them."""
    kmers = cut_large(kmers)  # read three times below
    kept = neighbours(kmers).join(kmers.select(F.col("kmer").alias("other")), "other", "left_semi")
    bits = kept.groupBy("kmer").agg(
        F.bit_or(F.when(F.col("side") == "pred", base_bit(F.col("letter"))).otherwise(0)).alias("pred"),
        F.bit_or(F.when(F.col("side") == "succ", base_bit(F.col("letter"))).otherwise(0)).alias("succ"),
    )
    return kmers.select("kmer", "n").join(bits, "kmer", "left").select("kmer", "n", F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("succ", F.lit(0)).alias("succ"))


def histogram(kmers: DataFrame, cap: int | None = 100) -> DataFrame:
    """(n, kmers): how many k-mers occur n times, all above the cap together; without a cap every n by itself."""
    n = F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap))
    return kmers.groupBy(n.cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("kmers"))


def affix_spectrum(kmers: DataFrame) -> DataFrame:
    """(n_pred, n_succ, kmers, total) by how many letters precede and follow."""
    return kmers.groupBy(F.bit_count("pred").alias("n_pred"), F.bit_count("succ").alias("n_succ")).agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("total"))


def bispectrum(a: DataFrame, b: DataFrame, cap: int | None = 20) -> DataFrame:
    """(na, nb, kmers): k-mers by their occurrences in two sets, absent counting 0; all above the cap together, if there is one."""
    both = a.select("kmer", F.col("n").alias("na")).join(b.select("kmer", F.col("n").alias("nb")), "kmer", "full")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("na", "nb")}
    capped = [(n if cap is None else F.least(n, F.lit(cap))).cast("bigint").alias(c) for c, n in counts.items()]
    return both.select(*capped).groupBy("na", "nb").agg(F.count(F.lit(1)).alias("kmers"))


def set_sizes(reads: DataFrame, k: int) -> DataFrame:
    """(part, kmers): sizes of the intersection, the differences and the union of the canonical k-mers of
    two sets of reads, which the flags A and B of reads(seq, A, B) name.

    One aggregate by k-mer, no join: no set is ever held by one process.
    """
    rows = reads.where(F.length("seq") >= k).select("A", "B", F.explode(kmers_of(F.col("seq"), k)).alias("fwd"))
    sets = rows.groupBy(canonical(F.col("fwd")).alias("kmer")).agg(F.bool_or("A").alias("a"), F.bool_or("B").alias("b"))
    parts = {"both": F.col("a") & F.col("b"), "a_only": F.col("a") & ~F.col("b"), "b_only": ~F.col("a") & F.col("b"), "any": F.lit(True)}
    sums = sets.agg(*[F.count_if(c).alias(name) for name, c in parts.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("part"), F.col(name).alias("kmers")) for name in parts])))


def quality_spectrum(reads: DataFrame, k: int) -> DataFrame:
    """(min_qual, kmers): k-mers of the reads by the least quality among their letters.

    Letters beyond the end of a quality list have quality 0.
    """
    ok = reads.where(F.length("seq") >= k)
    places = F.sequence(F.lit(1), F.length("seq") - (k - 1))
    least = F.transform(places, lambda i: F.when(F.size("qual") >= i + (k - 1), F.array_min(F.slice(F.col("qual"), i, F.lit(k)))).otherwise(0))
    return ok.select(F.explode(least).alias("min_qual")).groupBy("min_qual").agg(F.count(F.lit(1)).alias("kmers"))


def shaped_kmers(reads: DataFrame, shape: str) -> DataFrame:
    """(read_id, pos, kmer): letters under the ones of a shape such as 110101."""
    width = len(shape)
    rows = read_kmers(reads, width)
    parts = [F.substring("fwd", i + 1, 1) for i, c in enumerate(shape) if c == "1"]
    return rows.select("read_id", "pos", F.concat(*parts).alias("kmer"))


def genome_size(hist: DataFrame) -> DataFrame:
    """(peak, total, size): spectrum peak beyond the first valley, k-mers from there, and their ratio.

    ``hist`` must have no cap: n of a shared bin is no count. It has one row per distinct n, fewer than
    the square root of twice the k-mers read, so it is ordered in one task.
    """
    from pyspark.sql import Window

    w = Window.orderBy("n")
    rows = hist.withColumn("nxt", F.lead("kmers").over(w))
    valley = rows.where(F.col("nxt") >= F.col("kmers")).agg(F.coalesce(F.min("n"), F.lit(1)).alias("valley"))
    beyond = rows.join(F.broadcast(valley), F.col("n") >= F.col("valley"))
    return beyond.agg(F.max_by("n", F.struct("kmers", -F.col("n"))).alias("peak"), F.sum(F.col("n") * F.col("kmers")).alias("total")).select(
        "peak", "total", F.floor(F.col("total") / F.col("peak")).alias("size")
    )
