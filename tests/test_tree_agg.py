from collections import defaultdict

from pyspark.sql import functions as F

from strandflow.operators.tree_agg import expected_chunks, key_figures, tree_aggregate


def test_against_a_plain_count(spark, rows):
    data = [("hot" if i % 3 else f"k{i % 50}", i % 7, i) for i in range(3000)] + [(None, 1, 1), (None, None, 2), ("nul", None, None)]
    df = spark.createDataFrame(data, "k string, m int, v long").repartition(13)
    n, members, total = defaultdict(int), defaultdict(set), defaultdict(int)
    for k, m, v in data:
        n[k] += 1
        if m is not None:
            members[k].add(m)
        total[k] += v or 0
    got = {r.k: (r.n_rows, r.n_members, r.total) for r in key_figures(df, "k", "m", {"total": F.col("v")}).collect()}
    assert got == {k: (n[k], len(members[k]), total[k] if k != "nul" else None) for k in n}


def test_rounds_and_fan_in(spark):
    df = spark.range(1000).withColumn("k", F.lit("one")).repartition(40)
    for chunks, fan in ((2, 2), (40, 4), (300, 16)):
        out = tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}, chunks, fan)
        assert [tuple(r) for r in out.collect()] == [("one", 1000, 0, 999)]


def test_no_reducer_takes_all_partials(spark):
    df = spark.range(1000).withColumn("k", F.lit("one"))
    plan = tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1))}, 256)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") >= 2


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, n_rows int, chunk int, m0 int")
    assert key_figures(df, "k").count() == 0
    one = spark.createDataFrame([("a", 5, 6, 7)], "k string, n_rows int, chunk int, m0 int")
    assert [tuple(r) for r in key_figures(one, "k", "m0").collect()] == [("a", 1, 1)]


def test_chunks_are_those_of_the_input(spark, tmp_path):
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1000).repartition(37).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert expected_chunks(read.where("id > 3").select((F.col("id") % 2).alias("k"))) >= 37
    assert expected_chunks(read.union(read)) >= 74 and expected_chunks(read.repartition(333)) == 333
    assert expected_chunks(read.distinct()) == shuffled
    plan = tree_aggregate(read.repartition(5000), ["id"], {"n": ("sum", F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") >= 4  # 5000 chunks, at most 16 at a time
