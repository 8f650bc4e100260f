import random
from collections import Counter

from pyspark.sql import functions as F

from strandflow.llm import frequency


def brute(data, lengths):
    total, records = Counter(), {}
    for rec, tokens in data:
        tokens = [t for t in tokens or [] if t is not None]
        for m in lengths:
            for i in range(len(tokens) - m + 1):
                g = tuple(tokens[i : i + m])
                total[m, g] += 1
                if rec is not None:
                    records.setdefault((m, g), set()).add(rec)
    return {k: (n, len(records.get(k, ()))) for k, n in total.items()}


def test_ngrams_against_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.randint(1, 12), [rng.choice("aaaabcd") for _ in range(rng.randint(0, 30))]) for _ in range(80)]
    data += [(1, None), (2, []), (None, ["a", "b"]), (3, [None, "a", None]), data[0], (9, ["ä", "", " "])]
    df = spark.createDataFrame(data, "rec long, w array<string>")
    out = frequency.term_counts(frequency.token_suffixes(df, "w", "rec", 3), [1, 2, 3])
    got = {(r.m, tuple(x for x in (r.t1, r.t2, r.t3) if x is not None)): (r.total, r.records) for r in out.collect()}
    assert got == brute(data, [1, 2, 3])


def test_hot_term_over_many_blocks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        data = [("hot" if i % 3 else f"t{i % 40}", i % 25, 1 + i % 4, i) for i in range(4000)] + [("hot", None, 5, -1), (None, 1, 1, -2)]
        df = spark.createDataFrame(data, "term string, rec long, n int, row int")
        out = frequency.term_counts(frequency.term_suffixes(df, [F.col("term")], F.col("rec"), F.col("n"), F.col("row")), [1])
        got = {r.t1: (r.total, r.records) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t in {x[0] for x in data if x[0] is not None}:
        own = [x for x in data if x[0] == t]
        want[t] = (sum(x[2] for x in own), len({x[1] for x in own if x[1] is not None}))
    assert got == want


def test_marks_and_empty(spark):
    df = spark.createDataFrame([], "rec long, w array<string>")
    out = frequency.mark(frequency.term_counts(frequency.token_suffixes(df, "w", "rec", 2), [1, 2]), 2, 1)
    assert out.count() == 0 and out.columns[-2:] == ["too_rare", "too_common"]
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (2, ["b"])], "rec long, w array<string>")
    out = frequency.mark(frequency.term_counts(frequency.token_suffixes(df, "w", "rec", 1), [1]), 2, 1)
    assert {r.t1: (r.too_rare, r.too_common) for r in out.collect()} == {"a": (False, True), "b": (True, False)}
