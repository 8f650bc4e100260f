import random

import pytest

from strandflow.operators.intervals import active_counts, covered, covered_length, gaps
from strandflow.operators.joins import latest_before, stab_join


def brute(data):
    out_gaps, out_cover, depth = [], [], []
    for key in {k for k, a, b in data if k is not None}:
        runs = []
        good = sorted((a, b) for k, a, b in data if k == key and a is not None and b is not None and b > a)
        for a, b in good:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        out_cover += [(key, a, b) for a, b in runs]
        out_gaps += [(key, x[1], y[0]) for x, y in zip(runs, runs[1:])]
        if good:
            depth.append((key, sum(b - a for a, b in runs), sum(b - a for a, b in good)))
    return sorted(out_gaps), sorted(out_cover), sorted(depth)


@pytest.mark.parametrize("bits", [2, 5, 14])
def test_against_brute_force(spark, rows, bits):
    rng = random.Random(bits)
    data = []
    for _ in range(400):
        a = rng.choice([rng.randint(-300, 5000), rng.randint(0, 60) * 64])
        data.append((rng.choice([1, 1, 1, 2, 3]), a, a + rng.choice([0, 1, 3, 40, 64, 200, -5])))
    data += [(None, 1, 2), (1, None, 2), (2, 1, None), (4, 7, 7), (5, 3, 9), *data[:20]]
    df = spark.createDataFrame(data, "key long, a long, b long")
    g, c, d = brute(data)
    assert sorted(map(tuple, gaps(df, "key", "a", "b", bits).collect())) == g
    assert sorted(map(tuple, covered(df, "key", "a", "b", bits).collect())) == c
    assert sorted(map(tuple, covered_length(df, "key", "a", "b", bits).collect())) == d


def test_known_case(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (1, 12, 13)], "key long, a long, b long")
    assert [tuple(r) for r in gaps(df, "key", "a", "b").collect()] == [(1, 8, 10)]
    assert sorted(map(tuple, covered(df, "key", "a", "b").collect())) == [(1, 0, 8), (1, 10, 13)]
    last = [r.active for r in active_counts(df, "key", "a", "b").where("next_pos is null").collect()]
    assert last == [0]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "key long, a long, b long, pos int, at int, total int")
    assert gaps(df, "key", "a", "b").count() == 0 and covered(df, "key", "a", "b").count() == 0


def test_stab_join(spark):
    rng = random.Random(1)
    pts = [(rng.randint(1, 3), rng.randint(-50, 20_000)) for _ in range(200)] + [(None, 1), (1, None)]
    ivs = [(rng.randint(1, 3), a := rng.randint(-50, 20_000), a + rng.randint(-5, 9000)) for _ in range(60)] + [(None, 0, 9)]
    got = stab_join(spark.createDataFrame(pts, "k long, p long"), spark.createDataFrame(ivs, "k long, a long, b long"), "k", "p", "a", "b", 1000)
    want = sorted((k, p, a, b) for k, p in pts for j, a, b in ivs if k == j and k is not None and p is not None and a <= p < b)
    assert sorted(map(tuple, got.select("k", "p", "a", "b").collect())) == want


def test_latest_before(spark):
    from datetime import datetime, timedelta

    rng = random.Random(2)
    t0 = datetime(2024, 1, 1)
    left = [(i, rng.choice(["a", "b", "c"]), t0 + timedelta(hours=rng.randint(0, 400))) for i in range(80)] + [(99, None, t0), (98, "a", None)]
    right = [(rng.choice(["a", "b"]), t0 + timedelta(hours=rng.randint(0, 400)), i) for i in range(40)] + [("a", None, 1), (None, t0, 2)]
    out = latest_before(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v int"), "k", "t", "v")
    want = {}
    for i, k, t in left:
        best = max(((s, v) for j, s, v in right if j == k and k is not None and s is not None and t is not None and s <= t), default=(None, None))
        want[i] = best[1]
    assert {r.id: r.latest_v for r in out.collect()} == want


def test_stab_join_of_very_long_intervals(spark):
    ivs = [(1, 0, 10**13), (1, 10**12, 10**12 + 5), (1, 7, 8), (2, 5, 5), (2, 0, 10**17)]
    pts = [(1, 7), (1, 10**12 + 4), (1, 10**13), (2, 5), (None, 7), (1, None)]
    got = stab_join(spark.createDataFrame(pts, "k long, p long"), spark.createDataFrame(ivs, "k long, a long, b long"), "k", "p", "a", "b", 1000)
    want = sorted((k, p, a, b) for k, p in pts for j, a, b in ivs if k == j and p is not None and a <= p < b)
    assert sorted((r.k, r.p, r.a, r.b) for r in got.collect()) == want
