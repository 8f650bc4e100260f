import random

import pytest

from strandflow.llm import spans


def brute(records, least):
    texts = {(i, t) for i, t in records if i is not None and t is not None}
    where = {}
    for i, t in texts:
        for p in range(len(t) - least + 1):
            where.setdefault(t[p : p + least], set()).add(i)
    out = []
    for i in {i for i, _ in texts}:
        own = [t for j, t in texts if j == i]
        covered = [False] * max(map(len, own))
        for t in own:
            for p in range(len(t) - least + 1):
                if len(where[t[p : p + least]]) > 1:
                    covered[p : p + least] = [True] * least
        start = None
        for p, c in enumerate([*covered, False]):
            if c and start is None:
                start = p
            if not c and start is not None:
                out.append((i, start, p))
                start = None
    return sorted(out)


def records(seed, alphabet="ACGTN"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 90))) for _ in range(6)]
    out = []
    for i in range(40):
        out.append((i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(1, 5)))))
    return out + [out[3], out[4], (100, None), (101, ""), (102, pool[0] * 2), (None, pool[1])]


@pytest.fixture(params=["all rows in large batches", "few rows and names at a time"])
def room(request, spark, monkeypatch):
    """The same with next to no room, so that names are forgotten and texts are cut."""
    if request.param.startswith("few"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        monkeypatch.setattr(spans, "BLOCK", 64)
        monkeypatch.setattr(spans, "KEPT_NAMES", 20)
        yield
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    else:
        yield


@pytest.mark.parametrize("least,alphabet", [(50, "ACGTN"), (7, "AC"), (1, "äb😀 "), (33, "xyz")])
def test_against_brute_force(spark, room, least, alphabet):
    data = records(least, alphabet)
    df = spark.createDataFrame(data, "read_id long, seq string")
    got = sorted(map(tuple, spans.shared_spans(df, "read_id", "seq", least).collect()))
    assert got == brute(data, least)


def test_long_text(spark, room):
    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    data = [(1, a), (2, "GG" + a[40:1700] + "T"), (3, a[2900:])]
    got = sorted(map(tuple, spans.shared_spans(spark.createDataFrame(data, "read_id long, seq string"), "read_id", "seq", 50).collect()))
    assert got == brute(data, 50)


def test_several_texts_of_one_id(spark, room):
    a, b = "A" * 30 + "C" * 40, "G" * 80
    data = [(1, a), (1, b), (2, a), (3, "T" * 10 + b + "T"), (3, a[10:]), (1, a)]
    got = sorted(map(tuple, spans.shared_spans(spark.createDataFrame(data, "read_id long, seq string"), "read_id", "seq", 50).collect()))
    assert got == brute(data, 50) == [(1, 0, 80), (2, 0, 70), (3, 0, 90)]
    twice = [(1, a), (1, b), (2, a)]
    got = sorted(map(tuple, spans.shared_spans(spark.createDataFrame(twice, "read_id long, seq string"), "read_id", "seq", 50).collect()))
    assert got == [(1, 0, 70), (2, 0, 70)]


def test_windows_of_two_texts_are_not_joined(spark):
    rng = random.Random(9)
    x, y = ("".join(rng.choice("ACGT") for _ in range(50)) for _ in "xy")
    # id 1 has x at 0 in one text and y at 50 in another, id 2 has both in a row
    data = [(1, x + "A" * 50), (1, "C" * 50 + y), (2, x + y)]
    got = {r.read_id: r.longest for r in spans.shared_share(spark.createDataFrame(data, "read_id long, seq string"), "read_id", "seq", 50).collect()}
    assert got == {1: 50, 2: 50}


def test_a_name_in_a_third_of_all_rows(spark, room):
    rng = random.Random(4)
    hot = "".join(rng.choice("ACGT") for _ in range(60))
    data = [(i, (hot if i % 3 == 0 else "".join(rng.choice("ACGT") for _ in range(60)))) for i in range(300)]
    df = spark.createDataFrame(data, "read_id long, seq string").repartition(2)
    rows = spans.chosen_windows(spans.whole_records(df, "read_id", "seq"), 50)
    crowd = rows.where("salt = 0").groupBy("h1").count().agg({"count": "max"}).first()[0]
    assert crowd < 100 // 3  # of the hundred records with it
    assert sorted(map(tuple, spans.shared_spans(df, "read_id", "seq", 50).collect())) == brute(data, 50)


def test_text_ids(spark):
    data = [("a", "A" * 60), ("b", "C" + "A" * 55), ("a", "A" * 60)]
    assert sorted(map(tuple, spans.shared_spans(spark.createDataFrame(data, "k string, t string"), "k", "t", 50).collect())) == [("a", 0, 60), ("b", 1, 56)]


def test_share_and_levels(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("ACGT") for _ in range(500))
    data = [(1, a), (2, "T" + a[:250]), (3, a[300:360]), (4, "ACGT"), (5, "")]
    got = {r.read_id: (r.n_letters, r.n_shared, r.longest) for r in spans.shared_share(spark.createDataFrame(data, "read_id long, seq string"), "read_id", "seq", 50).collect()}
    want = {i: sum(q - p for j, p, q in brute(data, 50) if j == i) for i, _ in data}
    assert {i: v[1] for i, v in got.items()} == want
    assert got[1] == (500, 310, 200) and got[3][2] == 50 and got[4] == (4, 0, 0) and got[5] == (0, 0, 0)


def test_empty_and_extra_columns(spark):
    assert spans.shared_spans(spark.createDataFrame([], "read_id long, seq string"), "read_id", "seq").count() == 0
    df = spark.createDataFrame([(1, "A" * 60, 7, "x"), (2, "A" * 60, 8, "y")], "read_id long, seq string, pos int, name string")
    assert sorted(map(tuple, spans.shared_spans(df, "read_id", "seq", 50).collect())) == [(1, 0, 60), (2, 0, 60)]
    one = spark.createDataFrame([(1, "A" * 200)], "read_id long, seq string")
    assert spans.shared_share(one, "read_id", "seq").first().n_shared == 0
