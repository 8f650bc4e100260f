import random
import re

import pytest

from strandflow.llm import leaks, queries

VOCABULARY = [f"w{i}" for i in range(60)] + ["Ünder", "ΣΑΣ", "字", "x9"]


def cut(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = cut(t)
        seen = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for j, u in items:
            v = cut(u)
            if d is not None and j is not None and any(tuple(v[i : i + n]) in seen for i in range(len(v) - n + 1)):
                out.add((d, j))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda k: [rng.choice(VOCABULARY) for _ in range(k)]
    items = [(j, say(rng.randint(5, 40))) for j in range(12)]
    items += [(50, items[0][1][:20]), (51, items[1][1]), (52, say(11)), (53, say(12))]
    docs = []
    for i in range(60):
        w = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            _, v = rng.choice(items)
            a = rng.randint(0, len(v) - 1)
            piece = v[a : a + rng.choice([8, 11, 12, 13, 30])]
            if rng.random() < 0.3 and piece:
                piece = [*piece]
                piece[rng.randrange(len(piece))] = "changed"
            w += piece + say(rng.randint(0, 5))
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, " \n "), (None, docs[3][1]), docs[5], (103, ("-".join(items[0][1]) + " ") * 30)]
    return docs, [(j, " ".join(v)) for j, v in items] + [(60, None), (61, ""), (None, "a b c"), (50, " ".join(items[0][1][:20]))]


@pytest.mark.parametrize("seed,block", [(1, 2_000_000), (2, 90)])
def test_exact_leaks(spark, seed, block):
    docs, items = corpus(seed)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, leaks.leaked(d, i, 12, block_words=block).collect())) == brute(docs, items)


def test_substitutions_are_tolerated(spark):
    item = [f"t{i}" for i in range(30)]
    changed = [*item]
    changed[10] = changed[20] = "other"
    docs = [(1, "pre fix " + " ".join(changed) + " end"), (2, " ".join(item[:9])), (3, " ".join(item))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    masks = tuple(m[:9] for m in leaks.MASKS)
    got = {r.doc_id: (r.run, r.overlap, r.changed) for r in leaks.overlaps(d, i, masks=masks).collect()}
    assert got == {1: (10, 30, 2), 2: (9, 9, 0), 3: (30, 30, 0)}


def test_stretches_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    rows = [[rng.random() < 0.7 for _ in range(rng.randint(1, 25))] for _ in range(500)]
    found = leaks._stretches(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]), 2)
    for same, run, best, changed in zip(rows, *(x.tolist() for x in found)):
        spans_ = [(b - a, same[a:b].count(False)) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1]]
        assert run == max([n for n, c in spans_ if c == 0], default=0)
        assert best == max([n for n, c in spans_ if c <= 2], default=0)
        if best:
            assert changed == min(c for n, c in spans_ if n == best)


def test_one_word_over_and_over(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ROOM", 1000)
    d = spark.createDataFrame([(1, "a " * 3000), (2, "b " * 3000)], "doc_id long, text string")
    i = spark.createDataFrame([(j, "a " * (12 + j)) for j in range(20)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.run, r.overlap, r.changed) for r in leaks.overlaps(d, i).collect()}
    assert got == {(1, j): (12 + j, 12 + j, 0) for j in range(20)}


def test_empty_tables_and_long_masks(spark):
    d, i = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, item_id int"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked(d, i).count() == 0 and leaks.leaked(d.where("false"), i).count() == 0
    with pytest.raises(ValueError):
        leaks.leaked(d, i, 8)


def best_overlap(w, v, most_changed=2):
    """Longest aligned stretch, equal at both ends, with few changed words; over all alignments."""
    best = 0
    for shift in range(-len(v) + 1, len(w)):
        same = [w[j + shift] == v[j] for j in range(len(v)) if 0 <= j + shift < len(w)]
        for a in range(len(same)):
            changed = 0
            for b in range(a, len(same) if same[a] else a):
                changed += not same[b]
                if changed > most_changed:
                    break
                if same[b]:
                    best = max(best, b + 1 - a)
    return best


def test_every_two_changed_words_are_tolerated(spark, tmp_path):
    item = [f"t{i}" for i in range(30)]
    docs, expected = [], {}
    for n in range(8, 15):
        for a in range(1, n - 1):
            for b in range(a + 1, n - 1):
                words = item[5 : 5 + n]
                words[a], words[b] = "other", "another"
                expected[len(docs)] = (n, 2)
                docs.append((len(docs), "pre " + " ".join(words) + " end"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {r.doc_id: (r.overlap, r.changed) for r in queries.p7_overlaps(spark, str(tmp_path)).collect()} == expected


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    items = [(j, [f"w{rng.randrange(25)}" for _ in range(rng.randint(6, 25))]) for j in range(10)]
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(25)}" for _ in range(4)]
        for _ in range(2):
            v = [*rng.choice(items)[1]]
            for _ in range(rng.randint(0, 5)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(25)}"
            w += v
        docs.append((i, w))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    e = spark.createDataFrame([(j, " ".join(v)) for j, v in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in leaks.overlaps(d, e, masks=leaks.PAIR_MASKS).where("overlap >= 8").collect()}
    assert got == {(i, j): n for i, w in docs for j, v in items if (n := best_overlap(w, v)) >= 8}
