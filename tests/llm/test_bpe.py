import random

import pytest

from strandflow.llm import bpe
from strandflow.llm.queries import PATTERN, TOKENIZERS

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


CASES = ["", " ", "\n\n \t", "<|endoftext|>", "a" * 3000, "ab" * 2000, "don't they'll", "Ünïcödé 中文字 😀😀", "x​y z", "0123456789" * 50, "=-" * 300, " lead", "trail ", "\r\n\r\n", "ACGT" * 500, "\x00\x01"]


def test_against_the_public_library(public):
    enc = bpe.Encoder(PATH, PATTERN)
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choice("aabcdeth ing\n1.é中=-_'s") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        assert enc.encode(t) == public(t), t[:60]


def test_compatible_is_what_two_tokens_do(public):
    enc = bpe.Encoder(PATH, PATTERN)
    rng = random.Random(2)
    names = [t for t in enc._ids if t.isascii() and t.isalpha()]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        assert enc.compatible(enc._ids[a], enc._ids[b]) == (public(a + b) == [enc._ids[a], enc._ids[b]]), (a, b)


def test_bounded_stores(public, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    enc = bpe.Encoder(PATH, PATTERN)
    text = "many different words, unseparatedwords and antidisestablishmentarianism zzxxqq"
    assert enc.encode(text) == public(text) and len(enc._known) <= 3 and len(enc._pairs) <= 3


@pytest.mark.parametrize("room", [1 << 22, 1, 40])
def test_corpus(spark, public, monkeypatch, room):
    monkeypatch.setattr(bpe, "BATCH_IDS", room)
    data = [(i, t, 1) for i, t in enumerate(CASES)] + [(90, None, 1), (91, CASES[4], 2), (91, CASES[4], 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df, PATH, PATTERN).collect())
    assert got == sorted((i, public(t) if t else []) for i, t, _ in data)
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
