import random

import numpy as np
import pytest

from strandflow.llm import stuffing

GOODS = ["read trimming", "gel loading dye", "flow cell", "cheap sequencing", "long reads", "library prep kit"]
FILL = ["the", "with", "for", "and", "best", "buy", "now", "top", "of", "online"]


def strung(rng, n):
    return " ".join(x for _ in range(n) for x in (rng.choice(FILL), rng.choice(GOODS)))


def page(kind, rng):
    url = lambda: f"https://{rng.choice('abcdef')}{rng.randint(1, 999)}.example/x?id={rng.randint(1, 99)}"
    if kind == "repeated":
        return rng.choice(["; ", ", ", "\n", " • "]).join(rng.choice(GOODS[:2]) for _ in range(60))
    if kind == "strung":
        return strung(rng, 80)
    if kind == "strung sentences":
        return " ".join(strung(rng, 6).capitalize() + "." for _ in range(15))
    if kind == "links":
        return "\n".join(f"* [{rng.choice(GOODS)}]({url()})" for _ in range(40))
    if kind == "html links":
        return "\n".join(f'<li><a href="{url()}">{rng.choice(GOODS)}</a></li>' for _ in range(40))
    if kind == "menu":
        return " » ".join(f"{rng.choice(GOODS).title()} ({rng.randint(1, 900)})" for _ in range(50))
    if kind == "tags":
        return " ".join("#" + rng.choice(GOODS).replace(" ", "") + str(i % 3) for i in range(60))
    if kind == "products":
        return "\n".join(f"SKU-{rng.randint(1, 9999)} {rng.choice(GOODS)} ★★★☆☆ ({rng.randint(1, 99)}) {rng.randint(1, 99)},50 €" for _ in range(40))
    if kind == "sentences":
        return " ".join(f"The {rng.choice(['old', 'new', 'last'])} {rng.choice(['filter', 'graph', 'counter'])} keeps the {rng.choice(['first', 'weak', 'long'])} {rng.choice(['branch', 'edge', 'read'])} because it was {rng.choice(['seen', 'lost', 'kept'])} before." for _ in range(30))
    if kind == "one sentence":
        return "The counter keeps every read that was seen before the graph is built. " * 30
    if kind == "log":
        return "\n".join(f"08:04:{i % 60:02} WARN  lane {i % 7}: coverage below cutoff" for i in range(60))
    if kind == "table":
        return "sample,n50,edges\n" + "\n".join(f"A{i},{i * 37},{i * 91}" for i in range(60))
    if kind == "sequence":
        return "\n".join(["The reads follow."] + ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(30)])
    if kind == "commands":
        return "\n".join(f"$ tool -k {i} --out file{i} input{i}.fq" for i in range(40))
    if kind == "reading list":
        return "\n".join(f"* book ({url()}): The author shows how the graph is built and why it was kept in the end, with a note on the method." for _ in range(20))
    raise ValueError(kind)


SPAM = ["repeated", "strung", "strung sentences", "links", "html links", "menu", "tags", "products"]
PLAIN = ["sentences", "one sentence", "log", "table", "sequence", "commands", "reading list"]


@pytest.mark.parametrize("kind", SPAM + PLAIN)
def test_kinds(kind):
    rng = random.Random(kind)
    shares = stuffing.stuffed_shares([page(kind, rng) for _ in range(10)], stuffing.Reader())
    assert all((s > 0.5) == (kind in SPAM) for s in shares), shares


def test_share_follows_the_mixture():
    rng = random.Random(1)
    spam, plain = page("links", rng), page("sentences", rng)
    n = min(len(spam), len(plain))
    spam, plain = spam[:n], plain[:n]
    more_spam, more_plain = stuffing.stuffed_shares([spam + "\n" + plain[: n // 2], plain + "\n" + spam[: n // 2]], stuffing.Reader())
    assert 0.6 < more_spam < 0.78 and 0.25 < more_plain < 0.42


def test_blocks_do_not_change_the_result(monkeypatch):
    rng = random.Random(2)
    texts = [page(k, rng) for k in SPAM + PLAIN] + [None, "", " ", "ok"]
    whole = stuffing.stuffed_shares(texts, stuffing.Reader())
    monkeypatch.setattr(stuffing, "BLOCK_TERMS", 1)
    monkeypatch.setattr(stuffing, "KEPT_TERMS", 5)
    assert list(stuffing.stuffed_shares(texts, stuffing.Reader())) == list(whole)
    assert list(whole[-4:]) == [0, 0, 0, 0]


def test_pages(spark):
    rng = random.Random(3)
    data = [(1, page("links", rng), 0.1), (2, page("sentences", rng), 0.1), (3, None, 0.1), (4, "", 0.1), (5, "word " * 200_000, None), (1, page("tags", rng), 0.2)]
    df = spark.createDataFrame(data, "doc_id long, text string, stuffed_share double")
    assert sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect()) == [1, 1, 5]
    assert stuffing.stuffed_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


SHORT_SPAM = [
    "\n".join(f"https://a{i}.example/some/page?id={i}" for i in range(17)),
    "https://a.example/x //b.test/ www.c.test",
    "See the note:\n* [flow cell](https://a.example/kits/flow)\n* [loading dye](//b.example/kits/dye)",
    '<li><a href="https://a.example/x">kits</a></li><li><a href="https://a.example/y">reads</a></li>',
    "#assembly #reads #contigs",
    "Home » Shop » Library kits » Contact",
    "flow cell, cheap reads, loading dye, prep kit, long reads",
    "cheap reads cheap reads cheap reads cheap reads",
    "SKU-1 flow cell ★★★☆☆ (12) 19,50 €\nSKU-2 loading dye ★★☆☆☆ (3) 9,50 €",
]
SHORT_PLAIN = [
    "ok", "TODO", "404", "K=60?", "see above", "https://a.example/only", "[UNK] <s> </s>", "tab\t\ttab", "Siehe auch Quidi-kit.",
    "Unser Rechner verwirft überzählige Kopien.", "The second pass skips vertices of degree four during step 2.", "a_b__c snake_case CamelCase kMer2Go",
    "The list at https://a.example/x and the one at https://b.example/y were lost.", "sample | n50 | edges | cov\nA1 | 12 | 40 | 3.5", "k=60, n=5, freq=4, qual=7",
    "Reads, contigs, bubbles, lines. All were kept.", "08:04:11 WARN  lane 2\ncoverage below cutoff",
]


@pytest.mark.parametrize("text", SHORT_SPAM + SHORT_PLAIN)
def test_short_texts(text):
    reader = stuffing.Reader()
    assert 0 < len(reader.read(text)[0]) < stuffing.LEAST_TERMS
    assert (stuffing.stuffed_shares([text], reader)[0] > 0.5) == (text in SHORT_SPAM)


PROSE = {
    "ru": "Сегодня утром я вышел из дома и пошёл к реке, потому что погода была хорошая. На берегу сидели рыбаки, и один из них рассказал мне длинную историю о том, как он поймал большую щуку. Потом мы вместе пили чай и говорили о жизни. Вечером начался дождь, и все разошлись по домам.",
    "pl": "Dzisiaj rano wyszedłem z domu i poszedłem nad rzekę, ponieważ pogoda była ładna. Na brzegu siedzieli rybacy, a jeden z nich opowiedział mi długą historię o tym, jak złowił wielkiego szczupaka. Potem razem piliśmy herbatę i rozmawialiśmy o życiu. Wieczorem zaczął padać deszcz i wszyscy wrócili do domów.",
    "it": "Questa mattina sono uscito di casa e sono andato al fiume, perché il tempo era bello. Sulla riva sedevano dei pescatori, e uno di loro mi ha raccontato una lunga storia su come aveva preso un grosso luccio. Poi abbiamo bevuto insieme il tè e abbiamo parlato della vita.",
    "tr": "Bu sabah evden çıktım ve nehre gittim çünkü hava güzeldi. Kıyıda balıkçılar oturuyordu ve içlerinden biri bana büyük bir turna balığını nasıl yakaladığını anlattı. Sonra birlikte çay içtik ve hayat hakkında konuştuk. Akşam yağmur başladı ve herkes evine döndü.",
    "fi": "Tänä aamuna lähdin kotoa ja menin joelle, koska sää oli kaunis. Rannalla istui kalastajia, ja yksi heistä kertoi minulle pitkän tarinan siitä, miten hän oli saanut suuren hauen. Sitten joimme yhdessä teetä ja puhuimme elämästä. Illalla alkoi sataa ja kaikki lähtivät kotiin.",
    "ja": "今朝、私は家を出て川へ行きました。天気がよかったからです。岸には漁師が座っていて、その一人が長い話をしてくれました。それから一緒にお茶を飲み、人生について話しました。夕方には雨が降り始め、みんな家に帰りました。私は長い間眠れず、過ぎた一日のことを考えました。次の日、友人から手紙が届きました。彼は遠い町に住んでいて、新しい仕事を始めたそうです。手紙には写真が三枚入っていました。一枚目は海、二枚目は古い橋、三枚目は小さな犬でした。返事を書こうとしましたが、言葉が見つかりませんでした。",
}


@pytest.mark.parametrize("lang", PROSE)
def test_prose_of_unlisted_languages(lang):
    """Neither once nor over and over is it a list; lists in the same languages are."""
    shares = stuffing.stuffed_shares([PROSE[lang], (PROSE[lang] + " ") * 3, ", ".join(w.strip(",.") for w in PROSE[lang].split() if len(w) > 5) if lang != "ja" else "漁師、" * 40], stuffing.Reader())
    assert shares[0] < 0.3 and (shares[1] < 0.3 or lang == "ja") and shares[2] > 0.5


def test_keywords_in_the_form_of_tables_and_commands():
    rows = "\n".join(f"cheap kit, {i}, {i * 3}" for i in range(60))
    table = "\n".join(f"total reads {i}, {i}, {i * 3}" for i in range(60))
    shares = stuffing.stuffed_shares([rows, "$ cheap sequencing kit buy now\n" * 60, table, "name, n50, edges\n" + "\n".join(f"total {x}, 4, 5" for x in "abcdefgh" * 8)], stuffing.Reader())
    assert list(shares > 0.5) == [True, True, False, True]


def test_a_large_stock_of_keywords_recurs_regularly():
    rng = random.Random(7)
    stock = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pa", "ri", "so", "tu") for b in ("dex", "fan", "gol", "him", "jor", "kul")]
    strung = []
    for _ in range(20):
        rng.shuffle(stock)
        strung += [w + " for the" if i % 6 == 0 else w for i, w in enumerate(stock)]
    assert stuffing.stuffed_shares([" ".join(strung)], stuffing.Reader())[0] > 0.5
    rounds = np.concatenate([np.random.default_rng(i).permutation(54) for i in range(40)])
    chance = np.random.default_rng(1).integers(0, 54, len(rounds))
    alike = lambda codes: stuffing._alike(*stuffing._gaps(codes)).mean()
    assert alike(np.arange(3000) % 54) > 0.9 > alike(rounds) > 0.5 > 0.4 > alike(chance)
