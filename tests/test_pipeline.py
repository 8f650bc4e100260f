import random

import pytest

from strandflow.plans.pipeline import Pipeline, Settings

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(TURN)


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(11)
    return "".join(rng.choice("ACGT") for _ in range(600))


def reads(spark, genome, flip=False):
    data = []
    for i, a in enumerate(range(0, 400, 6)):
        one, two = genome[a : a + 100], rc(genome[a + 100 : a + 200])
        if flip:
            one, two = rc(one), rc(two)
        data += [(2 * i, one, [40] * 100, "s"), (2 * i + 1, two, [40] * 100, "s")]
    wrong = genome[200:260] + "A" + genome[261:300]
    data.append((10_000, wrong, [40] * 100, "s"))
    return spark.createDataFrame(data, "read_id long, seq string, qual array<int>, sample string")


def test_one_genome_gives_one_line_and_resumes(spark, genome, tmp_path):
    # lines count for the N50 from 1000 k-mers on; the genome of this test is shorter
    settings = Settings(k=24, min_freq=2, max_component_edge=100, min_component=50, min_line=50)
    run = Pipeline(spark, str(tmp_path / "a"), settings)
    run.run(reads(spark, genome), to_stage=3)
    assert {len(r.seq) for r in run.load("edges").collect()} and run.load("paths").count() > 100
    again = Pipeline(spark, str(tmp_path / "a"), settings)
    again.run(from_stage=4)
    assert [n for n, _ in again.times] == ["clean", "lines", "links", "final"]
    fasta = "".join(r.value for r in spark.read.text(str(tmp_path / "a/lines.fasta")).collect() if not r.value.startswith(">"))
    longest = max(run.load("edges").collect(), key=lambda r: r.n_kmers).seq
    assert longest in genome or rc(longest) in genome
    assert set(fasta) <= set("ACGT") and run.load("n50").first().n50 == len(longest)
    assert any(r.value.startswith("S\tedge") for r in spark.read.text(str(tmp_path / "a/graph.gfa")).collect())


def test_reversed_reads_give_the_same_edges(spark, genome, tmp_path):
    settings = Settings(k=24, min_freq=2)
    seqs = []
    for flip in (False, True):
        run = Pipeline(spark, str(tmp_path / str(flip)), settings)
        run.run(reads(spark, genome, flip), to_stage=2)
        seqs.append(sorted(r.seq for r in run.load("edges").collect()))
    assert seqs[0] == seqs[1]


def test_bad_stages(spark, tmp_path):
    run = Pipeline(spark, str(tmp_path))
    for bad in ({"from_stage": 0}, {"from_stage": 3, "to_stage": 2}, {"to_stage": 8}, {}):
        with pytest.raises(ValueError):
            run.run(**bad)


def test_larger_k_spans_a_repeat_and_weak_bubbles_are_popped(spark, tmp_path):
    rng = random.Random(12)
    text = [rng.choice("ACGT") for _ in range(600)]
    text[400:430] = text[150:180]  # longer than k, shorter than k2
    strong = "".join(text)
    data = []
    for i, a in enumerate(range(501)):
        piece = strong[a : a + 100]
        data.append((2 * i, piece if i % 2 else rc(piece), [40] * 100, "s"))
    other = strong[:280] + rc(strong[280]) + strong[281:]
    for i, a in enumerate((220, 225, 230)):
        data.append((10_000 + 2 * i, other[a : a + 100], [40] * 100, "s"))
    df = spark.createDataFrame(data, "read_id long, seq string, qual array<int>, sample string")
    run = Pipeline(spark, str(tmp_path / "r"), Settings(k=24, k2=40, min_freq=2, max_component_edge=100, min_component=50))
    run.run(df)
    assert run.load("edges").count() > 2 and {len(r.src) for r in run.load("edges_k2").collect()} == {39}
    assert run.load("clean_supported").count() > run.load("clean_popped").count()
    fasta = spark.read.text(str(tmp_path / "r/lines.fasta")).collect()
    longest = max(run.load("line_stats").collect(), key=lambda r: r.len).len + 39
    whole = "".join(r.value for r in fasta if not r.value.startswith(">"))
    assert longest > 550 and (strong[20:580] in whole or rc(strong[20:580]) in whole)
