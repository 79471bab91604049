"""Near copies by Jaccard similarity, against all pairs, and the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from tests.llm import plain
from weftgraph.llm import nearcopies, simhash
from weftgraph.plans.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, n_chars int"


def shingled(text):
    w = plain.words(plain.lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def kept_of(rows):
    """The rows that stay, by a comparison of all pairs."""
    sets, group = [shingled(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)]]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 150))) for _ in range(40)]
    texts += [edited(rng, rng.choice(texts).split(), rng.randrange(1, 6)) for _ in range(120)]
    hot = [f"h{rng.randrange(400)}" for _ in range(120)]
    texts += [edited(rng, hot, rng.randrange(0, 7)) for _ in range(90)]
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} {' '.join(f'w{rng.randrange(400)}' for _ in range(rng.randrange(5, 60)))}" for _ in range(50)]
    texts += [None, "", " \n", "One two", "ONE  two", "one two three", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = [(i, t, "x", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, texts[5], "x", 1), (7, texts[9], "x", 1), (7, texts[7], "x", 1)]


@pytest.mark.parametrize(("seed", "block", "frequent", "turns"), [(1, 2048, 4, (8, 1)), (2, 7, 4, (1,)), (3, 5, 10**6, ())])
def test_keeps_what_all_pairs_keep(spark, monkeypatch, seed, block, frequent, turns):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "TURNS", turns)
    monkeypatch.setattr(nearcopies, "FREQUENT_DOCS", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = nearcopies.keep_first(df, Scratch(spark, "t"))
    assert kept.columns == df.columns
    want = kept_of(rows)
    assert len(want) < len(rows) - 60
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(map(str, want))
    if not turns:
        assert nearcopies.keep_first(df.limit(0), Scratch(spark, "t")).collect() == []


def test_null_id_links_two_documents(spark):
    words = [f"w{i}" for i in range(100)]
    a, b, c = (" ".join(words[i : i + 80]) for i in (0, 7, 14))
    rows = [(1, a, "x", 1), (None, b, "x", 1), (2, c, "x", 1)]
    kept = nearcopies.keep_first(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert {r.doc_id for r in kept} == {1, None}


def test_stage_takes_pairs_that_differ_in_more_than_three_bits(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(300)]
    other = [*words[:100], "else", *words[101:200], "where", *words[201:]]
    a, b, c = " ".join(words), " ".join(other), " ".join(words[:240])
    assert (plain.fingerprint(a) ^ plain.fingerprint(b)).bit_count() > 3
    assert simhash.simhash(a.encode()) == plain.fingerprint(a)
    rows = [(1, a, "x", 1), (2, b, "x", 1), (3, c + " end of it " + " ".join(map(str, range(40))), "x", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r.doc_id for r in kept] == [1, 3]
