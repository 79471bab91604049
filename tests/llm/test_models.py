"""Language ID, toxicity, rules and quality: invariants, plain versions, held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import plain
from weftgraph.llm import langid, quality, rules, toxicity
from weftgraph.plans.scratch import Scratch

SYLLABLES = {"xx": "ka ti mo ru ne", "yy": "sch ung ein lich ver", "zz": "eau tion ç oi é"}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, speak(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randrange(8, 60)), lang, 0.5) for i in range(240)]
    rows += [(900, None, "xx", 0.1), (901, "", None, 0.1), (902, "12 34 !", "xx", 0.1), (903, "ka " * 20_000, None, 0.1), (None, speak(rng, "yy", 20), "yy", 0.1), (3, rows[3][1], rows[3][2], None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3).persist()


def bits(text, samples, order):
    """Plain prediction by partial matching over bytes; symbol -1 stands before a text."""
    counts = Counter()
    for s in samples:
        b = [-1] * order + list(s)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[tuple(b[i - k : i]), b[i]] += 1
    known = {b for s in samples for b in s}
    total, distinct = Counter(), Counter()
    for (context, _), n in counts.items():
        total[context] += n
        distinct[context] += 1
    cost, b = 0.0, [-1] * order + list(text)
    for i in range(order, len(b)):
        for k in range(order, -2, -1):
            if k < 0:
                cost += 8
                break
            context = tuple(b[i - k : i])
            if n := counts[context, b[i]]:
                cost -= math.log2(n / (total[context] + distinct[context]))
                break
            if distinct[context]:
                cost -= math.log2(distinct[context] / (total[context] + distinct[context]))
    assert known
    return cost


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(order):
    samples = {"a": [b"banana band", b"ban"], "b": [b"cabbage", b"bab\nb"]}
    trees = langid.Trees(samples, order=order)
    assert trees.order == order
    texts = [b"banana", b"cab ban", b"nab" * 9, b"", b"a"]
    found = trees.code_lengths(texts)
    for r, text in enumerate(texts):
        for g, lang in enumerate(trees.langs):
            assert found[r, g] == pytest.approx(bits(text, samples[lang], order), rel=1e-4, abs=1e-4)


def test_long_texts_in_chunks(monkeypatch):
    trees = langid.Trees({"a": [b"banana"], "b": [b"cabbage"]})
    texts = [b"ban" * 50, b"", b"cab" * 70, b"x"]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert np.allclose(trees.code_lengths(texts), whole)


def test_language(spark, spoken):
    rows, df = spoken
    found = langid.identify(df, langid.fit(df))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in found.collect()]
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows[:240]}
    assert sum(p != want[d] for d, h, p, _ in got if d in want and h) == 0
    assert all(h == plain.held_out(d) and 0 <= s <= 1 for d, h, _, s in got)
    assert {d: p for d, _, p, _ in got if d is not None and d >= 900} == {900: "und", 901: "und", 902: "und", 903: "xx"}
    kept = langid.keep_identified(df, langid.fit(df), lang_col="lang")
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).collect() == []
    assert {r.lang_pred for r in langid.identify(df, langid.Trees({})).collect()} == {"und"}


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        parts = [speak(rng, "xx", rng.randrange(3, 12)) for _ in range(rng.randrange(2, 9))]
        toxic = i % 4 == 0
        if toxic:
            parts[rng.randrange(len(parts))] += " vilest" + rng.choice(["", "er", "o", "imo"])
        good = i % 5 != 0
        if not good:
            parts = [" ".join(w + "###" for w in p.split()) for p in parts]
        rows.append((i, ". ".join(p.capitalize() for p in parts) + ".", "q"))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, "q"), (901, "", "q"), (902, "ka " * 30_000, "q"), (None, "vilest", "q"), (5, rows[5][1], "q")]
    labels += [(None, 1, 1), (7, None, None), (3, 1, 0)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).persist(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").persist()


def test_toxicity(spark, judged):
    rows, labels, df, marks = judged
    model = toxicity.fit(df, marks, Scratch(spark, "t"))
    found = toxicity.score(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    want = {i: t for i, _, t in labels if i is not None and t is not None}
    assert sum(r.predicted != want[r.doc_id] for r in found if r.doc_id in want and r.held_out) == 0
    for r in found:
        if r.doc_id is not None and r.doc_id < 400 and r.predicted:
            text = next(t for i, t, _ in rows if i == r.doc_id)
            assert [any(w.startswith(b"vilest") for w in s) for s in toxicity.sentences(text.encode())].index(True) in [s.sentence for s in r.offending]
    assert {r.predicted for r in found if r.doc_id in (900, 901, 902)} == {0}
    assert toxicity.score(df.limit(0), model).collect() == []
    blank = toxicity.fit(df, marks.limit(0), Scratch(spark, "t"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, blank).collect())


def test_noisy_or_is_that_of_the_sentences():
    score, parts = toxicity.Model({b"bad": 3.0, b"^wors": 2.0}, -1.0).scorer()(b"bad day. good day! WORSE")
    want = [1 / (1 + math.exp(-z)) for z in (2.0, -1.0, 1.0)]
    assert parts == pytest.approx(want)
    assert score == pytest.approx(1 - math.prod(1 - p for p in want))


def test_quality(spark, judged):
    rows, labels, df, marks = judged
    model = quality.fit(df, marks, Scratch(spark, "t"))
    found = quality.score(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    want = {i: q for i, q, _ in labels if i is not None and q is not None}
    assert sum(r.predicted != want[r.doc_id] for r in found if r.doc_id in want and r.held_out) <= 2
    assert quality.score(df.limit(0), model).collect() == []
    blank = quality.fit(df, marks.limit(0), Scratch(spark, "t"))
    assert {r.score for r in quality.score(df, blank).collect()} == {0.5}


def test_neighbours_are_those_of_all_cosines():
    rng = random.Random(5)
    texts = [speak(rng, g, 30).encode() for g in "xx yy zz".split() for _ in range(20)]
    labels = np.array([0] * 20 + [1] * 40)
    model = quality.Model(texts, labels, np.ones(60), dimensions=8)
    fresh = [speak(rng, "xx", 25).encode(), speak(rng, "zz", 25).encode(), b""]
    got = model.score(fresh)
    x = model._unit(model._unit(model.rows(fresh) * model.rarity) @ model.directions)
    for r in range(2):
        near = sorted(((float(x[r] @ v), y) for v, y in zip(model.vectors, labels)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(s, 0) ** quality.POWER, y) for s, y in near]
        assert got[r] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-4)
    assert got[0] < 0.2 and got[1] > 0.8 and got[2] == pytest.approx(model.base)


def counted(text):
    w = plain.words(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if plain.words(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeat)


def test_rules(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(speak(rng, "zz", rng.randrange(5, 20)).capitalize() + "." for _ in range(rng.randrange(6, 20)))) for i in range(120)]
    rows += [(200 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in speak(rng, "xx", 90).split())) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "a b c a b c\na b c a b c\n\n \n"), (303, "ka " * 20_000), (None, rows[0][1]), (4, rows[4][1])]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(3)
    found = rules.judge(df, Scratch(spark, "t")).collect()
    want = sorted(((str(i), *counted(t)) for i, t in rows))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.posterior <= 1
        if r.doc_id is not None and r.doc_id < 120 and not r.base_failed:
            assert r.kept
        if r.doc_id is not None and 200 <= r.doc_id < 212:
            assert not r.kept
    assert rules.judge(df.limit(0), Scratch(spark, "t")).collect() == []


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = np.array([[0.9, 0.7, 0.95, 0.8], [0.97, 0.95, 0.99, 0.9]])
    vote = np.where(rng.random((20_000, 4)) < right[good.astype(int)], np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    vote[rng.random((20_000, 4)) < 0.2] = 0
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    found = rules.Accuracies(patterns, counts.astype(float))
    assert found.prior == pytest.approx(0.8, abs=0.05)
    assert np.allclose(np.array(found.accuracy()).T, right, atol=0.08)
