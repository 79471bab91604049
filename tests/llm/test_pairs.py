"""Near duplicates, decontamination, line and substring dedup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from weftgraph.llm import decontaminate, linededup, simhash, substrings
from weftgraph.plans.scratch import Scratch

SCHEMA = "doc_id long, text string, fp string, window int"  # the last two clash with names inside


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "stone river cloud lamp green".split() for b in ["", "s", "Ä", "ed", "ing,"]]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    for i in range(0, n, 4):  # copies, near copies and shared passages
        w = texts[i].split()
        texts[(i * 7 + 3) % n] = texts[i]
        texts[(i * 5 + 2) % n] = " ".join([*w[: len(w) // 2], "other", *w[len(w) // 2 :]])
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    for i in range(1, n, 6):
        texts[i] = f"{texts[i]}\n{passage}\t{texts[i]}"
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(100, None, "x", 1), (101, "", None, 1), (102, " \n\t", "x", None), (103, "One", "x", 1), (103, "One", "x", 1), (None, texts[0], "x", 1), (104, "long " * 30_000, "x", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_classes(spark, docs, rows):
    found = simhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    prints = [(r[0], plain.fingerprint(r[1])) for r in rows]
    want = sorted((str(name), f"{fp:016x}", str(c)) for (name, fp), c in zip(prints, plain.classes(prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    assert simhash.near_duplicates(empty(spark), Scratch(spark, "t")).collect() == []


def test_simhash_keeps_one_of_each_class(spark, docs, rows):
    prints = [(r[0], plain.fingerprint(r[1])) for r in rows]
    want = sorted(str(r) for r, c in zip(rows, plain.classes(prints)) if r[0] is None or r[0] == c)
    kept = simhash.keep_first(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == want


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = base[rng.integers(0, 40, 300)]
    for _ in range(seed):  # balls of growing radius
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    keys = np.unique(np.concatenate((base, near, rng.integers(0, 1 << 20, 50).astype(np.uint64))))
    of = simhash.trie_self_join(keys, 0, 3)
    want = plain.classes(list(enumerate(int(k) for k in keys)))
    assert of.tolist() == want


def test_trie_join_splits_large_frontiers(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 700).astype(np.uint64))
    assert set(simhash.trie_self_join(keys, 0, 3)) == {0}


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from the bear"), (2, "Short item, here"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy dog and runs away from the bear"), (None, "seven small words that have no id"), (6, "Ünder the sea we go again and again and again and again"), (7, "...")]
TEXTS = ["see THE quick, brown fox; jumps over the lazy dog and runs home", "the quick brown fox jumps over the lazy", "a short item here and Short ITEM here", "seven small words that have no id at all", "ünder the sea we go again and again and again and again and again", "Ünder the sea we go again and again and again", None, "", "?!", "x " * 20_000 + "the quick brown fox jumps over the lazy dog and runs away from the bear"]


@pytest.mark.parametrize("block", [1 << 20, 90])
def test_contamination(spark, block):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1), (2, TEXTS[2], "y", 2)], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.digest(decontaminate.contamination(docs, items, block_bytes=block)).collect()
    want = []
    for name, text in [*enumerate(TEXTS), (None, TEXTS[0]), (2, TEXTS[2])]:
        n, hit, ids = plain.contamination(text, ITEMS)
        names = sorted(str(x) for x in ids - {None})
        want.append((str(name), n, hit, len(names), plain.sha(",".join(names)), hit > 0))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == sorted(want)
    kept = decontaminate.keep_clean(docs, items, block_bytes=block)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t in [*TEXTS, TEXTS[0], TEXTS[2]] if not plain.contamination(t, ITEMS)[1])


def test_contamination_of_random_texts(spark):
    rng = random.Random(2)
    vocabulary = "a b c d".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 25)))) for i in range(12)]
    texts = [(i, " ".join(rng.choices([*vocabulary, "zz"], k=200))) for i in range(12)] + [(50 + i, f"q {t} q {t[5:]}") for i, t in items]
    found = decontaminate.digest(decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in found.collect()}
    assert got == {i: (n, h, len(ids)) for i, t in texts for n, h, ids in [plain.contamination(t, items)]}


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.digest(decontaminate.contamination(docs, items)).orderBy("doc_id").collect()] == [(2, 0, False), (0, 0, False)]
    assert decontaminate.contamination(empty(spark), items).collect() == []


def test_line_dedup(spark):
    pages = [(i, f"Menu\r\nline {i}\n\n Menu\nRare" if i < 6 else f"line {i}", "h1") for i in range(10)] + [(20, "Menu\nonly", None), (21, None, "h1"), (22, "", "h1"), (23, "Menu", "h2"), (24, "Menu", "h2")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "doc_id long, text string, source string, pages int, keys string").withColumns({"__keys": F.lit(1), "__host": F.lit(2), "Kept": F.lit(3)})
    out = linededup.drop_boilerplate(df, Scratch(spark, "t"), ratio=0.4, min_pages=3)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"]) for r in out.collect()}
    assert got[0] == ("line 0\n", 5, 3) and got[9] == ("line 9", 1, 0)
    assert got[20] == ("Menu\nonly", 2, 0) and got[21] == (None, 0, 0) and got[22] == ("", 1, 0) and got[23] == ("Menu", 1, 0)
    assert linededup.drop_boilerplate(df.limit(0), Scratch(spark, "t")).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("batches", "chunk", "fanout"), [(1, 1 << 19, 4), (4, 40, 2)])
def test_substrings(spark, docs, rows, batches, chunk, fanout):
    found = substrings.dedup(docs, Scratch(spark, "t"), batches=batches, chunk_words=chunk, fanout=fanout)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted((str(r[0]), *x) for r, x in zip(order, plain.substrings([(r[0], r[1]) for r in order])))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in found.collect()) == want


def test_substrings_of_nothing_and_incrementally(spark):
    assert substrings.dedup(empty(spark), Scratch(spark, "t")).collect() == []
    scratch = Scratch(spark, "t")
    index = substrings.Index(spark, scratch, buckets=4, fanout=2)
    text = " ".join(f"w{i}" for i in range(30))
    for i in range(4):
        df = spark.createDataFrame([(i, f"{'new ' * i}{text}")], "doc_id long, text string")
        got = substrings.dedup(df, scratch, index=index).first()
        assert (got.n_removed, got.n_words) == (29 + i if i else 0, 30 + i)
    index.drop()


def test_window_hashes_are_those_of_the_words():
    data = b"a b c a b c a b c d e f"
    words, others, at = substrings.word_hashes(data)
    assert at.tolist() == list(range(0, 23, 2))
    for size in (1, 2, 3, 5, 7):
        h, check = substrings.window_hashes(words, others, size)
        keys = [tuple(data.split()[i : i + size]) for i in range(13 - size)]
        assert len(h) == len(keys) == len(check)
        for column in (h, check):
            assert len({(k, int(x)) for k, x in zip(keys, column)}) == len(set(keys))
            assert len(set(column.tolist())) == len(set(keys))


def test_words_that_a_polynomial_takes_for_the_same(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[x ^ turn] for x in bits) for turn in (0, 1))
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one[:60]} {rest}"), (4, f"{other[:60]} {rest}"), (5, f"{other} {rest}")]
    got = sorted(substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), size=20).collect())
    assert [(r.n_words, r.n_removed, r.text) for r in got] == plain.substrings(rows)
