"""Token ids, the binary store and packing: round trips and the tokenizers library itself."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import packing, tokenstore
from weftgraph.llm.tokens import Encoder
from weftgraph.plans.scratch import Scratch

tokenizers = pytest.importorskip("public_tokenizers")
FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ODD = ["It's we'll  they've 'S  'sx", " ", " \n \n x", "  x", "x  ", "\n\nx", "á ́b", "\x00a\x00 b", "<|endoftext|> a<|startoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|> <|endoftext", "été<|endoftext|><|endoftext|>\n x", "a\x1cb \x85c d", "", "İstanbul ΣΑΣ ſt ﬁ", "x" * 5000, "don't\tstop\r\nnow"]


def texts(n=300):
    rng = random.Random(9)
    signs = list("abcXYZ  \n\n\t\r  '’.,!#09é́ßİ 　\xa0\x85\x1c\x1f中文😀ñ-") + ["the ", "ing ", "été ", "'s "]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def library(kind, text):
    from tokenizers import Tokenizer

    t = _cache.get(kind)
    if t is None:
        t = _cache[kind] = Tokenizer.from_file(str(tokenizers.path(FILES[kind])))
    return t.encode(text or "", add_special_tokens=False).ids


_cache: dict = {}


@pytest.mark.parametrize("kind", FILES)
def test_chunks_give_the_librarys_ids(kind, monkeypatch):
    from weftgraph.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    encode = Encoder(str(tokenizers.path(FILES[kind])))
    for text in texts():
        assert np.frombuffer(encode(text), "<u4").tolist() == library(kind, text), text


ROWS = [(i * 3 % 41, t) for i, t in enumerate(texts(60))] + [(None, "no id"), (500, None), (7, "again"), (7, "again"), (600, "word " * 9000)]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, h int").repartition(3)
    path = str(tokenizers.path(FILES["word"]))
    store = f"file://{tmp_path}/store"
    tokenstore.write_store(df, store, Scratch(spark, "t"), path, end_id=2, shard_bytes=2000)
    back = tokenstore.read_store(spark, store).orderBy("start").collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in back) == sorted((str(i), (*library("word", t), 2)) for i, t in ROWS)
    at = 0
    for r in back:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    ids = [r.doc_id for r in back]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    shards, dictionary = tokenstore.open_store(spark, store)
    assert shards.count() > 2
    names = tokenstore.export(spark, store, str(tmp_path / "files"))
    plain = (tmp_path / "files" / "dictionary.zstd").read_bytes()
    assert plain == dictionary
    reader = tokenstore.ShardReader(open(names[1], "rb").read(), plain)
    one = next(r for r in back if r.doc_id == int(reader.index["id"][0]) and r.n_tokens == int(reader.index["n"][0]))
    assert reader.ids(0).tolist() == list(one.ids)
    with pytest.raises(ValueError, match="another dictionary"):
        tokenstore.ShardReader(open(names[1], "rb").read(), plain + b"x")


def test_empty_store(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([], "doc_id long, text string"), store, Scratch(spark, "t"), str(tokenizers.path(FILES["word"])))
    assert tokenstore.read_store(spark, store).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 200])
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity + 1))}
    plan = packing.Plan.of(counts, capacity)
    held = {}
    for length, n in counts.items():
        rank = np.arange(n)
        for s, o in zip(*(x.tolist() for x in plan.look_up(np.full(n, length), rank))):
            held.setdefault(s, []).append((o, length))
    assert len(held) == plan.sequences
    for pieces in held.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= capacity
    total = sum(k * v for k, v in counts.items())
    first_fit = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [i for i, room in enumerate(first_fit) if room >= length]
        if fits:
            first_fit[min(fits, key=lambda i: first_fit[i])] -= length
        else:
            first_fit.append(capacity - length)
    assert -(-total // capacity) <= plan.sequences <= len(first_fit)


    for lengths, times in plan.filled:
        assert sum(lengths) == capacity and 1 <= len(lengths) <= 4 and times > 0


def test_no_gap_that_three_lengths_fill_is_left():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 9) for n in rng.sample(range(20, 100), 30)}
    plan = packing.Plan(counts, 100)
    left = dict(counts)
    for lengths, times in plan.filled:
        for x in lengths:
            left[x] -= times
    assert min(left.values()) >= 0
    rest = [n for n, k in left.items() for _ in range(k)]
    sums = {sum(x) for size in (1, 2, 3, 4) for x in itertools.combinations(rest, size)}
    assert 100 not in sums


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_tables_take_as_few_sequences_as_can_be(spark):
    rows = packing.cut(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tokenizers.path(FILES["byte"]))).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in rows}
    plan = packing.Plan.of(counts, 2048)
    assert plan.sequences == -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(times for lengths, times in plan.filled if len(lengths) > 2) > 100


def test_exact_complements_leave_nothing():
    plan = packing.Plan({60: 4, 40: 2, 30: 2, 10: 2, 25: 4, 20: 1, 35: 0, 50: 2}, 100)
    assert plan.sequences == -(-(60 * 4 + 80 + 60 + 20 + 100 + 20 + 100) // 100)


def test_pack_documents(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, length int").repartition(3)
    path = str(tokenizers.path(FILES["byte"]))
    packed = packing.pack(packing.cut(df, path, capacity=64, end_id=0, with_ids=True), Scratch(spark, "t"), capacity=64).persist()
    rows = packed.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((str(r.doc_id)), []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        assert r.length == 64 or r.piece == 0
    want = sorted((str(i), tuple(library("byte", t)) + (0,)) for i, t in ROWS)
    for name, ids in want:
        if sum(n == name for n, _ in want) == 1:
            own = sorted(pieces[name], key=lambda r: r.piece)
            assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
            assert tuple(x for r in own for x in r.ids) == ids
            assert len(own) == max(1, -(-len(ids) // 64))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in used.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]
        assert sum(n for _, n in s) <= 64
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(ids) for _, ids in want) and max(len(r.ids) for r in whole) <= 64
    assert packing.pack(packing.cut(df.limit(0), path), Scratch(spark, "t")).collect() == []
