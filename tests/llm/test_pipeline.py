"""run() of the pipeline, each stage against plain versions on the rows handed to it."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_models import SYLLABLES, speak
from tests.llm.test_nearcopies import edited, kept_of
from tests.llm.test_tokens import library

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_boilerplate(rows):
    pages, seen = Counter(r.source for r in rows), defaultdict(Counter)
    for r in rows:
        seen[r.source].update({x.strip(" \t\r") for x in r.text.split("\n")} - {""})
    gone = {(h, x) for h, lines in seen.items() for x, n in lines.items() if n >= 5 and n > 0.05 * pages[h]}
    out = []
    for r in rows:
        lines = r.text.split("\n")
        kept = [x for x in lines if (r.source, x.strip(" \t\r")) not in gone]
        text = "\n".join(kept)
        out.append((r.doc_id, text, r.lang, r.source, r.n_chars if len(kept) == len(lines) else len(text)))
    return out


def test_run_stage_by_stage(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    items = [(1, " ".join(f"bench{i}" for i in range(14))), (2, speak(rng, "zz", 16))]
    rows = []
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        text = speak(rng, lang, rng.randrange(20, 90))
        if i % 9 == 4:
            text = edited(rng, rows[i - 3][1].split(), 1)
        if i % 20 == 5:
            text = f"{text} {items[1][1]} {text}" if lang == "zz" else f"{text} {items[0][1]}"
        if i % 4 == 0:
            text = f"{speak(random.Random(1), 'xx', 3)}\n{text}"
        rows.append((i, text, lang, f"host{i % 2}", len(text)))
    odd = [(900, None, "xx", "host0", 0), (901, "12 34", "xx", "host1", 5), (902, "人人生而自由", None, "host1", 6)]
    long = (903, speak(rng, "yy", 3000), "yy", "host0", 7)
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([*rows, *odd, long], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    handed = []

    def watched(stage):
        def f(spark, docs, sf_dir):
            assert docs.columns == COLUMNS
            handed.append(sorted(docs.collect()) if handed else None)
            return stage(spark, docs, sf_dir)

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, spoken, lined, distinct, clean = handed
    assert {r.doc_id for r in spoken} == {r[0] for r in [*rows, long]}
    langs = {r[0]: r[2] for r in [*rows, long]}
    assert all(r.lang == langs[r.doc_id] for r in spoken)
    assert [tuple(r) for r in lined] == without_boilerplate(spoken)
    assert lined != spoken
    assert distinct == sorted(kept_of(lined)) and len(distinct) < len(lined) - 10
    assert clean == [r for r in distinct if not plain.contamination(r.text, items)[1]] and len(clean) < len(distinct) - 5

    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for r in clean:
        ids, own = [*library("byte", r.text), 0], sorted(pieces.pop(r.doc_id), key=lambda x: x.piece)
        assert sum(x.length for x in own) == len(ids)
        for x in own:
            assert zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    assert not pieces
    for own in places.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 2048
