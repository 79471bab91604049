"""Costs that each task or each batch has, whatever it holds."""

import gc

import pyarrow as pa

from tests.llm import plain
from weftgraph.llm import substrings
from weftgraph.llm.common import lean
from weftgraph.plans.scratch import Scratch


def test_collections_after_tasks_do_not_walk_loaded_modules(spark):
    def seen(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([len(gc.get_objects())])], ["n"]) for _ in batches)

    found = spark.range(0, 8, 1, 8).mapInArrow(lean(seen), "n long").collect()
    assert found and max(r.n for r in found) < 20_000


def test_rows_of_a_chunk_go_in_few_batches(spark, monkeypatch):
    made = []
    monkeypatch.setattr(substrings, "lean", lambda run: made.append(run) or run)
    words = " ".join(f"w{i}" for i in range(5000))
    substrings._rows_of(spark.createDataFrame([(1, words)], "doc_id long, text string"), 20, 300, 1 << 18)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([words])], ["doc_id", "text"])
    out = list(made.pop()(iter([batch])))
    assert sum(b.num_rows for b in out) == 301 and len(out) == 2
    monkeypatch.setattr(substrings, "BATCH_BYTES", 20_000)
    cut = list(substrings._chunk_batches("c", [(1, words.encode())], 20, 300))
    assert 4 <= len(cut) < 9 and [r for b in cut[1:] for r in b.to_pylist()] == [r | {"chunk": "c"} for r in out[1].to_pylist()]


def test_ids_and_indices_of_any_width(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    filler = " ".join("abcdefghij"[i % 7] + str(i) for i in range(70_000))  # indices of three bytes
    rows = [(1 - (1 << 63), passage), (-5, f"{filler} {passage}"), (3, passage), (70_000, f"x {passage}"), (1 << 40, passage), ((1 << 63) - 1, f"y {passage} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for chunk in (10, 4000, 1 << 18):  # packed pieces, records, and both in one bucket
        got = sorted(substrings.dedup(df, Scratch(spark, "t"), batches=2, chunk_words=chunk).collect())
        assert [(r.n_words, r.n_removed, r.text) for r in got] == plain.substrings(rows)
