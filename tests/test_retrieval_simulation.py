import re

import pytest
from pyspark.sql import functions as F

from tests.graphs import F2, F2_QUERIES, F3, F3_LABELS, Q1, Q2, Q3
from weftgraph.operators import corpus, retrieval, simulation


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame([(d, f"t{t}", n) for d, t, n in F2], "doc long, term string, tf long")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(F2_QUERIES)), "qid long, terms array<string>")


def _scores(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.doc, r.score))
    return out


def _close(found, expected):
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected], abs=1e-5)


def test_statistics(postings):
    assert {r.doc: r.length for r in retrieval.doc_stats(postings).collect()} == {1: 6, 2: 4, 3: 6, 4: 3, 5: 5, 6: 3, 7: 6}
    row = retrieval.collection_stats(postings, 7).first()
    assert (row.n_tokens, round(row.mean_length, 6)) == (33, 4.714286)
    assert {r.term: (r.df, r.total_tf) for r in retrieval.term_stats(postings).collect()}["t4"] == (3, 6)


def test_bm25(postings, queries):
    found = _scores(retrieval.bm25(postings, queries, 7, 3))
    for q in (0, 1):
        _close(found[q], [(4, 0.530482), (1, 0.508382), (3, 0.162043)])
    _close(found[2], [(1, 0.945671), (4, 0.530482), (7, 0.308053)])


def test_language_model(postings, queries):
    found = _scores(retrieval.language_model(postings, queries, 7, 3))
    for q in (0, 1):
        _close(found[q], [(1, 0.002740), (4, 0.001679), (3, 0.000966)])
    _close(found[2], [(1, 0.006190), (4, 0.001028), (2, -0.000221)])


def test_unknown_and_repeated_terms(spark, postings):
    odd = spark.createDataFrame([(0, ["t4", "t3", "t4", "nothing"]), (1, ["nothing"])], "qid long, terms array<string>")
    found = _scores(retrieval.bm25(postings, odd, 7, 99))
    assert set(found) == {0}
    _close(found[0], [(4, 0.530482), (1, 0.508382), (3, 0.162043), (2, 0.156753)])
    longer = _scores(retrieval.language_model(postings, odd, 7, 99))[0]
    plain = _scores(retrieval.language_model(postings, spark.createDataFrame([(0, ["t4", "t3"])], "qid long, terms array<string>"), 7, 99))[0]
    assert all(a[1] < b[1] for a, b in zip(sorted(longer), sorted(plain)))
    terms = spark.createDataFrame([("t3", 10)], "term string, term_id long")
    assert {(r.term, r.term_id) for r in retrieval.term_lookup(retrieval.query_terms(odd), terms).collect()} == {("t4", 0), ("t3", 10), ("nothing", 0)}


def _simulate(spark, pattern, edges=F3, labels=F3_LABELS):
    e = spark.createDataFrame(edges, "src long, dst long")
    data = spark.createDataFrame([(i, x) for i, x in enumerate(labels) if x is not None], "id long, label string")
    return {(r.id, r.q) for r in simulation.simulate(e, data, spark.createDataFrame(pattern[1], "src long, dst long"), spark.createDataFrame(list(enumerate(pattern[0])), "q long, label string")).collect()}


EXPECTED = {(0, 0), (7, 0), (2, 1), (8, 1), (10, 1), (5, 2), (9, 2), (3, 3), (6, 3), (11, 3), (12, 3)}


@pytest.mark.parametrize(("pattern", "expected"), [(Q1, EXPECTED), (Q2, EXPECTED), (Q3, set())])
def test_simulation(spark, pattern, expected):
    assert _simulate(spark, pattern) == expected


def test_simulation_is_a_fixpoint_on_odd_inputs(spark):
    # a repeated label, a vertex without a label, a loop, a source with a leaf child
    edges, labels = [(0, 0), (0, 1), (2, 1), (3, 2)], ["A", "B", "A", None]
    assert _simulate(spark, (["A", "B"], [(0, 1)]), edges, labels) == {(0, 0), (2, 0), (1, 1)}
    assert _simulate(spark, (["A", "A"], [(0, 1)]), edges, labels) == {(0, 0), (0, 1), (2, 1)}


def test_dictionary_and_doc_ids(spark):
    rows = [(0, 1, "b", 2), (0, 2, "a", 1), (1, 1, "c", 1), (1, 1, "a", 4), (2, 1, "ä", 1)]
    moved = corpus.global_doc_ids(spark.createDataFrame(rows, "part int, doc_id long, term string, tf long"))
    edges, terms = corpus.build(moved)
    names = {r.term: r.term_id for r in terms.collect()}
    assert names == {"a": 1, "b": 2, "c": 3, "ä": 4}
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2, 2), (2, 1, 1), (3, 1, 4), (3, 3, 1), (4, 4, 1)]
    assert corpus.postings_of(spark.createDataFrame([(0, "A b,a"), (1, None), (2, "")], "doc_id long, text string")).where(F.col("term") == "a").first().tf == 2


def test_postings_of_a_part_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).selectExpr("int(id % 2) AS part", "id AS doc_id", "'a' AS term", "1L AS tf")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        moved = corpus.global_doc_ids(rows, spark.createDataFrame([(0, 9000), (1, 9000)], "part int, n_docs long"))
        per_task = [n for (n,) in moved.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(per_task) <= 4000 / 4


def _dealt_by(df):
    """The columns by which a plan deals rows, in turn."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_words_are_counted_where_their_text_is(spark):
    texts = spark.createDataFrame([(0, "a b,a"), (1, None), (2, ""), (0, "b  c")], "doc_id long, text string")
    found = corpus.postings_of(texts)
    assert _dealt_by(found) == ["doc"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2), (1, "b", 2), (1, "c", 1)]


def test_scores_of_a_document_come_from_one_task(spark, postings, queries):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        hits = retrieval._matches(postings, retrieval.query_terms(queries), 7)
        dealt = _dealt_by(hits.groupBy("qid", "doc").agg(F.sum("tf")))
        assert not any("doc" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
