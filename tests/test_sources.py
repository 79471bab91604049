import struct

import pytest
from pyspark.sql import functions as F

from tests.graphs import F1, f1
from weftgraph import functions, streaming
from weftgraph.plans.components import star_components
from weftgraph.plans.scratch import Scratch
from weftgraph.sources import binary, text


def test_text_edges(spark, tmp_path):
    p = tmp_path / "edges.mtx"
    p.write_text("% a comment\n# 8 8 13\n" + "\n".join(" ".join(map(str, e)) for e in F1) + "\n\n")
    assert sorted(map(tuple, text.read_edges(spark, str(p), weight="int").collect())) == sorted(F1)
    assert text.read_edges(spark, str(p)).columns == ["src", "dst"]
    assert text.read_header(str(p)) == (8, 8, 13)


@pytest.mark.parametrize(("weight", "layout"), [("none", "<II"), ("int", "<III"), ("double", "<IId")])
@pytest.mark.parametrize("header", [False, True])
def test_binary_edges(spark, tmp_path, weight, layout, header):
    rows = [e if weight != "none" else e[:2] for e in F1]
    p = tmp_path / "edges.bin"
    p.write_bytes((struct.pack("<IIQ", 8, 8, 13) if header else b"") + b"".join(struct.pack(layout, *r) for r in rows) + b"\1")
    found = binary.read_edges(spark, str(p), weight, header, split=40)
    assert found.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    binary.write_edges(found, str(tmp_path / "out"), weight, header)
    back = binary.read_edges(spark, str(tmp_path / "out"), weight, header)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    if header:
        assert binary.read_header(str(tmp_path / "out")) == (8, 8, 13)


def test_text_writer(spark, tmp_path):
    edges = f1(spark).where("src <> dst").dropDuplicates(["src", "dst"])
    out = str(tmp_path / "text")
    text.write_edges(edges.select("src", "dst"), out, weights="own", header=(8, 8, 13))
    assert {r.weight for r in text.read_edges(spark, out, "int").collect()} == {1}
    assert text.read_header(out) == (8, 8, 13)
    text.write_edges(edges, str(tmp_path / "random"), weights="random")
    drawn = [r.weight for r in text.read_edges(spark, str(tmp_path / "random"), "int").collect()]
    assert len(drawn) == 13 and all(1 <= w <= 128 for w in drawn)
    again = edges.select(functions.random_weight("src", "dst")).collect()
    assert sorted(r[0] for r in again) == sorted(drawn)


def test_labels_terms_queries_postings(spark, tmp_path):
    (tmp_path / "labels").write_text('[\n{"d":"O"},\n{"d":"R S"},\nnull,\n{"d":"P"}\n]\n')
    assert sorted(map(tuple, text.read_vertex_labels(spark, str(tmp_path / "labels")).collect())) == [(0, "O"), (1, "R S"), (3, "P")]
    (tmp_path / "pattern").write_text("O RS\nPM\n")
    assert sorted(map(tuple, text.read_pattern_labels(spark, str(tmp_path / "pattern")).collect())) == [(0, "O"), (1, "RS"), (2, "PM")]
    (tmp_path / "terms").write_text("t1 9\nt2 8\n")
    assert sorted(map(tuple, text.read_terms(spark, str(tmp_path / "terms"), 7).collect())) == [("t1", 8), ("t2", 9)]
    (tmp_path / "queries").write_text("t4 t3\n\nt2  t3\n\n")
    assert sorted((r.qid, r.terms) for r in text.read_queries(spark, str(tmp_path / "queries")).collect()) == [(0, ["t4", "t3"]), (1, ["t2", "t3"])]
    (tmp_path / "a").write_text("1\tx\t2\n1\t\t3\n")
    (tmp_path / "b").write_text("1\ty\t1\n")
    found = text.read_postings(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(map(tuple, found.collect())) == [(0, 1, "x", 2), (1, 1, "y", 1)]


def test_permutation_and_hash(spark):
    ids = spark.range(0, 64).select("id", functions.bucket_id("id", 8, 8).alias("d"))
    back = ids.withColumn("back", functions.bucket_id_back("d", 8, 8))
    assert sorted(r.d for r in back.collect()) == list(range(64)) and back.where("back <> id").isEmpty()
    both = spark.createDataFrame([("ab",), ("ba",)], "s string").select(functions.string_hash("s", both_ways=True))
    assert len({r[0] for r in both.collect()}) == 1


def test_star_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (200, 100)]
    found = {r.id: r.component for r in star_components(spark.createDataFrame(path, "src long, dst long"), Scratch(spark, "test")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 100}
    assert star_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "test")).isEmpty()


def test_streaming_degrees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    query = streaming.degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        found = {r.id: (r.out_degree, r.in_degree) for r in spark.table("degrees").collect()}
    finally:
        query.stop()
    assert found == {1: (2, 0), 2: (0, 1), 3: (0, 1)}
    assert spark.table("degrees").where(F.col("id") == 1).count() == 1


def test_binary_writer_refuses_what_it_cannot_keep(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    for wrong in (4294967301, -1):
        with pytest.raises(Exception, match="unsigned"):
            binary.write_edges(spark.createDataFrame([(wrong, 2)], "src long, dst long"), str(tmp_path / f"wrong{wrong}"))
    binary.write_edges(edges, str(tmp_path / "once"))
    with pytest.raises(FileExistsError):
        binary.write_edges(edges, str(tmp_path / "once"))


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    sizes = [1, 5000, 3, 700]  # Spark packs the largest first
    lines = [f"t{i}" for i in range(sum(sizes))]
    for part, n in enumerate(sizes):
        at = sum(sizes[:part])
        (tmp_path / f"part-{part:05d}.txt").write_text("\n".join(lines[at : at + n]) + "\n")
    found = {r.term: r.term_id for r in text.read_terms(spark, str(tmp_path)).collect()}
    assert found == {x: i + 1 for i, x in enumerate(lines)}
