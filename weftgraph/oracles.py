"""SQL for DuckDB that answers the registered queries on the same tables.

Fixpoints are unrolled: each round is a materialised step that reads the one before, for
more rounds than any of the given tables needs.
"""

from __future__ import annotations

from weftgraph.functions import NOT_WORD
from weftgraph.queries import PATTERN, ROOT, TOP

_N = "(SELECT max(c_custkey) FROM customer)"
_RAW = f"SELECT o_custkey AS src, (o_orderkey * 7919 + 13) % ({_N} + 1) AS dst, o_orderkey % 128 + 1 AS weight, o_orderkey AS ord FROM orders"
_MIX = f"SELECT * FROM ({_RAW}) WHERE src % 7 <> 0 AND dst % 5 <> 0"
_PLAIN = "SELECT DISTINCT src, dst FROM ({}) WHERE src <> dst"
_FIRST = "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS r FROM ({}) WHERE src <> dst) WHERE r = 1"
_BOTH = "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ({0}) UNION ALL SELECT dst, src FROM ({0})) WHERE src <> dst"
_DAG = f"SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({_RAW}) WHERE src <> dst"
_V = f"SELECT unnest(range(0, {_N} + 1)) AS id"
_KIND = "CASE WHEN o.src IS NOT NULL AND i.dst IS NOT NULL THEN 'regular' WHEN i.dst IS NOT NULL THEN 'sink' WHEN o.src IS NOT NULL THEN 'source' ELSE 'isolated' END"


def _with(**steps: str) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in steps.items()) + " "


_MIXED = {"e": _PLAIN.format(_MIX), "v": _V, "k": f"SELECT v.id, {_KIND} AS kind FROM v LEFT JOIN (SELECT DISTINCT src FROM e) o ON v.id = o.src LEFT JOIN (SELECT DISTINCT dst FROM e) i ON v.id = i.dst"}
_IN = "SELECT v.id, CAST(count(e.src) AS BIGINT) AS degree FROM v LEFT JOIN e ON v.id = e.dst GROUP BY v.id"
_OUT = "SELECT v.id, CAST(count(e.dst) AS BIGINT) AS degree FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id"


def _pagerank(rounds: int, deferred: bool) -> dict[str, str]:
    steps = dict(_MIXED) | {"od": "SELECT src, count(*) AS d FROM e GROUP BY src", "r0": "SELECT id, 0.15::DOUBLE AS rank FROM v"}
    in_loop = "JOIN k ON k.id = e.dst AND k.kind = 'regular'" if deferred else ""
    for i in range(1, rounds + 1):
        steps[f"r{i}"] = f"SELECT p.id, coalesce(0.15 + 0.85 * s.x, p.rank) AS rank FROM r{i - 1} p LEFT JOIN (SELECT e.dst, sum(r.rank / od.d) AS x FROM e JOIN r{i - 1} r ON r.id = e.src JOIN od ON od.src = e.src {in_loop} GROUP BY e.dst) s ON s.dst = p.id"
    steps["last"] = f"SELECT * FROM r{rounds}"
    if deferred:
        steps["last"] = f"SELECT p.id, coalesce(0.15 + 0.85 * s.x, p.rank) AS rank FROM r{rounds} p LEFT JOIN (SELECT e.dst, sum(r.rank / od.d) AS x FROM e JOIN r{rounds} r ON r.id = e.src JOIN od ON od.src = e.src JOIN k ON k.id = e.dst AND k.kind = 'sink' GROUP BY e.dst) s ON s.dst = p.id"
    return steps


def _unrolled(rounds: int, first: str, step: str) -> dict[str, str]:
    """r0 by first, and r1 to r<rounds> by step, in which {p} is the round before."""
    return {"r0": first} | {f"r{i}": step.replace("{p}", f"r{i - 1}") for i in range(1, rounds + 1)}


_SSSP = {"e": _FIRST.format(_MIX), "v": _V} | _unrolled(45, f"SELECT CAST({ROOT} AS BIGINT) AS id, CAST(0 AS BIGINT) AS d", "SELECT id, min(d) AS d FROM (SELECT * FROM {p} UNION ALL SELECT e.dst, p.d + e.weight FROM {p} p JOIN e ON e.src = p.id) GROUP BY id") | {"s": "SELECT v.id, CAST(r45.d AS BIGINT) AS distance FROM v LEFT JOIN r45 ON r45.id = v.id"}
_BFS = {"e": _BOTH.format(_MIX), "v": _V} | _unrolled(12, f"SELECT CAST({ROOT} AS BIGINT) AS id, 0 AS h", "SELECT id, min(h) AS h FROM (SELECT * FROM {p} UNION ALL SELECT e.dst, p.h + 1 FROM {p} p JOIN e ON e.src = p.id) GROUP BY id") | {
    "up": "SELECT a.id, max(b.id) AS parent FROM r12 a JOIN e ON e.dst = a.id JOIN r12 b ON b.id = e.src AND b.h = a.h - 1 GROUP BY a.id",
    "s": "SELECT v.id, CAST(r12.h AS BIGINT) AS hops, CAST(CASE WHEN r12.h = 0 THEN 0 ELSE up.parent END AS BIGINT) AS parent FROM v LEFT JOIN r12 ON r12.id = v.id LEFT JOIN up ON up.id = v.id",
}
_CC = {"e": _BOTH.format(_MIX), "v": _V} | _unrolled(14, "SELECT id, id AS label FROM v", "SELECT id, min(label) AS label FROM (SELECT * FROM {p} UNION ALL SELECT e.dst, p.label FROM {p} p JOIN e ON e.src = p.id) GROUP BY id") | {"s": "SELECT id, CAST(label AS BIGINT) AS label FROM r14"}
_TC = {"e": _DAG, "v": _V, "t": "SELECT ab.dst AS id, count(*) AS n FROM e ab JOIN e bc ON bc.src = ab.dst JOIN e ac ON ac.src = ab.src AND ac.dst = bc.dst GROUP BY ab.dst", "s": "SELECT v.id, CAST(coalesce(t.n, 0) AS BIGINT) AS triangles FROM v LEFT JOIN t ON t.id = v.id"}
_VALUES = ", ".join(f"({a}, {b})" for a, b in PATTERN)
_SIM = {
    "e": _PLAIN.format(_MIX),
    "q": "SELECT row_number() OVER (ORDER BY label) - 1 AS q, label FROM (SELECT DISTINCT c_mktsegment AS label FROM customer) ORDER BY label LIMIT 4",
    "pe": f"SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM (VALUES {_VALUES}) t(a, b)",
    "need": "SELECT src AS q, count(*) AS need FROM pe GROUP BY src",
} | _unrolled(40, "SELECT c_custkey AS id, q.q FROM customer JOIN q ON q.label = c_mktsegment", "SELECT p.id, p.q FROM {p} p LEFT JOIN need ON need.q = p.q LEFT JOIN (SELECT e.src AS id, pe.src AS q, count(DISTINCT c.q) AS met FROM {p} c JOIN e ON e.dst = c.id JOIN pe ON pe.dst = c.q GROUP BY e.src, pe.src) h ON h.id = p.id AND h.q = p.q WHERE coalesce(h.met, 0) >= coalesce(need.need, 0)")
_POSTINGS = {
    "w": f"SELECT doc_id + 1 AS doc, unnest(string_split_regex(lower(text), '{NOT_WORD}')) AS term FROM documents",
    "p": "SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM w WHERE term <> '' GROUP BY doc, term",
}
_STATS = {
    "nd": "SELECT count(*) AS n FROM documents",
    "dl": "SELECT doc, CAST(sum(tf) AS BIGINT) AS length FROM p GROUP BY doc",
    "ts": "SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM p GROUP BY term",
    "cs": "SELECT CAST(sum(tf) AS BIGINT) AS n_tokens, sum(tf) / (SELECT n FROM nd) AS mean_length FROM p",
}
_QUERIES = {
    "bw": f"SELECT item_id AS qid, t.term, t.i FROM benchmark, LATERAL (SELECT unnest(x) AS term, generate_subscripts(x, 1) AS i FROM (SELECT string_split_regex(lower(text), '{NOT_WORD}') AS x)) t WHERE t.term <> ''",
    "bf": "SELECT qid, term, min(i) AS i FROM bw GROUP BY qid, term",
    "qt": "SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS pos FROM bf",
}
_BEST = f"SELECT qid, rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= {TOP}"
_DICT = "SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM (SELECT DISTINCT term FROM p)"
_PROGRAM_STEP = "SELECT p.id, greatest(p.best, coalesce(s.acc * {i}, p.best)) AS best, coalesce(greatest(p.best, s.acc * {i}) > p.best, false) AS active FROM {p} p LEFT JOIN (SELECT e.dst, max(q.best + e.weight + z.best) AS acc FROM {p} q JOIN e ON e.src = q.id JOIN r0 z ON z.id = e.dst WHERE q.active GROUP BY e.dst) s ON s.dst = p.id"


def _program(rounds: int) -> str:
    steps = {"e": _FIRST.format(_MIX), "v": _V, "r0": "SELECT id, CAST(0 AS BIGINT) AS best, id % 3 = 0 AS active FROM v"}
    for i in range(1, rounds + 1):
        steps[f"r{i}"] = _PROGRAM_STEP.replace("{i}", str(i)).replace("{p}", f"r{i - 1}")
    return _with(**steps) + f"SELECT id, CAST(best AS BIGINT) AS best FROM r{rounds}"


_PARTED = {
    "g": "SELECT (doc - 1) % 4 AS part, (doc - 1) // 4 AS doc_id, term, tf FROM p",
    "pc": "SELECT part, count(DISTINCT doc_id) AS n FROM g GROUP BY part",
    "po": "SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pc",
    "dict": _DICT,
}
_SETS = {"o": "SELECT DISTINCT src AS id FROM e", "i": "SELECT DISTINCT dst AS id FROM e"}

ORACLES: dict[str, str] = {
    "edges_normalized": _PLAIN.format(_RAW),
    "edges_reversed": f"SELECT dst AS src, src AS dst FROM ({_PLAIN.format(_RAW)})",
    "edges_symmetric": _BOTH.format(_RAW),
    "edges_acyclic": _DAG,
    "edges_weighted_dedupe": _FIRST.format(_RAW),
    "bipartite_offset": "SELECT DISTINCT l_partkey + 1 AS src, l_suppkey + 1 + (SELECT count(*) FROM part) AS dst FROM lineitem WHERE l_partkey + 1 <> l_suppkey + 1 + (SELECT count(*) FROM part)",
    "bipartite_sides": "SELECT CASE WHEN id <= (SELECT count(*) FROM part) THEN 'left' ELSE 'right' END AS side, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + 1)) AS id) GROUP BY 1",
    "vertex_classes": _with(**_MIXED) + "SELECT id, kind FROM k",
    "graph_metadata": _with(**_MIXED) + f"SELECT CAST(count(*) AS BIGINT) AS n_edges, CAST({_N} + 1 AS BIGINT) AS n_vertices FROM e",
    "in_degree": _with(**_MIXED) + _IN,
    "out_degree": _with(**_MIXED) + _OUT,
    "degree_top3": _with(e=_PLAIN.format(_RAW), v=_V) + f"SELECT * FROM ({_IN}) ORDER BY degree DESC, id LIMIT 3",
    "pagerank_1": _with(**_pagerank(1, False)) + "SELECT id, round(rank, 12) AS rank FROM last",
    "pagerank_10": _with(**_pagerank(10, True)) + "SELECT id, round(rank, 12) AS rank FROM last",
    "pagerank_textbook_10": _with(**_pagerank(10, False)) + "SELECT id, round(rank, 12) AS rank FROM last",
    "pagerank_converged": _with(**_pagerank(120, True)) + "SELECT id, round(rank, 5) AS rank FROM last",
    "pagerank_checksum": _with(**_pagerank(10, True)) + "SELECT (SELECT CAST(count(*) AS BIGINT) FROM e) AS degrees, round(sum(rank), 4) AS ranks FROM last",
    "sssp": _with(**_SSSP) + "SELECT id, distance FROM s",
    "sssp_summary": _with(**_SSSP) + "SELECT CAST(count(distance) AS BIGINT) AS reached, CAST(sum(coalesce(distance, 2147483647)) AS BIGINT) AS checksum FROM s",
    "bfs": _with(**_BFS) + "SELECT id, hops, parent FROM s",
    "bfs_summary": _with(**_BFS) + "SELECT CAST(count(hops) AS BIGINT) AS reached, CAST(sum(hops * parent) AS BIGINT) AS checksum FROM s",
    "cc": _with(**_CC) + "SELECT id, label FROM s",
    "cc_checksum": _with(**_CC) + "SELECT CAST(sum(label) AS BIGINT) AS labels FROM s",
    "triangles_per_vertex": _with(**_TC) + "SELECT id, triangles FROM s",
    "triangles_total": _with(**_TC) + "SELECT CAST(sum(triangles) AS BIGINT) AS triangles FROM s",
    "in_neighbors_sorted": f"SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS neighbours FROM ({_DAG}) GROUP BY dst",
    "vertex_program_one_round": _program(1),
    "vertex_program_three_rounds": _program(3),
    "init_from_state": _with(**_MIXED, o=_OUT) + "SELECT o.id, o.degree AS own, CAST(coalesce(s.x, 0) AS BIGINT) AS around FROM o LEFT JOIN (SELECT e.dst, sum(o.degree) AS x FROM e JOIN o ON o.id = e.src GROUP BY e.dst) s ON s.dst = o.id",
    "bipartite_round": "WITH b AS (SELECT DISTINCT l_partkey + 1 AS src, l_suppkey + 1 + (SELECT count(*) FROM part) AS dst FROM lineitem), u AS (SELECT unnest(range((SELECT count(*) FROM part) + 1, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + 1)) AS id) SELECT u.id, CAST(coalesce(sum(b.src), 0) AS BIGINT) AS total FROM u LEFT JOIN b ON b.dst = u.id GROUP BY u.id",
    "reduce_active": _with(**_MIXED) + f"SELECT max(degree) AS degree FROM ({_IN}) WHERE degree > 5",
    "btopk": _with(**_MIXED, a=_IN, b=_OUT) + "SELECT batch, rank, id, value FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY value DESC, id) AS rank FROM (SELECT CAST(0 AS BIGINT) AS batch, id, degree AS value FROM a UNION ALL SELECT 1, id, degree FROM b UNION ALL SELECT 2, a.id, a.degree + b.degree FROM a JOIN b ON a.id = b.id)) WHERE rank <= 5",
    "subset_init": f"SELECT id, id * 2 AS value, id % 10 = 0 AS active FROM ({_V})",
    "bitset_ops": _with(**_MIXED, **_SETS) + "SELECT 'union' AS part, id FROM (SELECT id FROM o UNION SELECT id FROM i) UNION ALL SELECT 'intersect', id FROM (SELECT id FROM o INTERSECT SELECT id FROM i) UNION ALL SELECT 'difference', id FROM (SELECT id FROM o EXCEPT SELECT id FROM i) UNION ALL SELECT 'rest', id FROM (SELECT id FROM v EXCEPT (SELECT id FROM o UNION SELECT id FROM i))",
    "display_head": _with(**_MIXED) + f"SELECT * FROM ({_IN}) WHERE id <= 30 ORDER BY id",
    "id_permutation": f"SELECT id, (id % 128) * ({_N} // 128 + 1) + id // 128 AS dealt, id AS back FROM ({_V})",
    "doc_stats": _with(**_POSTINGS, **_STATS) + "SELECT doc, length FROM dl",
    "term_stats": _with(**_POSTINGS, **_STATS) + "SELECT term, df, total_tf FROM ts",
    "collection_stats": _with(**_POSTINGS, **_STATS) + "SELECT n_tokens, round(mean_length, 6) AS mean_length FROM cs",
    "term_dictionary": _with(**_POSTINGS) + _DICT,
    "corpus_roundtrip": _with(**_POSTINGS) + _DICT,
    "query_term_lookup": _with(**_POSTINGS, **_QUERIES, dict=_DICT) + "SELECT qid, pos, qt.term, coalesce(term_id + (SELECT count(*) FROM documents), 0) AS term_id FROM qt LEFT JOIN dict ON dict.term = qt.term",
    "bm25_topk": _with(**_POSTINGS, **_STATS, **_QUERIES, s="SELECT qid, p.doc, round(sum(log10((nd.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM qt JOIN p ON p.term = qt.term JOIN ts ON ts.term = p.term JOIN dl ON dl.doc = p.doc, nd, cs GROUP BY qid, p.doc") + _BEST,
    "lm_topk": _with(**_POSTINGS, **_STATS, **_QUERIES, s="SELECT qt.qid, p.doc, round(sum(log10(1 + tf / (2000.0::DOUBLE * total_tf / n_tokens))) + any_value(m.n) * log10(2000.0::DOUBLE / (any_value(length) + 2000.0::DOUBLE)), 6) AS score FROM qt JOIN p ON p.term = qt.term JOIN ts ON ts.term = p.term JOIN dl ON dl.doc = p.doc JOIN (SELECT qid, count(*) AS n FROM qt GROUP BY qid) m ON m.qid = qt.qid, cs GROUP BY qt.qid, p.doc") + _BEST,
    "corpus_graph": _with(**_POSTINGS, **_PARTED) + "SELECT CAST(g.doc_id + po.before AS BIGINT) AS doc_id, term_id, tf FROM g JOIN po ON po.part = g.part JOIN dict ON dict.term = g.term",
    "graph_simulation": _with(**_SIM) + "SELECT id, q FROM r40",
    "graph_simulation_count": _with(**_SIM) + "SELECT CAST(count(DISTINCT id) AS BIGINT) AS matched FROM r40",
    "binary_roundtrip": _FIRST.format(_RAW),
    "text_roundtrip": _FIRST.format(_RAW),
    "random_weights": "SELECT src, dst, CAST(((m * 48271 + 12345) % 2147483647 * 48271 + 12345) % 2147483647 // 1024 % 128 + 1 AS BIGINT) AS weight FROM (SELECT src, dst, (src::BIGINT * 7919 + dst::BIGINT * 104729 + 1299709) % 2147483647 AS m FROM (" + _PLAIN.format(_RAW) + "))",
}
