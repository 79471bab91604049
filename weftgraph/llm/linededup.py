"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line is boilerplate of a host where more than ``ratio`` of the host's pages have it (and
``min_pages`` at least).  Lines are counted by their hash, once a page, with map-side
combining, so a host or a line with a third of all rows is summed before it is shuffled.
The pages of a host have few lines that frequent: fewer than its mean lines a page divided
by the ratio.  That bounds the list that each host's pages are held against, and a hash
collision can only matter between one of those few and another line of the same host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh
from weftgraph.plans.scratch import Scratch

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.05
#: ... if so many pages have it.
MIN_PAGES = 5
#: Up to so many line hashes of all hosts together (8 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): for each host with any, the hashes of its boilerplate lines."""
    rows = pages.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    filled = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    seen = rows.select("host", F.explode(F.array_distinct(F.transform(filled, _key))).alias("key"))
    counted = seen.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counted.join(totals, counted["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy(counted["host"]).agg(F.collect_set("key").alias("keys"))


def drop_boilerplate(pages: DataFrame, scratch: Scratch, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the boilerplate lines gone from the text, and two more columns:
    ``__n_lines`` and ``__n_dropped``.

    Lines are cut at newlines and compared without blanks, tabs and carriage returns at
    their ends; blank lines always stay.  A text that loses lines is its other lines,
    joined by newlines; others stay as they are, null too.  Each row is a page, repeated
    rows count as often as they come.  A null host is a host of its own.  An empty table
    gives an empty one.  Columns of the two new names are replaced; others may have any name.
    """
    known = scratch.write(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    held = known.agg(F.sum(F.size("keys") + 8)).first()[0] or 0
    host, keys, kept_lines, all_lines, dropped = fresh(pages.drop("__n_lines", "__n_dropped"), "host", "keys", "kept", "__n_lines", "__n_dropped")
    pages = pages.drop(all_lines, dropped)
    known = known.select(F.col("host").alias(host), F.col("keys").alias(keys))
    if held <= BROADCAST_KEYS:  # else a join whose skewed hosts the adaptive planner splits
        known = F.broadcast(known)
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains(keys, _key(x)) | (F.btrim(x, F.lit(" \t\r")) == ""))
    out = pages.join(known, F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left")
    out = out.withColumn(all_lines, F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn(kept_lines, F.when(F.col(keys).isNotNull() & F.col(text_col).isNotNull(), kept))
    out = out.withColumn(dropped, F.coalesce(F.col(all_lines) - F.size(kept_lines), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(dropped) > 0, F.array_join(kept_lines, "\n")).otherwise(F.col(text_col)))
    return out.select(*[f"`{c}`" for c in pages.columns], all_lines, dropped)


#: The query over documents, a document's source being its host, for DuckDB.
ORACLE = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT rid, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM pages),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT c.source, c.t FROM (SELECT source, t, count(DISTINCT rid) AS n FROM trimmed WHERE t <> '' GROUP BY source, t) c
  JOIN totals ON c.source IS NOT DISTINCT FROM totals.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
marked AS (SELECT l.*, o.t IS NOT NULL AS gone FROM trimmed l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.t = o.t)
SELECT m.doc_id, any_value(m.source) AS source, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked m GROUP BY m.rid, m.doc_id
"""
