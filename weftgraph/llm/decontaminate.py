"""Benchmark decontamination by winnowing.

The benchmark is read in blocks of bounded size; a block's index goes to the workers and
every whole document is held against it, block after block, so no block is ever larger
than its bound however large the benchmark is, and documents are never shuffled.

Words that a block does not have cannot be in a shared span, so a document is a row of
word numbers with gaps.  From every ``window - k + 1`` consecutive k-grams the one of
the smallest hash is kept, on both sides: any shared span of ``window`` words has the same
kept k-gram on both sides.  Each shared fingerprint is compared word by word and extended
both ways as far as document and item agree; spans of at least a window are hits.  Items
shorter than a window are windows of their own length, looked up by the hash of all their
words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, map_slices, raw

#: Text bytes of the benchmark that one block holds at most, but for a single larger item.
BLOCK_BYTES = 16 << 20
#: Bytes that no word has: all of ASCII but digits and letters.
_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of digits, a-z and characters past ASCII."""
    return data.translate(_TO_SPACE).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word numbers."""
    n = max(len(ids) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = _mix(h * _MULTIPLIER + ids[j : j + n].astype(np.uint64))
    return h


def _winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of every w consecutive hashes the smallest, the last of equals."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(view)) + (w - 1 - view[:, ::-1].argmin(axis=1)))


class Index:
    """Winnowed fingerprints of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = 10, k: int = 5):
        self.window, self.k, self.w = window, k, window - k + 1
        self.number: dict[bytes, int] = {}
        same: dict[tuple, list[int]] = defaultdict(list)  # items of the same words are one
        for item, data in items:
            if words := words_of(data):
                same[tuple(self.number.setdefault(x, len(self.number) + 1) for x in words)].append(item)
        self.words = [list(x) for x in same]
        self.names = list(same.values())
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, int]] = defaultdict(dict)
        for i, words in enumerate(self.words):
            ids = np.array(words, np.int64)
            if len(ids) < window:
                self.short[len(ids)][int(_grams(ids, len(ids))[0])] = i
                continue
            h = _grams(ids, k)
            for p in _winnow(h, self.w).tolist():
                self.grams[int(h[p])].append((i, p))
        self.keys = np.sort(np.fromiter(self.grams, np.uint64, len(self.grams)))

    def _in(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) inside windows of items, and the items (by number)."""
        spans, found = [], set()
        known = np.fromiter((self.number.get(x, 0) for x in words), np.int64, len(words))
        gaps = np.flatnonzero(known == 0)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(words)]))
        least = min([self.window, *self.short])
        for a, b in zip(starts.tolist(), ends.tolist()) if len(gaps) < len(words) else ():
            if b - a < least:
                continue
            ids = known[a:b]
            for size, keys in self.short.items():
                for p, h in enumerate(_grams(ids, size).tolist()):
                    if (i := keys.get(h)) is not None and ids[p : p + size].tolist() == self.words[i]:
                        spans.append((a + p, a + p + size))
                        found.add(i)
            if b - a < self.window:
                continue
            h = _grams(ids, self.k)
            kept = _winnow(h, self.w)
            kept = kept[self._in(h[kept])]
            if not len(kept):
                continue
            text, reached = ids.tolist(), {}
            for p in kept.tolist():
                for i, q in self.grams[int(h[p])]:
                    if reached.get((i, p - q), 0) > p:
                        continue
                    item = self.words[i]
                    x, y = p, q
                    while x and y and text[x - 1] == item[y - 1]:
                        x, y = x - 1, y - 1
                    end, y = p, q
                    while end < len(text) and y < len(item) and text[end] == item[y]:
                        end, y = end + 1, y + 1
                    reached[i, p - q] = max(end, p + 1)
                    if end - x >= self.window:
                        spans.append((a + x, a + end))
                        found.add(i)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of bounded size, one after the other."""
    items = documents(benchmark, item_col, text_col).select(F.col("doc_id").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total * 5 // (4 * block_bytes)) or 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for b in range(count):
        yield [(x["item"], x["text"].encode()) for x in items.where(block == b).toLocalIterator()]


def _sent(spark: SparkSession, blocks):
    """Each block as a broadcast, and whether it is the last one."""
    sent = None
    for items in blocks:
        if sent is not None:
            yield sent, False
        sent = spark.sparkContext.broadcast(items)
    yield sent, True


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: (doc_id, n_words, spans, items).

    spans: array of (start, end) word ranges inside occurrences of benchmark windows,
    apart from each other and in order; items: ids of the items with such windows, in
    order, each once.  Null or empty texts have no words; a null or empty item has no
    window; an item without an id marks words but is not listed.  An empty benchmark
    gives no spans.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    out = documents(df, id_col, text_col).withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<struct<start:long,end:long>>")).withColumn("items", F.array().cast("array<long>"))
    for sent, last in _sent(df.sparkSession, blocks_of(benchmark, item_col, item_text_col, block_bytes)):

        def make(sent=sent, last=last):
            index = Index(sent.value, window, k)

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, all_spans, all_items = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for r, text in enumerate(raw(batch, "text")):
                    words = words_of(text)
                    counts.append(len(words))
                    spans, found = index.hits(words)
                    if spans:
                        before = [(x["start"], x["end"]) for x in all_spans[r]]
                        all_spans[r] = [{"start": a, "end": b} for a, b in merged(before + spans)]
                        all_items[r] = sorted({*all_items[r], *(x for i in found for x in index.names[i] if x is not None)})
                new = [pa.array(counts, pa.int64()), pa.array(all_spans, batch.schema.field(3).type), pa.array(all_items, batch.schema.field(4).type)]
                own = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
                return pa.RecordBatch.from_arrays(own + new, ["doc_id", "text"][: len(own)] + ["n_words", "spans", "items"])

            return f

        out = map_slices(out, make, out.drop("text").schema if last else out.schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df without a benchmark window, columns as they were; no shuffle.

    Rows of null or empty texts stay.
    """
    for sent, _ in _sent(df.sparkSession, blocks_of(benchmark, item_col, item_text_col, block_bytes)):

        def make(sent=sent):
            index = Index(sent.value, window, k)
            return lambda batch: batch.filter(pa.array([not index.hits(words_of(x))[0] for x in raw(batch, text_col)], pa.bool_()))

        df = map_slices(df, make, df.schema)
    return df
