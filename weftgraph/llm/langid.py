"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with counts frozen after training.
A byte that its longest known context has seen costs -log2(count / (total + distinct));
another pays the escape -log2(distinct / (total + distinct)) and is tried in the context
one byte shorter, down to the uniform 8 bits.  With frozen counts a byte's cost depends on
the bytes before it only through its context, so the trees are unrolled into one table of
costs for each language, and the exact code length of a text is a sum of table entries.
The language with the shortest code wins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, map_slices, raw

#: Bound of the fitting sample: documents and text bytes of each language.
TRAIN_DOCS, TRAIN_BYTES = 400, 2 << 20
#: Longest context in bytes, and the largest unrolled table that a worker may have to hold;
#: a sample that needs a larger one is an error, never a lower order.
ORDER, TABLE_BYTES = 3, 512 << 20
#: Bytes scored at a time.
CHUNK = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(data: bytes) -> bool:
    if _ASCII_LETTER.search(data):
        return True
    return not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace"))


class Trees:
    """The frozen statistics of all languages, unrolled.

    Symbol 0 stands before a text begins and for bytes that no sample has; symbols from 1
    are the bytes of the samples.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES):
        self.langs = sorted(samples)
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for x in texts:
                seen[np.frombuffer(x, np.uint8)] = True
        self.symbol = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
        a = self.size = int(seen.sum()) + 1
        self.order = order
        counts = [[self._counts(samples[g], k) for g in self.langs] for k in range(order + 1)]
        if (needed := self._bytes(counts, order)) > table_bytes:
            raise ValueError(f"the trees of {len(self.langs)} languages take {needed} bytes unrolled, over {table_bytes}; fit with a lower order")
        n = len(self.langs)
        cost = np.full((1, a, n), 8.0, np.float32)
        for k in range(self.order):  # shorter contexts: a row for each that could be
            rows = np.arange(a**k)
            cost = self._extend(cost, rows, cost_row=rows % a ** (k - 1) if k else rows * 0, counts=counts[k])
        k = self.order
        full = np.unique(np.concatenate([c[0] // a for c in counts[k]] or [np.zeros(0, np.int64)]))
        suffix = full % a ** (k - 1)
        self.row = (np.arange(a**k) % a ** (k - 1)).astype(np.int32)
        self.row[full] = len(cost) + np.arange(len(full))
        longest = self._extend(cost, full, suffix, counts[k])
        self.cost = np.concatenate((cost, longest)).reshape(-1, n) if n else np.zeros((0, 0), np.float32)

    def _bytes(self, counts, k: int) -> int:
        a, n = self.size, max(1, len(self.langs))
        full = len(np.unique(np.concatenate([c[0] // a for c in counts[k]]))) if counts[k] else 0
        return (a ** (k - 1) + full) * a * n * 4 + a**k * 4

    def _counts(self, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (context of k symbols, symbol), and how often each occurs."""
        parts = []
        for x in texts:
            s = np.concatenate((np.zeros(k, np.int64), self.symbol[np.frombuffer(x, np.uint8)]))
            code = np.zeros(len(s) - k, np.int64)
            for j in range(k + 1):
                code = code * self.size + s[j : len(s) - k + j]
            parts.append(np.unique(code, return_counts=True))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

    def _extend(self, shorter, rows, cost_row, counts):
        """Costs in the contexts ``rows`` (sorted codes) from those one symbol shorter."""
        a = self.size
        out = shorter[cost_row]
        for g, (codes, n) in enumerate(counts):
            context = np.searchsorted(rows, codes // a)
            total, distinct = (np.bincount(context, w, minlength=len(rows)) for w in (n, None))
            known = distinct > 0
            out[known, :, g] -= np.log2(distinct[known] / (total[known] + distinct[known]))[:, None].astype(np.float32)
            out[context, codes % a, g] = -np.log2(n / (total[context] + distinct[context]))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size = [], 0
        for i, x in enumerate(texts):
            group.append(i)
            size += len(x)
            if size >= CHUNK or i == len(texts) - 1:
                self._score([texts[j] for j in group], out, group)
                group, size = [], 0
        return out

    def _score(self, texts: list[bytes], out: np.ndarray, rows: list[int]) -> None:
        k, a, gap = self.order, self.size, b"\0" * self.order
        s = self.symbol[np.frombuffer(gap + gap.join(texts), np.uint8)]
        lengths = np.array([len(x) for x in texts])
        starts = np.cumsum(lengths + k) - lengths
        for i, n in enumerate(lengths.tolist()):
            s[starts[i] - k : starts[i]] = 0
        for at in range(0, len(s) - k, CHUNK):
            end = min(at + CHUNK, len(s) - k)
            context = s[at:end].copy()
            for j in range(1, k):
                context *= a
                context += s[at + j : end + j]
            cost = self.cost[self.row[context] * np.int64(a) + s[at + k : end + k]]
            first, last = np.clip(starts - k - at, 0, end - at), np.clip(starts + lengths - k - at, 0, end - at)
            here = np.flatnonzero(last > first)
            cuts = np.stack((first[here], last[here]), 1).ravel()
            sums = np.add.reduceat(np.concatenate((cost, np.zeros((1, cost.shape[1]), cost.dtype))), cuts, axis=0, dtype=np.float64)[::2] if len(here) else ()
            for r, x in zip(here.tolist(), sums):
                out[rows[r]] += x

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of the shortest code and its posterior under equal priors;
        ``und`` and 0 for texts without a letter, or if no language was learned."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """What predict says, and the bits a byte of the shortest code (0 if there is none)."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        lettered = [has_letter(x) for x in texts]
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], [float(p) if ok else 0.0 for p, ok in zip(share, lettered)], [float(x) / max(1, len(t)) for x, t in zip(bits.min(axis=1), texts)]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES, order: int = ORDER) -> Trees:
    """Fits on a bounded sample: of each language up to ``docs`` whole documents that are
    not held out, in the order of an id hash, until ``max_bytes`` of text are reached.
    Rows without language or text are not used.  It is an error if trees of this order
    take more than TABLE_BYTES."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(~held_out("doc_id") & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, list[bytes]] = {g: [] for g in sizes}
    if sizes:
        share = F.lit(0)
        for g, n in sizes.items():
            share = F.when(F.col("lang") == g, F.lit(min(1 << 20, -(-(docs << 20) * 3 // (2 * n))))).otherwise(share)
        key = F.xxhash64("doc_id")
        drawn = rows.where(F.col("text").isNotNull() & (F.pmod(key, F.lit(1 << 20)) < share)).select("lang", F.pmod(key, F.lit(1 << 20)).alias("at"), "doc_id", "text")
        used = dict.fromkeys(sizes, 0)
        for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["at"], r["doc_id"] or 0)):
            g, data = r["lang"], r["text"].encode()
            if len(samples[g]) < docs and used[g] < max_bytes:
                samples[g].append(data)
                used[g] += len(data)
    return Trees({g: x for g, x in samples.items() if x}, order)


def identify(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: (doc_id, held_out, lang_pred, score).

    score is the winner's posterior, 0 to 1.  A null or empty text and a text without any
    letter is ``und`` with score 0; equal code lengths go to the language first in order.
    """
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = model.predict(raw(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return f

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_slices(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, trees: Trees, min_score: float = 0.5, text_col: str = "text", lang_col: str | None = None, max_bits: float | None = None) -> DataFrame:
    """The rows of df whose language is found with at least ``min_score``, as they were;
    with ``lang_col`` that column becomes the language found.

    Rejected are texts without a letter (null and empty ones too) and those no language
    of which is likelier than the others together; with ``max_bits`` also those whose
    shortest code has so many bits a byte or more.  Without a language learned all go.
    """
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores, rates = model.judge(raw(batch, text_col))
            if lang_col:
                at = batch.schema.get_field_index(lang_col)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type))
            return batch.filter(pa.array([g != "und" and s >= min_score and (max_bits is None or b < max_bits) for g, s, b in zip(langs, scores, rates)], pa.bool_()))

        return f

    return map_slices(df, make, df.schema)
