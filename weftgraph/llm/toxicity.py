"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's logit is a bias and the weights of its
words; a document is toxic unless none of its sentences is (noisy-or), and only documents
have labels.  The weights are fitted to these by gradient descent, so the model learns
which sentences make a document toxic and can point at them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_sample, held_out, map_slices, raw
from weftgraph.plans.scratch import Scratch

#: Bound of the fitting sample: labelled documents of each class.
TRAIN_DOCS = 3000
#: Word beginnings, in bytes, that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers the weight of.
CACHE_WORDS = 300_000
#: Sentences end at . ! ? and newline; words are digits, letters and what is past ASCII.
_TABLE = bytes(10 if c in b".!?\n" else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def sentences(data: bytes) -> list[list[bytes]]:
    return [words for part in data.translate(_TABLE).split(b"\n") if (words := part.split())]


def features(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class _Weights(dict):
    """word -> the sum of its features' weights, remembered up to a bound."""

    def __init__(self, of: dict[bytes, float]):
        self.of = of

    def __missing__(self, word: bytes) -> float:
        get = self.of.get
        out = sum(get(x, 0.0) for x in features(word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


class Model:
    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """text -> (score of the document, scores of its sentences)."""
        of = _Weights(self.weights).__getitem__
        bias, rest = self.bias, float(1 / (1 + np.exp(-self.bias)))

        def score(data: bytes) -> tuple[float, list[float]]:
            parts = [rest if not (z := sum(map(of, words))) else 1 / (1 + np.exp(-min(40.0, max(-40.0, bias + z)))) for words in sentences(data)] or [rest]
            return float(-np.expm1(np.log1p(-np.minimum(parts, 1 - 1e-12)).sum())), parts

        return score


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, least_docs: int = 4, least_z: float = 5.0, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fits on documents with 0/1 labels; ``weights`` say how many documents of the whole
    table each stands for.  Only features whose share among toxic documents differs from
    that among others by ``least_z`` standard errors get a weight."""
    one: dict[bytes, bytes] = {}  # words that come again are one object
    bags = [[[one.setdefault(w, w) for w in s] for s in sentences(x)] for x in texts]
    counts = [Counter(), Counter()]
    for y, bag in zip(labels, bags):
        counts[int(y)].update({f for w in {w for s in bag for w in s} for f in features(w)})
    n = [max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))]
    chosen: dict[bytes, int] = {}
    often = {f for own, other in (counts, counts[::-1]) for f, times in own.items() if times + other.get(f, 0) >= least_docs}
    for f in sorted(often):
        a, b = counts[0][f], counts[1][f]
        p = (a + b + 1) / (n[0] + n[1] + 2)
        if abs(b / n[1] - a / n[0]) >= least_z * np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])):
            chosen[f] = len(chosen)
    del counts, one  # of a million words; the features chosen are few
    cache: dict[bytes, list[int]] = {}

    def found(word: bytes) -> list[int]:
        if word not in cache:
            cache[word] = [chosen[f] for f in features(word) if f in chosen]
        return cache[word]

    rows, cols, doc_of, plain = [], [], [], np.zeros(len(texts))
    for d, bag in enumerate(bags):
        for s in bag or [[]]:
            if hits := [i for w in s for i in found(w)]:
                rows += [len(doc_of)] * len(hits)
                cols += hits
                doc_of.append(d)
            else:
                plain[d] += 1  # sentences that have nothing but the bias
    rows, cols, doc_of = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc_of, np.int64)
    w, y, share = np.zeros(len(chosen) + 1), labels == 1, weights / max(weights.sum(), 1e-9)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], minlength=len(doc_of)) + w[-1]
        p, rest = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-np.clip(w[-1], -40, 40)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)) + plain * np.log1p(-rest)
        q = np.exp(np.minimum(none, -1e-12))  # no sentence is toxic
        pull = share * np.where(y, -q / (1 - q), 1.0)
        g_sentence = pull[doc_of] * p
        g = np.concatenate((np.bincount(cols, g_sentence[rows], minlength=len(chosen)) + decay * w[:-1], [g_sentence.sum() + (pull * plain * rest).sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in chosen.items() if abs(w[i]) > 1e-3}, float(w[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, scratch: Scratch, cap: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of up to ``cap`` labelled rows of each class that are not
    held out, those of the smallest id hash; weights restore the classes' shares.  Rows of
    a null or other label, or without an id, are not used; of several labels of one id the
    largest counts."""
    own = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    own = scratch.write(own.groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(own.where("y = 0"), "doc_id", cap).unionAll(bounded_sample(own.where("y = 1"), "doc_id", cap))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = sorted(text.join(F.broadcast(chosen), "doc_id").collect(), key=lambda r: (r["doc_id"], r["text"] or ""))  # cap rows a class
    y = np.array([r["y"] for r in rows], np.int64)
    held = np.bincount(y, minlength=2)
    weights = np.array([sizes[c] / held[c] for c in y.tolist()], float)
    return [(r["text"] or "").encode() for r in rows], y, weights


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, label_col: str = "toxic", cap: int = TRAIN_DOCS) -> Model:
    texts, y, weights = labelled_sample(docs, labels, label_col, scratch, cap)
    return train(texts, y, weights)


def score(df: DataFrame, model: Model, threshold: float = 0.7, sentence_threshold: float = 0.5, locate: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted and, with ``locate``,
    offending: array of (sentence number, its score), for sentences from
    ``sentence_threshold`` on.  A null or empty text counts as one empty sentence."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        of = sent.value.scorer()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [of(x) for x in raw(batch, "text")]
            scores = np.array([s for s, _ in found], float)
            out = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            if locate:
                kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))
                out.append(pa.array([[{"sentence": i, "score": float(p)} for i, p in enumerate(parts) if p >= sentence_threshold] for _, parts in found], kind))
            return pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted", "offending"][: len(out)])

        return f

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_slices(rows, make, "doc_id long, held_out boolean, score double, predicted int" + ", offending array<struct<sentence:int,score:double>>" * locate)
