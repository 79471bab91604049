"""Quality by nearest-neighbour voting among labelled documents in a latent space.

Terms are the shapes of words (letters and digits in runs of one, marks as they are),
frequent words and two counts of repetition.  Their log counts, weighted by rarity, are
projected on the leading singular directions of a bounded labelled sample.  The sample's
vectors are broadcast; every document is held against all of them, block by block, by
exact cosine products, and its nearest neighbours vote for their labels by similarity.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, map_slices, raw
from weftgraph.llm.toxicity import labelled_sample
from weftgraph.plans.scratch import Scratch

#: Bound of the labelled vectors: documents of each class, and their dimensions.
TRAIN_DOCS, DIMENSIONS = 1500, 48
#: What the two counts of repetition weigh against one term.
EMPHASIS = 4
#: Terms of each kind, and neighbours that vote.
SHAPES, WORDS, NEIGHBOURS, POWER = 400, 600, 15, 8
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))


def terms(data: bytes) -> tuple[Counter, Counter, dict[bytes, int]]:
    """Counts of shapes, of lower-cased words, and of repetition."""
    shaped = data.translate(_SHAPE)
    for c in (b"a", b"A", b"0"):
        for n in (16, 4, 4, 2, 2):
            shaped = shaped.replace(c * n, c)
    low = data.lower().split()
    words = Counter(low)
    again = sum(map(bytes.__eq__, low, low[1:]))
    return Counter(shaped.split()), words, {b"\x01again": again, b"\x01seen": len(low) - len(words)}


class Model:
    def __init__(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, dimensions: int = DIMENSIONS):
        found = [terms(x) for x in texts]
        self.index: dict[tuple[int, bytes], int] = {}
        of = [Counter(), Counter(), Counter()]
        for kinds in found:
            for counter, kind in zip(of, kinds):
                counter.update(kind.keys())
        self.shape, self.word, self.other = ({x: 0 for x, n in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:most] if n > 1} for c, most in zip(of, (SHAPES, WORDS, 9)))
        at = 0
        for part in (self.shape, self.word, self.other):
            for x in part:
                part[x] = at
                at += 1
        self.size = at
        self.labels, self.weights = labels.astype(np.float32), weights.astype(np.float32)
        self.base = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
        self.rarity = np.ones(at, np.float32)
        if not len(labels):
            return
        raw_rows = self.rows(texts, found)
        self.rarity = np.log((1 + len(texts)) / (1 + (raw_rows > 0).sum(0))).astype(np.float32) + 1
        rows = self._unit(raw_rows * self.rarity)
        _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        self.directions = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)
        self.vectors = self._unit(rows @ self.directions)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def rows(self, texts: list[bytes], found=None) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for r, kinds in enumerate(found or map(terms, texts)):
            for part, counts in zip((self.shape, self.word, self.other), kinds):
                for x in part.keys() & counts.keys():
                    out[r, part[x]] = counts[x]
        out = np.log1p(out)
        out[:, self.size - len(self.other) :] *= EMPHASIS
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The share of label 1 in the votes of the nearest; the sample's share of it for
        a text without any known term, or without a sample."""
        if not len(self.labels):
            return np.full(len(texts), self.base)
        latent = self._unit(self._unit(self.rows(texts) * self.rarity) @ self.directions)
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, 1), 0) ** POWER * self.weights[top]
        total = vote.sum(1)
        return np.where(total > 1e-9, (vote * self.labels[top]).sum(1) / np.maximum(total, 1e-9), self.base).astype(float)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, label_col: str = "quality", cap: int = TRAIN_DOCS) -> Model:
    return Model(*labelled_sample(docs, labels, label_col, scratch, cap))


def score(df: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted.  A null or empty
    text has no terms and gets the labelled share."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.clip(model.score(raw(batch, "text")), 0, 1)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return f

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_slices(rows, make, "doc_id long, held_out boolean, score double, predicted int")
