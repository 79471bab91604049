"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the votes of all documents estimates, for each rule, how
often it votes each way on good and on bad documents, and how many documents are good;
the posterior that these give a document's votes takes the place of "all rules must pass".
Votes are counted by pattern before anything leaves the executors: there are at most
3 ** len(RULES) patterns, however many documents there are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import documents, map_slices, raw
from weftgraph.plans.scratch import Scratch

_SYMBOLS = b"#*$%&|<>"
_ENDS = (b".", b"!", b"?", b'"', b":")
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_lower", "n_exclaims", "n_distinct", "n_again", "n_plain", "n_marks"]
#: A plain word: letters, then at most one mark of punctuation.
_PLAIN = re.compile(rb"(?<![^ \t-\r])[A-Za-z\x80-\xff]+[.,;:?!]?(?![^ \t-\r])")


def measure(data: bytes) -> tuple[int, ...]:
    """The FEATURES of a text in UTF-8."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(FEATURES)
    text_chars = len(data.decode("utf-8", "replace"))
    word_chars = text_chars - (len(data) - sum(map(len, words)))
    seen: set[bytes] = set()
    lines = dup = ended = 0
    for line in data.split(b"\n"):
        if body := line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
            ended += body.endswith(_ENDS)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = 0
    if n > 3:
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        inside = np.zeros(n, bool)
        for j in range(3):
            inside[j : n - 2 + j] |= again
        repeat = int(inside.sum())
    letters = np.bincount(np.frombuffer(data, np.uint8), minlength=128)
    return (n, word_chars, sum(data.count(c) for c in _SYMBOLS), dup, repeat, lines, ended, int(letters[65:91].sum()), int(letters[97:123].sum()), data.count(b"!"), len(number), int((ids[1:] == ids[:-1]).sum()), len(_PLAIN.findall(data)), int(letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()))


def _vote(share: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _below(part: str, whole: str, good: float, bad: float) -> Column:
    x = _share(part, whole)
    return _vote(x, x <= good, x >= bad)


def _above(part: str, whole: str, good: float, bad: float, least: int = 1) -> Column:
    x = _share(part, whole)
    return F.when(F.col(whole) < least, 0).otherwise(_vote(x, x >= good, x <= bad))


def rules() -> dict[str, Column]:
    """The rules as votes over the columns of FEATURES."""
    length = _share("word_chars", "n_words")
    return {
        "word_length": _vote(length, length.between(3, 10), (length < 2) | (length > 14)),
        "symbols_to_words": _below("n_symbols", "n_words", 0.05, 0.25),
        "symbols_to_characters": _below("n_symbols", "word_chars", 0.01, 0.05),
        "marks": _below("n_marks", "word_chars", 0.08, 0.15),
        "plain_words": _above("n_plain", "n_words", 0.85, 0.65),
        "repeated_trigrams": _below("n_repeat_words", "n_words", 0.15, 0.4),
        "repeated_lines": F.when(F.col("n_lines") < 3, 0).otherwise(_below("n_dup_lines", "n_lines", 0.1, 0.3)),
        "stuttering": _below("n_again", "n_words", 0.05, 0.2),
        "distinct_words": _above("n_distinct", "n_words", 0.3, 0.1, least=50),
        "capitals": _below("n_upper", "n_lower", 0.2, 0.8),
        "exclaims": _below("n_exclaims", "n_words", 0.05, 0.25),
        "ended_lines": _above("n_ended_lines", "n_lines", 0.6, 0.1, least=2),
    }


RULES = list(range(12))  # as many as rules() has; checked where votes are made


class Accuracies:
    """Each rule's accuracy on good and on bad documents by EM over counted vote patterns.

    An abstention says nothing, so only cast votes count.  Rules are taken to be better
    than chance: a prior worth the share ``trust`` of the documents says that a rule calls
    few good documents bad (BAD_ON_GOOD), and half of the bad ones.
    """

    BAD_ON_GOOD, BAD_ON_BAD = 0.02, 0.5

    def __init__(self, votes: np.ndarray, counts: np.ndarray, trust: float = 0.01, rounds: int = 200, tolerance: float = 1e-9):
        """votes: patterns x rules in {-1, 0, 1}; counts: documents of each pattern."""
        self.n_rules = votes.shape[1]
        hot = np.stack([votes == v for v in (-1, 1)], 2).astype(float)  # pattern, rule, vote
        total = counts.sum()
        # a document starts good by its share of good votes
        good = (1 + (votes == 1).sum(1)) / (2 + (votes == 1).sum(1) + 4 * (votes == -1).sum(1))
        self.log = np.zeros((2, self.n_rules, 2))
        self.prior, before = 0.5, -np.inf
        for _ in range(rounds):
            for y, (share, bad) in enumerate(((1 - good, self.BAD_ON_BAD), (good, self.BAD_ON_GOOD))):
                seen = np.einsum("p,prv->rv", share * counts, hot) + np.array([bad, 1 - bad]) * max(1.0, trust * total)
                self.log[y] = np.log(seen / seen.sum(1, keepdims=True))
            self.prior = float(np.clip((good * counts).sum() / max(total, 1), 1e-3, 1 - 1e-3))
            both = np.stack([np.einsum("prv,rv->p", hot, self.log[y]) + np.log(p) for y, p in ((0, 1 - self.prior), (1, self.prior))])
            whole = np.logaddexp(both[0], both[1])
            good = np.exp(both[1] - whole)
            now = float((whole * counts).sum())
            if now - before < tolerance * max(1.0, abs(now)):
                break
            before = now
        self.posterior = good

    def accuracy(self) -> list[tuple[float, float]]:
        """For each rule, how often a vote of it is right on bad and on good documents."""
        p = np.exp(self.log)
        return [(float(p[0, r, 0]), float(p[1, r, 1])) for r in range(self.n_rules)]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([measure(x) for x in raw(batch, "text")], np.int64).reshape(-1, len(FEATURES))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *FEATURES])

        return f

    return map_slices(documents(df, id_col, text_col), make, "doc_id long, " + ", ".join(f"{x} long" for x in FEATURES))


def judge(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """One row for each row of df: doc_id, the FEATURES, base_failed, posterior, kept.

    A text of fewer than ``min_words`` words, or more than half of whose words stand in
    repeated three-word windows, fails the base and is not kept; null and empty texts are
    such.  Other texts are kept from ``threshold`` of posterior quality on.  The rules'
    accuracies come from the votes of all documents that pass the base.
    """
    names = list(rules())
    if len(names) != len(RULES):
        raise ValueError("RULES and rules() differ")
    code = sum(((v + 1) * 3**i for i, v in enumerate(rules().values())), F.lit(0))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    made = scratch.write(features(df, id_col, text_col).withColumn("base_failed", failed).withColumn("__votes", code.cast("long")), "features")
    seen = made.groupBy("__votes", "base_failed").agg(F.count("*").alias("n")).collect()  # at most 2 * 3 ** rules rows
    codes = sorted({r["__votes"] for r in seen})
    counts = dict.fromkeys(codes, 0)
    for r in seen:
        counts[r["__votes"]] += 0 if r["base_failed"] else r["n"]
    votes = np.array([[c // 3**i % 3 - 1 for i in range(len(names))] for c in codes], np.int64).reshape(-1, len(names))
    found = Accuracies(votes, np.array([counts[c] for c in codes], float))
    table = df.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, found.posterior)], "__votes long, posterior double")
    out = made.join(F.broadcast(table), "__votes")  # as many rows as patterns
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select("doc_id", *FEATURES, "base_failed", "posterior", "kept")
