"""Packing documents into sequences: exact complements first, best fit for the rest.

How many pieces of each length there are is all that the plan needs, and lengths are
bounded by the sequence, so the plan is made from one small histogram however many
documents there are.  An index of single, pair and triple length sums says which gaps the
lengths at hand fill exactly.  All gaps that one length fills are filled first, then those
that two fill, then those that three fill, from the longest length down, each combination
as often as the counts allow; of several the one of the most even lengths, as short ones
are scarce and still fit anywhere.  Lengths that no combination completes go, longest
first, to the open sequence with the least room that takes them.  The plan is a list of
intervals: pieces of one length, from this rank to that, go to these sequences at that
offset.  Pieces get their ranks within their length by distributed counting, and look their
interval up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import columns_of, documents, fresh, map_slices, raw
from weftgraph.llm.tokens import encoder
from weftgraph.plans.scratch import Scratch

#: Pieces that one bucket of the rank count holds on average.
BUCKET_ROWS = 20_000


def cut(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its whole text and the end id; a null or empty text is the
    end id alone.  Only longer ones are cut, and only their first piece may be short.
    """

    def make():
        encode, end = encoder(tokenizer), np.uint32(end_id).tobytes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                ids = encode(text.decode()) + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    body = ids[4 * a : 4 * b]
                    out.append((doc, piece, a, b - a, zlib.crc32(body)) + ((np.frombuffer(body, "<u4").astype(np.int32),) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = zip(*out) if out else [[]] * (5 + with_ids)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

        return f

    return map_slices(documents(df, id_col, text_col), make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Sums:
    """Which gaps one, two or three of the lengths at hand fill: an index of their sums.

    pairs[s] is the number of pairs of lengths at hand, a <= b, of sum s; it is kept up to
    date as lengths run out.  Three lengths fill a gap if a length and a pair sum do.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.pairs = left, np.zeros(2 * len(left), np.int64)
        here = np.flatnonzero(left)
        for a in here.tolist():
            self.pairs[a + here[here > a]] += 1
            self.pairs[2 * a] += left[a] > 1

    def take(self, length: int, count: int) -> None:
        """``count`` pieces of a length are gone."""
        before, after = int(self.left[length]), int(self.left[length]) - count
        self.left[length] = after
        if before > 1 >= after:
            self.pairs[2 * length] -= 1
        if before and not after:
            self.pairs[length + np.flatnonzero(self.left)] -= 1

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """The two most even lengths of sum ``gap``."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        both = (self.left[low] > 0) & (self.left[gap - low] > 0)
        both[-1] &= gap % 2 or self.left[gap // 2] > 1
        found = np.flatnonzero(both)  # none, where the index counts the piece that leaves the gap
        return [gap - int(low[found[-1]]), int(low[found[-1]])] if len(found) else None

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths of sum ``gap``, the shortest as long as can be."""
        low = np.flatnonzero(self.left[: gap // 3 + 1])
        for x in low[self.pairs[gap - low] > 0][::-1].tolist():
            self.left[x] -= 1
            two = self.pair(gap - x)
            self.left[x] += 1
            if two and min(two) >= x:
                return [*two, x]
        return None


class Plan:
    """Intervals (length, first rank, count, first sequence, offset) for a histogram."""

    def __init__(self, counts: dict[int, int], capacity: int, most: int = 3):
        """``most``: of how many lengths a complement may be."""
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        #: lengths and times of each combination that was consumed
        self.filled: list[tuple[list[int], int]] = []
        sums = self.sums = Sums(self.left)
        for complement in (lambda gap: None if gap else [], sums.single, sums.pair, sums.triple)[: most + 1]:
            for length in range(capacity, 0, -1):
                while self.left[length]:
                    self.left[length] -= 1  # it is no part of its own complement
                    fill = complement(capacity - length)
                    self.left[length] += 1
                    if fill is None:
                        break
                    need = Counter([length, *fill])
                    times = min(int(self.left[x]) // m for x, m in need.items())
                    self._open([length, *fill], times)
                    self.filled.append(([length, *fill], times))
        self._best_fit()
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        self.key, self.sequence, self.offset = (rows[:, 0] << 44) + rows[:, 1], rows[:, 3], rows[:, 4]
        self.rank = rows[:, 1]

    @classmethod
    def of(cls, counts: dict[int, int], capacity: int) -> Plan:
        """The plan of fewest sequences, of such the one of the longest complements.

        Where nearly all pieces are long, pairs and triples can use up the short ones that
        fill most; on such histograms shorter complements do better.  On tables of documents
        triples have always been as good or better.
        """
        return min((cls(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: p.sequences)

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count
        self.sums.take(length, count)

    def _open(self, lengths: list[int], times: int) -> int:
        """``times`` new sequences, each of these lengths; returns the first one's number."""
        first, at = self.sequences, 0
        for x in lengths:
            self._place(x, times, first, at)
            at += x
        self.sequences += times
        return first

    def _best_fit(self) -> None:
        room: dict[int, list[list[int]]] = {}  # room left -> [first sequence, count] of such
        rooms: list[int] = []

        def add(left: int, first: int, count: int) -> None:
            if left and count:
                if left not in room:
                    room[left] = []
                    insort(rooms, left)
                room[left].append([first, count])

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    left = rooms[at]
                    first, count = room[left][-1]
                    take = min(n, count)
                    self._place(length, take, first, self.capacity - left)
                    if take == count:
                        room[left].pop()
                        if not room[left]:
                            del room[left]
                            rooms.pop(at)
                    else:
                        room[left][-1] = [first + take, count - take]
                    add(left - length, first, take)
                    continue
                each = self.capacity // length
                for times, many in ((n // each, each), (1, n % each)):
                    if times and many:
                        add(self.capacity - many * length, self._open([length] * many, times), times)

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """pieces as of cut() (any columns besides length stay) with sequence_id and offset.

    Every piece gets a place of its own, repeated rows too; an empty table gives none.
    Columns named sequence_id and offset are replaced; others may have any name.
    """
    spark = pieces.sparkSession
    pieces = scratch.write(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as lengths
    sent = spark.sparkContext.broadcast(Plan.of(counts, capacity))
    buckets = max(8, sum(counts.values()) // BUCKET_ROWS + 1)
    bucket, rank, n, length, b, earlier = fresh(pieces, "bucket", "rank", "n", "length", "b", "earlier")
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", bucket).agg(F.count("*").alias(n))
    before = before.select(F.col("length").alias(length), F.col(bucket).alias(b), (F.sum(n).over(Window.partitionBy("length").orderBy(bucket)) - F.col(n)).alias(earlier))
    own = F.row_number().over(Window.partitionBy("length", bucket).orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn(rank, own.cast("long"))
    ranked = ranked.join(before, (F.col("length") == F.col(length)) & (F.col(bucket) == F.col(b)))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(earlier)).select(*columns_of(pieces), rank)
    where = ranked.schema.fieldNames().index("length")

    def make():
        plan = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sequence, offset = plan.look_up(batch.column(where).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

        return f

    return map_slices(ranked, make, pieces.schema.add("sequence_id", "long").add("offset", "long"), at_once=1 << 16)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces that carry their ids; a group is one
    sequence, so its size is bounded by the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
