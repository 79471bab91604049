"""Substring dedup with a log-structured index of window fingerprints.

Documents come in batches of ascending ids.  The index holds the fingerprints of all
windows of earlier batches in sorted immutable runs, cut into buckets of the hash range.
A batch's own fingerprints, sorted too and each once for a chunk of documents, are dealt
to the same buckets and merge-joined with the runs there: a window that a run has starts
earlier in an older document, and of equal windows of the batch only the first does not
repeat.  What is new becomes the next run; runs of one level are merged into one of the
next when there are ``fanout`` of them.  Runs are bucketed tables, so only the batch is
shuffled.

A fingerprint is a 64-bit hash, by which runs are sorted and joined, and 24 bits of a
second one that verify a match.  The two are made of two hashes of each word that have
nothing in common, so words that one takes for the same the other tells apart: at a
thousand billion windows the odds that any two different ones are taken for the same are
still under one in two hundred.  A match is not compared word by word: that would need the
place of each window in the runs, and these are most of what is written.

Runs and texts are packed and compressed here, so the tables' own compression is off: it
would only hold buffers of whole pages outside the heap.  What chunks send to buckets and
get back are pieces that grow in number with the square of the text and become small; then
they are plain records, with no step for each piece.

Chunks of documents travel with their texts, packed, so the words that stay are cut out
where the decisions about a chunk meet, without another look at the table.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import batches_of, documents, lean
from weftgraph.plans.scratch import Scratch

#: Words of a chunk: a mapper sends each different window of a chunk once.
CHUNK_WORDS = 1 << 18
#: Words hashed at a time.
BLOCK_WORDS = 1 << 16
#: Text bytes that one bucket stands for, so that it fits a task.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 48
#: Batches that a table is taken in, and runs of a level before they are merged.
BATCHES, FANOUT = 10, 4
#: Bytes of rows, more or less, that go from Python to Spark at a time.
BATCH_BYTES = 1 << 20
#: Windows that the pieces of a chunk have at least, on average, to be worth packing.
PIECE = 512
NO_ID = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEFT, _RIGHT = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xA0761D6478BD642F))
#: Bytes of a word that are hashed by a table; longer words are hashed whole by XXH3.
LONG = 64
#: Two random numbers for each place and byte: a word's two hashes are sums of them, so
#: there is no structure in words that both, or either, could overlook.
_TABLES = np.random.PCG64(20).random_raw(2 * LONG * 256).reshape(2, LONG * 256)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, and the byte at which it starts."""
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, lengths = edge[::2], np.diff(edge)[::2]
    out = np.zeros((2, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), BLOCK_WORDS):  # eight bytes for each byte of a block
            n = np.minimum(lengths[at : at + BLOCK_WORDS], LONG)
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
            byte = b[place + np.repeat(starts[at : at + BLOCK_WORDS], n)]
            place <<= 8
            place |= byte
            last = first + n - 1
            for k in range(2):
                out[k, at : at + BLOCK_WORDS] = np.diff(np.cumsum(_TABLES[k][place])[last], prepend=np.uint64(0))
        out = _mix(out)
    for i in np.flatnonzero(lengths > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + lengths[i]])
        out[0, i], out[1, i] = whole & (1 << 64) - 1, whole >> 64
    return out[0], out[1], starts


def window_hashes(words: np.ndarray, others: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``size`` consecutive words a 64-bit hash of their first hashes and 24 bits
    of another one of their second."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def fold(out: np.ndarray, m: np.uint64) -> np.ndarray:
        width, step = 1, m  # out[i]: of width words from i
        total, have, power = np.zeros(len(words), np.uint64), 0, np.uint64(1)
        left = size
        while left:
            if left & 1:
                part = out[have : have + n]
                total = total[:n] + part * power
                have += width
                power *= step
            left >>= 1
            if left:
                out = out[:-width] + out[width:] * step
                width, step = 2 * width, step * step
        return total[:n]

    with np.errstate(over="ignore"):
        return _mix(fold(words, _LEFT)), (_mix(fold(others, _RIGHT)) >> np.uint64(40)).astype(np.uint32)


def _tied(h: np.ndarray) -> np.ndarray:
    """Places of a sorted array that hold what a neighbour holds."""
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def _order(h: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by h, then by the others, the last of which counts least; few hashes are
    equal, so only these are sorted by more than h."""
    order = np.argsort(h)
    at = _tied(h[order])
    own = order[at]
    order[at] = own[np.lexsort((*(x[own] for x in reversed(then)), h[own]))]
    return order


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first ascending, by bytes of equal weight."""
    n = len(columns[0])
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    body = b"".join(_planes(x) for x in (first, *columns[1:]))
    return struct.pack("<Q", n) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    body = zstandard.ZstdDecompressor().decompress(data[8:])
    out, at = [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(body[at : at + size], kind, n))
        at += size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


_ROW = "kind int, bucket long, chunk string, data binary, docs binary"
_NAMES = ["kind", "bucket", "chunk", "data", "docs"]
#: What plain records say of themselves: their chunk's least id, and the bytes of an index
#: and of an id less that one.  Nothing packed is as short.
_HEAD = np.dtype([("least", "<i8"), ("index", "u1"), ("id", "u1")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _width(x: np.ndarray) -> int:
    """Bytes that hold each of x, two at least."""
    return max(2, (int(x.max(initial=0)).bit_length() + 7) // 8)


def _narrow(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """One row of bytes for each place of the columns, of the width given with each."""
    return np.concatenate([x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width] for x, width in columns], axis=1)


def _wide(records: np.ndarray, at: int, width: int, kind: str) -> np.ndarray:
    """The column of ``width`` bytes that begins at byte ``at``."""
    out = np.zeros((len(records), np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = records[:, at : at + width]
    return out.view(kind).ravel()


def _cut(records: np.ndarray, cuts: np.ndarray, kind: int, buckets: np.ndarray, chunks: list[str], head: bytes) -> Iterator[pa.RecordBatch]:
    """A row for the records between two cuts each, in batches of about BATCH_BYTES.  There
    are as many rows as chunks times buckets, so nothing is done for one row at a time."""
    at = cuts * records.shape[1]
    turns = np.flatnonzero(np.diff(at[:-1] // BATCH_BYTES, prepend=-1))
    for i, j in zip(turns.tolist(), [*turns[1:].tolist(), len(buckets)]):
        offsets = pa.py_buffer((at[i : j + 1] - at[i]).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, pa.py_buffer(np.ascontiguousarray(records[cuts[i] : cuts[j]]))])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, kind, np.int32)), pa.array(buckets[i:j].astype(np.int64)), pa.array(chunks[i:j], pa.string()), data, pa.array([head] * (j - i), pa.binary())], _NAMES)


def _pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after the other, and where each begins."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    return np.frombuffer(values or b"", np.uint8), at


def _indices(data: pa.Array, heads: pa.Array) -> np.ndarray:
    """The indices in rows of kind 2, each with their width in bytes as its head."""
    values, at = _pieces(data)
    width = np.frombuffer(b"".join(heads.to_pylist()), np.uint8)
    parts = [np.zeros(0, np.uint32)]
    for w in np.unique(width).tolist():
        own = np.concatenate([values[at[k] : at[k + 1]] for k in np.flatnonzero(width == w).tolist()])
        parts.append(_wide(own.reshape(-1, w), 0, w, "<u4"))
    return np.concatenate(parts)


def _chunk_batches(name: str, docs: list[tuple[int, bytes]], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, chunk, data, docs) of a chunk: its texts, its windows that come
    later in it than equal ones, and the others for each bucket."""
    docs.sort(key=lambda d: d[0])
    ids = np.array([d[0] for d in docs], np.int64)
    lengths = np.array([len(d[1]) for d in docs], np.uint64)
    blob = struct.pack("<Q", len(docs)) + zstandard.ZstdCompressor(level=3).compress(ids.tobytes() + lengths.tobytes() + b"".join(d[1] for d in docs))
    yield _batch([(1, 0, name, blob, b"")])
    words, others, at = word_hashes(b"\n".join(d[1] for d in docs))
    begins = np.cumsum(lengths.astype(np.int64) + 1) - lengths.astype(np.int64) - 1
    first_word = np.searchsorted(at, begins)
    doc = np.repeat(np.arange(len(docs)), np.diff(np.append(first_word, len(words))))
    h, check = window_hashes(words, others, size)
    index = np.flatnonzero(doc[: len(h)] == doc[size - 1 : size - 1 + len(h)]).astype(np.uint32)
    h, check = h[index], check[index]
    order = _order(h, check, index)
    h, check, index = h[order], check[order], index[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    if len(later := np.sort(index[~first])):
        width = _width(later)
        yield from _cut(_narrow((later, width)), np.array([0, len(later)]), 2, np.zeros(1, np.int64), [name], bytes([width]))
    h, check, index = h[first], check[first], index[first]
    if not len(h):
        return
    doc = doc[index]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    there, cuts = bucket[cuts], np.append(cuts, len(h))
    if len(h) < PIECE * len(there):
        above = (ids.view(np.uint64) - ids[:1].view(np.uint64))[doc]  # ids ascend
        widths = _width(index), _width(above)
        records = _narrow((h, 8), (check, 3), (index, widths[0]), (above, widths[1]))
        yield from _cut(records, cuts, 0, there, [name] * len(there), np.array([(ids[0], *widths)], _HEAD).tobytes())
        return
    first_word, held, weight = first_word.astype(np.uint32), [], 0
    for b, i, j in zip(there.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        own = np.flatnonzero(np.bincount(doc[i:j]))
        held.append((0, b, name, pack(h[i:j], check[i:j], index[i:j]), pack(first_word[own], ids[own])))
        weight += len(held[-1][3])
        if weight >= BATCH_BYTES:
            yield _batch(held)
            held, weight = [], 0
    if held:
        yield _batch(held)


def _in_run(h: np.ndarray, check: np.ndarray, run_h: np.ndarray, run_check: np.ndarray) -> np.ndarray:
    """Which (h, check) a run sorted by both has."""
    out = np.zeros(len(h), bool)
    at = np.searchsorted(run_h, h)
    open_ = np.flatnonzero(at < len(run_h))
    while len(open_):
        same = run_h[at[open_]] == h[open_]
        hit = same & (run_check[at[open_]] == check[open_])
        out[open_[hit]] = True
        open_ = open_[same & ~hit]
        at[open_] += 1
        open_ = open_[at[open_] < len(run_h)]
    return out


def _merge_bucket(bucket: int, entries: pa.Array, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of the merge join in one bucket: the new run's block, and each chunk's repeats."""
    chunks, heads = (entries.field(x).to_pylist() for x in ("chunk", "docs"))
    names = sorted(chunks)
    rank = {name: i for i, name in enumerate(names)}
    number = np.array([rank[name] for name in chunks])
    plain = np.array([len(x) == _HEAD.itemsize for x in heads])
    parts, entry = [], []
    for e in np.flatnonzero(~plain).tolist():
        parts.append([*unpack(entries.field("data")[e].as_py(), "<u8", "<u4", "<u4"), None])
        parts[-1][3] = np.zeros(len(parts[-1][0]), np.int64)
        entry.append(np.full(len(parts[-1][0]), e))
    head = np.zeros(len(heads), _HEAD)
    head[plain] = np.frombuffer(b"".join(x for x, p in zip(heads, plain) if p), _HEAD)
    values, begin = _pieces(entries.field("data"))
    for wi, wd in set(zip(head["index"][plain].tolist(), head["id"][plain].tolist())):
        own = np.flatnonzero(plain & (head["index"] == wi) & (head["id"] == wd))
        records = np.concatenate([values[begin[e] : begin[e + 1]] for e in own.tolist()]).reshape(-1, 11 + wi + wd)
        parts.append([_wide(records, at, width, to) for at, width, to in ((0, 8, "<u8"), (8, 3, "<u4"), (11, wi, "<u4"), (11 + wi, wd, "<i8"))])
        entry.append(np.repeat(own, (begin[own + 1] - begin[own]) // records.shape[1]))
    h, check, index, ids = (np.concatenate(x) for x in zip(*parts))
    entry = np.concatenate(entry)
    order = np.argsort(h)
    at = _tied(h[order])
    tied = order[at]
    ids = head["least"][entry[tied]] + ids[tied]  # only equal windows need them
    by = np.argsort(entry[tied], kind="stable")
    cuts = np.searchsorted(entry[tied[by]], np.arange(len(heads) + 1))
    for e in np.flatnonzero(~plain & (cuts[1:] > cuts[:-1])).tolist():
        start, own = unpack(heads[e], "<u4", "<i8")
        of = by[cuts[e] : cuts[e + 1]]
        ids[of] = own[np.searchsorted(start, index[tied[of]], "right") - 1]
    order[at] = tied[np.lexsort((index[tied], number[entry[tied]], ids, check[tied], h[tied]))]
    h, check, index, chunk = h[order], check[order], index[order], number[entry[order]]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    new = first.copy()
    at = np.flatnonzero(first)
    for data in runs:
        run_h, run_check = unpack(data, "<u8", "<u4")
        new[at[_in_run(h[at], check[at], run_h, run_check)]] = False
    if new.any():
        block = np.frombuffer(pack(h[new], check[new]), np.uint8)[:, None]
        yield from _cut(block, np.array([0, len(block)]), 0, np.array([bucket]), [""], b"")
    repeated = np.sort(chunk[~new].astype(np.uint64) << np.uint64(32) | index[~new])
    if len(repeated):
        of, index = (repeated >> np.uint64(32)).astype(np.int64), repeated.astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        width = _width(index)
        yield from _cut(_narrow((index, width)), np.append(cuts, len(of)), 2, np.full(len(cuts), bucket), [names[c] for c in of[cuts].tolist()], bytes([width]))


class Index:
    """Sorted immutable runs of fingerprints, in one bucketed table for each level."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, fanout: int = FANOUT):
        self.spark, self.scratch, self.buckets, self.fanout = spark, scratch, buckets, fanout
        self.levels: list[tuple[str, int] | None] = []  # table and number of runs

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append(None)
        name, runs = self.levels[level] or (f"weftgraph_run_{uuid.uuid4().hex}", 0)
        run.select("bucket", "data").write.bucketBy(self.buckets, "bucket").sortBy("bucket").mode("append").option("compression", "none").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        self.levels[level] = name, runs + 1

    def _drop(self, level: int) -> None:
        name, _ = self.levels[level]
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.delete(f"{self.scratch.root}/{name}")
        self.levels[level] = None

    def append(self, run: DataFrame) -> None:
        """Adds a run; then merges each level that has ``fanout`` runs into one of the next."""
        self._put(0, run)
        for level in range(len(self.levels)):
            if not self.levels[level] or self.levels[level][1] < self.fanout:
                break

            def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for bucket, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        parts = [unpack(x, "<u8", "<u4") for x in runs]
                        h, check = (np.concatenate([p[i] for p in parts]) for i in range(2))
                        order = _order(h, check)
                        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([pack(h[order], check[order])], pa.binary())], ["bucket", "data"])

            whole = self.spark.table(self.levels[level][0]).groupBy("bucket").agg(F.collect_list("data").alias("runs"))
            self._put(level + 1, whole.mapInArrow(lean(merge), "bucket long, data binary"))
            self._drop(level)

    def merge_join(self, entries: DataFrame) -> DataFrame:
        """entries(bucket, chunk, data, docs) against all runs: rows of kind 0, the blocks
        of the run to append, and of kind 2, windows of chunks that repeat earlier ones."""
        rows = entries.groupBy("bucket").agg(F.collect_list(F.struct("chunk", "data", "docs")).alias("entries"))
        runs = F.array().cast("array<binary>")
        for name, _ in filter(None, self.levels):
            level = self.spark.table(name).groupBy("bucket").agg(F.collect_list("data").alias(name))
            rows = rows.join(level, "bucket", "left")
            runs = F.concat(runs, F.coalesce(F.col(name), F.array().cast("array<binary>")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield from _merge_bucket(b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].as_py())

        return rows.select("bucket", "entries", runs.alias("runs")).mapInArrow(lean(run), _ROW)

    def drop(self) -> None:
        for level in range(len(self.levels)):
            if self.levels[level]:
                self._drop(level)


def _rows_of(docs: DataFrame, size: int, buckets: int, chunk_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for b in batches:
            kind = pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(kind)):
                data = text.as_py() or b""
                held.append((NO_ID if doc is None else doc, data))
                weight += len(data)
                if weight >= 6 * chunk_words:  # a word takes six bytes, more or less
                    yield from _chunk_batches(uuid.uuid4().hex, held, size, buckets)
                    held, weight = [], 0
        if held:
            yield from _chunk_batches(uuid.uuid4().hex, held, size, buckets)

    return docs.mapInArrow(lean(run), _ROW)


def _cut_out(texts: DataFrame, repeats: DataFrame, size: int) -> DataFrame:
    """Chunks of texts and their repeated windows -> (doc_id, text, n_words, n_removed)."""
    found = repeats.groupBy("chunk").agg(F.collect_list(F.struct("data", "docs")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, windows = b.column(0)[i].as_py(), b.column(1)[i].values
                (n,) = struct.unpack_from("<Q", data)
                body = zstandard.ZstdDecompressor().decompress(data[8:])
                ids, lengths = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<u8", n, 8 * n)
                starts = np.zeros(0, np.int64) if windows is None else _indices(windows.field("data"), windows.field("docs")).astype(np.int64)
                at, word, out = 16 * n, 0, []
                steps = np.zeros(int(starts.max(initial=-1)) + size + 1, np.int32)
                steps[starts] += 1  # each window is in one row alone
                steps[starts + size] -= 1
                gone = np.cumsum(steps) > 0
                for doc, length in zip(ids.tolist(), lengths.tolist()):
                    words = body[at : at + length].split()
                    cut = gone[word : word + len(words)]
                    removed = int(cut.sum())
                    if removed:
                        keep = np.ones(len(words), bool)
                        keep[: len(cut)] = ~cut
                        kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                    else:
                        kept = b" ".join(words)
                    out.append((None if doc == NO_ID else doc, kept.decode(), len(words), removed))
                    at, word = at + length, word + len(words)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _OUT.types)], _OUT.names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _OUT.types)], _OUT.names)

    return texts.join(found, "chunk", "left").select("data", "windows").mapInArrow(lean(run), "doc_id long, text string, n_words long, n_removed long")


_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def dedup(df: DataFrame, scratch: Scratch, size: int = 20, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, fanout: int = FANOUT, index: Index | None = None) -> DataFrame:
    """One row for each row of df: (doc_id, text, n_words, n_removed).

    A window is ``size`` consecutive words of one document.  Words under a window that also
    starts earlier (in a smaller id, or before in the document) are removed; text is the
    other words, a blank between them.  Windows are judged on the input.  Null and empty
    texts have no words.  Documents without an id come first.  Rows that share an id are
    documents of their own, in a fixed order; of rows alike one is the first.

    With ``index`` the windows of earlier calls count as earlier too, and this call's are
    added to it, so ids must ascend from call to call: a window of a later call that an
    earlier one has is a repeat whatever its id.
    """
    spark, docs = df.sparkSession, documents(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = index or Index(spark, scratch, max(LEAST_BUCKETS, total // BUCKET_BYTES), fanout)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    texts, repeats = [], []

    def kind(paths: list[str], k: int) -> DataFrame:
        paths = [f"{p}/kind={k}" for p in paths]
        there = [p for p in paths if scratch.exists(p)]
        schema = _ROW.removeprefix("kind int, ")
        return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)

    for i in range(len(bounds) + 1):
        part = docs
        if i:
            part = part.where(F.col("doc_id") >= bounds[i - 1])
        if i < len(bounds):
            part = part.where((F.col("doc_id") < bounds[i]) | (F.col("doc_id").isNull() if i == 0 else F.lit(False)))
        chunked, joined = scratch.path("chunks"), scratch.path("joined")
        with batches_of(spark, 1000, "4m"):
            _rows_of(part, size, own.buckets, chunk_words).write.partitionBy("kind").parquet(chunked, compression="none")
            own.merge_join(kind([chunked], 0)).write.partitionBy("kind").parquet(joined, compression="none")
            scratch.delete(f"{chunked}/kind=0")
            own.append(kind([joined], 0))
        scratch.delete(f"{joined}/kind=0")
        scratch.release()
        texts.append(chunked)
        repeats += [chunked, joined]
    if index is None:
        own.drop()
    return _cut_out(kind(texts, 1).select("chunk", "data"), kind(repeats, 2).select("chunk", "data", "docs"), size)
