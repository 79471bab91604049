"""Token ids in binary shards: a shared zstandard dictionary, one frame a document.

A store is a folder of two tables.  ``dictionary`` has one row: the dictionary that was
trained on the serialized ids of a bounded sample, and its hash.  ``shards`` has one row a
shard, in document order; its ``data`` is a whole binary file:

    magic "WGTOK1\\0\\0" | u32 bytes an id | u32 documents | 32 bytes SHA-256 of the dictionary
    one zstandard frame a document, made with the dictionary
    index: documents x (i64 id, u64 offset of the frame, u64 ids in it); i64 minimum: no id
    u64 offset of the index

so that any one document of a shard is read by its index entry and its frame alone.  Ids
are little-endian, 2 bytes each where the vocabulary allows, else 4.  Spark's writers put
both tables where every executor and any store can be reached; ``export`` makes plain
files of them for readers without Spark.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import batches_of, documents, lean, map_slices, raw
from weftgraph.llm.tokens import encoder
from weftgraph.plans.scratch import Scratch

MAGIC = b"WGTOK1\0\0"
HEAD = struct.Struct("<8sII32s")
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
#: Bound of the sample that the dictionary is trained on, and the dictionary's size.
TRAIN_DOCS, TRAIN_IDS, DICTIONARY_BYTES = 1000, 1 << 21, 64 << 10
#: Text bytes that the sample takes at most; it goes to the driver.
TRAIN_BYTES = 16 << 20
#: A shard is closed when its frames reach so many bytes, and a task writes about so many.
#: Larger ones would be arrays that a JVM with a small heap keeps apart from all others.
SHARD_BYTES, PART_SHARDS = 448 << 10, 32
#: Up to so many shards their places are broadcast.
BROADCAST_SHARDS = 500_000
NO_ID = -(1 << 63)
_SHARDS = "part long, part_shard long, n_docs long, n_tokens long, data binary"


def ids_of(path: str, end_id: int):
    """text -> ids with the end id, as uint32."""
    encode, end = encoder(path), np.uint32(end_id).tobytes()
    return lambda text: np.frombuffer(encode(text) + end, "<u4")


def train(samples: list[bytes]) -> bytes:
    """A dictionary of serialized ids; of the bytes as they are where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


class ShardReader:
    """Documents of one shard, each read on its own."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, self.count, digest = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        (at,) = struct.unpack_from("<Q", data, len(data) - 8)
        self.index = np.frombuffer(data, ENTRY, self.count, at)
        self.data, self.ends = data, [*self.index["offset"][1:].tolist(), at]
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        entry = self.index[k]
        body = self.unpack.decompress(self.data[int(entry["offset"]) : self.ends[k]], max_output_size=int(entry["n"]) * self.width)
        return np.frombuffer(body, "<u2" if self.width == 2 else "<u4").astype("<u4")


def shard(rows: list[tuple[int | None, int, bytes]], width: int, dictionary: bytes) -> bytes:
    """rows: (id, ids in the frame, frame) -> a whole shard."""
    head = HEAD.pack(MAGIC, width, len(rows), hashlib.sha256(dictionary).digest())
    index, at = np.zeros(len(rows), ENTRY), len(head)
    for i, (name, n, frame) in enumerate(rows):
        index[i] = (NO_ID if name is None else name, at, n)
        at += len(frame)
    return b"".join([head, *(f for _, _, f in rows), index.tobytes(), struct.pack("<Q", at)])


def _sample(docs: DataFrame) -> Iterator[str]:
    """Whole texts of the smallest hashes, as many as TRAIN_DOCS, TRAIN_BYTES and, by two
    bytes an id at least, TRAIN_IDS allow; sizes are added up before a text is read."""
    h = F.xxhash64("doc_id", "text")
    few = docs.select(h.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).orderBy("h", "size").limit(TRAIN_DOCS).collect()
    used, hashes = 0, []
    for r in few:
        if used + r["size"] > min(TRAIN_BYTES, 2 * TRAIN_IDS):
            continue
        used += r["size"]
        hashes.append(r["h"])
    seen = set()
    for r in docs.where(h.isin(hashes)).select(h.alias("h"), "text").dropDuplicates(["h"]).collect() if hashes else []:
        if r["h"] not in seen:
            seen.add(r["h"])
            yield r["text"] or ""


def write_store(df: DataFrame, path: str, scratch: Scratch, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text, appends end_id and writes the store at ``path``.

    Documents stand in ascending id order, those without an id first; rows of one id stand
    side by side, ordered by their frames.  A null or empty text is the end id alone.  An
    empty table gives a store without shards.
    """
    from tokenizers import Tokenizer

    spark, docs = df.sparkSession, documents(df, id_col, text_col)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    encode = ids_of(tokenizer, end_id)
    samples = [encode(text).astype(kind).tobytes() for text in _sample(docs)]
    dictionary = train(sorted(samples))
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def make():
        encode, pack = ids_of(tokenizer, end_id), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encode(x.decode()) for x in raw(batch, "text")]
            frames = pa.array([pack.compress(x.astype(kind).tobytes()) for x in ids], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), frames], ["doc_id", "n", "frame"])

        return f

    with batches_of(spark, 1000, "4m"):
        frames = scratch.write(map_slices(docs, make, "doc_id long, n long, frame binary"), "frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (PART_SHARDS * shard_bytes) + 1)

    # the hash deals out and orders rows that share an id
    keyed = frames.withColumn("h", F.xxhash64("frame"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, number, part = [], 0, 0, TaskContext.get().partitionId()

        def close():
            numbers = [part, number, len(rows), sum(r[1] for r in rows)]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), pa.array([shard(rows, width, dictionary)], pa.binary())], ["part", "part_shard", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[2])
                if held >= shard_bytes:
                    yield close()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield close()

    # parts of a range partitioning are numbered in its order
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    with batches_of(spark, 1000, "4m"):
        ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "frame").select("doc_id", "n", "frame")
        ordered.mapInArrow(lean(gather), _SHARDS).write.parquet(f"{path}/shards")
    scratch.drop(frames)


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The shards with the number of ids before each (``start``), and the dictionary."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have its hash")
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    # sums of shards within their part, and of parts: a part is one number to the window
    # that sees all of them, and no window sees the shards
    place = ["part", "part_shard"]
    inside = shards.select(*place, (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("part_shard")) - F.col("n_tokens")).alias("inside"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = inside.join(before, "part").select(*place, (F.col("inside") + F.col("before")).alias("start"))
    few = shards.count() <= BROADCAST_SHARDS  # 24 bytes each
    return shards.join(F.broadcast(starts) if few else starts, place), dictionary


def read_store(spark: SparkSession, path: str, with_ids: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """One row a document, read back from the shards: (doc_id, start, n_tokens, ids_crc32[, ids]).

    With ``scratch`` the rows are read now, a shard at a time, and come from a written table;
    without, whoever reads the result sets how many shards a worker gets at once.
    """
    shards, dictionary = open_store(spark, path)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = ShardReader(data.as_py(), dictionary)
                for at in range(0, reader.count, 256):
                    ids = [reader.ids(k) for k in range(at, min(at + 256, reader.count))]
                    n = np.array([len(x) for x in ids], np.int64)
                    names = [None if x == NO_ID else x for x in reader.index["id"][at : at + 256].tolist()]
                    out = [pa.array(names, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                    start += int(n.sum())

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = shards.select("start", "data").mapInArrow(lean(f), kind)
    if scratch is None:
        return rows
    with batches_of(spark, 1, "1m"):
        return scratch.write(rows, "documents")


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Writes the dictionary and each shard as a plain file under a local folder of the driver."""
    shards, dictionary = open_store(spark, path)
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    (to / "dictionary.zstd").write_bytes(dictionary)
    names = []
    for i, row in enumerate(shards.orderBy("start").toLocalIterator()):
        names.append(str(to / f"shard-{i:06d}.tok"))
        Path(names[-1]).write_bytes(bytes(row["data"]))
    return names
