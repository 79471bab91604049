"""Binary edge files as a Spark data source, read and written in ranges of whole records.

A record is src and dst as little-endian unsigned 32-bit integers, with a weight of the
same kind or a 64-bit float behind them.  A file may begin with 16 bytes: rows and columns
(unsigned 32 bits each) and records (unsigned 64 bits).
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftgraph.sources import files

RECORDS = {
    "none": np.dtype([("src", "<u4"), ("dst", "<u4")]),
    "int": np.dtype([("src", "<u4"), ("dst", "<u4"), ("weight", "<u4")]),
    "double": np.dtype([("src", "<u4"), ("dst", "<u4"), ("weight", "<f8")]),
}
HEADER = struct.Struct("<IIQ")
SCHEMAS = {"none": "src long, dst long", "int": "src long, dst long, weight long", "double": "src long, dst long, weight double"}
#: Bytes that a task reads, and that it holds at a time.
SPLIT, BLOCK = 64 << 20, 4 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size


class Done(WriterCommitMessage):
    def __init__(self, path: str, records: int, top: tuple[int, int]):
        self.path, self.records, self.top = path, records, top


class EdgeSource(DataSource):
    """Options: path, weight (none, int, double), header (true, false), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "edges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("weight", "none")]

    def reader(self, schema) -> DataSourceReader:
        return EdgeReader(self.options)

    def writer(self, schema, overwrite: bool):
        return EdgeWriter(self.options)


class EdgeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], RECORDS[options.get("weight", "none")]
        self.header = str(options.get("header", "false")).lower() == "true"
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        out, width = [], self.kind.itemsize
        step = max(width, self.split // width * width)
        for i, (path, size) in enumerate(files.listing(self.path)):
            first = HEADER.size if self.header and i == 0 else 0
            end = first + (size - first) // width * width  # a torn last record is left out
            out += [Range(path, at, min(step, end - at)) for at in range(first, end, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        step = BLOCK // self.kind.itemsize * self.kind.itemsize
        for at in range(part.start, part.start + part.size, step):
            rows = np.frombuffer(files.read_range(part.path, at, min(step, part.start + part.size - at)), self.kind)
            columns = [rows[c].astype(np.float64 if rows[c].dtype.kind == "f" else np.int64) for c in self.kind.names]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(self.kind.names))


class EdgeWriter(DataSourceArrowWriter):
    """Each task writes a part file under a name of its own; commit gives them theirs."""

    def __init__(self, options):
        self.path, self.kind = options["path"].rstrip("/"), RECORDS[options.get("weight", "none")]
        self.header = str(options.get("header", "false")).lower() == "true"

    def write(self, iterator):
        path, n, top = f"{self.path}/.{uuid.uuid4().hex}", 0, [0, 0]

        def blocks():
            nonlocal n
            for b in iterator:
                rows = np.zeros(b.num_rows, self.kind)
                for c in self.kind.names:
                    column = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    if self.kind[c].kind == "u" and len(column) and not 0 <= column.min() <= column.max() < 1 << 32:
                        raise ValueError(f"{c} has values that 32 unsigned bits do not hold")
                    rows[c] = column
                n += len(rows)
                for i, c in enumerate(("src", "dst")):
                    top[i] = max(top[i], int(rows[c].max())) if len(rows) else top[i]
                yield rows.tobytes()

        files.write_bytes(path, blocks())
        return Done(path, n, tuple(top))

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        if self.header:
            top = [max([0, *(m.top[i] for m in done)]) for i in range(2)]
            files.write_bytes(f"{self.path}/part-00000-header", [HEADER.pack(*top, sum(m.records for m in done))])
        for i, m in enumerate(done):
            files.move(m.path, f"{self.path}/part-{i + 1:05d}")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                files.remove(m.path)


def read_header(path: str) -> tuple[int, int, int]:
    """(rows, columns, records) that the file says it has."""
    return HEADER.unpack(files.read_range(files.listing(path)[0][0], 0, HEADER.size))


def read_edges(spark: SparkSession, path: str, weight: str = "none", header: bool = False, split: int = SPLIT) -> DataFrame:
    """Edges of a binary file, or of a folder of part files of which the first may begin with a header."""
    spark.dataSource.register(EdgeSource)
    return spark.read.format("edges").options(path=path, weight=weight, header=str(header).lower(), split=str(split)).load()


def write_edges(edges: DataFrame, path: str, weight: str = "none", header: bool = False) -> None:
    """Writes part files, one a task; weights are dropped, kept, or 1 where there are none.

    Ids and whole weights are unsigned 32-bit numbers in the file: others are an error.  So
    is a folder that has part files, as two runs' parts can't be told apart.
    """
    if files.exists(path) and files.listing(path):
        raise FileExistsError(f"{path} has files already")
    from pyspark.sql import functions as F

    edges.sparkSession.dataSource.register(EdgeSource)
    own = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *([] if weight == "none" else [(F.col("weight") if "weight" in edges.columns else F.lit(1)).cast("long" if weight == "int" else "double").alias("weight")]))
    own.write.format("edges").options(path=path, weight=weight, header=str(header).lower()).mode("append").save()
