"""FASTA and FASTQ as a Spark data source, plain or gzipped.

``spark.read.format("fastx").load(folder or file or glob)`` after ``register(spark)``, or
``read(spark, paths)``. Columns: uri, record_no (from 0), name (to the first white space),
comment (the rest of the header), seq, qual (null in FASTA), corrupt (true where a FASTQ record's
quality is missing or of another length than its sequence; the record keeps what was read), start
(seq's place in its record: 0, unless records are cut into pieces).

Files are streams of blocks: a task holds one block and one record, or one piece of it.
"""

from __future__ import annotations

import contextlib
import glob as globbing
import gzip
import io
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "uri string, record_no long, name string, comment string, seq string, qual string, corrupt boolean, start long"
#: Bytes read at once; symbols of a piece of a sequence in an index's input; symbols and records of an Arrow batch.
BLOCK, PIECE, BATCH, ROWS = 1 << 20, 1 << 20, 1 << 22, 1000


def fragments(f) -> Iterator[tuple[str, bool]]:
    """(text, whether it begins a line) of a binary stream; a long line comes in blocks."""
    begins = True
    while block := f.read(BLOCK):
        parts = block.decode("latin-1").split("\n")
        for i, part in enumerate(parts):
            if part or i < len(parts) - 1:
                yield part, begins
            begins = i < len(parts) - 1
        begins = not parts[-1] if len(parts) > 1 else begins


class Record:
    """A record as far as it is read."""

    def __init__(self):
        self.head, self.seq, self.qual = [], [], None
        self.n_seq = self.n_qual = self.start = 0

    def row(self, seq: str | None = None) -> tuple:
        seq = "".join(self.seq) if seq is None else seq
        head = "".join(self.head).rstrip("\r")
        at = next((i for i, c in enumerate(head) if c in " \t"), len(head))
        qual = None if self.qual is None else "".join(self.qual)
        return head[:at], head[at + 1 :] or None, seq, qual, qual is not None and len(qual) != len(seq), self.start

    def pieces(self, size: int, overlap: int) -> Iterator[tuple]:
        """Whole pieces of the sequence so far; what follows them stays."""
        seq = "".join(self.seq)
        while len(seq) > size + overlap:
            yield self.row(seq[: size + overlap])
            seq, self.start = seq[size:], self.start + size
        self.seq, self.n_seq = [seq], len(seq)


def parse(texts, piece: int | None = None, overlap: int = 0) -> Iterator[tuple]:
    """(name, comment, seq, qual, corrupt, start) of each record of fragments.

    With piece, a FASTA sequence comes in pieces of piece + overlap symbols, each of which begins
    with the last overlap symbols of the one before."""
    r, kind = None, ""
    for text, begins in texts:
        if begins:
            if r and r.qual is not None and r.n_qual < r.n_seq:
                kind = "qual"  # also a line that starts with @ or >
            elif text[:1] in (">", "@"):
                if r:
                    yield r.row()
                r, kind, text = Record(), "head", text[1:]
            elif r is None:
                kind = ""  # before the first header
            elif r.qual is not None:
                kind = "qual"
            elif text[:1] == "+":
                r.qual, kind = [], ""
            else:
                kind = "seq"
        if kind == "head":
            r.head.append(text)
        elif kind == "seq":
            text = text.replace(" ", "").replace("\t", "").replace("\r", "")
            r.seq.append(text)
            r.n_seq += len(text)
            if piece and r.n_seq > 2 * piece + overlap:
                yield from r.pieces(piece, overlap)
        elif kind == "qual":
            text = text.rstrip("\r")
            r.qual.append(text)
            r.n_qual += len(text)
    if r:
        if piece and r.qual is None:
            yield from r.pieces(piece, overlap)
        yield r.row()


def records(uri: str, f, piece: int | None = None, overlap: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA of one file, a binary stream; gzip is told by its first bytes."""
    f = io.BufferedReader(f) if not hasattr(f, "peek") else f
    f = gzip.GzipFile(fileobj=f) if f.peek(2)[:2] == b"\x1f\x8b" else f
    number = -1
    try:
        for name, comment, seq, qual, corrupt, start in parse(fragments(f), piece, overlap):
            number += not start
            yield uri, number, name, comment, seq, qual, corrupt, start
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"{uri}: not a whole gzip file") from e


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        if os.path.isdir(self.path):
            names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if not n.startswith((".", "_")))
        else:
            names = sorted(globbing.glob(self.path)) or [self.path]
        return [OneFile(n) for n in names]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from records(partition.path, f)


class FastxSource(DataSource):
    """Files on a mounted file system; read() takes any store that Spark reads."""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def streams(uri: str) -> bool:
    """Whether workers can open uri as a stream; other stores' files come through Spark, whole."""
    from pyarrow import fs

    with contextlib.suppress(Exception):
        return bool(fs.FileSystem.from_uri(uri))
    return False


def read(spark: SparkSession, paths: list[str] | str, piece: int | None = None, overlap: int = 0) -> DataFrame:
    """Records of files in any store that Spark reads, one task a file and more with more files. With
    piece, long FASTA sequences come in overlapping pieces."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(paths)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    out = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    listed = files.select("path")
    first = listed.first()
    opened = first is None or streams(first["path"])

    def batch(rows: list[tuple]):
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=out)

    def each(batches):
        from pyarrow import fs

        for b in batches:
            for i, uri in enumerate(b["path"].to_pylist()):
                if opened:
                    store, place = fs.FileSystem.from_uri(uri)
                    f = store.open_input_stream(place, compression=None)
                else:
                    f = pa.BufferReader(b["content"][i].as_buffer())
                some, n = [], 0
                with f:
                    for r in records(uri, io.BufferedReader(Raw(f), BLOCK), piece, overlap):
                        some.append(r)
                        n += len(r[4])
                        if len(some) == ROWS or n >= BATCH:
                            yield batch(some)
                            some, n = [], 0
                if some:
                    yield batch(some)

    if opened:  # the content isn't read here; a task for each file as far as there are cores
        files = listed.repartition(max(1, min(listed.count(), 64 * spark.sparkContext.defaultParallelism)), "path")
    else:
        files = files.select("path", "content")
    return files.mapInArrow(each, SCHEMA)


class Raw(io.RawIOBase):
    """An Arrow stream as Python's raw stream."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def readinto(self, b):
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def documents(spark: SparkSession, paths: list[str], piece: int | None = None, overlap: int = 0) -> DataFrame:
    """doc_id (place in paths), uri, record_no, name, seq, start."""
    rows = read(spark, paths, piece, overlap)
    # Spark reports a file by its full URI; each listed path is the end of one
    order = [(i, p if "://" in p else os.path.abspath(p)) for i, p in enumerate(paths)]
    listed = spark.createDataFrame(order, "doc_id int, listed string")
    bare = F.regexp_replace("uri", "^[a-z]+:/*", "/")
    plain = F.regexp_replace("listed", "^[a-z]+:/*", "/")
    return rows.withColumn("_bare", bare).join(listed.withColumn("_bare", plain), "_bare").select("doc_id", "uri", "record_no", "name", "seq", "start")
