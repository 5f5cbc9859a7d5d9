"""Token ids in fixed-width bit packing (operator 7).

File format (little-endian): ``WLBP``, width u32, block u32 (ids a block), n_ids u64, n_docs u64;
byte offset of each block (u64, one more than blocks); each document's first id (u64, one more
than documents); doc_ids (i64) and a byte each that is 1 for a null doc_id; the blocks. A block
holds its ids in ``width`` bits each, least significant bit first, and starts at a byte, so that
any id is found from the offsets alone and a block unpacks in numpy without a loop over ids.

Documents are range-partitioned by doc_id and sorted, so the files follow one another in
ascending doc_id order (null first). Rows of one doc_id are dealt further by their text and their
place in the input, so no id meets in one task. A task writes a file for every IDS_PER_FILE ids, so
that memory is bounded by ids (and one text), not by documents. It writes each file under a name of
its own and renames it: an attempt that is repeated leaves the same files.

Defined results: null and empty texts have their end id alone; repeated rows are documents of
their own, next to one another; rows of one doc_id stand in the order of a hash of their text; null
doc_ids come first; texts may have any length; extra columns are ignored; an empty table gives no
file and no rows.
"""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
MAGIC = b"WLBP"
BLOCK = 4096
HEAD = struct.Struct("<4sIIQQ")
#: Ids of a file (a longer document has a file of its own), and bytes of text of a task on average.
IDS_PER_FILE, TASK_BYTES = 4_000_000, 32_000_000
#: Bytes of text whose different words are encoded once (a longer text is encoded with those before it).
ENCODED_BYTES = 12_000_000


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def encode_file(ids: np.ndarray, offsets: np.ndarray, doc_ids: list, width: int, block: int = BLOCK) -> bytes:
    blocks = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, width, block, len(ids), len(doc_ids)), at.tobytes(), offsets.astype("<u8").tobytes(), keys.tobytes(), nulls.tobytes(), *blocks])


class Reader:
    """Random access to a file's ids: read(a, b) touches only the blocks that hold them."""

    def __init__(self, f):
        self.f = f
        magic, self.width, self.block, self.n_ids, self.n_docs = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        n = math.ceil(self.n_ids / self.block)
        self.at = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(f.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(f.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(f.read(self.n_docs), np.uint8)
        self.data = HEAD.size + 8 * (n + 1) + 8 * (self.n_docs + 1) + 9 * self.n_docs

    def read(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        self.f.seek(self.data + int(self.at[first]))
        raw = self.f.read(int(self.at[last + 1] - self.at[first]))
        base = first * self.block
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(raw[int(self.at[k] - self.at[first]) : int(self.at[k + 1] - self.at[first])], n, self.width))
        return np.concatenate(parts)[a - base : b - base]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.offsets[k]), int(self.offsets[k + 1]))


def grouped(parts):
    """Lists of parts that have ENCODED_BYTES of text together."""
    group, size = [], 0
    for b in parts:
        group.append(b)
        size += pc.sum(pc.binary_length(b["text"])).as_py() or 0
        if size >= ENCODED_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write documents to files below folder (a URI that the executors share).

    Returns the manifest, one row a file: file, part, piece, n_ids, n_docs, base (all long; base:
    ids in all files before it). The manifest lies beside the files.
    """
    spark, path = docs.sparkSession, vocabulary or common.vocabulary_path(common.WORD_BPE)
    common.small_batches(spark)
    rows = common.id_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(common.partitions(spark), math.ceil(size / TASK_BYTES))
    width = width_of(common.word_tokens(path).tokenizer.get_vocab_size())

    def save(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, place = open_fs(folder)
        store.create_dir(place, recursive=True)
        piece, ids, ends, keys = 0, [], [0], []

        def flush() -> pa.RecordBatch:
            data = encode_file(np.concatenate(ids), np.asarray(ends), keys, width)
            name = f"part-{part:06d}-{piece:06d}.wlbp"
            with store.open_output_stream(tried := f"{place}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            store.move(tried, f"{place}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "piece": [piece], "n_ids": [ends[-1]], "n_docs": [len(keys)]})

        for group in grouped(common.parts(batches)):
            coded = common.coded_texts(pa.chunked_array([b["text"] for b in group]))
            some, cuts = common.coded_ids(*coded, path, end_id)
            some, first = some.astype(np.uint16) if width <= 16 else some, 0
            for b in group:
                own = cuts[first : first + b.num_rows + 1]
                ids.append(some[own[0] : own[-1]])
                ends.extend((own[1:] - own[0] + ends[-1]).tolist())
                keys.extend(b["doc_id"].to_pylist())
                first += b.num_rows
                if ends[-1] >= IDS_PER_FILE:
                    yield flush()
                    piece, ids, ends, keys = piece + 1, [], [0], []
        if keys:
            yield flush()

    schema = "file string, part long, piece long, n_ids long, n_docs long"
    spread = rows.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(tasks, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    ordered.mapInArrow(save, schema).write.parquet(f"{folder}/_manifest")
    manifest = spark.read.schema(schema).parquet(f"{folder}/_manifest")
    # one row a file: this window is over files, not over documents
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and the file that holds them."""

    def load(batches):
        for b in common.parts(batches):
            for name, base in zip(b["file"].to_pylist(), b["base"].to_pylist()):
                store, place = open_fs(folder)
                with store.open_input_file(f"{place}/{name}") as f:
                    r = Reader(f)
                    step = 2000
                    for i in range(0, r.n_docs, step):
                        ks = range(i, min(i + step, r.n_docs))
                        lo = int(r.offsets[i])
                        ids = r.read(lo, int(r.offsets[ks[-1] + 1]))
                        cuts = r.offsets[i : ks[-1] + 2] - lo
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([None if r.nulls[k] else int(r.doc_ids[k]) for k in ks], pa.int64()),
                            "start": pa.array(base + lo + cuts[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                            "ids_crc32": pa.array([common.crc(ids[s:e]) for s, e in zip(cuts[:-1], cuts[1:])], pa.int64()),
                            "file": pa.array([name] * len(ks), pa.string()),
                        })

    spread = manifest.repartition(max(1, common.partitions(manifest.sparkSession)), "part", "piece")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op7_bitpack(spark, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "bitpack")
    return read(write(common.table(spark, sf_dir, "documents"), folder), folder)
