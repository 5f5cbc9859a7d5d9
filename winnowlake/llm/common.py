"""What the operators share: words, tokens, hashing of words, and the shared folder.

A *word* is a maximal run of characters other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``). Arrow's ASCII split uses exactly that class.
"""

from __future__ import annotations

import array
import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a regex class and as the characters themselves.
WS_CLASS = r"[\x20\x09-\x0D]"
WS = " \t\n\x0b\x0c\r"
WORD_BPE = "word_bpe_49k.json"
#: Rows in one Arrow batch; a batch of average documents is then a few megabytes.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, also where single texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), doc_id, text: an operator's own columns stand beside row, so
    no name of docs can clash with them. unpacked() gives the columns back."""
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing and Spark runs in this one process (tests), a folder of
    this machine takes its place; on a cluster a missing setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='winnowlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there. Whoever knows that
    the table is read no more may give it to dropped()."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _written.append(path)
    return out


#: Folders of settled tables in the order in which they were written and not dropped.
_written: list[str] = []


def written() -> list[str]:
    return list(_written)


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete settled tables, given as they were returned or by their folders."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_settled_at", None)
        if path is None:
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


#: Bits of an id filter at least and at most; the most makes a table of 262,144 rows of two numbers.
FILTER_BITS = (1 << 18, 1 << 24)


def id_filter(ids: DataFrame, column: str = "doc_id"):
    """A function that splits a DataFrame by a bitmap of hashed ids.

    split(df, True) has all rows whose id is in ids, and a few more; split(df, False) has the
    rest, none of which is. The bitmap has eight bits or more for each id up to its largest size,
    beyond which more rows pass as True: what is broadcast is bounded and no row is lost.
    """
    bits = FILTER_BITS[0]
    n = ids.count()
    while bits < FILTER_BITS[1] and bits < 8 * n:
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    words = ids.select(slot(column).alias("s")).groupBy(F.shiftright("s", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) AS int))")).alias("_b"))
    words = settled(ids.sparkSession, words, "bitmap")

    def split(df: DataFrame, inside: bool, key: str = "doc_id") -> DataFrame:
        marked = df.withColumn("_slot", slot(key)).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_w"), "left")
        hit = F.expr("coalesce(shiftright(_b, cast(pmod(_slot, 64) AS int)) & 1L, 0L) = 1L")
        return marked.where(hit if inside else ~hit).select(*df.columns)

    return split


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words (texts + 1 numbers) and all words, empty strings left out.

    A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk or several
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    values, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(values)) > 0 if len(values) else np.zeros(0, bool)
    if not full.all():
        values = values.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return offsets, values


#: Bytes of text that a worker handles at once (a longer text alone makes a part of its own).
PART_BYTES = 1_000_000


def parts(batches, column: str = "text", most: int = PART_BYTES):
    """Slices of Arrow batches with a bounded amount of text each; memory goes back at the start
    and at the end. column may be a field of a struct (row.text).

    Workers outlive a stage, so what one leaves allocated would add to the next one's needs."""
    release()
    outer, _, inner = column.partition(".")
    for b in batches:
        if outer not in b.schema.names or not b.num_rows:
            yield b
            continue
        texts = b[outer].field(inner) if inner else b[outer]
        total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        first = 0
        while first < b.num_rows:
            before = int(total[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(total, before + most, side="right")))
            yield b.slice(first, end - first)
            first = end
    release()


def release() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts with A-Z in lower case. They are copied first: Arrow 23's ascii_lower reads from the
    wrong place where the first string does not start at the buffer's start (as in a slice)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    return pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))


def coded_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in the list of different words, and that list."""
    d = words.dictionary_encode()
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def coded_texts(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, the number of each word in the list of different words, and
    that list; only a part of the words is held at once."""
    sizes, coded = [np.zeros(1, np.int64)], [pa.array([], pa.large_string()).dictionary_encode()]
    for b in parts(pa.table({"text": texts}).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)):
        offsets, words = split_words(b["text"])
        sizes.append(np.diff(offsets))
        coded.append(words.dictionary_encode())
    chunks = pa.chunked_array(coded).unify_dictionaries().chunks
    return np.cumsum(np.concatenate(sizes)), np.concatenate([np.asarray(c.indices) for c in chunks]), chunks[0].dictionary


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file of the installed collection lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin-1 letters, and the marks behind it.
PLAIN_WORD = r"^(?P<stem>[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)(?P<marks>[.,;:!?\"()]*)$"
#: Stems that a worker keeps, and words that go through the whole tokenizer at once.
KEPT_STEMS, SLOW_WORDS = 100_000, 2000


def byte_letters() -> dict[int, str]:
    """What stands for each byte in a byte-level vocabulary: itself if it is printable, else a
    letter from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokens:
    """The ids of words, by a tokenizer of which no token crosses white space.

    A word of Latin letters is one match of the tokenizer's pattern: its lower case goes straight
    to the merges, and its ids are kept. Marks behind it are a match of their own. All other words
    go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {c: "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        # the short way must be the tokenizer's own; if a vocabulary's isn't, all words go the long way
        probe = ["House", "ÉtÉ", "straße", "zzqx", "a"]
        self.short = [self.stem(w.lower()) for w in probe] == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe]
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.ends = array.array("I"), array.array("q", [0])

    def stem(self, low: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else low.translate(self.letters))]

    def add(self, word: str, ids: list[int]) -> None:
        self.code[word] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def stems(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of stems or marks, and their lengths."""
        if len(self.code) > KEPT_STEMS:
            self.forget()
        code = self.code
        for w in words:
            if w not in code:
                self.add(w, self.stem(w) if w.isalpha() else self.tokenizer.encode(w, add_special_tokens=False).ids)
        at = np.fromiter((code[w] for w in words), np.int64, len(words))
        ends = np.array(self.ends, dtype=np.int64)
        lengths = ends[at + 1] - ends[at]
        return np.array(self.ids, dtype=np.uint32)[gather(ends[at], lengths)], lengths

    def slow(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, lengths = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        for i in range(0, len(words), SLOW_WORDS):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + SLOW_WORDS], add_special_tokens=False)]
            lengths[i : i + len(found)] = list(map(len, found))
            parts.append(np.fromiter((x for e in found for x in e), np.uint32))
        return np.concatenate(parts), lengths

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of different words, and their lengths."""
        n = len(distinct)
        parts = pc.extract_regex(distinct, PLAIN_WORD)
        plain = np.asarray(parts.is_valid()) if self.short else np.zeros(n, bool)
        fast, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        rows = parts.take(pa.array(fast))
        columns = []  # (words, flat ids, lengths) in the order in which they stand in a word
        for name in ("stem", "marks"):
            code, known = coded_words(pc.utf8_lower(rows.field(name)))
            flat, lengths = self.stems(known.to_pylist())
            starts = np.cumsum(lengths) - lengths
            own = lengths[code]
            columns.append((fast, flat[gather(starts[code], own)], own))
        columns.append((rest, *self.slow(distinct.take(pa.array(rest)).to_pylist())))
        lengths = np.zeros(n, np.int64)
        for words, _, own in columns:
            lengths[words] += own
        out, filled = np.zeros(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        for words, flat, own in columns:
            out[gather(filled[words], own)] = flat
            filled[words] += own
        return out, lengths


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def token_ids(texts: pa.Array | pa.ChunkedArray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, one after the other and end_id after each text, and their offsets.

    Each different word of the batch is encoded once. A null text has its end id alone.
    """
    offsets, words = split_words(texts)
    codes, distinct = coded_words(words)
    return filled_ids(offsets, codes, *word_tokens(path).encode(distinct), end_id)


def filled_ids(offsets: np.ndarray, codes: np.ndarray, flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids and their offsets as token_ids, of numbered words and each word's ids."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(own)])[offsets]
    n = len(offsets) - 1
    out = np.empty(int(ends[-1]) + n, np.uint32)
    cuts = ends + np.arange(n + 1)
    last = cuts[1:] - 1
    out[last] = end_id
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = flat[gather(starts[codes], own)]
    return out, cuts


#: Different words encoded at once, and words whose ids are put in their places at once.
ENCODED_WORDS, FILLED_WORDS = 50_000, 250_000


def coded_ids(offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of coded_texts' result: each different word is encoded once for all texts."""
    found = [word_tokens(path).encode(distinct.slice(i, ENCODED_WORDS)) for i in range(0, len(distinct), ENCODED_WORDS)]
    flat = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in found)])
    lengths = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
    ids, cuts, first = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + FILLED_WORDS, side="right")) - 1)
        part = offsets[first : end + 1]
        some, ends = filled_ids(part - part[0], codes[part[0] : part[-1]], flat, lengths, end_id)
        ids.append(some)
        cuts.append(ends[1:] + cuts[-1][-1])
        first = end
    return np.concatenate(ids), np.concatenate(cuts)


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """XXH64 of each word's UTF-8 bytes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
