"""Minimizers of sequences.

For each window of k symbols the minimizer is the least hash among its k - m + 1 m-mers (of an
m-mer and its reverse complement the smaller counts, if canonical). Three forms agree:

* ``minimizers``: an Arrow kernel in numpy over whole batches, the fast path;
* ``minimizers_sql``: a window function over exploded positions, in DataFrame operations alone;
* ``naive``: a direct Python loop, for tests.

Hashes are ``mix`` (a 64-bit finaliser; stored as signed, compared as unsigned) or ``md5`` (hex
strings, equal in every SQL engine).
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import encode

K, M, SEED = 31, 19, 42
#: Symbols that the kernel handles at once; a longer sequence is cut into pieces of as many.
PIECE = 2_000_000
#: Leading bits of a hash that tell whether it may be among those sought: a bitmap of 2 MB.
LEADING = 24
#: Symbols whose m-mers are made at once, so that they stay in a core's cache.
MER_BLOCK = 32_768


def checked(k: int, m: int) -> tuple[int, int]:
    if not 1 <= k < 32:
        raise ValueError(f"k must be in 1..31, not {k}")
    if not 1 <= m <= k:
        raise ValueError(f"m must be in 1..k, not {m}")
    return k, m


def finalise(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mmers(codes: np.ndarray, m: int, canonical: bool) -> np.ndarray:
    """The value of each m-mer, by joining spans of doubled length."""
    n = len(codes) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    fwd = rev = None
    width, span_f, span_r = 1, codes, codes ^ np.uint64(2)
    size, done = m, 0
    while size:
        if size & 1:
            here_f, here_r = span_f[done:], span_r[done:]
            if fwd is None:
                fwd, rev = here_f, here_r
            else:
                n_now = min(len(fwd), len(here_f))
                fwd = (fwd[:n_now] << np.uint64(2 * width)) | here_f[:n_now]
                rev = (here_r[:n_now] << np.uint64(2 * done)) | rev[:n_now]
            done += width
        size >>= 1
        if size:
            a, b = span_f[: len(span_f) - width], span_f[width:]
            c, d = span_r[: len(span_r) - width], span_r[width:]
            span_f, span_r = (a << np.uint64(2 * width)) | b, (d << np.uint64(2 * width)) | c
            width *= 2
    fwd, rev = fwd[:n], rev[:n]
    return np.minimum(fwd, rev) if canonical else fwd


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: Shifts of MD5's rounds, its constants and its first state; values hashed at once, so that their state stays in a core's cache.
MD5_SHIFTS = [s for group in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in group * 4]
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_BLOCK = 16_384


def md5_words(values: np.ndarray, m: int, seed: int) -> list:
    """The 16 words of MD5's only block for the text "digits|seed": arrays where digits are, else numbers."""
    tail = f"|{seed}".encode() + b"\x80"
    block = bytes(m) + tail + bytes(56 - m - len(tail)) + struct.pack("<Q", 8 * (m + len(tail) - 1))
    words = []
    for i, rest in enumerate(struct.unpack("<16I", block)):
        n = min(4, m - 4 * i)  # digits in this word
        if n <= 0:
            words.append(rest)
            continue
        table = np.array([sum((48 + (v >> 2 * (n - 1 - j) & 3)) << 8 * j for j in range(n)) + rest for v in range(4**n)], np.uint32)
        words.append(table[(values >> np.uint64(2 * (m - 4 * i - n))) & np.uint64(4**n - 1)])
    return words


def md5_digests(values: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of "digits|seed" for m-mers: the digest's first and last eight bytes, as numbers that are
    ordered like the hex text."""
    hi, lo = np.empty(len(values), np.uint64), np.empty(len(values), np.uint64)
    if m + len(str(seed)) + 1 > 55:
        for i, v in enumerate(values.tolist()):
            d = hashlib.md5(f"{''.join(str(v >> 2 * (m - 1 - j) & 3) for j in range(m))}|{seed}".encode()).digest()
            hi[i], lo[i] = struct.unpack(">QQ", d)
        return hi, lo
    for at in range(0, len(values), MD5_BLOCK):
        words = md5_words(values[at : at + MD5_BLOCK], m, seed)
        size = len(words[0])
        state = [np.full(size, x, np.uint32) for x in MD5_STATE]
        a, b, c, d = (x.copy() for x in state)
        f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                g = 7 * i % 16
            np.add(f, a, out=f)
            if isinstance(words[g], int):
                np.add(f, np.uint32((MD5_SINES[i] + words[g]) & 0xFFFFFFFF), out=f)
            else:
                np.add(f, words[g], out=f)
                np.add(f, np.uint32(MD5_SINES[i]), out=f)
            np.left_shift(f, np.uint32(MD5_SHIFTS[i]), out=t)
            np.right_shift(f, np.uint32(32 - MD5_SHIFTS[i]), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        for x, y in zip((a, b, c, d), state):
            np.add(x, y, out=x)
            x.byteswap(inplace=True)
        hi[at : at + size] = a.astype(np.uint64) << np.uint64(32) | b
        lo[at : at + size] = c.astype(np.uint64) << np.uint64(32) | d
    return hi, lo


def hex_texts(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """Digests as hex text."""
    pairs = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint16)
    data = pairs[np.stack([hi, lo], 1).astype(">u8").view(np.uint8).ravel()]
    return pa.StringArray.from_buffers(len(hi), pa.py_buffer(np.arange(0, 32 * len(hi) + 1, 32, dtype=np.int32)), pa.py_buffer(data))


def sliding_min_pairs(hi: np.ndarray, lo: np.ndarray, size: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """sliding_min of two-part numbers; more goes along."""

    def less(step: int):
        a, b = hi[: len(hi) - step], hi[step:]
        c, d = lo[: len(lo) - step], lo[step:]
        first = (a < b) | ((a == b) & (c < d))
        return np.minimum(a, b), *(np.where(first, x[: len(x) - step], x[step:]) for x in (lo, *more))

    width = 1
    while 2 * width <= size:
        hi, lo, *more = less(width)
        width *= 2
    return less(size - width) if size > width else (hi, lo, *more)


def batch_hashes(data: np.ndarray, offsets: np.ndarray, k: int, m: int, canonical: bool, seed: int, kind: str, mers: bool = False):
    """(sequence, position of the k-mer from 0, hash, rest of an md5 hash or None) for all k-mers of a batch;
    with mers, the m-mers that have these hashes come last."""
    codes = ((data >> 1) & 3).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64) if kind == "md5" else None, *[np.zeros(0, np.uint64)] * mers
    values, rest, own_mers = mmers(codes, m, canonical), None, []
    if kind == "mix" and mers:
        least, *own_mers = sliding_min_pairs(finalise(values, seed), values, k - m + 1)
    elif kind == "mix":
        least = sliding_min(finalise(values, seed), k - m + 1)[:n]
    else:
        least, rest, *own_mers = sliding_min_pairs(*md5_digests(values, m, seed), k - m + 1, *[values] * mers)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[:n] == owner[k - 1 :]
    at = np.flatnonzero(inside)
    own = owner[at]
    return own, at - offsets[own], least[at], None if rest is None else rest[at], *(x[at] for x in own_mers)


def mer_slots(values: np.ndarray) -> np.ndarray:
    """The bit that stands for each m-mer in mmer_bits' bitmap."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - LEADING)).astype(np.int64)


def near_hashes(data: np.ndarray, offsets: np.ndarray, k: int, m: int, canonical: bool, seed: int, kind: str, mers: np.ndarray):
    """batch_hashes of those k-mers whose minimizer is an m-mer of the bitmap mers; only m-mers in the same
    k-mer as one of these are hashed."""
    last = len(data) - m
    if len(data) < k:
        return batch_hashes(data, offsets, k, m, canonical, seed, kind)
    values, at = np.empty(last + 1, np.uint64), []
    for a in range(0, last + 1, MER_BLOCK):
        some = mmers(((data[a : a + MER_BLOCK + m - 1] >> 1) & 3).astype(np.uint64), m, canonical)
        values[a : a + len(some)] = some
        slots = mer_slots(some)
        at.append(a + np.flatnonzero(mers[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)))
    at = np.concatenate(at)
    # spans of m-mers around these, neighbouring ones joined
    starts, ends = np.maximum(at - (k - m), 0), np.minimum(at + (k - m), last) + 1
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(at) else at
    starts, ends = starts[first], ends[np.concatenate([first[1:], [len(at)]]).astype(np.int64) - 1] if len(at) else at
    lengths, size = ends - starts, k - m + 1
    near = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    if len(near) < size:
        return batch_hashes(data[:0], offsets, k, m, canonical, seed, kind)
    h = [finalise(values[near], seed)] if kind == "mix" else list(md5_digests(values[near], m, seed))
    known = np.unique(h[0][np.searchsorted(near, at)])
    least = [sliding_min(h[0], size)] if kind == "mix" else list(sliding_min_pairs(*h, size))
    start = near[: len(near) - size + 1]
    own = np.searchsorted(offsets, start, side="right") - 1
    kept = np.flatnonzero((near[size - 1 :] - start == size - 1) & (start + k <= offsets[own + 1]) & np.isin(least[0], known))
    own, start, least = own[kept], start[kept], [x[kept] for x in least]
    return own, start - offsets[own], least[0], least[1] if kind == "md5" else None


def batch_minimizers(data: np.ndarray, offsets: np.ndarray, k: int, m: int, canonical: bool, seed: int, kind: str):
    """(sequence, position of the k-mer from 0, hash) for all k-mers of a batch; md5 hashes as
    numbers of a sorted list, which comes last."""
    own, pos, least, rest = batch_hashes(data, offsets, k, m, canonical, seed, kind)
    if rest is None:
        return own, pos, least, None
    names, rank = np.unique(np.array(hex_texts(least, rest).to_pylist(), dtype="<U32"), return_inverse=True)
    return own, pos, rank.astype(np.uint64), names


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def string_bytes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    seqs = seqs.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = seqs.buffers()
    offsets = np.frombuffer(offsets, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def minimizers(df: DataFrame, keys: list[str], seq: str = "seq", k: int = K, m: int = M, canonical: bool = True, seed: int = SEED, kind: str = "mix", runs: bool = False, among: np.ndarray | None = None, mers: np.ndarray | None = None) -> DataFrame:
    """keys, h, n: each sequence's minimizers and how many of its k-mers have them. With among
    (leading_bits), most minimizers whose leading bits aren't there are left out; with mers (mmer_bits), most
    of those that aren't minimizers of the bitmap's sequences, and most m-mers aren't even hashed (not with runs).

    With runs: keys, pos (of the run's first k-mer, from 0), h, n for each run of equal minimizers
    instead. A sequence of more than PIECE symbols gives rows for each of its pieces, so a minimizer
    may come once a piece and a run may be cut there. Sequences shorter than k, empty or null give no rows.
    """
    k, m = checked(k, m)
    if runs and mers is not None:
        raise ValueError("runs need all minimizers")
    rows = df.select(*keys, F.col(seq).alias("_seq"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = f"{types}, " + ("pos long, " if runs else "") + f"h {'long' if kind == 'mix' else 'string'}, n long"

    def each(batches):
        for b in batches:
            for at, base, data, offsets in pieces(b["_seq"], k):
                made = batch_hashes(data, offsets, k, m, canonical, seed, kind) if mers is None else near_hashes(data, offsets, k, m, canonical, seed, kind, mers)
                own, pos, *h = made
                h = [x for x in h if x is not None]
                # runs first: they are about a seventh of the k-mers, and only they are sorted
                first = starts_of(own, *h)
                n = np.diff(np.concatenate([first, [len(own)]]))
                own, pos, h = own[first], pos[first], [x[first] for x in h]
                if among is not None:
                    at_word = (h[0] >> np.uint64(64 - LEADING)).astype(np.int64)
                    kept = np.flatnonzero(among[at_word >> 6] >> (at_word & 63).astype(np.uint64) & np.uint64(1))
                    own, pos, n, h = own[kept], pos[kept], n[kept], [x[kept] for x in h]
                if not runs and len(n):
                    order = np.lexsort((*h[::-1], own))
                    own, n, h = own[order], n[order], [x[order] for x in h]
                    first = starts_of(own, *h)
                    own, n, h = own[first], np.add.reduceat(n, first), [x[first] for x in h]
                rows_at = pa.array(at + own)
                cols = {c: b[c].take(rows_at) for c in keys}
                if runs:
                    cols["pos"] = pa.array(base + pos, pa.int64())
                cols["h"] = pa.array(h[0].view(np.int64)) if kind == "mix" else hex_texts(*h)
                cols["n"] = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(each, out)


def leading_bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits that hashes (column h) begin with, of bounded size whatever their number."""
    text = isinstance(hashes.schema["h"].dataType, StringType)
    lead = F.conv(F.substring("h", 1, LEADING // 4), 16, 10).cast("long") if text else F.shiftrightunsigned("h", 64 - LEADING)
    return bitmap(hashes.select(lead.alias("lead")))


def mmer_bits(df: DataFrame, seq: str = "seq", k: int = K, m: int = M, canonical: bool = True, seed: int = SEED, kind: str = "mix") -> np.ndarray:
    """A bitmap of the m-mers that are minimizers of sequences, of bounded size whatever their number."""
    k, m = checked(k, m)

    def each(batches):
        for b in batches:
            for _, _, data, offsets in pieces(b["_seq"], k):
                least = batch_hashes(data, offsets, k, m, canonical, seed, kind)[2]
                values = mmers(((data >> 1) & 3).astype(np.uint64), m, canonical)
                own = finalise(values, seed) if kind == "mix" else md5_digests(values, m, seed)[0]
                yield pa.RecordBatch.from_pydict({"lead": pa.array(np.unique(mer_slots(values[np.isin(own, least)])), pa.int64())})

    return bitmap(df.select(F.col(seq).alias("_seq")).mapInArrow(each, "lead long"))


def bitmap(leads: DataFrame) -> np.ndarray:
    """Words of 64 bits in which the bits numbered lead are set."""
    words = leads.groupBy(F.shiftright("lead", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(lead & 63 AS int))")).alias("b")).toPandas()
    bits = np.zeros(1 << LEADING - 6, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def pieces(seqs: pa.Array, k: int):
    """(first row, first symbol, bytes, offsets) of parts of a batch with PIECE symbols at most. Pieces
    of a long sequence overlap by k - 1 symbols, so each k-mer lies in one piece."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(seqs), 0), dtype=np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        data, offsets = string_bytes(seqs.slice(first, last - first))
        if len(data) <= PIECE:
            yield first, 0, data, offsets
        else:  # one sequence alone
            for a in range(0, len(data) - k + 1, PIECE):
                part = data[a : a + PIECE + k - 1]
                yield first, a, part, np.array([0, len(part)])
        first = last


def positions(df: DataFrame, keys: list[str], digits: str, k: int = K, m: int = M, canonical: bool = True, seed: int = SEED) -> DataFrame:
    """keys, pos (from 1), mmer, h, last (the last k-mer's position): one row for each m-mer."""
    k, m = checked(k, m)
    length = F.length(digits)
    rows = df.where(length >= k).select(*keys, digits, (length - k + 1).alias("last"), F.explode(F.sequence(F.lit(1), length - m + 1)).alias("pos"))
    mer = encode.mmer(F.col(digits), F.col("pos"), m)
    mer = encode.canonical(mer) if canonical else mer
    return rows.select(*keys, "pos", "last", mer.alias("mmer")).withColumn("h", encode.mmer_hash(F.col("mmer"), seed))


def minimizers_sql(df: DataFrame, keys: list[str], digits: str, k: int = K, m: int = M, canonical: bool = True, seed: int = SEED) -> DataFrame:
    """keys, pos, h: the minimizer of each k-mer, by a window function. One sequence's positions
    lie in one task; the Arrow kernel has no such need."""
    span = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.currentRow, k - m)
    rows = positions(df, keys, digits, k, m, canonical, seed).withColumn("h", F.min("h").over(span))
    return rows.where("pos <= last").select(*keys, "pos", "h")


def runs_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run (from 1), pos (of its first k-mer, from 0), h, n: neighbouring k-mers with one
    minimizer, from keys, pos (from 1), h."""
    order = Window.partitionBy(*keys).orderBy("pos")
    new = F.coalesce((F.lag("h").over(order) != F.col("h")).cast("long"), F.lit(1).cast("long"))
    marked = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return marked.groupBy(*keys, "run").agg((F.min("pos") - 1).cast("long").alias("pos"), F.min("h").alias("h"), F.count("*").alias("n"))


def naive(seq: str, k: int = K, m: int = M, canonical: bool = True, seed: int = SEED, kind: str = "md5") -> list:
    """The minimizer of each k-mer, by definition."""
    digits = "".join(str((b >> 1) & 3) for b in seq.encode())

    def value(s: str):
        other = s[::-1].translate(str.maketrans("0123", "2301"))
        s = min(s, other) if canonical else s
        if kind == "md5":
            return hashlib.md5(f"{s}|{seed}".encode()).hexdigest()
        return int(finalise(np.array([int(s, 4)], np.uint64), seed)[0])

    return [min(value(digits[i + j : i + j + m]) for j in range(k - m + 1)) for i in range(len(digits) - k + 1)]


class MinimizerTable:
    """A SQL table function: minimizers(seq, k, m) -> pos, h (register_minimizers)."""

    def eval(self, seq: str, k: int, m: int):
        if seq is None:
            return
        data = np.frombuffer(seq.encode(), np.uint8)
        _, pos, least, _ = batch_minimizers(data, np.array([0, len(data)]), *checked(k, m), True, SEED, "mix")
        for p, h in zip(pos.tolist(), least.view(np.int64).tolist()):
            yield p, h


def register_minimizers(spark) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("minimizers", udtf(MinimizerTable, returnType="pos: bigint, h: bigint"))
