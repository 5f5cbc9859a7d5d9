"""Colour sets of a collection without a table of its documents' minimizers.

A minimizer's hash follows from its m-mer, which needs 2m bits instead of a hash's 64 or 128 (as text 256).
So m-mers are shuffled, dealt by themselves: those of a part of a batch in one row for each bucket, with each
document's digests once. A bucket has all documents of its m-mers; it hashes them again and returns each of
its sets once, with the least hash there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minimizers

#: Bytes of sequences of which a bucket holds the m-mers (a tenth as many, or so), and buckets at most.
BUCKET_BYTES, BUCKETS = 25_000_000, 1 << 16
SIGN = np.uint64(1 << 63)


def pack(own: np.ndarray, mers: np.ndarray, d1: np.ndarray, d2: np.ndarray, width: int) -> bytes:
    """Documents (rows of d1, d2 that own counts, ascending) and their m-mers, width bytes each."""
    first = minimizers.starts_of(own)
    counts = np.diff(np.concatenate([first, [len(own)]])).astype("<i8")
    data = np.ascontiguousarray(mers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return b"".join(x.tobytes() for x in (np.array([len(first)], "<i8"), d1[own[first]], d2[own[first]], counts.astype("<u4"), data))


def unpack(blob, width: int):
    """d1, d2 and number of m-mers of each document, and all m-mers."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    d1, d2 = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i8", n, 8 + 8 * n)
    counts = np.frombuffer(blob, "<u4", n, 8 + 16 * n).astype(np.int64)
    data = np.zeros((int(counts.sum()), 8), np.uint8)
    data[:, :width] = np.frombuffer(blob, np.uint8, len(data) * width, 8 + 20 * n).reshape(-1, width)
    return d1, d2, counts, data.view("<u8").ravel()


def distinct_pairs(a: np.ndarray, b: np.ndarray, bits_b: int, bits_a: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of numbers below 2**bits, in order."""
    if bits_a + bits_b <= 64:
        key = a.astype(np.uint64)
        key <<= np.uint64(bits_b)
        key |= b.astype(np.uint64, copy=False)
        key.sort()
        key = key[minimizers.starts_of(key)]
        return key >> np.uint64(bits_b), key & np.uint64((1 << bits_b) - 1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = minimizers.starts_of(a, b)
    return a[first], b[first]


def sets_of(blobs, m: int, seed: int, kind: str):
    """size, d1, d2 (as index.digest_sets has them) and the least hash, in two numbers that are ordered as signed
    ones, of the sets of a bucket's m-mers. A set may come twice if others share its d1."""
    parts = [unpack(b, (2 * m + 7) // 8) for b in blobs]
    d1, d2, counts, mers = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((d2, d1))  # a document may come in several rows
    first = minimizers.starts_of(d1[order], d2[order])
    doc = np.empty(len(d1), np.int64)
    doc[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
    d1, d2 = d1[order][first], d2[order][first]
    mers, doc = distinct_pairs(mers, np.repeat(doc, counts), max(1, len(d1).bit_length()), 2 * m)
    doc = doc.astype(np.int64)
    first = minimizers.starts_of(mers)
    size = np.diff(np.concatenate([first, [len(mers)]]))
    x1, x2 = np.bitwise_xor.reduceat(d1[doc], first), np.bitwise_xor.reduceat(d2[doc], first)
    mers = mers[first]
    del doc
    order = np.argsort(x1, kind="stable")
    size, x1, x2, mers = size[order], x1[order], x2[order], mers[order]
    first = minimizers.starts_of(x1, x2, size)
    hi, lo = (minimizers.finalise(mers, seed) ^ SIGN, np.zeros(len(mers), np.uint64)) if kind == "mix" else minimizers.md5_digests(mers, m, seed)
    least = np.minimum.reduceat(hi, first)
    lo[hi != np.repeat(least, np.diff(np.concatenate([first, [len(hi)]])))] = np.uint64(2**64 - 1)
    signed = lambda x: (x ^ SIGN).view(np.int64)
    return size[first], x1[first], x2[first], signed(least), signed(np.minimum.reduceat(lo, first))


def hash_of(hi: Column, lo: Column, kind: str) -> Column:
    """The hash, as minimizers.minimizers has it."""
    if kind == "mix":
        return hi
    return F.concat(*(F.lower(F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")) for x in (hi, lo)))


def color_sets(docs: DataFrame, seq: str = "seq", k: int = minimizers.K, m: int = minimizers.M, canonical: bool = True, seed: int = minimizers.SEED, kind: str = "mix") -> DataFrame:
    """size, d1, d2, rep of all colour sets of documents' minimizers (the sequences of a document may be several rows)."""
    minimizers.checked(k, m)
    total = docs.agg(F.sum(F.octet_length(seq))).first()[0] or 0
    buckets, width = min(BUCKETS, 1 + total // BUCKET_BYTES), (2 * m + 7) // 8
    rows = docs.select(F.xxhash64("doc_id").alias("_d1"), F.xxhash64(F.lit(7), "doc_id").alias("_d2"), F.col(seq).alias("_seq"))

    def each(batches):
        for b in batches:
            d1, d2 = (b[c].to_numpy(zero_copy_only=False) for c in ("_d1", "_d2"))
            for at, _, data, offsets in minimizers.pieces(b["_seq"], k):
                own, *_, mers = minimizers.batch_hashes(data, offsets, k, m, canonical, seed, kind, mers=True)
                if not len(own):
                    continue
                first = minimizers.starts_of(own, mers)
                own, mers = distinct_pairs(own[first], mers[first], 2 * m, max(1, len(offsets).bit_length()))
                slot = (mers * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) * buckets >> 16
                order = np.argsort(slot.astype(np.uint16), kind="stable")
                own, mers, slot = own[order].astype(np.int64) + at, mers[order], slot[order]
                first = minimizers.starts_of(slot)
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(slot)]):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(slot[a])], pa.int32()), "mers": pa.array([pack(own[a:z], mers[a:z], d1, d2, width)], pa.binary())})

    def one(table):
        names = ("size", "d1", "d2", "hi", "lo")
        return pa.table(dict(zip(names, map(pa.array, sets_of([x.as_buffer() for x in table["mers"]], m, seed, kind)))))

    dealt = rows.mapInArrow(each, "bucket int, mers binary").repartition(buckets, "bucket")
    found = dealt.groupBy("bucket").applyInArrow(one, "size long, d1 long, d2 long, hi long, lo long")
    least = found.groupBy("size", "d1", "d2").agg(F.min(F.struct("hi", "lo")).alias("x"))
    return least.select("size", "d1", "d2", hash_of(F.col("x.hi"), F.col("x.lo"), kind).alias("rep"))
