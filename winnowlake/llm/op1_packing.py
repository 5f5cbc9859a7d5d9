"""Lexical retrieval packing (operator 1).

Documents are dealt to shards of a bounded amount of text by a hash of their row. Each shard builds
a BM25 inverted index over its own documents. A seed (the first unused document by doc_id, or
the document whose tail opens a window) asks the index for its unused neighbours, which fill its
window of 4096 tokens one after the other, best first; a document that does not fit is cut and its
rest opens the next window. A seed asks with its heaviest terms; when no answer is left and its
window isn't full, also with the next ones, to its last; only then does the next unused document follow. So each
window but a shard's last is full. The last is cut into sequences whose lengths are powers of two,
which need no padding.

Defined results: null and empty texts are one piece (the end id alone); repeated rows, also of a
null doc_id, are documents of their own; ties in BM25 go to the smaller doc_id; a text of any length
is cut as often as it takes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
END_ID = 2
#: Documents of a shard on average, and bytes of text, whichever makes more shards.
DOCS_PER_SHARD, SHARD_BYTES = 2048, 16_000_000
#: Terms, by descending BM25 weight, with which a seed asks at once.
QUERY_TERMS = 24
K1, BETA = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long, seed_doc_id long"


class BM25:
    """Inverted index of one shard: postings by term with their weights, and each document's postings."""

    def __init__(self, offsets: np.ndarray, codes: np.ndarray, n_terms: int):
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        pairs, tf = np.unique(codes * max(n, 1) + np.repeat(np.arange(n), lengths), return_counts=True)
        term, self.doc = (pairs // max(n, 1)).astype(np.int32), (pairs % max(n, 1)).astype(np.int32)
        del pairs
        self.starts = np.searchsorted(term, np.arange(n_terms + 1))
        self.df = np.diff(self.starts)
        idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - BETA + BETA * lengths / max(lengths.mean() if n else 1, 1))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.term, self.n = term, n
        self.by_doc = np.argsort(self.doc, kind="stable").astype(np.int32)
        self.first = np.searchsorted(self.doc[self.by_doc], np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray, step: int = QUERY_TERMS):
        """Unused documents that share a term with seed: first those that its step heaviest terms find,
        best first, then, as long as more are asked for, those that the next step terms add, and so on
        to its last term. Scores add up over the terms asked."""
        own = self.by_doc[self.first[seed] : self.first[seed + 1]]
        own = own[self.df[self.term[own]] > 1]  # a term of one document finds no neighbour
        terms = self.term[own[np.argsort(-self.weight[own], kind="stable")]]
        score = np.zeros(self.n)
        for i in range(0, len(terms), step):
            asked = terms[i : i + step]
            at = common.gather(self.starts[asked], self.df[asked])
            score += np.bincount(self.doc[at], self.weight[at], self.n)
            found = np.flatnonzero((score > 0) & unused)
            yield from found[np.argsort(-score[found], kind="stable")].tolist()


def plan(lengths: np.ndarray, index: BM25, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, seed) of all pieces of a shard."""
    pieces, unused = [], np.ones(len(lengths), bool)
    sequence, filled, seed, queue, following = 0, 0, -1, iter(()), 0
    while True:
        doc = next((int(x) for x in queue if unused[x]), None)
        if doc is None:
            while following < len(lengths) and not unused[following]:
                following += 1
            if following == len(lengths):
                break
            doc = following
            seed, queue = doc, None
        unused[doc] = False
        start = 0
        while start < lengths[doc]:
            if not filled and queue is not None and seed != doc:  # its rest, or all of it, opens a window
                seed, queue = doc, None
            take = int(min(lengths[doc] - start, window - filled))
            pieces.append((doc, start, take, sequence, filled, seed))
            start, filled = start + take, filled + take
            if filled == window:
                sequence, filled = sequence + 1, 0
        if queue is None:
            queue = index.neighbours(seed, unused) if filled else iter(())
    return halved(pieces, sequence, filled)


def halved(pieces: list, sequence: int, filled: int) -> list:
    """The last, part-filled sequence cut into sequences of powers of two."""
    out, last = [p for p in pieces if p[3] != sequence], [p for p in pieces if p[3] == sequence]
    room, done = (1 << filled.bit_length()) >> 1, 0
    for doc, start, length, _, _, seed in last:
        while length:
            if done == room:
                filled, sequence, done = filled - room, sequence + 1, 0
                room = (1 << filled.bit_length()) >> 1
            take = min(length, room - done)
            out.append((doc, start, take, sequence, done, seed))
            start, length, done = start + take, length - take, done + take
    return out


def pack(docs: DataFrame, window: int = WINDOW, docs_per_shard: int = DOCS_PER_SHARD, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: SCHEMA. sequence_id is shard << 32 plus the place in the shard."""
    spark, path = docs.sparkSession, vocabulary or common.vocabulary_path(common.WORD_BPE)
    common.small_batches(spark)
    rows = common.id_text(docs)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, math.ceil(size["n"] / docs_per_shard), math.ceil((size["bytes"] or 0) / SHARD_BYTES))

    def shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        keys = t["doc_id"].to_pylist()
        number = t["shard"][0].as_py()
        offsets, codes, distinct = common.coded_texts(t["text"])
        index = BM25(offsets, codes.astype(np.int64), len(distinct))
        ids, ends = common.coded_ids(offsets, codes, distinct, path, end_id)
        del codes, distinct
        common.release()
        pieces = plan(np.diff(ends), index, window)
        out = [(keys[d], s, n, common.crc(ids[ends[d] + s : ends[d] + s + n]), int(ends[d + 1] - ends[d]), (number << 32) + q, o, number, keys[seed]) for d, s, n, q, o, seed in pieces]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        made = pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(names)})
        del t, index, ids, ends, pieces, out
        common.release()  # the worker outlives the shard
        return made

    # by row, so that rows of one id, or without one, don't meet in a shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(shard, SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
