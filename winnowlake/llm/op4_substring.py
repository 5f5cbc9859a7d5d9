"""Substring dedup by relative Lempel-Ziv parsing (operator 4).

Every document is factored against the documents of smaller doc_id, in units of phrases (runs of
WINDOW words). Equal phrases share their anchor, the least hash among their ANCHOR-word shingles.
Neighbouring phrases with one anchor form a block (about twenty phrases); blocks are cut by
content alone, so a shared passage gives equal blocks but for its ends.

1. Blocks: a reference table holds each different block with its smallest doc_id and the place
   there. A document's block that a smaller doc_id has is matched as a whole.
2. Factor boundaries: where an anchor has several different blocks, a passage begins or ends
   inside them. The phrases of these blocks' first documents are indexed one by one; a phrase
   that a smaller doc_id has is matched.

So every phrase that a smaller doc_id has comes with a reference: document and place. The parse is
greedy: a factor starts at the first phrase that has one and runs on as long as the next phrase
stands next to it in the same reference, so each factor is a run of words of its source. Where the
reference ends, the next factor starts at the next phrase that has one, which may overlap it.
Factors have WINDOW words or more by construction; words under a factor are removed. Blocks and
phrases are compared by 128 bits of hash.

Shuffles hold hashes of blocks, and phrases of boundary blocks only; texts are shuffled only where
a bitmap of bounded size says that their document is concerned. Frequent keys are aggregated
before the shuffle, and joins on them are inner or left joins that Spark splits when skewed.

Defined results: null text has no words and keeps its row; texts of fewer than WINDOW words lose
nothing; repeats inside one document stay; rows with a null doc_id, or with the same doc_id, are no
reference for each other, so repeated rows stay as they are; where a source has a phrase at several
places, a factor names any one of them; texts may have any length; extra columns are ignored by
dedup and carried by keep, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

WINDOW = 50
ANCHOR = 10
#: Odd bases of the two polynomial hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of each run of size hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n - size + 1, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(up), out=sums[1:])
        return common.mix((sums[size:] - sums[:-size]) * np.cumprod(down))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(texts, window: int, anchor: int, full: bool):
    """Of all phrases of the texts: document, start, anchor and, if full, both hashes."""
    offsets, words = common.split_words(texts)
    codes, distinct = common.coded_words(words)
    h = common.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(len(h) - window + 1, 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[len(doc) - n :]
    least = sliding_min(rolling(h, anchor, BASES[0]), window - anchor + 1)[:n] if n else h
    own = doc[:n][inside]
    out = [own, (np.arange(n) - offsets[doc[:n]])[inside], least[inside]]
    return out + [rolling(h, window, b)[inside] for b in BASES] if full else out


def blocks(texts, window: int, anchor: int):
    """Of all blocks of the texts: document, first start, number of phrases, anchor and content
    hash; and the phrases themselves (block, start, two hashes)."""
    own, start, least, one, two = phrases(texts, window, anchor, True)
    if not len(own):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), (empty, start, one, two)
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (least[1:] != least[:-1])]))
    n = np.diff(np.concatenate([first, [len(own)]]))
    block = np.repeat(np.arange(len(first)), n)
    # phrases in order: each one's hash is weighted by its place
    with np.errstate(over="ignore"):
        place = (np.arange(len(own)) - first[block]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        content = common.mix(np.add.reduceat(common.mix(two + place) * place, first) + n.astype(np.uint64))
    return own[first], start[first], n, least[first], content, (block, start, one, two)


def parse(starts: np.ndarray, sizes: np.ndarray, sources: np.ndarray, places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, reference document, place there) from matches (first phrase,
    phrases, reference document, place there)."""
    order = np.lexsort((-sizes, starts))
    out: list[list[int]] = []  # start, end (both in phrases), source, place
    for a, n, s, p in zip(*(x[order].tolist() for x in (starts, sizes, sources, places))):
        last = out[-1] if out else None
        if last and a + n <= last[1]:
            continue  # inside the factor that runs
        if last and a <= last[1] and s == last[2] and p - a == last[3] - last[0]:
            last[1] = a + n
        else:
            out.append([a, a + n, s, p])
    return [(a, e - a - 1 + window, s, p) for a, e, s, p in out]


def matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, check (CRC-32 of the text) and m, an array of (start, n, source, at): matched phrases
    and where the reference document has them."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = common.id_text(docs).where("doc_id is not null and text is not null").withColumn("check", F.crc32("text"))

    def cut_blocks(batches):
        for b in common.parts(batches):
            own, start, n, h, g, _ = blocks(b["text"], window, anchor)
            at = pa.array(own)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].take(at), "check": b["check"].take(at), "h": pa.array(h.view(np.int64)), "g": pa.array(g.view(np.int64)), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32())})

    found = common.settled(spark, texts.mapInArrow(cut_blocks, "doc_id long, check long, h long, g long, start int, n int"), "blocks")
    table = found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.min_by("start", "doc_id").alias("at"), F.max("doc_id").alias("last"))
    table = common.settled(spark, table, "references")
    shared = table.where("first < last").select("h", "g", F.col("first").alias("source"), "at")
    whole = found.join(shared, ["h", "g"]).where("source < doc_id").select("doc_id", "check", "start", "n", "source", "at")

    several = table.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("a"), F.max("last").alias("b")).where("kinds > 1 and a < b").select("h")
    several = common.settled(spark, several, "boundaries")
    wanted = table.join(several, "h").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("g").alias("wanted"))
    wanted = common.settled(spark, wanted, "wanted")

    def cut_phrases(batches):
        for b in common.parts(batches):
            own, _, _, _, g, (block, start, one, two) = blocks(b["text"], window, anchor)
            lists = b["wanted"]
            lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            known, code = np.unique(np.asarray(lists.flatten()).view(np.uint64), return_inverse=True)
            pairs = np.sort(np.repeat(np.arange(len(lengths)), lengths) * (len(known) + 1) + code)
            at = np.searchsorted(known, g)
            at[at == len(known)] = 0
            key = own * (len(known) + 1) + at
            spot = np.searchsorted(pairs, key)
            spot[spot == len(pairs)] = 0
            hit = (known[at] == g) & (pairs[spot] == key) if len(pairs) else np.zeros(len(g), bool)
            keep = np.flatnonzero(hit[block])
            rows = pa.array(own[block[keep]])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].take(rows), "check": b["check"].take(rows), "start": pa.array(start[keep], pa.int32()), "one": pa.array(one[keep].view(np.int64)), "two": pa.array(two[keep].view(np.int64))})

    concerned = common.id_filter(wanted.select("doc_id"))(texts, True)
    single = concerned.join(wanted, "doc_id").mapInArrow(cut_phrases, "doc_id long, check long, start int, one long, two long")
    single = common.settled(spark, single, "phrases")
    index = single.groupBy("one", "two").agg(F.min("doc_id").alias("source"), F.min_by("start", "doc_id").alias("at"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    index = common.settled(spark, index, "index")
    at_ends = single.join(index, ["one", "two"]).where("source < doc_id").select("doc_id", "check", "start", F.lit(1).alias("n"), "source", "at")
    both = whole.unionByName(at_ends)
    return common.settled(spark, both.groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "n", "source", "at")).alias("m")), "matches")


def with_matches(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """rows (row, doc_id, text) with the column m (null: no match). Documents without a match are
    not shuffled."""
    found = matches(rows, window, anchor)
    split = common.id_filter(found.select("doc_id").distinct())
    checked = rows.withColumn("check", F.crc32("text"))
    joined = split(checked, True).join(found, ["doc_id", "check"], "left").select("row", "doc_id", "text", "m")
    return split(rows, False).withColumn("m", F.lit(None).cast(dict(found.dtypes)["m"])).unionByName(joined)


def cut(text, m, window: int) -> tuple[int, list, pa.Array]:
    """A text's number of words, its factors, and the words that no factor covers."""
    _, words = common.split_words(pa.array([text], pa.large_string()))
    factors = parse(*(np.asarray(m.values.field(k)) for k in ("start", "n", "source", "at")), window) if m.is_valid else []
    keep = np.ones(len(words), bool)
    for a, size, _, _ in factors:
        keep[a : a + size] = False
    return len(words), factors, words.filter(pa.array(keep)) if factors else words


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the words left, joined by one space;
    with digest their SHA-256 in hex), factors (start, words, source, at: words of this document
    from start on are words of source from at on)."""
    names, kinds = ["start", "words", "source", "at"], [pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct(list(zip(names, kinds))))]
    columns = ["doc_id", "n_words", "n_removed", "kept", "factors"]

    def each(batches):
        for b in common.parts(batches):
            out = []
            for key, text, m in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["m"]):
                n, factors, kept = cut(text, m, window)
                joined = b" ".join(kept.cast(pa.large_binary()).to_pylist())
                out.append((key, n, n - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode(), [dict(zip(names, f)) for f in factors]))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=columns)

    rows = with_matches(common.id_text(docs).select(F.lit(None).cast("int").alias("row"), "doc_id", "text"), window, anchor)
    return rows.drop("row").mapInArrow(each, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: int, words: int, source: long, at: int>>")


def keep(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with duplicate words removed from text (and n_chars to match, if there is one). A
    text that loses words has the rest joined by one space; others stay as they are; a document
    that loses all its words goes."""
    names = docs.columns

    def each(batches):
        for b in common.parts(batches, "row.text"):
            hit = np.flatnonzero(np.asarray(b["m"].is_valid()))
            row = b["row"]
            cols = [row.field(i) for i in range(len(names))]
            texts, gone = cols[names.index("text")].to_pylist(), set()
            for i in hit.tolist():
                _, _, kept = cut(texts[i], b["m"][i], window)
                texts[i] = " ".join(kept.to_pylist())
                if not len(kept):
                    gone.add(i)
            if "n_chars" in names:
                old = cols[names.index("n_chars")].to_pylist()
                for i in hit.tolist():
                    old[i] = len(texts[i])
                cols[names.index("n_chars")] = pa.array(old, cols[names.index("n_chars")].type)
            cols[names.index("text")] = pa.array(texts, pa.string())
            made = pa.StructArray.from_arrays(cols, fields=[pa.field(f.name, c.type) for f, c in zip(row.type, cols)])
            yield pa.RecordBatch.from_arrays([made], names=["row"]).filter(pa.array([i not in gone for i in range(len(texts))]))

    rows = with_matches(common.packed(docs), window, anchor).select("row", "m")
    return common.unpacked(rows.mapInArrow(each, StructType([StructField("row", docs.schema)])))


def op4_substring(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: The same by string comparison of whole phrases.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS phrase FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT phrase, min(doc_id) AS first FROM p GROUP BY phrase),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM (SELECT p.doc_id, p.i FROM p JOIN f USING (phrase) WHERE f.first < p.doc_id), range(50) o(k) GROUP BY doc_id),
u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT u.doc_id, array_to_string(list(ws[i] ORDER BY i), ' ') AS kept, count(*) AS n FROM u LEFT JOIN c ON c.doc_id = u.doc_id WHERE c.gone IS NULL OR NOT list_contains(c.gone, i) GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
