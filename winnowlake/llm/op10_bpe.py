"""Byte-level BPE in DuckDB, one database per Python worker (operator 10).

The text is cut by the public pattern; each different match of a batch that the worker does not
know yet goes to DuckDB. A join with the vocabulary finds matches that are a token as a whole. The
others become token-position rows; a recursive query joins neighbouring rows to the merge table,
contracts each word's leftmost pair of least rank, and repeats until no pair is left.

Two recursive queries do the same:

* STEPS keeps the rows of every step, about half the square of a word's bytes; words go through it
  in calls of at most ROWS rows, so its memory is bounded whatever the words.
* LIVE (for a match of more than LONG bytes) keeps a row a position (``USING KEY``), so it holds
  as many rows as the match has bytes. A step takes all occurrences of the least pair, from the
  left, up to the first one that brings a pair of lower rank beside it: what the leftmost-first
  order would do one by one.

Decoding joins ids to their bytes and aggregates them in order.

Defined results: null and empty texts have no tokens and decode to no bytes (the digests are
those of the empty string); texts and matches may have any length; rows are independent, so
repeated rows, ties and extra columns change nothing; a null doc_id stays null; an empty table
gives no rows.
"""

from __future__ import annotations

import array
import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Bytes of a match from which on LIVE is used, and rows that one call of STEPS may make.
LONG, ROWS = 2000, 3_000_000
#: Matches that a worker keeps, tokens of one decoding query, characters handled at once.
KEPT, TOKENS, CHARS = 800_000, 1_000_000, 4_000_000
#: Megabytes that DuckDB may use, and more for each byte of a match that is longer than a megabyte.
MEMORY, PER_BYTE = 400, 0.0004

#: s: a row's id, the next row and its id, and the rank of the pair of both; only a contracted row and the one before it are looked up again.
STEPS = """
WITH RECURSIVE s(w, pos, id, nxt, nid, m, step) AS (
  SELECT a.w, a.pos, a.id, a.nxt, a.nid, g.m, 0
  FROM (SELECT w, pos, id, lead(pos) OVER o AS nxt, lead(id) OVER o AS nid FROM start WINDOW o AS (PARTITION BY w ORDER BY pos)) a
  LEFT JOIN merges g ON g.l = a.id AND g.r = a.nid
  UNION ALL
  (WITH c AS MATERIALIZED (SELECT w, min(m::BIGINT * 4294967296 + pos) AS k, arg_min(nxt, m::BIGINT * 4294967296 + pos) AS gone
         FROM s WHERE m IS NOT NULL GROUP BY w),
   d AS MATERIALIZED (SELECT c.w, (c.k & 4294967295)::INT AS pos, (c.k >> 32)::INT AS id, c.gone, s.nxt, s.nid
         FROM s JOIN c ON c.w = s.w AND c.gone = s.pos),
   t AS MATERIALIZED (SELECT s.w, s.pos, CASE WHEN s.pos = d.pos THEN d.id ELSE s.id END AS id,
           CASE WHEN s.pos = d.pos THEN d.nxt ELSE s.nxt END AS nxt,
           CASE WHEN s.pos = d.pos THEN d.nid WHEN s.nxt = d.pos THEN d.id ELSE s.nid END AS nid,
           s.m, s.step + 1 AS step, s.pos = d.pos OR coalesce(s.nxt = d.pos, false) AS changed
         FROM s JOIN d ON d.w = s.w WHERE s.pos <> d.gone)
   SELECT w, pos, id, nxt, nid, m, step FROM t WHERE NOT changed
   UNION ALL SELECT t.w, t.pos, t.id, t.nxt, t.nid, g.m, t.step FROM t LEFT JOIN merges g ON g.l = t.id AND g.r = t.nid WHERE t.changed)
)
SELECT w, list(id ORDER BY pos) AS ids FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step)
GROUP BY w ORDER BY w
"""

#: s: id (-1: contracted into the row before it), the next live row, and the rank of the pair with it.
LIVE = """
WITH RECURSIVE s(w, pos, id, nxt, m) USING KEY (w, pos) AS (
  SELECT a.w, a.pos, a.id, a.nxt, g.m
  FROM (SELECT w, pos, id, lead(pos) OVER o AS nxt, lead(id) OVER o AS nid FROM start WINDOW o AS (PARTITION BY w ORDER BY pos)) a
  LEFT JOIN merges g ON g.l = a.id AND g.r = a.nid
  UNION
  (WITH least AS MATERIALIZED (SELECT w, min(m) AS m FROM recurring.s GROUP BY w),
   -- overlapping pairs (aaaa) form a run, of which every second one is due
   runs AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS place FROM (
     SELECT *, sum(fresh) OVER (PARTITION BY w ORDER BY pos) AS run FROM (
       SELECT s.w, s.pos, s.nxt, s.m, CASE WHEN lag(s.nxt) OVER (PARTITION BY s.w ORDER BY s.pos) = s.pos THEN 0 ELSE 1 END AS fresh
       FROM recurring.s AS s JOIN least ON least.w = s.w AND least.m = s.m))),
   due AS MATERIALIZED (SELECT w, pos, nxt, m, row_number() OVER (PARTITION BY w ORDER BY pos) AS n FROM runs WHERE place % 2 = 1),
   near AS MATERIALIZED (SELECT s.w, s.pos, s.id, s.nxt, a.pos IS NOT NULL AS gone, b.pos AS before
     FROM recurring.s AS s LEFT JOIN due a ON a.w = s.w AND a.nxt = s.pos LEFT JOIN due b ON b.w = s.w AND b.pos = s.nxt
     WHERE s.id >= 0 AND (a.pos IS NOT NULL OR b.pos IS NOT NULL)),
   made AS MATERIALIZED (SELECT d.w, d.pos, d.nxt AS old, d.m AS id, near.nxt, d.n FROM due d JOIN near ON near.gone AND near.w = d.w AND near.pos = d.nxt),
   -- pairs that a contraction brings about, with the neighbours as they are at its turn
   beside AS (SELECT d.w, d.n, d.id AS l, s.id AS r, d.id AS m FROM made d JOIN recurring.s AS s ON s.w = d.w AND s.pos = d.nxt
     UNION ALL SELECT d.w, d.n, CASE WHEN near.gone THEN d.id ELSE near.id END, d.id, d.id FROM made d JOIN near ON near.w = d.w AND near.before = d.pos),
   lower AS MATERIALIZED (SELECT b.w, min(b.n) AS n FROM beside b JOIN merges g ON g.l = b.l AND g.r = b.r WHERE g.m < b.m GROUP BY b.w),
   taken AS MATERIALIZED (SELECT made.* FROM made LEFT JOIN lower ON lower.w = made.w WHERE lower.n IS NULL OR made.n <= lower.n),
   touched AS MATERIALIZED (SELECT w, pos FROM taken UNION ALL SELECT w, old FROM taken),
   changed AS MATERIALIZED (SELECT w, pos, id, nxt FROM taken
     UNION ALL SELECT near.w, near.pos, near.id, near.nxt FROM near JOIN taken ON taken.w = near.w AND taken.pos = near.before
       ANTI JOIN touched ON touched.w = near.w AND touched.pos = near.pos),
   after AS (SELECT c.w, c.pos, c.id, c.nxt, coalesce(t.id, n.id) AS nid FROM changed c
     LEFT JOIN recurring.s AS n ON n.w = c.w AND n.pos = c.nxt LEFT JOIN taken t ON t.w = c.w AND t.pos = c.nxt)
   SELECT a.w, a.pos, a.id, a.nxt, g.m FROM after a LEFT JOIN merges g ON g.l = a.id AND g.r = a.nid
   UNION ALL SELECT w, old, -1, NULL, NULL FROM taken)
)
SELECT w, list(id ORDER BY pos) AS ids FROM s WHERE id >= 0 GROUP BY w ORDER BY w
"""


class Codec:
    """Encoder and decoder over one DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], m) for t, m in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*pairs))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        merges = pa.table({"l": left, "r": right, "m": merged})  # noqa: F841  DuckDB reads it by name
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "b": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.texts: list[str] = []
        self.ids, self.ends = array.array("i"), array.array("q", [0])

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, none of which is empty, and their lengths."""
        lengths = np.array(list(map(len, words)), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.con.register("start", pa.table({"w": w, "pos": pos.astype(np.int32), "id": self.byte[flat]}))
        most = int(lengths.max())
        if most > LONG:
            self.con.execute(f"SET memory_limit = '{MEMORY + int(max(0, most - 1_000_000) * PER_BYTE)}MB'")
        lists = self.con.sql(LIVE if most > LONG else STEPS).to_arrow_table()["ids"].combine_chunks()
        return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()

    def whole(self, words: list[bytes]) -> dict[int, int]:
        """The token of each word (by its place) that is one as a whole."""
        self.con.register("words", pa.table({"w": np.arange(len(words), dtype=np.int32), "b": pa.array(words, pa.binary())}))
        found = self.con.sql("SELECT w, id FROM words JOIN vocab USING (b)").to_arrow_table()
        return dict(zip(found["w"].to_pylist(), found["id"].to_pylist()))

    def add(self, word: str, ids: list[int]) -> None:
        self.code[word] = len(self.texts)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.texts.append(" ".join(map(str, ids)))

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        known = self.whole(raw)
        for i, token in known.items():
            self.add(words[i], [token])
        todo = sorted(set(range(len(words))) - known.keys(), key=lambda i: len(raw[i]))
        for some in calls([len(raw[i]) for i in todo]):
            flat, lengths = self.contract([raw[i] for i in todo[some]])
            ids, at = flat.tolist(), 0
            for i, n in zip(todo[some], lengths.tolist()):
                self.add(words[i], ids[at : at + n])
                at += n

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Each text's ids, and the same in decimal, joined by one space."""
        if len(self.code) > KEPT:
            self.forget()
        matches = [self.find(t) for t in texts]
        new = set().union(*matches).difference(self.code)
        if new:
            self.learn(sorted(new))
        code, decimal = self.code, self.texts
        all_codes = [[code[w] for w in m] for m in matches]
        counts = np.fromiter(map(len, all_codes), np.int64, len(all_codes))
        codes = np.fromiter(itertools.chain.from_iterable(all_codes), np.int64, int(counts.sum()))
        ends = np.array(self.ends, dtype=np.int64)
        lengths = ends[codes + 1] - ends[codes]
        flat = np.array(self.ids, dtype=np.int32)[common.gather(ends[codes], lengths)]
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [(flat[a:e], " ".join([decimal[c] for c in k])) for a, e, k in zip(cuts[:-1], cuts[1:], all_codes)]

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        lengths = np.array(list(map(len, docs)), np.int64)
        out = [b""] * len(docs)
        if not lengths.sum():
            return out
        ids = np.concatenate(docs).astype(np.int32)
        d = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        for i in range(0, len(ids), TOKENS):
            self.con.register("tok", pa.table({"d": d[i : i + TOKENS], "p": np.arange(i, min(i + TOKENS, len(ids))), "id": ids[i : i + TOKENS]}))
            got = self.con.sql("SELECT d, list(b ORDER BY p) AS b FROM tok JOIN vocab USING (id) GROUP BY d").to_arrow_table()
            for chunk in got.to_batches():
                lists = chunk["b"]
                # the bytes of a list's neighbouring values are neighbours
                values = lists.values.cast(pa.large_binary())
                ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
                data = values.buffers()[2]
                at = ends[np.asarray(lists.offsets)]
                for k, a, e in zip(chunk["d"].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    out[k] += data[a:e].to_pybytes()
        return out


_codecs: dict = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def calls(sizes: list[int]) -> list[slice]:
    """Slices of words, given by their bytes in ascending order, for one call each."""
    out, first, rows = [], 0, 0
    for i, n in enumerate(sizes):
        # a longer match than LONG has a call of its own
        if i > first and (n > LONG or rows + n * (n + 1) // 2 > ROWS):
            out.append(slice(first, i))
            first, rows = i, 0
        rows += n * (n + 1) // 2
    return [*out, slice(first, len(sizes))] if sizes else out


def runs(sizes: list[int], most: int) -> list[slice]:
    """Slices of neighbouring texts of about most characters together."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append(slice(first, i))
            first, total = i, 0
        total += n
    return [*out, slice(first, len(sizes))] if sizes else out


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each text."""
    path, pattern = vocabulary or common.vocabulary_path(BYTE_BPE), pattern or public_pattern()
    common.small_batches(docs.sparkSession)

    def each(batches):
        c = codec(path, pattern)
        for b in common.parts(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            for s in runs(list(map(len, texts)), CHARS):
                ids = [x for x, _ in c.encode(texts[s])]
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"][s], "ids": pa.array(ids, pa.list_(pa.int32()))})

    return common.id_text(docs).mapInArrow(each, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, decoded (the bytes that the ids stand for)."""
    path, pattern = vocabulary or common.vocabulary_path(BYTE_BPE), public_pattern()
    common.small_batches(ids.sparkSession)

    def each(batches):
        c = codec(path, pattern)
        for b in common.parts(batches):
            docs = [np.array(x or [], np.int32) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "decoded": pa.array(c.decode(docs), pa.binary())})

    return ids.select("doc_id", "ids").mapInArrow(each, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of each text's ids and of what they decode to, in one pass over the texts."""
    path, pattern = vocabulary or common.vocabulary_path(BYTE_BPE), pattern or public_pattern()
    common.small_batches(docs.sparkSession)

    def each(batches):
        c = codec(path, pattern)
        for b in common.parts(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            for s in runs(list(map(len, texts)), CHARS):
                coded = c.encode(texts[s])
                plain = c.decode([ids for ids, _ in coded])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"][s],
                    "n_tokens": pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in coded]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                })

    return common.id_text(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
