"""Approximate nearest neighbours by a permutation index (operator 8).

Pivots are a sample of the vectors, about as many as the root of their number. A vector is
represented by its PREFIX nearest pivots in order and posted, with its place in that order, in the
inverted file of each of them. A query opens the files of its own PREFIX pivots. Spearman's footrule
between two orders (a pivot beyond the prefix counts as the place after it) is a constant less twice
the sum, over pivots that both have, of PREFIX less the greater of the two places: postings add that
up by vector, so vectors are ranked by footrule on ids alone. The best share of them, RERANK, is
reranked by the exact distance; the rest is never touched.

The index is cut into sections by a hash of vec_id; each section has its own inverted files over
its own vectors, so a vector lies in one place, is shuffled once, and its postings are merged
before it is reranked. Queries are cut into blocks, and each block meets each section in one task:
both sides of a task are bounded. Every section reranks the same share of its own.

Work of a query over n vectors with m pivots: PREFIX * PREFIX / m * n additions of small integers and
RERANK * n exact distances, with m distances to pivots for each vector once. With exact=True every
vector is reranked: the same result as brute force, in the same blocks.

Equal vectors are one entry: it keeps its smallest vec_ids, one more than a result holds, which
is all that any result can need. Equal query vectors are searched once.

Defined results: vectors that are null, zero, of odd length (other than the most frequent one),
or hold a null or non-finite component take no part, as do rows with a null vec_id; of several
vectors with one vec_id the least (component by component) counts, so repeated rows count once; ties
go to the smaller vec_id; fewer candidates than K give fewer rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Pivots at least; places of an order; share of all vectors that a query reranks, and vectors at least.
MIN_PIVOTS, PREFIX, RERANK, LEAST = 256, 40, 0.15, 500
#: Vectors of a section at most (about) and at least, if there are few; queries of a block; bytes of all pivots.
SECTION, LEAST_SECTION, BLOCK, PIVOT_BYTES = 32_768, 2048, 4096, 64_000_000


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of float or double): the rows that take part, one for each vec_id."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~F.coalesce(bad, F.lit(True))).where(F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return v.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """Different vectors: vec_id (the smallest), embedding, ids (the smallest vec_ids, at most keep)."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    # the limit on row_number is applied before the shuffle too, so that copies don't travel
    first = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids")


def ranks(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first (ties: the smaller number)."""
    d = ((pivots**2).sum(1) - 2 * x @ pivots.T).round(12)
    prefix = min(prefix, len(pivots))
    if prefix < len(pivots):
        some = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


class Files:
    """The pivots' inverted files of a section: entries that have a pivot in their prefix, and its place there."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.prefix = orders.shape
        flat = orders.ravel()
        at = np.argsort(flat, kind="stable")
        self.entry = (at // self.prefix).astype(np.int32)
        self.place = (at % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[at], np.arange(n_pivots + 1))

    def gains(self, order: np.ndarray) -> np.ndarray:
        """For each entry what its footrule distance to order falls short of the greatest, halved."""
        lengths = self.starts[order + 1] - self.starts[order]
        at = common.gather(self.starts[order], lengths)
        place = np.maximum(np.repeat(np.arange(self.prefix, dtype=np.int32), lengths), self.place[at])
        return np.bincount(self.entry[at], self.prefix - place, self.n)


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    """Lists of equal length as rows."""
    if not len(column):
        return np.zeros((0, 0), kind)
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(values, dtype=kind).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: float = RERANK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (rows of vectors)."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    index = common.settled(spark, entries(clean(vectors), k + 1), "entries")
    n = index.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    width = len(index.select("embedding").first()[0])
    m = int(min(n, max(MIN_PIVOTS, math.isqrt(n)), max(MIN_PIVOTS, PIVOT_BYTES // (8 * width))))
    rows = index.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
    sent = spark.sparkContext.broadcast(np.array([r["embedding"] for r in rows], float))  # PIVOT_BYTES at most
    sections = max(1, math.ceil(n / SECTION), min(2 * common.partitions(spark), n // LEAST_SECTION))

    def ordered(df: DataFrame) -> DataFrame:
        def each(batches):
            for b in batches:
                order = ranks(matrix(b["embedding"], float), sent.value, PREFIX) if b.num_rows else np.zeros((0, 1))
                flat, size = pa.array(order.ravel(), pa.int32()), order.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * size, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["embedding"], lists], names=["vec_id", "embedding", "order"])

        kind = f"vec_id long, embedding {dict(df.dtypes)['embedding']}, order array<int>"
        return df.select("vec_id", "embedding").mapInArrow(each, kind)

    asked = clean(queries)
    different = common.settled(spark, ordered(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))), "queries")
    blocks = max(1, math.ceil(different.count() / BLOCK))
    part = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = different.withColumn("block", part(blocks)).withColumn("section", every(sections))
    right = ordered(index).withColumn("section", part(sections)).withColumn("block", every(blocks))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # the two sides share no column

    def rank(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(entries):
            x, ids = matrix(entries["embedding"], float), entries["vec_id"].to_numpy()
            files = Files(matrix(entries["order"], np.int64), len(sent.value))
            most = len(ids) if exact else min(len(ids), max(k + 1, math.ceil(rerank * len(ids)), math.ceil(LEAST * len(ids) / n)))
            for name, vector, order in zip(queries["vec_id"].to_numpy(), matrix(queries["embedding"], float), matrix(queries["order"], np.int64)):
                at = np.argpartition(-files.gains(order), most - 1)[:most] if most < len(ids) else np.arange(len(ids))
                d = np.sqrt(((x[at] - vector) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[: k + 1]
                out.append((np.full(len(best), name), ids[at][best], d[best]))
        q, e, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": pa.array(q, pa.int64()), "e": pa.array(e, pa.int64()), "score": pa.array(d, pa.float64())})

    near = left.groupBy("section", "block").cogroup(right.groupBy("section", "block")).applyInArrow(rank, "q long, e long, score double")
    best = Window.partitionBy("q").orderBy("score", "e")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # from different vectors to vec_ids, and from different queries to all of them
    members = near.join(index.select(F.col("vec_id").alias("e"), "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    members = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = members.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    names = asked.join(different.select("embedding", F.col("vec_id").alias("q")), "embedding").select(F.col("vec_id").alias("query_id"), "q")
    own = names.join(lists, "q").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op8_permutation(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
