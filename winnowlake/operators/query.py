"""Ranked threshold queries: which documents hold at least a share of a query's k-mers.

Counts are summed per colour set before sets are expanded, so the expansion has one row for each
query, set and document instead of one for each minimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode, minimizers
from .index import Index, pruned, sought


def query_minimizers(queries: DataFrame, seq: str = "seq", **options) -> DataFrame:
    """qid, h, n of the queries' minimizers."""
    return minimizers.minimizers(queries, ["qid"], seq, **options).groupBy("qid", "h").agg(F.sum("n").alias("n"))


def joined(doc_min: DataFrame, query_min: DataFrame) -> DataFrame:
    """qid, doc_id, h, n: each query's minimizers with the documents (doc_id, h) that have them."""
    return doc_min.join(query_min, "h").select("qid", "doc_id", "h", "n")


def set_counts(query_min: DataFrame, minimizer_map: DataFrame) -> DataFrame:
    """qid, cid, n: k-mers of each query whose minimizer has that colour set."""
    return query_min.join(minimizer_map, "h").groupBy("qid", "cid").agg(F.sum("n").alias("n"))


def scores(counts: DataFrame, colors: DataFrame) -> DataFrame:
    """qid, doc_id, score."""
    return counts.join(colors, "cid").groupBy("qid", "doc_id").agg(F.sum("n").alias("score"))


def placed(scored: DataFrame) -> DataFrame:
    """qid, doc_id, score, place: all scored documents of a query, best first, ties to the smaller doc_id."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def kmers(queries: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return queries.select("qid", encode.n_kmers(F.coalesce(F.col(seq), F.lit("")), k).alias("n_kmers"))


def ranked(scored: DataFrame, n: DataFrame, ratio: float = 1.0, top_k: int | None = None) -> DataFrame:
    """qid, doc_id, score, n_kmers, rank: hits at or above the threshold, best first, ties to the
    smaller doc_id. top_k is an extension: without it every hit is returned."""
    ratio = encode.guarded_ratio(ratio)
    hits = scored.join(n, "qid").where(F.col("score") >= encode.threshold(F.col("n_kmers"), ratio))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_k) if top_k else out


def run(index: Index, queries: DataFrame, ratio: float = 1.0, seq: str = "seq", top_k: int | None = None) -> DataFrame:
    """Hits of queries (qid and a sequence column) in an index."""
    o = index.meta
    q = query_minimizers(queries, seq, k=o["k"], m=o["m"], canonical=o["canonical"], seed=o["seed"], kind=o["hash"])
    return ranked(scores(set_counts(q, pruned(index, q)), index.colors), kmers(queries, o["k"], seq), ratio, top_k)


def run_direct(docs: DataFrame, queries: DataFrame, ratio: float = 1.0, seq: str = "seq", **options) -> DataFrame:
    """The same without an index: documents' minimizers are joined on the fly; only those
    that a query has are shuffled."""
    k = options.get("k", minimizers.K)
    q = query_minimizers(queries, seq, **options)
    d = sought(docs, q, seq, queries, **options)
    return ranked(joined(d, q).groupBy("qid", "doc_id").agg(F.sum("n").alias("score")), kmers(queries, k, seq), ratio)


def lines(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, line: the text form ``name \\t n \\t (doc,score) ...``; queries without hits have n = 0.

    A line holds all hits of its query, as the format demands."""
    pair = F.struct("rank", F.concat(F.lit("("), F.col("doc_id"), F.lit(","), F.col("score"), F.lit(")")).alias("t"))
    made = hits.groupBy("qid").agg(F.sort_array(F.collect_list(pair)).alias("p"))
    pairs = F.coalesce(F.transform("p", lambda x: x["t"]), F.array().cast("array<string>"))
    out = queries.select("qid", "name").join(made, "qid", "left")
    return out.select("qid", F.concat_ws("\t", F.concat(F.array(F.col("name"), F.size(pairs).cast("string")), pairs)).alias("line"))


def semi_contained(query_min: DataFrame, minimizer_map: DataFrame) -> DataFrame:
    """Query minimizers that the index has."""
    return query_min.join(minimizer_map, "h", "left_semi")


def anti_alien(query_min: DataFrame, minimizer_map: DataFrame) -> DataFrame:
    """Query minimizers that the index does not have."""
    return query_min.join(minimizer_map, "h", "left_anti")


def alien_filter(query_min: DataFrame, slots: DataFrame, n_slots: int, b: int) -> DataFrame:
    """Emulates a lookup without stored keys: a minimizer reads the slot pmod(h, n_slots) and
    passes if b check bits agree. slots: slot, packed. An exact join needs none of this."""
    probe = query_min.withColumn("slot", F.pmod("h", F.lit(n_slots)))
    return probe.join(slots, "slot").where(encode.check_bits(F.col("packed"), b) == encode.check_bits(F.col("h"), b)).withColumn("cid", encode.unpack_cid(F.col("packed"), b))
