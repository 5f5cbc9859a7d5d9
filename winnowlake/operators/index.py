"""The index: minimizer -> colour set, with equal sets stored once.

In memory, colour sets stay in long form (one row per set and document), so a set may hold any
number of documents; stored, they are cut into chunks of 65,536 document ids, each in the shortest
of three forms. Whether two minimizers have the same set is decided by two order-free 64-bit digests
and the size of the set, which Spark aggregates before it shuffles; no set is ever gathered.
A colour set is named by a dense id in order of its least minimizer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import colors, minimizers
from . import packed

#: Minimizers of a partition of the stored map, and partitions at least and at most.
BUCKET_ROWS, MIN_BUCKETS, BUCKETS = 1_000_000, 16, 4096
#: Slots of document ids, by which those of several rows are told.
SLOTS = 65_536


@dataclass
class Index:
    meta: dict
    docs: DataFrame  # doc_id, uri
    minimizer_map: DataFrame | None  # h, cid; stored with bucket; None in build_sets' index, as colors
    colors: DataFrame | None  # cid, doc_id
    colorsets: DataFrame  # cid, size, class
    encoded: DataFrame | None = None  # cid, chunk, class, data: what a stored index has of colors


def doc_minimizers(docs: DataFrame, seq: str = "seq", **options) -> DataFrame:
    """doc_id, h: the distinct minimizers of each document (its sequences may be several rows).

    One row's minimizers are distinct already. Only where a document may have several rows or pieces are
    they shuffled: these ids are told by slots of their hash, so few numbers are broadcast however many they are."""
    rows = lambda some: minimizers.minimizers(some, ["doc_id"], seq, **options).select("doc_id", "h")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("_slot")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length(seq)).alias("size")).where(f"n > 1 OR size > {minimizers.PIECE}")
    again = F.broadcast(again.select(slot).distinct())
    own = docs.select("doc_id", seq, slot)
    return rows(own.join(again, "_slot", "left_anti")).union(rows(own.join(again, "_slot", "left_semi")).distinct())


def sought(docs: DataFrame, wanted: DataFrame, seq: str = "seq", queries: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, h: the distinct minimizers of each document that wanted (column h) has. Most others are
    left out by the kernel, by a bitmap of bounded size; the join is exact. With queries, the sequences that
    wanted's minimizers are of, the bitmap is of their m-mers, and most others aren't even hashed."""
    some = {"among": minimizers.leading_bits(wanted)} if queries is None else {"mers": minimizers.mmer_bits(queries, seq, **options)}
    rows = minimizers.minimizers(docs, ["doc_id"], seq, **some, **options).select("doc_id", "h")
    return rows.join(wanted.select("h").distinct(), "h", "left_semi").distinct().select("doc_id", "h")


def invert(postings: DataFrame) -> DataFrame:
    """h, ids, size: ascending arrays, for sets that fit in a row (index tables never need one)."""
    return postings.groupBy("h").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).withColumn("size", F.size("ids"))


def bucket(h="h", buckets: int = 1):
    """The partition of the stored map that holds a minimizer."""
    return F.pmod(F.xxhash64(h), F.lit(buckets)).cast("int")


def pruned(index: Index, wanted: DataFrame) -> DataFrame:
    """h, cid of the partitions of the map that hold any of wanted's h: a stored map is partitioned
    by bucket, and only bucket numbers (BUCKETS at most) go through the driver."""
    buckets = index.meta.get("buckets")
    if not buckets or "bucket" not in index.minimizer_map.columns:
        return index.minimizer_map.select("h", "cid")
    some = [r[0] for r in wanted.select(bucket("h", buckets).alias("b")).distinct().collect()]
    return index.minimizer_map.where(F.col("bucket").isin(some)).select("h", "cid")


def digest_sets(members: DataFrame) -> DataFrame:
    """h, size, d1, d2: what tells colour sets apart."""
    return members.groupBy("h").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("d2"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with dense numbers from 0 in the order of key (unique; a hash, as text or long), without a
    single-task sort.

    Rows are dealt by the first twelve bits of the key, so every reading of df deals them alike; the
    bounds of a range partitioning are drawn from a sample and differ between two readings. Only the
    number of rows per slot meets in one place."""
    text = isinstance(df.schema[key].dataType, StringType)
    slots = df.withColumn("_slot", F.substring(key, 1, 3) if text else F.shiftright(F.col(key), 52))
    local = slots.withColumn("_row", F.row_number().over(Window.partitionBy("_slot").orderBy(key)))
    sizes = slots.groupBy("_slot").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_slot", "_base")
    return local.join(F.broadcast(base), "_slot").withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_slot", "_row", "_base")


def color_ids(members: DataFrame, sets_named: DataFrame | None = None) -> DataFrame:
    """h, cid, size and rep (the least minimizer with the same colour set). With sets_named (color_sets),
    members may lack minimizers, but no document of those that they have; numbers are those of sets_named."""
    sets = digest_sets(members)
    same = sets.groupBy("size", "d1", "d2").agg(F.min("h").alias("rep"))
    ids = numbered(same, "rep", "cid") if sets_named is None else same.join(sets_named.select("size", "d1", "d2", "cid"), ["size", "d1", "d2"])
    return sets.join(ids, ["size", "d1", "d2"]).select("h", "cid", "size", "rep")


def color_sets(docs: DataFrame, seq: str = "seq", staging: str | None = None, **options) -> DataFrame:
    """size, d1, d2, rep, cid of all colour sets of documents, numbered as color_ids does. No table of all members
    is made."""
    return numbered(staged(packed.color_sets(docs, seq, **options), staging, "sets"), "rep", "cid")


def build(docs: DataFrame, seq: str = "seq", uri: str | None = None, k: int = minimizers.K, m: int = minimizers.M, canonical: bool = True, seed: int = minimizers.SEED, kind: str = "mix", staging: str | None = None, members: DataFrame | None = None, sets_named: DataFrame | None = None) -> Index:
    """An index of documents (doc_id and a sequence column; documents too short have no minimizers).

    With staging (a folder), the documents' minimizers and the named sets are written there, so
    that the index's tables share them instead of computing them again. With members (doc_id, h: sought),
    the index holds these minimizers alone, each with its whole colour set: it answers the queries that
    they were sought for as the whole index does. Its set numbers are its own, unless sets_named (color_sets
    of the same documents) has the whole index's."""
    minimizers.checked(k, m)
    if members is None:
        members = doc_minimizers(docs, seq, k=k, m=m, canonical=canonical, seed=seed, kind=kind)
    members = staged(members, staging, "members")
    named = staged(color_ids(members, sets_named), staging, "named")
    rows = named.where("h = rep").select("h", "cid").join(members, "h").select("cid", "doc_id")
    listed, n_docs = listed_docs(docs, uri)
    sets = classed(named.where("h = rep"), n_docs)
    meta = {"nb_docs": n_docs, "k": k, "m": m, "canonical": canonical, "seed": seed, "hash": kind}
    return Index(meta, listed, named.select("h", "cid"), rows, sets)


def listed_docs(docs: DataFrame, uri: str | None) -> tuple[DataFrame, int]:
    """doc_id, uri of the documents, and their number."""
    listed = docs.groupBy("doc_id").agg((F.min(uri) if uri else F.lit(None).cast("string")).alias("uri"))
    return listed, listed.count()


def classed(sets: DataFrame, n_docs: int) -> DataFrame:
    """cid, size, class."""
    return sets.select("cid", "size").withColumn("class", colors.colorset_class(F.col("size"), F.lit(n_docs)))


def staged(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def build_sets(docs: DataFrame, seq: str = "seq", uri: str | None = None, k: int = minimizers.K, m: int = minimizers.M, canonical: bool = True, seed: int = minimizers.SEED, kind: str = "mix", staging: str | None = None) -> Index:
    """The documents and the colour sets (numbers, sizes and classes) of build's index, without its map and members."""
    sets = color_sets(docs, seq, staging, k=k, m=m, canonical=canonical, seed=seed, kind=kind)
    listed, n_docs = listed_docs(docs, uri)
    meta = {"nb_docs": n_docs, "k": k, "m": m, "canonical": canonical, "seed": seed, "hash": kind}
    return Index(meta, listed, None, None, classed(sets, n_docs))


def write(index: Index, path: str) -> None:
    """Parquet tables below path. The map is partitioned by a hash of the minimizer, so a lookup reads
    only the partitions that its minimizers fall in; sets are stored in the form of their class. Of an index
    without map and members (build_sets) the other tables are written."""
    spark = index.docs.sparkSession
    meta = index.meta | {"tables": ["docs", "colorsets"]}
    if index.minimizer_map is not None:
        # one number for a set in all tables: named once, then read again
        buckets = max(MIN_BUCKETS, min(BUCKETS, index.minimizer_map.count() // BUCKET_ROWS))
        named = index.minimizer_map.select("h", "cid", bucket("h", buckets).alias("bucket"))
        named.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/minimizer_map")
        sets = colors.encode(index.colors, index.meta["nb_docs"])
        sets.repartitionByRange("cid").sortWithinPartitions("cid", "chunk").write.mode("overwrite").parquet(f"{path}/colors")
        meta |= {"tables": [*meta["tables"], "minimizer_map", "colors"], "buckets": buckets}
    index.colorsets.repartitionByRange("cid").sortWithinPartitions("cid").write.mode("overwrite").parquet(f"{path}/colorsets")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read(spark, path: str) -> Index:
    """A stored index; tables that it was written without are None."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    get = lambda name: spark.read.parquet(f"{path}/{name}")
    if "minimizer_map" not in meta.pop("tables", ["minimizer_map"]):
        return Index(meta, get("docs"), None, None, get("colorsets"))
    encoded = get("colors")
    schema = "h long, cid long, bucket int" if meta["hash"] == "mix" else "h string, cid long, bucket int"
    named = spark.read.schema(schema).parquet(f"{path}/minimizer_map")
    return Index(meta, get("docs"), named, colors.decode(encoded, meta["nb_docs"]), get("colorsets"), encoded)


def stats(index: Index) -> DataFrame:
    """n_docs, n_minimizers, n_sets, n_members and the number of sets per class; of a stored index
    also n_words, the numbers that its encoded sets hold (ids, or bitmap words of 64 bits)."""
    sets = index.colorsets.agg(
        F.count("*").alias("n_sets"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_members"),
        *(F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c}") for c in ("sparse", "bitmap", "complement")),
    )
    out = sets.crossJoin(index.minimizer_map.agg(F.count("*").alias("n_minimizers"))).withColumn("n_docs", F.lit(index.meta["nb_docs"]).cast("long"))
    if index.encoded is None:
        return out
    return out.crossJoin(index.encoded.agg(F.coalesce(F.sum(F.size("data")), F.lit(0)).cast("long").alias("n_words")))


def size_histogram(index: Index, steps: int = 10) -> DataFrame:
    """tenth, n_sets, n_members: sets by the share of all documents that they hold."""
    n = max(1, index.meta["nb_docs"])
    tenth = F.least(F.lit(steps - 1), F.floor(F.col("size") * steps / n)).cast("int")
    return index.colorsets.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("n_sets"), F.sum("size").alias("n_members"))
