"""Functions over colour sets: ascending arrays of document ids below n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def colorset_class(size: Column, n: Column) -> Column:
    """Which form is the shortest: sparse below a quarter of all documents, complement from three quarters."""
    return F.when(size < (0.25 * n).cast("int"), "sparse").when(size < (0.75 * n).cast("int"), "bitmap").otherwise("complement")


#: Document ids of a chunk of a stored set.
CHUNK = 1 << 16


def room(chunk: Column, n: int) -> Column:
    """How many document ids below n a chunk covers."""
    return F.least(F.lit(CHUNK).cast("long"), F.lit(n).cast("long") - chunk * CHUNK).cast("int")


def encode(members: DataFrame, n: int) -> DataFrame:
    """cid, chunk, class, data: sets (cid, doc_id; ids from 0 below n) in the shortest form for each
    chunk: the ids within it (sparse), words of 64 bits (bitmap) or the ids that are absent
    (complement). Bits of a word are joined before the shuffle; a row holds a chunk at most."""
    at = F.pmod(F.col("doc_id").cast("long"), F.lit(CHUNK))
    words = members.select("cid", F.expr(f"cast(doc_id AS long) div {CHUNK}").alias("chunk"), F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(cast(doc_id AS long), 64) AS int))").alias("b"))
    words = words.groupBy("cid", "chunk", "w").agg(F.bit_or("b").alias("b"))
    rows = words.groupBy("cid", "chunk").agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("ws"), F.sum(F.bit_count("b")).alias("size"))
    rows = rows.withColumn("room", room(F.col("chunk"), n)).withColumn("class", colorset_class(F.col("size"), F.col("room")))
    ids = bits_of("ws")
    absent = F.array_except(F.sequence(F.lit(0), F.col("room") - 1), ids)
    data = F.when(F.col("class") == "sparse", ids.cast("array<bigint>")).when(F.col("class") == "bitmap", F.transform(F.array(F.col("ws")), lambda ws: filled(ws, F.col("room")))[0]).otherwise(absent.cast("array<bigint>"))
    return rows.select("cid", "chunk", "class", data.alias("data"))


def bits_of(ws) -> Column:
    """Ids (from 0) of an array of (w, b): set bits of words."""
    one = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("1L").bitwiseAND(shifted(x["b"], i)) != 0), lambda i: x["w"] * 64 + i)
    return F.flatten(F.transform(ws, one))


def shifted(b: Column, i: Column) -> Column:
    return F.call_function("shiftright", b, i)


def filled(ws: Column, width: Column) -> Column:
    """All words of a chunk, also those without a bit."""
    start = F.array().cast("array<bigint>")
    upto = lambda a, w: F.array_repeat(F.lit(0).cast("long"), w - F.size(a))
    whole = F.aggregate(ws, start, lambda a, x: F.concat(a, upto(a, x["w"]), F.array(x["b"])))
    return F.transform(F.array(whole), lambda a: F.concat(a, upto(a, F.floor((width + 63) / 64).cast("int"))))[0]


def decode(encoded: DataFrame, n: int) -> DataFrame:
    """cid, doc_id of stored sets; a row's chunk is expanded on its own."""
    data, width = F.col("data"), room(F.col("chunk"), n)
    words = F.transform(data, lambda b, w: F.struct(w.alias("w"), b.alias("b")))
    every = F.sequence(F.lit(0), width - 1)
    ids = F.when(F.col("class") == "sparse", data.cast("array<int>")).when(F.col("class") == "bitmap", bits_of(words)).otherwise(F.array_except(every, data.cast("array<int>")))
    return encoded.select("cid", "chunk", F.explode(ids).alias("at")).select("cid", (F.col("chunk") * CHUNK + F.col("at")).alias("doc_id"))


def absent_ranges(members: DataFrame, n: int) -> DataFrame:
    """h, ranges: the ids below n that sets (h, doc_id, no repeats, not empty) do not hold, as ascending
    ranges (a, b), b excluded. They lie between neighbours, so there are about as many as members; a
    set that holds all ids has none."""
    order = Window.partitionBy("h").orderBy("doc_id")
    doc, end = F.col("doc_id").cast("long"), F.lit(n).cast("long")
    own = members.select("h", F.coalesce(F.lag(doc).over(order) + 1, F.lit(0).cast("long")).alias("a"), doc.alias("b"), F.lead(doc).over(order).isNull().alias("last"))
    ranges = F.array(F.struct("a", "b"), F.struct((F.col("b") + 1).alias("a"), F.when(F.col("last"), end).otherwise(0).alias("b")))
    found = own.select("h", F.filter(ranges, lambda r: r["a"] < r["b"]).alias("r")).groupBy("h").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    return found.select("h", F.sort_array("ranges").alias("ranges"))


def absent(members: DataFrame, n: int) -> DataFrame:
    """h, doc_id: the ids of absent_ranges in long form; no pair of a set and an id is formed that the
    result lacks."""
    return absent_ranges(members, n).select("h", F.explode("ranges").alias("r")).select("h", F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("doc_id"))


def within(ranges: Column) -> Column:
    """All ids of an array of ranges."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"] - 1)))


def between(ids: Column, n: Column) -> Column:
    """absent_ranges of one ascending array of ids."""
    ends = F.concat(ids.cast("array<bigint>"), F.array(n.cast("long")))
    return F.transform(ends, lambda x, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1) + 1).alias("a"), x.alias("b")))


def ids_text(ranges: Column, n: int) -> Column:
    """All ids below n of ascending ranges (a, b), b excluded, as text with commas: slices of the text of all ids,
    so a set costs copies of a few slices and not a number for each id."""
    every = ("".join(f"{i}," for i in range(n))).encode()
    shorter = F.array(*(F.lit((10**d - 10) // 9) for d in range(1, len(str(max(1, n))) + 1)))

    def start(x: Column) -> Column:
        """Where an id's text begins: each id before it takes its digits and a comma."""
        digits = F.length(x.cast("string"))
        return (x * (digits + 1) - F.get(shorter, digits - 1)).cast("int")

    inside = F.transform(ranges, lambda r: F.struct(F.greatest(r["a"], F.lit(0).cast("long")).alias("a"), F.least(r["b"], F.lit(n).cast("long")).alias("b")))
    some = F.filter(inside, lambda r: r["a"] < r["b"])
    return F.concat_ws(",", F.transform(some, lambda r: F.substring(F.lit(every), start(r["a"]) + 1, start(r["b"]) - start(r["a"]) - 1).cast("string")))


def gap_encode(ids: Column) -> Column:
    """The first id, then each distance to the next id less one."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1) - 1))


def gap_decode(gaps: Column) -> Column:
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(-1).cast("long").alias("last"))
    step = lambda a, g: F.struct(F.concat(a["ids"], F.array(a["last"] + 1 + g)).alias("ids"), (a["last"] + 1 + g).alias("last"))
    return F.aggregate(gaps, start, step, lambda a: a["ids"])


def complement_set(ids: Column, n: Column) -> Column:
    """The ids below n that are not in the set."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), ids)).otherwise(F.array().cast("array<bigint>"))


def next_geq(ids: Column, bound: Column, n: Column) -> Column:
    """The least id of the set that is at least bound; n if there is none."""
    return F.coalesce(F.get(F.filter(ids, lambda x: x >= bound), F.lit(0)), n)


def log2_floor(x: Column) -> Column:
    """Of a whole number from 1, without floating point."""
    return (F.length(F.bin(x)) - 1).cast("long")


def gamma_bits(x: Column) -> Column:
    """Length of the gamma code of x (coded as x + 1)."""
    return 2 * log2_floor(x + 1) + 1


def delta_bits(x: Column) -> Column:
    """Length of the delta code of x (coded as x + 1)."""
    return log2_floor(x + 1) + gamma_bits(log2_floor(x + 1))


def unary_bits(x: Column) -> Column:
    return x + 1


def set_bits(ids: Column, n: Column) -> Column:
    """Bits of a set: the delta code of its size, then the gaps or the bitmap of its class."""
    total = lambda g: F.aggregate(F.transform(gap_encode(g), delta_bits), F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.size(ids).cast("long")
    kind = colorset_class(size, n)
    return delta_bits(size) + F.when(kind == "sparse", total(ids)).when(kind == "bitmap", n.cast("long")).otherwise(total(complement_set(ids, n)))
