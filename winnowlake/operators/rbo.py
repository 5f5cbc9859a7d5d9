"""Rank-biased overlap of two files of ranked results, line by line.

All sums run inside a row in rank order, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, PROPORTION, EPS, MIN_SIZE = 0.9, 0.1, 0.000001, 10
#: Halvings until an interval of 1 - 2 * EPS is no longer than EPS.
STEPS = 20


def weight(p: Column, depth: Column) -> Column:
    """The share of the total weight that the first depth ranks bear."""
    start = F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("total"))
    sums = F.aggregate(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, d: F.struct((a["power"] * p).alias("power"), (a["total"] + a["power"] * p / d).alias("total")),
    )
    inner = lambda s: 1 - s["power"] + (1 - p) / p * depth * (-F.log(1 - p) - s["total"])
    return F.transform(F.array(sums), inner)[0]


def find_p(length: Column) -> Column:
    """The p for which the first PROPORTION of length ranks bear TARGET of the weight: of the
    midpoints of a bisection the one that comes closest."""
    depth = F.ceil(F.lit(PROPORTION) * length).cast("int")
    start = F.struct(F.lit(EPS).alias("low"), F.lit(1 - EPS).alias("high"), F.lit(float("nan")).alias("best"), F.lit(float("inf")).alias("diff"))

    def step(a: Column, _) -> Column:
        mid = (a["low"] + a["high"]) / 2
        return F.transform(F.array(F.struct(mid.alias("mid"), weight(mid, depth).alias("w"), a.alias("a"))), move)[0]

    def move(x: Column) -> Column:
        a, diff = x["a"], F.abs(x["w"] - TARGET)
        less, nearer = x["w"] < TARGET, diff < a["diff"]
        return F.struct(
            F.when(less, a["low"]).otherwise(x["mid"]).alias("low"), F.when(less, x["mid"]).otherwise(a["high"]).alias("high"),
            F.when(nearer, x["mid"]).otherwise(a["best"]).alias("best"), F.when(nearer, diff).otherwise(a["diff"]).alias("diff"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["best"])


def by_ties(pairs: Column) -> Column:
    """Ids of an array of (doc_id, score): the best score first, equal scores by id."""
    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct((-x["score"]).alias("s"), x["doc_id"].alias("d"))))
    return F.transform(ordered, lambda x: x["d"])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def completed(a: Column, b: Column) -> Column:
    """For each id that both lists have among their first ranks (as many as the shorter list has),
    the depth from which on both have it; ascending.

    Both lists are sorted as one by id, so that equal ids are neighbours; of an id that a list
    repeats, its first rank counts."""
    depth = F.least(F.size(a), F.size(b))
    # a's ranks are negative and come first: the last of them is the smallest
    left = F.transform(F.slice(a, 1, depth), lambda v, i: F.struct(v.cast("long").alias("id"), F.lit(0).alias("side"), (-i - 1).alias("rank")))
    right = F.transform(F.slice(b, 1, depth), lambda v, i: F.struct(v.cast("long").alias("id"), F.lit(1).alias("side"), (i + 1).alias("rank")))

    def shared(s: Column) -> Column:
        def both(j: Column) -> Column:
            x, y = F.get(s, j), F.get(s, j + 1)
            return F.when((x["id"] == y["id"]) & (x["side"] < y["side"]), F.greatest(-x["rank"], y["rank"]))

        at = F.transform(F.sequence(F.lit(0), F.size(s) - 2), both)
        return F.when(F.size(s) > 1, F.sort_array(F.filter(at, lambda d: d.isNotNull()))).otherwise(F.array().cast("array<int>"))

    return let(F.sort_array(F.concat(left, right)), shared)


def overlap(a: Column, b: Column, depth: Column) -> Column:
    """How many ids the first depth ranks share."""
    return F.size(F.array_intersect(F.slice(a, 1, depth), F.slice(b, 1, depth)))


def fold(at: Column, depth: Column, p: Column, base: Column) -> Column:
    """Sum over depths d of (X_d - base) / d * p^(d-1), X_d the overlap at depth d.

    at (from completed) is followed from depth to depth: a depth adds one id of each list, so two
    ids at most become shared there and a step is constant work. at and base must be bound (let)."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("power"), F.lit(0).alias("x"))
    one = lambda s, d, i: F.coalesce((F.get(at, s["x"] + i) == d).cast("int"), F.lit(0))

    def step(s: Column, d: Column) -> Column:
        now = s["x"] + one(s, d, 0) + one(s, d, 1)
        return let(now, lambda x: F.struct((s["total"] + (x - base) / d.cast("double") * s["power"]).alias("total"), (s["power"] * p).alias("power"), x.alias("x")))

    depths = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(depths, start, step, lambda s: s["total"])


def rbo_prefix(a: Column, b: Column, p: Column) -> Column:
    return (1 - p) * let(completed(a, b), lambda at: fold(at, F.least(F.size(a), F.size(b)), p, F.lit(0)))


def rbo_min(a: Column, b: Column, p: Column) -> Column:
    depth = F.least(F.size(a), F.size(b))
    value = lambda at, x: fold(at, depth, p, x) - x * F.log(1 - p) / p
    return (1 - p) * let(completed(a, b), lambda at: let(F.size(at), lambda x: value(at, x)))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """line_no, a, b: the lists of lines (line_no, docs) that both sides have; lines meet by number."""
    return left.select("line_no", F.col("docs").alias("a")).join(right.select("line_no", F.col("docs").alias("b")), "line_no")


def sized(both: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """both with length (of the shorter list) and valid (whether it is min_size or more)."""
    return both.withColumn("length", F.least(F.size("a"), F.size("b"))).withColumn("valid", F.col("length") >= min_size)


def overlaps(both: DataFrame) -> DataFrame:
    """line_no, d, x: how many ids the first d ranks share, for each depth."""
    rows = both.withColumn("at", completed(F.col("a"), F.col("b")))
    known = rows.select("line_no", F.explode("at").alias("d")).groupBy("line_no", "d").agg(F.count("*").alias("new"))
    depth = rows.select("line_no", F.explode(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")))).alias("d"))
    run = Window.partitionBy("line_no").orderBy("d")
    return depth.join(known, ["line_no", "d"], "left").select("line_no", "d", F.coalesce(F.sum("new").over(run), F.lit(0)).alias("x"))


def compare(left: DataFrame, right: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """line_no, rbo for lines of two results (line_no, docs: ids in rank order), matched by line
    number; lines that only one side has are left out. A line is -1 if a list is shorter than
    min_size. p depends on the length alone and is solved once per different length."""
    lines = sized(zipped(left, right), min_size)
    ps = lines.where("valid").select("length").distinct().withColumn("p", find_p(F.col("length")))
    joined = lines.join(ps, "length", "left")
    value = F.when(F.col("valid"), rbo_min(F.col("a"), F.col("b"), F.col("p"))).otherwise(F.lit(-1.0))
    return joined.select("line_no", value.alias("rbo"))


def mean(rbo: DataFrame) -> DataFrame:
    """mean: the sum of valid lines over the number of all lines; NaN without lines."""
    valid = F.coalesce(F.sum(F.when(F.col("rbo") >= 0, F.col("rbo"))), F.lit(0.0))
    n = F.count("*")
    return rbo.agg(F.when(n == 0, F.lit(float("nan"))).otherwise(valid / F.greatest(n, F.lit(1))).alias("mean"))


def with_mean(rbo: DataFrame) -> DataFrame:
    """line_no, rbo, and a last row (line_no null) with the mean."""
    return rbo.unionByName(mean(rbo).select(F.lit(None).cast("long").alias("line_no"), F.col("mean").alias("rbo")))
