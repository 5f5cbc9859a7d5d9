"""SimHash near-duplicates by vantage-point trees (operator 5).

Each document gets a 64-bit SimHash fingerprint. Different fingerprints (not documents) are
linked at RADIUS or fewer differing bits. A vantage-point tree, grown on a bounded sample of
fingerprints, deals them to shards by Hamming distance: at each node the fingerprints within the
node's distance of its vantage point go left, the others right. The triangle inequality bounds
which branches can hold a neighbour: a left fingerprint near the boundary is also sent to the
right branch, as a query. Shards split further in memory by the same rule, and small cells
compare all their fingerprints exactly, so no link is lost. A cell reports, for each of its
fingerprints, the least one it is connected to there: edges grow with the fingerprints, not with
the square of a group. Components of these edges come from repeated minima over written tables.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other;
fewer words than a shingle count as one shingle; repeated rows share a component; a null doc_id
is never the smallest unless the component has no other (then component_id is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a shard on average, of a cell compared as a whole, of the sample, and leaves at most (a larger shard splits in memory).
SHARD, CELL, SAMPLE, LEAVES = 4096, 512, 65_536, 8192


def fingerprints_of(texts, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of an Arrow array of texts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    offsets, words = common.split_words(common.lower_ascii(texts))
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(words):
        return out
    ends = np.cumsum(np.asarray(pc.binary_length(words), dtype=np.int64) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    joined = b" ".join(words.cast(pa.large_binary()).to_pylist())
    step = 2000  # documents whose bits are counted at once
    for i in range(0, len(out), step):
        cut = offsets[i : i + step + 1]
        n = np.diff(cut)
        shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        if not shingles.sum():
            continue
        first = common.gather(cut[:-1], shingles)
        last = np.minimum(first + shingle, np.repeat(cut[1:], shingles)) - 1
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist())], "<u8")
        full = np.flatnonzero(shingles)
        starts = (np.cumsum(shingles) - shingles)[full]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = (2 * ones > shingles[full][:, None]).astype(np.uint8)
        out[i + full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    common.small_batches(docs.sparkSession)

    def each(batches):
        for b in common.parts(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fp": pa.array(fingerprints_of(b["text"], shingle).view(np.int64))})

    return common.id_text(docs).mapInArrow(each, "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(fps: np.ndarray, radius: int = RADIUS) -> tuple[int, int] | None:
    """Of a few candidates the vantage point whose median distance parts fps best; None if none parts them."""
    best = None
    for v in fps[:: max(1, len(fps) // 5)][:5]:
        d = distance(fps, v)
        m = int(np.median(d))
        for r in (m, m - 1):
            left = int((d <= r).sum())
            if 0 < left < len(fps):
                near = int(((d > r - radius) & (d <= r + radius)).sum())
                cost = max(left, len(fps) - left) + near
                if best is None or cost < best[0]:
                    best = (cost, int(v), r)
    return best and best[1:]


def grow(sample: np.ndarray, leaves: int) -> dict:
    """A tree of about that many leaves: {"v", "r", "left", "right"}, or {"leaf": number}."""
    numbers = iter(range(1 << 30))

    def node(fps: np.ndarray, n: int) -> dict:
        split = vantage(fps) if n > 1 and len(fps) > 4 else None
        if split is None:
            return {"leaf": next(numbers)}
        d = distance(fps, np.uint64(split[0]))
        return {"v": split[0], "r": split[1], "left": node(fps[d <= split[1]], n - n // 2), "right": node(fps[d > split[1]], n // 2)}

    return node(sample, leaves)


def branches(fps: np.ndarray, home: np.ndarray, v: int, r: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints go left and right. A query goes wherever a neighbour may be; of two
    fingerprints at home that a node parts, the left one is sent after the right one."""
    d = distance(fps, np.uint64(v))
    left = np.where(home, d <= r, d - radius <= r)
    right = np.where(home, d + radius > r, d + radius > r)
    return left, right


def route(tree: dict, fps: np.ndarray, radius: int, at_home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, position in fps, at home) for every visit."""
    out = []
    stack = [(tree, np.arange(len(fps)), np.full(len(fps), at_home))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if "leaf" in node:
            out.append((np.full(len(at), node["leaf"]), at, home))
            continue
        left, right = branches(fps[at], home, node["v"], node["r"], radius)
        d = distance(fps[at], np.uint64(node["v"])) > node["r"]
        stack.append((node["left"], at[left], home[left]))
        stack.append((node["right"], at[right], home[right] & d[right]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0, bool),)


class Sets:
    """Union-find over positions, by arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flat(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.flat()
            x, y = up[a], up[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def link(fps: np.ndarray, home: np.ndarray, at: np.ndarray, sets: Sets, radius: int) -> None:
    """Join all fingerprints of a cell within radius of one another, one of each pair at home."""
    stack = [(at, home[at])]
    while stack:
        at, own = stack.pop()
        n = int(own.sum())
        if not n or len(at) < 2:
            continue
        split = vantage(fps[at[own]], radius) if n > CELL else None
        if split is None:
            mine, seen = at[own], 0
            while seen < len(at):  # in blocks, so that memory stays bounded
                block = at[seen : seen + max(1, 4_000_000 // n)]
                i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[mine][None, :]) <= radius)
                sets.join(block[i], mine[j])
                seen += len(block)
            continue
        left, right = branches(fps[at], own, *split, radius)
        far = distance(fps[at], np.uint64(split[0])) > split[1]
        stack.append((at[left], own[left]))
        stack.append((at[right], own[right] & far[right]))


def edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, no repeats) that connect the same
    ones as all links do."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = int(min(LEAVES, max(1, -(-n // SHARD))))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, leaves * 64)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = grow(sample, leaves)

    def deal(batches):
        for b in common.parts(batches):
            fps = np.asarray(b["fp"]).view(np.uint64)
            leaf, at, home = route(tree, fps, radius)
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaf, pa.int32()), "fp": pa.array(fps[at].view(np.int64)), "home": pa.array(home)})

    def search(t: pa.Table) -> pa.Table:
        fps, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
        order = np.argsort(fps.view(np.int64), kind="stable")
        fps, home = fps[order], home[order]
        sets = Sets(len(fps))
        link(fps, home, np.arange(len(fps)), sets, radius)
        root = sets.flat()
        odd = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[odd].view(np.int64), "b": fps[root[odd]].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that links connect it to), for nodes of links (a, b).

    Each round takes the least root among neighbours and then follows roots of roots; rounds are
    written tables, so nothing is recomputed when an executor is lost. A round's table is deleted
    when the next one is written.
    """
    spark = links.sparkSession
    both = common.settled(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = kept = common.settled(spark, both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = common.settled(spark, step, "roots")
        common.dropped(spark, kept)
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        kept = common.settled(spark, jump.select("node", "old", F.least("root", "next").alias("root")), "roots")
        common.dropped(spark, step)
        if kept.where("root <> old").isEmpty():
            common.dropped(spark, both)
            return kept.select("node", "root")
        roots = kept.select("node", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of all documents reachable by links)."""
    spark = docs.sparkSession
    prints = common.settled(spark, fingerprints(docs, shingle), "fingerprints")
    classes = common.settled(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(edges(classes.select("fp"), radius))
    linked = classes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    whole = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(common.settled(spark, whole, "components"), "fp")


#: Words of a shingle, similarity of near copies, and candidates verified in one call on average.
NEAR_SHINGLE, NEAR_SIMILARITY, VERIFIED = 5, 0.8, 2000
#: Signatures compared in one call on average. Rows whose shingles are counted for their order, the count from which one is hot, and hot ones at most.
COMPARED, COUNTED, HOT_AT, HOT_MOST = 50_000, 8192, 3, 65_536
#: Signatures that a map task combines at once.
COMBINED = 300_000


def shingle_sets(texts, size: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """Hashes of the different shingles of each text (the whole sequence, if it is shorter)."""
    from .op4_substring import BASES, rolling

    offsets, words = common.split_words(common.lower_ascii(texts))
    codes, distinct = common.coded_words(words)
    h = common.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    out = []
    for a, e in zip(offsets[:-1], offsets[1:]):
        out.append(np.unique(rolling(h[a:e], min(size, e - a), BASES[0])) if e > a else h[:0])
    return out


def verified(sets: list[np.ndarray], similarity: float = NEAR_SIMILARITY) -> np.ndarray:
    """A root for each set: sets of one root are connected by pairs of at least that Jaccard
    similarity. Each set is compared with others until one component is left; those that hold
    the most common shingles come first, so that a text and its many copies take one pass.

    With shingles in one order, rare ones first, of two such sets each has one of the other's first
    n - ceil(similarity * n) + 1. So a set is compared with those that share one of these and aren't
    connected to it, or with all where that is less work."""
    n = len(sets)
    parts = Sets(n)
    sizes = np.array([len(x) for x in sets])
    empty = np.flatnonzero(sizes == 0)
    parts.join(empty[1:], np.repeat(empty[:1], max(len(empty) - 1, 0)))
    full = np.flatnonzero(sizes)
    if len(full) < 2:
        return parts.flat()
    known, ids = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
    starts = np.cumsum(sizes[full]) - sizes[full]
    common_ = np.add.reduceat(np.bincount(ids)[ids], starts) / sizes[full]
    heat, own = np.bincount(ids), np.repeat(np.arange(len(full)), sizes[full])
    rare = ids[np.lexsort((ids, heat[ids], own))]
    head = sizes[full] - np.ceil(similarity * sizes[full] - 1e-9).astype(np.int64) + 1
    heads = rare[common.gather(starts, head)]
    holders = np.repeat(np.arange(len(full)), head)[np.argsort(heads, kind="stable")]
    many = np.bincount(heads, minlength=len(known))
    first = np.cumsum(many) - many
    mark = np.zeros(len(known), bool)
    for k in np.argsort(-common_, kind="stable"):
        root = parts.flat()[full]
        if (root == root[0]).all():
            break
        mine = rare[starts[k] : starts[k] + sizes[full[k]]]
        asked = mine[: head[k]]
        if many[asked].sum() < len(ids):
            others = np.unique(holders[common.gather(first[asked], many[asked])])
            others = others[root[others] != root[k]]
        else:
            others = np.flatnonzero(root != root[k])
        if not len(others):
            continue
        mark[mine] = True
        lengths = sizes[full[others]]
        both = np.add.reduceat(mark[ids[common.gather(starts[others], lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
        mark[mine] = False
        near = others[both >= similarity * (len(mine) + lengths - both) - 1e-9]
        parts.join(full[near], np.repeat(full[k], len(near)))
    return parts.flat()


def batch_shingles(texts, size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the shingles of all texts, repeats included, as in shingle_sets."""
    from .op4_substring import BASES, rolling

    offsets, words = common.split_words(common.lower_ascii(texts))
    codes, distinct = common.coded_words(words)
    h = common.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    own = np.repeat(np.arange(len(n)), n)
    runs = rolling(h, size, BASES[0])
    inside = own[: len(runs)] == own[len(own) - len(runs) :]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = [rolling(h[offsets[i] : offsets[i + 1]], int(n[i]), BASES[0]) for i in short]
    return np.concatenate([own[: len(runs)][inside], short]), np.concatenate([runs[inside], *whole])


def signatures(texts, hot: np.ndarray, counts: np.ndarray, similarity: float = NEAR_SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Text number and signature; texts of that similarity share one or more.

    The different shingles of a text stand in one order for all texts: those counted as hot last.
    Of the n - 1 pairs of neighbours in a text of n, a shingle that only it has breaks two and one
    that only the other text has breaks one, so similar texts share all but 2 * (1 - similarity)
    * n pairs (rounded down) at least. One more than that from the front of either text's pairs,
    in the same order, then have one in common. The digest of a whole set serves sets without pairs.
    """
    own, h = batch_shingles(texts)
    heat = np.zeros(len(h), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        heat = np.where(hot[at] == h, counts[at], 0)
    order = np.lexsort((h, heat, own))
    own, h = own[order], h[order]
    if len(h):
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])
        own, h = own[new], h[new]
    n = np.bincount(own, minlength=len(texts))
    starts = np.cumsum(n) - n
    digest = np.zeros(len(n), np.uint64)
    pairs = np.minimum(n - 1, np.floor(2 * (1 - similarity) * n + 1e-9).astype(np.int64) + 1).clip(0)
    first = common.gather(starts, pairs)
    with np.errstate(over="ignore"):
        np.add.at(digest, own, common.mix(h))
        pair = common.mix(common.mix(h[first]) * np.uint64(3) + h[first + 1]) if len(first) else h[:0]
        digest = common.mix(digest + n.astype(np.uint64))
    return np.concatenate([np.repeat(np.arange(len(n)), pairs), np.arange(len(n))]), np.concatenate([pair, digest])


def text_id(column: str = "text"):
    """What stands for a text: equal texts have one, null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def hot_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often among a bounded number of different texts, and how often. They only
    decide the order, of which the result does not depend."""
    share = min(1.0, COUNTED / max(n, 1))
    some = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["text_id"])

    def each(batches):
        for b in common.parts(batches):
            own, h = batch_shingles(b["text"])
            pairs = np.unique(np.stack([own.astype(np.uint64), h], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"h": pa.array(pairs[:, 1].view(np.int64))})

    found = some.mapInArrow(each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_AT)
    found = found.orderBy(F.desc("n"), "h").limit(HOT_MOST).toPandas()
    hot, counts = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(hot)
    return hot[order], counts[order]


def stars(found: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of signatures and nodes: each different signature with its least node, and edges (node,
    least node) of the others."""
    order = np.lexsort((node, found))
    found, node = found[order], node[order]
    new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, int)
    first = np.repeat(node[new], np.diff(np.concatenate([new, [len(node)]])))
    pairs = np.unique(np.stack([node, first], 1)[node != first], axis=0)
    return found[new], node[new], pairs[:, 0], pairs[:, 1]


def candidates(texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all texts (text_id, text) which share a signature.

    A map task sends each signature once for every COMBINED signatures that it makes, and its own
    edges, so a signature that very many texts have brings few rows to the task that gathers it."""
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    hot, counts = hot_shingles(texts, size["n"])
    calls = max(1, (size["bytes"] or 0) // (15 * COMPARED))  # a signature for about 15 bytes

    def sent(found: list, nodes: list):
        one, node, a, b = stars(np.concatenate(found), np.concatenate(nodes))
        none = np.zeros(len(one), bool)
        yield pa.RecordBatch.from_pydict({
            "signature": pa.array(np.concatenate([one, a])), "node": pa.array(np.concatenate([node, a])),
            "other": pa.array(np.concatenate([node, b]), mask=np.concatenate([~none, np.zeros(len(a), bool)])),
        })

    def each(batches):
        found, nodes, n = [], [], 0
        for b in common.parts(batches):
            own, some = signatures(b["text"], hot, counts)
            found.append(some.view(np.int64))
            nodes.append(b["text_id"].to_numpy()[own])
            n += len(own)
            if n >= COMBINED:
                yield from sent(found, nodes)
                found, nodes, n = [], [], 0
        if n:
            yield from sent(found, nodes)

    def share(t: pa.Table) -> pa.Table:
        known = np.asarray(t["other"].is_valid())
        found, node = t["signature"].to_numpy(), t["node"].to_numpy()
        _, _, a, b = stars(found[~known], node[~known])
        return pa.table({"a": np.concatenate([a, node[known]]), "b": np.concatenate([b, t["other"].filter(pa.array(known)).to_numpy()])})

    rows = texts.select("text_id", "text").mapInArrow(each, "signature long, node long, other long")
    return rows.withColumn("call", F.pmod(F.xxhash64("signature"), F.lit(calls))).groupBy("call").applyInArrow(share, "a long, b long")


def fingerprint_links(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all texts (text_id, text) that near_duplicates links: those of one
    fingerprint with the least of them, and these by the edges of the vantage-point trees."""
    spark = texts.sparkSession
    prints = common.settled(spark, fingerprints(texts.withColumnRenamed("text_id", "doc_id")).distinct(), "fingerprints")
    classes = common.settled(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    equal = prints.join(classes, "fp").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    of = lambda c: classes.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = edges(classes.select("fp"), radius).join(of("a"), "a").join(of("b"), "b")
    return equal.union(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def near_texts(docs: DataFrame) -> DataFrame:
    """node, root: different texts (text_id) of a component of near copies and its least text_id.
    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more.

    Candidates are the texts that operator 5 links by fingerprints (fingerprint_links), and, as the exact
    way for what these miss, texts that share a signature, which no near copies escape: at a similarity
    of 0.8 two texts' shingle sets stand at an angle of 27 degrees, so 64-bit fingerprints differ by
    ten bits on average, a radius at which vantage-point trees prune nothing and about half of the pairs
    are lost. The components of candidates are then verified by exact similarity, as fingerprints may
    also agree where texts differ (one phrase repeated); a component's different texts meet in one
    task, where only linear memory is used.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = common.id_text(docs).select(text_id().alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = common.settled(spark, components(fingerprint_links(texts).union(candidates(texts))), "candidates")
    calls = max(1, grouped.count() // VERIFIED)
    concerned = common.id_filter(grouped.select(F.col("node").alias("doc_id")))(texts.withColumnRenamed("text_id", "doc_id"), True)
    rows = concerned.dropDuplicates(["doc_id"]).join(grouped.withColumnRenamed("node", "doc_id"), "doc_id")

    def check(t: pa.Table) -> pa.Table:
        t = t.sort_by([("root", "ascending"), ("doc_id", "ascending")])
        root, ids = t["root"].to_numpy(), t["doc_id"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
        texts, a, b = t["text"].combine_chunks(), [], []
        for i, e in zip(cuts[:-1], cuts[1:]):
            to = verified(shingle_sets(texts[i:e]))
            odd = np.flatnonzero(to != np.arange(e - i))
            a.append(ids[i:e][odd])
            b.append(ids[i:e][to[odd]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    links = rows.withColumn("call", F.pmod(F.xxhash64("root"), F.lit(calls))).groupBy("call").applyInArrow(check, "a long, b long")
    return components(links)


def chosen(docs: DataFrame) -> DataFrame:
    """text_id, first_id, first_text: of each component of several rows its texts, and the doc_id
    and text of the row that stands for all: the least doc_id, then the least text_id. A row
    without doc_id comes after all others."""
    spark = docs.sparkSession
    alike = common.settled(spark, near_texts(docs).withColumnRenamed("node", "text_id"), "alike")
    rows = common.id_text(docs).select("doc_id", text_id().alias("text_id"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    kinds = rows.groupBy("text_id").agg(F.min(first).alias("first"), F.count("*").alias("n")).join(alike, "text_id", "left")
    kinds = common.settled(spark, kinds.withColumn("root", F.coalesce("root", "text_id")), "kinds")
    best = kinds.groupBy("root").agg(F.min(F.struct("first", "text_id")).alias("best"), F.sum("n").alias("n")).where("n > 1")
    best = best.select("root", F.col("best.first.id").alias("first_id"), F.col("best.text_id").alias("first_text"))
    return kinds.select("text_id", "root").join(best, "root").select("text_id", "first_id", "first_text")


def near_copies(docs: DataFrame) -> DataFrame:
    """node, root: documents (doc_id) of a component of near copies and its least doc_id; rows
    without doc_id are left out."""
    rows = common.id_text(docs).where("doc_id is not null").select(F.col("doc_id").alias("node"), text_id().alias("text_id"))
    return rows.join(chosen(docs), "text_id").select("node", F.col("first_id").alias("root"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component of near copies: that of the least
    doc_id. Rows are told apart by doc_id and text, so different texts of one doc_id stay, and
    equal texts are one with or without doc_id; of rows equal in both any one stays. Null text is
    the empty text; extra columns may have any names."""
    spark = docs.sparkSession
    found = common.settled(spark, chosen(docs).withColumnRenamed("text_id", "node"), "chosen")
    split = common.id_filter(found, "node")
    marked = common.packed(docs).select("row", "doc_id", text_id().alias("own"))
    some = split(marked, True, "own").join(found, F.col("own") == F.col("node"), "left")
    # a text that isn't in found has a single row
    some = some.where(F.col("node").isNull() | (F.col("own") == F.col("first_text")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return common.unpacked(split(marked, False, "own").select("row").unionByName(some.dropDuplicates(["own"]).select("row")))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
