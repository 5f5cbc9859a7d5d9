"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 9).

A word enters the network with word inputs (log-odds of its hashed form and length) and character
inputs (largest, second largest and mean log-odds of its hashed character n-grams, three to five
characters with word boundaries). A dense layer, a GRU in each direction and attention over the
hidden states give a window's logit; all is trained in numpy by back-propagation through time.
Every text is scored in overlapping windows of WINDOW words, STRIDE apart, the last one at the
text's end; the largest logit is the document's, and a logistic calibration maps it to 0..1.

Training reads a bounded sample of labelled rows: at most about SAMPLE documents per class and
SAMPLE_BYTES of text, chosen by a hash of doc_id, with all their windows. They fall in two halves; each half's log-odds are the inputs with which
the other half trains the network (a document never sees its own counts), and scoring uses the
mean of the two tables. A document trains with the window that the current network scores highest.

Defined results: null, empty and wordless texts are scored as one empty window; without rows of
both classes every score is the share of label 1 (0 without labels); of several labels of one doc_id
1 counts, and of several texts the least; labels other than 0 and 1 and labels without a document
are ignored; rows are independent, so repeated rows and ties change nothing in scoring; texts may
have any length; extra columns are ignored by score and carried by keep, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 48, 24
#: Labelled documents of a class, and bytes of text of all of them, that training reads (about, at most).
SAMPLE, SAMPLE_BYTES = 2500, 30_000_000
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)
#: Documents that the prior counts as, spread over both classes by their size: chance hits of the rarer class weigh little.
#: Chosen by three-fold cross-validation inside the training rows (README).
PRIOR = 6.0
INPUTS, DENSE, HIDDEN = 5, 8, 8
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 7
#: Small samples take more epochs, until there are so many steps.
LEAST_STEPS, MOST_EPOCHS = 1300, 120
#: Windows scored at once.
BLOCK = 2048
#: Bytes of text whose n-grams are counted at once (a longer text alone makes a part of its own).
COUNTED_BYTES = 250_000
#: Different words whose n-grams are taken at once.
WORDS = 20_000
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def buckets(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each different word's bucket and length, its n-grams' buckets and where they start.

    Case and the punctuation around a word don't count."""
    plain = [w.lower().strip(".,;:!?\"'()[]|%*$&#<>") for w in distinct.to_pylist()]
    text = " " + " ".join(plain) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = np.flatnonzero(cp == 32)
    # a word that holds a space of another kind stays one word: boundaries come from lengths
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    starts = np.cumsum(lengths + 1) - lengths
    del space
    word_of = np.full(len(cp), -1)
    word_of[common.gather(starts, lengths)] = np.repeat(np.arange(len(plain)), lengths)
    owner = np.maximum(word_of, np.concatenate([word_of[1:], [-1]]))  # a leading boundary belongs to its word
    at, out = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), np.uint64)
        whole = np.zeros(len(plain), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = len(cp) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                first = owner[:m]
                last = np.where(word_of[n - 1 :] >= 0, word_of[n - 1 :], np.concatenate([[-1], word_of])[n - 1 : n - 1 + m])
                pos = np.flatnonzero((first >= 0) & (first == last))
                out.append((common.mix(h[pos]) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
                at.append(first[pos])
        up = np.concatenate([[np.uint64(1)], np.full(len(cp), 0xD6E8FEB86659FD93, np.uint64)])
        up = np.cumprod(up)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(7)) * up[: len(cp)])])
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(cp), pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)]))
        whole = common.mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64))
    at = np.concatenate(at) if at else np.zeros(0, int)
    order = np.argsort(at, kind="stable")
    grams = np.concatenate(out)[order] if out else np.zeros(0, int)
    return (whole % np.uint64(WORD_BUCKETS)).astype(np.int64), lengths, grams, np.searchsorted(at[order], np.arange(len(plain) + 1))


def features(distinct: pa.Array, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """INPUTS numbers for each different word, and a row of zeros for padding."""
    out = np.zeros((len(distinct) + 1, INPUTS), np.float32)
    for i in range(0, len(distinct), WORDS):  # n-grams take much more room than words
        some = distinct.slice(i, WORDS)
        rows = out[i : i + len(some)]
        word, lengths, gram, starts = buckets(some)
        rows[:, 0] = words[word]
        rows[:, 1] = np.minimum(lengths, 20) / 10 - 0.6
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            odds = grams[gram]
            top = np.maximum.reduceat(odds, starts[full])
            count = np.diff(starts)[full]
            total = np.add.reduceat(odds, starts[full])
            rest = np.where(odds == np.repeat(top, count), -9, odds)
            second = np.maximum.reduceat(rest, starts[full])
            rows[full, 2], rows[full, 3], rows[full, 4] = top, np.where(second > -9, second, top), total / count
    return out


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    if n <= window:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - window + 1, stride)
    return s if s[-1] == n - window else np.append(s, n - window)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (among all words) and size of every window."""
    sizes = np.diff(offsets)
    per = [window_starts(int(n)) for n in sizes]
    count = np.fromiter(map(len, per), np.int64, len(per))
    doc = np.repeat(np.arange(len(per)), count)
    first = (np.concatenate(per) if per else np.zeros(0, np.int64)) + offsets[doc]
    return doc, first, np.minimum(sizes[doc], WINDOW)


class Network:
    """Dense input layer, GRU in both directions, attention, logit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"Wi": draw(INPUTS, DENSE), "bi": np.zeros(DENSE, np.float32), "a": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(DENSE, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": draw(HIDDEN, 3 * HIDDEN)}

    def inputs(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What each different word adds to the gates, in both directions."""
        e = np.tanh(rows @ self.p["Wi"] + self.p["bi"])
        return {"e": e} | {d: e @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: at (windows, steps) numbers of words, mask of real steps."""
        n, steps = at.shape
        H = HIDDEN
        states = np.empty((steps, n, 2 * H), np.float32)
        tape = {}
        ragged = not mask.all()
        for k, d in enumerate("fb"):
            h, U, g = np.zeros((n, H), np.float32), self.p[f"U{d}"], gates[d]
            tape[d] = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, u = g[at[:, t]], h @ U
                zr = np.tanh((x[:, : 2 * H] + u[:, : 2 * H]) * np.float32(0.5))
                zr += 1
                zr *= np.float32(0.5)
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
                new = c + z * (h - c)
                if ragged:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    tape[d].append((t, h, z, r, c, u[:, 2 * H :]))
                h = new
                states[t, :, k * H : (k + 1) * H] = h
        score = np.where(mask.T, states @ self.p["a"], np.float32(-1e9))
        score = np.exp(score - score.max(0))
        weight = score / score.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["o"] + self.p["ob"]
        return (logit, states, weight, pooled, tape) if keep else logit

    def gradient(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, for all parameters."""
        p, H = self.p, HIDDEN
        gates = self.inputs(rows)
        logit, states, weight, pooled, tape = self.run(gates, at, mask, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
        g["o"], g["ob"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pool = d_logit[:, None] * p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["a"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pool + d_score[:, :, None] * p["a"]
        d_e = np.zeros_like(gates["e"])
        for k, d in enumerate("fb"):
            U, dh = p[f"U{d}"], np.zeros((len(at), H), np.float32)
            d_gate = np.zeros_like(gates[d])
            for t, h, z, r, c, uc in reversed(tape[d]):
                dh = dh + d_states[t, :, k * H : (k + 1) * H]
                real = mask[:, t, None]
                live = dh * real
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                g[f"U{d}"] += h.T @ du
                np.add.at(d_gate, at[:, t], np.concatenate([dz, dr, dc], 1))
                dh = live * z + du @ U.T + dh * ~real
            g[f"W{d}"], g[f"b{d}"] = gates["e"].T @ d_gate, d_gate.sum(0)
            d_e += d_gate @ p[f"W{d}"].T
        d_in = d_e * (1 - gates["e"] ** 2)
        g["Wi"], g["bi"] = rows.T @ d_in, d_in.sum(0)
        return g


def grid(first: np.ndarray, size: np.ndarray, codes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in each window, and which places hold a word."""
    steps = max(int(size.max()) if len(size) else 1, 1)
    mask = np.arange(steps) < np.maximum(size, 1)[:, None]
    real = np.arange(steps) < size[:, None]
    at = np.full(mask.shape, pad)
    at[real] = codes[(first[:, None] + np.arange(steps))[real]]
    return at, mask


def logits(net: Network, rows: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of windows, in blocks; windows of equal size together, so that few places are empty."""
    gates, out = net.inputs(rows), np.zeros(len(first), np.float32)
    order = np.argsort(size, kind="stable")
    for i in range(0, len(order), BLOCK):
        k = order[i : i + BLOCK]
        at, mask = grid(first[k], size[k], codes, len(rows) - 1)
        out[k] = net.run(gates, at, mask)
    return out


def train(rows: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray, bag: np.ndarray, label: np.ndarray) -> Network:
    """Multiple-instance training: bag is each window's document, ascending; label is per document."""
    net, rng = Network(), np.random.default_rng(SEED)
    m, v, step = {}, {}, 0
    starts = np.searchsorted(bag, np.arange(len(label) + 1))
    strength = None
    epochs = max(EPOCHS, min(MOST_EPOCHS, -(-LEAST_STEPS * BATCH // (len(label) + int((label == 0).sum()) // 2))))
    for epoch in range(epochs):
        if epoch % 3 == 0:
            if epoch == 0:  # before the network knows anything: the window of the highest inputs
                top = np.maximum(rows[codes, 0], rows[codes, 2]) if len(codes) else np.zeros(0)
                total = np.concatenate([[0], np.cumsum(top > 1.0)])
                strength = (total[first + size] - total[first]).astype(np.float32)
            else:
                strength = logits(net, rows, codes, first, size)
            best = np.array([s + int(np.argmax(strength[s:e])) for s, e in zip(starts[:-1], starts[1:])])
        # beside the best window, one of negative documents at random
        other = np.array([rng.integers(s, e) for s, e in zip(starts[:-1], starts[1:])])
        use = np.concatenate([best, other[label == 0][::2]])
        want = np.concatenate([label, np.zeros(len(other[label == 0][::2]))]).astype(np.float32)
        order = rng.permutation(len(use))
        for i in range(0, len(order), BATCH):
            k = order[i : i + BATCH]
            at, mask = grid(first[use[k]], size[use[k]], codes, len(rows) - 1)
            known, local = np.unique(at, return_inverse=True)
            g = net.gradient(rows[known], local.reshape(at.shape), mask, want[k])
            step += 1
            rate = RATE * (0.5 if epoch > epochs // 2 else 1)
            for name, x in g.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                v[name] = 0.999 * v.get(name, 0) + 0.001 * x * x
                net.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def calibrate(score: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on document logits, with label 1 weighted to share."""
    weight = np.where(label == 1, share / max((label == 1).mean(), 1e-9), (1 - share) / max((label == 0).mean(), 1e-9))
    # targets away from 0 and 1 keep the curve finite where the classes part cleanly
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score.astype(float), np.ones(len(score))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-6 * (w - [1, 0]))
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return {"share": share}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = {k: int(min(1.0, sample / n) * (1 << 20)) for k, n in sizes.items()}
    chosen = known.where(place < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    # at most about 2 x sample rows of two numbers and an id, whatever the input
    found = common.id_text(docs).join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = common.settled(spark, found.groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text")), "sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:  # fewer rows of long texts
        rows = common.settled(spark, rows.where(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 20)) < int(SAMPLE_BYTES / size * (1 << 20))), "sample")

    def count(batches):
        # documents by half, kind (word or n-gram), class and bucket, of all texts of a task
        seen = np.zeros((2, 2, 2, GRAM_BUCKETS), np.int64)
        for b in common.parts(batches, most=COUNTED_BYTES):
            offsets, words = common.split_words(b["text"])
            codes, distinct = common.coded_words(words)
            if not len(codes):
                continue
            word, _, gram, starts = buckets(distinct)
            half, toxic = np.asarray(b["half"]), np.asarray(b["toxic"])
            for i in range(b.num_rows):
                w = np.unique(codes[offsets[i] : offsets[i + 1]])
                for kind, places in ((0, word[w]), (1, gram[common.gather(starts[w], np.diff(starts)[w])])):
                    seen[half[i], kind, toxic[i], np.unique(places)] += 1
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({**{k: pa.array(x, pa.int32()) for k, x in zip(("half", "kind", "toxic", "g"), at)}, "n": pa.array(seen[at], pa.int64())})

    docs_of = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    if len(docs_of) < 4:
        return {"share": share}
    # at most two halves, two classes and the buckets
    got = rows.select("text", "toxic", "half").mapInArrow(count, "half int, kind int, toxic int, g int, n long").groupBy("half", "kind", "toxic", "g").agg(F.sum("n").alias("n")).toPandas()

    def odds(half: int, kind: int, size: int) -> np.ndarray:
        out, seen = np.zeros(size), np.zeros(size, bool)
        for label, sign in ((1, 1), (0, -1)):
            part = got[(got["half"] == half) & (got["kind"] == kind) & (got["toxic"] == label)]
            share_of = np.full(size, PRIOR / (docs_of[half, 0] + docs_of[half, 1]))
            share_of[part["g"].to_numpy()] += part["n"].to_numpy() / docs_of[half, label]
            seen[part["g"].to_numpy()] = True
            out += sign * np.log(share_of)
        return np.where(seen, out, 0).astype(np.float32)  # a bucket that neither class shows says nothing

    halves = [[odds(h, kind, size) for kind, size in ((0, WORD_BUCKETS), (1, GRAM_BUCKETS))] for h in (0, 1)]
    tables = [(a + b) / 2 for a, b in zip(*halves)]
    del got

    # the sample's rows are bounded; of each, training and calibration see all windows, as scoring does
    whole = rows.select("doc_id", "text", "toxic", "half").toArrow().sort_by("doc_id")
    bags, of = np.unique(whole["doc_id"].to_numpy(), return_inverse=True)
    half, label = whole["half"].to_numpy(), np.zeros(len(bags), int)
    label[of] = whole["toxic"].to_numpy()
    offsets, codes, distinct = common.coded_texts(whole["text"])
    del whole
    doc, first, size = windows_of(offsets)
    bag = of[doc]
    # the inputs of a half's words come from the other half's table, one after the other
    inputs = [features(distinct, *halves[1 - h]) for h in (0, 1)]
    inputs = np.concatenate([inputs[0][:-1], inputs[1]])
    codes += np.repeat(half, np.diff(offsets)).astype(codes.dtype) * codes.dtype.type(len(distinct))
    net = train(inputs, codes, first, size, bag, label)
    best = np.full(len(bags), -np.inf)
    np.maximum.at(best, bag, logits(net, inputs, codes, first, size))
    slope, intercept = calibrate(best, label, share)
    return {"share": share, "tables": tables, "net": net.p, "slope": slope, "intercept": intercept}


def scorer(spark, model: dict):
    """A function from an Arrow array of texts to their scores, to run on executors."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> np.ndarray:
        model = sent.value
        if "net" not in model:
            return np.full(len(texts), model["share"])
        net = Network()
        net.p = model["net"]
        offsets, words = common.split_words(texts)
        codes, distinct = common.coded_words(words)
        doc, first, size = windows_of(offsets)
        rows = features(distinct, *model["tables"])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, logits(net, rows, codes, first, size))
        return 1 / (1 + np.exp(-np.clip(model["slope"] * best + model["intercept"], -30, 30)))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score. Whole texts, all overlapping windows."""
    common.small_batches(docs.sparkSession)
    run = scorer(docs.sparkSession, model)

    def each(batches):
        for b in common.parts(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(run(b["text"]))})

    return common.id_text(docs).mapInArrow(each, "doc_id long, score double")


def keep(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    common.small_batches(docs.sparkSession)
    run = scorer(docs.sparkSession, model)

    def each(batches):
        for b in common.parts(batches):
            yield b.filter(pa.array(run(b["text"]) < threshold))

    return docs.mapInArrow(each, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
