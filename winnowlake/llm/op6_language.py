"""Language identification as multilingual mixture inference (operator 6).

Training counts character n-grams (one to four, with word boundaries) of labelled documents per
language, in a hashed table of fixed size. At inference each different word gets its n-gram
log-likelihood in each language. A document is a mixture of languages: expectation-maximisation
over its words estimates the proportions. The language set grows by the next largest proportion as
long as the penalised likelihood (BIC) improves, up to all learned languages; expectation-
maximisation within the set gives its proportions. The largest proportion names the language and
is the score.

Defined results: null text and text without a letter are ``und`` with score 0 and no set; ties go to
the language that sorts first; without any training row every document is ``und``; rows are
independent, so repeated rows change nothing; texts may have any length; extra columns are ignored;
a null doc_id stays null; an empty table gives no rows. LANGUAGES bounds the labels that are learned:
the most frequent ones (ties: the first in order); rows with another label don't train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
MAX_N = 4
#: Labelled documents per language that training reads, at most about so many (chosen by a hash of doc_id).
SAMPLE_PER_LANGUAGE = 3000
ROUNDS, SET_ROUNDS = 8, 4
#: Languages that are learned at most; the model has BUCKETS numbers for each.
LANGUAGES = 200
#: Pseudo-count of an n-gram that a language hasn't shown.
SMOOTHING = 0.5


def grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the words, and where each word's n-grams start."""
    text = " " + " ".join(w.lower() for w in distinct.to_pylist()) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = np.cumsum(cp == 32)
    out, at = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), np.uint64)
        for n in range(1, MAX_N + 1):
            m = len(cp) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(n)
            # a gram may hold a boundary at its ends alone, and something beside boundaries
            inner = space[n - 2 : n - 2 + m] - space[:m] if n > 2 else np.zeros(m, int)
            ok = (inner == 0) & ~((cp[:m] == 32) & (n == 1)) & ~((n == 2) & (cp[:m] == 32) & (cp[n - 1 :] == 32))
            pos = np.flatnonzero(ok)
            # the word is the one that the gram's last character but a boundary belongs to
            word = space[pos] - 1
            out.append(common.mix(h[pos]) % np.uint64(BUCKETS))
            at.append(word)
    word = np.concatenate(at)
    order = np.argsort(word, kind="stable")
    return np.concatenate(out)[order].astype(np.int64), np.searchsorted(word[order], np.arange(len(distinct) + 1))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and a table (language, bucket) of log-probabilities from labelled documents
    (doc_id, text, lang). Its size is fixed; texts stay on the executors."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang").where("lang is not null")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r["lang"] for r in frequent)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20))
    shares = spark.createDataFrame([(r["lang"], int(min(1.0, per_language / r["n"]) * (1 << 20))) for r in frequent], "lang string, share int")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in common.parts(batches):
            offsets, words = common.split_words(b["text"])
            if not len(words):
                continue
            codes, distinct = common.coded_words(words)
            bucket, starts = grams(distinct)
            of_doc = np.array([number[k] for k in b["lang"].to_pylist()])
            own = np.repeat(of_doc, np.diff(offsets))
            for k in np.unique(own):
                times = np.bincount(codes[own == k], minlength=len(distinct))
                total[k] += np.bincount(bucket, np.repeat(times, np.diff(starts)), BUCKETS).astype(np.int64)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "g": pa.array(g, pa.int32()), "n": pa.array(total[k, g], pa.int64())})

    common.small_batches(spark)
    chosen = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(shares), "lang").where(place < F.col("share"))
    # at most languages x buckets rows, whatever the input's size
    got = chosen.select("lang", "text").mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    table[got["k"].to_numpy(), got["g"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True))


def mixtures(own: np.ndarray, weight: np.ndarray, like: np.ndarray, n_docs: int) -> np.ndarray:
    """Proportions (documents, languages) of each document's best language set, 0 outside of it.

    own: document of each (document, word) pair, ascending; weight: how often; like: the pair's
    log-likelihoods (pairs, languages).
    """
    n_lang = like.shape[1]
    out = np.zeros((n_docs, n_lang))
    live = np.unique(own)  # documents with words, and then those whose set still grows
    own = np.searchsorted(live, own)
    p = np.exp(like - like.max(1, keepdims=True))

    def improve(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after some rounds, and the log-likelihood that they give."""
        for _ in range(rounds):
            joint = share[own] * p
            joint *= (weight / np.maximum(joint.sum(1), 1e-300))[:, None]
            share = np.maximum(np.add.reduceat(joint, starts, axis=0) / total[:, None], 1e-12 * (share > 0))
        return share, np.add.reduceat(weight * np.log(np.maximum((share[own] * p).sum(1), 1e-300)), starts)

    if not len(live):
        return out
    starts = np.searchsorted(own, np.arange(len(live)))
    total = np.add.reduceat(weight, starts)
    share, _ = improve(np.full((len(live), n_lang), 1 / n_lang), ROUNDS)
    # the largest first; on ties the language that sorts first
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best = np.full(len(live), -np.inf)
    for k in range(1, n_lang + 1):
        chosen = np.where(rank < k, np.maximum(share, 1e-6), 0)
        kept, value = improve(chosen / chosen.sum(1, keepdims=True), SET_ROUNDS if k > 1 else 0)
        value = value - 0.5 * (2 * k - 1) * np.log(total + 1)
        better = np.flatnonzero(value > best)
        out[live[better]] = kept[better]
        if len(better) < len(live):  # the others are done
            same = np.zeros(len(live), bool)
            same[better] = True
            pairs = same[own]
            own, weight, p = np.cumsum(same)[own[pairs]] - 1, weight[pairs], p[pairs]
            live, share, rank, total = live[better], share[better], rank[better], total[better]
            value = value[better]
            if not len(live):
                break
            starts = np.searchsorted(own, np.arange(len(live)))
        best = value
    return np.clip(out, 0, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages (the set, largest proportion first) and proportions. Whole
    texts; nothing but the text is used."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def each(batches):
        langs, logs = sent.value
        by_bucket = np.ascontiguousarray(logs.T)
        for b in common.parts(batches):
            n = b.num_rows
            offsets, words = common.split_words(b["text"])
            lang, score, sets, shares = ["und"] * n, np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
            if len(words) and langs:
                codes, distinct = common.coded_words(words)
                bucket, starts = grams(distinct)
                like = np.add.reduceat(by_bucket[bucket], starts[:-1], axis=0, dtype=np.float64)
                letters = np.asarray(pc.match_substring_regex(distinct, r"\pL"), dtype=bool)
                doc = np.repeat(np.arange(n), np.diff(offsets))
                keep = letters[codes]
                pairs, times = np.unique(doc[keep] * len(distinct) + codes[keep], return_counts=True)
                own = pairs // len(distinct)
                if len(pairs):
                    share = mixtures(own, times.astype(float), like[pairs % len(distinct)], n)
                    order = np.argsort(-share, axis=1, kind="stable")
                    for i in np.unique(own).tolist():
                        some = [k for k in order[i].tolist() if share[i, k] > 0]
                        lang[i], score[i] = langs[some[0]], share[i, some[0]]
                        sets[i], shares[i] = [langs[k] for k in some], share[i, some].tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": b["doc_id"], "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score),
                "languages": pa.array(sets, pa.list_(pa.string())), "proportions": pa.array(shares, pa.list_(pa.float64())),
            })

    return common.id_text(docs).mapInArrow(each, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "proportions")
