import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnowlake.llm import common, op1_packing, op2_quality, op3_chat, op4_substring, op5_simhash, op6_language, op7_bitpack, op8_permutation, op9_toxicity, op10_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\t", "a", "Foo foo\u00a0bar", "x" * 3000, "it's <|endoftext|> né? 日本語 123!", "\\### Assistant: </turn>", "a b c a b c a b c", "don't stop " * 300]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, long ones, a null doc_id, repeated rows and clashing extra columns."""
    rows = [(i, t, "s", 1) for i, t in enumerate(ODD)] + [(3, "a", "s", 1), (None, "no id", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, check string, fp int")


#: Names that operators use for columns of their own.
OWN = "row check m h g start n source at one two wanted _slot _b _m _id _w _gone _node _first _text own node root call signature text_id fp leaf home shard score kept failed".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Null, empty, wordless and very long texts, ties, repeated rows, null and repeated ids, and
    columns named as the operators' own."""
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 5000, n))
    a, long, shared = draw(200), draw(30_000), draw(80)
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, a), (4, a), (4, a), (5, long), (6, long + " end"), (7, draw(90) + " " + shared), (8, draw(90) + " " + shared + " " + draw(90)), (9, draw(120)), (9, draw(120)), (None, draw(120)), (None, a), (10, "short one"), (11, "x" * 100_000)]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)
    return spark.createDataFrame([(k, t, len(t or ""), *["x"] * len(OWN)) for k, t in texts], schema).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r.text for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}


def ids_of(text, end):
    return common.word_tokens(common.vocabulary_path(common.WORD_BPE)).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["op2_quality", "op3_chat", "op4_substring"])
def test_equals_sql(same, name):
    same(name)


def check_packing(pieces, texts):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, rows in by_doc.items():
        ids, at = ids_of(texts[k], 2), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_packing(spark, sf, documents, odd):
    check_packing(op1_packing.op1_packing(spark, sf).collect(), documents)
    check_packing(op1_packing.pack(odd.where("doc_id <> 3"), docs_per_shard=3).collect(), {i: t for i, t in enumerate(ODD) if i != 3})
    pieces = op1_packing.pack(odd, docs_per_shard=2).collect()  # repeated rows, a null doc_id
    want = sorted([len(ids_of(t, 2)) for t in [*ODD, "a", "no id"]])
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == want and sum(r.length for r in pieces) == sum(want)
    assert op1_packing.pack(odd.limit(0)).count() == 0


def test_packing_finds_neighbours():
    texts = ["apple pear plum", "stone brick wall", "pear plum fig", "wall brick tower"]
    offsets, words = common.split_words(pa.array(texts))
    codes, distinct = common.coded_words(words)
    index = op1_packing.BM25(offsets, codes, len(distinct))
    assert list(index.neighbours(0, np.array([False, True, True, True]))) == [2]


def test_quality_odd(odd):
    led = op2_quality.apply(op2_quality.ledger(odd))
    got = {r.doc_id: r for r in led.collect()}
    assert len(got) == 11 and not got[0].kept and got[0].n_words == 0 and got[8].n_repeat_words == 9
    ab = {(r.policy, r.without): r.n_kept for r in op2_quality.ablations(led).collect()}
    assert ab["strict-2", None] == sum(r.kept for r in led.collect())
    assert ab["strict-2", "min_words"] >= ab["strict-2", None]
    assert op2_quality.keep(odd).columns == odd.columns


def test_quality_repeats(spark):
    texts = ["a b c d a b c", "a a a a a", "a b", "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in op2_quality.ledger(df).orderBy("doc_id").collect()] == [6, 5, 0, 0]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", t) for t in ODD] + [(1, 1, None, "x"), (2, 0, "user", "q"), (2, 1, "assistant", "a\n</turn>\n"), (3, 0, "~Tool:\n", "#"), (None, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op3_chat.read_back(op3_chat.format(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", t) for t in sorted(t or "" for t in ODD)] + [("", "x")]
    assert got[2].loss_text == "a\n</turn>\n" and got[2].valid and not got[1].valid and got[1].broken_at == 1
    assert [(t.role, t.text) for t in got[3].turns] == [("~Tool:\n", "#")] and None in got
    assert op3_chat.format(df.limit(0)).count() == 0


@given(st.text(alphabet="\\<#~:blhtc/turn> \n", max_size=30))
@settings(max_examples=100, deadline=None)
def test_escape_is_reversible(text):
    plain = text
    for a, b in op3_chat.TEMPLATE["escapes"].items():
        text = text.replace(a, b)
    assert not set("<#~:") & set(text)
    for a, b in reversed(op3_chat.TEMPLATE["escapes"].items()):
        text = text.replace(b, a)
    assert text == plain


def brute_substrings(rows, window):
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            p = tuple(w[i : i + window])
            first[p] = min(first.get(p, k), k)
    out = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                keep[i : i + window] = [False] * window
        out[k] = " ".join(x for x, y in zip(w, keep) if y)
    return out


def test_substrings_random(spark):
    rng = np.random.default_rng(5)
    phrase = [[str(x) for x in rng.integers(0, 6, 30)] for _ in range(6)]
    rows = [(int(k), " ".join(w for i in rng.integers(0, 6, 5) for w in phrase[i][rng.integers(0, 9) : 21 + rng.integers(0, 9)])) for k in rng.permutation(60)]
    got = op4_substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=8, anchor=3)
    assert {r.doc_id: r.kept for r in got.collect()} == brute_substrings(rows, 8)


def test_factors_are_runs_of_their_sources(spark):
    """Each factor's words stand in the source from its place on, and no phrase is left that a smaller doc_id has."""
    rng = np.random.default_rng(6)
    phrase = [[f"{i}w{x}" for x in rng.integers(0, 9, 40)] for i in range(8)]
    rows = [(int(k), " ".join(w for i in rng.integers(0, 8, 6) for w in phrase[i][rng.integers(0, 12) : 28 + rng.integers(0, 12)])) for k in rng.permutation(80)]
    words = {k: t.split() for k, t in rows}
    got = op4_substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=12, anchor=4).collect()
    factors = [(r.doc_id, f) for r in got for f in r.factors]
    assert len(factors) > 100 and max(f.words for _, f in factors) > 30
    for k, f in factors:
        assert f.source < k and f.words >= 12
        assert words[k][f.start : f.start + f.words] == words[f.source][f.at : f.at + f.words]
    assert {r.doc_id: r.kept for r in got} == brute_substrings(rows, 12)


def test_parse():
    p = lambda *m: op4_substring.parse(*np.array(m).T.reshape(4, -1), 50)
    assert p((0, 1, 7, 3), (1, 1, 7, 4)) == [(0, 51, 7, 3)]  # neighbours there too
    assert p((0, 1, 7, 3), (1, 1, 7, 9)) == [(0, 50, 7, 3), (1, 50, 7, 9)]
    assert p((2, 1, 7, 5), (0, 4, 7, 3), (4, 2, 7, 7), (9, 1, 7, 12)) == [(0, 55, 7, 3), (9, 50, 7, 12)]
    assert p((0, 2, 7, 3), (1, 3, 2, 0)) == [(0, 51, 7, 3), (1, 52, 2, 0)]


def test_substrings_odd(odd):
    got = op4_substring.dedup(odd).collect()
    assert len(got) == 12 and all(r.n_removed == 0 for r in got)
    assert op4_substring.keep(odd).columns == odd.columns and op4_substring.keep(odd).count() == 12
    assert op4_substring.dedup(odd.limit(0)).count() == 0


def brute_simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    keys, up = sorted(fps), {k: k for k in fps}
    for a in keys:
        for b in keys:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)

    def root(k):
        return k if up[k] == k else root(up[k])

    return {k: root(k) for k in keys}


def test_simhash(spark, sf, documents):
    fps = {k: brute_simhash(t) for k, t in documents.items()}
    want = brute_components(fps, 2)
    got = op5_simhash.op5_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


def test_vantage_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    near = base[rng.integers(0, 700, 2500)] ^ (np.uint64(1) << rng.integers(0, 63, 2500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 2500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    tree = op5_simhash.grow(fps[::3], 16)
    leaf, at, home = op5_simhash.route(tree, fps, 2)
    assert len(set(leaf)) > 4 and sorted(at[home]) == list(range(len(fps)))
    sets = op5_simhash.Sets(len(fps))
    for n in set(leaf):
        local = op5_simhash.Sets(int((leaf == n).sum()))
        op5_simhash.link(fps[at[leaf == n]], home[leaf == n], np.arange(len(local.up)), local, 2)
        sets.join(at[leaf == n], at[leaf == n][local.flat()])
    want = brute_components({i: int(x) for i, x in enumerate(fps)}, 2)
    assert sets.flat().tolist() == [want[i] for i in range(len(fps))]


def test_simhash_odd(spark, odd):
    got = op5_simhash.near_duplicates(odd).collect()
    assert len(got) == 12 and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert op5_simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = sorted((r.doc_id is None, r.doc_id) for r in op5_simhash.keep(odd).collect())
    assert kept == [(False, i) for i in (0, 3, 4, 5, 6, 7, 8, 9)] + [(True, None)]


def test_near_copies(spark, documents):
    text = max(documents.values(), key=lambda t: len(t or "")).split()[:300]
    copy, other = list(text), list(text)
    copy[50] = copy[200] = "changed"
    other[::5] = ["other"] * len(other[::5])
    df = spark.createDataFrame([(5, " ".join(text)), (6, " ".join(copy)), (7, " ".join(other))], "doc_id long, text string")
    assert {r.node: r.root for r in op5_simhash.near_copies(df).collect()}.get(6) == 5
    assert sorted(r.doc_id for r in op5_simhash.keep(df).collect()) == [5, 7]


def brute_near(rows):
    """Least doc_id of each document's component, by Jaccard of five-word shingles."""
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {k: k for k in sets}

    def root(k):
        return k if up[k] == k else root(up[k])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def test_near_copies_equal_brute_force(spark):
    """Truncated, extended and edited copies, down to the threshold, of short and long texts with a common passage."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.2, n), 50_000)]
    license, rows = draw(60), []
    for n in (5, 6, 8, 12, 30, 100, 100, 300, 700, 1500):
        text = draw(n) + license * int(rng.integers(0, 2))
        m = len(text)
        for cut in (0.05, 0.1, 0.15, 0.18, 0.19, 0.2, 0.22):
            k = int(m * cut)
            rows += [text[: m - k], text[k:], text + draw(k), draw(k) + text]
        for changes in (1, 2, m // 50):
            copy = list(text)
            for i in rng.integers(0, m, changes):
                copy[i] = "changed"
            rows.append(copy)
        rows.append(text)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = brute_near(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.node: r.root for r in op5_simhash.near_copies(df).collect()}
    assert {k: got.get(k, k) for k in want} == want and len(set(want.values())) > 10
    assert sorted(r.doc_id for r in op5_simhash.keep(df).collect()) == sorted(set(want.values()))


def test_verified_equals_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sets = []
        for _ in range(rng.integers(1, 25)):
            if sets and rng.random() < 0.6:
                old = sets[rng.integers(len(sets))]
                x = np.concatenate([old[rng.random(len(old)) < rng.choice([0.8, 0.9, 1])], rng.integers(0, 60, rng.integers(0, 3)).astype(np.uint64)])
            else:
                x = rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)
            sets.append(np.unique(x))
        want = op5_simhash.Sets(len(sets))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9:
                    want.join(np.array([i]), np.array([j]))
        want, got = want.flat(), op5_simhash.verified(sets)
        assert ((want[:, None] == want[None]) == (got[:, None] == got[None])).all()


def test_large_candidate_components_take_no_quadratic_time():
    """Many texts that share a passage but aren't near copies: each was compared with all, some 15 seconds for 3,000."""
    import time

    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 400).astype(np.uint64), shared])) for _ in range(3000)]
    began = time.time()
    assert len(np.unique(op5_simhash.verified(sets))) == 3000
    assert time.time() - began < 5


def test_near_copies_go_by_fingerprints(spark, documents, monkeypatch):
    """All texts that operator 5 links are candidates of the pipeline's stage, which verifies them."""
    word = lambda a, i: f"{a}{i * 7919 % 1009}"
    texts = {10_000 + k: " ".join(["spam"] * 60 + [word(a, i) for i in range(38)]) for k, a in enumerate("xyz")}
    texts |= {k: t or "" for k, t in list(documents.items())[:80]}
    want = brute_components({k: brute_simhash(t) for k, t in texts.items()}, 2)
    assert want[10_001] == want[10_002] == 10_000
    seen, components = [], op5_simhash.components
    monkeypatch.setattr(op5_simhash, "components", lambda links: seen.append(components(links)) or seen[-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in op5_simhash.keep(df).collect()}
    root = {r.node: r.root for r in seen[0].collect()}
    ids = {r.doc_id: r.t for r in df.select("doc_id", op5_simhash.text_id().alias("t")).collect()}
    assert all(root.get(ids[k], ids[k]) == root.get(ids[v], ids[v]) for k, v in want.items())
    assert {10_000, 10_001, 10_002} <= kept


def test_near_copies_of_repeated_content(spark):
    """A text and the same text several times over have nearly the same shingles, though lengths differ much."""
    text = [f"w{i}" for i in range(300)]
    rows = [(1, text), (2, text * 2), (3, text * 5), (4, text[:250] + text[:200]), (5, text[:150] * 2)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in op5_simhash.keep(df).collect()) == [1, 5]


def test_near_copies_by_id_and_text(spark):
    """Different texts of one doc_id stay; equal texts are one, with or without doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (None, c), (None, c), (None, a), (None, "odd one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in op5_simhash.keep(df).collect())
    assert got == sorted([(1, a), (1, b), (0, c), (0, "odd one")])


def test_language(spark, sf, odd):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = op6_language.op6_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 100 and got.where("lang = lang_pred").count() / got.count() > 0.97
    model = op6_language.fit(docs)
    r = {r.doc_id: r for r in op6_language.predict(odd, model).collect()}
    assert r[0].lang_pred == r[2].lang_pred == "und" and r[0].score == 0 and 0 <= r[4].score <= 1
    none = op6_language.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in op6_language.predict(odd, none).collect()} == {"und"}


def test_packing_neighbours_by_definition():
    """BM25 scores and order equal the plain formula, over all terms; a seed's answers leave out no document that shares a term."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(1, 40)), 60)) for _ in range(40)]
    words = [t.split() for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for x in words for w in set(x))

    def bm25(q, d):
        c, norm = Counter(words[d]), op1_packing.K1 * (1 - op1_packing.BETA + op1_packing.BETA * len(words[d]) / mean)
        return sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (op1_packing.K1 + 1) / (c[w] + norm) for w in set(words[q]) if df[w] > 1)

    offsets, flat = common.split_words(pa.array(texts))
    codes, distinct = common.coded_words(flat)
    index = op1_packing.BM25(offsets, codes, len(distinct))
    for q in range(n):
        unused = rng.random(n) < 0.7
        unused[q] = False
        got = list(index.neighbours(q, unused, 1000))
        score = [bm25(q, d) for d in got]
        assert set(got) == {d for d in np.flatnonzero(unused) if bm25(q, d) > 0}
        assert all(a >= b - 1e-4 for a, b in zip(score, score[1:]))
        asked, by_step = unused.copy(), []
        for d in index.neighbours(q, asked, 2):  # a document that is taken doesn't come again
            asked[d] = False
            by_step.append(d)
        assert len(set(by_step)) == len(by_step) and set(by_step) == set(got)


def brute_mixture(weight, like):
    """The best language set of one document: expectation-maximisation for every subset, by loops."""
    best = None
    p = np.exp(like - like.max(1, keepdims=True))
    for bits in range(1, 1 << like.shape[1]):
        some = [k for k in range(like.shape[1]) if bits >> k & 1]
        share = {k: 1 / len(some) for k in some}
        for _ in range(60):
            got = dict.fromkeys(some, 0.0)
            for w, x in zip(weight, p):
                total = sum(share[k] * x[k] for k in some)
                for k in some:
                    got[k] += w * share[k] * x[k] / total
            share = {k: v / weight.sum() for k, v in got.items()}
        value = sum(w * np.log(sum(share[k] * x[k] for k in some)) for w, x in zip(weight, p))
        value -= 0.5 * (2 * len(some) - 1) * np.log(weight.sum() + 1)
        if best is None or value > best[0] + 1e-9:
            best = value, share
    return best[1]


def test_mixtures_equal_all_subsets():
    """The growing set against every subset of four languages, on documents that mix one to four of them."""
    rng = np.random.default_rng(9)
    own, weight, like, mixed = [], [], [], []
    for d in range(24):
        k = 1 + d % 4
        some = rng.choice(4, k, replace=False)
        n = int(rng.integers(20, 60)) * k
        truth = some[rng.integers(0, k, n)]
        x = rng.normal(-9, 1.5, (n, 4))
        x[np.arange(n), truth] += 7
        own, like, mixed = own + [d] * n, [*like, x], [*mixed, set(some.tolist())]
        weight.append(rng.integers(1, 4, n).astype(float))
    own, like, weight = np.array(own), np.concatenate(like), np.concatenate(weight)
    got = op6_language.mixtures(own, weight, like, 25)
    assert not got[24].any()
    right = 0
    for d in range(24):
        want = brute_mixture(weight[own == d], like[own == d])
        assert {k for k in range(4) if got[d, k] > 0} == set(want)
        assert all(abs(got[d, k] - v) < 0.02 for k, v in want.items())
        right += set(want) == mixed[d]
    assert right >= 22


def test_language_odd(spark, clashing):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("junk"), "doc_id")).otherwise(F.col("lang")).alias("lang"))
    few = op6_language.LANGUAGES
    try:
        op6_language.LANGUAGES = 4
        model = op6_language.fit(docs)
    finally:
        op6_language.LANGUAGES = few
    assert len(model[0]) == 4 and not any(k.startswith("junk") for k in model[0])
    got = op6_language.predict(clashing, model).collect()
    assert len(got) == clashing.count() and op6_language.predict(clashing.limit(0), model).count() == 0
    for r in got:
        assert (r.lang_pred == "und") == (not r.languages) and len(r.languages) == len(r.proportions)
        assert not r.languages or (r.languages[0] == r.lang_pred and abs(sum(r.proportions) - 1) < 1e-6 and r.proportions[0] == r.score)


@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.sampled_from([16, 17, 20]))
@settings(max_examples=60, deadline=None)
def test_bits(ids, width):
    x = np.array(ids, np.uint32) % (1 << width)
    assert op7_bitpack.unpack_bits(op7_bitpack.pack_bits(x, width), len(x), width).tolist() == x.tolist()
    assert op7_bitpack.width_of(49408) == 16 and op7_bitpack.width_of(65537) == 17


def test_packing_of_whole_bytes():
    """Ids of 16 bits are copied; the general way gives the same bytes."""
    x = np.random.default_rng(0).integers(0, 1 << 16, 1000).astype(np.uint32)
    bits = (x[:, None] >> np.arange(16, dtype=np.uint32)) & 1
    assert op7_bitpack.pack_bits(x, 16) == np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def test_random_access():
    import io

    ids = np.arange(1000, dtype=np.uint32)
    r = op7_bitpack.Reader(io.BytesIO(op7_bitpack.encode_file(ids, np.array([0, 10, 10, 1000]), [4, None, 9], 17, 64)))
    assert r.read(60, 200).tolist() == list(range(60, 200)) and r.document(1).tolist() == [] and r.document(0).tolist() == list(range(10))


def test_bitpack(spark, sf, documents, odd, tmp_path):
    got = {r.doc_id: r for r in op7_bitpack.op7_bitpack(spark, sf).collect()}
    at = 0
    for k in sorted(documents):
        ids = ids_of(documents[k], 1)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = f"file://{tmp_path}/odd"
    got = sorted(op7_bitpack.read(op7_bitpack.write(odd, folder), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(t, 1)) for t in [*ODD, "a", "no id"])
    folder = f"file://{tmp_path}/none"
    assert op7_bitpack.read(op7_bitpack.write(odd.limit(0), folder), folder).count() == 0


def test_words_of_a_group_are_encoded_once(documents, monkeypatch):
    """Groups hold every part once and in order; their ids are those of the parts."""
    monkeypatch.setattr(op7_bitpack, "ENCODED_BYTES", 100_000)
    texts = pa.array([None, "", *documents.values(), "x " * 80_000, "end"], pa.string())
    parts = list(common.parts([pa.record_batch({"text": texts})], most=20_000))
    groups = list(op7_bitpack.grouped(parts))
    assert [b for g in groups for b in g] == parts and max(map(len, groups)) > 1
    path = common.vocabulary_path(common.WORD_BPE)
    for g in groups:
        ids, cuts = common.coded_ids(*common.coded_texts(pa.chunked_array([b["text"] for b in g])), path, 1)
        want = [common.token_ids(b["text"], path, 1) for b in g]
        assert np.array_equal(ids, np.concatenate([x for x, _ in want]))
        assert np.array_equal(np.diff(cuts), np.concatenate([np.diff(c) for _, c in want]))


def test_rows_of_one_id_lie_in_several_files(spark, tmp_path):
    rows = [(1, "word " * (i % 50)) for i in range(300)] + [(2, "long " * 5000), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/x"
    manifest = op7_bitpack.write(docs, folder)
    got = sorted(op7_bitpack.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0] + [1] * 300 + [2] and manifest.count() >= 6 and max(r.n_docs for r in manifest.collect()) < 150
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, t in rows for x in [ids_of(t, 1)])


@given(st.lists(st.text(max_size=60), max_size=10))
@settings(max_examples=300, deadline=None)
def test_short_way_equals_the_tokenizer(texts):
    ids, cuts = common.token_ids(pa.array(texts, pa.string()), common.vocabulary_path(common.WORD_BPE), 7)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [ids_of(t, 7) for t in texts]


def test_tokens_equal_the_tokenizer():
    ids, cuts = common.token_ids(pa.array(ODD), common.vocabulary_path(common.WORD_BPE), 7)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [ids_of(t, 7) for t in ODD]


def brute_nearest(vectors, q):
    own = dict(vectors)[q]
    d = sorted((float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), k) for k, v in vectors if k != q)
    return d[:10]


@pytest.mark.parametrize("scale", ["0.001", "0.1"])
def test_nearest(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in common.table(spark, sf, "embeddings").collect()]
    got = {}
    for r in op8_permutation.op8_permutation(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    found = 0
    for q in (k for k, _ in rows if k % 100 == 0):
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        found += len({k for _, k in got[q]} & {k for _, k in brute_nearest(rows, q)})
    assert found / (10 * len(got)) >= 0.9


def test_nearest_exact(spark, sf, monkeypatch):
    """Many sections and blocks, everything reranked: brute force."""
    monkeypatch.setattr(op8_permutation, "SECTION", 60)
    monkeypatch.setattr(op8_permutation, "BLOCK", 2)
    vectors = common.table(spark, sf, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()]
    got = {}
    for r in op8_permutation.search(vectors, vectors.where("vec_id % 100 = 0"), exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == {q: brute_nearest(rows, q) for q, _ in rows if q % 100 == 0}


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (200, [float("inf"), 1.0]), (9, [1.0, None]), (100, [5.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, section string, q int")
    want = [(0, 1, 3, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 1.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 8, 1.0)]
    for exact in (False, True):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op8_permutation.search(df, df.where("vec_id % 100 = 0"), exact=exact).collect())
        assert got == want
    assert op8_permutation.search(df.limit(0), df.limit(0)).count() == 0


def test_footrule():
    """Postings give the footrule distance of two prefixes, by its definition."""
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(12)[:5] for _ in range(30)])
    files = op8_permutation.Files(orders, 12)
    for q in orders[:5]:
        place = lambda order: np.array([list(order).index(p) if p in order else 5 for p in range(12)])
        want = [np.abs(place(q) - place(o)).sum() for o in orders]
        assert (5 * 6 - 2 * files.gains(q)).tolist() == want


def test_gradient():
    rng = np.random.default_rng(0)
    net = op9_toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = rng.standard_normal((6, op9_toxicity.INPUTS))
    at, mask, label = rng.integers(0, 6, (3, 5)), np.arange(5) < np.array([[5], [2], [4]]), np.array([1, 0, 1])
    g = net.gradient(rows, at, mask, label)

    def loss():
        z = net.run(net.inputs(rows), at, mask)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for k in ("Wi", "Uf", "Wb", "a", "o", "bf"):
        i = np.unravel_index(rng.integers(net.p[k].size), net.p[k].shape)
        old, e = net.p[k][i], 1e-3
        net.p[k][i] = old + e
        up = loss()
        net.p[k][i] = old - e
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3


def test_network_equals_plain_loops():
    """Logits of windows against a GRU written out word by word."""
    rng = np.random.default_rng(5)
    net, H = op9_toxicity.Network(), op9_toxicity.HIDDEN
    rows = rng.standard_normal((9, op9_toxicity.INPUTS)).astype(np.float32)
    sizes = np.array([4, 1, 7])
    first, codes = np.array([0, 4, 5]), rng.integers(0, 8, 12)
    got = op9_toxicity.logits(net, rows, codes, first, sizes)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for k, (a, n) in enumerate(zip(first, sizes)):
        states = np.zeros((n, 2 * H))
        for side, d in enumerate("fb"):
            h = np.zeros(H)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                e = np.tanh(rows[codes[a + t]] @ net.p["Wi"] + net.p["bi"])
                x, u = e @ net.p[f"W{d}"] + net.p[f"b{d}"], h @ net.p[f"U{d}"]
                z, r = sigmoid(x[:H] + u[:H]), sigmoid(x[H : 2 * H] + u[H : 2 * H])
                h = z * h + (1 - z) * np.tanh(x[2 * H :] + r * u[2 * H :])
                states[t, side * H : (side + 1) * H] = h
        weight = np.exp(states @ net.p["a"])
        assert abs((weight / weight.sum()) @ states @ net.p["o"] + net.p["ob"][0] - got[k]) < 1e-4


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 72, 100, 1000):
        s = op9_toxicity.window_starts(n)
        assert set(range(n)) <= {w for a in s for w in range(a, a + 48)} and (n <= 48 or s[-1] == n - 48)


def test_toxicity(spark, odd):
    """Held-out accuracy where there are enough labels to learn from."""
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels").select("doc_id", "toxic")
    got = op9_toxicity.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out")
    right = got.where("toxic = predicted").count() / got.count()
    assert right > 0.95
    model = op9_toxicity.fit(common.table(spark, sf, "documents").where("doc_id < 0"), labels.limit(0))
    assert [r.score for r in op9_toxicity.score(odd, model).collect()] == [0.0] * 12


def test_toxicity_trains_on_all_windows(spark, monkeypatch):
    seen = {}

    def record(rows, codes, first, size, bag, label):
        seen.update(n=np.bincount(bag).tolist(), words=np.unique(codes[common.gather(first, size)] % (len(rows) // 2)).size)
        return op9_toxicity.Network()

    monkeypatch.setattr(op9_toxicity, "train", record)
    length = [10, 48, 300, 313, 2000, 5000] * 4
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate(length)], "doc_id long, text string")
    # one id has both labels, one row has none, one label has no document
    labels = spark.createDataFrame([(i, i // 6 % 2) for i in range(len(length))] + [(7, 0), (7, 1), (0, 9), (99, 1), (None, 1)], "doc_id long, toxic int")
    op9_toxicity.fit(docs, labels)
    assert seen["n"] == [len(op9_toxicity.window_starts(n)) for n in length] and seen["words"] == sum(length)


@pytest.fixture(scope="module")
def bpe():
    """The codec, and the public encoder's tokens of a text."""
    import tiktoken

    c = op10_bpe.Codec(common.vocabulary_path(op10_bpe.BYTE_BPE), op10_bpe.public_pattern())
    e = tiktoken.Encoding("own", pat_str=op10_bpe.public_pattern(), mergeable_ranks=c.ranks, special_tokens={})
    return c, e.encode_ordinary


def test_bpe(bpe):
    c, public = bpe
    texts = [t or "" for t in ODD] + ["aaab" * 400, "ab" * 700, "é" * 900, " " * 2000, "abcabd" * 900, "a" * 30_000, "日本語né" * 1500]
    coded = c.encode(texts)
    assert [x.tolist() for x, _ in coded] == [public(t) for t in texts]
    assert c.decode([x for x, _ in coded]) == [t.encode() for t in texts]


def random_letters(rng, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), n)])


def test_bpe_of_many_long_words(bpe):
    """Memory follows the words' bytes, not what all steps of all words add up to."""
    c, public = bpe
    rng = np.random.default_rng(0)
    text = " ".join(random_letters(rng, 400) for _ in range(300)) + " " + random_letters(rng, 5000)
    assert c.encode([text])[0][0].tolist() == public(text)
    assert [s.stop - s.start for s in op10_bpe.calls([400] * 100 + [2500, 9000])] == [37, 37, 26, 1, 1]


def test_both_recursive_queries_agree(bpe, monkeypatch):
    """Few letters make many equal and overlapping pairs, where the order of contraction matters."""
    c, _ = bpe
    rng = np.random.default_rng(1)
    words = [random_letters(rng, int(rng.integers(1, 90)), a).encode() for a in ("ab", "abe", "sta ", "é0", "the in") for _ in range(150)]
    steps = [x.tolist() for x in c.contract(words)]
    monkeypatch.setattr(op10_bpe, "LONG", 0)
    assert [x.tolist() for x in c.contract(words)] == steps


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_public_encoder(bpe, texts):
    c, public = bpe
    assert [x.tolist() for x, _ in c.encode(texts)] == [public(t) for t in texts]


def test_bpe_round_trip(spark, odd):
    got = op10_bpe.round_trip(odd)
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in [*ODD, "a", "no id"])
    assert sorted(r.decoded_sha256 for r in got.collect()) == want
    assert op10_bpe.decode(op10_bpe.encode(odd)).count() == 12 and op10_bpe.round_trip(odd.limit(0)).count() == 0


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())


def test_stages_on_odd_tables(spark, clashing):
    """Defined results of every filtering stage: nothing crashes, columns stay, and no row goes that shouldn't."""
    rows = rows_of(clashing)
    near = op5_simhash.keep(clashing)
    assert near.schema.names == clashing.schema.names and all(r.own == "x" for r in near.collect())
    texts, left = {k: t for (_, k), t in rows if k}, rows_of(near)
    # the null, empty and wordless texts are one group, as are copies of a with or without id, and the long ones
    assert len(left) == len(rows) - 2 - 3 - 1 and [k for (none, k), t in left if t == texts[3] and not none] == [3]
    assert len([t for (_, k), t in left if k == 9]) == 2
    cut = op4_substring.keep(clashing)
    assert cut.schema.names == clashing.schema.names
    got = {k[1]: t for k, t in rows_of(cut) if not k[0]}
    # copies of a lose all words and go; the shared passage goes from the larger id
    assert 4 not in got
    want = brute_substrings([(k, t) for (none, k), t in rows if not none and k in (3, 5, 6, 7, 8)], 50)
    assert {k: " ".join(WORD.findall(got.get(k, ""))) for k in want} == want
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    good = op2_quality.keep(clashing)
    assert good.schema.names == clashing.schema.names and {k for (_, k), _ in rows_of(good)} >= {3, 4, 5, 6, 7, 8, 9}
    safe = op9_toxicity.keep(clashing, {"share": 0.0})
    assert rows_of(safe) == rows and op9_toxicity.keep(clashing, {"share": 0.5}).count() == 0
    pieces = op1_packing.pack(clashing)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(ids_of(t, 2)) for _, t in rows)
    none = clashing.limit(0)
    assert [op5_simhash.keep(none).count(), op4_substring.keep(none).count(), op2_quality.keep(none).count(), op1_packing.pack(none).count()] == [0] * 4


def test_pipeline(spark, sf):
    """Every stage's decisions, one by one, against the operators' plain definitions."""
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.settled(spark, stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    bad = {r.doc_id for r in op2_quality.ledger(before).where("failed <> 0").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad
    before, after = seen["substrings"]
    want = brute_substrings([(r.doc_id, r.text) for r in before.collect()], 50)
    assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in after.collect()} == {k: t for k, t in want.items() if t}
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: WORD.findall((r.text or "").lower()) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept == set(brute_near([(r.doc_id, r.text) for r in before.collect()]).values())
    before, after = seen["packing"]
    check_packing(after.collect(), {r.doc_id: r.text for r in before.collect()})


def test_byte_bpe_steps_sort_once_and_equal_the_live_form():
    """A step once sorted all rows and looked all pairs up again, which went over the budget (1000 CPU s/GB of 900)."""
    import public_tokenizers

    from winnowlake.llm import common, op10_bpe

    codec = op10_bpe.Codec(common.vocabulary_path(op10_bpe.BYTE_BPE), public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 97 + int(letters), int(n)).astype(np.uint8)) for n, letters in zip(rng.integers(1, 60, 300), rng.choice([1, 2, 26], 300))]
    flat, lengths = codec.contract(words)  # registers start, too
    lists = codec.con.sql(op10_bpe.LIVE).to_arrow_table()["ids"].combine_chunks()
    assert lists.flatten().to_pylist() == flat.tolist() and lists.value_lengths().to_pylist() == lengths.tolist()
    plan = "".join(r[1] for r in codec.con.execute("EXPLAIN " + op10_bpe.STEPS).fetchall())
    assert plan.lower().count("window") == 1
