import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnowlake import cli
from winnowlake.functions import codes, colors, encode, minimizers
from winnowlake.operators import index, packed, query, rbo
from winnowlake.sources import fastx, lists, results

SEQ = st.text("ACGT", min_size=0, max_size=90)


def kernel(seq, **o):
    data = np.frombuffer(seq.encode(), np.uint8)
    o = {"k": 9, "m": 5, "canonical": True, "seed": 42, "kind": "md5"} | o
    own, pos, least, names = minimizers.batch_minimizers(data, np.array([0, len(data)]), **o)
    return [names[int(x)] for x in least] if names is not None else least.tolist()


@given(SEQ, st.sampled_from([(9, 5), (7, 7), (31, 19), (1, 1)]), st.booleans(), st.sampled_from(["md5", "mix"]))
@settings(max_examples=60, deadline=None)
def test_kernel_equals_definition(seq, km, canonical, kind):
    k, m = km
    assert kernel(seq, k=k, m=m, canonical=canonical, kind=kind) == minimizers.naive(seq, k, m, canonical, 42, kind)


@given(SEQ)
@settings(max_examples=40, deadline=None)
def test_reverse_complement_has_the_same_minimizers(seq):
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert sorted(kernel(seq, kind="mix")) == sorted(kernel(other, kind="mix"))


def test_md5_kernel_is_fast():
    """A million symbols, which took some 8 seconds when each hash was a Python call."""
    import time

    data = np.random.default_rng(3).choice(np.frombuffer(b"ACGT", np.uint8), 1_000_000)
    began = time.time()
    own, pos, hi, lo = minimizers.batch_hashes(data, np.array([0, len(data)]), 31, 19, True, 42, "md5")
    assert time.time() - began < 3
    for i in (0, 500_000, len(pos) - 1):
        assert minimizers.hex_texts(hi[i : i + 1], lo[i : i + 1]).to_pylist() == minimizers.naive(data[i : i + 31].tobytes().decode())


@pytest.mark.parametrize("m, seed", [(1, 0), (4, 7), (19, 42), (20, -3), (31, 10**19), (31, 10**30)])
def test_md5_of_many_equals_hashlib(m, seed):
    import hashlib

    values = np.random.default_rng(m).integers(0, 4 ** min(m, 30), 40).astype(np.uint64)
    want = [hashlib.md5(f"{''.join(str(v >> 2 * (m - 1 - j) & 3) for j in range(m))}|{seed}".encode()).hexdigest() for v in values.tolist()]
    assert minimizers.hex_texts(*minimizers.md5_digests(values, m, seed)).to_pylist() == want


@pytest.mark.parametrize("kind", ["md5", "mix"])
def test_documents_of_several_rows_and_sought_minimizers(spark, monkeypatch, kind):
    """Ids of several rows, null ids and texts; only repeated ids' rows are shuffled, and only sought ones leave the kernel."""
    rng = np.random.default_rng(5)
    seqs = ["".join(np.array(list("ACGT"))[rng.integers(0, 4, n)]) for n in (300, 200, 31, 5, 400)]
    rows = [(1, seqs[0]), (2, seqs[1]), (2, seqs[1][50:]), (3, seqs[2]), (4, seqs[3]), (5, None), (None, seqs[1]), (None, seqs[1]), (6, seqs[4] + seqs[4])]
    want = {}
    for i, s in rows:
        want.setdefault(i, set()).update(minimizers.naive(s or "", kind=kind))
    signed = lambda h: h if kind == "md5" or h < 1 << 63 else h - (1 << 64)
    pairs = sorted((str(i), signed(h)) for i, hs in want.items() for h in hs)
    docs = spark.createDataFrame(rows, "doc_id int, seq string")
    assert sorted((str(r.doc_id), r.h) for r in index.doc_minimizers(docs, kind=kind).collect()) == pairs
    some = query.query_minimizers(spark.createDataFrame([(1, seqs[1][:40] + seqs[4][100:150])], "qid long, seq string"), kind=kind)
    known = {r.h for r in some.collect()}
    assert sorted((str(r.doc_id), r.h) for r in index.sought(docs, some, kind=kind).collect()) == [x for x in pairs if x[1] in known]
    bits = minimizers.leading_bits(some)
    left = minimizers.minimizers(docs, ["doc_id"], kind=kind, among=bits).select("h").distinct().count()
    assert len(known & {h for _, h in pairs}) <= left < len({h for _, h in pairs}) / 2


def test_bounds_of_k_and_m():
    for k, m in ((32, 19), (0, 1), (5, 6), (5, 0)):
        with pytest.raises(ValueError):
            minimizers.checked(k, m)
    with pytest.warns(UserWarning):
        assert encode.guarded_ratio(1.5) == 1.0


@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1)))))
@settings(max_examples=60, deadline=None)
def test_sets_as_bits(x):
    n, ids = x[0], sorted(x[1])
    assert codes.get_set(codes.put_set(ids, n), n) == ids


def test_set_sizes_equal_the_bit_stream(spark):
    sets = [[0, 3, 9], list(range(12)), [1], list(range(3, 20))]
    df = spark.createDataFrame([(s,) for s in sets], "ids array<bigint>")
    got = [r[0] for r in df.select(colors.set_bits(F.col("ids"), F.lit(20))).collect()]
    assert got == [codes.put_set(s, 20).length for s in sets]


GENOMES = ["ACGTTGCAAGCTTACGGATCCTAGGATTACAGATTACAGGCCTTAAGCTA", "TTGACCATGCATGCCGATAGCTAGCTAGGATCGATCGGATTACGCGCTAT"]


def test_index_round_trip_and_short_queries(spark, tmp_path):
    docs = spark.createDataFrame([(0, GENOMES[0]), (1, GENOMES[1]), (2, GENOMES[0]), (3, "AC"), (4, None)], "doc_id int, seq string")
    index.write(index.build(docs, k=15, m=7), str(tmp_path))
    built = index.read(spark, str(tmp_path))
    assert built.meta["nb_docs"] == 5 and built.colorsets.count() <= 3
    q = spark.createDataFrame([(0, "a", GENOMES[0]), (1, "a", GENOMES[1].lower()), (2, "b", "ACGT"), (3, "c", ""), (4, "d", GENOMES[0][:15])], "qid long, name string, seq string")
    hits = query.run(built, q, 1.0)
    assert sorted((r.qid, r.doc_id, r.score) for r in hits.collect()) == [(0, 0, 36), (0, 2, 36), (1, 1, 36), (4, 0, 1), (4, 2, 1)]
    assert sorted(tuple(r) for r in query.lines(hits, q).collect()) == [(0, "a\t2\t(0,36)\t(2,36)"), (1, "a\t1\t(1,36)"), (2, "b\t0"), (3, "c\t0"), (4, "d\t2\t(0,1)\t(2,1)")]
    assert query.run(built, q, 1.0, top_k=1).count() == 3


def test_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id int, seq string")
    q = spark.createDataFrame([(0, "a", GENOMES[0])], "qid long, name string, seq string")
    assert query.run(index.build(docs), q).count() == 0


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\r\nACGT\r\nAC GT\n\n>s2\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1\nACGT\n+\n@III\n@r2 x\nAC\n+r2\nIII\n")
    got = sorted((r.name, r.comment, r.seq, r.qual, r.corrupt) for r in fastx.read(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")]).collect())
    want = [("r1", None, "ACGT", "@III", False), ("r2", "x", "AC", "III", True), ("s1", "first one", "ACGTACGT", None, False), ("s2", None, "", None, False)]
    assert got == want
    fastx.register(spark)
    assert spark.read.format("fastx").load(str(tmp_path)).count() == 4


def test_long_sequences_come_in_pieces(spark, tmp_path, monkeypatch):
    """Blocks, pieces and kernel parts cut anywhere; k-mers stay the same."""
    import io

    rng = np.random.default_rng(0)
    seqs = ["".join(np.array(list("ACGT"))[rng.integers(0, 4, n)]) for n in (1, 30, 31, 500, 5000)]
    text = "".join(f">s{i} n\r\n" + "\r\n".join(s[j : j + 70] for j in range(0, len(s), 70)) + "\r\n" for i, s in enumerate(seqs))
    want = [("u", i, f"s{i}", "n", s, None, False, 0) for i, s in enumerate(seqs)]
    for block in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(fastx, "BLOCK", block)
        assert list(fastx.records("u", io.BytesIO(text.encode()))) == want
        assert list(fastx.records("u", io.BytesIO(gzip.compress(text.encode())))) == want
        got = list(fastx.records("u", io.BytesIO(text.encode()), 100, 30))
        for i, s in enumerate(seqs):
            parts = [r for r in got if r[1] == i]
            assert all(len(r[4]) <= 130 and r[4] == s[r[7] : r[7] + len(r[4])] for r in parts) and parts[-1][7] + len(parts[-1][4]) == len(s)
            assert [a[7] + 100 for a in parts[:-1]] == [b[7] for b in parts[1:]]
    monkeypatch.undo()
    (tmp_path / "a.fa").write_text(text)
    whole = sorted((r.record_no, r.seq) for r in fastx.read(spark, str(tmp_path / "a.fa")).collect())
    assert whole == list(enumerate(seqs))
    import pyarrow as pa

    monkeypatch.setattr(minimizers, "PIECE", 64)
    for s in seqs:
        found = [x for at, base, data, offsets in minimizers.pieces(pa.array(["", s, None]), 9) for x in minimizers.batch_minimizers(data, offsets, 9, 5, True, 42, "mix")[2].tolist()]
        assert found == minimizers.naive(s, 9, 5, True, 42, "mix")


@given(st.integers(1, 200_000).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1), min_size=1, max_size=40), st.booleans())))
@settings(max_examples=12, deadline=None)
def test_stored_sets(spark, x):
    """Sets in chunks of three forms and back; also sets of nearly all ids."""
    n, ids, rest = x
    n = min(n, 70_000) if rest else n
    ids = sorted({i % n for i in ids})
    ids = sorted(set(range(n)) - set(ids)) if rest else ids
    members = spark.createDataFrame([(7, i) for i in ids], "cid long, doc_id long")
    encoded = colors.encode(members, n)
    assert sorted(r.doc_id for r in colors.decode(encoded, n).collect()) == ids
    assert all(len(r.data) <= max(1, colors.CHUNK // 4) for r in encoded.collect())


@pytest.mark.parametrize("kind", ["md5", "mix"])
def test_sets_are_numbered_alike_in_every_reading(spark, kind):
    """More sets than a range partitioning samples: each has one number, dense and in order."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        n = 150_000
        h = F.md5(F.col("id").cast("string")) if kind == "md5" else F.xxhash64("id")
        named = index.color_ids(spark.range(0, n, 1, 8).select(h.alias("h"), F.col("id").alias("doc_id")))
        got = [(r.cid, r.h) for r in named.select("cid", "h").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert [c for c, _ in sorted(got)] == list(range(n))
    assert [x for _, x in sorted(got)] == sorted(x for _, x in got)


@pytest.mark.parametrize("kind, k, m, canonical", [("md5", 31, 19, True), ("mix", 31, 19, True), ("md5", 15, 4, False), ("mix", 31, 31, True)])
def test_packed_sets_equal_those_of_members(spark, monkeypatch, kind, k, m, canonical):
    """Several buckets, pieces and rows of a document; null, empty and short sequences; ids of any type."""
    monkeypatch.setattr(packed, "BUCKET_BYTES", 500)
    monkeypatch.setattr(minimizers, "PIECE", 300)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ACGT"), n)) for n in (700, 40, 31, 12, 0, 250)]
    data = [(i % 9, base[i % 6] + base[i % 4][: 7 * i]) for i in range(20)] + [(50, None), (51, ""), (52, base[0]), (53, base[0])]
    docs = spark.createDataFrame(data, "doc_id long, seq string").repartition(3)
    o = {"kind": kind, "k": k, "m": m, "canonical": canonical}
    for some in (docs, docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "seq"), docs.where("false")):
        want = index.color_ids(index.doc_minimizers(some, **o)).where("h = rep").select("size", "rep", "cid")
        got = index.color_sets(some, **o).select("size", "rep", "cid")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_absent_ids_stay_out_of_shuffles(spark, tmp_path):
    """Sets of few ids of very many, of all, of none but the last: the complement follows from the gaps,
    and what the catalogue query shuffles grows with the members."""
    n = 5000
    sets = {1: [0], 2: list(range(n)), 3: [n - 1], 4: [7, 8, 4000], 5: [i for i in range(n) if i % 3]}
    members = spark.createDataFrame([(h, i) for h, ids in sets.items() for i in ids], "h long, doc_id long")
    want = {h: sorted(set(range(n)) - set(ids)) for h, ids in sets.items()}
    got = {r.h: r.ids for r in colors.absent_ranges(members, n).select("h", colors.within(F.col("ranges")).alias("ids")).collect()}
    assert got == want
    assert sorted((r.h, r.doc_id) for r in colors.absent(members, n).collect()) == [(h, i) for h, ids in want.items() for i in ids]

    import __spark_entry__ as e

    spark.createDataFrame([(h, i) for h, ids in sets.items() for i in ids], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    made = e.queries()["set_complement"](spark, str(tmp_path))
    assert {r.h: r.absent for r in made.collect()} == {h: ",".join(map(str, ids)) for h, ids in want.items()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_lookups_read_only_their_partitions(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "".join(np.array(list("ACGT"))[rng.integers(0, 4, 3000)])) for i in range(4)], "doc_id int, seq string")
    index.write(index.build(docs, k=15, m=11), str(tmp_path))
    built = index.read(spark, str(tmp_path))
    q = docs.where("doc_id = 2").selectExpr("cast(doc_id AS long) AS qid", "substr(seq, 100, 20) AS seq")
    found = query.run(built, q, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") or "bucket#" in plan.split("PartitionFilters")[1]
    assert [(r.doc_id, r.score) for r in found.collect()] == [(2, 6)]
    assert index.pruned(built, query.query_minimizers(q, k=15, m=11)).count() < built.minimizer_map.count() / 2


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = results.numbered_lines(spark, str(tmp_path / "x.txt"))
        assert sorted((r.line_no, r.line) for r in rows.collect()) == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lists_and_results(spark):
    assert lists.is_list(["x.list"]) and not lists.is_list(["x.fa"]) and not lists.is_list(["a.list", "b.list"])
    df = spark.createDataFrame([(0, "q\t2\t(3,10)\t(1,10)"), (1, "r\t0")], "line_no long, line string")
    got = results.parse(df).select("line_no", "name", rbo.by_ties(F.col("pairs")).alias("d")).collect()
    assert [(r.line_no, r.name, r.d) for r in got] == [(0, "q", [1, 3]), (1, "r", [])]


def plain_rbo(a, b, p):
    d = min(len(a), len(b))
    xs = [len(set(a[:i]) & set(b[:i])) for i in range(1, d + 1)]
    return (1 - p) * (sum((x - xs[-1]) / (i + 1) * p**i for i, x in enumerate(xs)) - xs[-1] * np.log(1 - p) / p)


def test_rbo(spark):
    a = [list(range(12)), list(range(10)), list(range(9)), list(range(10))]
    b = [list(range(12))[::-1], list(range(20, 30)), list(range(9)), list(range(10))]
    left = spark.createDataFrame(list(enumerate(a)), "line_no long, docs array<bigint>")
    right = spark.createDataFrame([*enumerate(b), (9, [1])], "line_no long, docs array<bigint>")
    got = {r.line_no: r.rbo for r in rbo.compare(left, right).collect()}
    p = {n: spark.range(1).select(rbo.find_p(F.lit(n))).first()[0] for n in (10, 12)}
    assert set(got) == {0, 1, 2, 3} and got[2] == -1
    for i, n in ((0, 12), (1, 10), (3, 10)):
        assert abs(got[i] - plain_rbo(a[i], b[i], p[n])) < 1e-9
    mean = rbo.mean(rbo.compare(left, right)).first()[0]
    assert abs(mean - (got[0] + got[1] + got[3]) / 4) < 1e-12
    assert np.isnan(rbo.mean(rbo.compare(left.limit(0), right)).first()[0])


@given(st.lists(st.integers(0, 30), max_size=25, unique=True), st.lists(st.integers(0, 30), max_size=25, unique=True))
@settings(max_examples=15, deadline=None)
def test_rbo_of_any_lists(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    at, low = df.select(rbo.completed(F.col("a"), F.col("b")), rbo.rbo_prefix(F.col("a"), F.col("b"), F.lit(0.9))).first()
    d = min(len(a), len(b))
    xs = [len(set(a[:i]) & set(b[:i])) for i in range(1, d + 1)]
    assert [sum(v <= i for v in at) for i in range(1, d + 1)] == xs
    assert abs(low - 0.1 * sum(x / (i + 1) * 0.9**i for i, x in enumerate(xs))) < 1e-12


def test_rbo_work_follows_depth(spark):
    """Four times the depth takes far less than sixteen times as long."""
    import time

    def took(depth):
        lists = [(i, [(j * 7 + i) % 100_003 for j in range(depth)], [(j * 11 + i) % 100_003 for j in range(depth)]) for i in range(1000)]
        df = spark.createDataFrame(lists, "line_no long, a array<bigint>, b array<bigint>").repartition(8).persist()
        df.count()
        left, right = df.selectExpr("line_no", "a AS docs"), df.selectExpr("line_no", "b AS docs")
        rbo.compare(left, right).write.format("noop").mode("overwrite").save()
        began = time.time()
        rbo.compare(left, right).write.format("noop").mode("overwrite").save()
        df.unpersist()
        return time.time() - began

    short, long = took(100), took(400)
    assert long < 8 * short + 2 and long < 30


def test_command_line(spark, tmp_path):
    for i, g in enumerate(GENOMES):
        (tmp_path / f"g{i}.fa").write_text(f">g{i}\n{g}\n")
    (tmp_path / "all.list").write_text(f"{tmp_path}/g0.fa\n{tmp_path}/g1.fa\n")
    (tmp_path / "q.fa").write_text(f">q0\n{GENOMES[1]}\n>q1\nAC\n")
    x, out = str(tmp_path / "index"), str(tmp_path / "out")
    assert cli.main(["build", "-i", f"{tmp_path}/all.list", "-o", x, "-k", "15", "-m", "7"], spark) == 0
    assert cli.main(["query", "-x", x, "-i", f"{tmp_path}/q.fa", "-o", out, "-r", "0.8"], spark) == 0
    assert [r[0] for r in spark.read.text(out).collect()] == ["q0\t1\t(1,36)", "q1\t0"]
    for n in ("f1", "f2"):
        (tmp_path / n).write_text("a\t10\t" + "\t".join(f"({i},{20 - i})" for i in range(10)) + "\nb\t0\n")
    assert cli.main(["rbo", "-f1", f"{tmp_path}/f1", "-f2", f"{tmp_path}/f2", "-o", str(tmp_path / "r")], spark) == 0
    lines = sorted(float(r[0]) for r in spark.read.text(str(tmp_path / "r")).collect())
    assert len(lines) == 3 and lines[0] == -1
    assert cli.main(["rbo", "-f1", "x", "-f2", "y", "--raw-lists"], spark) == 1


def test_streaming_queries(spark, tmp_path):
    from winnowlake.streaming import queries

    docs = spark.createDataFrame(list(enumerate(GENOMES)), "doc_id int, seq string")
    built = index.build(docs, k=15, m=7)
    spark.createDataFrame([(7, GENOMES[1])], "qid long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, seq string").parquet(str(tmp_path / "in"))
    queries.run(built, stream, str(tmp_path / "hits"), str(tmp_path / "state")).awaitTermination()
    assert [(r.qid, r.doc_id) for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [(7, 1)]


def test_sql_function(spark):
    minimizers.register_minimizers(spark)
    n = spark.sql(f"SELECT * FROM minimizers('{GENOMES[0]}', 15, 7)").count()
    assert n == len(GENOMES[0]) - 14


@pytest.mark.parametrize("kind", ["md5", "mix"])
@pytest.mark.parametrize("k, m", [(31, 19), (31, 31), (9, 4), (5, 1)])
def test_near_hashes_are_all_of_those_sought(k, m, kind):
    """Against all k-mers' minimizers, over the ends of blocks and sequences, with empty and short sequences and an empty bitmap."""
    rng = np.random.default_rng(k + m)
    lengths = [0, 3, 100, minimizers.MER_BLOCK + 7, k, 0, 4000, 0]
    data = rng.choice(np.frombuffer(b"ACGT", np.uint8), sum(lengths))
    data[-300:] = data[110:410]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    own, pos, *h = minimizers.batch_hashes(data, offsets, k, m, True, 42, kind)
    values = minimizers.mmers(((data >> 1) & 3).astype(np.uint64), m, True)
    first = minimizers.finalise(values, 42) if kind == "mix" else minimizers.md5_digests(values, m, 42)[0]
    sought = np.unique(h[0][::500])
    for some in (sought, sought[:1], sought[:0]):
        mers, slots = np.zeros(1 << minimizers.LEADING - 6, np.uint64), np.unique(minimizers.mer_slots(values[np.isin(first, some)]))
        np.bitwise_or.at(mers, slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64))
        own2, pos2, *h2 = minimizers.near_hashes(data, offsets, k, m, True, 42, kind, mers)
        all_of = lambda o, p, h: [x for x in zip(o.tolist(), p.tolist(), *(y.tolist() for y in h if y is not None)) if x[2] in set(some.tolist())]
        assert all_of(own2, pos2, h2) == all_of(own, pos, h)
    assert not len(own2)


def test_few_mmers_are_hashed_for_sought_minimizers(monkeypatch):
    """All were, so that queries of 1 GB ran out of time."""
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"ACGT", np.uint8), 200_000)
    mers = np.zeros(1 << minimizers.LEADING - 6, np.uint64)
    slot = minimizers.mer_slots(minimizers.mmers(((data[5000:5019] >> 1) & 3).astype(np.uint64), 19, True))[0]
    mers[slot >> 6] = np.uint64(1) << np.uint64(slot & 63)
    hashed, digests = [], minimizers.md5_digests
    monkeypatch.setattr(minimizers, "md5_digests", lambda v, *a: (hashed.append(len(v)), digests(v, *a))[1])
    minimizers.near_hashes(data, np.array([0, len(data)]), 31, 19, True, 42, "md5", mers)
    assert sum(hashed) < 2000


def test_sought_minimizers_by_their_queries(spark):
    rng = np.random.default_rng(6)
    seqs = ["".join(np.array(list("ACGT"))[rng.integers(0, 4, n)]) for n in (300, 200, 40)]
    docs = spark.createDataFrame([(1, seqs[0]), (2, seqs[0][100:] + seqs[1]), (3, None), (None, seqs[1]), (2, seqs[2])], "doc_id int, seq string")
    asked = spark.createDataFrame([(1, seqs[0][50:200]), (2, seqs[2]), (3, None), (4, "ACGT")], "qid long, seq string")
    for kind in ("md5", "mix"):
        q = query.query_minimizers(asked, kind=kind)
        got = lambda **o: sorted((str(r.doc_id), r.h) for r in index.sought(docs, q, kind=kind, **o).collect())
        assert got(queries=asked) == got() != []
