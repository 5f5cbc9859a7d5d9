"""``python -m winnowlake.cli build | query | rbo``."""

from __future__ import annotations

import argparse
import sys
import time


#: Bits of a query id that number the records of a file.
RECORD_BITS = 40


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="winnowlake")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build an index from sequence files")
    b.add_argument("-i", "--input-list", nargs="+", required=True)
    b.add_argument("-o", "--output-dirname", default="winnowlake_index")
    b.add_argument("-k", type=int, default=31)
    b.add_argument("-m", type=int, default=19)
    b.add_argument("-n", "--non-canonical", action="store_true")
    b.add_argument("-s", "--seed", type=int, default=42)
    # accepted for the sake of existing scripts: Spark decides these
    for short, name, default in (("-b", "--bit-check", 1), ("-g", "--max-ram", 8192), ("-t", "--threads", 0)):
        b.add_argument(short, name, type=int, default=default)
    b.add_argument("-c", "--pthash-constant", type=float, default=4.0)
    b.add_argument("-K", "--keep-tmp-files", action="store_true")
    b.add_argument("-v", "--verbose", type=int, default=0)
    q = sub.add_parser("query", help="query an index")
    q.add_argument("-x", "--index", required=True)
    q.add_argument("-i", "--input-list", nargs="+", required=True)
    q.add_argument("-o", "--output-filename", default="winnowlake_results.txt", help="a folder of text files; '' prints")
    q.add_argument("-r", "--ratio", type=float, default=1.0)
    q.add_argument("-t", "--threads", type=int, default=0)
    q.add_argument("-v", "--verbose", type=int, default=0)
    r = sub.add_parser("rbo", help="compare two result files line by line")
    r.add_argument("-f1", "--file1", required=True)
    r.add_argument("-f2", "--file2", required=True)
    r.add_argument("-o", "--output-filename", default="rbos.txt")
    r.add_argument("--raw-lists", action="store_true")
    r.add_argument("--min_size", type=int, default=10)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .cluster import ship
    from .functions import minimizers
    from .operators import index, query, rbo
    from .sources import fastx, lists, results

    if a.command == "build":
        minimizers.checked(a.k, a.m)
    if a.command == "rbo" and a.raw_lists:
        print("raw lists are not supported", file=sys.stderr)
        return 1
    if spark is None:
        builder = SparkSession.builder.appName("winnowlake")
        if getattr(a, "threads", 0):
            builder = builder.master(f"local[{a.threads}]")
        spark = builder.getOrCreate()
    ship(spark)
    began = time.time()
    if a.command == "build":
        docs = fastx.documents(spark, lists.resolve(spark, a.input_list), piece=fastx.PIECE, overlap=a.k - 1)
        built = index.build(docs, uri="uri", k=a.k, m=a.m, canonical=not a.non_canonical, seed=a.seed, staging=f"{a.output_dirname}/_staging")
        index.write(built, a.output_dirname)
        if a.verbose >= 2:
            stored = index.read(spark, a.output_dirname)
            index.stats(stored).show()
            index.size_histogram(stored).orderBy("tenth").show()
    elif a.command == "query":
        rows = fastx.documents(spark, lists.resolve(spark, a.input_list))
        # the file's place in the list and the record's in the file
        qid = F.shiftleft(F.col("doc_id").cast("long"), RECORD_BITS).bitwiseOR(F.col("record_no"))
        queries = rows.select(qid.alias("qid"), "name", "seq")
        lines = query.lines(query.run(index.read(spark, a.index), queries, a.ratio), queries)
        if a.output_filename:
            lines.repartitionByRange("qid").sortWithinPartitions("qid").select("line").write.mode("overwrite").text(a.output_filename)
        else:
            for row in lines.orderBy("qid").toLocalIterator():
                print(row["line"])
    else:
        def side(path: str):
            return results.parse(results.numbered_lines(spark, path)).select("line_no", rbo.by_ties(F.col("pairs")).alias("docs"))

        out = rbo.with_mean(rbo.compare(side(a.file1), side(a.file2), a.min_size))
        text = out.select(F.coalesce("line_no", F.lit((1 << 62))).alias("n"), F.when(F.col("rbo") == -1, "-1").otherwise(F.format_string("%.6g", "rbo")).alias("line"))
        text.repartitionByRange("n").sortWithinPartitions("n").select("line").write.mode("overwrite").text(a.output_filename)
    if getattr(a, "verbose", 0):
        print(f"{a.command}: {(time.time() - began) * 1000:.0f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
