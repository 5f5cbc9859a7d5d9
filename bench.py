"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from winnowlake.cluster import ship
    from winnowlake.functions import minimizers
    from winnowlake.operators import index, query
    from winnowlake.plans import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map={"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp()})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    place = tempfile.mkdtemp()
    docs, asked = catalog.docs(spark, sf), catalog.asked(spark, sf)
    spark.range(1000).selectExpr("sum(id)").collect()

    def save(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def build() -> None:
        index.write(index.build(docs, staging=f"{place}/_staging"), place)

    runs = {
        "minimizers": lambda: save(minimizers.minimizers(docs, ["doc_id"])),
        "build_index": build,
        "query_index_r1": lambda: save(query.run(index.read(spark, place), asked, 1.0)),
        "query_index_r08": lambda: save(query.run(index.read(spark, place), asked, 0.8)),
        "query_direct": lambda: save(query.run_direct(docs, asked, 1.0)),
        "invert_lineitem": lambda: save(index.color_ids(catalog.postings(spark, sf))),
        "rbo": lambda: save(catalog.QUERIES["rbo_min"](spark, sf)),
        "result_lines": lambda: save(query.lines(query.run(index.read(spark, place), asked, 0.3), asked)),
    }
    took = {}
    for name, run in runs.items():
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)
    chars = docs.agg(F.sum(F.length("seq"))).first()[0]
    scale = float(re.search(r"sf([\d.]+)", sf).group(1)) if re.search(r"sf([\d.]+)", sf) else sf
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale, "symbols_per_second_minimizers": round(chars / took["minimizers"])}))


if __name__ == "__main__":
    main()
