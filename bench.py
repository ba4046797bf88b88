"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = ("search_files", "p13_combined", "k10_k11_recency_preference", "s4_planned_nothing", "s4_planned_extension",
             "s4_planned_trigram", "w1_candidate_cap", "f24_trigrams", "a4_catalogue", "r2_apply_batch", "j1_paths", "scan_empty", "scan_rare", "scan_filters")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from lodestone import queries
    from lodestone.sources import views

    # Uncapped scans of a stored file table, the reference figures that read every record; of many copies of it, so that
    # the rows count and not the query's fixed cost, which an empty scan shows.
    once = views.bench_files(spark, sf_dir)
    copies = int(os.environ.get("BENCH_COPIES", "16"))
    table = once.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).repartition(2 * int(cpus)).cache()
    rows = table.count()
    scans = {
        "scan_empty": lambda s, d: spark.range(0),
        "scan_rare": lambda s, d: table.where(F.col("lname").contains("zzqxjw")),
        "scan_filters": lambda s, d: table.where((F.col("extension") == "pdf") & (F.col("size") > 2_000_000)),
    }
    # The indexes are built once and looked up by the planned queries.
    began = time.time()
    queries.stored_postings(spark, sf_dir)
    built = round(time.time() - began, 3)
    every = {**queries.QUERIES, **scans}
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(3):
            began = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 4)
    took["postings_build"] = built
    per_row = {f"{n}_rows_per_s": round(rows / max(1e-3, took[n] - took["scan_empty"])) for n in scans if n != "scan_empty"}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir, "rows": rows, **per_row}))


if __name__ == "__main__":
    main()
