"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Shredding is measured against the same query on JSON text, in this Spark, as absolute numbers of other machines don't compare.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emergent.operators.shred import records
from emergent.plans import catalog
from emergent.session import shared_dir

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def best(run, times: int = 3) -> float:
    """Seconds of the fastest of some runs, after one that compiles."""
    took = []
    for _ in range(times + 1):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(min(took[1:]), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    docs = rows.select(F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))).alias("value"))
    docs.repartition(int(CPUS)).write.parquet(f"{folder}/json")  # the table is one row group, which a single core would read
    text = spark.read.parquet(f"{folder}/json")
    count = text.count()
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    queries: dict[str, float] = {}
    numbers = iter(range(100))
    queries["ingest"] = best(lambda: records(text).write.parquet(f"{folder}/typed-{next(numbers)}"), 2)
    typed = spark.read.parquet(f"{folder}/typed-0")
    path = lambda p: F.get_json_object("value", p)
    for name, shredded, plain in (
        ("errors", typed.where("quantity >= 45").groupBy("`line.flag`").count(), text.where(path("$.quantity").cast("double") >= 45).groupBy(path("$.line.flag")).count()),
        ("p99", typed.groupBy("`line.status`").agg(F.percentile("price", 0.99)), text.groupBy(path("$.line.status")).agg(F.percentile(path("$.price").cast("double"), 0.99))),
        ("status", typed.groupBy("`line.status`").count(), text.groupBy(path("$.line.status")).count()),
    ):
        queries[f"{name}_shredded"] = best(lambda q=shredded: done(q))
        queries[f"{name}_json"] = best(lambda q=plain: done(q))
    for name in ("agg_by_dotted", "shred_events", "explode_envelope", "otlp_traces_flatten", "join_multi", "agg_pricing", "window_running", "join_asof", "top_k"):
        queries[name] = best(lambda n=name: done(catalog.QUERIES[n](spark, SF_DIR)), 1)
    total = round(sum(queries.values()), 3)
    ratios = {n: round(queries[f"{n}_json"] / max(queries[f"{n}_shredded"], 1e-3), 1) for n in ("errors", "p99", "status")}
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": queries, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "ingest_rows_per_sec": round(count / queries["ingest"]), "json_over_shredded": ratios}))
    spark.stop()


if __name__ == "__main__":
    main()
