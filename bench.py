"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads.  Each query is run once to warm up
on what it reads and then timed, its whole result written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["voronoi_cells", "voronoi_facets", "power_cells", "pressure_force", "viscous_force", "neighbor_range_join", "knn_closest_first", "block_halo_replication", "moving_step", "walled_cells", "cell_sections"]


def main() -> None:
    from cellweave.operators.tessellate import tessellate
    from cellweave.queries import QUERIES
    from cellweave.sources import seeds_from_embeddings

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}

    def timed(name, query):
        start = time.time()
        run(query())
        took[name] = round(time.time() - start, 3)

    run(QUERIES["voronoi_cells"](spark, SF))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, SF))
    # 21 seeds of each vector: enough cells for a rate
    seeds = seeds_from_embeddings(spark, SF, 21).cache()
    n = seeds.count()
    timed("voronoi_many", lambda: tessellate(seeds, topology=False).select("cell_id", "volume", "n_facets"))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cells": n, "cells_per_sec": round(n / took["voronoi_many"])}))
    spark.stop()


if __name__ == "__main__":
    main()
