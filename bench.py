"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ("centre_of_gravity", "inertia_tensor", "gray_histogram", "tile_stats", "octree_rollup", "sobel_gradient", "border_classification", "cube_cases", "surface_vertices", "trilinear_samples", "crop_box", "voxel_grid", "radius_search", "radius_search_capped", "knn_search", "statistical_outlier_removal", "euclidean_clusters", "plane_scores", "mesh_area", "plane_slice_segments", "ray_hits", "nearest_time_match", "vector_knn_exact")


def brute_radius(spark: SparkSession, sf_dir: str):
    """The radius search as a cross join, the only baseline there is: each query against all points."""
    from geomill.plans.tables import points, queries

    q = queries(spark, sf_dir).select("query_id", *(F.col(c).alias(f"q{c}") for c in "xyz"))
    d2 = sum((F.col(c) - F.col(f"q{c}")) ** 2 for c in "xyz")
    return points(spark, sf_dir).crossJoin(F.broadcast(q)).withColumn("d2", d2).filter("d2 < 2500").select("query_id", "point_id", "d2")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from geomill.plans import catalog

    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(catalog.FLAGSHIP)  # starts the session's services, not counted
    run(lambda s, _: s.range(int(cpus), numPartitions=int(cpus)).mapInArrow(lambda batches: batches, "id long"))  # and its Python workers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(catalog.QUERIES[name])
        seconds[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    run(brute_radius)
    brute = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "brute_force_radius_search": brute, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
