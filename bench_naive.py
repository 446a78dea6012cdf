"""The engine's plans beside naive nested loops at $BENCH_SF_DIR; prints one JSON line.

No outside figure exists for these queries, so the plan that compares every row of one side with every row of the other,
written as plain Spark SQL, is the yardstick. Both give the same rows, which is checked by a hash; the second of two runs counts. Each query's figures also go to stderr when it ends.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import spatial
from voxloom.plans import fixtures as x
from voxloom.plans.scratch import writer
from voxloom.session import local_session, ship

INSIDE = "abs(cos(yaw)*(x-tx)+sin(yaw)*(z-tz)) <= sx/2 AND abs(y-ty) <= sy/2 AND abs(cos(yaw)*(z-tz)-sin(yaw)*(x-tx)) <= sz/2"
NEAR = "greatest(least(w/x,(w+1)/x), least(h/y,(h+1)/y), least(d/z,(d+1)/z))"
FAR = "least(greatest(w/x,(w+1)/x), greatest(h/y,(h+1)/y), greatest(d/z,(d+1)/z))"
SQUARED = "(q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z)"

NAIVE = {
    "J1_voxels": "SELECT DISTINCT cloud_id, h, w, d FROM points, voxels WHERE x BETWEEN w AND w+1 AND y BETWEEN h AND h+1 AND z BETWEEN d AND d+1",
    "J2_free_space": f"SELECT DISTINCT cloud_id, h, w, d FROM points, voxels WHERE {NEAR} <= {FAR} AND {NEAR} < 1 AND {FAR} > 0",
    "F2_points_in_oriented_box": f"SELECT box_id, point_id FROM points, boxes WHERE {INSIDE}",
    "A7_distance_field": "SELECT cloud_id, h, w, d, round(sqrt(min((w+0.5D-x)*(w+0.5D-x)+(h+0.5D-y)*(h+0.5D-y)+(d+0.5D-z)*(d+0.5D-z))), 6) AS distance FROM points, voxels GROUP BY 1, 2, 3, 4",
    "J10_nearest_points": f"SELECT query_id, point_id FROM (SELECT q.point_id AS query_id, p.point_id, row_number() OVER (PARTITION BY q.point_id ORDER BY {SQUARED}, p.point_id) AS place FROM points q JOIN points p ON p.cloud_id = q.cloud_id) WHERE place <= 3",
}


def native(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    points = x.points(spark, sf_dir)
    if name == "J1_voxels":
        return spatial.occupancy(points, x.GRID)
    if name == "J2_free_space":
        return spatial.carved(x.rays(spark, sf_dir), x.GRID)
    if name == "F2_points_in_oriented_box":
        return spatial.points_in_boxes(points, x.boxes(spark, sf_dir)).select("box_id", "point_id")
    if name == "A7_distance_field":
        return spatial.distance_field(points, x.GRID).withColumn("distance", F.round("distance", 6))
    return spatial.nearest(points.withColumnRenamed("point_id", "query_id"), points, 3, 4.0, writer(spark)).select("query_id", "point_id")


def timed(make) -> tuple[float, tuple]:
    """Seconds of the second run (of the first if it is long), and the result's rows and hash."""
    for _ in range(2):
        start = time.perf_counter()
        df = make()
        wide = [F.col(c).cast("long") if t in ("int", "bigint") else F.col(c) for c, t in sorted(df.dtypes)]
        found = df.agg(F.count("*"), F.sum(F.xxhash64(*wide).cast("decimal(38,0)"))).first()
        seconds = time.perf_counter() - start
        if seconds > 10:  # long ones once
            break
    return round(seconds, 3), tuple(found)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "12g"))
    ship(spark)
    x.points(spark, sf_dir).createOrReplaceTempView("points")
    x.boxes(spark, sf_dir).createOrReplaceTempView("boxes")
    spatial.voxels(spark, x.GRID).createOrReplaceTempView("voxels")
    out = {}
    for name, sql in NAIVE.items():
        ours, a = timed(lambda name=name: native(spark, sf_dir, name))
        naive, b = timed(lambda sql=sql: spark.sql(sql))
        out[name] = {"native": ours, "naive": naive, "ratio": round(naive / ours, 2), "rows": a[0], "same": a == b}
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "native_against_naive", "queries": out, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
