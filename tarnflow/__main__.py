"""Command line: python -m tarnflow delineate DATASET (--lat LAT --lon LON | --outlets FILE) [options]; prints GeoJSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.delineate import Options, delineate_batch
from .sources.export import features
from .sources.fabric import Fabric, read_outlets


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnflow")
    d = parser.add_subparsers(dest="command", required=True).add_parser("delineate")
    d.add_argument("dataset")
    d.add_argument("--lat", type=float)
    d.add_argument("--lon", type=float)
    d.add_argument("--outlets")
    d.add_argument("--snap-radius", type=float, default=1000.0)
    d.add_argument("--snap-strategy", choices=["weight-first", "distance-first"], default="weight-first")
    d.add_argument("--no-check", action="store_true")
    a = parser.parse_args(args)
    if (a.outlets is None) == (a.lat is None or a.lon is None):
        parser.error("give --lat and --lon, or --outlets")
    spark = SparkSession.builder.appName("tarnflow").getOrCreate()
    fabric = Fabric.open(spark, a.dataset, check=not a.no_check)
    if a.outlets:
        rows = read_outlets(spark, a.outlets)
        rows = rows.select(F.coalesce("id", F.monotonically_increasing_id().cast("string")).alias("outlet_id"), "lat", "lon")
    else:
        rows = spark.createDataFrame([("0", a.lat, a.lon)], "outlet_id string, lat double, lon double")
    done = features(delineate_batch(fabric, rows, Options(a.snap_radius, a.snap_strategy)))
    failed = 0
    for r in done.toLocalIterator():
        print(r["feature"])
        failed += '"status": "Resolved"' not in r["feature"]
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
