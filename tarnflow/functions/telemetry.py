"""Stage timings as JSON lines."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def stage(spark: SparkSession, name: str, sink=None):
    """Names the jobs of a block after a stage and writes {kind, stage, duration_ms} to sink, a text file, when it ends."""
    spark.sparkContext.setJobDescription(name)
    began = time.perf_counter()
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        if sink is not None:
            sink.write(json.dumps({"kind": "stage", "stage": name, "duration_ms": round(1000 * (time.perf_counter() - began), 3)}) + "\n")
