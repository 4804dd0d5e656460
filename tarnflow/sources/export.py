"""Sinks: basins as Parquet in Hilbert order with GeoParquet metadata beside it, and as GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, spatial
from . import scratch


class ExportError(ValueError):
    """Rows that cannot be exported."""


def default_label(fabric_name: str, fabric_version: str | None, method: str) -> str:
    if method not in ("d8-best-effort", "d8-required", "no-refine"):
        raise ExportError(f"unknown method {method!r}")
    if not fabric_version:
        raise ExportError("the fabric has no version")
    return f"{fabric_name}/{fabric_version}/{method}"


def basin_rows(results: DataFrame, label: str, basin_id: str | None = None, adapter_version: str | None = None) -> DataFrame:
    """The export columns of resolved results (geometry, lat, lon, area_km2, terminal, ...). basin_id names a column; without
    one the terminal's id is the name."""
    done = results.where("status = 'Resolved'")
    name = F.col(basin_id).cast("string") if basin_id else F.col("terminal").cast("string")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data in pdf["geometry"]:
                points = [q for p in geometry.from_wkb(data) for q in p[0]]
                xs, ys = zip(*points, strict=True)
                (a, c), (b, d) = geometry.outward(min(xs), max(xs)), geometry.outward(min(ys), max(ys))
                out.append((a, b, c, d, (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "_x", "_y"])], axis=1)

    rows = done.select(
        name.alias("basin_id"), F.lit(label).alias("delineation"), "geometry", F.col("lon").alias("outlet_lon"), F.col("lat").alias("outlet_lat"), "area_km2",
        F.col("method").alias("resolution_method"), "upstream_unit_ids", F.lit(adapter_version).cast("string").alias("adapter_version"),
    )
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    out = rows.mapInPandas(boxes, kinds + ", bbox_minx float, bbox_miny float, bbox_maxx float, bbox_maxy float, _x double, _y double")
    key = spatial.hilbert(spatial.quantised(F.col("_x"), -180.0, 180.0), spatial.quantised(F.col("_y"), -90.0, 90.0))
    return out.withColumn("hilbert", key).drop("_x", "_y")


#: The coordinate system of all geometries, as GeoParquet wants it (PROJJSON).
WGS84 = {
    "type": "GeographicCRS",
    "name": "WGS 84",
    "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
    "coordinate_system": {
        "subtype": "ellipsoidal",
        "axis": [
            {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
            {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"},
        ],
    },
    "id": {"authority": "EPSG", "code": 4326},
}


def write_basins(rows: DataFrame, path: str) -> None:
    """Writes basin_rows() as Parquet in Hilbert order. Names must be valid and, with their delineation, unique. Spark's
    writer takes no footer keys of ours: the GeoParquet metadata is the one line of <path>/_geo/."""
    rows = scratch.written(rows)  # checks, files and bounds read the basins; they are made once
    bad = rows.where(~spatial.valid_basin_id(F.col("basin_id"))).limit(1).collect()
    if bad:
        raise ExportError(f"invalid basin_id {bad[0]['basin_id']!r}")
    twice = rows.groupBy("basin_id", "delineation").count().where("count > 1").limit(1).collect()
    if twice:
        raise ExportError(f"duplicate basin {twice[0]['basin_id']!r}")
    rows.repartitionByRange("hilbert", "basin_id").sortWithinPartitions("hilbert", "basin_id", "delineation").drop("hilbert").write.mode("errorifexists").parquet(path)
    box = rows.agg(F.min("bbox_minx"), F.min("bbox_miny"), F.max("bbox_maxx"), F.max("bbox_maxy")).first()
    column = {"encoding": "WKB", "geometry_types": ["MultiPolygon"], "crs": WGS84, "bbox": [None if v is None else float(v) for v in box]}
    meta = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}})
    rows.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_geo")


def features(results: DataFrame) -> DataFrame:
    """outlet_id and feature: each result as a GeoJSON Feature, a failed one with a null geometry and its status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shape = None if r.geometry is None else {"type": "MultiPolygon", "coordinates": geometry.from_wkb(r.geometry)}
                props = {"id": str(r.outlet_id), "status": r.status, "terminal": None if pd.isna(r.terminal) else int(r.terminal), "area_km2": None if pd.isna(r.area_km2) else r.area_km2, "method": r.method}
                out.append(json.dumps({"type": "Feature", "geometry": shape, "properties": props}))
            yield pd.DataFrame({"outlet_id": pdf["outlet_id"], "feature": out})

    rows = results.select("outlet_id", "status", "terminal", "method", "area_km2", "geometry")
    return rows.mapInPandas(run, f"outlet_id {dict(rows.dtypes)['outlet_id']}, feature string")
