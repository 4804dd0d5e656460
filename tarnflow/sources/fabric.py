"""A hydro-fabric dataset: manifest, drainage graph, catchment units and snap targets."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traverse, validate

# Fixed values of the format.
FORMAT_VERSION, CRS = "0.2.1", "EPSG:4326"
D8_SCHEMA, SNAP_SCHEMA = "hfx.aux.d8_raster.v1", "hfx.aux.snap.v1"
BOX = "bbox_minx float, bbox_miny float, bbox_maxx float, bbox_maxy float"
UNITS = f"id long, level short, parent_id long, area_km2 float, up_area_km2 float, outlet_lon double, outlet_lat double, {BOX}, geometry binary"
GRAPH = f"id long, level short, upstream_ids array<bigint>, {BOX}"
SNAPS = f"id long, unit_id long, weight float, stem_role string, {BOX}, geometry binary"


class FabricError(Exception):
    """A dataset that cannot be used; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


#: Columns that a table may lack; they read as null.
OPTIONAL = {"parent_id", "outlet_lon", "outlet_lat", "stem_role", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table in the columns of schema. A column that is missing (unless optional) or of another type is an error; Spark
    would read the former as null and fail on the latter in the middle of a job. One footer is read for it."""
    have, want = {f.name: f.dataType for f in spark.read.parquet(path).schema}, spark.createDataFrame([], schema).schema
    for f in want:
        if f.name not in have and f.name not in OPTIONAL:
            raise FabricError("SCHEMA", f"{path} has no column {f.name}")
        if f.name in have and have[f.name].simpleString() != f.dataType.simpleString():
            raise FabricError("SCHEMA", f"{path}: {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return spark.read.schema(want).parquet(path)


def check_source(uri: str) -> str:
    """The dataset's root: a path, or a file, s3a, abfss, gs, hdfs or viewfs URI; s3 is read as s3a."""
    scheme = urlparse(uri).scheme
    if scheme not in ("", "file", "s3", "s3a", "abfss", "gs", "hdfs", "viewfs"):
        raise FabricError("SOURCE", f"scheme {scheme!r} is not supported")
    return "s3a" + uri[2:] if scheme == "s3" else uri


def parse_manifest(text: str) -> dict:
    """The manifest, checked in the order: version, coordinate system, topology, auxiliaries."""
    try:
        manifest = json.loads(text)
    except ValueError as e:
        raise FabricError("MANIFEST_INVALID", str(e)) from e
    if manifest.get("format_version") != FORMAT_VERSION:
        raise FabricError("UNSUPPORTED_VERSION", str(manifest.get("format_version")))
    for name in ("fabric_name", "crs", "topology", "bbox", "unit_count", "created_at", "adapter_version"):
        if name not in manifest:
            raise FabricError("MANIFEST_INVALID", f"{name} is missing")
    if manifest["crs"] != CRS:
        raise FabricError("UNSUPPORTED_CRS", manifest["crs"])
    if manifest["topology"] not in ("tree", "dag"):
        raise FabricError("MANIFEST_INVALID", f"topology {manifest['topology']!r}")
    for aux in manifest.setdefault("auxiliary", []):
        need = {D8_SCHEMA: ("flow_dir", "flow_acc"), SNAP_SCHEMA: ("snap",)}.get(aux.get("schema"), ())
        if any(a not in aux.get("artifacts", {}) for a in need):
            raise FabricError("AUX_INVALID", f"{aux.get('schema')} needs {', '.join(need)}")
        if aux.get("schema") == D8_SCHEMA and aux.get("metadata", {}).get("flow_dir_encoding") not in ("esri", "taudem"):
            raise FabricError("AUX_INVALID", "flow_dir_encoding is neither esri nor taudem")
        for path in aux.get("artifacts", {}).values():
            parts = PurePosixPath(path)
            if parts.is_absolute() or ".." in parts.parts:
                raise FabricError("AUX_INVALID", f"{path} leaves the dataset")
    return manifest


@dataclass(frozen=True)
class Fabric:
    """Lazy tables of one dataset; nothing but the manifest is read until a query runs."""

    manifest: dict
    units: DataFrame
    graph: DataFrame
    snaps: DataFrame | None

    @staticmethod
    def open(spark: SparkSession, uri: str, check: bool = True) -> Fabric:
        root = check_source(uri).rstrip("/")
        text = "\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect())
        manifest = parse_manifest(text)
        units, graph = read_table(spark, f"{root}/catchments.parquet", UNITS), read_table(spark, f"{root}/graph.parquet", GRAPH)
        snaps = None
        for aux in sorted((a for a in manifest["auxiliary"] if a["schema"] == SNAP_SCHEMA), key=lambda a: (a["metadata"].get("name", ""), a["artifacts"]["snap"])):
            table = read_table(spark, f"{root}/{aux['artifacts']['snap']}", SNAPS)
            table = table.withColumn("declared", F.lit(aux["metadata"].get("name"))).withColumn("references_levels", F.array(*[F.lit(x) for x in aux["metadata"].get("references_levels", [])]).cast("array<int>"))
            snaps = table if snaps is None else snaps.unionByName(table)
        fabric = Fabric(manifest, units, graph, snaps)
        if check:
            fabric.check()
        return fabric

    def violations(self) -> dict[str, DataFrame]:
        """Tables of violating rows; all are empty for a sound dataset."""
        edges = traverse.edge_list(self.graph)
        found = {
            "graph_without_unit": validate.missing(self.graph, self.units),
            "unit_without_graph": validate.missing(self.units, self.graph),
            "duplicate_units": validate.duplicates(self.units, ["id"]),
            "duplicate_graph_rows": validate.duplicates(self.graph, ["id"]),
            "level_conflicts": validate.level_conflicts(self.graph, self.units),
            "dangling_edges": traverse.dangling(edges, self.units),
            "cross_level_edges": validate.cross_level_edges(edges, self.units),
        }
        if self.snaps is not None:
            u = self.units.select(F.col("id").alias("unit_id"), "level")
            found["snaps"] = self.snaps.join(u, "unit_id", "left").where(F.col("level").isNull() | ~F.array_contains("references_levels", F.col("level").cast("int"))).select("id", "unit_id")
        return found

    def check(self) -> None:
        n = self.units.count()
        if n != self.manifest["unit_count"]:
            raise FabricError("COUNT_MISMATCH", f"{n} units, {self.manifest['unit_count']} declared")
        for name, rows in self.violations().items():
            if rows.limit(1).count():
                raise FabricError("SNAP_INTEGRITY" if name == "snaps" else "GRAPH_INTEGRITY", name)


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """Outlets of a CSV file with columns lat, lon and, optional, id and name; a row out of range fails the read."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if "lat" not in names or "lon" not in names:
        raise ValueError("the outlet file needs the columns lat and lon")
    lat, lon = (F.col(names[c]).cast("double") for c in ("lat", "lon"))
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    checked = lambda c: F.when(F.coalesce(ok, F.lit(False)), c).otherwise(F.raise_error(F.lit("an outlet has no valid lat and lon")).cast("double"))
    optional = [(F.col(names[c]) if c in names else F.lit(None)).cast("string").alias(c) for c in ("id", "name")]
    return raw.select(*optional, checked(lat).alias("lat"), checked(lon).alias("lon"))
