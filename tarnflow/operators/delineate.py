"""Delineation of many outlets at once over an opened fabric."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..sources.fabric import Fabric
from . import assemble, dissolve, resolve, traverse


class DelineationError(Exception):
    """An outlet that failed, in a batch asked to raise."""


@dataclass(frozen=True)
class Options:
    """How outlets are resolved and basins finished."""

    snap_radius: float = 1000.0
    snap_strategy: str = "weight-first"
    snap_tolerance: float = 1.0
    fill_holes: bool = True

    def __post_init__(self):
        if self.snap_strategy not in ("weight-first", "distance-first"):
            raise ValueError(f"snap_strategy {self.snap_strategy!r} is neither weight-first nor distance-first")
        if not self.snap_radius > 0:
            raise ValueError("snap_radius must be positive")


CELL = 0.1  # degrees: the grid on which outlets and boxes meet


def _points(data: bytes) -> np.ndarray:
    """The points of a Point or LineString."""
    order = "<" if data[0] == 1 else ">"
    kind = np.frombuffer(data, order + "u4", 1, 1)[0]
    at, n = (5, 1) if kind == 1 else (9, int(np.frombuffer(data, order + "u4", 1, 5)[0]))
    return np.frombuffer(data, order + "f8", 2 * n, at).reshape(n, 2)


def _bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and the 32-bit bounds of each geometry."""
    for pdf in batches:
        out = []
        for data in pdf["geometry"]:
            kind = int.from_bytes(data[1:5], "little" if data[0] == 1 else "big")
            p = _points(data) if kind in (1, 2) else np.array([q for polygon in geometry.from_wkb(data) for ring in polygon for q in ring])
            (a, c), (b, d) = geometry.outward(*(float(f(p[:, 0])) for f in (np.min, np.max))), geometry.outward(*(float(f(p[:, 1])) for f in (np.min, np.max)))
            out.append((a, b, c, d))
        yield pd.DataFrame(out, columns=["bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"]).assign(id=pdf["id"].to_numpy())


def _meeting(outlets: DataFrame, boxes: DataFrame, half_x, half_y) -> DataFrame:
    """Outlets with the rows whose 32-bit bounds touch the box around them, by an equi-join on grid cells. The box ends at the
    edges of the world, and an outlet outside it meets nothing; near a pole it is a whole circle of cells. Rows without bounds take
    those of their geometry. Only cells, ids and bounds are dealt out; the other columns join the pairs that are left."""
    grid = lambda a, b: F.sequence(F.floor(a / CELL), F.floor(b / CELL))
    low = lambda c, bound: F.greatest(c, F.lit(-bound))
    high = lambda c, bound: F.least(c, F.lit(bound))
    box = ((low(F.col("lon") - half_x, 180.0), "ox1"), (high(F.col("lon") + half_x, 180.0), "ox2"), (low(F.col("lat") - half_y, 90.0), "oy1"), (high(F.col("lat") + half_y, 90.0), "oy2"))
    o = outlets.where("lon between -180 and 180 and lat between -90 and 90").select("*", *[c.alias(n) for c, n in box])
    o = o.withColumn("cx", F.explode(grid(F.col("ox1"), F.col("ox2")))).withColumn("cy", F.explode(grid(F.col("oy1"), F.col("oy2"))))
    bounds = ["bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"]
    bare = F.greatest(*[F.col(c).isNull() for c in bounds])
    narrow = boxes.where(~bare).select("id", *bounds).unionByName(boxes.where(bare & F.col("geometry").isNotNull()).select("id", "geometry").mapInPandas(_bounds, f"id {dict(boxes.dtypes)['id']}, " + ", ".join(f"{c} float" for c in bounds)))
    b = narrow.withColumn("cx", F.explode(grid(F.col("bbox_minx"), F.col("bbox_maxx")))).withColumn("cy", F.explode(grid(F.col("bbox_miny"), F.col("bbox_maxy"))))
    hit = o.join(b, ["cx", "cy"]).where("bbox_minx <= ox2 and bbox_maxx >= ox1 and bbox_miny <= oy2 and bbox_maxy >= oy1")
    hit = hit.select(*outlets.columns, "id").dropDuplicates(["outlet_id", "id"])
    return hit.join(boxes, "id")


def _position(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds where: 2 inside the geometry, 1 on its edge, 0 outside."""
    for pdf in batches:
        where = []
        for data, x, y in zip(pdf["geometry"], pdf["lon"], pdf["lat"], strict=True):
            polygons = geometry.from_wkb(data)
            on = any(geometry.on_ring(r, (x, y)) for p in polygons for r in p)
            inside = any(geometry.contains(p[0], (x, y)) and not any(geometry.contains(h, (x, y)) for h in p[1:]) for p in polygons)
            where.append(1 if on else 2 if inside else 0)
        yield pdf.drop(columns="geometry").assign(where=np.array(where, np.int32))


def resolve_in_polygons(outlets: DataFrame, units: DataFrame) -> DataFrame:
    half_y = F.lit(100.0) / resolve.METRES_LAT
    half_x = F.lit(100.0) / (resolve.METRES_LON * F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(1e-10)))
    near = _meeting(outlets, units.select("id", "area_km2", "up_area_km2", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "geometry"), half_x, half_y)
    rows = near.select("outlet_id", "lon", "lat", "id", F.col("area_km2").alias("area"), F.col("up_area_km2").alias("up_area"), "geometry")
    kinds = dict(rows.dtypes)
    found = rows.mapInPandas(_position, ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "geometry") + ", where int").where("where > 0")
    return resolve.resolve_by_area(found.withColumn("inside", F.col("where") == 2)).select("outlet_id", "unit_id", F.concat(F.lit("pip"), F.coalesce(F.concat(F.lit(":"), "reason"), F.lit(""))).alias("method"))


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds px, py: the point of a Point or LineString that is nearest in degrees."""
    for pdf in batches:
        found = []
        for data, x, y in zip(pdf["geometry"], pdf["lon"], pdf["lat"], strict=True):
            p = _points(data)
            if len(p) > 1:
                a, d = p[:-1], np.diff(p, axis=0)
                size = (d**2).sum(1)
                t = np.clip(((np.array([x, y]) - a) * d).sum(1) / np.where(size > 0, size, 1), 0, 1)
                p = a + d * t[:, None]
            found.append(p[((p - [x, y]) ** 2).sum(1).argmin()])
        points = np.array(found).reshape(-1, 2)
        yield pdf.drop(columns="geometry").assign(px=points[:, 0], py=points[:, 1])


def resolve_on_snaps(outlets: DataFrame, snaps: DataFrame, options: Options) -> DataFrame:
    half_y = F.lit(options.snap_radius) / resolve.METRES_LAT
    half_x = F.lit(options.snap_radius) / (resolve.METRES_LON * F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(1e-10)))
    near = _meeting(outlets, snaps.select("id", "unit_id", "weight", "stem_role", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "geometry"), half_x, half_y)
    rows = near.select("outlet_id", "lon", "lat", F.col("id").alias("snap_id"), "unit_id", "weight", F.when(F.col("stem_role") == "mainstem", 1).otherwise(0).alias("mainstem"), "geometry")
    kinds = dict(rows.dtypes)
    hits = rows.mapInPandas(_nearest, ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "geometry") + ", px double, py double")
    hits = hits.withColumn("metres", resolve.local_metres(F.col("lon"), F.col("lat"), F.col("px"), F.col("py"))).where(F.col("metres") <= options.snap_radius)
    if options.snap_strategy == "distance-first":
        hits = hits.withColumn("least", F.min("metres").over(Window.partitionBy("outlet_id"))).where(F.col("metres") <= F.col("least") + options.snap_tolerance)
        order = F.struct(-F.col("weight"), -F.col("mainstem"), F.col("snap_id"))
    else:
        order = F.struct(-F.col("weight"), -F.col("mainstem"), F.col("metres"), F.col("snap_id"))
    return hits.groupBy("outlet_id").agg(F.min_by(F.struct("unit_id", "snap_id"), order).alias("b")).select("outlet_id", "b.unit_id", F.concat(F.lit("snap:"), F.col("b.snap_id")).alias("method"))


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The directed sides x1, y1, x2, y2 of each unit, in degrees."""
    for pdf in batches:
        for terminal, data in zip(pdf["terminal"], pdf["geometry"], strict=True):
            sides = [(*a, *b) for p in geometry.canonical(geometry.from_wkb(data), 12) for r in p for a, b in zip(r, r[1:], strict=False)]
            yield pd.DataFrame(np.array(sides, float).reshape(-1, 4), columns=["x1", "y1", "x2", "y2"]).assign(terminal=terminal)


def _dissolved(parts: DataFrame, fill: bool) -> DataFrame:
    """terminal, geometry, area_km2, clash of the union of parts (terminal, geometry), whose shared borders have the same points:
    sides that two units share in opposite directions cancel. A side that two units have in the same direction is a clash
    (they overlap): such a basin has no geometry."""
    sides = parts.mapInPandas(_sides, "x1 double, y1 double, x2 double, y2 double, terminal long")
    twice = sides.groupBy("terminal", "x1", "y1", "x2", "y2").count().where("count > 1").select("terminal", F.lit(True).alias("clash")).distinct()
    outline = dissolve.boundary(sides, ["terminal"]).join(twice, "terminal", "left_anti")
    shapes = assemble.assemble(outline, "terminal", 1.0, fill).select("terminal", "geometry", "area_km2")
    return shapes.join(twice, "terminal", "full")


def delineate_batch(fabric: Fabric, outlets: DataFrame, options: Options | None = None) -> DataFrame:
    """outlets (outlet_id, lat, lon) with status, terminal, method, upstream_unit_ids (breadth-first), geometry (WKB) and
    area_km2. An outlet that cannot be resolved has a status other than Resolved and nulls; one whose
    units overlap (UnitsOverlap) has no geometry and area. Basins of one terminal are made once."""
    options = options or Options()
    level = resolve.select_level(fabric.units)
    units = fabric.units.join(F.broadcast(level), "level", "left_semi")
    snaps = None
    if fabric.snaps is not None:
        snaps = fabric.snaps.join(F.broadcast(level), F.array_contains("references_levels", F.col("level").cast("int")))
        least = F.min("declared").over(Window.partitionBy())
        snaps = snaps.withColumn("first", least).where(F.col("declared").eqNullSafe(F.col("first"))) if snaps.limit(1).count() else None
    found = resolve_on_snaps(outlets, snaps, options) if snaps is not None else resolve_in_polygons(outlets, units)
    edges = traverse.edge_list(fabric.graph)
    basin = traverse.upstream(found.select(F.col("unit_id").alias("terminal")), edges, ranked=True)
    order = basin.groupBy("terminal").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"]).alias("upstream_unit_ids"))
    parts = basin.join(units.select(F.col("id").alias("unit"), "geometry"), "unit").select("terminal", "geometry")
    shapes = _dissolved(parts, options.fill_holes)
    out = outlets.join(found.withColumnRenamed("unit_id", "terminal"), "outlet_id", "left").join(order, "terminal", "left").join(shapes, "terminal", "left")
    failed = "NoSnapCandidates" if snaps is not None else "OutsideAllCatchments"
    status = F.when(F.col("terminal").isNull(), failed).when(F.col("clash"), "UnitsOverlap").otherwise("Resolved")
    return out.select("outlet_id", "lat", "lon", status.alias("status"), "terminal", "method", "upstream_unit_ids", "geometry", "area_km2")


def collect_or_raise(results: DataFrame) -> list:
    """All results in the order of outlet_id; the first failure raises."""
    rows = results.orderBy("outlet_id").collect()
    for r in rows:
        if r["status"] != "Resolved":
            raise DelineationError(f"outlet {r['outlet_id']}: {r['status']}")
    return rows
