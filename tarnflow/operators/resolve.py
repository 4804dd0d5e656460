"""Outlet resolution: spatial joins by grid cell, then ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import dealt

METRES_LON, METRES_LAT = 111_320.0, 110_540.0


def select_level(units: DataFrame) -> DataFrame:
    """The finest level: the largest there is."""
    return units.agg(F.max("level").alias("level"))


def search_box(lon: Column, lat: Column, radius: float) -> list[Column]:
    """minx, miny, maxx, maxy of the box around a point, clamped to the world and cut to 32 bits."""
    up = F.lit(radius) / METRES_LAT
    aside = F.lit(radius) / (METRES_LON * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-10)))
    sides = (F.greatest(lon - aside, F.lit(-180.0)), F.greatest(lat - up, F.lit(-90.0)), F.least(lon + aside, F.lit(180.0)), F.least(lat + up, F.lit(90.0)))
    return [c.cast("float").alias(n) for c, n in zip(sides, ("minx", "miny", "maxx", "maxy"), strict=True)]


def local_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    east = (lon2 - lon1) * METRES_LON * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, (lat2 - lat1) * METRES_LAT)


def cells_of(minimum: Column, maximum: Column, cell: int) -> Column:
    return F.sequence(F.floor(minimum / cell), F.floor(maximum / cell))


def within_radius(outlets: DataFrame, targets: DataFrame, radius: int, x: str = "sx", y: str = "sy") -> DataFrame:
    """outlets (gx, gy) with every target at most radius away, and d2, the squared distance. Outlets are dealt to the grid
    cells that their box touches, targets to their own: an equi-join in place of a range join."""
    box = outlets.withColumn("cx", F.explode(cells_of(F.col("gx") - radius, F.col("gx") + radius, radius))).withColumn(
        "cy", F.explode(cells_of(F.col("gy") - radius, F.col("gy") + radius, radius))
    )
    own = targets.withColumn("cx", F.floor(F.col(x) / radius)).withColumn("cy", F.floor(F.col(y) / radius))
    d2 = (F.col("gx") - F.col(x)) * (F.col("gx") - F.col(x)) + (F.col("gy") - F.col(y)) * (F.col("gy") - F.col(y))
    return box.join(dealt(own), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("cx", "cy")


def snap_weight_first(hits: DataFrame) -> DataFrame:
    """Of each outlet the target with the highest weight, then mainstem, then nearest, then least id."""
    best = F.min_by(F.struct("snap_id", "unit_id", "d2"), F.struct(-F.col("weight"), -F.col("mainstem"), F.col("d2"), F.col("snap_id")))
    return hits.groupBy("outlet_id").agg(best.alias("b"), F.count("*").alias("candidates")).select("outlet_id", "b.*", "candidates")


def snap_distance_first(hits: DataFrame, tolerance: int = 1) -> DataFrame:
    """Of the targets within tolerance of the nearest, that with the highest weight, then mainstem, then least id; their
    distances do not count."""
    least = F.sqrt(F.min("d2").over(Window.partitionBy("outlet_id")))
    band = hits.withColumn("least", least).where(F.sqrt("d2") <= F.col("least") + tolerance)
    best = F.min_by(F.struct("snap_id", "unit_id", "d2"), F.struct(-F.col("weight"), -F.col("mainstem"), F.col("snap_id")))
    return band.groupBy("outlet_id").agg(best.alias("b"), F.count("*").alias("band")).select("outlet_id", "b.*", "band")


def containing(outlets: DataFrame, units: DataFrame, cell: int) -> DataFrame:
    """outlets with the units whose bounds contain them, and inside: whether strictly. Units of the cell's size or less
    touch few grid cells; both sides meet there."""
    box = units.withColumn("cx", F.explode(cells_of(F.col("minx"), F.col("maxx"), cell))).withColumn("cy", F.explode(cells_of(F.col("miny"), F.col("maxy"), cell)))
    at = outlets.withColumn("cx", F.floor(F.col("gx") / cell)).withColumn("cy", F.floor(F.col("gy") / cell))
    found = at.join(dealt(box), ["cx", "cy"]).where("minx <= gx and gx <= maxx and miny <= gy and gy <= maxy").drop("cx", "cy")
    return found.withColumn("inside", F.expr("minx < gx and gx < maxx and miny < gy and gy < maxy"))


def resolve_by_area(found: DataFrame) -> DataFrame:
    """Of each outlet's containing units (strictly if any, else those it lies on the edge of) the one with the largest
    upstream area (null last), then local area, then least id; and the reason that told it from the next."""
    strict = F.max("inside").over(Window.partitionBy("outlet_id"))
    some = found.withColumn("strict", strict).where(F.col("inside") | ~F.col("strict"))
    w = Window.partitionBy("outlet_id").orderBy(F.col("up_area").desc_nulls_last(), F.col("area").desc(), "id")
    ranked = some.select(
        "outlet_id", "id", "area", "up_area", "strict", F.row_number().over(w).alias("place"), F.lead("up_area").over(w).alias("up2"),
        F.lead("area").over(w).alias("area2"), F.count("*").over(Window.partitionBy("outlet_id")).alias("candidates"),
    )
    reason = F.when(F.col("candidates") == 1, None).when(~F.col("up_area").eqNullSafe(F.col("up2")), "HighestUpstreamArea").when(F.col("area") != F.col("area2"), "HighestLocalArea").otherwise("LowestUnitId")
    return ranked.where("place = 1").select("outlet_id", F.col("id").alias("unit_id"), "candidates", "strict", reason.alias("reason"))
