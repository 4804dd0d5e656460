"""Checks of a fabric's tables: each gives the rows that violate it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.select(key).join(right.select(key), key, "left_anti")


def level_conflicts(graph: DataFrame, units: DataFrame) -> DataFrame:
    u = units.select("id", F.col("level").alias("unit_level"))
    return graph.select("id", F.col("level").alias("graph_level")).join(u, "id").where("graph_level <> unit_level")


def cross_level_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges (id, up) between different levels."""
    levels = units.select("id", "level")
    low = edges.select("id", "up").join(levels, "id")
    return low.join(levels.select(F.col("id").alias("up"), F.col("level").alias("up_level")), "up").where("level <> up_level").select("id", "up", "level", "up_level")


def snap_violations(snaps: DataFrame, units: DataFrame, levels: list[int]) -> DataFrame:
    """Snap targets whose unit is missing or of a level that is not referenced."""
    u = units.select(F.col("id").alias("unit_id"), F.col("level").alias("unit_level"))
    out = snaps.select("snap_id", "unit_id").join(u, "unit_id", "left")
    return out.where(F.col("unit_level").isNull() | ~F.col("unit_level").isin(levels)).select("snap_id", "unit_id", F.when(F.col("unit_level").isNull(), "MissingUnit").otherwise("WrongLevel").alias("problem"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def crossings(edges: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Pairs (seq, other) of the edges (keys, seq, x1, y1, x2, y2) of a ring that cross properly: the ends of each lie on
    different sides of the other. Edges meet on the grid cells that their boxes touch, not all with all."""
    # One exchange serves both sides of the join.
    grid = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    dealt = edges.select(*keys, "seq", "x1", "y1", "x2", "y2", grid(F.col("x1"), F.col("x2")).alias("cx")).withColumn("cy", grid(F.col("y1"), F.col("y2"))).repartition(*keys, "cx", "cy")
    other = dealt.select(*keys, "cx", "cy", F.col("seq").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    turn = lambda ax, ay, bx, by, px, py: F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))
    mine = turn("x1", "y1", "x2", "y2", "ox1", "oy1") * turn("x1", "y1", "x2", "y2", "ox2", "oy2")
    theirs = turn("ox1", "oy1", "ox2", "oy2", "x1", "y1") * turn("ox1", "oy1", "ox2", "oy2", "x2", "y2")
    return dealt.join(other.hint("merge"), [*keys, "cx", "cy"]).where((F.col("seq") < F.col("other")) & (mine < 0) & (theirs < 0)).select(*keys, "seq", "other").distinct()


def first_origins(rows: DataFrame, key: str, origin: str, order: str) -> DataFrame:
    """Keys that more than one row has, with the origin of the first of them in order, and how many there are."""
    return rows.groupBy(key).agg(F.min_by(origin, order).alias("first_origin"), F.count("*").alias("n")).where("n > 1")
