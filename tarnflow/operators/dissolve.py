"""Dissolving units into basins by cancelling shared edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dealt


def sides(cells: DataFrame) -> DataFrame:
    """The four directed, counter-clockwise unit sides x1, y1, x2, y2 of each row's cell (x, y)."""
    x, y = F.col("x"), F.col("y")
    corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    side = F.explode(F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corners, corners[1:], strict=False)]))
    return cells.select("*", side.alias("s")).select(*[c for c in cells.columns if c not in ("x", "y")], "s.*")


def boundary(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges of each group that are on its outline: those whose reverse is not there. Both directions get one name, and
    a count tells: partial sums meet before the shuffle."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    named = edges.select(*keys, *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))], F.when(forward, 1).otherwise(-1).alias("way"))
    kept = named.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.sum("way").alias("way"), F.count("*").alias("n")).where("n = 1")
    return kept.select(*keys, *[F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def planar_area(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The signed shoelace area of each group's directed edges."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges.groupBy(*keys).agg((twice / 2).alias("planar_area"), F.count("*").alias("boundary_edges"))


def terminal_override(premerge: DataFrame, refined: DataFrame) -> DataFrame:
    """premerge (terminal, unit, area) with the terminal's own area replaced where refined (terminal, area) has one."""
    r = refined.select("terminal", F.col("area").alias("refined"))
    area = F.when(F.col("unit") == F.col("terminal"), F.coalesce("refined", "area")).otherwise(F.col("area"))
    return premerge.join(dealt(r), "terminal", "left").withColumn("area", area).drop("refined")


def largest_part(parts: DataFrame, key: str, part: str, area: str) -> DataFrame:
    """key, part, area of each key's largest part; of equally large ones the last."""
    return parts.groupBy(key).agg(F.max_by(F.struct(part, area), F.struct(area, part)).alias("m")).select(key, f"m.{part}", f"m.{area}")
