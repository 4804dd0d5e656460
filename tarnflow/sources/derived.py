"""A drainage fabric derived from the driver's tables by whole-number arithmetic.

Units are parts on a grid of W columns; coordinates are hundredths of a cell. Unit i drains from 2i and 2i + 1 (tree), and also
from 3i (dag). Outlets are customers, snap targets and raster cells are orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell has so many coordinate steps a side and spans so many degrees.
STEPS, DEGREES = 100, 0.1


class Derived:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.n = self.table("part").count()
        self.width = math.isqrt(max(0, self.n - 1)) + 1
        self.height = self.n // self.width

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def units(self) -> DataFrame:
        """id, level, area, up_area (nullable), cell x and y, and the bounds in coordinate steps."""
        i, w = F.col("p_partkey"), F.lit(self.width)
        x, y = i % w, F.floor(i / w)
        up = F.when(i % 7 != 0, F.col("p_retailprice"))
        u = self.table("part").select((i + 1).alias("id"), F.lit(0).alias("level"), F.col("p_size").cast("long").alias("area"), up.alias("up_area"), x.alias("x"), y.alias("y"))
        return u.select("*", (F.col("x") * STEPS).alias("minx"), (F.col("y") * STEPS).alias("miny"), ((F.col("x") + 1) * STEPS).alias("maxx"), ((F.col("y") + 1) * STEPS).alias("maxy"))

    def leveled(self) -> DataFrame:
        """The units twice: at level 0, and as level 1 with ids moved up by n and the level-0 unit as parent."""
        u = self.units().select("id", "level", "area", F.lit(None).cast("long").alias("parent_id"))
        return u.unionByName(u.select((F.col("id") + self.n).alias("id"), F.lit(1).alias("level"), "area", F.col("id").alias("parent_id")))

    def graph(self, kind: str = "tree") -> DataFrame:
        """id, upstream_ids; kind is tree, dag or chain."""
        i = F.col("p_partkey") + 1
        of = {"tree": (2 * i, 2 * i + 1), "dag": (2 * i, 2 * i + 1, 3 * i), "chain": (i + 1,)}[kind]
        up = F.filter(F.array_distinct(F.array(*of)), lambda u: u <= self.n)
        return self.table("part").select(i.alias("id"), F.lit(0).alias("level"), up.alias("upstream_ids"))

    def outlets(self) -> DataFrame:
        """outlet_id, gx, gy in coordinate steps; every 50th lies outside the fabric."""
        c = F.col("c_custkey")
        gx = (c * 37) % (STEPS * self.width) + F.when(c % 50 == 49, STEPS * self.width + 1).otherwise(0)
        return self.table("customer").select(c.alias("outlet_id"), gx.alias("gx"), ((c * 91) % (STEPS * max(1, self.height))).alias("gy"))

    def snaps(self) -> DataFrame:
        """snap_id, unit_id, weight, mainstem, sx, sy."""
        o, w = F.col("o_orderkey"), F.lit(self.width)
        s = self.table("orders").select((o + 1).alias("snap_id"), ((o * 7) % self.n + 1).alias("unit_id"), (o % 5).alias("weight"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("mainstem"), (F.col("o_custkey") % 100).alias("dx"), (o % 100).alias("dy"))
        u = F.col("unit_id") - 1
        return s.select("snap_id", "unit_id", "weight", "mainstem", ((u % w) * STEPS + F.col("dx")).alias("sx"), (F.floor(u / w) * STEPS + F.col("dy")).alias("sy"))

    def cells(self) -> DataFrame:
        """row, col, code (D8 step east, south-east or south: 1, 2, 4) and acc, null where there is no data."""
        o = F.col("o_orderkey")
        code = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("o_custkey") % 3 + 1).cast("int"))
        return self.table("orders").select(F.floor(o / 100).alias("row"), (o % 100).alias("col"), F.when(o % 31 != 0, code).alias("code"), F.when(o % 31 != 0, F.col("o_totalprice")).alias("acc"))


#: The same relations in SQL, as common table expressions.
SQL = """
WITH RECURSIVE dims AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
grid AS (SELECT n, w, n // w AS h FROM dims),
units AS (SELECT p_partkey + 1 AS id, 0 AS level, CAST(p_size AS BIGINT) AS area, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS up_area,
  p_partkey % w AS x, p_partkey // w AS y, p_partkey % w * 100 AS minx, p_partkey // w * 100 AS miny, (p_partkey % w + 1) * 100 AS maxx, (p_partkey // w + 1) * 100 AS maxy FROM part, grid),
leveled AS (SELECT id, level, area, CAST(NULL AS BIGINT) AS parent_id FROM units UNION ALL SELECT id + n, 1, area, id FROM units, grid),
tree AS (SELECT id, unnest([2 * id, 2 * id + 1]) AS up, unnest([0, 1]) AS pos FROM units),
tree_edges AS (SELECT id, up, pos FROM tree, grid WHERE up <= n),
dag AS (SELECT id, unnest(CASE WHEN id = 1 THEN [2 * id, 2 * id + 1] ELSE [2 * id, 2 * id + 1, 3 * id] END) AS up, unnest(CASE WHEN id = 1 THEN [0, 1] ELSE [0, 1, 2] END) AS pos FROM units),
dag_edges AS (SELECT id, up, pos FROM dag, grid WHERE up <= n),
outlets AS (SELECT c_custkey AS outlet_id, (c_custkey * 37) % (100 * w) + CASE WHEN c_custkey % 50 = 49 THEN 100 * w + 1 ELSE 0 END AS gx, (c_custkey * 91) % (100 * greatest(1, h)) AS gy FROM customer, grid),
snaps AS (SELECT o_orderkey + 1 AS snap_id, (o_orderkey * 7) % n + 1 AS unit_id, o_orderkey % 5 AS weight, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS mainstem,
  (o_orderkey * 7) % n % w * 100 + o_custkey % 100 AS sx, (o_orderkey * 7) % n // w * 100 + o_orderkey % 100 AS sy FROM orders, grid),
cells AS (SELECT o_orderkey // 100 AS "row", o_orderkey % 100 AS col, CASE WHEN o_orderkey % 31 <> 0 THEN [1, 2, 4][1 + CAST(o_custkey % 3 AS INTEGER)] END AS code, CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END AS acc FROM orders),
pip AS (SELECT outlet_id, gx, gy, id, area, up_area, minx < gx AND gx < maxx AND miny < gy AND gy < maxy AS inside FROM outlets, units WHERE minx <= gx AND gx <= maxx AND miny <= gy AND gy <= maxy),
ranked AS (SELECT *, row_number() OVER w AS place, lead(up_area) OVER w AS up2, lead(area) OVER w AS area2, count(*) OVER (PARTITION BY outlet_id) AS candidates
  FROM (SELECT *, max(inside) OVER (PARTITION BY outlet_id) AS strict FROM pip) WHERE inside OR NOT strict
  WINDOW w AS (PARTITION BY outlet_id ORDER BY up_area DESC NULLS LAST, area DESC, id)),
resolved AS (SELECT outlet_id, id AS unit_id, candidates, strict, CASE WHEN candidates = 1 THEN NULL WHEN up_area IS DISTINCT FROM up2 THEN 'HighestUpstreamArea' WHEN area <> area2 THEN 'HighestLocalArea' ELSE 'LowestUnitId' END AS reason FROM ranked WHERE place = 1),
near AS (SELECT outlet_id, snap_id, unit_id, weight, mainstem, (gx - sx) * (gx - sx) + (gy - sy) * (gy - sy) AS d2 FROM outlets JOIN snaps ON sx BETWEEN gx - 60 AND gx + 60 AND sy BETWEEN gy - 60 AND gy + 60),
hits AS (SELECT * FROM near WHERE d2 <= 3600),
basin AS (SELECT DISTINCT unit_id AS terminal, unit_id AS unit, 0 AS depth FROM resolved UNION ALL SELECT terminal, up, depth + 1 FROM basin JOIN tree_edges ON unit = id),
basin_dag AS (SELECT DISTINCT unit_id AS terminal, unit_id AS unit FROM resolved UNION SELECT terminal, up FROM basin_dag JOIN dag_edges ON unit = id)
"""
