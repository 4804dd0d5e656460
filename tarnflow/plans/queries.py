"""The registered queries: the engine's operators on the derived fabric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial
from ..operators import assemble, dissolve, raster, resolve, traverse, validate
from ..sources.derived import DEGREES, STEPS, Derived
from ..sources.scratch import dealt, written

RADIUS, WINDOW_ROWS, TILE = 60, 8192, 5


def _resolved(d: Derived) -> DataFrame:
    return resolve.resolve_by_area(resolve.containing(d.outlets(), d.units().drop("x", "y"), STEPS))


def _hits(d: Derived) -> DataFrame:
    return resolve.within_radius(d.outlets(), d.snaps(), RADIUS)


def _basins(d: Derived) -> DataFrame:
    terminals = _resolved(d).select(F.col("unit_id").alias("terminal"))
    return traverse.upstream_tree(terminals, traverse.edge_list(d.graph("tree")).select("id", "up"))


def select_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.select_level(Derived(spark, sf_dir).leveled())


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Derived(spark, sf_dir).leveled().groupBy("level").agg(F.count("*").alias("units"))


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.edge_list(Derived(spark, sf_dir).graph("dag"))


def bbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    low, high = d.width // 4 * STEPS, d.width // 2 * STEPS
    return d.units().where((F.col("minx") <= high) & (F.col("maxx") >= low) & (F.col("miny") <= high) & (F.col("maxy") >= low)).select("id", "area")


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    wanted = _resolved(d).select(F.col("unit_id").alias("id")).distinct()
    return d.units().select("id", "level", "area", "up_area").join(dealt(wanted), "id", "left_semi")


def search_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    at = d.outlets().select("outlet_id", (F.col("gx") / 1000.0).alias("lon"), (F.col("gy") / 1000.0).alias("lat"))
    box = resolve.search_box(F.col("lon"), F.col("lat"), 1000.0)
    return at.select("outlet_id", *box).select("outlet_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def snap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(Derived(spark, sf_dir)).groupBy("outlet_id").agg(F.count("*").alias("candidates"), F.min("d2").alias("nearest_d2"))


def snap_weight_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.snap_weight_first(_hits(Derived(spark, sf_dir)))


def snap_distance_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.snap_distance_first(_hits(Derived(spark, sf_dir)))


def pip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return resolve.containing(d.outlets(), d.units(), STEPS).where("inside").select("outlet_id", F.col("id").alias("unit_id"))


def pip_boundary_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(Derived(spark, sf_dir))


def resolve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    status = F.when(F.col("unit_id").isNull(), "OutsideAllCatchments").otherwise("Resolved")
    return d.outlets().select("outlet_id").join(dealt(_resolved(d).select("outlet_id", "unit_id")), "outlet_id", "left").select("outlet_id", "unit_id", status.alias("status"))


def upstream_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basins(Derived(spark, sf_dir))


def upstream_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    terminals = _resolved(d).select(F.col("unit_id").alias("terminal"))
    return traverse.upstream(terminals, traverse.edge_list(d.graph("dag"))).select("terminal", "unit")


def bfs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    terminals = _resolved(d).select(F.col("unit_id").alias("terminal"))
    return traverse.upstream(terminals, traverse.edge_list(d.graph("tree")), ranked=True).select("terminal", "unit", "depth", "rank")


def same_level_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    lift = d.leveled().where("level = 1").select(F.col("parent_id").alias("id"), F.col("id").alias("up"))
    edges = traverse.edge_list(d.graph("tree")).select("id", "up").unionByName(lift.where("id % 11 = 0"))
    return validate.cross_level_edges(edges, d.leveled())


def pre_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return _basins(d).join(dealt(d.units().select(F.col("id").alias("unit"), "area", "up_area")), "unit").select("terminal", "unit", "area", "up_area")


def _refined(d: Derived) -> DataFrame:
    return d.units().where("id % 3 = 0").select(F.col("id").alias("terminal"), F.expr("area div 2").alias("area"))


def terminal_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    rows = dissolve.terminal_override(pre_merge(spark, sf_dir), _refined(d))
    return rows.groupBy("terminal").agg(F.sum("area").alias("area"))


def _outline(d: Derived) -> DataFrame:
    cells = _basins(d).join(dealt(d.units().select(F.col("id").alias("unit"), "x", "y")), "unit").select("terminal", "x", "y")
    return dissolve.boundary(dissolve.sides(cells), ["terminal"])


def dissolve_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(Derived(spark, sf_dir)).groupBy("terminal").agg(F.count("*").alias("edges"))


def dissolve_planar_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissolve.planar_area(_outline(Derived(spark, sf_dir)), ["terminal"]).select("terminal", F.col("planar_area").cast("long").alias("planar_area"))


def delineate_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each outlet's terminal unit with the units, local area and depth of its basin."""
    d = Derived(spark, sf_dir)
    totals = _totals(d, "tree").select(F.col("id").alias("unit_id"), "units", F.col("total").alias("area"), "depth")
    return _resolved(d).join(dealt(totals), "unit_id").select("outlet_id", "unit_id", "reason", "units", "area", "depth")


def morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    x, y = (spatial.quantised(F.col(c) / 1000.0, -180.0, 180.0) for c in ("minx", "miny"))
    return d.units().select("id", spatial.morton(x, y).alias("morton"))


def hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    x, y = spatial.quantised(F.col("minx") / 1000.0, -180.0, 180.0), spatial.quantised(F.col("miny") / 1000.0, -90.0, 90.0)
    return d.units().select("id", spatial.hilbert(x, y).alias("hilbert"))


def d8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    dr, dc = raster.step(F.expr("shiftleft(1, cast(o_custkey % 9 as int))"))
    tr, tc = raster.step((F.col("o_custkey") % 9).cast("int"), raster.TAUDEM)
    return Derived(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("cell"), dr.alias("esri_row"), dc.alias("esri_col"), tr.alias("taudem_row"), tc.alias("taudem_col"))


def pixel_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Derived(spark, sf_dir).outlets()
    row, col = raster.pixel(F.col("gx"), F.col("gy"), 0, 5000, 25, 25)
    return at.select("outlet_id", col.alias("col"), row.alias("row"))


def _triangles(d: Derived) -> DataFrame:
    """Triangles in pixels, one to a supplier, as directed edges."""
    s = F.col("s_suppkey")
    p = [(s % 7, s % 5), (s % 7 + 8 + s % 3, s % 5 + 1), (s % 7 + 2, s % 5 + 9 + s % 4)]
    sides = F.explode(F.array(*[F.struct(*[v.cast("double").alias(n) for v, n in zip((*a, *b), ("x1", "y1", "x2", "y2"), strict=True)]) for a, b in zip(p, [*p[1:], p[0]], strict=True)]))
    return d.table("supplier").select(s.alias("polygon"), sides.alias("e")).select("polygon", "e.*")


def rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterize(_triangles(Derived(spark, sf_dir)), ["polygon"])


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return raster.masked(d.cells(), raster.rasterize(_triangles(d), ["polygon"]))


def snap_pour_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    at = d.outlets().select("outlet_id", (F.col("gy") % 200 / 10.0).alias("prow"), (F.col("gx") % 900 / 10.0).alias("pcol"))
    return raster.snap_pour_point(at, d.cells(), 300_000.0, 3)


def trace_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Derived(spark, sf_dir).cells()
    return raster.trace_upstream(cells.where("row % 5 = 4 and col % 25 = 20").select("row", "col"), cells)


def polygonize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    cells = raster.rasterize(_triangles(d), ["polygon"]).select("polygon", F.col("col").alias("x"), F.col("row").alias("y"))
    return dissolve.planar_area(dissolve.boundary(dissolve.sides(cells), ["polygon"]), ["polygon"]).select("polygon", "boundary_edges", F.col("planar_area").cast("long").alias("cells"))


def d8_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    k, side = F.col("n_nationkey"), TILE * STEPS
    tx, ty = (k % TILE) * side, F.floor(k / TILE) * side
    tiles = d.table("nation").select(k.alias("tile_id"), tx.alias("tminx"), ty.alias("tminy"), (tx + side + F.when(k % 4 == 0, STEPS).otherwise(0)).alias("tmaxx"), (ty + side).alias("tmaxy"))
    boxes = d.units().withColumn("maxx", F.col("maxx") + F.when(F.col("id") % 6 == 0, STEPS).otherwise(0))
    return raster.select_tile(boxes, tiles)


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return d.units().agg(F.count("*").alias("units")).crossJoin(d.graph().agg(F.count("*").alias("graph_rows")))


def validate_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    graph, units = d.graph().where("id % 17 <> 3"), d.units().where("id % 13 <> 5")
    return validate.missing(graph, units).withColumn("problem", F.lit("NoUnit")).unionByName(validate.missing(units, graph).withColumn("problem", F.lit("NoGraphRow")))


def validate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return validate.level_conflicts(d.graph(), d.units().withColumn("level", F.when(F.col("id") % 19 == 0, 1).otherwise(0)))


def validate_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    return traverse.dangling(traverse.edge_list(d.graph("dag")), d.units().where("id % 23 <> 7")).select("id", "up")


def validate_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    units = d.units().where("id % 29 <> 1").withColumn("level", F.when(F.col("id") % 31 == 2, 1).otherwise(0))
    return validate.snap_violations(d.snaps(), units, [0])


def basin_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Derived(spark, sf_dir).table("customer")
    k = F.col("c_custkey")
    name = F.element_at(F.array(F.col("c_name"), F.concat(F.lit("com"), k % 12), F.concat(k.cast("string"), F.lit(".")), F.concat(F.lit("basin "), k), F.concat(F.lit("a_b-"), k), F.repeat(F.lit("x"), (k % 200).cast("int")), F.lit("..")), (k % 7 + 1).cast("int"))
    return rows.select(k.alias("id"), name.alias("basin_id")).select("id", "basin_id", spatial.valid_basin_id(F.col("basin_id")).alias("valid"))


def default_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(F.lit("d8-best-effort"), F.lit("d8-required"), F.lit("no-refine")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return Derived(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws("/", "s_name", F.concat(F.lit("v"), F.col("s_nationkey")), method).alias("label"))


def row_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each export, one to a market segment, in balanced row groups: one below 4096 rows, else ceil(n / 8192)."""
    n = Derived(spark, sf_dir).table("customer").groupBy("c_mktsegment").agg((F.count("*") * 37).alias("n"))
    groups = F.when(F.col("n") < 4096, 1).otherwise(F.ceil(F.col("n") / WINDOW_ROWS)).cast("long")
    g = n.withColumn("groups", groups).withColumn("row_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    return g.select("c_mktsegment", "row_group", (F.floor(F.col("n") / F.col("groups")) + F.when(F.col("row_group") < F.col("n") % F.col("groups"), 1).otherwise(0)).alias("rows"))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Derived(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("basin_id"), F.col("l_linenumber").alias("delineation"))
    return validate.duplicates(rows, ["basin_id", "delineation"])


def dataset_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Derived(spark, sf_dir).units().agg(*[f(c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resolve_status(spark, sf_dir)
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("unit_id").isNotNull()).alias("succeeded"), F.count_if(F.col("unit_id").isNull()).alias("failed"))


def basin_sizes_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets as they arrive in the events: arrivals and basin area by hour."""
    d = Derived(spark, sf_dir)
    areas = written(delineate_area(spark, sf_dir).select("outlet_id", "area"))
    hour = F.date_trunc("hour", "ts").alias("hour")
    return d.table("events").select(hour, F.col("user_id").alias("outlet_id")).join(dealt(areas), "outlet_id").groupBy("hour").agg(F.count("*").alias("arrivals"), F.sum("area").alias("area"))


def largest_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest basin of each nation's outlets; ties go to the least outlet."""
    d = Derived(spark, sf_dir)
    nation = d.table("customer").select(F.col("c_custkey").alias("outlet_id"), F.col("c_nationkey").alias("nation"))
    w = Window.partitionBy("nation").orderBy(F.col("area").desc(), "outlet_id")
    return delineate_area(spark, sf_dir).join(dealt(nation), "outlet_id").withColumn("place", F.row_number().over(w)).where("place = 1").select("nation", "outlet_id", "units", "area")


def basin_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terminal's dissolved basin: geometry, geodesic area and bounds."""
    return assemble.assemble(_outline(Derived(spark, sf_dir)), "terminal", DEGREES)


def d8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    dr, dc = o % 5 - 2, F.floor(o / 5) % 5 - 2
    code = F.expr("shiftleft(1, cast(o_custkey % 9 as int))")
    return Derived(spark, sf_dir).table("orders").select(
        o.alias("cell"), raster.code_of(dr, dc).alias("esri"), raster.code_of(dr, dc, raster.TAUDEM).alias("taudem"), raster.opposite(code).alias("back")
    )


def pixel_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return Derived(spark, sf_dir).table("supplier").select(k.alias("id"), raster.pixel_area((k % 9 + 1) / 4, -(k % 5 + 1) / 8).alias("area"))


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    wanted = d.outlets().select("outlet_id", (F.col("gy") % 40).alias("row"), (F.col("gx") % 120).alias("col"))
    return raster.lookup(wanted, d.cells())


def _refined_terminals(d: Derived) -> tuple[DataFrame, DataFrame]:
    s = F.col("s_suppkey")
    at = d.table("supplier").select(s.alias("polygon"), (s % 5 + 3.25).cast("double").alias("prow"), (s % 7 + 3.5).cast("double").alias("pcol"))
    return raster.refine_terminals(at, _triangles(d), d.cells(), 100_000.0, "polygon")


def refine_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each terminal's pour point, and how many of its cells drain there."""
    pours, cells = _refined_terminals(Derived(spark, sf_dir))
    n = cells.groupBy("polygon").agg(F.count("*").alias("cells"))
    return pours.join(n, "polygon", "left").select("polygon", "status", "pour_row", "pour_col", F.coalesce("cells", F.lit(0)).alias("cells"))


def refined_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of each refined terminal: its sides, and its area in cells."""
    _, cells = _refined_terminals(Derived(spark, sf_dir))
    sides = dissolve.sides(cells.select("polygon", F.col("col").alias("x"), F.col("row").alias("y")))
    return dissolve.planar_area(dissolve.boundary(sides, ["polygon"]), ["polygon"]).select("polygon", "boundary_edges", F.col("planar_area").cast("long").alias("cells"))


def refinement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Derived(spark, sf_dir)
    i = F.col("id")
    mode = F.element_at(F.array(F.lit("d8-best-effort"), F.lit("d8-required"), F.lit("no-refine")), (i % 3 + 1).cast("int"))
    return d.units().select("id", raster.refinement_gate(mode, i % 4 != 0, i % 5 != 0).alias("gate"))


def self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of four-sided rings, one to an order, that cross."""
    k = F.col("o_orderkey")
    p = [(k % 7, k % 5), (k % 7 + 6, k % 5 + 1 + k % 3), (k % 7 + k % 4 * 2, k % 5 + 5), (k % 7 + 5 - k % 3 * 3, k % 5 + 6 + k % 2)]
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), *[v.alias(n) for v, n in zip((*p[i], *p[(i + 1) % 4]), ("x1", "y1", "x2", "y2"), strict=True)]) for i in range(4)]))
    edges = Derived(spark, sf_dir).table("orders").select(k.alias("ring"), sides.alias("e")).select("ring", "e.*")
    return validate.crossings(edges, ["ring"], 8)


def first_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.first_origins(Derived(spark, sf_dir).table("orders"), "o_custkey", "o_orderstatus", "o_orderkey")


def largest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest triangle of each nation."""
    d = Derived(spark, sf_dir)
    areas = dissolve.planar_area(_triangles(d), ["polygon"]).select("polygon", F.abs("planar_area").alias("area"))
    nation = d.table("supplier").select(F.col("s_suppkey").alias("polygon"), F.col("s_nationkey").alias("nation"))
    return dissolve.largest_part(areas.join(nation, "polygon"), "nation", "polygon", "area")


def same_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.same_units(upstream_tree(spark, sf_dir), upstream_dag(spark, sf_dir))


def _totals(d: Derived, kind: str) -> DataFrame:
    down = traverse.edge_list(d.graph(kind)).select(F.col("up").alias("id"), F.col("id").alias("down"))
    return traverse.upstream_totals(d.units().select("id", F.col("area").alias("value")).join(dealt(down), "id", "left"))


def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, area and depth upstream of every unit."""
    return _totals(Derived(spark, sf_dir), "tree")


def river_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on one river through all units, thousands of reaches deep."""
    return _totals(Derived(spark, sf_dir), "chain")


NAMES = [
    select_level, levels, edge_list, bbox_scan, id_lookup, search_bbox, snap_candidates, snap_weight_first, snap_distance_first, pip_strict, pip_boundary_tiebreak, resolve_status,
    upstream_tree, upstream_dag, bfs_rank, same_level_violation, pre_merge, terminal_override, dissolve_boundary, dissolve_planar_area, delineate_area, morton, hilbert, d8_decode,
    pixel_coord, rasterize, mask, snap_pour_point, trace_upstream, polygonize_edges, d8_select, validate_counts, validate_membership, validate_levels, validate_dangling,
    validate_snaps, basin_id_check, default_label, row_group_plan, duplicate_rows, dataset_bbox, envelope, basin_sizes_by_arrival, largest_basins,
    basin_geometry, d8_encode, pixel_area, cell_lookup, refine_terminals, refined_outline, refinement_gate, self_intersections, first_origins, largest_part, same_units,
    tree_totals, river_totals,
]
QUERIES = {f.__name__: f for f in NAMES}
