"""Delineation over a small fabric on disk: resolution, traversal, dissolve, export, stream, command line."""

import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarnflow.__main__ import main
from tarnflow.functions import geometry
from tarnflow.operators import delineate
from tarnflow.operators.delineate import DelineationError, Options, collect_or_raise, delineate_batch
from tarnflow.sources.export import ExportError, basin_rows, default_label, features, write_basins
from tarnflow.sources.fabric import Fabric, FabricError, check_source, parse_manifest, read_outlets
from tarnflow.streaming.outlets import delineate_stream


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


RECTS = {1: (0, 0, 1, 1), 2: (1, 0, 2, 1), 3: (1, 1, 2, 2), 4: (5, 5, 6, 6)}
UPSTREAM = {1: [2], 2: [3], 3: [], 4: []}


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    return write_dataset(tmp_path_factory.mktemp("fabric"))


def write_dataset(root, snaps=False, upstream=UPSTREAM, count=4):
    f32 = lambda i: pa.array([r[i] for r in RECTS.values()], pa.float32())
    boxes = {n: f32(i) for i, n in enumerate(("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"))}
    level = pa.array([0] * 4, pa.int16())
    pq.write_table(pa.table({
        "id": list(RECTS), "level": level, "parent_id": pa.array([None] * 4, pa.int64()), "area_km2": pa.array([1, 2, 3, 4], pa.float32()), "up_area_km2": pa.array([30, 20, None, 4], pa.float32()),
        "outlet_lon": [0.5] * 4, "outlet_lat": [0.5] * 4, **boxes, "geometry": [geometry.to_wkb([[box(*r)]]) for r in RECTS.values()]}), root / "catchments.parquet")
    pq.write_table(pa.table({"id": list(upstream), "level": level, "upstream_ids": pa.array(list(upstream.values()), pa.list_(pa.int64())), **boxes}), root / "graph.parquet")
    aux = []
    if snaps:
        at = [(0.5, 0.5), (0.501, 0.5), (1.5, 0.5)]
        pad = {n: pa.array([p[i % 2] + (1e-6 if i > 1 else -1e-6) for p in at], pa.float32()) for i, n in enumerate(("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"))}
        pq.write_table(pa.table({"id": [1, 2, 3], "unit_id": [1, 2, 2], "weight": pa.array([1, 9, 5], pa.float32()), "stem_role": ["mainstem", None, "tributary"], **pad, "geometry": [struct.pack("<BIdd", 1, 1, *p) for p in at]}), root / "snap.parquet")
        aux = [{"schema": "hfx.aux.snap.v1", "artifacts": {"snap": "snap.parquet"}, "metadata": {"name": "s", "references_levels": [0]}}]
    manifest = {"format_version": "0.2.1", "fabric_name": "test", "crs": "EPSG:4326", "topology": "tree", "bbox": [-180, -90, 180, 90], "unit_count": count, "created_at": "x", "adapter_version": "1", "auxiliary": aux}
    (root / "manifest.json").write_text(json.dumps(manifest))
    return root


def outlets(spark, *points):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(points)], "outlet_id long, lat double, lon double")


def test_delineate(spark, dataset):
    fabric = Fabric.open(spark, str(dataset))
    got = {r.outlet_id: r for r in delineate_batch(fabric, outlets(spark, (0.5, 0.5), (1.0, 0.5), (9, 9), (1.5, 1.5))).collect()}
    assert got[0].upstream_unit_ids == [1, 2, 3] and got[0].method == "pip" and got[2].status == "OutsideAllCatchments" and got[2].geometry is None
    assert got[1].terminal == 1 and got[1].method == "pip:HighestUpstreamArea" and got[3].terminal == 3
    shape = geometry.canonical(geometry.from_wkb(got[0].geometry))
    assert shape == [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]
    assert got[0].area_km2 == pytest.approx(sum(geometry.geodesic_area([[box(*RECTS[i])]]) for i in (1, 2, 3)), rel=1e-6)
    with pytest.raises(DelineationError):
        collect_or_raise(delineate_batch(fabric, outlets(spark, (9, 9))))


def test_outlets_at_the_edges_of_the_world(spark, dataset):
    """A box around an outlet ends at a pole; outlets outside the world resolve to nothing."""
    got = delineate_batch(Fabric.open(spark, str(dataset)), outlets(spark, (10, 90), (180, 0), (10, 95))).collect()
    assert len(got) == 3 and all(r["terminal"] is None and r["status"] != "Resolved" for r in got)


def test_dissolve_finds_overlaps_and_keeps_only_the_outline_in_a_group(spark, monkeypatch):
    rows = [(7, geometry.to_wkb([[box(x, y, x + 1, y + 1)]])) for x in range(12) for y in range(12)]
    rows += [(8, geometry.to_wkb([[box(*b)]])) for b in ((0, 0, 1, 1), (1, 0, 2, 1), (1, 0, 2, 1))]
    seen = []
    real = delineate.assemble.assemble
    monkeypatch.setattr(delineate.assemble, "assemble", lambda outline, *a: seen.append(outline) or real(outline, *a))
    got = {r.terminal: r for r in delineate._dissolved(spark.createDataFrame(rows, "terminal long, geometry binary"), True).collect()}
    assert seen[0].count() == 48  # of 576 sides
    assert not got[7].clash and got[7].area_km2 == pytest.approx(geometry.geodesic_area([[box(0, 0, 12, 12)]]), rel=1e-3)
    assert got[8].clash and got[8].geometry is None and got[8].area_km2 is None


@pytest.mark.parametrize(("strategy", "terminal"), [("weight-first", 2), ("distance-first", 1)])
def test_snap_strategies(spark, tmp_path, strategy, terminal):
    fabric = Fabric.open(spark, str(write_dataset(tmp_path, snaps=True)))
    got = {r.outlet_id: r for r in delineate_batch(fabric, outlets(spark, (0.5, 0.5), (0.2, 0.2)), Options(snap_strategy=strategy)).collect()}
    assert got[0].terminal == terminal and got[1].status == "NoSnapCandidates"


def test_violations(spark, tmp_path):
    with pytest.raises(FabricError, match="GRAPH_INTEGRITY"):
        Fabric.open(spark, str(write_dataset(tmp_path, upstream={1: [2], 2: [77], 3: [], 4: []})))
    with pytest.raises(FabricError, match="COUNT_MISMATCH"):
        Fabric.open(spark, str(write_dataset(tmp_path, count=5)))


@pytest.mark.parametrize(("change", "code"), [({"format_version": "0.1"}, "UNSUPPORTED_VERSION"), ({"crs": "EPSG:3857"}, "UNSUPPORTED_CRS"), ({"topology": "ring"}, "MANIFEST_INVALID"),
                                              ({"auxiliary": [{"schema": "hfx.aux.snap.v1", "artifacts": {}}]}, "AUX_INVALID"), ({"auxiliary": [{"schema": "x", "artifacts": {"a": "../b"}}]}, "AUX_INVALID")])
def test_manifest(change, code):
    good = {"format_version": "0.2.1", "fabric_name": "f", "crs": "EPSG:4326", "topology": "dag", "bbox": [], "unit_count": 1, "created_at": "", "adapter_version": ""}
    assert parse_manifest(json.dumps(good))["auxiliary"] == []
    with pytest.raises(FabricError, match=code):
        parse_manifest(json.dumps(good | change))
    with pytest.raises(FabricError, match="SOURCE"):
        check_source("ftp://x/y")


def test_export_stream_and_command_line(spark, dataset, tmp_path, capsys):
    fabric = Fabric.open(spark, str(dataset))
    done = delineate_batch(fabric, outlets(spark, (0.5, 0.5), (5.5, 5.5), (9, 9)))
    write_basins(basin_rows(done, default_label("test", "1", "no-refine")), str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out"))
    assert {r.basin_id: len(r.upstream_unit_ids) for r in table.collect()} == {"1": 3, "4": 1} and "bbox_maxy" in table.columns
    with pytest.raises(ExportError):
        write_basins(basin_rows(done.union(done), "x"), str(tmp_path / "twice"))
    with pytest.raises(ExportError):
        default_label("test", None, "no-refine")
    shapes = [json.loads(r.feature) for r in features(done).orderBy("outlet_id").collect()]
    assert [s["geometry"] is None for s in shapes] == [False, False, True]
    (tmp_path / "in").mkdir()
    outlets(spark, (0.5, 0.5), (9, 9)).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("outlet_id long, lat double, lon double").parquet(str(tmp_path / "in" / "*"))
    delineate_stream(fabric, stream, str(tmp_path / "basins"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "basins")).collect()) == ["OutsideAllCatchments", "Resolved"]
    (tmp_path / "o.csv").write_text("id,lat,lon\na,0.5,0.5\nb,9,9\n")
    assert main(["delineate", str(dataset), "--outlets", str(tmp_path / "o.csv")]) == 1
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    (tmp_path / "bad.csv").write_text("lat,lon\n99,0\n")
    with pytest.raises(Exception, match="valid lat and lon"):
        read_outlets(spark, str(tmp_path / "bad.csv")).collect()


def test_totals_and_roots_double_their_steps(spark):
    from tarnflow.operators import traverse

    n = 70
    links = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(n)] + [(100, 0, None), (200, 999, 5)], "id long, down long, value long")
    got = {r.id: (r.units, r.total, r.depth) for r in traverse.upstream_totals(links).collect()}
    assert got == {i: (n - i + (i == 0), sum(range(i, n)), n - 1 - i) for i in range(n)} | {100: (1, None, 0), 200: (1, 5, 0)}
    assert {r.id: r.root for r in traverse.roots(links).collect()} == {i: 0 for i in [*range(n), 100]} | {200: 999}
    loop = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1)], "id long, down long, value long")
    with pytest.raises(ValueError, match="cycle"):
        traverse.upstream_totals(loop)
    assert {r.root for r in traverse.roots(loop).collect()} <= {1, 2, 3}
    assert not traverse.upstream_totals(links.limit(0)).count() and not traverse.roots(links.limit(0)).count()


def test_proper_crossings_only(spark):
    from tarnflow.operators import validate

    bow = [(0, 0, 0, 10, 10), (1, 10, 10, 10, 0), (2, 10, 0, 0, 10), (3, 0, 10, 0, 0)]
    touch = [(0, 0, 0, 10, 0), (1, 10, 0, 5, 0), (2, 5, 0, 5, 9), (3, 5, 9, 0, 0)]  # sides that meet or overlap do not cross
    rows = [("bow", *e) for e in bow] + [("touch", *e) for e in touch]
    edges = spark.createDataFrame(rows, "ring string, seq int, x1 long, y1 long, x2 long, y2 long")
    assert [tuple(r) for r in validate.crossings(edges, ["ring"], 4).collect()] == [("bow", 0, 2)]


def rewritten(root, name, change):
    pq.write_table(change(pq.read_table(root / name)), root / name)


@pytest.mark.parametrize("snaps", [False, True])
def test_rows_without_bounds_take_those_of_their_geometry(spark, tmp_path, snaps):
    root = write_dataset(tmp_path, snaps=snaps)
    points = outlets(spark, (0.5, 0.5), (1.5, 0.5), (9, 9))
    want = sorted(map(str, delineate_batch(Fabric.open(spark, str(root)), points).collect()))

    def bare(t):
        i = t.schema.get_field_index("bbox_minx")
        return t.set_column(i, "bbox_minx", pa.array([None, *t["bbox_minx"].to_pylist()[1:]], pa.float32()))

    rewritten(root, "snap.parquet" if snaps else "catchments.parquet", bare)
    assert sorted(map(str, delineate_batch(Fabric.open(spark, str(root)), points).collect())) == want


def test_schemas_are_checked(spark, tmp_path):
    root = write_dataset(tmp_path)
    rewritten(root, "catchments.parquet", lambda t: t.drop_columns(["parent_id"]))
    Fabric.open(spark, str(root))
    rewritten(root, "catchments.parquet", lambda t: t.drop_columns(["area_km2"]))
    with pytest.raises(FabricError, match="no column area_km2"):
        Fabric.open(spark, str(root))
    root = write_dataset(tmp_path)
    rewritten(root, "graph.parquet", lambda t: t.set_column(0, "id", t["id"].cast(pa.string())))
    with pytest.raises(FabricError, match="id is string, not bigint"):
        Fabric.open(spark, str(root))

NOT_BROADCAST = ["id_lookup", "snap_candidates", "snap_weight_first", "snap_distance_first", "pip_strict", "pip_boundary_tiebreak", "resolve_status", "envelope", "delineate_area", "largest_basins",
                 "basin_sizes_by_arrival", "upstream_tree", "upstream_dag", "bfs_rank", "pre_merge", "terminal_override", "dissolve_boundary", "dissolve_planar_area", "same_units", "tree_totals",
                 "river_totals", "snap_pour_point", "trace_upstream"]


@pytest.mark.parametrize("name", NOT_BROADCAST)
def test_tables_that_grow_do_not_pass_the_driver(spark, sf_dir, monkeypatch, name):
    from tarnflow import registry
    from tarnflow.operators import raster, traverse
    from tarnflow.plans import queries

    plans, real = [], traverse.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (traverse, raster, queries):
        monkeypatch.setattr(module, "written", lambda df: plan(df) or real(df))
    monkeypatch.setattr(traverse, "SHORT", -1, raising=False)
    plan(registry.QUERIES[name](spark, sf_dir))
    assert not [p for p in plans if "BroadcastExchange" in p or "UnionLoop" in p]


def reached(up, start):
    seen, todo = set(), [start]
    while todo:
        if (u := todo.pop()) not in seen:
            seen.add(u)
            todo += up.get(u, [])
    return seen


def test_traversal_of_graphs_with_cycles_and_many_ways(spark, monkeypatch):
    from tarnflow.operators import traverse

    up = {i: [i + 1, i + 2] for i in range(1, 40)} | {41: [39, 1], 50: [51], 51: [50]}
    edges = traverse.edge_list(spark.createDataFrame(list(up.items()), "id long, upstream_ids array<long>"))
    found = traverse.upstream(spark.createDataFrame([(t,) for t in (1, 30, 50, 99)], "terminal long"), edges).collect()
    assert len(found) == len(set(found)) and {(r.terminal, r.unit) for r in found} == {(t, u) for t in (1, 30, 50, 99) for u in reached(up, t)}
    assert {r.unit: r.depth for r in found if r.terminal == 1}[40] == 20  # the shortest way
    with pytest.raises(ValueError, match="cycle"):
        traverse.upstream_tree(spark.createDataFrame([(50,)], "terminal long"), edges.select("id", "up"), 9)


def test_a_long_way_between_pour_points_takes_few_rounds(spark, monkeypatch):
    from tarnflow.operators import raster, traverse

    n, rounds, real = 200, [], traverse.written
    for module in (traverse, raster):
        monkeypatch.setattr(module, "written", lambda df: rounds.append(df) or real(df))
    cells = [(0, c, 1) for c in range(n)] + [(1, 0, 1), (1, 1, 4), (2, 1, 16), (2, 0, 64), (1, 5, 64), (7, 7, None)]  # a row, a ring, one cell more
    pours = [(0, 150), (0, n - 1), (0, n + 3), (2, 1), (7, 7), (0, 150)]
    got = raster.trace_upstream(spark.createDataFrame(pours, "row long, col long"), spark.createDataFrame(cells, "row long, col long, code int")).collect()
    up = {}
    for r, c, code in cells:
        if code:
            up.setdefault((r + raster.ESRI[code][0], c + raster.ESRI[code][1]), []).append((r, c))
    want = sorted((*p, *u) for p in set(pours) for u in reached(up, p))
    assert sorted(map(tuple, got)) == want and len(rounds) < 30


def test_outlets_at_one_place_share_a_search(spark, monkeypatch):
    from tarnflow.operators import raster

    outlets = spark.createDataFrame([(i, 1.5, 1.5) for i in range(500)] + [(900, 9.5, 9.5), (901, None, 1.0)], "outlet_id long, prow double, pcol double")
    cells = spark.createDataFrame([(1, 2, 7.0), (2, 1, 7.0), (1, 1, 1.0)], "row long, col long, acc double")
    kept, real = [], raster.dealt
    monkeypatch.setattr(raster, "dealt", lambda df: kept.append(df) or real(df))
    got = raster.snap_pour_point(outlets, cells, 5.0, 3).collect()
    assert sorted(map(tuple, got)) == [(i, 1, 2, 7.0, 1.0) for i in range(500)] and min(k.count() for k in kept) == 1


def test_crossings_are_dealt_out_once(spark):
    from tarnflow.operators import validate

    edges = spark.createDataFrame([("bow", 0, 0, 0, 10, 10), ("bow", 1, 10, 0, 0, 10)], "ring string, seq int, x1 long, y1 long, x2 long, y2 long")
    got = validate.crossings(edges, ["ring"], 4)
    assert [tuple(r) for r in got.collect()] == [("bow", 0, 1)]
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_basins_of_a_batch_are_assembled_together(spark):
    """Basins that go on in the next batch, and each ring's area as if it were alone."""
    from tarnflow.operators import assemble, dissolve

    cells = [(t, t * 3 + i % (t + 1), t % 50 + i // (t + 1)) for t in range(40) for i in range(2 * t + 2)]
    outline = dissolve.boundary(dissolve.sides(spark.createDataFrame(cells, "terminal long, x long, y long")), ["terminal"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = assemble.assemble(outline, "terminal", 0.1)
        assert "FlatMapGroupsInPandas" not in table._jdf.queryExecution().executedPlan().toString()
        got = {r.terminal: r for r in table.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    for t, r in got.items():
        shape = geometry.canonical([[[(x * 0.1, y * 0.1) for x, y in box(t * 3, t % 50, t * 4 + 1, t % 50 + 2)]]])
        assert geometry.from_wkb(r.geometry) == shape and r.area_km2 == geometry.geodesic_area(shape)
