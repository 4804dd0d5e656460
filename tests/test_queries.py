"""Every registered query of the engine against its SQL in DuckDB, on the smoke tables."""

import os

import duckdb
import pytest

from tarnflow import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = sql.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    want = sorted(map(str, sql.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_basin_geometries_have_the_planar_area(spark, sf_dir):
    from tarnflow.functions import geometry

    area = {r.terminal: r.planar_area for r in registry.QUERIES["dissolve_planar_area"](spark, sf_dir).collect()}
    shapes = registry.QUERIES["basin_geometry"](spark, sf_dir).collect()
    assert {r.terminal for r in shapes} == set(area)
    for r in shapes:
        cells = sum(geometry.signed_area(ring) for p in geometry.from_wkb(r.geometry) for ring in p) * 100
        assert round(cells, 6) >= area[r.terminal] and r.area_km2 > 0
