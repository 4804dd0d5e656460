"""From basin outlines to geometries: one Arrow function at the end of the relational work, for all basins of a batch together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import geometry


def assemble(outline: DataFrame, key: str, degrees: float, fill: bool = True) -> DataFrame:
    """key, geometry (WKB of the multipolygon in canonical form), area_km2 (geodesic), polygons, and the bounds outward in 32
    bits. outline has the directed edges that are left of each basin; a basin's outline is one row's geometry and must
    fit in a task."""

    def shape(edges: np.ndarray) -> list[geometry.Polygon]:
        rings = geometry.rings_of_edges(edges)
        polygons = geometry.polygons_of_rings([r for r in rings if geometry.signed_area(r) > 0] if fill else rings)
        return geometry.canonical([[[(x * degrees, y * degrees) for x, y in r] for r in p] for p in polygons])

    def basins(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, edges = pdf[key].to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        shapes, out = [shape(e) for e in np.split(edges, starts[1:])], []
        for at, polygons, area in zip(starts, shapes, geometry.geodesic_areas(shapes), strict=True):
            xs, ys = zip(*[q for p in polygons for q in p[0]], strict=True)
            (minx, maxx), (miny, maxy) = geometry.outward(min(xs), max(xs)), geometry.outward(min(ys), max(ys))
            out.append((keys[at], geometry.to_wkb(polygons), area, len(polygons), minx, miny, maxx, maxy))
        return pd.DataFrame(out, columns=[key, "geometry", "area_km2", "polygons", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # the batches of the last key, which may go on in the next one
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            last = pdf[key].iloc[-1]
            if held[0][key].iloc[0] != last:
                rows = pd.concat(held)
                held = [rows[rows[key] == last]]
                yield basins(rows[rows[key] != last])
        if held:
            yield basins(pd.concat(held))

    kind = dict(outline.dtypes)[key]
    return outline.repartition(key).sortWithinPartitions(key).mapInPandas(run, f"{key} {kind}, geometry binary, area_km2 double, polygons int, bbox_minx float, bbox_miny float, bbox_maxx float, bbox_maxy float")
