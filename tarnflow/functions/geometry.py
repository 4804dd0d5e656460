"""Polygons as lists of rings of (x, y): assembly, area, order, binary form. Small numpy helpers for grouped Arrow functions."""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np

Ring = list[tuple[float, float]]
Polygon = list[Ring]

# The WGS84 ellipsoid in kilometres.
AXIS, FLATTENING = 6378.137, 1 / 298.257223563


def signed_area(ring: Ring) -> float:
    p = np.asarray(ring, float)
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def rings_of_edges(edges: np.ndarray) -> list[Ring]:
    """Closed rings of directed edges (x1, y1, x2, y2). Where two rings touch in a point, the walk turns as far right as it
    can, which keeps the rings simple; points in the middle of a straight side are left out."""
    leaving: dict[tuple, list[tuple]] = defaultdict(list)
    for x1, y1, x2, y2 in edges[np.lexsort(edges.T[::-1])].tolist():
        leaving[x1, y1].append((x2, y2))
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            ring, here = [start], leaving[start].pop(0)
            while here != start:
                back, ways = ring[-1], leaving[here]
                if len(ways) > 1:
                    dx, dy = here[0] - back[0], here[1] - back[1]
                    ways.sort(key=lambda w: np.arctan2(dx * (w[1] - here[1]) - dy * (w[0] - here[0]), dx * (w[0] - here[0]) + dy * (w[1] - here[1])))
                ring.append(here)
                here = ways.pop(0)
            rings.append(_straightened(ring))
    return rings


def _straightened(ring: Ring) -> Ring:
    n = len(ring)
    turn = [(ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0]) for i in range(n)]
    kept = [p for p, t in zip(ring, turn, strict=True) if t]
    return [*kept, kept[0]]


def contains(ring: Ring, point: tuple[float, float]) -> bool:
    """Even-odd test; points on the ring may fall on either side."""
    p = np.asarray(ring, float)
    (x1, y1), (x2, y2), (x, y) = p[:-1].T, p[1:].T, point
    cross = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum() % 2)


def on_ring(ring: Ring, point: tuple[float, float]) -> bool:
    p = np.asarray(ring, float)
    a, b, q = p[:-1], p[1:], np.asarray(point, float)
    flat = (b[:, 0] - a[:, 0]) * (q[1] - a[:, 1]) == (b[:, 1] - a[:, 1]) * (q[0] - a[:, 0])
    return bool((flat & (np.minimum(a, b) <= q).all(1) & (q <= np.maximum(a, b)).all(1)).any())


def polygons_of_rings(rings: list[Ring]) -> list[Polygon]:
    """Counter-clockwise rings are exteriors; each other ring is a hole of the smallest exterior around it."""
    outer = sorted(([r] for r in rings if signed_area(r) > 0), key=lambda p: signed_area(p[0]))
    for hole in (r for r in rings if signed_area(r) < 0):
        inside = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        home = next((p for p in outer if signed_area(p[0]) > -signed_area(hole) and (contains(p[0], inside) or on_ring(p[0], inside))), None)
        if home is not None:
            home.append(hole)
    return outer


def fill_holes(polygons: list[Polygon], below: float | None = None) -> list[Polygon]:
    """Without holes, or without those of a planar area under below."""
    return [[p[0], *[h for h in p[1:] if below is not None and abs(signed_area(h)) >= below]] for p in polygons]


def largest(polygons: list[Polygon]) -> Polygon:
    return max(polygons, key=lambda p: sum(signed_area(r) for r in p))


def _authalic(s: np.ndarray, e2: float) -> np.ndarray:
    e = np.sqrt(e2)
    return (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)


def geodesic_ring_areas(rings: list[Ring], points: int = 24, block: int = 1 << 15) -> list[float]:
    """Signed areas in km2 of rings of (lon, lat) degrees whose sides are geodesics of the ellipsoid: the authalic integral
    over longitude along each side, by Gauss-Legendre points on the auxiliary sphere. The sides of all rings are worked on
    together; each ring's steps and sums are its own, so that its area does not depend on the others."""
    if not rings:
        return []
    f, e2 = FLATTENING, FLATTENING * (2 - FLATTENING)
    p, of = np.radians(np.concatenate([np.asarray(r, float) for r in rings])), np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    lon, beta = p[:, 0], np.arctan((1 - f) * np.tan(p[:, 1]))
    b1, b2, span = beta[:-1], beta[1:], np.diff(lon)
    live = (of[:-1] == of[1:]) & (np.abs(span) > 1e-15)
    b1, b2, span, of = b1[live], b2[live], span[live], of[:-1][live]
    s1, c1, s2, c2, w, arc, at = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2), span.copy(), np.zeros(len(span)), np.arange(len(span))
    for _ in range(50):  # the longitude on the sphere, by Vincenty's series
        if not len(at):
            break
        t1, d1, t2, d2, v = s1[at], c1[at], s2[at], c2[at], w[at]
        east, north = d2 * np.sin(v), d1 * t2 - t1 * d2 * np.cos(v)
        sin_arc, cos_arc = np.hypot(east, north), t1 * t2 + d1 * d2 * np.cos(v)
        arc[at] = along = np.arctan2(sin_arc, cos_arc)
        sin_a = d1 * d2 * np.sin(v) / sin_arc
        cos2 = 1 - sin_a**2
        middle = np.where(cos2 > 1e-18, cos_arc - 2 * t1 * t2 / np.where(cos2 > 1e-18, cos2, 1), 0.0)
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        w[at] = new = span[at] + (1 - c) * f * sin_a * (along + c * sin_arc * (middle + c * cos_arc * (2 * middle**2 - 1)))
        worst = np.zeros(len(rings))
        np.maximum.at(worst, of[at], np.abs(new - v))
        at = at[~(worst < 1e-15)[of[at]]]
    azimuth = np.arctan2(c2 * np.sin(w), c1 * s2 - s1 * c2 * np.cos(w))
    sin_0 = np.sin(azimuth) * c1
    cos_0 = np.sqrt(np.maximum(0, 1 - sin_0**2))
    start = np.arctan2(s1, np.cos(azimuth) * c1)
    x, weight = np.polynomial.legendre.leggauss(points)
    sides = np.zeros(len(span))
    for i in range(0, len(span), block):
        k = slice(i, i + block)
        sigma = start[k, None] + arc[k, None] * (x + 1) / 2
        sin_b = cos_0[k, None] * np.sin(sigma)
        cos2_b = 1 - sin_b**2
        sin_lat = sin_b / np.sqrt(sin_b**2 + (1 - f) ** 2 * cos2_b)
        rate = sin_0[k, None] * np.sqrt(1 - e2 * cos2_b) / cos2_b
        sides[k] = (_authalic(sin_lat, e2) * rate * weight).sum(1) * arc[k] / 2
    ends = np.searchsorted(of, np.arange(len(rings) + 1))
    return [-float((AXIS**2 / 2) * sides[i:j].sum()) if j > i else 0.0 for i, j in zip(ends, ends[1:], strict=False)]


def geodesic_areas(shapes: list[list[Polygon]]) -> list[float]:
    """Unsigned areas in km2 of lists of polygons, holes taken off."""
    area = iter(geodesic_ring_areas([r for polygons in shapes for p in polygons for r in p]))
    return [sum(abs(next(area)) - sum(abs(next(area)) for _ in p[1:]) for p in polygons) for polygons in shapes]


def geodesic_ring_area(ring: Ring, points: int = 24) -> float:
    """The signed area in km2 of one ring."""
    return geodesic_ring_areas([ring], points)[0]


def geodesic_area(polygons: list[Polygon]) -> float:
    """Unsigned area in km2, holes taken off."""
    return geodesic_areas([polygons])[0]


def to_wkb(polygons: list[Polygon]) -> bytes:
    """A multipolygon in little-endian well-known binary."""
    parts = [struct.pack("<BII", 1, 6, len(polygons))]
    for p in polygons:
        parts.append(struct.pack("<BII", 1, 3, len(p)))
        for r in p:
            parts += [struct.pack("<I", len(r)), np.asarray(r, "<f8").tobytes()]
    return b"".join(parts)


def from_wkb(data: bytes) -> list[Polygon]:
    """Polygons of well-known binary of a polygon or multipolygon, of either byte order."""

    def number(at: int) -> tuple[int, str, int]:
        order = "<" if data[at] == 1 else ">"
        return struct.unpack_from(order + "I", data, at + 1)[0], order, at + 5

    def polygon(at: int) -> tuple[Polygon, int]:
        kind, order, at = number(at)
        if kind != 3:
            raise ValueError(f"geometry type {kind} is no polygon")
        n, at, rings = struct.unpack_from(order + "I", data, at)[0], at + 4, []
        for _ in range(n):
            m = struct.unpack_from(order + "I", data, at)[0]
            rings.append([tuple(p) for p in np.frombuffer(data, order + "f8", 2 * m, at + 4).reshape(m, 2).tolist()])
            at += 4 + 16 * m
        return rings, at

    kind, order, at = number(0)
    if kind == 3:
        return [polygon(0)[0]]
    if kind != 6:
        raise ValueError(f"geometry type {kind} is no polygon")
    out, n, at = [], struct.unpack_from(order + "I", data, at)[0], at + 4
    for _ in range(n):
        p, at = polygon(at)
        out.append(p)
    return out


def canonical(polygons: list[Polygon], digits: int = 6) -> list[Polygon]:
    """The same polygons in one order and form: rounded, exteriors counter-clockwise and holes clockwise, each ring from
    where its sequence of points is least, holes and polygons sorted."""

    def ring(r: Ring, hole: bool) -> Ring:
        pts = [(round(x, digits) + 0.0, round(y, digits) + 0.0) for x, y in r]
        pts = pts[:-1] if pts[0] == pts[-1] else pts
        if (signed_area([*pts, pts[0]]) < 0) != hole:
            pts = pts[::-1]
        least = min(pts)
        best = min(pts[i:] + pts[:i] for i, p in enumerate(pts) if p == least)
        return [*best, best[0]]

    return sorted([ring(p[0], False), *sorted(ring(h, True) for h in p[1:])] for p in polygons)


def outward(low: float, high: float) -> tuple[float, float]:
    """Bounds cut to 32 bits without losing anything between them."""
    a, b = np.float32(low), np.float32(high)
    a = np.nextafter(a, np.float32(-np.inf)) if float(a) > low else a
    b = np.nextafter(b, np.float32(np.inf)) if float(b) < high else b
    return float(a), float(b)
