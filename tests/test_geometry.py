import numpy as np
import pytest

from tarnflow.functions import geometry as g


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


@pytest.mark.parametrize(("ring", "area"), [(box(0, -5, 5, 0), 307541.81354758184), (box(0, -3, 5, 0), 184671.66225785605)])
def test_geodesic_area(ring, area):
    assert g.geodesic_area([[ring]]) == pytest.approx(area, rel=1e-11)
    assert g.geodesic_area([[ring, box(1, -2, 2, -1)[::-1]]]) < area


def test_wkb_round_trip():
    shapes = [[box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]], [box(9, 9, 10, 10)]]
    assert g.from_wkb(g.to_wkb(shapes)) == [[[tuple(map(float, p)) for p in r] for r in s] for s in shapes]
    with pytest.raises(ValueError):
        g.from_wkb(b"\x01\x01\x00\x00\x00" + b"\x00" * 16)


def edges_of(cells):
    out = set()
    for x, y in cells:
        for a, b in zip(box(x, y, x + 1, y + 1), box(x, y, x + 1, y + 1)[1:], strict=False):
            out.symmetric_difference_update({(*a, *b)}) if (*b, *a) not in out else out.discard((*b, *a))
    return np.array(sorted(out))


def test_rings_with_a_hole_and_a_touching_corner():
    ring = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    shape = g.canonical(g.polygons_of_rings(g.rings_of_edges(edges_of(ring))))
    assert shape == [[[(float(x), float(y)) for x, y in box(0, 0, 3, 3)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]]]
    assert len(g.fill_holes(shape)[0]) == 1 and len(g.fill_holes(shape, 0.5)[0]) == 2
    two = g.polygons_of_rings(g.rings_of_edges(edges_of({(0, 0), (1, 1)})))
    assert sum(g.signed_area(r) for p in two for r in p) == 2 and all(g.signed_area(p[0]) > 0 for p in two)


def test_random_cells_keep_their_area():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cells = {tuple(map(int, c)) for c in rng.integers(0, 7, (25, 2))}
        shape = g.polygons_of_rings(g.rings_of_edges(edges_of(cells)))
        assert sum(g.signed_area(r) for p in shape for r in p) == len(cells)


def test_canonical_does_not_depend_on_start_or_direction():
    r = box(0, 0, 2, 1)[:-1]
    forms = {str(g.canonical([[[*(r[i:] + r[:i]), r[i]][::way]]])) for i in range(4) for way in (1, -1)}
    assert len(forms) == 1


def test_outward():
    low, high = g.outward(0.1, 0.3)
    assert low <= 0.1 and high >= 0.3 and high - low < 0.2001
