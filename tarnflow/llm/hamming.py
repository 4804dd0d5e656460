"""Pairs of 64-bit fingerprints that differ in few bits, found through a table of their distances to reference fingerprints.

The bits are cut into groups, the groups into fields. The pivots are one reference fingerprint, the same with one field inverted
(one pivot a field), and SPREAD further ones. Each distinct fingerprint's Hamming distances to all pivots are computed once.

* Candidates: the distance to a pivot with an inverted field, less that to the reference, gives the differing bits inside the
  field. A differing bit changes one field's coordinate, so two fingerprints within the radius have equal coordinates in all but
  ``radius`` of the groups; each is dealt to one cell for every choice of that many groups.
* Discarding: inside a cell a pair goes if its coordinates differ by more than the radius at any of the spread pivots
  (the triangle inequality), and what survives is compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Pivots that discard pairs inside a cell; eight distances of a byte to a column.
SPREAD = 16
#: Groups to cut the bits into and the bits of a field, in order of the table's size: more fingerprints need finer cells.
SCHEMES = ((1 << 21, (6, 2)), (1 << 28, (7, 2)), (None, (9, 2)))
#: Members of cells with more fingerprints are dealt again to finer cells.
HOT, HOT_SCHEME = 1 << 15, (11, 1)
_RANDOM = np.random.default_rng(20_240_601)
REFERENCE = _RANDOM.integers(0, 2**64, 1, dtype=np.uint64)
SPREAD_PIVOTS = _RANDOM.integers(0, 2**64, SPREAD, dtype=np.uint64)


def fields(groups: int, bits: int) -> list[list[int]]:
    """The fields of every group, as bit masks."""
    edges = [64 * i // groups for i in range(groups + 1)]
    return [[sum(1 << b for b in range(a, min(a + bits, end))) for a in range(start, end, bits)] for start, end in zip(edges, edges[1:], strict=False)]


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The Hamming distance of every fingerprint to each pivot, one row per fingerprint."""
    table = np.empty((len(fps), len(pivots)), np.uint8)
    for j, pivot in enumerate(pivots):
        np.bitwise_count(fps ^ pivot, out=table[:, j])
    return table


def cells(fps: np.ndarray, radius: int, scheme: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of every fingerprint the keys of its cells, one to each choice of groups, and its distances to the spread pivots (two
    columns of eight bytes)."""
    groups = fields(*scheme)
    inverted = REFERENCE ^ np.array([m for g in groups for m in g], np.uint64)
    table = pivot_table(fps, np.r_[REFERENCE, inverted, SPREAD_PIVOTS])
    n = len(inverted)
    coordinates = table[:, 1 : 1 + n].astype(np.int64) - table[:, :1]
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    digest = np.zeros((len(fps), len(groups)), np.uint64)  # equal coordinates, equal digests; others may meet by chance
    for j, g in enumerate(owner.tolist()):
        digest[:, g] = digest[:, g] * np.uint64(131) + (coordinates[:, j] + 65).astype(np.uint64)
    choices = list(combinations(range(len(groups)), len(groups) - radius))
    keys = np.empty((len(fps), len(choices)), np.uint64)
    for k, choice in enumerate(choices):
        key = np.full(len(fps), k, np.uint64)
        for g in choice:
            key = (key ^ digest[:, g]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, k] = key
    return keys.view(np.int64), np.ascontiguousarray(table[:, 1 + n :]).view(np.int64)


def cell_links(fps: np.ndarray, table: np.ndarray, radius: int, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints of a cell with their table rows (distances to the spread pivots): as few as
    connect all that are linked (a forest). counts, if given, adds up pairs met, left by the pivots, and linked."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    group, left, right = np.arange(len(fps)), [], []
    for i in range(len(fps) - 1):
        js = np.arange(i + 1, ends[i])
        for p in range(1, table.shape[1]):
            if not len(js):
                break
            js = js[np.abs(table[js, p] - table[i, p]) <= radius]
        near = js[np.bitwise_count(fps[js] ^ fps[i]) <= radius]
        if counts is not None:
            counts[:] = [counts[0] + len(fps) - 1 - i, counts[1] + len(js), counts[2] + len(near)]
        near = near[group[near] != group[i]]
        if len(near):
            new, first = np.unique(group[near], return_index=True)
            left.append(np.full(len(first), i))
            right.append(near[first])
            group[np.isin(group, new)] = group[i]
    a = np.concatenate(left) if left else np.array([], int)
    b = np.concatenate(right) if right else np.array([], int)
    return order[a], order[b]


def _small_cells(fps: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of cells of few members, all at once: members `gap` places apart inside a cell are compared."""
    out_a, out_b = [], []
    size = ends - starts
    for gap in range(1, int(size.max(initial=1))):
        more = size > gap
        n = size[more] - gap
        a = np.repeat(starts[more] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        b = a + gap
        left = (np.abs(table[a].astype(np.int16) - table[b]) <= radius).all(axis=1)
        a, b = a[left], b[left]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        out_a.append(a[near])
        out_b.append(b[near])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.array([], int), np.array([], int))


#: Cells of at most so many members are compared side by side.
FEW = 8


def _cell_stream(radius: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        fps = fp.view(np.uint64)
        table = np.ascontiguousarray(pdf[["p0", "p1"]].to_numpy(np.int64)).view(np.uint8)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        few = ends - starts <= FEW
        a, b = _small_cells(fps, table, starts[few], ends[few], radius)
        out_a, out_b = [fp[a]], [fp[b]]
        for s, e in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
            a, b = cell_links(fps[s:e], table[s:e], radius)
            out_a.append(fp[s:e][a])
            out_b.append(fp[s:e][b])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            last = pdf["key"].iloc[-1]
            if held[0]["key"].iloc[0] != last:  # the last cell may go on in the next batch
                whole = pd.concat(held) if len(held) > 1 else pdf
                open_ = (whole["key"] == last).to_numpy()
                yield solve(whole[~open_])
                held = [whole[open_]]
        if held:
            yield solve(pd.concat(held))

    return run


def _dealt(fps: DataFrame, radius: int, scheme: tuple[int, int]) -> DataFrame:
    """key, fp, p0, p1: the distinct fingerprints in their cells, with their distances to the spread pivots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            keys, far = cells(fp.view(np.uint64), radius, scheme)
            n = keys.shape[1]
            yield pd.DataFrame({"key": keys.ravel(), "fp": np.repeat(fp, n), "p0": np.repeat(far[:, 0], n), "p1": np.repeat(far[:, 1], n)})

    return fps.select("fp").mapInPandas(run, "key long, fp long, p0 long, p1 long")


def _crowded(dealt: DataFrame, hot: int) -> DataFrame:
    return dealt.groupBy("key").count().where(F.col("count") > hot).select("key")


def _solved(dealt: DataFrame, radius: int) -> DataFrame:
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(_cell_stream(radius), "a long, b long")


def near_fingerprints(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Links (a, b) among the distinct, non-null fingerprints fps.fp: all within the radius are connected; a cell of many members
    gives fewer links than members. Members of cells above hot are dealt again to finer cells, where every pair meets too."""
    n = fps.count()
    scheme = next(s for most, s in SCHEMES if most is None or n <= most)
    dealt = _dealt(fps, radius, scheme)
    if n > hot and _crowded(_dealt(fps, scheme[0] - 1, scheme), hot).limit(1).count():
        # The coordinates of some group alone are crowded; else no choice of groups can be.
        crowded = stash(_crowded(dealt, hot))
        if crowded.limit(1).count():
            again = dealt.join(crowded, "key", "left_semi").select("fp").distinct()
            first = _solved(dealt.join(crowded, "key", "left_anti"), radius)
            return first.unionByName(_solved(_dealt(again, radius, HOT_SCHEME), radius)).distinct()
    return _solved(dealt, radius).distinct()
