"""Points in regions of several parts with holes, by a quadtree covering.

A region's part is covered by cells of a quadtree over degrees. Cells that no edge of the part comes near are wholly inside, and are kept, or
wholly outside, and go; the others are split, ``DEPTH`` times. A point in an inner cell is in the region without
a ray being cast; in a cell at an edge a ray meets only the edges that its cell keeps, those whose range of latitudes meets the cell's and
that aren't all to the west of it. Parts are covered one by one, without a shuffle; the covering meets the points in one equi-join on cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.operators.match import settled

#: How often a part's first cells, which are as large as its box, are split.
DEPTH = 5
#: Bytes of a covering, about, that every task may hold; a larger one meets the points in a shuffle.
HELD_BYTES = 32 << 20
#: Degrees by which an edge may miss a cell and still count as near.
_SLACK = 1e-9


def _cells(edges: np.ndarray, depth: int) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """Level, place and edges of a part's cells; inner ones have none. ``edges``: rows of ax, ay, bx, by."""
    west, east = edges[:, [0, 2]].min(1), edges[:, [0, 2]].max(1)
    south, north = edges[:, [1, 3]].min(1), edges[:, [1, 3]].max(1)
    level = int(np.ceil(np.log2(max(east.max() - west.min(), north.max() - south.min(), 1e-6))))
    size = 2.0**level
    span = lambda lo, hi: range(int(np.floor(lo / size)), int(np.floor(hi / size)) + 1)
    every = np.arange(len(edges))
    live = [(x, y, every) for x in span(west.min(), east.max()) for y in span(south.min(), north.max())]
    for n in range(depth + 1):
        below = []
        for x, y, own in live:
            x0, y0 = x * size, y * size
            own = own[(east[own] >= x0 - _SLACK) & (south[own] <= y0 + size + _SLACK) & (north[own] >= y0 - _SLACK)]
            if (west[own] <= x0 + size + _SLACK).any():
                if n == depth:
                    yield level, x, y, edges[own]
                else:
                    below += [(2 * x + i, 2 * y + j, own) for i in (0, 1) for j in (0, 1)]
            else:
                mid, e = y0 + size / 2, edges[own]  # all edges that are left are to the east
                if ((e[:, 1] > mid) != (e[:, 3] > mid)).sum() % 2:
                    yield level, x, y, None
        live, level, size = below, level - 1, size / 2


def covering(regions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(seq, name, level, cx, cy, edges) of ``regions`` (seq, name, parts): a level's cells are 2^level degrees wide; inner cells have no edges."""
    point = "struct<x:double,y:double>"

    @F.pandas_udf(f"array<struct<level:int,cx:long,cy:long,edges:array<struct<a:{point},b:{point}>>>>")
    def cells(lines: pd.Series) -> pd.Series:
        out = []
        for own in lines:
            found = _cells(np.array([[e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]] for e in own]), depth) if len(own) else ()
            out.append([(level, x, y, None if e is None else [((ax, ay), (bx, by)) for ax, ay, bx, by in e.tolist()]) for level, x, y, e in found])
        return pd.Series(out, dtype=object)

    parts = regions.select("seq", "name", F.explode("parts").alias("rings")).select("seq", "name", N.edges(F.col("rings")).alias("e")).where("size(e) > 0")
    return parts.select("seq", "name", F.explode(cells.asNondeterministic()("e")).alias("c")).select("seq", "name", "c.*")


def regions_of(points: DataFrame, regions: DataFrame, depth: int = DEPTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, polygon) of the first region, in order of ``seq``, that holds the point in any of its parts. ``points``: (id, lat, lng); others than finite ones are nowhere."""
    cells = settled(covering(regions, depth))
    size = F.sum(64 + 40 * F.coalesce(F.size("edges"), F.lit(0)))
    seen = {r["level"]: r["bytes"] for r in cells.groupBy("level").agg(size.alias("bytes")).collect()}  # as many as the boxes' sizes double, and DEPTH more
    levels = sorted(seen)
    # Points must not be the broadcast side: by the bytes of their compressed file they seem few, and they have a row for each level here.
    cells = cells.hint("broadcast" if sum(seen.values()) <= held_bytes else "merge")
    own = points.select("id", "lat", "lng").where("abs(lat) <= 90 and abs(lng) < 1e9 and not isnan(lat) and not isnan(lng)")
    at = own.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), "level")).cast("bigint")
    met = at.withColumns({"cx": cell("lng"), "cy": cell("lat")}).join(cells, ["level", "cx", "cy"])
    inside = F.col("edges").isNull() | N.crossed(F.col("lng"), F.col("lat"), F.col("edges"))
    return met.where(inside).groupBy("id").agg(F.min_by("name", "seq").alias("polygon"))
