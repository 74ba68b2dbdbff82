"""Points and areas: boxes and even-odd rings in the JVM, met through cells of areas; nearest places on the plane and on the sphere."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.retrieval import numbered
from postloom.session import checkpoint


def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), following.alias("b"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point is in the ring (array of struct x, y, closed or not) or on its edge."""
    return inside_rings(x, y, F.array(ring))


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether the point is in an odd number of the rings, so that holes and several parts count, or on an edge."""
    a, b = (lambda e: e["a"]), (lambda e: e["b"])
    crosses = lambda e: ((a(e)["y"] > y) != (b(e)["y"] > y)) & (x < (b(e)["x"] - a(e)["x"]) * (y - a(e)["y"]) / F.when(b(e)["y"] == a(e)["y"], F.lit(1.0)).otherwise(b(e)["y"] - a(e)["y"]) + a(e)["x"])
    cross = lambda e: (b(e)["x"] - a(e)["x"]) * (y - a(e)["y"]) - (b(e)["y"] - a(e)["y"]) * (x - a(e)["x"])
    on = lambda e: (cross(e) == 0) & x.between(F.least(a(e)["x"], b(e)["x"]), F.greatest(a(e)["x"], b(e)["x"])) & y.between(F.least(a(e)["y"], b(e)["y"]), F.greatest(a(e)["y"], b(e)["y"]))
    edges = F.flatten(F.transform(rings, _edges))
    return F.exists(edges, on) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def rings_of(wkt: Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON text, as arrays of struct x, y; further coordinates are left out, no text has none."""
    point = lambda p: F.struct(F.get(F.split(p, r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(p, r"\s+"), F.lit(1)).try_cast("double").alias("y"))
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), point))


#: Edges of a cell that isn't cut further, and the finest cells: 4**-FINEST times the width asked for.
EDGES, FINEST = 12, 5
#: Where in a cell the point of known side stands; no vertex of a map is likely there.
ASIDE = (0.5 + 0.01 * 2**0.5, 0.5 + 0.01 * 3**0.5)


def _crossed(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges (rows ax, ay, bx, by) meet a box, its border too."""
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    low, high = np.zeros(len(e)), np.ones(len(e))
    for d, a, lo, hi in ((dx, e[:, 0], x0, x1), (dy, e[:, 1], y0, y1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = (lo - a) / d, (hi - a) / d
        flat, inside = d == 0, (a >= lo) & (a <= hi)
        low = np.where(flat, np.where(inside, low, 2.0), np.maximum(low, np.minimum(s, t)))
        high = np.where(flat, high, np.minimum(high, np.maximum(s, t)))
    return low <= high + 1e-12


def _turns(e: np.ndarray, x: float, y: float, rx: float, ry: float) -> int:
    """Edges that the way from (x, y), level to rx and then upright to ry, crosses."""
    ax, ay, bx, by = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at_x, at_y = (bx - ax) * (y - ay) / (by - ay) + ax, (by - ay) * (rx - ax) / (bx - ax) + ay
    level = ((ay > y) != (by > y)) & (at_x > min(x, rx)) & (at_x <= max(x, rx))
    upright = ((ax > rx) != (bx > rx)) & (at_y > min(y, ry)) & (at_y <= max(y, ry))
    return int(level.sum() + upright.sum())


def cover(rings: list, cell: float, edges: int = EDGES) -> list[tuple]:
    """The cells of an area: (level, cx, cy, side of the known point, its x and y, edges of the cell).

    Cells are ``cell * 4**level`` wide; they are cut into 16 as long as more than ``edges`` edges meet them, down to ``FINEST`` levels. A cell
    that no edge meets is inside as a whole, and has no edges, or is left out. So there are about as many cells as the
    outline needs, however large the area is.
    """
    parts = [np.array([(p["x"], p["y"]) for p in ring], float) for ring in rings if ring]  # null coordinates become nan
    if not parts:
        return []
    all_edges = np.concatenate([np.column_stack([r, np.roll(r, -1, 0)]) for r in parts])
    all_edges = all_edges[~np.isnan(all_edges).any(1)]
    if not len(all_edges):
        return []
    x0, y0, x1, y1 = all_edges[:, ::2].min(), all_edges[:, 1::2].min(), all_edges[:, ::2].max(), all_edges[:, 1::2].max()
    level = int(np.ceil(np.log(max(x1 - x0, y1 - y0, cell) / cell) / np.log(4) - 1e-9))
    side = cell * 4.0**level
    stack, out = [], []
    for cx in range(int(np.floor(x0 / side)), int(np.floor(x1 / side)) + 1):
        for cy in range(int(np.floor(y0 / side)), int(np.floor(y1 / side)) + 1):
            rx, ry = (cx + ASIDE[0]) * side, (cy + ASIDE[1]) * side
            stack.append((level, cx, cy, _turns(all_edges, rx, ry, 2 * x1 - x0 + side, ry) % 2, all_edges))
    while stack:
        level, cx, cy, within, near = stack.pop()
        side = cell * 4.0**level
        own = near[_crossed(near, cx * side - 1e-9 * side, cy * side - 1e-9 * side, (cx + 1 + 1e-9) * side, (cy + 1 + 1e-9) * side)]
        rx, ry = (cx + ASIDE[0]) * side, (cy + ASIDE[1]) * side
        if not len(own):
            if within:
                out.append((level, cx, cy, True, rx, ry, []))
        elif len(own) <= edges or level <= -FINEST:
            out.append((level, cx, cy, bool(within), rx, ry, own.tolist()))
        else:
            small = side / 4
            for i in range(4):
                for j in range(4):
                    to = ((4 * cx + i + ASIDE[0]) * small, (4 * cy + j + ASIDE[1]) * small)
                    stack.append((level - 1, 4 * cx + i, 4 * cy + j, (within + _turns(own, *to, rx, ry)) % 2, own))
    return out


def covers(areas: DataFrame, cell: float) -> DataFrame:
    """A row for each cell of each area, with the area's columns but its rings."""
    rings = F.col("rings") if "rings" in areas.columns else F.array("ring")
    kept = [c for c in areas.columns if c not in ("ring", "rings")]
    kinds = dict(areas.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rings_at = batch.schema.get_field_index("_rings")
            for i, area in enumerate(batch.column(rings_at).to_pylist()):
                found = cover(area, cell) if area is not None else []
                if found:
                    own = [c.take(pa.array([i] * len(found))) for k, c in enumerate(batch.columns) if k != rings_at]
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.float64())))
                    cells = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *cells], names=[*kept, "_level", "_cx", "_cy", "_in", "_rx", "_ry", "_edges"])

    columns = "".join(f"`{c}` {kinds[c]}, " for c in kept) + "_level int, _cx long, _cy long, _in boolean, _rx double, _ry double, _edges array<array<double>>"
    return areas.select(*kept, rings.alias("_rings")).mapInArrow(run, columns)


def spatial_join(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) with the areas (area_id and ring, or rings where there are holes or several parts) that they are in or on.

    Areas are cut into cells once (``cover``): large ones where the outline is far, small ones along it. A point meets its cell of
    each level that occurs, by an equi-join. In a cell that no edge meets it is inside; in another one it is tested by the cell's own
    edges only, from a point whose side is known. The area's rings aren't in the result.
    """
    known = checkpoint(covers(areas, cell))
    levels = sorted(r["_level"] for r in known.select("_level").distinct().collect())  # a few
    x, y = F.col("x"), F.col("y")
    at = lambda v, side: F.floor(v / side).cast("long")
    places = [F.struct(F.lit(k).alias("_level"), at(x, cell * 4.0**k).alias("_cx"), at(y, cell * 4.0**k).alias("_cy")) for k in levels]
    none = F.array().cast("array<struct<_level:int,_cx:bigint,_cy:bigint>>")
    whole = x.isNotNull() & y.isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    placed = points.withColumn("_place", F.explode(F.when(whole, F.array(*places) if places else none))).select(*points.columns, "_place.*")
    rx, ry = F.col("_rx"), F.col("_ry")
    side = lambda e, i: e[i]

    def on(e: Column) -> Column:
        ax, ay, bx, by = (side(e, i) for i in range(4))
        return ((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = (side(e, i) for i in range(4))
        at_x = (bx - ax) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax
        at_y = (by - ay) * (rx - ax) / F.when(bx == ax, F.lit(1.0)).otherwise(bx - ax) + ay
        level = ((ay > y) != (by > y)) & (at_x > F.least(x, rx)) & (at_x <= F.greatest(x, rx))
        upright = ((ax > rx) != (bx > rx)) & (at_y > F.least(y, ry)) & (at_y <= F.greatest(y, ry))
        return level != upright  # both: twice, so the side is the same

    edges = F.col("_edges")
    within = F.when(F.size(edges) == 0, F.col("_in")).otherwise(F.exists(edges, on) | (F.col("_in") != (F.size(F.filter(edges, crosses)) % 2 == 1)))
    kept = [c for c in known.columns if not c.startswith("_")]
    return placed.join(known, ["_level", "_cx", "_cy"]).filter(within).select(*points.columns, *(known[c] for c in kept))


def haversine(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Kilometres on a sphere."""
    dlat, dlon = F.radians(other_lat - lat) / 2, F.radians(other_lon - lon) / 2
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * F.pow(F.sin(dlon), 2))))


#: Places of a block; blocks whose bounds one group holds; bounds that the driver holds, at most; points that one task compares with a block.
PLACES, GROUP, BOUNDS, POINTS = 1024, 256, 1 << 20, 50_000
#: What rounding may do to a distance of vectors with coordinates from -1 to 1; of others as much more as they are larger.
CHORD_SLACK = 1e-12


def _unit(lat, lon) -> np.ndarray:
    a, b = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def _kilometres(lat: float, lon: float, other_lat: float, other_lon: float) -> float:
    """``haversine`` in the C library's doubles, step by step as in SQL: places that are as far but for the last bits come in SQL's order."""
    dlat, dlon = math.radians(other_lat - lat) / 2, math.radians(other_lon - lon) / 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.pow(math.sin(dlat), 2) + math.cos(math.radians(lat)) * math.cos(math.radians(other_lat)) * math.pow(math.sin(dlon), 2))))


def _nearest_of(lat: np.ndarray, lon: np.ndarray, place: np.ndarray, plat: np.ndarray, plon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kilometres to the nearest of the places, and its place: the chord leaves those that rounding could put first, kilometres and place decide."""
    unit, other = _unit(lat, lon), _unit(plat, plon)
    best, at = np.full(len(unit), np.inf), np.zeros(len(unit), np.int64)
    for k in range(0, len(unit), 1024):
        chord = np.sqrt(((unit[k : k + 1024, None] - other) ** 2).sum(2))
        i, c = np.nonzero(chord <= chord.min(1)[:, None] + CHORD_SLACK)
        i += k
        km = np.fromiter(map(_kilometres, lat[i].tolist(), lon[i].tolist(), plat[c].tolist(), plon[c].tolist()), float, len(i))
        order = np.lexsort((place[c], km, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        best[i[first]], at[i[first]] = km[first], c[first]
    return best, place[at]


def _morton(unit: np.ndarray) -> np.ndarray:
    """A number for each vector with coordinates from -1 to 1 that is close for close ones: 20 bits of each coordinate, by turns."""
    code = np.zeros(len(unit), np.int64)
    cells = np.clip((unit + 1) / 2 * (1 << 20), 0, (1 << 20) - 1).astype(np.int64)
    for bit in range(20):
        for axis in range(unit.shape[1]):
            code |= (cells[:, axis] >> bit & 1) << (unit.shape[1] * bit + axis)
    return code


def _candidates(unit: np.ndarray, centre: np.ndarray, radius: np.ndarray, size: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a point and a block that may hold its nearest place.

    The nearest place is no farther than the farthest of any block could be; blocks whose nearest could be no nearer are left
    out. Blocks are neighbours in order, so they are first judged in groups.
    """
    slack = CHORD_SLACK * np.maximum(1.0, np.abs(unit).max(1, initial=0.0))
    n = -(-len(centre) // size)
    heads = np.arange(n) * size
    middle = np.add.reduceat(centre, heads) / np.diff(np.append(heads, len(centre)))[:, None]
    reach = np.maximum.reduceat(np.linalg.norm(centre - np.repeat(middle, np.diff(np.append(heads, len(centre))), axis=0), axis=1) + radius, heads)
    far = np.linalg.norm(unit[:, None] - middle, axis=2)
    most = (far + reach).min(1)
    rows, groups = np.nonzero(far - reach <= (most + slack)[:, None])
    points, blocks = [], []
    for g in np.unique(groups):
        own, at = rows[groups == g], slice(g * size, (g + 1) * size)
        gap = np.linalg.norm(unit[own][:, None] - centre[at], axis=2)
        np.minimum.at(most, own, (gap + radius[at]).min(1))
        i, b = np.nonzero(gap - radius[at] <= (most + slack)[own][:, None])
        points.append(own[i])
        blocks.append(b + g * size)
    if not points:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, b = np.concatenate(points), np.concatenate(blocks)
    keep = np.linalg.norm(unit[i] - centre[b], axis=1) - radius[b] <= (most + slack)[i]  # by what all groups showed
    return i[keep], b[keep]


def _planar(x: np.ndarray, y: np.ndarray, place: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared distance to the nearest of the places, and its place, the least of several."""
    order = np.argsort(place, kind="stable")
    px, py, best, at = px[order], py[order], np.empty(len(x)), np.empty(len(x), np.int64)
    for k in range(0, len(x), 1024):
        square = (x[k : k + 1024, None] - px) ** 2 + (y[k : k + 1024, None] - py) ** 2
        at[k : k + 1024] = square.argmin(1)
        best[k : k + 1024] = square.min(1)
    return best, place[order][at]


def _by_blocks(points: DataFrame, places: DataFrame, vectors: Callable, decide: Callable, block: int) -> DataFrame:
    """Each point (point_id, a, b) with the place (place_id, a, b; one of each spot) that ``decide`` finds nearest, and its ``distance``.

    ``vectors`` gives places of coordinates from -1 to 1. In an order that keeps neighbours together places are cut into blocks of
    ``block``, however dense: a city is many small blocks. The blocks' balls (larger blocks where there are many, so that there are
    BOUNDS at most) say which blocks a point has to meet, mostly one or two; a block that many points meet is dealt to several tasks.
    """
    spark = points.sparkSession
    kinds = dict(places.dtypes) | dict(points.select("point_id").dtypes)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(code=_morton(vectors(frame["a"], frame["b"])))

    order = places.select("place_id", "a", "b").mapInPandas(coded, f"place_id {kinds['place_id']}, a double, b double, code long")
    ranked = checkpoint(numbered(order, [F.col("code"), F.col("place_id")]))
    block = max(block, -(-ranked.count() // BOUNDS))

    def ball(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = vectors(frame["a"], frame["b"])
        centre = (own.max(0) + own.min(0)) / 2
        return pd.DataFrame({"block": [key[0]], "centre": [centre.tolist()], "radius": [np.linalg.norm(own - centre, axis=1).max()]})

    blocks = ranked.withColumn("block", F.floor((F.col("rank") - 1) / block)).select("block", "place_id", "a", "b")
    bounds = blocks.groupBy("block").applyInPandas(ball, "block long, centre array<double>, radius double").orderBy("block").toPandas()  # BOUNDS rows at most
    empty = f"point_id {kinds['point_id']}, place_id {kinds['place_id']}, distance double"
    if not len(bounds):
        return spark.createDataFrame([], empty)
    sent = spark.sparkContext.broadcast((np.stack(bounds["centre"].to_numpy()), bounds["radius"].to_numpy()))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, radius = sent.value
        for frame in frames:
            for lo in range(0, len(frame), 2048):
                some = frame.iloc[lo : lo + 2048].reset_index(drop=True)
                i, b = _candidates(vectors(some["a"], some["b"]), centre, radius)
                yield some.iloc[i].assign(block=b)

    met = checkpoint(points.select("point_id", "a", "b").mapInPandas(meet, f"point_id {kinds['point_id']}, a double, b double, block long"))
    pieces = met.groupBy("block").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("pieces"))
    dealt = met.join(pieces, "block").withColumn("piece", F.floor(F.rand(5) * F.col("pieces")).cast("int")).drop("pieces")
    copies = blocks.join(pieces, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def compare(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own, place = own if len(near) else own.iloc[:0], near["place_id"].to_numpy()
        spots = [f[c].to_numpy(float) for f in (own, near) for c in ("a", "b")]
        distance, place = decide(*spots[:2], place, *spots[2:]) if len(own) else (np.zeros(0), place[:0])
        return pd.DataFrame({"point_id": own["point_id"].to_numpy(), "place_id": place, "distance": distance})

    pairs = dealt.groupBy("block", "piece").cogroup(copies.groupBy("block", "piece")).applyInPandas(compare, empty)
    best = F.min(F.struct("distance", "place_id")).alias("b")
    return pairs.groupBy("point_id").agg(best).select("point_id", F.col("b.place_id").alias("place_id"), F.col("b.distance").alias("distance"))


def nearest(points: DataFrame, places: DataFrame, cell: float | None = None, block: int = PLACES) -> DataFrame:
    """Each point (point_id, x, y) with the nearest place (place_id, px, py) and the distance; ties go to the least place_id.

    Places are met in blocks of neighbours, however dense, as in ``nearest_on_sphere``; ``cell``, the width of a grid, is of no account any more.
    Points without finite coordinates have no row, and there are none without places; of rows that share a point_id the least
    distance counts.
    """
    good = lambda rows, key, *xy: rows.select(key, *(F.col(c).cast("double").alias(n) for c, n in zip(xy, "ab", strict=True))).filter((F.abs("a") < float("inf")) & (F.abs("b") < float("inf")))
    known = good(places, "place_id", "px", "py").groupBy("a", "b").agg(F.min("place_id").alias("place_id"))  # places of one spot are one
    box = known.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    x0, x1, y0, y1 = (v or 0.0 for v in box)
    half = max(x1 - x0, y1 - y0) / 2 or 1.0

    def scaled(x, y) -> np.ndarray:
        return np.column_stack([(np.asarray(x, float) - (x0 + x1) / 2) / half, (np.asarray(y, float) - (y0 + y1) / 2) / half])

    return _by_blocks(good(points, "point_id", "x", "y"), known, scaled, _planar, block).withColumn("distance", F.sqrt("distance"))


def nearest_on_sphere(points: DataFrame, places: DataFrame, block: int = PLACES) -> DataFrame:
    """Each point (point_id, lat, lon in degrees) with the nearest place (place_id, lat, lon), great-circle kilometres, ties to the least place_id.

    Places are unit vectors, so the date line and the poles are like any other part of the sphere; see ``_by_blocks``. Rows without
    coordinates, or off the map in latitude, take no part; of rows that share a point_id the least distance counts; without
    places there are no rows.
    """
    good = lambda rows, key: rows.select(key, F.col("lat").cast("double").alias("a"), F.col("lon").cast("double").alias("b")).filter(F.col("a").between(-90, 90) & (F.abs("b") < float("inf")))
    known = good(places, "place_id").groupBy("a", "b").agg(F.min("place_id").alias("place_id"))  # places of one spot are one
    return _by_blocks(good(points, "point_id"), known, _unit, _nearest_of, block)
