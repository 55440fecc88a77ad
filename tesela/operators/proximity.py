"""Points near other points, and the regions that contain points.

Regions are cut into triangles by ear clipping, on the executors, and packed by place into blocks of bounded size. Each
block is a bounding-volume hierarchy, and the points within its box pass through it in Arrow batches, without a
shuffle. Close pairs come from a grid join in which one side is repeated only into the cells that its search
circle touches, and crowded cells are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.operators.ranking import ordered
from tesela.runtime import cut, ready_workers, small

EARTH_M = 6_371_008.8
#: So many triangles make one hierarchy that is sent to the executors (about 20 MB); more are taken in blocks.
SHAPES_PER_BLOCK = 100_000
#: Points of a grid cell that are compared by one task with all points near the cell; a cell with more is split.
CROWDED = 20_000
_ERR = 4e-16


def _turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> int:
    """Sign of the turn a-b-c, exact: floating point where it is certain, rational numbers where not."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = left - right
    if abs(det) > 8 * _ERR * (abs(left) + abs(right)):
        return 1 if det > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def ear_clip(xs: list[float], ys: list[float]) -> list[tuple[float, ...]] | None:
    """Triangles ``(x1, y1, x2, y2, x3, y3)``, turning left, that cover a simple ring; closed or open, either direction. None for a ring that is not simple.

    Null or not finite vertices are left out, repeated and straight ones dropped; a ring without area gives none.
    """
    ring = clean_ring(xs, ys)
    if len(ring) < 3:
        return []
    area = sum(Fraction(ring[i - 1][0]) * Fraction(ring[i][1]) - Fraction(ring[i][0]) * Fraction(ring[i - 1][1]) for i in range(len(ring)))
    if area < 0:
        ring.reverse()
    n = left = len(ring)
    x, y, live = np.array([p[0] for p in ring]), np.array([p[1] for p in ring]), np.ones(n, bool)
    before, after = [*range(-1, n - 1)], [*range(1, n), 0]
    before[0] = n - 1

    def blocked(a: tuple, b: tuple, c: tuple) -> bool:
        """Whether another vertex lies in or on the triangle; only those in its box are looked at exactly."""
        low_x, high_x, low_y, high_y = min(a[0], b[0], c[0]), max(a[0], b[0], c[0]), min(a[1], b[1], c[1]), max(a[1], b[1], c[1])
        near = np.flatnonzero(live & (x >= low_x) & (x <= high_x) & (y >= low_y) & (y <= high_y)).tolist()
        others = (ring[k] for k in near if ring[k] not in (a, b, c))
        return any(_turn(*a, *b, *p) >= 0 and _turn(*b, *c, *p) >= 0 and _turn(*c, *a, *p) >= 0 for p in others)

    out: list[tuple[float, ...]] = []
    at, missed = 0, 0
    while left > 2:
        if missed > left:
            return None  # what is left has no ear
        a, b, c = ring[before[at]], ring[at], ring[after[at]]
        turn = _turn(*a, *b, *c)
        if turn < 0 or (turn > 0 and blocked(a, b, c)):
            at, missed = after[at], missed + 1
            continue
        if turn > 0:
            out.append((*a, *b, *c))
        live[at] = False
        after[before[at]], before[after[at]] = after[at], before[at]
        at, left, missed = after[at], left - 1, 0
    return out


def clean_ring(xs: list[float], ys: list[float]) -> list[tuple[float, float]]:
    """The finite vertices of a ring, none equal to the one before it."""
    points = [(float(x), float(y)) for x, y in zip(xs, ys) if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    return [p for i, p in enumerate(points) if p != points[i - 1]]


def shapes_of(regions: DataFrame, region_id: str, vert_lat: str, vert_lon: str) -> DataFrame:
    """``region_id, x0, y0, x1, y1, xs, ys``: the triangles of each region with their boxes, found where the regions are; a ring that is not simple is one shape, itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for region, lats, lons in zip(batch[region_id], batch[vert_lat], batch[vert_lon]):
                lats, lons = ([] if v is None else list(v) for v in (lats, lons))
                triangles = ear_clip(lons, lats)
                shapes = [(t[0::2], t[1::2]) for t in triangles] if triangles is not None else [tuple(zip(*clean_ring(lons, lats)))]
                out += [(region, min(xs), min(ys), max(xs), max(ys), [*xs], [*ys]) for xs, ys in shapes]
            yield pd.DataFrame(out, columns=[region_id, "x0", "y0", "x1", "y1", "xs", "ys"])

    ready_workers(regions.sparkSession)
    kind = regions.schema[region_id].dataType.simpleString()
    rows = regions.select(region_id, vert_lat, vert_lon).where(F.col(region_id).isNotNull())
    return rows.mapInPandas(run, f"`{region_id}` {kind}, x0 double, y0 double, x1 double, y1 double, xs array<double>, ys array<double>")


def turns(ax: float, ay: float, bx: float, by: float, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Signs of the turns a-b-p, exact."""
    left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    det = left - right
    out = np.sign(det).astype(int)
    for j in np.flatnonzero(np.abs(det) <= 8 * _ERR * (np.abs(left) + np.abs(right))):
        out[j] = _turn(ax, ay, bx, by, float(px[j]), float(py[j]))
    return out


class Hierarchy:
    """A bounding-volume hierarchy over shapes, triangles that turn left or whole rings; ``owner`` gives the region of each, ``boxes`` their boxes."""

    def __init__(self, shapes: list[tuple[list[float], list[float]]], boxes: np.ndarray, owner: np.ndarray, leaf: int = 8):
        self.boxes: list[tuple[float, ...]] = []
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        low, high = boxes[:, :2], boxes[:, 2:]
        order = np.arange(len(shapes))
        work = [(0, len(shapes), -1, 0)] if shapes else []
        while work:
            a, b, parent, side = work.pop()
            node = len(self.boxes)
            own = order[a:b]
            lo, hi = low[own].min(0), high[own].max(0)
            self.boxes.append((lo[0], lo[1], hi[0], hi[1]))
            self.children.append(None)
            self.spans.append((a, b))
            if parent >= 0:
                first = self.children[parent]
                self.children[parent] = (node, first[1]) if side == 0 else (first[0], node)
            if b - a > leaf:
                middle = (low[own] + high[own]) / 2
                axis = int(np.argmax(middle.max(0) - middle.min(0)))
                order[a:b] = own[np.argsort(middle[:, axis], kind="stable")]
                self.children[node] = (0, 0)
                work += [(a, (a + b) // 2, node, 0), ((a + b) // 2, b, node, 1)]
        self.shapes, self.owner = [shapes[k] for k in order], owner[order]

    def containing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(point, region)`` for every region, borders included, that contains a point; each once."""
        found: list[tuple[np.ndarray, int]] = []
        work = [(0, np.arange(len(x)))] if len(self.boxes) else []
        while work:
            node, at = work.pop()
            x0, y0, x1, y1 = self.boxes[node]
            at = at[(x[at] >= x0) & (x[at] <= x1) & (y[at] >= y0) & (y[at] <= y1)]
            if not len(at):
                continue
            if self.children[node]:
                work += [(child, at) for child in self.children[node]]
                continue
            for k in range(*self.spans[node]):
                inside = at[self._inside(k, x[at], y[at])]
                if len(inside):
                    found.append((inside, self.owner[k]))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        pairs = np.unique(np.stack([np.concatenate([f for f, _ in found]), np.concatenate([np.full(len(f), o) for f, o in found])], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _inside(self, k: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        xs, ys = self.shapes[k]
        edges = list(zip(xs, ys, [*xs[1:], xs[0]], [*ys[1:], ys[0]]))
        if len(xs) == 3:
            inside = np.ones(len(px), bool)
            for ax, ay, bx, by in edges:
                inside[inside] = turns(ax, ay, bx, by, px[inside], py[inside]) >= 0
            return inside
        # a ring that crosses itself: on its line, or an odd number of edges to the right
        odd, on = np.zeros(len(px), bool), np.zeros(len(px), bool)
        for ax, ay, bx, by in edges:
            side = turns(ax, ay, bx, by, px, py)
            on |= (side == 0) & (px >= min(ax, bx)) & (px <= max(ax, bx)) & (py >= min(ay, by)) & (py <= max(ay, by))
            odd ^= ((ay > py) != (by > py)) & (side == (1 if by > ay else -1))
        return odd | on


def containing_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, lat: str, lon: str, vert_lat: str, vert_lon: str) -> DataFrame:
    """``point_id, region_id`` for every region that contains a point, each pair once; borders belong to the region.

    Triangles are counted; up to SHAPES_PER_BLOCK of them are gathered as one hierarchy and sent to the executors, more are packed by
    place into blocks of that size, each of which only the points within its box pass. A ring that crosses
    itself contains what an odd number of its windings surround. Points or regions with null or not
    finite coordinates contain nothing and are in nothing; repeated points give one row.
    """
    spark = points.sparkSession
    shapes = cut(shapes_of(regions, region_id, vert_lat, vert_lon))
    box = shapes.agg(F.count(F.lit(1)).alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).first()
    blocks = max(1, math.ceil(box.n / SHAPES_PER_BLOCK))
    if blocks > 1:
        # strips of like height, along each from west to east
        strips = math.ceil(math.sqrt(blocks))
        strip = F.floor(((F.col("y0") + F.col("y1")) / 2 - box.y0) / ((box.y1 - box.y0) or 1.0) * strips)
        shapes = cut(ordered(shapes.withColumn("_strip", strip), [F.asc("_strip"), F.asc("x0"), F.asc("y0"), F.asc("x1"), F.asc("y1"), F.asc(region_id)], "_n"))
    schema = points.select(point_id).schema.add(region_id, regions.schema[region_id].dataType)
    located = points.select(point_id, lat, lon).where(F.col(point_id).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    out = None
    for block in range(blocks):
        part = shapes if blocks == 1 else shapes.where((F.col("_n") > block * SHAPES_PER_BLOCK) & (F.col("_n") <= (block + 1) * SHAPES_PER_BLOCK))
        rows = part.select(region_id, "x0", "y0", "x1", "y1", "xs", "ys").collect()
        names, owner = np.unique(np.array([r[0] for r in rows], object), return_inverse=True)
        boxes = np.array([r[1:5] for r in rows], float).reshape(-1, 4)
        tree = spark.sparkContext.broadcast((Hierarchy([(r.xs, r.ys) for r in rows], boxes, owner.reshape(-1)), names))
        inside = located
        if blocks > 1:
            (west, south), (east, north) = boxes[:, :2].min(0).tolist(), boxes[:, 2:].max(0).tolist()
            inside = located.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))

        def locate(batches: Iterator[pd.DataFrame], tree=tree) -> Iterator[pd.DataFrame]:
            hierarchy, names = tree.value
            for batch in batches:
                if not len(batch):
                    continue
                spots, which = np.unique(batch[[lat, lon]].to_numpy(float), axis=0, return_inverse=True)
                spot, region = hierarchy.containing(spots[:, 1], spots[:, 0])
                pairs = pd.DataFrame({"_spot": spot, region_id: names[region]})
                rows = pd.DataFrame({point_id: batch[point_id].to_numpy(), "_spot": which.reshape(-1)})
                yield rows.merge(pairs, on="_spot")[[point_id, region_id]].drop_duplicates()

        found = inside.mapInPandas(locate, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def close_pairs(points: DataFrame, point_id: str, group: str, lat: str, lon: str, metres: float, cell: float | None = None) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: different ids of the same ``group`` at most ``metres`` apart, each pair once.

    Points with a null id, group or coordinate are near nothing. Repeated points are reduced to one first. ``cell`` is the
    grid's width in degrees, twice the radius if not given; a point is repeated into each cell its circle touches (four on average), and pairs
    are joined on group and cell. A cell of more than CROWDED points is split: each part of it meets the points around it in
    a task of its own. Not for circles over a pole or the 180th meridian.
    """
    p = points.select(F.col(point_id).alias("id"), F.col(group).alias("g"), F.col(lat).alias("la"), F.col(lon).alias("lo")).dropna().distinct()
    dlat = math.degrees(metres / EARTH_M) * 1.000001
    cell = cell or max(2 * dlat, 1e-9)
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(metres / EARTH_M)) / F.cos(F.radians(F.least(F.lit(89.9), F.abs("la") + dlat)))))) * 1.000001
    at = lambda c: F.floor(c / cell)
    home = p.select("g", at(F.col("la")).alias("cy"), at(F.col("lo")).alias("cx"), F.col("id").alias("id_a"), F.col("la").alias("la_a"), F.col("lo").alias("lo_a"))
    reach = p.select("*", F.explode(F.sequence(at(F.col("la") - dlat), at(F.col("la") + dlat))).alias("cy"), dlon.alias("dlon")).select("*", F.explode(F.sequence(at(F.col("lo") - F.col("dlon")), at(F.col("lo") + F.col("dlon")))).alias("cx")).drop("dlon")
    place = ["g", "cy", "cx"]
    crowded = cut(home.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select(*place, F.ceil(F.col("_n") / CROWDED).alias("_parts")))
    if not crowded.isEmpty():
        many = small(crowded)  # at most one row per CROWDED points
        parts = F.coalesce("_parts", F.lit(1))
        home = home.join(many, place, "left").withColumn("_part", F.pmod(F.xxhash64("id_a"), parts)).drop("_parts")
        reach = reach.join(many, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
        place = [*place, "_part"]
    near = great_circle_m(F.col("la_a"), F.col("lo_a"), F.col("la"), F.col("lo")) <= metres
    return home.join(reach, place).where((F.col("id_a") < F.col("id")) & near).select("id_a", F.col("id").alias("id_b")).distinct()


def usable_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon", box: tuple[float, float, float, float] = (-30.0, -25.0, -57.0, -53.0)) -> DataFrame:
    """Replace ``lat`` and ``lon`` by the pair that lies in ``box`` (south, north, west, east), as it is or exchanged; rows without one are left out."""
    south, north, west, east = box
    direct = F.col(lat).between(south, north) & F.col(lon).between(west, east)
    swapped = F.col(lon).between(south, north) & F.col(lat).between(west, east)
    return df.where(direct | swapped).withColumns({lat: F.when(direct, F.col(lat)).otherwise(F.col(lon)), lon: F.when(direct, F.col(lon)).otherwise(F.col(lat))})


def claims_nearby(reclamos: DataFrame, distritos: DataFrame, metres: float = 100.0) -> DataFrame:
    """``tipo, id_a, id_b``: pairs of claims of one day close to each other, and the districts that contain claims."""
    claims = usable_coordinates(reclamos.select("reclamo_id", F.to_date("fecha_reclamo").alias("dia"), "lat", "lon"))
    pairs = close_pairs(claims, "reclamo_id", "dia", "lat", "lon", metres).select(F.lit("par").alias("tipo"), "id_a", "id_b")
    inside = containing_regions(claims, distritos, "reclamo_id", "distrito_id", "lat", "lon", "vert_lat", "vert_lon")
    return pairs.unionByName(inside.select(F.lit("distrito").alias("tipo"), F.col("reclamo_id").alias("id_a"), F.col("distrito_id").alias("id_b")))
