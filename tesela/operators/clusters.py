"""Destinations into zones of bounded diameter, and measures of zones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.proximity import EARTH_M, great_circle_m
from tesela.operators.ranking import ordered
from tesela.runtime import cut, ready_workers, salted_lookup


def _km(lat: np.ndarray, lon: np.ndarray, la: float, lo: float) -> np.ndarray:
    a = np.sin(np.radians(lat - la) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(la)) * np.sin(np.radians(lon - lo) / 2) ** 2
    return 2 * EARTH_M / 1000 * np.arcsin(np.minimum(1, np.sqrt(a)))


def bounded_zones(destinos: DataFrame, diameter_km: float = 5.0, tile_deg: float = 1.0, cells: int = 50) -> DataFrame:
    """``destino_id, zona`` for destinations ``destino_id, lat, lon, peso``: greedy zones no wider than ``diameter_km``.

    Destinations are first added up to cells a ``cells``-th of the diameter wide, so that the sequential step has a bounded input however many there are.
    Heaviest first, a cell joins the zone with the nearest weighted centre among those it keeps within the diameter, its own width included, else
    opens one. The greedy order runs inside tiles of ``tile_deg`` degrees in parallel, so a zone doesn't cross a tile's
    border; zones are numbered by weight over all tiles. Rows without coordinates are left out; of repeated ids each row is placed.
    """
    side = diameter_km / cells / 111.32  # of a cell, in degrees
    reach = diameter_km - 2 * math.sqrt(2) * diameter_km / cells  # of centres, so that no two points of their cells are farther apart

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["peso", "cy", "cx"], ascending=[False, True, True])
        zones: list[dict] = []
        near: dict[tuple[int, int], set[int]] = {}
        out = []
        cell = diameter_km / 111.32
        for la, lo, w in zip(pdf.lat.tolist(), pdf.lon.tolist(), pdf.peso.tolist()):
            cy, cx = int(la // cell), int(lo * np.cos(np.radians(la)) // cell)
            best, best_km = None, None
            for k in sorted({k for y in (cy - 1, cy, cy + 1) for x in (cx - 1, cx, cx + 1) for k in near.get((y, x), ())}):
                z = zones[k]
                if _km(np.array(z["lat"]), np.array(z["lon"]), la, lo).max() <= reach:
                    km = float(_km(np.array([z["cla"]]), np.array([z["clo"]]), la, lo)[0])
                    if best is None or km < best_km:
                        best, best_km = k, km
            if best is None:
                best = len(zones)
                zones.append({"lat": [], "lon": [], "cla": la, "clo": lo, "w": 0.0, "cell": None})
            z = zones[best]
            z["lat"].append(la)
            z["lon"].append(lo)
            total = z["w"] + max(w, 1e-9)
            z["cla"], z["clo"], z["w"] = (z["cla"] * z["w"] + la * max(w, 1e-9)) / total, (z["clo"] * z["w"] + lo * max(w, 1e-9)) / total, total
            near.get(z["cell"], set()).discard(best)
            z["cell"] = (int(z["cla"] // cell), int(z["clo"] * np.cos(np.radians(z["cla"])) // cell))
            near.setdefault(z["cell"], set()).add(best)
            out.append(best)
        return pd.DataFrame({"tile": pdf.tile, "cy": pdf.cy, "cx": pdf.cx, "local": out, "peso": pdf.peso})

    ready_workers(destinos.sparkSession)
    rows = destinos.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    rows = rows.select("destino_id", "lat", "lon", F.coalesce("peso", F.lit(0)).cast("double").alias("peso"), F.concat_ws("_", F.floor(F.col("lat") / tile_deg), F.floor(F.col("lon") / tile_deg)).alias("tile"), F.floor(F.col("lat") / side).alias("cy"), F.floor(F.col("lon") / side).alias("cx"))
    place = ["tile", "cy", "cx"]
    summed = rows.groupBy(*place).agg(((F.min("lat") + F.max("lat")) / 2).alias("lat"), ((F.min("lon") + F.max("lon")) / 2).alias("lon"), F.sum("peso").alias("peso"))
    placed = cut(summed.groupBy("tile").applyInPandas(run, "tile string, cy bigint, cx bigint, local int, peso double"))
    weight = placed.groupBy("tile", "local").agg(F.sum("peso").alias("_w"))
    weight = ordered(weight, [F.desc("_w"), F.asc("tile"), F.asc("local")], "_n")
    named = placed.join(weight, ["tile", "local"]).select(*place, F.format_string("zona_%04d", "_n").alias("zona"))
    return salted_lookup(rows.select("destino_id", *place), named, place, "inner", spread=F.xxhash64("destino_id")).select("destino_id", "zona")


def _outline(lat: np.ndarray, lon: np.ndarray, la: float, lo: float) -> np.ndarray:
    """Places of the convex hull's vertices, seen from ``la, lo`` where every great circle is a straight line."""
    if len(lat) < 3:
        return np.arange(len(lat))
    f, f0, turn = np.radians(lat), np.radians(la), np.radians(lon - lo)
    # from half angles, so that points close to each other keep their digits
    north = np.sin(f - f0) + 2 * np.sin(f0) * np.cos(f) * np.sin(turn / 2) ** 2
    front = np.cos(f - f0) - 2 * np.cos(f0) * np.cos(f) * np.sin(turn / 2) ** 2
    x, y = np.cos(f) * np.sin(turn) / front, north / front
    order = np.lexsort((y, x)).tolist()
    xs, ys = x.tolist(), y.tolist()
    kept: set[int] = set()
    for walk in (order, order[::-1]):
        chain: list[int] = []
        for k in walk:
            while len(chain) > 1 and (xs[chain[-1]] - xs[chain[-2]]) * (ys[k] - ys[chain[-2]]) <= (ys[chain[-1]] - ys[chain[-2]]) * (xs[k] - xs[chain[-2]]):
                chain.pop()
            chain.append(k)
        kept.update(chain)
    return np.array(sorted(kept))


def _outlines(batches):
    """The outline points of each zone of a partition, from frames ``z, destino_id, lat, lon, la, lo``; only outlines stay in memory."""
    left = None
    for pdf in batches:
        whole = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        parts = [g.iloc[_outline(g.lat.to_numpy(), g.lon.to_numpy(), g.la.iat[0], g.lo.iat[0])] for _, g in whole.groupby("z", sort=False)]
        left = pd.concat(parts, ignore_index=True) if parts else None
    if left is not None:
        yield left


def zone_diameters(points: DataFrame, zone: str, exact_up_to: int = 250) -> DataFrame:
    """``zone, puntos, diametro_km``: the greatest distance in a zone, exact at every size.

    Of a zone with more than ``exact_up_to`` points only the vertices of its convex hull are compared, found per partition
    and again per zone: within a quarter of the globe's circumference the point farthest from another is such a vertex.
    A zone with a point more than an eighth of the circumference from its first compares all its points.
    """
    p = points.select(F.col(zone).alias("z"), "destino_id", "lat", "lon").dropna().dropDuplicates(["z", "destino_id"])
    sizes = p.groupBy("z").agg(F.count(F.lit(1)).alias("puntos"), F.min(F.struct("destino_id", "lat", "lon")).alias("_a"))
    small = p.join(sizes.where(F.col("puntos") <= exact_up_to).select("z"), "z", "left_semi")
    of_zone = lambda rows, zones: salted_lookup(rows, zones, ["z"], "inner", spread=F.xxhash64("destino_id"))
    large = of_zone(p, sizes.where(F.col("puntos") > exact_up_to).select("z", F.col("_a.lat").alias("la"), F.col("_a.lon").alias("lo")))
    reach = large.groupBy("z").agg(F.max(great_circle_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))).alias("_m"))
    near = F.col("_m") < EARTH_M * np.pi / 4
    wide = of_zone(large, reach.where(~near).select("z")).drop("la", "lo")
    ready_workers(points.sparkSession)
    held = of_zone(large, reach.where(near).select("z"))
    parts = held.mapInPandas(_outlines, held.schema)
    outline = parts.groupBy("z").applyInPandas(lambda g: g.iloc[_outline(g.lat.to_numpy(), g.lon.to_numpy(), g.la.iat[0], g.lo.iat[0])], held.schema).drop("la", "lo")
    few = small.unionByName(wide).unionByName(outline)
    pairs = few.join(few.select("z", F.col("destino_id").alias("id_b"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), "z").where("destino_id < id_b")
    km = great_circle_m(F.col("lat"), F.col("lon"), F.col("lb"), F.col("ob")) / 1000
    exact = pairs.groupBy("z").agg(F.max(km).alias("d"))
    return sizes.join(exact, "z", "left").select(F.col("z").alias(zone), "puntos", F.coalesce("d", F.lit(0.0)).alias("diametro_km"))


def zone_geometry(points: DataFrame, zone: str, weight: str) -> DataFrame:
    """Weighted centre and radius (greatest distance from it, km) of each zone."""
    w = F.col(weight).cast("double")
    centre = points.groupBy(zone).agg((F.sum(F.col("lat") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("centro_lat"), (F.sum(F.col("lon") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("centro_lon"))
    far = points.join(centre, zone).groupBy(zone).agg((F.max(great_circle_m(F.col("centro_lat"), F.col("centro_lon"), F.col("lat"), F.col("lon"))) / 1000).alias("radio_km"))
    return centre.join(far, zone)
