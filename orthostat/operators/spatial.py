"""Points near other points and points inside regions.

Both operators cut the latitudes into strips, range-partition the strips over the cluster,
sort each partition by longitude and sweep it once with an active set, so that no group is
ever held as a whole. Dense strips are cut again by measured longitude quantiles. A pair has
one owner: it is reported where the point of the lower strip (in one strip: the western
point) is at home; all other places hold only copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import EARTH_RADIUS_KM, valid_coordinates
from ..session import cut

#: Rows of one strip from which it is cut by longitude, and the quantiles measured for that.
CELL_ROWS, CELL_QUANTILES = 50_000, 256
#: Candidate pairs that a sweep holds at once.
_BLOCK = 1_000_000


def locations(points: DataFrame, key: str = "key", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct places: (rep, lat, lon, n), the smallest key standing for all points at one place.

    Points without key or with unusable coordinates are left out.
    """
    return (
        points.select(F.col(key).cast("string").alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        .where(F.col("key").isNotNull() & valid_coordinates(F.col("lat"), F.col("lon"), zero_is_valid=True))
        .groupBy("lat", "lon")
        .agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    )


def _dense_bounds(rows: DataFrame, cell_rows: int) -> DataFrame:
    """(strip, bounds): longitudes that cut strips of more than ``cell_rows`` rows.

    It has at most rows / ``cell_rows`` rows, each of at most CELL_QUANTILES numbers.
    """
    shares = [i / CELL_QUANTILES for i in range(1, CELL_QUANTILES)]
    every = F.greatest(F.lit(1), F.floor(CELL_QUANTILES * F.lit(float(cell_rows)) / F.col("n"))).cast("int")
    return (
        rows.groupBy("strip")
        .agg(F.count("*").alias("n"), F.percentile_approx("x", shares, 2000).alias("q"))
        .where(F.col("n") > cell_rows)
        .select("strip", F.array_distinct(F.filter("q", lambda v, i: (i + 1) % every == 0)).alias("bounds"))
    )


def _with_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.join(bounds, "strip", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<double>")))


def _segment(bounds: Column, x: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= x))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned by cell, then sorted by longitude within it."""
    return rows.repartitionByRange("strip", "seg").sortWithinPartitions("strip", "seg", *order)


def _reach(strip: Column, height: float, radius_km: float) -> Column:
    """Bound on the difference of longitude, in degrees, of near points in a strip or the next."""
    top = F.greatest(F.abs(strip * height), F.abs((strip + 2) * height))
    ratio = math.sin(radius_km / (2 * EARTH_RADIUS_KM)) / F.cos(F.radians(F.least(top, F.lit(90.0))))
    degrees = F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-9
    return F.when((top >= 90) | (ratio >= 0.7), F.lit(360.0)).otherwise(degrees)


def near_locations(places: DataFrame, radius_km: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rep_a, rep_b, distance_km) for each two places at most ``radius_km`` apart, once, rep_a < rep_b.

    ``places`` has distinct (lat, lon) and a unique ``rep``, as :func:`locations` gives them.
    Antimeridian and poles are handled. An empty table gives an empty result.
    """
    if not 0 < radius_km < 5000:
        raise ValueError("radius_km must lie between 0 and 5000")
    reach_lat = math.degrees(radius_km / EARTH_RADIUS_KM) * (1 + 1e-9) + 1e-9
    height = 4 * reach_lat
    home = places.select("rep", "lat", F.col("lon").alias("x"), F.floor(F.col("lat") / height).cast("int").alias("strip"))
    bounds = _dense_bounds(home, cell_rows)
    reach = _reach(F.col("strip"), height, radius_km)
    home = home.withColumn("reach", reach)
    below = _reach(F.col("strip") - 1, height, radius_km)

    def image(strip: Column, x: Column, reach: Column, kind: int) -> Column:
        return F.struct(strip.alias("strip"), x.alias("x"), reach.alias("reach"), F.lit(kind).alias("kind"))

    strip, x, r = F.col("strip"), F.col("x"), F.col("reach")
    low = (F.col("lat") - strip * height) <= reach_lat
    images = F.array(
        image(strip, x, r, 0),
        F.when((r < 180) & (x > 180 - r), image(strip, x - 360, r, 1)),
        F.when(low, image(strip - 1, x, below, 2)),
        F.when(low & (below < 180) & (x > 180 - below), image(strip - 1, x - 360, below, 2)),
        F.when(low & (below < 180) & (x < below - 180), image(strip - 1, x + 360, below, 2)),
    )
    rows = home.select("rep", "lat", F.explode(F.filter(images, lambda i: i.isNotNull())).alias("i")).select("rep", "lat", "i.*")
    rows = _with_bounds(rows, bounds)
    first, at = _segment(F.col("bounds"), x - r), _segment(F.col("bounds"), x)
    last = F.when(F.col("kind") == 2, _segment(F.col("bounds"), x + r)).otherwise(at)
    rows = rows.withColumn("at", at).withColumn("seg", F.explode(F.sequence(first, last)))
    rows = rows.select("strip", "seg", "x", "lat", "reach", "rep", ((F.col("kind") == 0) & (F.col("seg") == F.col("at"))).alias("own"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, active = None, None
        for batch in batches:
            for now, new in batch.groupby(["strip", "seg"], sort=False):
                rows = pd.concat([active, new], ignore_index=True) if now == cell else new
                start = len(rows) - len(new)
                xs, width = rows["x"].to_numpy(), float(new["reach"].iloc[0])
                yield from _near_pairs(rows, xs, start, np.searchsorted(xs, xs[start:] - width), radius_km, reach_lat)
                cell, active = now, rows[xs >= xs[-1] - width]

    return _ranged(rows, "x", "rep").mapInPandas(sweep, "rep_a string, rep_b string, distance_km double")


def near_points(points: DataFrame, radius_km: float, key: str = "key", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(a, b, distance_km), a < b, of all points (unique key) at most ``radius_km`` apart, those at one place too."""
    places = cut(locations(points, key, lat, lon), "places")
    at = points.select(F.col(key).cast("string").alias("key"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("key is not null").join(places, ["lat", "lon"]).select("key", "rep")
    x, y = at.select(F.col("key").alias("x"), F.col("rep").alias("rep_a")), at.select(F.col("key").alias("y"), F.col("rep").alias("rep_b"))
    # written first: the planner would take the sweep's result for as small as its input and broadcast it
    apart = cut(near_locations(places, radius_km), "near").join(x, "rep_a").join(y, "rep_b").select("x", "y", "distance_km")
    together = x.join(y, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y", F.lit(0.0).alias("distance_km"))
    return apart.unionByName(together).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance_km")


def _near_pairs(rows: pd.DataFrame, xs: np.ndarray, start: int, left: np.ndarray, radius_km: float, reach_lat: float) -> Iterator[pd.DataFrame]:
    """Pairs of each row from ``start`` on with the rows that are active when it comes."""
    lat, own, rep = rows["lat"].to_numpy(), rows["own"].to_numpy(), rows["rep"].to_numpy()
    i_all = np.arange(start, len(rows))
    ends = np.cumsum(i_all - left)
    begin = 0
    while begin < len(i_all):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
        i, from_ = i_all[begin:stop], left[begin:stop]
        count = i - from_
        a = np.repeat(i, count)
        b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(from_, count)
        keep = (np.abs(lat[a] - lat[b]) <= reach_lat) & (own[a] | own[b])
        a, b = a[keep], b[keep]
        la, lb = np.radians(lat[a]), np.radians(lat[b])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(xs[b] - xs[a]) / 2) ** 2
        km = 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))
        near = (km <= radius_km) & (rep[a] != rep[b])
        a, b, km = rep[a[near]], rep[b[near]], km[near]
        if len(km):
            swap = a > b
            yield pd.DataFrame({"rep_a": np.where(swap, b, a), "rep_b": np.where(swap, a, b), "distance_km": km})
        begin = stop


def parse_polygons(wkt: str | None) -> list[list[np.ndarray]]:
    """Polygons of a WKT POLYGON or MULTIPOLYGON as lists of rings; anything else gives none.

    An SRID prefix, letter case, blanks and further dimensions don't matter.
    """
    text = (wkt or "").strip()
    text = text.split(";", 1)[1] if text[:5].upper() == "SRID=" and ";" in text else text
    if not re.match(r"\s*(multi)?polygon", text, re.I):
        return []
    polygons = []
    for part in re.split(r"\)\s*\)\s*,\s*\(\s*\(", text[text.find("(") :] if "(" in text else ""):
        rings = []
        for ring in re.split(r"\)\s*,\s*\(", part.strip("() \t\r\n")):
            try:
                corners = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
            except ValueError:
                continue
            if corners.ndim == 2 and corners.shape[1] == 2 and len(corners) >= 3:
                rings.append(corners)
        if rings:
            polygons.append(rings)
    return polygons


def region_edges(regions: DataFrame, region_key: str, wkt: str) -> DataFrame:
    """(region, part, x1, y1, x2, y2, x0): the edges of each polygon that aren't level, with its least longitude.

    ``part`` names one polygon of one shape; its rings, holes too, count alike. Null, empty and
    unreadable shapes have no edges.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["region", "part", "x1", "y1", "x2", "y2", "x0"]
        for batch in batches:
            found, size = [], 0
            for name, text, shape in zip(batch["region"], batch["wkt"], batch["shape"]):
                for k, rings in enumerate(parse_polygons(text)):
                    ends = np.concatenate([np.hstack([ring, np.roll(ring, -1, axis=0)]) for ring in rings])
                    ends = ends[ends[:, 1] != ends[:, 3]]
                    rows = pd.DataFrame(ends, columns=["x1", "y1", "x2", "y2"])
                    found.append(rows.assign(region=name, part=f"{shape}:{k}", x0=min(ring[:, 0].min() for ring in rings)))
                    size += len(rows)
                    if size > 100_000:
                        yield pd.concat(found)[columns]
                        found, size = [], 0
            if found:
                yield pd.concat(found)[columns]

    shapes = regions.select(F.col(region_key).cast("string").alias("region"), F.col(wkt).alias("wkt")).where(F.col("region").isNotNull() & F.col("wkt").isNotNull()).distinct()
    rows = shapes.withColumn("shape", F.md5(F.concat_ws("\u0001", "region", "wkt")))
    return rows.mapInPandas(parse, "region string, part string, x1 double, y1 double, x2 double, y2 double, x0 double")


class _Polygon:
    """The points of a cell that one polygon may contain, and on which side of its edges they have come to lie."""

    def __init__(self, part: str, region: str, x0: float, xs: np.ndarray, ys: np.ndarray):
        self.part, self.region = part, region
        at = np.arange(np.searchsorted(xs, x0), len(xs))
        self.at = at[np.argsort(ys[at], kind="stable")]
        self.xs, self.ys = xs[self.at], ys[self.at]
        self.odd = np.zeros(len(self.at), np.int64)

    def cross(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> None:
        """Count the edges to the right of each point at its height."""
        first, last = np.searchsorted(self.ys, np.minimum(y1, y2)), np.searchsorted(self.ys, np.maximum(y1, y2))
        count = last - first
        ends = np.cumsum(count)
        begin = 0
        while begin < len(count):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
            c = count[begin:stop]
            edge = np.repeat(np.arange(begin, stop), c)
            point = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[begin:stop], c)
            right = self.xs[point] < (x2[edge] - x1[edge]) * (self.ys[point] - y1[edge]) / (y2[edge] - y1[edge]) + x1[edge]
            self.odd += np.bincount(point[right], minlength=len(self.odd))
            begin = stop

    def inside(self, reps: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"rep": reps[self.at[self.odd % 2 == 1]], "region": self.region})


def points_in_regions(places: DataFrame, regions: DataFrame, region_key: str, wkt: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rep, region) for each place and each region that contains it, planar in degrees.

    ``places`` as of :func:`locations`. Null, empty and unreadable shapes contain nothing;
    several rows of one region count once. Strips are as high as the regions are on average. Not
    regions but their edges are copied, to the strips that an edge crosses and there to the cells
    from the polygon's western end to the edge; each cell holds its points, sorted by longitude,
    while the edges stream by, polygon by polygon. By the even-odd rule holes are outside.
    """
    edges = cut(region_edges(regions, region_key, wkt), "edges")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    height = max(edges.groupBy("part").agg((F.max(high) - F.min(low)).alias("h")).agg(F.avg("h")).first()[0] or 1.0, 1e-4)
    strip = lambda y: F.floor(y / height).cast("int")
    points = places.select(strip(F.col("lat")).alias("strip"), F.col("lon").alias("x"), F.col("lat").alias("y"), "rep")
    bounds = _dense_bounds(points, cell_rows)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    points = _with_bounds(points, bounds).select("strip", _segment(F.col("bounds"), F.col("x")).alias("seg"), F.lit(0).alias("kind"), text.alias("part"), "rep", "x", "y", none.alias("x2"), none.alias("y2"), none.alias("x0"))
    sides = edges.withColumn("strip", F.explode(F.sequence(strip(low), strip(high))))
    # strips without points need no edges
    sides = _with_bounds(sides.join(points.select("strip").distinct(), "strip", "left_semi"), bounds)
    sides = sides.withColumn("seg", F.explode(F.sequence(_segment(F.col("bounds"), F.col("x0")), _segment(F.col("bounds"), F.greatest("x1", "x2")))))
    sides = sides.select("strip", "seg", F.lit(1).alias("kind"), "part", F.col("region").alias("rep"), F.col("x1").alias("x"), F.col("y1").alias("y"), "x2", "y2", "x0")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, polygon = None, [], None
        xs = ys = reps = np.array([])
        for batch in batches:
            for now, rows in batch.groupby(["strip", "seg"], sort=False):
                if now != cell:
                    if polygon is not None:
                        yield polygon.inside(reps)
                    cell, held, polygon, xs = now, [], None, None
                new = rows[rows["kind"] == 0]
                if len(new):
                    held.append(new[["x", "y", "rep"]])
                sides = rows[rows["kind"] == 1]
                if not len(sides) or not held:
                    continue
                if xs is None:  # all points of the cell come before its edges
                    points = pd.concat(held)
                    xs, ys, reps = points["x"].to_numpy(), points["y"].to_numpy(), points["rep"].to_numpy(dtype=object)
                for part, own in sides.groupby("part", sort=False):
                    if polygon is None or polygon.part != part:
                        if polygon is not None:
                            yield polygon.inside(reps)
                        polygon = _Polygon(part, own["rep"].iloc[0], float(own["x0"].iloc[0]), xs, ys)
                    polygon.cross(*(own[c].to_numpy() for c in ("x", "y", "x2", "y2")))
        if polygon is not None:
            yield polygon.inside(reps)

    return _ranged(points.unionByName(sides), "kind", "part", "x").mapInPandas(sweep, "rep string, region string").distinct()


def point_of_wkt(wkt: Column) -> tuple[Column, Column]:
    """(lat, lon) of a WKT point in two or more dimensions, null where it states none."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*{number}\s+{number}(?:\s+[-+0-9.eE]+)*\s*\)\s*$"
    return F.regexp_extract(wkt, pattern, 2).try_cast("double"), F.regexp_extract(wkt, pattern, 1).try_cast("double")
