import math

import numpy as np
import pytest

from orthostat.operators import spatial
from orthostat.operators.proximity import near_or_inside, recorded_near_pairs, site_points


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))


def brute(points, radius):
    return {tuple(sorted((p[0], q[0]))) for i, p in enumerate(points) for q in points[i + 1 :] if km(p[1:], q[1:]) <= radius}


def clouds():
    rng = np.random.default_rng(1)
    near = lambda n, lat, lon, s: [(lat + s * rng.standard_normal(), lon + s * rng.standard_normal()) for _ in range(n)]
    return {
        "plain": near(300, 42, 12, 0.05), "dense and wide": near(150, 45, 9, 0.004) + near(100, 40, 15, 3),
        "antimeridian": [(a, (b + 180) % 360 - 180) for a, b in near(150, -17, 180, 0.02)], "pole": [(min(89.9999, 89.99 + 0.005 * abs(a)), 180 * math.sin(b)) for a, b in near(80, 0, 0, 1)],
        "one place": [(41.0, 10.0)] * 30 + near(30, 41, 10, 0.001), "edges": [(90.0, 0.0), (90.0, 50.0), (-90.0, 3.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0)],
    }


@pytest.mark.parametrize("name", list(clouds()))
@pytest.mark.parametrize("cell_rows", [20, 50_000])
def test_near_points_equal_brute_force(spark, name, cell_rows, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(spatial.near_locations, "__defaults__", (cell_rows,))
    monkeypatch.setattr(spatial, "_BLOCK", 50)
    points = [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(clouds()[name])]
    df = spark.createDataFrame([(*p, "x", 1) for p in points], "key string, lat double, lon double, rep string, strip int")
    got = [(r["a"], r["b"]) for r in spatial.near_points(df, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.8)


def test_unusable_points_are_left_out(spark):
    rows = [("a", None, 1.0), ("b", 91.0, 1.0), ("c", float("nan"), 1.0), (None, 1.0, 1.0), ("d", 1.0, 1.0), ("e", 1.0, 1.0001)]
    df = spark.createDataFrame(rows, "key string, lat double, lon double")
    assert [(r["a"], r["b"]) for r in spatial.near_points(df, 0.5).collect()] == [("d", "e")]
    assert spatial.near_points(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        spatial.near_points(df, 0.0)


REGIONS = [
    ("A1", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), ("A2", "SRID=4326;multipolygon(((1 1,2 1,2 2,1 2,1 1)),((8 8, 9 8, 9 9, 8 9, 8 8), (8.4 8.4, 8.6 8.4, 8.6 8.6, 8.4 8.6, 8.4 8.4)))"),
    ("A3", "polygon Z ((3 3 1, 7 3 1, 7 7 1, 3 3 1))"), ("A4", None), ("A5", ""), ("A6", "POLYGON EMPTY"), ("A7", "nonsense ((1 1"), ("A1", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
]
POINTS = [("p1", 1.5, 1.5), ("p2", 5.2, 5.0), ("p3", 8.5, 8.5), ("p4", 8.2, 8.2), ("p5", 11.0, 5.0), ("p6", 3.5, 6.0), ("p7", 5.0, 6.5)]


def test_regions_with_holes(spark):
    places = spatial.locations(spark.createDataFrame(POINTS, "key string, lat double, lon double"))
    regions = spark.createDataFrame([(*r, "x") for r in REGIONS], "area_id string, wkt string, strip string")
    got = {(r["rep"], r["region"]) for r in spatial.points_in_regions(places, regions, "area_id", "wkt").collect()}
    assert got == {("p1", "A1"), ("p1", "A2"), ("p3", "A1"), ("p4", "A1"), ("p4", "A2"), ("p6", "A1"), ("p6", "A3"), ("p7", "A1"), ("p7", "A3")}
    assert spatial.points_in_regions(places, regions.limit(0), "area_id", "wkt").count() == 0
    assert spatial.points_in_regions(places.limit(0), regions, "area_id", "wkt").count() == 0


def contains(polygons, x, y):
    """Even-odd rule, an edge at a time."""
    for rings in polygons:
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring.tolist(), [*ring.tolist()[1:], ring.tolist()[0]]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        if odd:
            return True
    return False


def test_a_region_of_many_corners_among_small_ones(spark):
    """A star of 100 000 corners, with a hole, over small squares; places in dense cells, ties and repeated rows."""
    rng = np.random.default_rng(8)
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    reach = 4 + 0.5 * np.sin(40 * turn)
    ring = lambda x, y: "(" + ", ".join(f"{a:.9f} {b:.9f}" for a, b in zip([*x, x[0]], [*y, y[0]])) + ")"
    star = "POLYGON (" + ring(5 + reach * np.cos(turn), 5 + reach * np.sin(turn)) + ", (4 4, 6 4, 6 6, 4 6, 4 4))"
    squares = [(f"s{k}", f"POLYGON (({x} {y}, {x + 0.3} {y}, {x + 0.3} {y + 0.2}, {x} {y + 0.2}, {x} {y}))") for k, (x, y) in enumerate(rng.uniform(0, 10, (60, 2)).round(3))]
    points = rng.uniform(0, 10, (3000, 2)).round(2)
    places = spatial.locations(spark.createDataFrame([(f"p{k}", float(y), float(x)) for k, (x, y) in enumerate(points)], "key string, lat double, lon double"))
    df = spark.createDataFrame([("star", star), ("star", star), *squares], "area_id string, wkt string")
    got = {(r["rep"], r["region"]) for r in spatial.points_in_regions(places, df, "area_id", "wkt", cell_rows=40).collect()}
    kept = [(r["rep"], r["lon"], r["lat"]) for r in places.collect()]
    angle = lambda x, y: 4 + 0.5 * np.sin(40 * np.arctan2(y - 5, x - 5))
    clear = [(p, x, y) for p, x, y in kept if abs(np.hypot(x - 5, y - 5) - angle(x, y)) > 1e-3 and not (4 <= x <= 6 and 4 <= y <= 6 and min(x - 4, 6 - x, y - 4, 6 - y) == 0)]
    want = {(p, "star") for p, x, y in clear if np.hypot(x - 5, y - 5) < angle(x, y) and not (4 < x < 6 and 4 < y < 6)}
    names = {p for p, _, _ in clear}
    assert {g for g in got if g[1] == "star" and g[0] in names} == want and len(want) > 500
    assert {g for g in got if g[1] != "star"} == {(p, name) for name, wkt in squares for p, x, y in kept if contains(spatial.parse_polygons(wkt), x, y)}


def test_regions_in_small_cells(spark):
    rng = np.random.default_rng(4)
    points = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 10, (400, 2)))]
    regions = [(f"A{k}", "POLYGON ((" + ", ".join(f"{x + r * math.cos(t)} {y + r * math.sin(t)}" for t in np.linspace(0, 2 * math.pi, 9)) + "))") for k, (x, y, r) in enumerate(np.column_stack([rng.uniform(0, 10, (20, 2)), rng.uniform(0.2, 3, 20)]))]
    places = spatial.locations(spark.createDataFrame(points, "key string, lat double, lon double"))
    df = spark.createDataFrame(regions, "area_id string, wkt string")
    got = {(r["rep"], r["region"]) for r in spatial.points_in_regions(places, df, "area_id", "wkt", cell_rows=15).collect()}
    want = {(p, name) for name, wkt in regions for p, lat, lon in points if contains(spatial.parse_polygons(wkt), lon, lat)}
    assert got == want


def test_site_points(spark):
    sites = spark.createDataFrame([("s1", "http://x/G1"), ("s1", None), ("s2", "https://X/y/g2/ "), ("s3", "x/g3"), ("s4", None), (None, "x/g1"), ("s5", "x/g5")], "identifier string, geometry_uri string")
    g = [("x/g1", None, 1.0, "POINT Z (12 42 0)"), ("x/g2", 0.0, 0.0, "point ( 9.5 40.5 )"), ("x/g3", 95.0, 1.0, "POINT EMPTY"), ("x/g1", None, None, None), ("x/g5", 44.0, 11.0, "POINT (1 1)")]
    geometries = spark.createDataFrame(g, "geometry_uri string, latitude double, longitude double, wkt string")
    got = {r["key"]: (r["lat"], r["lon"]) for r in site_points(sites, geometries).collect()}
    assert got == {"s1": (42.0, 12.0), "s2": (40.5, 9.5), "s3": (None, None), "s4": (None, None), "s5": (44.0, 11.0)}


def test_near_or_inside(spark):
    sites = spark.createDataFrame([("s1", "g/1"), ("s2", "g/2"), ("s3", None), ("s4", None), ("s5", "g/5")], "identifier string, geometry_uri string")
    geometries = spark.createDataFrame([("g/1", 5.0, 5.0, None), ("g/2", 5.001, 5.0, None), ("g/5", 30.0, 5.0, None)], "geometry_uri string, latitude double, longitude double, wkt string")
    rel = [("nearTo", "u/s3", "u/S1/", 0.1, None), ("nearTo", "u/s4", "u/s3", 120.0, '{"unit": "m"}'), ("nearTo", "u/s1", "u/s5", 0.01, None), ("nearTo", "u/s4", "u/s9", 0.01, None), ("similarTo", "u/s4", "u/s1", 0.1, None), ("nearTo", "u/s4", "u/s5", None, None), ("nearTo", None, "u/s5", 0.1, None), ("nearTo", "u/s4", "u/s4", 0.1, None), ("nearTo", "u/s4", "u/s2", -1.0, None)]
    relations = spark.createDataFrame(rel, "relation_type string, source_uri string, target_uri string, value double, metadata string")
    areas = spark.createDataFrame([("A1", "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))")], "area_id string, wkt string")
    got = {(r["key_a"], r["key_b"], r["kind"]) for r in near_or_inside(sites, geometries, relations, areas).collect()}
    assert got == {("s1", "s2", "distance"), ("s1", "s3", "record"), ("s3", "s4", "record"), ("A1", "s1", "inside"), ("A1", "s2", "inside")}
    assert recorded_near_pairs(relations.limit(0), 0.15).count() == 0
