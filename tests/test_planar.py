"""Geometry expressions, atomic zones against unit cells, merges, joins."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from overlay_jobs.functions import geom as G
from overlay_jobs.functions import kernels as K
from overlay_jobs.operators import combine as C
from overlay_jobs.operators import flags as P
from overlay_jobs.operators import spatial as S
from overlay_jobs.session import new_path
from overlay_jobs.sources import tables as R


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in [*xy, xy[0]]]


def square(x, y, w, h=None):
    h = w if h is None else h
    return [[ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def table(spark, geometries, extra=None):
    return spark.createDataFrame([(n, *((extra[n],) if extra else ()), g) for n, g in enumerate(geometries)], f"OBJECTID long, {'ACTIVITY string, ' if extra else ''}geometry {G.POLYGON}")


def test_measures(spark):
    holed = [[ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), (2, 1))]]
    df = table(spark, [square(10, 10, 2), holed, []])
    rows = df.select(G.area(F.col("geometry")).alias("a"), G.centroid(F.col("geometry")).alias("c")).collect()
    assert [r["a"] for r in rows] == [4.0, 15.0, 0.0] and (rows[0]["c"]["x"], rows[0]["c"]["y"]) == (11.0, 11.0) and rows[2]["c"] is None
    assert math.isclose(rows[1]["c"]["x"], (16 * 2 - 1.5) / 15)


def test_snap_drops_degenerate(spark):
    df = table(spark, [square(0.2, 0.2, 0.1), square(0, 0, 2.4)])
    assert G.clean_geometry(df).select("OBJECTID", G.area(F.col("geometry"))).collect() == [(1, 4.0)]


def test_reproject(spark):
    df = table(spark, [[[ring((-105.0, 40.0), (-104.0, 40.0), (-104.0, 41.0))]]])
    p = df.select(G.reproject(F.col("geometry"), 4326, 26913)[0][0].alias("r")).head()["r"]
    assert abs(p[0]["x"] - 500000) < 1e-6 and abs(p[0]["y"] - 4427757.219) < 0.01
    back = df.select(G.reproject(G.reproject(F.col("geometry"), 4326, 26913), 26913, 4326)[0][0].alias("r")).head()["r"]
    assert abs(back[1]["x"] + 104) < 1e-9 and abs(back[1]["y"] - 40) < 1e-9
    with pytest.raises(ValueError):
        G.reproject(F.col("geometry"), 4326, 2154)


@pytest.mark.parametrize("tile", [4000.0, 16.0])
def test_zones_are_cells_with_equal_cover(spark, tile):
    """Faces of boxes on a lattice: 4-neighbour components of cells with equal cover, whatever the tiles."""
    rng = random.Random(3)
    boxes = [(rng.randrange(20), rng.randrange(20), rng.randrange(1, 7), rng.randrange(1, 7)) for _ in range(30)]
    cells = {}
    for i, (x, y, w, h) in enumerate(boxes):
        for a in range(x, x + w):
            for b in range(y, y + h):
                cells.setdefault((a, b), set()).add(i)
    seen, want = set(), []
    for c in cells:
        if c in seen:
            continue
        todo, size = [c], 0
        seen.add(c)
        while todo:
            a, b = todo.pop()
            size += 1
            for d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if d in cells and d not in seen and cells[d] == cells[c]:
                    seen.add(d)
                    todo.append(d)
        want.append((tuple(sorted(cells[c])), float(size)))
    z = S.build_atomic_zones(table(spark, [square(*b) for b in boxes]), 0.5, 0.0, tile=tile)
    got = z.select("cover", G.area(F.col("geometry")).alias("a")).collect()
    assert sorted((tuple(r["cover"]), round(r["a"], 6)) for r in got) == sorted(want)
    assert sorted(r["_atom_id"] for r in z.collect()) == list(range(1, len(want) + 1))


def test_triangles_keep_their_area(spark):
    rng = random.Random(8)
    shapes = [[[ring(*((rng.randrange(60), rng.randrange(60)) for _ in range(3)))]] for _ in range(12)]
    df = table(spark, shapes)
    z = S.build_atomic_zones(df, 0.5, 0.0, tile=16.0)
    per = {r["id"]: r["a"] for r in z.select("cover", G.area(F.col("geometry")).alias("a")).select(F.explode("cover").alias("id"), "a").groupBy("id").agg(F.sum("a").alias("a")).collect()}
    for r in df.select("OBJECTID", G.area(F.col("geometry")).alias("a")).collect():
        assert abs(per.get(r["OBJECTID"], 0.0) - r["a"]) < 0.1 + 1e-3 * r["a"]


def test_bow_tie_and_empty(spark):
    assert S.build_atomic_zones(table(spark, [[[ring((0, 0), (4, 4), (4, 0), (0, 4))]]]), 0.5, 0.0).count() == 2
    with pytest.raises(ValueError):
        S.build_atomic_zones(table(spark, [[]]), 0.5, 0.0)


def test_layer_merges_equal_neighbours(spark):
    """Two boxes of one activity side by side become one zone; a box that touches in a corner stays apart."""
    rows = [(1, "Manual", 2015, "CFT", square(0, 0, 30)), (2, "Manual", 2015, "TWIG", square(30, 0, 30)), (3, "Manual", 2015, "CFT", square(60, 30, 30)), (4, "Removal", 2015, "CFT", square(0, 60, 30))]
    df = spark.createDataFrame(rows, f"OBJECTID long, ACTIVITY string, YEAR_COMP int, SOURCE string, geometry {G.POLYGON}")
    out = S.build_interactions(df, extra=("SOURCE",), tile=64.0)
    assert tuple(out.columns) == S.LAYER
    got = sorted((r["TRT_EFF"], r["SOURCE_IDS"], r["N_EVENTS"], round(r["ACRES_GIS"] / 0.000247105)) for r in out.collect())
    assert got == [("Manual", [1, 2], 2, 1800), ("Manual", [3], 1, 900), ("Removal", [4], 1, 900)]


def test_clip_and_overlay(spark):
    df = table(spark, [square(0, 0, 2), square(4, 0, 2), square(8, 8, 1), square(2, 0, 1)])
    aoi = table(spark, [square(1, 1, 1, 4), square(3, 0, 2)]).withColumnRenamed("OBJECTID", "aoi_id")
    hits = S.clip_intersects(df, aoi, cell=2.0)
    assert sorted((r["OBJECTID"], r["aoi_id"]) for r in hits.collect()) == [(0, 0), (1, 1), (3, 0), (3, 1)]
    assert sorted(r["OBJECTID"] for r in S.clip_intersects(df, aoi, "left_semi", cell=2.0).collect()) == [0, 1, 3]
    cut = S.overlay_intersection(df, aoi, cell=2.0).select("OBJECTID", "aoi_id", G.area(F.col("geometry")).alias("a"))
    assert sorted(tuple(r) for r in cut.collect()) == [(0, 0, 1.0), (1, 1, 2.0)]


def test_points_on_an_edge_are_outside(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 5.0, 5.0)], "_atom_id long, px double, py double")
    got = S.assign_treatments(points, table(spark, [square(0, 0, 2)]), cell=1.0).orderBy("_atom_id").collect()
    assert [r["SOURCE_IDS"] for r in got] == [[0], [], []]


def test_hole_stays_a_hole():
    edges = K.ring_segments(K.to_units([[ring((0, 0), (6, 0), (6, 6), (0, 6))], [ring((2, 2), (4, 2), (4, 4), (2, 4))]]))
    found = sorted(round(f["area"] * K.UNIT**2, 6) for f in K.faces(K.node(edges)))
    assert found == [4.0, 32.0]


def test_dense_ids(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(1000),) for _ in range(500)], "k int")
    out = C.dense_ids(df, ["k"], "id").orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(1, 501)) and [r["k"] for r in out] == sorted(r["k"] for r in out)


def test_flags_edge_cases(spark):
    rows = [(1, None, 10.0, 5.0), (2, "a", 10.0, None), (3, "a", 8.0, 0.0)]
    df = spark.createDataFrame(rows, "OBJECTID int, ACTIVITY string, ACRES_GIS double, ACRES_MGT double").withColumn("gis_acres", F.col("ACRES_GIS"))
    out = P.flag_acre_mismatch(df).orderBy("OBJECTID").collect()
    assert [r["ac_flag"] for r in out] == [False] * 3 and [r["ac_flag_abs"] for r in out] == [False] * 3
    plain = P.flag_acre_mismatch(df.drop("ACRES_MGT")).orderBy("OBJECTID").collect()
    assert [r["acres_diff"] for r in plain] == [10.0, 10.0, 8.0] and plain[1]["ac_flag_abs"]


def test_heatmap_query_counts_boxes_far_up(spark, monkeypatch):
    """Boxes of large customer keys lie beyond any fixed window; the query counts them all."""
    from overlay_jobs.plans import catalog

    far = spark.createDataFrame([(1, square(0, 0, 60)), (2, square(90, 200_000, 60)), (3, square(90, 1_350_000, 60))], f"OBJECTID long, geometry {G.POLYGON}")
    monkeypatch.setattr(catalog.T, "boxes", lambda *a: far)
    got = sorted(tuple(r) for r in catalog.centroid_grid_heatmap(spark, "").collect())
    assert got == [(0, 0, 1), (0, 40, 1), (0, 270, 1)]


def test_slanted_polygons_with_holes(spark):
    """Every polygon's area is that of its zones, and random points lie in the zone of exactly the polygons around them."""
    rng = random.Random(41)
    rows = []
    for n in range(60):
        cx, cy, turn = rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(0, 7)
        ring = lambda r, k: [(cx + r * math.cos(turn + 2 * math.pi * i / k), cy + r * math.sin(turn + 2 * math.pi * i / k)) for i in range(k)]  # noqa: E731, B023
        outer, inner = ring(rng.uniform(60, 160), rng.choice([3, 5, 8])), ring(rng.uniform(5, 20), 4)[::-1]
        rings = [outer, inner] if n % 2 else [outer]
        rows.append((n, [[[{"x": x, "y": y} for x, y in [*r, r[0]]] for r in rings]]))
    df = spark.createDataFrame(rows, f"OBJECTID long, geometry {G.POLYGON}")
    zones = S.build_atomic_zones(df, 1 / 512, 0.0, tile=400.0).withColumn("area", G.area(F.col("geometry"))).collect()
    own = {r["OBJECTID"]: (r["area"], r["geometry"]) for r in df.withColumn("area", G.area(F.col("geometry"))).collect()}
    total = dict.fromkeys(own, 0.0)
    for z in zones:
        for i in z["cover"]:
            total[i] += z["area"]
    assert all(abs(total[i] - own[i][0]) < 1.0 for i in own)
    at = np.array([(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(300)])
    inside = lambda g: K.covers(at, K.ring_segments(K.to_units(g)) * K.UNIT)
    want, got = [set() for _ in at], [[] for _ in at]
    for i, (_, g) in own.items():
        for k in np.flatnonzero(inside(g)):
            want[k].add(i)
    for z in zones:
        for k in np.flatnonzero(inside(z["geometry"])):
            got[k].append(set(z["cover"]))
    assert got == [[w] if w else [] for w in want]


def test_noding_that_does_not_settle_is_an_error():
    seg = np.array([[0.0, 0.0, 10.0, 10.0], [0.0, 10.0, 10.0, 0.0]])
    assert len(K.node(seg)) == 4
    with pytest.raises(ArithmeticError):
        K.node(seg, rounds=1)


def test_intersects_in_small_portions(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(K, "PAIRS", 3)
    square = lambda x, y, s: [[np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]], float)]]
    for _ in range(300):
        (a, b, s), (c, d, t) = ([rng.randrange(0, 12), rng.randrange(0, 12), rng.randrange(1, 8)] for _ in range(2))
        assert K.intersects(square(a, b, s), square(c, d, t)) == (a <= c + t and c <= a + s and b <= d + t and d <= b + s)


def points_agree(zones, polygons, at):
    """Covers of the zones around points against the polygons around them."""
    inside = lambda g: K.covers(at, K.ring_segments(K.to_units(g)) * K.UNIT)
    want, got = [set() for _ in at], [[] for _ in at]
    for i, g in polygons:
        for k in np.flatnonzero(inside(g)):
            want[k].add(i)
    for z in zones:
        for k in np.flatnonzero(inside(z["geometry"])):
            got[k].append(set(z["cover"]))
    assert got == [[w] if w else [] for w in want]


def test_covers_are_carried_through_split_tiles(spark):
    """Tiles of several levels, large polygons that hold whole tiles, and edges through the corners of seams."""
    rng = random.Random(9)
    side = S._tile_sides(400.0)[0] * K.UNIT
    rows = [(n, [[[{"x": x + dx, "y": y + dy} for dx, dy in [(0, 0), (s, 0), (s, s), (0, s), (0, 0)]]]]) for n, (x, y, s) in enumerate([(-900.0, -900.0, 2600.0), (10.0, 10.0, 1500.0)])]
    star = lambda cx, cy, r, k: [(cx + r * (1 if i % 2 else 0.45) * math.cos(math.pi * i / k), cy + r * (1 if i % 2 else 0.45) * math.sin(math.pi * i / k)) for i in range(2 * k)]
    rings = [star(rng.uniform(100, 500), rng.uniform(100, 500), rng.uniform(20, 300), rng.randrange(3, 9)) for _ in range(40)]
    off = 1 * K.UNIT  # the seams' corners lie at multiples of the side and one unit
    for c in range(3):  # diagonals through corners, rising and falling
        x, y = c * side + off, side + off
        rings += [[(x - 200 * 1, y - 200), (x + 200, y + 200), (x - 200, y + 200)], [(x - 100, y + 100), (x + 100, y - 100), (x + 100, y + 100)]]
    rows += [(10 + n, [[[{"x": 2 * K.UNIT * round(x / 2 / K.UNIT), "y": 2 * K.UNIT * round(y / 2 / K.UNIT)} for x, y in [*r, r[0]]]]]) for n, r in enumerate(rings)]
    df = spark.createDataFrame(rows, f"OBJECTID long, geometry {G.POLYGON}")
    at = np.array([(rng.uniform(-950, 1750), rng.uniform(-950, 1750)) for _ in range(150)] + [(rng.uniform(50, 650), rng.uniform(50, 650)) for _ in range(400)])
    found = {}
    for limit in (4_000, 60):  # one level, several levels
        zones = S.build_atomic_zones(df, 1 / 512, 0.0, tile=400.0, limit=limit).withColumn("area", G.area(F.col("geometry"))).collect()
        points_agree(zones, rows, at)
        found[limit] = sorted((sorted(z["cover"]), round(z["area"], 1)) for z in zones if z["area"] > 1)
        area = dict.fromkeys((i for i, _ in rows), 0.0)
        for z in zones:
            for i in z["cover"]:
                area[i] += z["area"]
        plain = {r["OBJECTID"]: r["a"] for r in df.select("OBJECTID", G.area(F.col("geometry")).alias("a")).collect()}
        assert all(abs(area[i] - plain[i]) < 1.0 for i in plain)
    assert {str(c) for c, _ in found[4_000]} == {str(c) for c, _ in found[60]}
    split = S.tile_segments(df.withColumnRenamed("OBJECTID", "id"), 400.0, 60)
    assert split[1] >= 2 and split[0].where("level = 0").count() and split[0].where("level > 1").count()


def test_one_polygon_with_100000_vertices(spark):
    """A region of 120 km: its segments are dealt to tiles, its inner tiles get its id alone."""
    n = 100_000
    a = 2 * np.pi * np.arange(n) / n
    r = 60_000 + 3_000 * np.sin(40 * a)
    big = [(1, [[[{"x": float(x), "y": float(y)} for x, y in zip(np.append(r * np.cos(a), r[0]), np.append(r * np.sin(a), 0.0))]]])]
    small = [(2, [[[{"x": x, "y": y} for x, y in [(100.0, 100.0), (900.0, 100.0), (900.0, 900.0), (100.0, 900.0), (100.0, 100.0)]]]])]
    df = spark.createDataFrame(big + small, f"OBJECTID long, geometry {G.POLYGON}")
    zones = S.build_atomic_zones(df, 1 / 512, 0.0).select("cover", G.area(F.col("geometry")).alias("a")).collect()
    want = float((r**2).mean() * np.pi)
    assert sorted(z["cover"] for z in zones) == [[1], [1, 2]]
    assert {len(z["cover"]): round(z["a"]) for z in zones}[2] == 640_000
    assert abs(sum(z["a"] for z in zones) - want) / want < 1e-6
    parts, _, _ = S.tile_segments(df.withColumnRenamed("OBJECTID", "id"))
    assert parts.where("ax IS NULL").count() > 500 and parts.where("ax IS NOT NULL").count() < 1.2 * n


def test_only_crossing_polygons_are_taken_apart(monkeypatch):
    """The flat test against all pairs of segments, exactly: also with 600 km and a vertex one unit off an edge."""
    rng = random.Random(4)

    def crosses(ring):
        e = list(zip(ring, ring[1:]))
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        on = lambda a, b, p: side(a, b, p) == 0 and (p[0] - a[0]) * (b[0] - p[0]) + (p[1] - a[1]) * (b[1] - p[1]) > 0
        for i, (a, b) in enumerate(e):
            for c, d in e[i + 1 :]:
                proper = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
                if proper or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b) or {a, b} == {c, d}:
                    return True
        return False

    rings = [[(2 * rng.randrange(12), 2 * rng.randrange(12)) for _ in range(rng.randrange(3, 7))] for _ in range(300)]
    far = 600_000 * 1024
    rings += [[(0, 0), (far, far - 2), (far, 0)], [(0, 0), (far, far - 2), (far // 2, far // 2 - 2), (far, 0)], [(0, 0), (far, far - 2), (far // 2, far // 2), (far, 0)]]
    rings = [[p for p, q in zip(r, r[-1:] + r) if p != q] for r in rings]
    rings = [[*r, r[0]] for r in rings if len(r) > 2]
    column = pa.array([None] + [[[[{"x": x * K.UNIT, "y": y * K.UNIT} for x, y in r]]] for r in rings], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(K, "PAIRS", pairs)
        assert K.crossing_rows(*K.polygon_segments(column)).tolist() == [n + 1 for n, r in enumerate(rings) if crosses(r)]


def test_convex_is_told_in_the_jvm(spark):
    ring = lambda *p: [[[{"x": float(x), "y": float(y)} for x, y in [*p, p[0]]]]]
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    rows = [(1, ring((0, 0), (4, 0), (4, 3), (0, 3))), (2, ring((0, 0), (0, 3), (4, 3), (4, 0))), (3, ring((0, 0), (4, 0), (1, 1), (0, 4))), (4, ring((0, 0), (4, 4), (4, 0), (0, 4))), (5, ring(*star)), (6, []), (7, None), (8, ring((0, 0), (2, 0), (4, 0), (0, 3)))]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, f"i long, geometry {G.POLYGON}").select("i", S._convex(F.col("geometry")).alias("c")).collect()}
    assert [bool(got[i]) for i in range(1, 9)] == [True, True, False, False, False, False, False, False]


def test_rings_of_a_batch(spark):
    """Holes, islands in holes, rings that touch in a vertex, edges both ways, empty rows: the same as the plain chaining, row by row."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    edges = lambda ring: [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    rows = [edges(box(0, 0, 90, 90)) + edges(box(10, 10, 60, 60)[::-1]) + edges(box(20, 20, 30, 30)), edges(box(0, 0, 4, 4)) + edges(box(4, 4, 6, 6)), edges(box(0, 0, 4, 4)) + edges(box(4, 0, 4, 4)), [], None, edges(box(0, 0, 2, 2)) + [(0, 0, 0, 0)]]
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))
    got = K.ring_columns(pa.array([None if r is None else [dict(zip(("ax", "ay", "bx", "by"), map(float, e))) for e in r] for r in rows], kind)).to_pylist()
    plain = [K.dissolve([np.array([e for e in r or [] if e[:2] != e[2:]], float).reshape(-1, 4)]) if r else [] for r in rows]
    canon = lambda parts, unit: sorted(sorted((tuple(sorted(p)) for p in part), key=len) for part in [[[(x * unit, y * unit) for x, y in ring] for ring in p] for p in parts])
    assert [canon([[[(p["x"], p["y"]) for p in ring[:-1]] for ring in part] for part in g], 1) for g in got] == [canon([[ring[:-1] for ring in part] for part in g], K.UNIT) for g in plain]
    assert [len(g) for g in got] == [2, 2, 1, 0, 0, 1] and sorted(len(p) for p in got[0]) == [1, 2]


@pytest.mark.parametrize("few", [False, True])
def test_points_in_polygons_by_leaves(spark, monkeypatch, few):
    """One large polygon with a hole, many small ones, points on edges and vertices, repeated and null points; leaves of several levels
    and in several deals."""
    if few:
        monkeypatch.setattr(S, "LEAF_POINTS", 5)
    rng = random.Random(12)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    shapes = {1: [box(-3000.0, -2500.0, 6000.0, 6000.0), box(200.0, 200.0, 500.0, 400.0)[::-1]]}
    for n in range(2, 120):
        cx, cy, r, k = rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(5, 120), rng.randrange(3, 8)
        ring = [(2 * K.UNIT * round((cx + r * math.cos(2 * math.pi * i / k)) / 2 / K.UNIT), 2 * K.UNIT * round((cy + r * math.sin(2 * math.pi * i / k)) / 2 / K.UNIT)) for i in range(k)]
        shapes[n] = [[*ring, ring[0]]]
    shapes[500], shapes[501] = [box(0.0, 0.0, 8.0, 8.0)], [box(8.0, 0.0, 8.0, 8.0)]
    rows = [(i, [[[{"x": x, "y": y} for x, y in r] for r in rings]]) for i, rings in shapes.items()] + [(900, []), (901, None)]
    polygons = spark.createDataFrame(rows, f"OBJECTID long, geometry {G.POLYGON}")
    spots = [(rng.uniform(-200, 1100), rng.uniform(-200, 1100)) for _ in range(400)] + [(8.0, 4.0), (4.0, 4.0), (8.0, 8.0), (0.0, 0.0), (12.0, 4.0), (16.0, 9.0), (4.0, 4.0)]
    points = spark.createDataFrame([(f"p{n}", x, y) for n, (x, y) in enumerate(spots)] + [("none", None, 1.0)], "_atom_id string, px double, py double")
    got = S.assign_points(points, polygons, cell=400.0, limit=60 if few else 4_000).collect()
    want = []
    for i, rings in shapes.items():
        seg = np.vstack([K.ring_segments([[np.array(r) / K.UNIT]]) for r in rings])
        at = np.array(spots) / K.UNIT
        inside = K.covers(at, seg)
        d, w = seg[:, 2:] - seg[:, :2], at[:, None, :] - seg[None, :, :2]
        along = (w * d).sum(axis=2)
        on = ((d[:, 0] * w[:, :, 1] == d[:, 1] * w[:, :, 0]) & (along >= 0) & (along <= (d * d).sum(axis=1))).any(axis=1)
        want += [(f"p{n}", i) for n in np.flatnonzero(inside & ~on)]
    assert sorted((r["_atom_id"], r["OBJECTID"]) for r in got) == sorted(want)
    assert S.assign_points(points.limit(0), polygons).count() == 0 and S.assign_points(points, polygons.limit(0)).count() == 0


def test_curve_visits_neighbours(spark):
    side = 8
    df = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    at = {r["d"]: (r["x"], r["y"]) for r in df.withColumn("d", G.hilbert(F.col("x"), F.col("y"), 3)).collect()}
    assert sorted(at) == list(range(side * side))
    assert all(abs(at[d][0] - at[d + 1][0]) + abs(at[d][1] - at[d + 1][1]) == 1 for d in range(side * side - 1))


def files_read(df):
    """Files and rows that the scan of a plan that ran has counted."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    count = lambda name: plan.metrics().apply(name).value()
    return count("numFiles"), count("numOutputRows")


def test_windows_leave_out_files(spark):
    """A window of 1 % of the area opens less than 5 % of the files, and gives what a scan of all rows gives."""
    rng = random.Random(3)
    rows = [(n, "clash", square(rng.uniform(0, 1e5), rng.uniform(0, 1e5), rng.uniform(1, 50))) for n in range(8_000)] + [(8_000, "x", None), (8_001, "x", [])]
    df = spark.createDataFrame(rows, f"OBJECTID long, _curve string, geometry {G.POLYGON}").drop("_curve")
    path, window = new_path(spark, "window"), (30_000.0, 40_000.0, 40_000.0, 50_000.0)
    R.save_layer(df, path, files=400)
    own = R.read_window(spark, path, window)
    got = {r["OBJECTID"] for r in own.collect()}
    box = lambda g: (*map(min, zip(*((p["x"], p["y"]) for p in g[0][0]))), *map(max, zip(*((p["x"], p["y"]) for p in g[0][0]))))
    meets = lambda b: b[0] <= window[2] and b[2] >= window[0] and b[1] <= window[3] and b[3] >= window[1]
    assert got == {n for n, _, g in rows if g and meets(box(g))} and len(got) > 40
    files, read = files_read(own)
    assert files < 20 and read < 8_000 * 0.05
    assert R.read_window(spark, path, (-9.0, -9.0, -8.0, -8.0)).count() == 0
    assert spark.read.parquet(path).count() == len(rows)  # the table of boxes is not part of the layer
    R.save_layer(df.limit(0), path)
    assert R.read_window(spark, path, window).count() == 0


def test_boundaries_by_name(spark):
    df = spark.createDataFrame([("08", "Ada", square(0, 0, 1)), ("08", "Bee", square(2, 0, 1)), ("8", "Cee", square(4, 0, 1)), (None, "Dee", square(6, 0, 1))], f"code string, name string, geometry {G.POLYGON}")
    path = new_path(spark, "boundaries")
    R.write_feature_pages(df, path, ["code", "name"])
    read = lambda column, *values: sorted(r["name"] for r in R.read_boundaries(spark, path, "code string, name string", column, values).collect())
    assert read("code", "08") == ["Ada", "Bee"] and read("name", "Cee", "Dee") == ["Cee", "Dee"]
    with pytest.raises(ValueError, match="Eve"):
        read("name", "Ada", "Eve")


def test_sources_in_two_systems(spark):
    """Sources combine in the first one's system; the same place comes out the same."""
    here = table(spark, [square(500_000, 4_400_000, 100)])
    there = here.withColumn("geometry", G.reproject(F.col("geometry"), 26913, 4269))
    out = C.combine_sources({"A": here, "B": there}, crs={"A": 26913, "B": 4269}).orderBy("OBJECTID").collect()
    assert [r["SOURCE"] for r in out] == ["A", "B"]
    for p, q in zip(out[0]["geometry"][0][0], out[1]["geometry"][0][0]):
        assert math.isclose(p["x"], q["x"], abs_tol=1e-3) and math.isclose(p["y"], q["y"], abs_tol=1e-3)


def test_bow_ties_are_taken_apart_together(monkeypatch):
    """A batch of crossing polygons is noded a few times in all, not once each: areas as by the faces of each alone."""
    rng = random.Random(12)
    rings = [[(x, 0), (x + 90, 60), (x + 90, 0), (x, 60)] for x in range(0, 14_000, 7)]
    rings += [[(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(rng.randrange(4, 9))] for _ in range(200)]
    rings += [[(0, 0), (600_000, 2), (600_000, 0), (0, 2)], [(0, 0), (4, 0), (4, 4), (0, 4)]]
    column = pa.array([None] + [[[ring(*r)]] for r in rings], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
    calls, node = [], K.node
    monkeypatch.setattr(K, "node", lambda *a: calls.append(1) or node(*a))
    got = S._repair(column).to_pylist()
    assert len(calls) < 10
    assert got[0] is None and got[-1] is None and all(len(g) == 2 for g in got[1:2_001])
    own = lambda r: abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, r[1:]))) / 2
    area = lambda g: sum(2 * own(p[0]) - sum(map(own, p)) for p in g)
    for g, r in zip(got[2_001:-1], rings[2_000:-1]):
        seg = K.ring_segments(K.to_units([[ring(*r)]]))
        inside = [f["area"] * K.UNIT**2 for f in K.faces(node(seg)) if K.covers(np.array([f["point"]]), seg)[0]]
        assert g is None or abs(area(g) - sum(inside)) < 1e-6


def test_tiles_of_segments_in_arrays():
    """Every tile that a segment passes through is among its tiles, and corners are told as by the polygon itself."""
    rng, side = random.Random(21), 2_048
    rings = [[(2 * rng.randrange(-6_000, 6_000), 2 * rng.randrange(-6_000, 6_000)) for _ in range(rng.randrange(3, 7))] for _ in range(60)]
    seg = np.array([[*p, *q] for r in rings for p, q in zip(r, r[1:] + r[:1])])
    owner = np.repeat(np.arange(60), [len(r) for r in rings])
    tx, ty, of, mx, my, who = K.tile_rows(seg, owner, side)
    have = set(zip(of.tolist(), tx.tolist(), ty.tolist()))
    for k, (ax, ay, bx, by) in enumerate(seg.tolist()):
        for t in np.linspace(0, 1, 400):
            assert (k, math.floor((ax + t * (bx - ax) - 1) / side), math.floor((ay + t * (by - ay) - 1) / side)) in have
    assert len(have) == len(of) < 3 * sum(1 + abs(ax - bx) // side + abs(ay - by) // side for ax, ay, bx, by in seg.tolist())
    marks = set(zip(who.tolist(), mx.tolist(), my.tolist()))
    corners = np.array([(x * side + 1, y * side + 1) for x in range(-7, 8) for y in range(-7, 8)], float)
    for k in range(60):
        inside = K.covers(corners, seg[owner == k])
        assert {(k, int(x // side), int(y // side)) for x, y in corners[inside]} == {m for m in marks if m[0] == k}


def test_faces_inside_a_tile_come_with_their_geometry(spark):
    """Only faces on a seam are left for the join across tiles; zones have their area, and no ids where none are asked for."""
    rows = [(0, 0, 0, i, *v) for i, (x, y, s) in enumerate([(100, 100, 60), (130, 130, 60), (1_990, 500, 60)]) for v in [[int(c * 1024) for c in e] for e in ((x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y))]]
    tile = pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], ["level", "tx", "ty", "id", "ax", "ay", "bx", "by"])
    faces = S._tile_faces(tile, S._tile_sides(2_000.0), 0).to_pylist()
    assert sorted((f["cover"], f["area"], len(f["seams"]) > 0) for f in faces if f["geometry"]) == [([0], 2700.0, False), ([0, 1], 900.0, False), ([1], 2700.0, False)]
    assert [(f["cover"], f["area"], len(f["seams"]) > 0) for f in faces if not f["geometry"]] == [([2], None, True)]
    zones = S.build_atomic_zones(table(spark, [square(100, 100, 60), square(130, 130, 60), square(1_990, 500, 60)]), 0.5, 1_000.0, numbered=False)
    assert "_atom_id" not in zones.columns and sorted((r["cover"], r["area"]) for r in zones.collect()) == [([0], 2700.0), ([1], 2700.0), ([2], 3600.0)]


def test_points_of_a_leaf_meet_segments_of_their_x_only():
    """20,000 points and 4,000 boxes of one leaf: pairs as by the boxes themselves, without a look at all 320 million of points and sides."""
    rng = np.random.default_rng(5)
    at, size = 2 * rng.integers(-2_000, 500_000, (4_000, 2)), 2 * rng.integers(1, 5_000, (4_000, 2))
    (x0, y0), (x1, y1) = at.T, (at + size).T
    seg = np.concatenate([np.stack(v, 1) for v in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))])
    points = rng.integers(2, 1_000_000, (20_000, 2)) + 0.0
    points[:50] = at[:50] + [0, 1]  # on an edge: not inside
    corner = ((at < 1) & (at + size > 1)).all(axis=1).astype(int)
    began = time.perf_counter()
    p, q = K.inside_leaf(points, seg, np.tile(np.arange(4_000), 4), corner, (1, 1))
    assert time.perf_counter() - began < 4
    want = {(i, k) for k in range(4_000) for i in np.flatnonzero((points > at[k]).all(axis=1) & (points < at[k] + size[k]).all(axis=1)).tolist() if (points[i] > 1).all()}
    assert len(p) == len(want) and set(zip(p.tolist(), q.tolist())) == want


@pytest.mark.parametrize("tile", [4000.0, 64.0])
def test_dissolve_joins_within_tiles_first(spark, monkeypatch, tile):
    """Unions are 4-neighbour components of cells of a key, nulls agree; only pieces on seams are left to the join of components."""
    rng = random.Random(31)
    boxes = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 4), rng.randrange(1, 4), rng.choice(["a", "b", None])) for _ in range(60)]
    own = [(n, k, square(30 * x + 30, 30 * y + 30, 30 * w, 30 * h)) for n, (x, y, w, h, k) in enumerate(boxes)]
    links, join = [], S.connected_components
    monkeypatch.setattr(S, "connected_components", lambda df, *a: links.append(df.count()) or join(df, *a))
    got = S.dissolve(spark.createDataFrame(own, f"OBJECTID long, ACTIVITY string, geometry {G.POLYGON}"), ["ACTIVITY"], {"n": F.count("*")}, snap=0.5, tile=tile)
    got = sorted((str(r["ACTIVITY"]), tuple(r["ids"]), r["n"], round(r["a"])) for r in got.select("ACTIVITY", "ids", "n", G.area(F.col("geometry")).alias("a")).collect())
    want = []
    for key in ("a", "b", None):
        cells = {}
        for n, (x, y, w, h, k) in enumerate(boxes):
            if k == key:
                for c in ((i, j) for i in range(x, x + w) for j in range(y, y + h)):
                    cells.setdefault(c, set()).add(n)
        while cells:
            todo, ids, size = [next(iter(cells))], set(cells[next(iter(cells))]), 0
            while todo:
                c = todo.pop()
                if c in cells:
                    ids |= cells.pop(c)
                    size += 900
                    todo += [(c[0] + i, c[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            want.append((str(key), tuple(sorted(ids)), len(ids), size))
    assert got == sorted(want)
    assert links == [0] if tile == 4000.0 else links[0] > 0


def test_only_atoms_with_equal_neighbours_are_gathered(spark, monkeypatch):
    """Outlines are made of the two that merge; the others go through as they are, and all are numbered by their least atom."""
    event = [{"SOURCE_ID": 1, "FUND_SOURCE": " x ", "YEAR_COMP": 2015}]
    rows = [(n, k, [n], [{**event[0], "SOURCE_ID": n}], square(30 * x, 0, 30)) for n, k, x in [(3, "a", 0), (5, "b", 1), (8, "a", 3), (9, "a", 2), (12, "a", 9)]]
    atoms = spark.createDataFrame(rows, f"ATOM_ID long, k string, SOURCE_IDS array<long>, EVENTS array<struct<SOURCE_ID: long, FUND_SOURCE: string, YEAR_COMP: int>>, geometry {G.POLYGON}")
    seen, outlines = [], S._outlines
    monkeypatch.setattr(S, "_outlines", lambda df, key: seen.append(df.count()) or outlines(df, key))
    out = S.merge_adjacent(atoms, ("k",))
    got = [(r["ATOM_ID"], r["k"], r["SOURCE_IDS"], r["N_EVENTS"], r["FUND_SOURCES"], round(r["ACRES_GIS"] / 0.000247105)) for r in out.orderBy("ATOM_ID").collect()]
    assert got == [(1, "a", [3], 1, "x", 900), (2, "b", [5], 1, "x", 900), (3, "a", [8, 9], 2, "x", 1800), (4, "a", [12], 1, "x", 900)]
    assert seen == [2] and "area" not in out.columns
