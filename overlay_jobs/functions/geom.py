"""Geometry as nested arrays (parts, rings, closed vertices), worked on by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

POLYGON = "array<array<array<struct<x: double, y: double>>>>"

# GRS80 ellipsoid, UTM zone 13 north, spherical Mercator.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
UTM_SCALE, UTM_EAST, UTM_MERIDIAN = 0.9996, 500000.0, -105.0
LONLAT, UTM13N, MERCATOR = (4326, 4269), 26913, 3857


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _sum(items: Column, zero: float = 0.0) -> Column:
    return F.aggregate(items, F.lit(zero), lambda a, b: a + b)


def _edges(ring: Column) -> Column:
    """Pairs of consecutive vertices, relative to the ring's first one."""
    first = ring[0]
    size = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, size), F.slice(ring, 2, size), lambda p, q: F.struct((p["x"] - first["x"]).alias("ax"), (p["y"] - first["y"]).alias("ay"), (q["x"] - first["x"]).alias("bx"), (q["y"] - first["y"]).alias("by")))


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(_sum(F.transform(_edges(ring), lambda e: (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)))


def area(geometry: Column) -> Column:
    """Shells less holes, whatever their direction."""
    part = lambda rings: 2 * F.abs(ring_area(rings[0])) - _sum(F.transform(rings, lambda r: F.abs(ring_area(r))))
    return _sum(F.transform(F.filter(geometry, lambda p: F.size(p) > 0), part))


def _moments(ring: Column) -> Column:
    """struct(a, x, y): area and first moments, as of a counter-clockwise ring."""
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    raw = F.struct(
        _sum(F.transform(_edges(ring), lambda e: cross(e) / 2)).alias("a"),
        _sum(F.transform(_edges(ring), lambda e: cross(e) * (e["ax"] + e["bx"]) / 6)).alias("x"),
        _sum(F.transform(_edges(ring), lambda e: cross(e) * (e["ay"] + e["by"]) / 6)).alias("y"),
    )

    def placed(m: Column) -> Column:
        sign = F.when(m["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.struct((sign * m["a"]).alias("a"), (sign * (m["x"] + m["a"] * ring[0]["x"])).alias("x"), (sign * (m["y"] + m["a"] * ring[0]["y"])).alias("y"))

    return let(raw, placed)


def centroid(geometry: Column) -> Column:
    """struct(x, y); null for an empty geometry or one without area."""
    flat = F.flatten(F.transform(geometry, lambda rings: F.transform(rings, lambda r, i: F.struct(_moments(r).alias("m"), F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s")))))
    total = F.aggregate(flat, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda t, r: F.struct((t["a"] + r["s"] * r["m"]["a"]).alias("a"), (t["x"] + r["s"] * r["m"]["x"]).alias("x"), (t["y"] + r["s"] * r["m"]["y"]).alias("y")))
    return let(total, lambda t: F.when(t["a"] > 0, F.struct((t["x"] / t["a"]).alias("x"), (t["y"] / t["a"]).alias("y"))))


def vertices(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax as columns by name."""
    xs, ys = F.transform(vertices(geometry), lambda p: p["x"]), F.transform(vertices(geometry), lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place of whole x and y, both in [0, 2^bits), on the Hilbert curve; null if one is null."""
    side = F.lit((1 << bits) - 1).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(t: Column, s: Column) -> Column:
        right, upper = t["x"].bitwiseAND(s) > 0, t["y"].bitwiseAND(s) > 0
        quarter = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        turned = lambda own, other: F.when(upper, own).when(right, side - other).otherwise(other)
        return F.struct(turned(t["x"], t["y"]).alias("x"), turned(t["y"], t["x"]).alias("y"), (t["d"] + s * s * quarter).alias("d"))

    halves = F.array(*(F.lit(1 << b).cast("long") for b in reversed(range(bits))))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(halves, start, step)["d"])


def total_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    own = df.select(*(c.alias(n) for n, c in bounds(F.col(geometry)).items()))
    return own.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def not_empty(geometry: Column) -> Column:
    return geometry.isNotNull() & (F.size(geometry) > 0) & F.coalesce(F.exists(geometry, lambda p: F.size(p) > 0), F.lit(False))


def each_vertex(geometry: Column, change) -> Column:  # noqa: ANN001
    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, change)))


def clean_rings(geometry: Column) -> Column:
    """Closed rings without repeated vertices; rings of fewer than four vertices and parts without a shell go."""

    def tidy(ring: Column) -> Column:
        kept = F.filter(ring, lambda p, i: (i == 0) | (F.coalesce(F.get(ring, i - 1), p) != p))
        return let(kept, lambda r: F.when((F.size(r) > 0) & (r[0] != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r))

    rings = F.transform(geometry, lambda part: F.transform(part, tidy))
    whole = lambda r: F.size(r) >= 4
    return F.transform(F.filter(rings, lambda part: (F.size(part) > 0) & whole(part[0])), lambda part: F.filter(part, whole))


def snap(geometry: Column, grid: float) -> Column:
    """Vertices on a grid (halves go up), then clean rings."""
    near = lambda v: F.floor(v / grid + 0.5) * F.lit(grid)
    return clean_rings(each_vertex(geometry, lambda p: F.struct(near(p["x"]).alias("x"), near(p["y"]).alias("y"))))


def explode_parts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per part, each a geometry of one part."""
    rest = [c for c in df.columns if c != geometry]
    return df.select(*rest, F.explode(geometry).alias("_part")).select(*rest, F.array("_part").alias(geometry))


def clean_geometry(df: DataFrame, snap_m: float = 1.0, geometry: str = "geometry") -> DataFrame:
    """Snapped and tidied geometries, empty ones dropped, gis_acres recomputed."""
    from overlay_jobs.functions.labels import M2_TO_ACRES

    out = df.where(F.col(geometry).isNotNull()).withColumn(geometry, snap(F.col(geometry), snap_m))
    return out.where(not_empty(F.col(geometry))).withColumn("gis_acres", area(F.col(geometry)) * M2_TO_ACRES)


def drop_slivers(df: DataFrame, min_area_m2: float, geometry: str = "geometry") -> DataFrame:
    return df.where(area(F.col(geometry)) > min_area_m2)


def geometry_key(geometry: Column, grid: float = 1.0) -> Column:
    """The same for equal snapped geometries: rings begin at their least vertex and run the same way round."""

    def normal(ring: Column) -> Column:
        open_ = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
        way = let(F.when(ring_area(ring) < 0, F.reverse(open_)).otherwise(open_), lambda r: let(F.array_position(r, F.array_min(r)).cast("int"), lambda k: F.concat(F.slice(r, k, F.size(r)), F.slice(r, F.lit(1), k - 1))))
        return way

    rings = F.transform(snap(geometry, grid), lambda part: F.concat(F.transform(F.slice(part, 1, 1), normal), F.array_sort(F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), normal))))
    return F.sha2(F.to_json(F.array_sort(rings)), 256)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle, counter-clockwise."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))))


# reprojection
def _kruger() -> tuple[float, list[float], list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    scale = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return scale, forward, back, latitude


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _series(terms: list[float], f) -> Column:  # noqa: ANN001
    out = F.lit(0.0)
    for j, a in enumerate(terms, 1):
        out = out + a * f(2 * j)
    return out


def lonlat_to_utm(p: Column) -> Column:
    scale, forward, _, _ = _kruger()
    n = FLATTENING / (2 - FLATTENING)
    k = 2 * n**0.5 / (1 + n)
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - UTM_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(lat)) - k * F.atanh(k * F.sin(lat)))
    start = F.struct(F.atan2(t, F.cos(lon)).alias("u"), F.atanh(F.sin(lon) / F.sqrt(1 + t * t)).alias("v"))

    def placed(s: Column) -> Column:
        east = s["v"] + _series(forward, lambda j: F.cos(j * s["u"]) * F.sinh(j * s["v"]))
        north = s["u"] + _series(forward, lambda j: F.sin(j * s["u"]) * F.cosh(j * s["v"]))
        return _point(UTM_EAST + UTM_SCALE * scale * east, UTM_SCALE * scale * north)

    return let(start, placed)


def utm_to_lonlat(p: Column) -> Column:
    scale, _, back, latitude = _kruger()
    start = F.struct((p["y"] / (UTM_SCALE * scale)).alias("u"), ((p["x"] - UTM_EAST) / (UTM_SCALE * scale)).alias("v"))

    def reduced(s: Column) -> Column:
        u = s["u"] - _series(back, lambda j: F.sin(j * s["u"]) * F.cosh(j * s["v"]))
        v = s["v"] - _series(back, lambda j: F.cos(j * s["u"]) * F.sinh(j * s["v"]))
        return F.struct(u.alias("u"), v.alias("v"))

    def placed(s: Column) -> Column:
        chi = F.asin(F.sin(s["u"]) / F.cosh(s["v"]))
        return let(chi, lambda c: _point(UTM_MERIDIAN + F.degrees(F.atan2(F.sinh(s["v"]), F.cos(s["u"]))), F.degrees(c + _series(latitude, lambda j: F.sin(j * c)))))

    return let(let(start, reduced), placed)


def lonlat_to_mercator(p: Column) -> Column:
    return _point(SEMI_MAJOR * F.radians(p["x"]), SEMI_MAJOR * F.atanh(F.sin(F.radians(p["y"]))))


def mercator_to_lonlat(p: Column) -> Column:
    return _point(F.degrees(p["x"] / SEMI_MAJOR), F.degrees(F.atan(F.sinh(p["y"] / SEMI_MAJOR))))


def reproject(geometry: Column, from_: int, to: int) -> Column:
    """Between longitude and latitude (4326, 4269), UTM 13 north (26913) and web Mercator (3857); other codes: ValueError."""
    for code in (from_, to):
        if code not in (*LONLAT, UTM13N, MERCATOR):
            raise ValueError(f"no transformation for EPSG {code}")
    same = from_ == to or (from_ in LONLAT and to in LONLAT)
    if same:
        return geometry

    def change(p: Column) -> Column:
        p = utm_to_lonlat(p) if from_ == UTM13N else mercator_to_lonlat(p) if from_ == MERCATOR else p
        return let(p, lonlat_to_utm) if to == UTM13N else let(p, lonlat_to_mercator) if to == MERCATOR else p

    return each_vertex(geometry, change)
