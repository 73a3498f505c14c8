"""Geometry on longitude/latitude columns and on arrays of struct<lon,lat>. Everything stays in whole-stage code generation
or in higher-order functions; only WKB, at the edges, goes through Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import ship

#: Metres of the mean Earth radius, metres a degree that waypoint sampling assumes.
EARTH_M = 6_371_000.0
WAYPOINT_M_PER_DEGREE = 100_000.0
MERCATOR_M = 20037508.342789244


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in degrees, [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar azimuth in degrees; 0 for coincident points."""
    dx, dy = lon2 - lon1, lat2 - lat1
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def angle_between(a: Column, b: Column) -> Column:
    """Between two bearings, at most 180 and at least 1 degree."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.greatest(F.least(d, F.lit(360.0) - d), F.lit(1.0))


def axis_angle(road: Column, sun: Column) -> Column:
    """Acute angle between a road's axis and the sun's azimuth, [0, 90]."""
    d = F.pmod(F.abs(road - sun), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def snap(x: Column, step: float = 1e-6) -> Column:
    """Grid number of a coordinate: a join key that needs no text."""
    return F.round(x / F.lit(step)).cast("long")


def _legs(coords: Column) -> Column:
    """Consecutive vertices as struct<a, b, len>, planar degrees."""
    pairs = F.zip_with(F.slice(coords, F.lit(1), F.size(coords) - 1), F.slice(coords, F.lit(2), F.size(coords) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.sqrt(F.pow(p["b"]["lon"] - p["a"]["lon"], 2) + F.pow(p["b"]["lat"] - p["a"]["lat"], 2)).alias("len")))


def line_length(coords: Column) -> Column:
    """Planar length in degrees."""
    return F.aggregate(_legs(coords), F.lit(0.0), lambda s, x: s + x["len"])


def centroid(coords: Column) -> Column:
    """Length-weighted centroid of a line as struct<lon,lat>; the first vertex if it has no length."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("l"))
    step = lambda s, g: F.struct((s["x"] + (g["a"]["lon"] + g["b"]["lon"]) / 2 * g["len"]).alias("x"), (s["y"] + (g["a"]["lat"] + g["b"]["lat"]) / 2 * g["len"]).alias("y"), (s["l"] + g["len"]).alias("l"))
    first = F.element_at(coords, 1)
    end = lambda s: F.when(s["l"] > 0, F.struct((s["x"] / s["l"]).alias("lon"), (s["y"] / s["l"]).alias("lat")))
    return F.coalesce(F.aggregate(_legs(coords), zero, step, end), F.struct(first["lon"].alias("lon"), first["lat"].alias("lat")))


def vertex(coords: Column, n: int) -> Column:
    """The n-th vertex from the start (1, 2, ...) or from the end (-1, -2, ...)."""
    return F.element_at(coords, n)


def end_azimuths(coords: Column) -> tuple[Column, Column]:
    """Planar azimuths of the first leg, out of the start, and of the last leg, into the end."""
    a, b, y, z = (vertex(coords, n) for n in (1, 2, -2, -1))
    return azimuth(a["lon"], a["lat"], b["lon"], b["lat"]), azimuth(y["lon"], y["lat"], z["lon"], z["lat"])


def bounds(coords: Column) -> dict[str, Column]:
    """min_lon, min_lat, max_lon, max_lat of a line."""
    lons, lats = F.transform(coords, lambda c: c["lon"]), F.transform(coords, lambda c: c["lat"])
    return {"min_lon": F.array_min(lons), "min_lat": F.array_min(lats), "max_lon": F.array_max(lons), "max_lat": F.array_max(lats)}


def places(coords: Column) -> dict[str, Column]:
    """start_, mid_ and end_ lon and lat of a line; the middle is its centroid."""
    at = {"start": vertex(coords, 1), "mid": centroid(coords), "end": vertex(coords, -1)}
    return {f"{n}_{k}": c[k] for n, c in at.items() for k in ("lon", "lat")}


def bbox_hit(coords: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    """Whether any vertex lies in the closed box."""
    return F.exists(coords, lambda c: c["lon"].between(min_lon, max_lon) & c["lat"].between(min_lat, max_lat))


def waypoint_count(coords: Column, spacing_m: float = 50.0, most: int = 5) -> Column:
    metres = line_length(coords) * F.lit(WAYPOINT_M_PER_DEGREE)
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(metres / F.lit(spacing_m)).cast("int") + 1))


def interpolate(coords: Column, fraction: Column) -> Column:
    """Point at a fraction of the line's length, [0, 1]."""
    whole = line_length(coords)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))

    def step(s: Column, g: Column) -> Column:
        t = F.when(g["len"] > 0, (fraction * whole - s["done"]) / g["len"]).otherwise(0.0)
        hit = s["lon"].isNull() & (fraction * whole <= s["done"] + g["len"] * (1 + 1e-12))
        return F.struct((s["done"] + g["len"]).alias("done"), F.when(hit, g["a"]["lon"] + t * (g["b"]["lon"] - g["a"]["lon"])).otherwise(s["lon"]).alias("lon"), F.when(hit, g["a"]["lat"] + t * (g["b"]["lat"] - g["a"]["lat"])).otherwise(s["lat"]).alias("lat"))

    last = F.element_at(coords, -1)
    return F.aggregate(_legs(coords), start, step, lambda s: F.struct(F.coalesce(s["lon"], last["lon"]).alias("lon"), F.coalesce(s["lat"], last["lat"]).alias("lat")))


def waypoints(coords: Column, spacing_m: float = 50.0, most: int = 5) -> Column:
    """Array of struct<sample_index, fraction>: the middle if there is one point, else evenly from end to end."""
    n = waypoint_count(coords, spacing_m, most)
    return F.when(n == 1, F.array(F.struct(F.lit(0).alias("sample_index"), F.lit(0.5).alias("fraction")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("sample_index"), (i / (n - 1)).cast("double").alias("fraction"))))


def mercator_x(lon: Column) -> Column:
    return lon / 180.0 * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / math.pi * MERCATOR_M


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(2**zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * float(2**zoom)).cast("int")


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """min_lon, min_lat, max_lon, max_lat of a slippy tile."""
    n = 2.0**z
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_units(lon: Column, lat: Column, z: Column, x: Column, y: Column, extent: int = 4096) -> tuple[Column, Column]:
    """Place within a slippy tile, in units of its extent from its north-western corner; not rounded."""
    n, r = F.pow(F.lit(2.0), z), F.radians(lat)
    px = ((lon + 180.0) / 360.0 * n - x) * extent
    return px, ((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n - y) * extent


def _once(value: Column, f) -> Column:
    """f of a value that is computed once: what a lambda names twice is else computed twice."""
    return F.transform(F.array(value), f)[0]


def clipped(coords: Column, z: Column, x: Column, y: Column, extent: int = 4096, buffer: int = 256) -> Column:
    """Pieces of a line inside a tile and its buffer, as array<struct<part,x1,y1,x2,y2>> of whole units; empty if there is none.

    Each leg is cut to the interval of its parameter in which it lies between both pairs of borders. Every vertex is placed once.
    """
    low, high = float(-buffer), float(extent + buffer)

    def placed(c: Column) -> Column:
        px, py = tile_units(c["lon"], c["lat"], z, x, y, extent)
        return F.struct(px.alias("x"), py.alias("y"))

    def leg(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def inside(p: Column, d: Column) -> tuple[Column, Column]:
        a, b = (low - p) / d, (high - p) / d
        still = F.when(p.between(low, high), 0.0).otherwise(2.0)  # enters after the end: nowhere
        return F.when(d == 0, still).otherwise(F.least(a, b)), F.when(d == 0, 1.0).otherwise(F.greatest(a, b))

    def piece(g: Column, i: Column) -> Column:
        (x0, x1), (y0, y1) = inside(g["x"], g["dx"]), inside(g["y"], g["dy"])
        whole = lambda v, n: F.round(v).cast("int").alias(n)
        at = lambda t, n: (whole(g["x"] + t * g["dx"], f"x{n}"), whole(g["y"] + t * g["dy"], f"y{n}"))
        span = F.struct(F.greatest(F.lit(0.0), x0, y0).alias("s"), F.least(F.lit(1.0), x1, y1).alias("e"))
        return _once(span, lambda t: F.when(t["s"] < t["e"], F.struct(i.alias("part"), *at(t["s"], 1), *at(t["e"], 2))))

    n = F.size(coords) - 1
    legs = _once(F.transform(coords, placed), lambda p: F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), leg))
    return F.filter(F.transform(legs, piece), lambda p: p.isNotNull())


def to_wkb(coords: Column | str) -> Column:
    """Lines as WKB LineStrings, big-endian; null for null lines, for null vertices and for fewer than two vertices."""
    ship(SparkSession.active())
    return F.arrow_udf(_write_wkb, T.BinaryType())(coords)


def from_wkb(wkb: Column | str) -> Column:
    """Vertices of WKB LineStrings of either byte order, with or without a spatial reference; null for anything else."""
    ship(SparkSession.active())
    vertex = T.StructType().add("lon", T.DoubleType()).add("lat", T.DoubleType())
    return F.arrow_udf(_read_wkb, T.ArrayType(vertex))(wkb)


def _write_wkb(lines: pa.Array) -> pa.Array:
    lines = lines if isinstance(lines, pa.ListArray) else lines.combine_chunks()
    starts, ends = (np.asarray(lines.offsets)[k : k + len(lines)] for k in (0, 1))
    xy = np.stack([np.asarray(pc.struct_field(lines.values, f).to_numpy(zero_copy_only=False)) for f in ("lon", "lat")], axis=1)
    body = xy.astype(">f8").tobytes()
    whole = np.concatenate([[0], np.cumsum(np.isnan(xy).any(axis=1))])
    bad = (ends - starts < 2) | (whole[ends] > whole[starts]) | np.asarray(lines.is_null())
    return pa.array([None if b else _WKB_LINE + int(e - s).to_bytes(4, "big") + body[16 * s : 16 * e] for s, e, b in zip(starts.tolist(), ends.tolist(), bad.tolist(), strict=True)], pa.binary())


#: Big-endian mark and the type number of a LineString; flags of the extended form for a spatial reference and for Z and M.
_WKB_LINE = b"\x00\x00\x00\x00\x02"
_WITH_SRID = 0x20000000


def _read_wkb(lines: pa.Array) -> pa.Array:
    offsets, parts, ok = [0], [], []
    for line in lines.to_pylist():
        xy = _vertices(line) if line is not None else None
        ok.append(xy is not None)
        parts.append(xy if xy is not None else np.empty((0, 2)))
        offsets.append(offsets[-1] + len(parts[-1]))
    flat = np.concatenate(parts) if parts else np.empty((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points, mask=pa.array([not x for x in ok]))


def _vertices(line: bytes) -> np.ndarray | None:
    if len(line) < 9 or line[0] > 1:
        return None
    order = "little" if line[0] else "big"
    kind, at = int.from_bytes(line[1:5], order), 5
    if kind & _WITH_SRID:
        kind, at = kind & ~_WITH_SRID, 9
    n = int.from_bytes(line[at : at + 4], order)
    if kind != 2 or n < 2 or len(line) != at + 4 + 16 * n:
        return None
    return np.frombuffer(line, ">f8" if order == "big" else "<f8", 2 * n, at + 4).astype("f8").reshape(n, 2)
