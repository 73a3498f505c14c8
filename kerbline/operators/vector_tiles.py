"""Vector tiles as bytes: clipped geometry as commands, attributes through a dictionary of the layer, one row a tile.

Features are encoded where their tile's rows meet; a tile is one value of the result, so that is as far as it can be spread.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import ship

# Version of the format, its command numbers, the type of lines, wire kinds.
VERSION, MOVE, LINE, LINES = 2, 1, 2, 2


def tiled(segments: DataFrame, zoom: int, extent: int = 4096, buffer: int = 256) -> DataFrame:
    """segments (coords) by the tiles (z, x, y) that their boxes meet, with what is left of their lines there (geometry); rows without geometry are dropped."""
    s = segments.withColumns({f"_{n}": c for n, c in geo.bounds(F.col("coords")).items()})
    s = s.withColumn("x", F.explode(F.sequence(geo.tile_x(F.col("_min_lon"), zoom), geo.tile_x(F.col("_max_lon"), zoom))))
    s = s.withColumn("y", F.explode(F.sequence(geo.tile_y(F.col("_max_lat"), zoom), geo.tile_y(F.col("_min_lat"), zoom))))
    clipped = geo.clipped(F.col("coords"), F.lit(zoom), F.col("x"), F.col("y"), extent, buffer)
    s = s.withColumn("z", F.lit(zoom)).withColumn("geometry", F.explode(F.array(clipped)))  # exploded: else the filter would move below and clip once more
    return s.where(F.size("geometry") > 0).drop("_min_lon", "_min_lat", "_max_lon", "_max_lat", "coords")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def message(k: int, body: bytes) -> bytes:
    return varint(k << 3 | 2) + varint(len(body)) + body


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else ~n << 1 | 1


def commands(legs: Iterable[Mapping]) -> bytes:
    """Legs in whole units as moves and lines; a leg that starts where the one before ended goes on with it, one without length is left out."""
    lines: list[list[tuple[int, int]]] = []
    for leg in legs:
        a, b = (leg["x1"], leg["y1"]), (leg["x2"], leg["y2"])
        if a == b:
            continue
        if lines and lines[-1][-1] == a:
            lines[-1].append(b)
        else:
            lines.append([a, b])
    out, at = bytearray(), (0, 0)
    for line in lines:
        for k, points in ((MOVE, line[:1]), (LINE, line[1:])):
            out += varint(len(points) << 3 | k)
            for p in points:
                out += varint(zigzag(p[0] - at[0])) + varint(zigzag(p[1] - at[1]))
                at = p
    return bytes(out)


def value(v) -> bytes:
    if isinstance(v, bool):
        return varint(7 << 3) + varint(v)
    if isinstance(v, int):
        return varint(5 << 3) + varint(v) if v >= 0 else varint(6 << 3) + varint(zigzag(v))
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return message(1, str(v).encode())


def layer(rows: Iterable[Mapping], name: str, key: str, attributes: list[str], extent: int = 4096) -> tuple[bytes, int]:
    """A tile of one layer and its number of features. Nulls are left out, and so are features whose geometry has no length."""
    values: dict[bytes, int] = {}
    body, n = bytearray(), 0
    for r in rows:
        drawn = commands(r["geometry"])
        if not drawn:
            continue
        tags = b"".join(varint(k) + varint(values.setdefault(value(r[a]), len(values))) for k, a in enumerate(attributes) if r[a] is not None)
        body += message(2, varint(1 << 3) + varint(r[key] % 2**64) + message(2, tags) + varint(3 << 3) + varint(LINES) + message(4, drawn))
        n += 1
    head = varint(15 << 3) + varint(VERSION) + message(1, name.encode())
    tail = b"".join(message(3, a.encode()) for a in attributes) + b"".join(message(4, v) for v in values) + varint(5 << 3) + varint(extent)
    return message(3, head + bytes(body) + tail), n


def encode(rows: DataFrame, name: str, key: str, attributes: list[str], extent: int = 4096) -> DataFrame:
    """rows (z, x, y, geometry, key, attributes): z, x, y, features, tile, for every tile with a row."""
    ship(rows.sparkSession)

    def one(t: pa.Table) -> pa.Table:
        tile, n = layer(sorted(t.to_pylist(), key=lambda r: r[key]), name, key, attributes, extent)
        return t.slice(0, 1).select(["z", "x", "y"]).append_column("features", pa.array([n], pa.int64())).append_column("tile", pa.array([tile], pa.binary()))

    own = rows.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), F.col(key).cast("long").alias(key), *attributes, "geometry")
    return own.groupBy("z", "x", "y").applyInArrow(one, "z int, x long, y long, features long, tile binary")


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Whether a row's box (min_lon, ...) meets another."""
    x0, y0, x1, y1 = box
    return (F.col("max_lon") >= x0) & (F.col("min_lon") <= x1) & (F.col("max_lat") >= y0) & (F.col("min_lat") <= y1)
