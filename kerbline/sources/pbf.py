"""OSM extracts in the block-wise binary format, read in parallel by ranges of blocks.

The driver reads only the headers between blocks and deals runs of blocks out as partitions; each task unpacks its own blocks.
Numbers of a block are decoded in whole arrays: variable-length integers, then zigzag, then running sums of differences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import ship

SCHEMA = "kind string, id long, lat double, lon double, refs array<bigint>, tags map<string, string>"
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields: integers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field of unknown kind {kind}")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Variable-length integers, one after the other, as unsigned 64-bit."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        more = starts + k <= ends
        out[more] |= (b[starts[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def sums(data: bytes) -> np.ndarray:
    return np.cumsum(signed(packed(data)))


def unpack(blob: bytes) -> bytes:
    """A block's content; ValueError for compressions other than none and zlib."""
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError(f"block of unknown compression: fields {sorted(found)}")


def _tags(keys: np.ndarray, values: np.ndarray, text: list[str]) -> list[tuple[str, str]]:
    return [(text[k], text[v]) for k, v in zip(keys.tolist(), values.tolist(), strict=True)]


def _batch(kind: str, ids, lat, lon, refs, tags) -> pa.RecordBatch:
    n = len(ids)
    cols = [[kind] * n, ids, lat, lon, refs, tags]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)


def block(data: bytes, kinds: frozenset[str] = frozenset({"node", "way"})) -> Iterator[pa.RecordBatch]:
    """Nodes and ways of a block; degrees to nine decimals, as stored."""
    text: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            text = [s.decode() for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k in (19, 20):
            off = int(np.uint64(v).view(np.int64))
            lat0, lon0 = (off, lon0) if k == 19 else (lat0, off)
    degrees = lambda v, off: np.round(1e-9 * (off + scale * v), 9)
    for group in groups:
        nodes, ways = [], []
        for k, v in fields(group):
            if k == 2 and "node" in kinds:
                yield _dense(dict(fields(v)), text, degrees, lat0, lon0)
            elif k == 1 and "node" in kinds:
                nodes.append(dict(fields(v)))
            elif k == 3 and "way" in kinds:
                ways.append(dict(fields(v)))
        none = np.empty(0, np.uint64)
        tags = lambda m: _tags(packed(m[2]), packed(m[3]), text) if 2 in m else _tags(none, none, text)
        if nodes:
            ids, lat, lon = (signed(np.array([m[k] for m in nodes], np.uint64)) for k in (1, 8, 9))
            yield _batch("node", ids, degrees(lat, lat0), degrees(lon, lon0), None, [tags(m) for m in nodes])
        if ways:
            ids = np.array([m[1] for m in ways], np.uint64).view(np.int64)
            yield _batch("way", ids, None, None, [sums(m.get(8, b"")) for m in ways], [tags(m) for m in ways])


def _dense(m: dict, text: list[str], degrees, lat0: int, lon0: int) -> pa.RecordBatch:
    ids, lat, lon = (sums(m.get(k, b"")) for k in (1, 8, 9))
    told = packed(m.get(10, b"")).tolist()
    tags: list[list[tuple[str, str]]] = [[] for _ in range(len(ids))]
    n = at = 0
    while at < len(told):  # key and value numbers of each node, ended by a zero
        if told[at] == 0:
            n, at = n + 1, at + 1
        else:
            tags[n].append((text[told[at]], text[told[at + 1]]))
            at += 2
    return _batch("node", ids, degrees(lat, lat0), degrees(lon, lon0), None, tags)


@dataclass
class Range(InputPartition):
    path: str
    blocks: list[tuple[int, int]]


def data_blocks(path: str) -> Iterator[tuple[int, int]]:
    """Places and sizes of a file's data blocks; the blocks themselves are skipped."""
    with open(path, "rb") as f:
        while head := f.read(4):
            told = dict(fields(f.read(int.from_bytes(head, "big"))))
            if told[1] == b"OSMData":
                yield f.tell(), told[3]
            f.seek(told[3], 1)


class PbfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"].removeprefix("file://"), int(options.get("split", 32 << 20))
        self.kinds = frozenset(options.get("kinds", "node,way").split(","))

    def partitions(self) -> list[InputPartition]:
        out, some, size = [], [], 0
        for at, n in data_blocks(self.path):
            some.append((at, n))
            size += n
            if size >= self.split:
                out.append(Range(self.path, some))
                some, size = [], 0
        return [*out, Range(self.path, some)] if some else out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with open(partition.path, "rb") as f:
            for at, n in partition.blocks:
                f.seek(at)
                yield from block(unpack(f.read(n)), self.kinds)


class Pbf(DataSource):
    """Nodes and ways of an extract. Options: path; kinds, what to unpack (node,way); split, the bytes of blocks that a partition reads at least."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def read(spark: SparkSession, path: str, kinds: str = "node,way", split: int = 32 << 20) -> DataFrame:
    """kind, id, lat, lon, refs, tags of the kinds asked for. The file must be on a disk that driver and executors share; elsewhere, whole files are the unit of work."""
    ship(spark)
    if "://" not in path or path.startswith("file://"):
        spark.dataSource.register(Pbf)
        return spark.read.format("osm_pbf").option("split", split).option("kinds", kinds).load(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data, at = content.as_py(), 0
                while at < len(data):
                    size = int.from_bytes(data[at : at + 4], "big")
                    told = dict(fields(data[at + 4 : at + 4 + size]))
                    at += 4 + size
                    if told[1] == b"OSMData":
                        yield from block(unpack(data[at : at + told[3]]), frozenset(kinds.split(",")))
                    at += told[3]

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
