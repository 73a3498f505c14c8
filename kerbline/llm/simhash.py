"""SimHash near-duplicate classes with bit-sliced comparison.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Equal fingerprints are
one class from the start, so copies cost one row. Pairs within a radius r of 64 bits agree in at least two of r + 2 bands,
which gives (r + 2 choose 2) exact lookup keys; nothing within the radius is missed and no bucket is capped. A bucket
beyond ``block`` classes is cut into blocks, and every pair of blocks becomes a cell of its own.

Inside a cell the fingerprints lie in 64 bit planes: plane j holds bit j of all of them, as one wide integer. Comparing one
fingerprint with all others takes one exclusive-or per plane and a carry-save counter of three wide integers (ones, twos,
exceeded); planes on which the cell agrees are skipped, and a fingerprint is abandoned once every lane has exceeded the
radius. Cells return a spanning forest of their links, never all pairs, and components() joins the forests.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; a text with fewer
words than a shingle is one shingle; rows that repeat stay, each with its own line of the result; a null doc_id never
names a component unless no other document is reachable.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, cut, parts, ship, text_or_empty, whole_groups
from .components import components

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; words are runs of bytes other than ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ends = [words[i:] for i in range(shingle)]
    n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*ends, strict=False)), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> list[int]:
    """64 wide integers; bit i of the j-th is bit j of fps[i]."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def forest(fps: np.ndarray, radius: int = 3) -> list[tuple[int, int]]:
    """Links (later, earlier) that span the components of fps (unsigned, distinct) under the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the carry-save counter holds radii up to 3")
    m, full = len(fps), (1 << len(fps)) - 1
    live = [(1 << j, p) for j, p in enumerate(planes(fps)) if p not in (0, full)]
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, f in enumerate(fps.tolist()):
        ones = twos = 0
        gone = (2 << i) - 1  # lanes up to the own one need no look
        for bit, plane in live:
            x = plane ^ full if f & bit else plane
            carry = ones & x
            ones ^= x
            gone |= twos & carry
            twos ^= carry
            if gone == full:
                break
        else:
            if radius < 3:
                gone |= {0: ones | twos, 1: twos, 2: ones & twos}[radius]
            near = full & ~gone
            while near:
                low = near & -near
                near ^= low
                a, b = root(i), root(low.bit_length() - 1)
                parent[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(m) if root(i) != i]


def link_classes(fps: DataFrame, radius: int = 3, block: int = 8192) -> DataFrame:
    """fps: distinct fp (long). Returns links (a, b) whose components are those of all pairs within the radius."""
    ship(fps.sparkSession)
    bands = radius + 2
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(bands)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j]))) for i, j in combinations(range(bands), 2)))
    rows = fps.select("fp", F.posexplode(keys).alias("t", "k"))
    full = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(full, ["t", "k"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", "t"), F.col("nb")).cast("int")
    rows = rows.select("fp", "t", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select("fp", "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cell = ["t", "k", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for t in whole_groups(batches, cell):
            cols = [t[c].to_numpy() for c in cell]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = [*np.flatnonzero(new).tolist(), t.num_rows]
            all_fps, a, b = t["fp"].to_numpy().view(np.uint64), [], []
            for s, e in zip(starts, starts[1:], strict=False):
                group = all_fps[s:e]
                for x, y in forest(group, radius):
                    a.append(int(group[x]))
                    b.append(int(group[y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    dealt = rows.repartition(parts(fps.sparkSession), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(alone(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable over links, one row for each row of docs."""
    marks = cut(fingerprints(docs, shingle), "fingerprints")
    classes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(link_classes(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """docs without the documents whose component has one of a smaller id; rows without an id stay."""
    gone = near_duplicates(docs, shingle, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
