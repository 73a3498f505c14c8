"""Near-duplicates by word shingles: candidates from MinHash bands and SimHash, each verified by its exact Jaccard similarity.

A text is the set of its word shingles (64-bit hashes). Texts of equal words are one class from the start. Two classes are
candidates if they agree in one of ``BANDS`` bands of ``ROWS`` MinHash values (at a similarity of 0.8 all bands differ with
probability 5e-5) or if their SimHash fingerprints are within the radius; they are linked if the similarity of their sets
is at least ``least``. A component of the links is one near-duplicate class.

No bucket is capped: first every class is verified with the smallest one of each of its buckets. In a bucket whose classes are
not all linked by then, those outside its largest component (probes) are compared with all others of a size that allows the
similarity. This happens inside cells of bounded size, which hold probes and targets with their sets: overlaps of all of a
cell's pairs are counted at once, frequent shingles as bits of words and the others by inverted lists, and a cell
returns a spanning forest of what it links, never its pairs. What is left out joins classes that are linked already, so the
components are those of all candidates.

Defined cases: null text is empty, and empty texts are one class; a text with fewer words than a shingle is one shingle;
rows without a doc_id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, cut, join_spread, parts, release, ship, small_batches, text_or_empty, whole_groups
from .components import components
from .simhash import SEED, fingerprint, link_classes

BANDS, ROWS = 25, 5
#: Texts of an Arrow batch.
TEXTS = 1024
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; one at least."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def bands(h: np.ndarray) -> np.ndarray:
    """A key (signed) for each band of the set's MinHash values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(h), 1 << 12):
        low = np.minimum(low, np.multiply.outer(_MULTIPLIERS, h[a : a + (1 << 12)]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def overlaps(probes: list[np.ndarray], targets: list[np.ndarray], often: int = 64, width: int = 4096) -> np.ndarray:
    """How many hashes each probe shares with each target; all are sorted sets."""
    tokens, column = np.unique(np.concatenate(targets), return_inverse=True)
    owner = np.repeat(np.arange(len(targets), dtype=np.int32), [len(t) for t in targets])
    order = np.argsort(column, kind="stable")
    owner, starts = owner[order], np.searchsorted(column[order], np.arange(len(tokens) + 1))
    lengths = np.diff(starts)
    out = np.zeros((len(probes), len(targets)), np.int32)
    found = []
    for k, p in enumerate(probes):
        at = np.searchsorted(tokens, p)
        at = at[np.take(tokens, at, mode="clip") == p]
        hot = lengths[at] >= often
        found.append(at[hot])
        at = at[~hot]
        n = lengths[at]
        if len(at):
            hits = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[k] = np.bincount(owner[hits], minlength=len(targets))
    frequent = np.flatnonzero(lengths >= often)
    for a in range(0, len(frequent), width):  # frequent hashes as bits: one of targets' words for 64 of them
        some = frequent[a : a + width]
        bits = np.zeros((len(targets), 64 * -(-len(some) // 64)), bool)
        for k, t in enumerate(some.tolist()):
            bits[owner[starts[t] : starts[t + 1]], k] = True
        held = np.packbits(bits, axis=1).view(np.uint64)
        for k, at in enumerate(found):
            own = np.zeros(bits.shape[1], bool)
            own[np.searchsorted(some, at[(at >= some[0]) & (at <= some[-1])])] = True
            out[k] += np.bitwise_count(held & np.packbits(own).view(np.uint64)).sum(axis=1, dtype=np.int32)
    return out


def forest(probes: list[np.ndarray], targets: list[np.ndarray], own: list[int], other: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs (probe, target) that span what the cell links; own and other: the components that they are in already."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    sizes = np.array([len(t) for t in targets])
    for k, (p, shared) in enumerate(zip(probes, overlaps(probes, targets), strict=True)):
        for t in np.flatnonzero(shared / (len(p) + sizes - shared) >= least).tolist():
            a, b = root(own[k]), root(other[t])
            if a != b:
                parent[a] = b
                out.append((k, t))
    return out


def _class(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()))


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, c (of the words), fp, keys, size (of the set): one row for each row of docs that has a doc_id."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            listed, sizes = [], []
            for t in texts:
                x = shingles(t, shingle)
                listed.append(bands(x).tolist())
                sizes.append(len(x))
            cols = [b.column("doc_id"), _signed([_class(t) for t in texts]), _signed([fingerprint(t, shingle) for t in texts]), pa.array(listed, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "c", "fp", "keys", "size"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(alone(run), "doc_id long, c long, fp long, keys array<long>, size int")


def grams(docs: DataFrame, named: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """c, grams: the sets of the classes named (c, distinct)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([_signed([_class(t) for t in texts]), pa.array([shingles(t, shingle).tobytes() for t in texts], pa.binary())], ["c", "grams"])

    ids = classes.join(named, "c").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(ids, "doc_id", "left_semi")
    return rows.select("text").mapInArrow(alone(run), "c long, grams binary")


def sets_of(docs: DataFrame, named: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """grams(), written out; a batch holds whole texts and their sets, both in the JVM and in its worker."""
    with small_batches(docs.sparkSession, TEXTS):
        return cut(grams(docs, named, classes, shingle), "grams")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least this Jaccard similarity, written out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(k).to_pylist() for k in ("x", "y"))
            near = [jaccard(np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64)) >= least for i, j in zip(x, y, strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    pairs = cut(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    found = sets_of(docs, named, classes, shingle)
    one = found.select(F.col("c").alias("a"), F.col("grams").alias("x"))
    two = found.select(F.col("c").alias("b"), F.col("grams").alias("y"))
    small = F.octet_length("x") >= F.octet_length("y") * least  # else the sizes alone forbid it
    large = F.octet_length("y") >= F.octet_length("x") * least
    both = pairs.join(one, "a").join(two, "b").where(small & large).select("a", "b", "x", "y")
    with small_batches(docs.sparkSession, 512):
        out = cut(both.mapInArrow(alone(run), "a long, b long").distinct(), "links")
    release(pairs, found)
    return out


def links(docs: DataFrame, classes: DataFrame, shingle: int, least: float, radius: int) -> DataFrame:
    """classes: c, doc_id, fp, keys, size. Links (a, b) whose components are those of all candidates that are similar enough."""
    band = F.floor(F.log("size") / math.log(1 / least) + 1e-9).cast("int")  # partners are in the same band or in the next
    rows = classes.select("c", band.alias("band"), F.explode("keys").alias("key"))
    full = cut(rows.groupBy("key").agg(F.min("c").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    rows = cut(join_spread(rows, full, ["key"], ["c"]).select("c", "band", "key", "lead"), "buckets")
    release(full)
    marks = classes.groupBy("fp").agg(F.min("c").alias("lead"))
    alike = classes.join(marks, "fp").select(F.col("lead").alias("a"), F.col("c").alias("b"))
    close = link_classes(marks.select("fp"), radius)
    mark = lambda k: marks.select(F.col("fp").alias(k), F.col("lead").alias(f"{k}_lead"))
    close = close.join(mark("a"), "a").join(mark("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    stars = rows.select(F.col("lead").alias("a"), F.col("c").alias("b")).unionByName(alike).unionByName(close)
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = verified(docs, stars, classes, shingle, least)
    roots = components(first)
    named = cut(rows.join(roots, rows.c == roots.node, "left").select("c", "band", "key", F.coalesce("root", "c").alias("root")), "buckets")
    release(rows)
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"), F.sum("n").alias("n")).where("roots > 1")
    mains = cut(main.select("key", F.col("m.root").alias("main"), "n"), "mains")
    mixed = cut(join_spread(named, mains, ["key"], ["c"]), "mixed")
    more = cells(docs, classes, mixed, shingle, least)
    release(named, mains, mixed)
    return first.unionByName(more)


def cells(docs: DataFrame, classes: DataFrame, mixed: DataFrame, shingle: int, least: float) -> DataFrame:
    """mixed: c, band, key, root, main. Links (a, b) between classes outside the main component of a bucket and all others of it.

    A cell holds 512 probes and as many targets of a bucket and size band at most, or some 8 MB of either.
    """
    base = 1 / least
    targets = mixed.select("key", "band", "c", "root")
    probes = mixed.where("root <> main").select("key", "c", "root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    room = F.greatest(F.lit(16.0), F.least(F.lit(512.0), F.lit(float(1 << 20)) / F.pow(F.lit(base), F.col("band") + 1)))
    blocks = lambda n: F.ceil(F.col(n) / room).cast("int")
    count = lambda df, n: df.groupBy("key", "band").agg(F.count("*").alias(n))
    both = count(targets, "nt").join(count(probes, "np"), ["key", "band"]).select("key", "band", "nt", "np", blocks("nt").alias("bt"), blocks("np").alias("bp"))
    both = cut(both, "cells")
    spot = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = join_spread(targets, both.select("key", "band", "bt", "bp", F.col("nt").alias("n")), ["key", "band"], ["c"])
    two = join_spread(probes, both.select("key", "band", "bt", "bp", F.col("np").alias("n")), ["key", "band"], ["c"])
    one = one.select("key", "band", spot("bt").alias("j"), every("bp").alias("i"), "c", "root", F.lit(0).alias("probe"))
    two = two.select("key", "band", spot("bp").alias("i"), every("bt").alias("j"), "c", "root", F.lit(1).alias("probe"))
    dealt = cut(one.unionByName(two), "dealt")
    sets = sets_of(docs, dealt.select("c").distinct(), classes, shingle)
    cell = ["key", "band", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for t in whole_groups(batches, cell):
            cols = [t[k].to_numpy() for k in cell]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = [*np.flatnonzero(new).tolist(), t.num_rows]
            c, root, probe = (t[k].to_numpy() for k in ("c", "root", "probe"))
            a, b = [], []
            for s, e in zip(starts, starts[1:], strict=False):
                held = [np.frombuffer(x, np.uint64) for x in t["grams"][s:e].to_pylist()]
                asks, told = np.flatnonzero(probe[s:e] == 1).tolist(), np.flatnonzero(probe[s:e] == 0).tolist()
                if asks and told:
                    pick = lambda at, s=s: root[s + np.array(at)].tolist()
                    for x, y in forest([held[k] for k in asks], [held[k] for k in told], pick(asks), pick(told), least):
                        a.append(c[s + asks[x]])
                        b.append(c[s + told[y]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = dealt.join(sets, "c").select(*cell, "probe", "c", "root", "grams").repartition(parts(docs.sparkSession), *cell).sortWithinPartitions(*cell)
    with small_batches(docs.sparkSession, 256):
        out = cut(rows.mapInArrow(alone(run), "a long, b long").distinct(), "links")
    release(both, dealt, sets)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, component_id: the smallest doc_id of the near-duplicate class, one row for each row of docs that has a doc_id."""
    with small_batches(docs.sparkSession, TEXTS):
        marks = cut(marked(docs, shingle), "marks")
    classes = cut(marks.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("size").alias("size")), "classes")
    lowest = classes.select("c", "doc_id")
    roots = components(links(docs, classes, shingle, least, radius))
    named = lowest.join(roots, lowest.c == roots.node, "left").select("c", "doc_id", F.coalesce("root", "c").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marks.select("doc_id", "c").join(named.select("c", "root").join(names, "root").select("c", "component_id"), "c").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose class has one of a smaller id; rows without an id stay."""
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
