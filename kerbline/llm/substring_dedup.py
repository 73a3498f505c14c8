"""Exact substring deduplication with longest-previous-factor arrays over a partitioned suffix order.

A byte goes if a string of L bytes that covers it also starts earlier in the corpus (smaller doc_id, or the same document
and an earlier start). With LPF[i] the longest match of position i with an earlier one, these are the L bytes from every i
with LPF[i] >= L. LPF comes from suffix order: the nearest entries before and after i there whose positions are smaller
(previous and next smaller positions) hold the longest earlier match.

No suffix array of the whole corpus is needed, because only positions that agree for L bytes matter:

1. Every window of L bytes is assigned to the k-gram in it with the smallest hash, the leftmost if equal. The choice
   depends on the window's bytes alone, so equal windows meet at equal k-grams (anchors), at the same offset. A run of
   windows with one anchor is a context; about one row for 35 bytes is shuffled, never the windows themselves.
2. A row holds its anchor's hash and a digest of its context. All but the first of the contexts that agree in both are
   marked at once: within a batch before the shuffle, so what a third of all documents holds sends one row a batch to its
   key, and across batches where an anchor's rows meet. Exact copies end here.
3. Anchors with several different contexts get their bytes, one representative each. There the suffixes at all window
   starts are sorted, and LPF by previous and next smaller positions marks what repeats.
4. Beyond ``split`` different contexts (a large group of near copies) an anchor's windows are dealt by digests of their own
   instead, equal ones of a batch as one, so neither a task's rows nor its memory grow with the group.

A mark carries a digest of the bytes it removes, which is checked before they go.

Defined cases: null text is empty and shorter texts than L keep all; a document without a doc_id takes no part and keeps
all; rows that repeat a doc_id with the same text have no earlier start and do not remove one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, ship, text_or_empty, whole_groups

GRAM = 32
#: Bytes that are hashed at once, windows that are sorted at once, and different contexts an anchor's task takes.
SEGMENT, SORTED, SPLIT = 1 << 20, 200_000, 2000
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.int64(-0x61C8864680B583EB)


# -- suffix order and LPF --


def previous_smaller(values: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it with a smaller value (-1: none) and the least lcp on the way there.

    lcp[i] belongs to entries i - 1 and i. All entries jump at once, each over what its last stop has jumped over, so a
    few rounds do; ways on which less than ``least`` is common are given up, with 0.
    """
    at = np.arange(-1, len(values) - 1)
    common = lcp.astype(np.int64)
    if len(values):
        common[0] = 0
    while True:
        on = np.flatnonzero((at >= 0) & (common >= least))
        on = on[values[at[on]] >= values[on]]
        if not len(on):
            break
        stop = at[on]
        at[on], common[on] = at[stop], np.minimum(common[on], common[stop])
    common[(at < 0) | (common < least)] = 0
    return at, common


def longest_previous(suffixes: np.ndarray, place: np.ndarray, least: int = 1) -> np.ndarray:
    """LPF of each suffix (byte strings of equal width): its longest prefix that a suffix of a smaller place begins with.

    Lengths below ``least`` may come out as 0. Equal places are one and the same, so they don't count as earlier.
    """
    n = len(place)
    if not n:
        return np.zeros(0, np.int64)
    width = suffixes.dtype.itemsize
    order = np.argsort(suffixes, kind="stable")
    letters = np.frombuffer(suffixes[order].tobytes(), np.uint8).reshape(n, width)
    lcp = np.zeros(n, np.int64)
    differ = letters[1:] != letters[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    ranked = place[order]
    _, before = previous_smaller(ranked, lcp, least)
    _, after = previous_smaller(ranked[::-1], np.append(0, lcp[:0:-1]), least)
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


# -- anchors --


class Hasher:
    """Rolling hashes of k-grams of a buffer, by prefix sums modulo 2**64."""

    def __init__(self, gram: int, room: int):
        self.gram = gram
        inv = pow(_BASE, -1, 1 << 64)
        self.up, self.down = (np.ones(room, np.uint64) for _ in range(2))
        np.multiply.accumulate(np.full(room - 1, _BASE, np.uint64), out=self.up[1:])
        np.multiply.accumulate(np.full(room - 1, inv, np.uint64), out=self.down[1:])

    def grams(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


_HASHERS: dict = {}


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(a)
    full = -(-n // w) * w
    x = np.full(full, np.iinfo(a.dtype).max, a.dtype)
    x[:n] = a
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).reshape(-1)
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors_of(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(number of the text, hash, first window, anchor's offset from it, windows) of every run of windows with one anchor."""
    w = length - gram + 1
    if (gram, length) not in _HASHERS:
        _HASHERS[gram, length] = Hasher(gram, 2 * SEGMENT + 2 * length)
    hasher = _HASHERS[gram, length]
    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        buf = np.frombuffer(b"".join([x for _, _, x in held]), np.uint8)
        h = hasher.grams(buf)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, w) & _PLACE).astype(np.int64)
        size = np.array([len(x) for _, _, x in held], np.int64)
        begin = size.cumsum() - size
        ok = np.zeros(len(buf) + 1, np.int32)
        np.add.at(ok, begin, 1)
        np.add.at(ok, begin + size - length + 1, -1)
        p = np.flatnonzero(ok.cumsum()[: len(at)])
        a = at[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(p)))
        lo = p[first]
        seg = np.searchsorted(begin, lo, side="right") - 1
        doc, base = np.array([d for d, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)
        out.append((doc[seg], h[a[first]].view(np.int64), lo - begin[seg] + base[seg], a[first] - lo, n))
        held.clear()

    total = 0
    for d, t in enumerate(texts):
        for base in range(0, max(0, len(t) - length + 1), SEGMENT):
            part = t[base : base + SEGMENT + length - 1]
            held.append((d, base, part))
            total += len(part)
            if total >= SEGMENT:
                flush()
                total = 0
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(5))


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _digest(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _runs(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch; those of a document stand together, by start."""
    if not len(doc):
        return doc, s, e
    change = np.append(False, doc[1:] != doc[:-1])
    lift = np.cumsum(change) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + lift) - lift
    new = change.copy()
    new[0] = True
    new[1:] |= s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], s[first], reach[np.append(first[1:], len(doc)) - 1]


# A place is (start, offset of the anchor, windows, 0) of a context or (start, length, 1) of a mark, in one long.
_ROW = (1 << 15, 1 << 8, 2)


def anchors(base: DataFrame, length: int) -> DataFrame:
    """h, digest, doc_id, place: a row for each different context of a batch, and marks of what repeats within it."""
    many, few, two = _ROW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = _binary(b.column("text"))
            doc, h, lo, off, n = anchors_of(texts, length)
            ends = lo + n - 1 + length
            digest = np.fromiter((xxhash.xxh64_intdigest(texts[d][x:y]) for d, x, y in zip(doc.tolist(), lo.tolist(), ends.tolist(), strict=True)), np.uint64, len(doc)).view(np.int64)
            ids = b.column("doc_id").to_numpy()[doc] if len(doc) else doc
            if ((ids[1:] < ids[:-1]) | (ids[1:] == ids[:-1]) & (lo[1:] < lo[:-1])).any():
                by_id = np.lexsort((lo, ids))
                doc, h, lo, off, n, ends, digest, ids = (x[by_id] for x in (doc, h, lo, off, n, ends, digest, ids))
            with np.errstate(over="ignore"):
                order = np.argsort(h + digest * _MIX, kind="stable")
            same = np.zeros(len(h), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (digest[order][1:] == digest[order][:-1])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            lead = order[start]
            again = order[same & ((ids[order] != ids[lead]) | (lo[order] != lo[lead]))]
            first = np.sort(order[~same])
            again.sort()
            at, s, e = _runs(doc[again], lo[again], ends[again])
            own = b.column("doc_id").to_numpy()[at] if len(at) else at
            marks = np.array([_digest(texts[d][x:y]) for d, x, y in zip(at.tolist(), s.tolist(), e.tolist(), strict=True)], np.int64)
            place = np.concatenate([lo[first] * many + off[first] * few + n[first] * two, (s << 32) + (e - s) * two + 1])
            with np.errstate(over="ignore"):
                cols = (np.concatenate([h[first], (own + s * _MIX) * _MIX]), np.concatenate([digest[first], marks]), np.concatenate([ids[first], own]), place)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["h", "digest", "doc_id", "place"])

    return base.select("doc_id", "text").mapInArrow(run, "h long, digest long, doc_id long, place long")


def first_contexts(found: DataFrame, length: int, split: int) -> DataFrame:
    """doc_id, and either s, size, digest of a mark or a place to look at: start, offset, windows and whether to split."""
    many, few, two = _ROW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for t in whole_groups(batches, ["h"]):
            h, digest, ids, place = (t[c].to_numpy() for c in ("h", "digest", "doc_id", "place"))
            mark = place % 2 == 1
            out = [(ids[mark], place[mark] >> 32, (place[mark] & 0xFFFFFFFF) >> 1, digest[mark], np.zeros(mark.sum(), np.int64))]
            h, digest, ids, place = (x[~mark] for x in (h, digest, ids, place))
            new_h, new = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new[1:] = new_h[1:] | (digest[1:] != digest[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = ~new & ((ids != ids[start]) | (place != place[start]))
            size = place % many % few // two - 1 + length
            out.append((ids[again], place[again] // many, size[again], digest[again], np.zeros(again.sum(), np.int64)))
            group = np.cumsum(new_h) - 1
            kinds = np.bincount(group, new, int(group[-1]) + 1 if len(group) else 0).astype(np.int64)
            ask = new & (kinds[group] > 1) if len(group) else new
            many_kinds = (kinds[group][ask] > split).astype(np.int64) if len(group) else np.zeros(0, np.int64)
            out.append((ids[ask], place[ask], np.zeros(ask.sum(), np.int64), digest[ask], 1 + many_kinds))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(cols, (np.int64, np.int64, np.int64, np.int64, np.int8), strict=True)], ["doc_id", "s", "size", "digest", "kind"])

    dealt = found.repartition(parts(found.sparkSession), "h").sortWithinPartitions("h", "digest", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id long, s long, size long, digest long, kind byte")


# -- contexts, and LPF among those of one anchor --

_ASKED = ["h", "doc_id", "lo", "off", "size", "digest", "bytes"]
_ASKED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
_WINDOW, _MARK = -1, -2


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """rows: doc_id, text, places (place, kind). A row for each context asked for, or for each different window of a split one."""
    many, few, two = _ROW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out: list[tuple] = []
                windows: dict[tuple[int, int], tuple[int, int]] = {}
                gone: list[tuple[int, int, bytes]] = []
                order = np.argsort(part.column("doc_id").to_numpy(), kind="stable")
                part = part.take(pa.array(order))
                for doc, t, places in zip(part.column("doc_id").to_pylist(), _binary(part.column("text")), part.column("places").to_pylist(), strict=True):
                    for p in sorted(places, key=lambda p: p["s"]):
                        lo, off, n = p["s"] // many, p["s"] % many // few, p["s"] % few // two
                        bytes_ = t[lo : lo + n - 1 + length]
                        if len(bytes_) != n - 1 + length:  # a row of the same doc_id
                            continue
                        if p["kind"] == 1:
                            out.append((_digest(bytes_[off : off + GRAM]), doc, lo, off, len(bytes_), 0, bytes_))
                            continue
                        for k in range(n):
                            w = bytes_[k : k + length]
                            key = (xxhash.xxh3_64_intdigest(w), _digest(w))
                            if windows.setdefault(key, (doc, lo + k)) != (doc, lo + k):
                                gone.append((doc, lo + k, w))
                for (h, digest), (doc, lo) in windows.items():
                    out.append((h - (1 << 64) if h >> 63 else h, doc, lo, _WINDOW, length, digest, None))
                for doc, s, w in gone:
                    out.append((int(np.int64((doc * 1_000_003 + s) & 0x7FFFFFFFFFFFFFFF)), doc, s, _MARK, length, _digest(w), None))
                cols = list(zip(*out, strict=True)) or [()] * len(_ASKED)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _ASKED_TYPES, strict=True)], _ASKED)

    return rows.mapInArrow(run, "h long, doc_id long, lo long, off int, size long, digest long, bytes binary")


def marked(t: pa.Table, length: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, start, size, digest) of what is to go; t: whole anchor groups of contexts, by h, doc_id and lo."""
    h, doc, lo = (t[c].to_numpy() for c in ("h", "doc_id", "lo"))
    data = t["bytes"].to_pylist()
    n = t["size"].to_numpy() - length + 1
    edges = np.flatnonzero(np.append(True, h[1:] != h[:-1])).tolist() + [len(h)] if len(h) else [0]
    out: list[tuple[int, int, int, int]] = []

    def sort(first: int, last: int) -> None:
        """LPF among the windows of the contexts from first on; windows of different anchors differ, so many groups go at once."""
        count = n[first:last]
        row = np.repeat(np.arange(first, last), count)
        step = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
        size = count - 1 + length
        buf = np.frombuffer(b"".join(data[first:last]), np.uint8)
        starts = np.repeat(size.cumsum() - size, count) + step
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[starts]).view(f"S{length}").reshape(-1)
        at, ids = lo[row] + step, doc[row]
        order = np.lexsort((at, ids))
        new = np.zeros(len(row), np.int64)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (at[order][1:] != at[order][:-1])
        place = np.empty(len(row), np.int64)
        place[order] = new.cumsum()
        gone = np.flatnonzero(longest_previous(suffixes, place, length) >= length)
        runs, s, e = _runs(row[gone], at[gone], at[gone] + length)
        for r, x, y in zip(runs.tolist(), s.tolist(), e.tolist(), strict=True):
            out.append((int(doc[r]), x, y - x, _digest(data[r][x - int(lo[r]) : y - int(lo[r])])))

    first, held = 0, 0
    for a, b in zip(edges, edges[1:], strict=False):
        own = int(n[a:b].sum())
        if held and held + own > SORTED:
            sort(first, a)
            first, held = a, 0
        held += own
    if held:
        sort(first, len(h))
    return out


def same_windows(h: np.ndarray, digest: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which windows, given by two digests, have an equal one of an earlier place."""
    order = np.lexsort((lo, doc, digest, h))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
    out = np.zeros(len(h), bool)
    out[order] = same & ((doc[order] != doc[lead]) | (lo[order] != lo[lead]))
    return out


def removals(found: DataFrame, length: int) -> DataFrame:
    """doc_id, s, size, digest: marks from contexts() as dealt by their keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.Table] = []
        names = ["doc_id", "s", "size", "digest"]

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            off = t["off"].to_numpy()
            gone = marked(t.filter(pa.array(off >= 0)), length)
            h, doc, lo, size, digest = (t[c].to_numpy()[off < 0] for c in ("h", "doc_id", "lo", "size", "digest"))
            keep = off[off < 0] == _MARK
            keep[~keep] = same_windows(h[~keep], digest[~keep], doc[~keep], lo[~keep])
            cols = list(zip(*gone, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(c, np.int64), x[keep]])) for c, x in zip(cols, (doc, lo, size, digest), strict=True)], names)

        for t in whole_groups(batches, ["h"]):
            held.append(t)
            if sum(x.num_rows for x in held) >= 10_000:
                yield flush()
        if held:
            yield flush()

    dealt = found.repartition(parts(found.sparkSession), "h").sortWithinPartitions("h", "doc_id", "lo")
    return dealt.mapInArrow(run, "doc_id long, s long, size long, digest long")


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def dedup(docs: DataFrame, length: int = 100, split: int = SPLIT) -> DataFrame:
    """doc_id, kept binary, n_bytes, n_removed, n_spans (long), kept_sha256; one row for each row of docs."""
    ship(docs.sparkSession)
    if length <= GRAM or length > GRAM + 94:
        raise ValueError(f"lengths from {GRAM + 1} to {GRAM + 94} bytes")
    ids = "doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")  # a needless alias would keep Spark from reusing the exchange
    text = docs.select(ids, text_or_empty().alias("text"))
    base = text.where(F.col("doc_id").isNotNull())
    # the text moves once: both joins need it dealt by doc_id, and Spark reuses the exchange
    mark = F.struct("s", "size", "digest")
    place = F.struct("s", "kind")
    told = first_contexts(anchors(base, length), length, split).groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == 0, mark)).alias("marks"), F.collect_list(F.when(F.col("kind") > 0, place)).alias("places"))
    rows = base.join(told.select("doc_id", "places"), "doc_id").where(F.size("places") > 0)
    late = removals(contexts(rows.select("doc_id", "text", "places"), length), length).groupBy("doc_id").agg(F.collect_list(mark).alias("late"))
    every = base.join(told.select("doc_id", "marks"), "doc_id", "left").join(late, "doc_id", "left")
    none = F.array().cast("array<struct<s:bigint,size:bigint,digest:bigint>>")
    every = every.select("doc_id", "text", F.concat(F.coalesce("marks", none), F.coalesce("late", none)).alias("gone"))
    every = every.unionByName(text.where(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("gone")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], ([], [], [])
            for t, ranges in zip(_binary(b.column("text")), b.column("gone").to_pylist(), strict=True):
                spans = merged([(r["s"], r["s"] + r["size"]) for r in ranges if _digest(t[r["s"] : r["s"] + r["size"]]) == r["digest"]])
                at, left = 0, []
                for s, e in spans:
                    left.append(t[at:s])
                    at = e
                kept.append(b"".join([*left, t[at:]]) if spans else t)
                for c, v in zip(counts, (len(t), len(t) - len(kept[-1]), len(spans)), strict=True):
                    c.append(v)
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return every.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
