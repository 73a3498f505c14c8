"""Line deduplication by pairwise alignment.

Overlapping documents are found through the hashes of the windows they share, aligned with patience diff, and aligned common
blocks are deleted from the later document (larger doc_id). Three choices keep the work in proportion to the lines:

* A window is as many consecutive lines as reach ``min_chars`` characters, from its first line on or back from its last. The
  lines fix where it ends, so every document with the block has the same windows there, and together they cover the block.
* A window shared by many documents is attributed to the first place that holds it, so a group of n copies makes n - 1 pairs
  and not n squared. Nothing is lost by that: whatever earlier document a block is common with, each of its windows stands
  whole in its first place, in an earlier document too. No window is left out for being frequent.
* What two documents share is already in the rows that meet on the key (both positions), so no other text moves. The rows of
  a frequent window are dealt to several tasks, with its first place sent to each.

Windows of fewer characters are keys only for documents that are no longer than that as a whole.

A pair is aligned in three steps, and only what they align can go. The spine is the longest run of lines that are unique among the
shared ones, in both documents, whose positions increase in both (patience sorting). The other shared lines are dealt to
further increasing runs: first those that lie between two lines of the spine on either side, then those across it, which are
sections that stand in another order, or twice. Each piece of a run that is contiguous in both documents is extended as far
as the documents agree. A block found in this way is deleted if it has at least ``min_chars`` characters, however many
documents hold it; a document all of whose lines are one block goes whole.
``rare`` (none by default) additionally asks a block of fewer than ``min_lines`` lines for a line that at most so many hold.

Defined cases: null text is empty; blank lines never match and stay where lines around them stay; a document without a
doc_id is never changed; rows that repeat a doc_id are treated alike and never matched with one another. dedup() replaces
columns of the names it adds; keep_rest() leaves all columns but text and n_chars as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, aside, cut, join_spread, ship, text_or_empty


def windows(lines: list[str], least: int) -> list[tuple[int, int, int, bool]]:
    """(position, lines, signed key, whether to look it up) of the windows of the non-blank lines."""
    found: dict[tuple[int, int], bool] = {}
    n, sizes = len(lines), list(map(len, lines))
    for p in range(n):
        total, k = 0, 0
        while total < least and p + k < n:
            total += sizes[p + k]
            k += 1
            found[p, k] = total >= least or k == n
        total, k = 0, 0
        while total < least and k <= p:
            total += sizes[p - k]
            k += 1
        if total >= least:
            found[p - k + 1, k] = True
    out = []
    for (p, k), ask in found.items():
        h = xxhash.xxh64_intdigest("\n".join(lines[p : p + k]).encode("utf-8", "surrogatepass"))
        out.append((p, k, h - (1 << 64) if h >> 63 else h, ask))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first number, whose second numbers increase; patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, x) in enumerate(pairs):
        k = bisect_left(tops, x)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[k], piles[k] = x, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Stretches of an alignment that are contiguous in both documents, as positions in the later one."""
    out: list[list[int]] = []
    for k, (p, q) in enumerate(pairs):
        if k and p == pairs[k - 1][0] + 1 and q == pairs[k - 1][1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def runs(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """All pairs, dealt to runs whose positions increase in both documents: a pair goes on the run that ends nearest before it."""
    ends: list[int] = []
    found: list[list[tuple[int, int]]] = []
    for p, q in sorted(pairs, key=lambda x: (x[0], -x[1])):
        k = bisect_left(ends, q)
        if k:
            ends[k - 1] = q
            found[k - 1].append((p, q))
        else:
            ends.insert(0, q)
            found.insert(0, [(p, q)])
    return found


def aligned(pairs: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The spine of a pair of documents, the runs between its lines, and the runs across it."""
    here, there = Counter(p for p, _ in pairs), Counter(q for _, q in pairs)
    spine = increasing(sorted((p, q) for p, q in pairs if here[p] == there[q] == 1))
    at = [p for p, _ in spine]
    inner, across = [], []
    for p, q in pairs.difference(spine):
        k = bisect_left(at, p)
        between = (k == 0 or spine[k - 1][1] < q) and (k == len(at) or p < at[k] and q < spine[k][1])
        (inner if between else across).append((p, q))
    return [spine, *runs(inner), *runs(across)]


def extended(block: list[int], shift: int, pairs: set[tuple[int, int]]) -> list[int]:
    """A block (positions in the later document, shift to the earlier one) as far as the documents agree on either side."""
    first, last = block[0], block[-1]
    while (first - 1, first - 1 + shift) in pairs:
        first -= 1
    while (last + 1, last + 1 + shift) in pairs:
        last += 1
    return list(range(first, last + 1))


def removable(lines: list[str], shared: Iterable[tuple[int, int, int, int]], rare: int | None, min_lines: int, min_chars: int) -> list[list[int]]:
    """Disjoint blocks to delete. lines: the non-blank ones; shared: (position, earlier document, position there, how often it is held)."""
    by_doc: dict[int, set[tuple[int, int]]] = defaultdict(set)
    held: dict[int, int] = defaultdict(int)
    for p, a, q, n in shared:
        by_doc[a].add((p, q))
        held[p] = max(held[p], n)
    out: list[list[int]] = []
    done: set[int] = set()
    for a in sorted(by_doc):
        seen: set[tuple[int, int]] = set()
        for run in aligned(by_doc[a]):
            to = dict(run)
            for piece in blocks(run):
                shift = to[piece[0]] - piece[0]
                if (piece[0], shift) in seen:
                    continue
                b = extended(piece, shift, by_doc[a])
                seen.update((p, shift) for p in b)
                new = [p for p in b if p not in done]
                enough = sum(len(lines[p]) for p in b) >= min_chars and (rare is None or len(b) >= min_lines or any(held[p] <= rare for p in b))
                if new and (enough or len(b) == len(lines)):
                    out.append(new)
                    done.update(new)
    return out


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, pos (among the lines that aren't blank), size, key, ask: the windows of all rows."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = windows([x for x in map(str.strip, text.split("\n")) if x], least)
                ids += [doc] * len(own)
                found += own
            cols = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "pos", "size", "key", "ask"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(alone(run), "doc_id long, pos int, size int, key long, ask boolean")


def dedup(docs: DataFrame, rare: int | None = None, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """docs with text without the deleted blocks (null stays null), and n_lines, n_removed, n_blocks (long)."""
    old = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_blocks")]
    lines = line_keys(docs, max(1, min_chars))
    first = lines.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("key", F.col("f.doc_id").alias("a"), F.col("f.pos").alias("q"), F.col("n").alias("held"), "n"), "windows")
    shared = join_spread(lines.where("ask").drop("ask"), first, ["key"], ["doc_id", "pos"]).where("a < doc_id")
    shared = shared.groupBy(F.col("doc_id").alias("shared_by")).agg(F.collect_list(F.struct("pos", "size", "a", "q", F.col("held").alias("n"))).alias("shared"))
    docs, _ = aside(docs.select(*old), "shared", "shared_by", "whole_text", "n_lines", "n_removed", "n_blocks")
    own, old = old, docs.columns
    rows = docs.join(shared, docs["doc_id"].cast("long") == shared["shared_by"], "left").select(*old, F.col("text").alias("whole_text"), "shared")
    added = "n_lines long, n_removed long, n_blocks long"
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]) + ", " + added

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("whole_text").to_pylist(), b.column("shared").to_pylist()
            counts: tuple[list, list, list] = ([], [], [])
            for i, (t, shared) in enumerate(zip(texts, found, strict=True)):
                whole = (t or "").split("\n")
                real = [k for k, x in enumerate(whole) if x.strip()]
                gone = removable([whole[k].strip() for k in real], ((s["pos"] + k, s["a"], s["q"] + k, s["n"]) for s in shared for k in range(s["size"])), rare, min_lines, min_chars) if shared else []
                drop = {real[p] for x in gone for p in x}
                if len(drop) == len(real) and drop:
                    texts[i] = ""
                elif drop:
                    texts[i] = "\n".join([x for k, x in enumerate(whole) if k not in drop])
                for c, v in zip(counts, (len(real), len(drop), len(gone)), strict=True):
                    c.append(v)
            cols = {c: b.column(c) for c in old} | {"text": pa.array(texts, pa.string())}
            cols |= {k: pa.array(v, pa.int64()) for k, v in zip(("n_lines", "n_removed", "n_blocks"), counts, strict=True)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = rows.mapInArrow(alone(run), shape)
    return out.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(old, own, strict=True)), "n_lines", "n_removed", "n_blocks")


def keep_rest(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, texts deduplicated and n_chars set anew; documents of which nothing is left go."""
    moved, back = aside(docs, "n_lines", "n_removed", "n_blocks")
    out = dedup(moved, **options).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return back(out.withColumns(changed))
