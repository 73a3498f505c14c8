"""Best-fit packing of documents into token sequences with a grouping genetic algorithm on islands.

Texts become token ids on the executors. A piece is a document, or a cut of a document longer than a sequence. Pieces are
dealt by hash into blocks of bounded size; each block is solved on several islands (one task each). An island holds a
population of packings whose genes are whole bins. Crossover injects well-filled bins of one parent into the other, takes
out the bins that then hold duplicates, and best-fits the documents so displaced. Between epochs every island sends its
elite packing to the next island of its block through a shuffle. An island stops early when it reaches the lower bound.

The search ends early only where no packing can be better: with one bin at most that is not full. A block's least filled
bins, up to an eighth of its pieces, go with those of other blocks into blocks of the next level, until one block is left:
so what a block wastes is packed again among eight times as many pieces, and the last level sees what is left of all.

Defined cases: null text is empty and is the single end id; ties between bins go to the one opened first; repeated rows are
packed as often as they occur, told apart by an occurrence number that only this operator sees; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept, release, ship, text_or_empty

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own output.

    The vocabulary's tokens never cross white space, so a text is the concatenation of its white-space separated words,
    and a word that of its pre-tokens. Words are looked up in a table of bounded size, which a worker keeps for its next
    tasks; what is missing is encoded in one call for all of a batch and split again at the marks that end a word. Words
    with anything but letters, digits and ASCII punctuation go to the tokenizer one by one, as do those with characters
    that normalisation might compose.
    """

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer

        self.tk, self.room = Tokenizer.from_file(path), room
        vocab = self.tk.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Words free of white space; the plain ones are encoded as one text, each ended by a mark of its own."""
        plain = [w for w in words if w.isalpha() and w.isascii() or w.isalpha() and max(w) < "ɐ"]
        out = {}
        for a in range(0, len(plain), 4096):
            some = plain[a : a + 4096]
            ids = np.array(self.tk.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                out |= {w: data[s:e] for w, s, e in zip(some, [0, *cuts], cuts, strict=False)}
            else:  # a word that is more or less than one pre-token
                out |= self._single(some)
        rest = [w for w in words if w not in out]
        return out | self._single(rest)

    def _single(self, words: list[str]) -> dict[str, bytes]:
        found = self.tk.encode_batch_fast(words, add_special_tokens=False)
        return {w: self._pack(e.ids) for w, e in zip(words, found, strict=True)}

    def _apart(self, text: str) -> str:
        """Chunks that the tokenizer would treat one by one, between spaces; lower case and apart from closing marks where that is surely the same."""
        text = text.replace("\n", " ")
        if text.isascii() or _latin(text):
            text = text.lower() + " "
            if not _MARKS.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    def batch(self, texts: list[str]) -> list[bytes]:
        """Words are told apart by Arrow, so that each distinct one of the batch is looked up once; their ids are spliced by position."""
        chunks = pc.split_pattern(pa.array([self._apart(t) for t in texts], pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words, which = pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "), coded.indices.to_numpy()  # words hold no space
        found = list(map(self.words.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if missing:
            extra = self._fresh(missing)
            found = [extra[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        data = np.frombuffer(b"".join(found), "<u4")
        n = size[which]
        ends = np.cumsum(n, dtype=np.int64)
        ids = data[np.repeat((np.cumsum(size, dtype=np.int64) - size)[which] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[chunks.offsets.to_numpy()].tolist()
        return [ids[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)]

    def _fresh(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of words that the table does not hold; their stems and closing marks go into the table while it has room."""
        known, stems = self.words, {}
        for w in missing:  # closing punctuation is a pre-token of its own
            stem = w.rstrip(_TAIL)
            if stem != w and _splits(stem, w[len(stem) :]):
                stems[w] = (stem, w[len(stem) :])
        bare = set(missing).difference(stems).union(*stems.values())
        fresh = self._encode([w for w in bare if w and w not in known]) | {"": b""}
        if len(known) < self.room:
            known |= fresh
        get = lambda x: fresh[x] if x in fresh else known[x]
        return fresh | {w: get(s) + get(p) for w, (s, p) in stems.items()}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Marks that form one pre-token after a letter; none of them takes part in a contraction or a special token.
_TAIL = '.,!?;:%*#$&()"'
#: A full stop or comma before white space whose own pre-token may have begun before it. White space is Unicode's here; Python's \s has U+001C to U+001F too.
_MARKS = re.compile(r"[^\t-\r \x85\xa0a-z0-9\xdf-\xf6\xf8-\xff][.,][\t-\r \x85\xa0]")


def _splits(stem: str, tail: str) -> bool:
    """Whether the tokenizer surely starts a new pre-token between stem and tail."""
    return not tail or not stem or stem[-1].lower()[-1].isalpha()


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document; vocabulary: a tokenizer file, by default the public word-level BPE."""
    ship(docs.sparkSession)
    full = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
        encoder = kept(("packing", path), lambda: Encoder(path))
        end = end_id.to_bytes(4, "little")
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.batch(part.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), full)):
                        one = ids[at : at + full]
                        for c, v in zip(cols, (doc, k, at // 4, len(one) // 4, zlib.crc32(one)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


# -- the genetic algorithm; a packing is a list of bins, a bin a list of item numbers --


def best_fit(order: Iterable[int], size: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts each item into the fullest bin that still takes it."""
    bins = [list(b) for b in bins or []]
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if left > size[i]:
            insort(room, (left - size[i], k))
    return bins


def fills(bins: list[list[int]], size: list[int]) -> list[int]:
    get = size.__getitem__
    return [sum(map(get, b)) for b in bins]


def score(bins: list[list[int]], size: list[int], capacity: int) -> float:
    """Fewer bins first; then the mean of the squared fill, which prefers full bins and few very empty ones."""
    return -len(bins) + sum((x / capacity) ** 2 for x in fills(bins, size)) / max(1, len(bins))


def perfect(bins: list[list[int]], size: list[int], capacity: int) -> bool:
    """No packing is better: at most one bin isn't full."""
    return sum(x < capacity for x in fills(bins, size)) <= 1


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Injects well-filled bins of b into a; bins of a that share an item with them go, and their other items are best-fitted."""
    full = fills(b, size)
    good = sorted(range(len(b)), key=full.__getitem__, reverse=True)[: max(1, len(b) // 2)]
    gift = [b[k] for k in rng.sample(good, rng.randint(1, len(good)))]
    taken = {i for x in gift for i in x}
    stay, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            stay.append(x)
        else:
            loose += [i for i in x if i not in taken]
    return best_fit(sorted(loose, key=size.__getitem__, reverse=True), size, capacity, gift + stay)


def mutate(a: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the least filled bins and a few others, and best-fits their items."""
    full = fills(a, size)
    ranked = sorted(range(len(a)), key=full.__getitem__)
    n = max(1, len(a) // 50)
    gone = {*ranked[:n], *rng.sample(ranked[n:], min(n, len(ranked) - n))}
    loose = sorted((i for k in gone for i in a[k]), key=size.__getitem__, reverse=True)
    return best_fit(loose, size, capacity, [x for k, x in enumerate(a) if k not in gone])


def evolve(size: list[int], capacity: int, seed: int, guests: list[list[list[int]]] = (), generations: int = 6, members: int = 4) -> list[list[int]]:
    """The best packing that an island finds, never worse than best fit by decreasing size; guests are elite packings of other islands."""
    rng = random.Random(seed)
    order = sorted(range(len(size)), key=size.__getitem__, reverse=True)
    people = [(score(p, size, capacity), p) for p in guests or [best_fit(order, size, capacity)]]
    best = max(people, key=lambda x: x[0])[1]
    if perfect(best, size, capacity):
        return best
    while len(people) < members:  # nearly sorted orders: best fit from the large ones on, each with its own noise
        noise = [-x * rng.uniform(0.8, 1.2) for x in size]
        child = best_fit(sorted(order, key=noise.__getitem__), size, capacity)
        people.append((score(child, size, capacity), child))
    for _ in range(generations):
        people.sort(key=lambda x: -x[0])
        if perfect(people[0][1], size, capacity):
            break
        x, y = rng.sample(range(len(people)), 2)
        child = crossover(people[min(x, y)][1], people[max(x, y)][1], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        people = [*people[: members - 1], (score(child, size, capacity), child)]
    return max(people, key=lambda x: x[0])[1]


def _number(packing: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            out[i] = k
    return out


def _bins(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return out


def solve(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """items: block long, item (any), length. Returns block, item, bin int, offset long, fill long: the best packing of each block."""
    ship(items.sparkSession)
    kind = dict(items.dtypes)["item"]
    blocks = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("length"), F.col("item")))).alias("items"))
    state = blocks.select("block", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), "items", F.lit(None).cast("array<array<int>>").alias("guests"))

    def run(epoch: int):
        def go(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in batches:
                sizes = b.column("sizes").to_pylist()
                found, scores = [], []
                for s, block, island, guests in zip(sizes, b.column("block").to_pylist(), b.column("island").to_pylist(), b.column("guests").to_pylist(), strict=True):
                    p = evolve(s, capacity, hash((block, island, epoch)), [_bins(g) for g in guests or []])
                    found.append(_number(p, len(s)))
                    scores.append(score(p, s, capacity))
                yield pa.RecordBatch.from_arrays([b.column("block"), b.column("island"), pa.array(found, pa.list_(pa.int32())), pa.array(scores, pa.float64())], ["block", "island", "bins", "score"])

        return go

    out = None
    for epoch in range(epochs):
        sized = state.select("block", "island", F.transform("items", lambda x: x["length"]).alias("sizes"), "guests")
        out = sized.repartition("block", "island").mapInArrow(run(epoch), "block long, island int, bins array<int>, score double")
        if epoch + 1 < epochs:
            out = cut(out, "elite")
            elite = out.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "bins").unionByName(out.select("block", "island", "bins"))
            elite = elite.groupBy("block", "island").agg(F.collect_list("bins").alias("guests"))
            state = state.drop("guests").join(elite, ["block", "island"])
    best = out.groupBy("block").agg(F.max_by("bins", F.struct("score", F.negative("island").alias("x"))).alias("bins"))
    rows = blocks.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("z"))
    rows = rows.select("block", F.col("z.items.item").alias("item"), F.col("z.items.length").alias("length"), F.col("z.bins").alias("bin"))
    packed = rows.groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("s"), F.sum("length").alias("fill"))
    at = F.transform("s", lambda x, i: F.struct(x["item"].alias("item"), F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("offset"), x["length"].alias("length")))
    return packed.select("block", "bin", "fill", F.explode(at).alias("z")).select("block", F.col("z.item").cast(kind).alias("item"), "z.length", "bin", "z.offset", "fill")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, block_size: int = 4000, islands: int = 3, epochs: int = 3, fan_in: int = 8) -> DataFrame:
    """Adds sequence_id long and offset long to pieces(docs)."""
    all_pieces = cut(pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = all_pieces.where(F.col("length") == capacity).select(F.col("row").alias("item"), F.lit(0).alias("level"), F.col("row").alias("block"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = all_pieces.where(F.col("length") < capacity).select(F.col("row").alias("item"), "length")
    blocks, level, done = max(1, -(-rest.count() // block_size)), 1, [whole]
    while True:
        items = rest.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block"), "item", "length")
        solved = cut(solve(items, capacity, islands, epochs), "packed")
        place = lambda d, n=level: d.select("item", F.lit(n).alias("level"), "block", "bin", "offset")
        if blocks == 1:
            done.append(place(solved))
            break
        # a block's least filled bins go on, as far as they hold its share of the next level; a block has a bounded number of bins
        bins = solved.where(F.col("fill") < capacity).groupBy("block", "bin").agg(F.min("fill").alias("fill"), F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("block").orderBy("fill", "bin").rowsBetween(Window.unboundedPreceding, -1))
        chosen = bins.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("n") <= F.greatest("n", F.lit(block_size // fan_in)))
        marked = solved.join(chosen.select("block", "bin", F.lit(True).alias("loose")), ["block", "bin"], "left")
        done.append(place(marked.where(F.col("loose").isNull())))
        rest, level, blocks = marked.where("loose").select("item", "length"), level + 1, -(-blocks // fan_in)
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    sequence = F.when(F.col("level") == 0, F.col("block") * 64).otherwise((F.col("block") * 65536 + F.col("bin")) * 64 + F.col("level"))
    return all_pieces.join(placed.select(F.col("item").alias("row"), sequence.alias("sequence_id"), "offset"), "row").drop("row")
