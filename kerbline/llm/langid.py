"""Language identification by unigram pieces with every segmentation summed.

The pieces are a fixed public vocabulary (sentencepiece, 32k); each language has its own probability for each piece. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward
pass over the word's positions gives it without listing the ways. Words are independent, so a text's score is a sum over
its words. The piece probabilities are learnt by expectation-maximisation, whose expected counts come from the same
forward pass and a backward one.

Learning uses a bounded sample: for each of the ``languages`` with most documents at most ``sample_docs`` documents of at
most ``sample_chars`` characters, those whose hashed ids are smallest. Prediction covers every word of every text. A word is a run of letters in lower case;
runs beyond 32 letters are scored as consecutive parts of 32.

Defined cases: text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learnt. A null
doc_id counts as held out. Languages that tie go to the smaller name. Rows that repeat give rows that repeat; of a repeated
doc_id the smallest text is learnt from. predict() replaces columns of the names it adds, keep_known() changes none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, kept, ship

MARK = "▁"
PART = 32
#: Words whose lattices are held at once.
SLICE = 16_384
_RUNS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIXES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_BITS = 18


class Pieces:
    """The vocabulary as a table from substring hashes to piece numbers; the last two numbers are 'none' and 'unknown letter'."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if 0 < len(p) <= 16 and p == p.lower() and _RUNS.fullmatch(p.removeprefix(MARK) or "a")})
        self.none, self.size = len(self.pieces), len(self.pieces) + 2
        self.kind = np.int16 if self.size < 1 << 15 else np.int32
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        left, self.tables = np.arange(len(hashes)), []
        for mix in _MIXES:  # what collides in one table goes to the next
            slot = (hashes[left] * mix) >> np.uint64(64 - _BITS)
            keys, ids = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, self.none, self.kind)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], ids[slot[first]] = hashes[left[first]], left[first]
            self.tables.append((mix, keys, ids))
            left = np.delete(left, first)
            if not len(left):
                break
        if len(left):
            raise ValueError("the vocabulary needs a larger table")
        self.powers = np.ones(PART + 2, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(self.powers)):
                self.powers[i] = self.powers[i - 1] * _BASE

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.none, self.kind)
        for mix, keys, ids in self.tables:
            slot = (h * mix) >> np.uint64(64 - _BITS)
            out = np.where(keys[slot] == h, ids[slot], out)
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Order and lengths of the words, longest first, and for each span (start, end) the piece of each word long enough."""
        marked = [MARK + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        order = np.argsort(-size, kind="stable")
        width = int(size.max(initial=1))
        codes = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join([marked[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = size[order]
        codes[np.arange(width)[None, :] < size[:, None]] = flat + np.uint64(1)
        prefix = np.zeros((width + 1, len(words)), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j]
        spans = []
        for e in range(1, width + 1):
            n = int(np.searchsorted(-size, -e, side="right"))
            for s in range(max(0, e - self.longest), e):
                ids = self.find(prefix[e, :n] - prefix[s, :n] * self.powers[e - s])
                if e - s == 1:
                    ids[ids == self.none] = self.none + 1
                spans.append((s, e, ids))
        return order, size, spans

    def forward(self, size: np.ndarray, spans: list, p: np.ndarray) -> np.ndarray:
        a = np.zeros((int(size.max(initial=1)) + 1, len(size), p.shape[1]))
        a[0] = 1
        for s, e, ids in spans:
            a[e, : len(ids)] += a[s, : len(ids)] * p[ids]
        return a

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of each word's probability in each language."""
        out = np.zeros((len(words), p.shape[1]))
        for at in range(0, len(words), SLICE):
            order, size, spans = self.lattice(words[at : at + SLICE])
            a = self.forward(size, spans, p)
            out[at + order] = np.log(a[size, np.arange(len(size))] + 1e-300)
        return out

    def learn(self, words: list[str], counts: np.ndarray, rounds: int = 4, smooth: float = 0.05, unknown: float = 1e-7) -> np.ndarray:
        """Piece probabilities by language from counts (words x languages)."""
        parts = [(self.lattice(words[at : at + SLICE]), counts[at : at + SLICE]) for at in range(0, len(words), SLICE)]
        p = np.full((self.size, counts.shape[1]), 1 / max(1, self.none))
        p[self.none], p[self.none + 1] = 0, unknown
        for _ in range(rounds):
            seen = np.zeros_like(p)
            for (order, size, spans), n_words in parts:
                at = np.arange(len(size))
                a = self.forward(size, spans, p)
                b = np.zeros_like(a)
                b[size, at] = 1
                for s, e, ids in reversed(spans):
                    b[s, : len(ids)] += b[e, : len(ids)] * p[ids]
                weight = n_words[order] / np.maximum(a[size, at], 1e-300)
                for s, e, ids in spans:
                    n = len(ids)
                    new = a[s, :n] * b[e, :n] * p[ids] * weight[:n]
                    for k in range(p.shape[1]):
                        seen[:, k] += np.bincount(ids, new[:, k], self.size)
            kept = seen[: self.none] + smooth
            p[: self.none] = kept / kept.sum(axis=0) * (1 - unknown)
        return p


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, cut into parts of bounded length."""
    return [w[i : i + PART] for w in _RUNS.findall(text.lower()) for i in range(0, len(w), PART)]


class Model:
    def __init__(self, langs: list[str], pieces: Pieces, p: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.p, self.prior, self.uid = langs, pieces, p, prior, uuid.uuid4().hex

    def scorer(self) -> Scorer:
        return kept(("langid", self.uid), lambda: Scorer(self))


class Scorer:
    """Looks words up in a table of bounded size and scores what is missing of a whole batch at once."""

    def __init__(self, model: Model, room: int = 400_000):
        self.m, self.room = model, room
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, len(model.langs)))

    def chunks(self, texts: list[str]) -> list[list[str]]:
        return [t.lower().replace(".", " ").replace(",", " ").split() for t in texts]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (texts x languages), and whether a text has a letter."""
        split = self.chunks(texts)
        found = [list(map(self.rows.get, ws)) for ws in split]
        holes = []
        for ws, rows in zip(split, found, strict=True):
            at, own = -1, []
            for _ in range(rows.count(None)):
                at = rows.index(None, at + 1)
                own.append(at)
            holes.append(own)
        missing = list({ws[i] for ws, own in zip(split, holes, strict=True) for i in own})
        runs = [[w] if len(w) <= PART and w.isalpha() else words_of(w) for w in missing]
        flat = [w for r in runs for w in r]
        score = np.vstack([np.zeros((1, len(self.m.langs))), self.m.pieces.score(flat, self.m.p)]).cumsum(axis=0)
        ends = np.cumsum([len(r) for r in runs], dtype=np.int64) if runs else np.zeros(0, np.int64)
        new = score[ends] - score[ends - np.array([len(r) for r in runs], np.int64)] if runs else np.zeros((0, len(self.m.langs)))
        base = len(self.values)
        fresh = {w: base + i for i, w in enumerate(missing)}
        values = np.vstack([self.values, new])
        for ws, rows, own in zip(split, found, holes, strict=True):
            for i in own:
                rows[i] = fresh[ws[i]]
        size = np.array([len(r) for r in found], np.int64)
        picked = values[np.fromiter((i for r in found for i in r), np.int64, int(size.sum()))]
        total = np.vstack([np.zeros((1, picked.shape[1])), picked.cumsum(axis=0)])
        ends = size.cumsum()
        if base < self.room:
            self.rows |= fresh
            self.values = values
        out = total[ends] - total[ends - size]
        return out, (out != 0).any(axis=1)


def sample(docs: DataFrame, sample_docs: int, sample_chars: int, languages: int) -> DataFrame:
    """lang, text of the bounded sample to learn from, one row a document: never a held-out document."""
    ids = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & (F.char_length("text") <= sample_chars) & F.col("text").rlike(r"\p{L}"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.select("doc_id", "lang").withColumn("rn", F.dense_rank().over(w)).where(F.col("rn") <= sample_docs).select("doc_id", "lang").distinct()
    known = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    ids = ids.join(F.broadcast(known), "lang", "left_semi")
    few = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most sample_docs x languages rows of two columns
    return few.where(F.char_length("text") <= sample_chars).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, sample_docs: int = 200, sample_chars: int = 20_000, languages: int = 200, vocabulary: str | None = None) -> Model | None:
    """None if no document can be learnt from."""
    import public_tokenizers
    import sentencepiece

    rows = sample(docs.select("doc_id", "lang", "text"), sample_docs, sample_chars, languages).collect()  # bounded by the three parameters
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = Pieces([sp.id_to_piece(i) for i in range(sp.get_piece_size())])
    seen: dict[str, np.ndarray] = {}
    prior = np.zeros(len(langs))
    for r in rows:
        k = langs.index(r["lang"])
        prior[k] += 1
        for w in words_of(r["text"]):
            if w not in seen:
                seen[w] = np.zeros(len(langs))
            seen[w][k] += 1
    words = sorted(seen)
    return Model(langs, pieces, pieces.learn(words, np.array([seen[w] for w in words])), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, all columns, with lang_pred and score; no row moves."""
    spark = docs.sparkSession
    ship(spark)
    old = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*old)
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages numbers, whatever the input's size
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                sums, letters = m.scorer().batch([t or "" for t in part.column("text").to_pylist()])
                sums = sums + m.prior
                best = sums.argmax(axis=1)
                score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], [*old, "lang_pred", "score"])

    return docs.mapInArrow(run, shape)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, learnt from its rows that are not held out."""
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), learn(docs, **bounds)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, letters: float = 0.75, spare: int = 16, **bounds) -> DataFrame:
    """docs without the documents that have no language of at least that probability, or are hardly in any.

    A document is in a language by its letters: they must be at least a share of all characters but white space, where so
    many ``spare`` characters count as letters that short texts aren't judged by a date or a full stop. Running text of any
    language is well above three quarters; noise, figures and symbol-laden text are below.
    """
    moved, back = aside(docs, "lang_pred", "score")
    shown = F.char_length(F.regexp_replace("text", r"[\s\p{Z}]+", ""))
    enough = F.regexp_count("text", F.lit(r"\p{L}")) + spare >= F.lit(letters) * shown
    return back(predict(moved, learn(docs, **bounds)).where((F.col("lang_pred") != "und") & (F.col("score") >= least) & enough))
