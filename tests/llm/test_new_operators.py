"""Spelling variants, Merkle manifest and SentencePiece round trip against brute force, on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import merkle, sentence_pieces, spelling
from kerbline.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, ids binary, path int, place int, n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["reading", "running", "garden", "gardens", "Général", "général", "aaaaaaa", "aaaaaab", "résumées"]

    def typo(w):
        k, at = rng.randrange(4), rng.randrange(len(w))
        return (w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdeéxyz") + w[at + (k == 2) :], w[:at] + w[at : at + 2][::-1] + w[at + 2 :])[k]

    texts = [" ".join(typo(rng.choice(base)) + rng.choice(["", ",", "\n", "1", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "×÷ ×÷×÷×÷", "garden " * 3000, "日本 garden\U0001f600gardén", "x" * 5000, "\x00 \x01garden"]
    docs = [(i, t, ("en", "fr", "de", None)[i % 4 if i % 5 else 0], (None, "s")[i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (None, texts[5], "xx", None, None), (2**40, "é", "en", "-", 1)]
    return [(*d, "w", "k", b"\x01", 1, 2, 3) for d in docs]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- spelling --


def plain_words(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_variants(docs, rows, empty):
    got = spelling.variants(docs).collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[1] is not None for w in want) > 5 and any(w[2] != w[1] is not None for w in want) | any(w[4] > 1 for w in want)
    assert spelling.variants(empty).count() == 0


def test_anagram_keys_lose_no_near_word(spark):
    """Words over two and three letters share keys in large numbers; runs of a letter make the place of an edit ambiguous."""
    words = {"".join(t) for k in (1, 2, 3, 4) for t in itertools.product("ab", repeat=k)} | {"".join(t) for t in itertools.product("aéz", repeat=4)} | {"x" * 300, "x" * 301, "x" * 299 + "y"}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = spelling.near(df).collect()
    want = {(a, b) for a in words for b in words if one_apart(a, b)}
    assert {(r["word"], r["other"]) for r in got} == want and len(got) == len(want)


def test_forms_are_followed_to_the_last(spark):
    chain = [("a" * 6 + "bcdefgh"[:k], 5 ** (k + 1)) for k in range(7)]  # each a letter longer and five times as frequent
    got = {r["word"]: r for r in spelling.roots(spelling.forms(spark.createDataFrame(chain, "word string, n long")))[0].collect()}
    assert all(got[w]["root"] == chain[-1][0] for w, _ in chain) and got[chain[-1][0]]["form"] is None and got[chain[2][0]]["form"] == chain[3][0]
    tie = spark.createDataFrame([("garden", 5), ("gardez", 25), ("gardex", 25)], "word string, n long")
    assert {r["word"]: (r["form"], r["form_n"], r["n_near"]) for r in spelling.forms(tie).collect()} == {"garden": ("gardex", 25, 2), "gardex": (None, None, 2), "gardez": (None, None, 2)}


def test_spelling_joins_are_not_broadcast(spark):
    """A small file of words becomes many rows after the explode, which Spark's sizes do not tell."""
    words = cut(spark.createDataFrame([("garden", 5), ("gardens", 25), ("gardex", 1)], "word string, n long"), "words")
    found = cut(spelling.forms(words), "near")
    linked, _ = spelling.roots(found)
    for df in (spelling.near(words), spelling.forms(words), linked):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], r["root"]) for r in linked.collect()} == {("garden", "gardens"), ("gardens", "gardens"), ("gardex", "gardens")}


# -- Merkle --


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The root, and for each leaf its siblings and a function that folds another hash up."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            steps[i].append((a % 2, level[a ^ 1] if a ^ 1 < len(level) else ""))
        level, at = [h(*level[k : k + 2]) for k in range(0, len(level), 2)], [a // 2 for a in at]
    return level[0], steps


def plain_manifest(rows, tampered):
    trees = {}
    for r in rows:
        d = r[:5]
        leaf = plain_leaf(*d)
        odd = d[0] is not None and d[4] is not None and tampered(d[0])
        trees.setdefault(d[2], []).append(((d[0] is not None, d[0] or 0), leaf, plain_leaf(*d[:4], d[4] + 1) if odd else leaf, d[0]))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for lang in order:
        trees[lang].sort()
        low[lang] = plain_tree([x[1] for x in trees[lang]])
    root, high = plain_tree([low[lang][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for (_, leaf, other, doc), steps in zip(trees[lang], low[lang][1], strict=True):
            folded = other
            for half, sibling in steps + high[k]:
                folded = h(sibling, folded) if half else h(folded, sibling)
            out.append((doc, leaf, low[lang][0], root, "".join(s for _, s in steps + high[k]), folded))
    return out


def seventh(d):
    return zlib.crc32(str(d).encode()) % 7 == 0


def odd():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0


def key(r):
    return tuple(str(x) for x in r)


def test_manifest(docs, rows, empty):
    got = merkle.manifest(docs, tampered=odd()).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows, seventh), key=key)
    assert {r["folded_root"] == r["root"] for r in got} == {True, False}
    assert merkle.manifest(empty).count() == 0
    assert all(r["folded_root"] == r["root"] for r in merkle.manifest(docs).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 255, 256, 257, 511, 513, 700])
def test_trees_of_any_size(spark, n):
    """One language of n rows and another of one row; 256 nodes are a tier."""
    rows = [(i, f"t{i}", "a", "s", 1) for i in range(n)] + [(7, "x", "b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(map(tuple, merkle.manifest(df, tampered=odd()).collect()), key=key) == sorted(plain_manifest(rows, seventh), key=key)


def test_a_single_row_and_many_languages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(1, None, None, None, None)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, schema)).collect()] == plain_manifest(one, seventh)
    many = [(i, "x", None if i == 5 else f"l{i % 1100:x}é", "s", i) for i in range(1500)]  # more trees than are broadcast
    got = merkle.manifest(spark.createDataFrame(many, schema).repartition(4), tampered=odd()).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(many, seventh), key=key)


# -- SentencePiece --


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return sentence_pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))


def test_round_trip(docs, rows, empty, library):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in sentence_pieces.round_trip(docs).collect())
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc is not None, doc or 0, tuple(ids), library.decode(ids)))
    assert got == sorted(want)
    two = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert sorted(r["text"] for r in two) == sorted(x[3] for x in want)
    bare = sentence_pieces.encode(docs, begin=False, end=False).collect()
    assert sum(len(r["ids"]) for r in bare) == 4 * sum(len(x[2]) - 2 for x in want)
    assert sentence_pieces.round_trip(empty).count() == sentence_pieces.decode(sentence_pieces.encode(empty)).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_encoding_equals_the_library(model, library, monkeypatch, stretch):
    monkeypatch.setattr(sentence_pieces, "STRETCH", stretch)
    rng = random.Random(stretch)
    pieces = list(model.ids)
    texts = ["", " ", "  ", "▁", "▁▁ ▁", "\n", " \n ", "<s>", "<0x0A>", "a\x00b", "﻿x", " " * 100, "x" + " " * 37 + "y", "a" * 3000, "ab" * 2000, "theing" * 900]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice(["the", "er", "ing", " ", "  ", "é", "\n", "12", ".", ",", "'s", "日"]) for _ in range(rng.randint(0, 120))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0xE000, 0x10FFFF), 32])) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), repr(text)


def test_decoding_equals_the_library(model, library):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(3, 259), rng.randrange(len(model.pieces)), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_compatibility_decides(model):
    """Rows of pieces whose neighbours are all compatible are just those that merging yields."""
    rng = random.Random(4)
    pieces = [p for p in model.ids if len(p) < 4 and p.isascii()]
    for _ in range(3000):
        row = [rng.choice(pieces) for _ in range(3)]
        fits = all(model.compatible(model.ids[a], model.ids[b]) for a, b in zip(row, row[1:], strict=False))
        assert fits == (model.merge("".join(row)) == row)
