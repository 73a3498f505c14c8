"""Near-duplicates of the pipeline's stage against all pairs."""

import random

import corpus_pipeline
import numpy as np
from kerbline.llm import near, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stage_links_at_jaccard(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(80, 200))]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
    texts += [None, "", "a b", "A  b", texts[3].upper()]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = (simhash.fingerprint((texts[k] or "").encode(), 5) for k in (i, j))
                wide += (a ^ b).bit_count() > 3
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert wide > 20  # pairs that fingerprints within 3 bits leave apart
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()}
    assert got == dict(enumerate(root))
    kept = [r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    assert {i for i in kept if i is not None} == set(root) and None in kept
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_jaccard():
    a, b = near.shingles(b"a b c d e f g", 5), near.shingles(b"a b c d e f h", 5)
    assert (len(a), len(b), near.jaccard(a, b)) == (3, 3, 0.5)
    assert near.jaccard(a, a) == 1 and np.array_equal(near.bands(a), near.bands(a))


def test_overlaps_and_forest_of_a_cell():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, np.uint64)
    edited = lambda k: np.unique(np.concatenate([rng.choice(base, 150 - k, replace=False), rng.integers(0, 1 << 63, k, np.uint64)]))
    probes, targets = [edited(int(k)) for k in rng.integers(0, 30, 40)], [edited(int(k)) for k in rng.integers(0, 30, 90)]
    want = np.array([[len(np.intersect1d(p, t)) for t in targets] for p in probes])
    for often in (1, 64, 10**6):
        assert np.array_equal(near.overlaps(probes, targets, often=often, width=7), want)
    links = [(i, 100 + j) for i, p in enumerate(probes) for j, t in enumerate(targets) if near.jaccard(p, t) >= 0.8]
    spanned = [(i, 100 + j) for i, j in near.forest(probes, targets, list(range(40)), list(range(100, 190)), 0.8)]

    def roots(pairs):
        r = list(range(190))
        for a, b in pairs:
            a, b = sorted((r[a], r[b]))
            r = [a if x == b else x for x in r]
        return r

    assert set(spanned) <= set(links) and len(spanned) < len(links) and roots(spanned) == roots(links)


def test_group_with_classes_apart(spark):
    """Edits of one text at very different rates: most classes of a bucket are apart from its first, and some link only among themselves."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randint(0, 9)):
            x[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(x))
    for _ in range(8):  # pairs far from the base and near each other
        x = list(base)
        for _ in range(7):
            x[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        texts += [" ".join(x), " ".join([*x[:140], "end", *x[140:]])]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df).collect()} == dict(enumerate(root))
    assert 3 < len(set(root)) < len(texts)
