"""The operators' kernels against plain definitions; no Spark."""

import random

import numpy as np
import pytest
import xxhash

from kerbline.llm import langid, line_dedup, packing, simhash, substring_dedup, topk


def components(n, links):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_forest(radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(20):
        b = rng.getrandbits(64)
        for _ in range(12):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    assert components(len(fps), simhash.forest(np.array(fps, np.uint64), radius)) == components(len(fps), links)


def plain_fingerprint(text, k):
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one two", "A b c", "the cat the cat the cat sat", "é É x\x0by z " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text.encode(), 3)


def test_longest_previous_factors():
    rng = random.Random(1)
    for n, letters in ((30, "ab"), (30, "abc"), (200, "ab"), (40, "a"), (1, "a")):
        t = "".join(rng.choice(letters) for _ in range(n)).encode()
        want = [max([0] + [next(k for k in range(n + 1) if i + k >= n or t[i + k] != t[j + k]) for j in range(i)]) for i in range(n)]
        suffixes = np.array([t[i:].ljust(n, b"~") for i in range(n)], f"S{n}")
        got = substring_dedup.longest_previous(suffixes, np.arange(n))
        assert np.minimum(got, n - np.arange(n)).tolist() == want  # the filler may add to it
        windows = np.array([t[i : i + 4] for i in range(n - 3)], "S4")
        got = substring_dedup.longest_previous(windows, np.arange(len(windows)), 4)
        assert (got >= 4).tolist() == [x >= 4 for x in want[: len(windows)]]
    assert substring_dedup.longest_previous(np.array([b"xy"] * 3), np.array([5, 5, 5])).tolist() == [0, 0, 0]  # one place


def test_previous_smaller_positions():
    rng = random.Random(2)
    for n in (1, 2, 7, 300):
        v, lcp = [rng.randrange(40) for _ in range(n)], [rng.randrange(1, 9) for _ in range(n)]
        at, common = substring_dedup.previous_smaller(np.array(v), np.array(lcp))
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert at.tolist() == want
        assert common.tolist() == [min(lcp[j + 1 : i + 1]) if j >= 0 else 0 for i, j in enumerate(want)]


def test_equal_windows_get_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 123) for _ in range(260))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 300))) + shared + bytes(rng.randrange(97, 123) for _ in range(80)) for _ in range(5)]
    doc, h, lo, off, n = substring_dedup.anchors_of(texts, 100)
    assert n.sum() == sum(max(0, len(t) - 99) for t in texts)
    seen = {}
    for d, x, s, o, m in zip(doc, h, lo, off, n, strict=True):
        for j in range(m):
            w = texts[d][s + j : s + j + 100]
            assert seen.setdefault(w, (x, o - j)) == (x, o - j)


def test_search_block_is_exact_with_ties():
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (200, 16))
    v[50:80] = v[0]
    ids = rng.permutation(1000)[:200]
    vectors = {int(i): x.tolist() for i, x in zip(ids, v, strict=True)}
    q = sorted(vectors)[:20]
    a, b, s = topk.search_block(np.array(q), np.array([vectors[i] for i in q]), ids, v, 5, (2, 4, 8))
    want = topk.bruteforce(vectors, q, 5)
    assert list(zip(a, b, s, strict=True)) == [(x, i, y) for x, _, i, y in want]


def test_genetic_packing_is_a_partition_within_capacity():
    rng = random.Random(5)
    size = [rng.randint(1, 2047) for _ in range(600)]
    a = packing.evolve(size, 2048, 1)
    b = packing.evolve(size, 2048, 2, guests=[a])
    for p in (a, b, packing.crossover(a, b, size, 2048, rng), packing.mutate(a, size, 2048, rng)):
        assert sorted(i for x in p for i in x) == list(range(600)) and max(sum(size[i] for i in x) for x in p) <= 2048
    plain = packing.best_fit(sorted(range(600), key=lambda i: -size[i]), size, 2048)
    assert len(b) <= len(a) <= len(plain) and packing.score(b, size, 2048) >= packing.score(a, size, 2048) >= packing.score(plain, size, 2048)


def test_genetic_search_beats_best_fit_decreasing():
    better = 0
    for seed in range(12):
        rng = random.Random(seed)
        size = []
        for _ in range(25):  # bins of three pieces that fill them exactly
            x, y = sorted(rng.sample(range(1, 100), 2))
            size += [x, y - x, 100 - y]
        rng.shuffle(size)
        plain = packing.best_fit(sorted(range(len(size)), key=lambda i: -size[i]), size, 100)
        found = [packing.evolve(size, 100, seed, generations=60)]
        for island in range(3):
            found = [packing.evolve(size, 100, 100 * seed + island, found, generations=60)]
        assert len(found[0]) <= len(plain)
        better += packing.score(found[0], size, 100) > packing.score(plain, size, 100)
    assert better >= 6


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, en, rng = Tokenizer.from_file(path), packing.Encoder(path, room=50), random.Random(6)
    parts = ["a", "Be", "é", "é", "İ", "ß", "'s", "'re", " ", "\n", "\t", ".", ", ", ". ", "?. ", "1", "<|endoftext|>", "漢字", "̇", "ﬁ", "Σ", "\x85", "\xa0", "😀", "foo bar, baz.\n", "!!", "%%%", "(", "it's", "\"", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for at in range(0, 3000, 500):
        for t, ids in zip(texts[at : at + 500], en.batch(texts[at : at + 500]), strict=True):
            assert ids == b"".join(i.to_bytes(4, "little") for i in tk.encode(t, add_special_tokens=False).ids), t


def test_encoder_on_all_spaces_and_controls():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, en, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(16)
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c < 32 or 127 <= c < 160 or c in (0xAD, 0x200B, 0x200D, 0x2060, 0xFEFF))]
    parts = [*odd, *".,.,?!'", *"aZ9 é×_~", ". ", ", ", ".\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000)] + [f"×{c}. a{c}, b.{c}" for c in odd]
    found = en.batch(texts)
    want = tk.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, x, y in zip(texts, found, want, strict=True) if x != np.array(y.ids, "<u4").tobytes()] == []


def test_forward_sums_all_segmentations():
    p = langid.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    w = np.random.default_rng(0).random((p.size, 2))
    w[p.none] = 0

    def plain(s, l):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in p.pieces:
                total += w[p.pieces.index(s[:k]), l] * plain(s[k:], l)
            elif k == 1:
                total += w[p.none + 1, l] * plain(s[k:], l)
        return total

    words = ["ab", "b", "abab", "zab", "a", "a" * 20]
    assert np.allclose(np.exp(p.score(words, w)), [[plain("▁" + x, l) for l in range(2)] for x in words])


def test_learning_against_enumerated_segmentations():
    p = langid.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    words, counts = ["ab", "aba", "bb", "zab", "a"], np.array([[3, 1], [2, 0], [0, 4], [1, 1], [0, 2]], float)

    def ways(s):
        if not s:
            return [[]]
        own = [p.pieces.index(s[:k]) if s[:k] in p.pieces else p.none + 1 for k in range(1, len(s) + 1) if s[:k] in p.pieces or k == 1]
        size = [k for k in range(1, len(s) + 1) if s[:k] in p.pieces or k == 1]
        return [[i, *rest] for i, k in zip(own, size, strict=True) for rest in ways(s[k:])]

    w = np.full((p.size, 2), 1 / p.none)
    w[p.none], w[p.none + 1] = 0, 1e-7
    for _ in range(3):
        seen = np.zeros_like(w)
        for word, n in zip(words, counts, strict=True):
            every = ways("▁" + word)
            each = np.array([np.prod(w[x], axis=0) for x in every])
            for x, share in zip(every, each / each.sum(axis=0), strict=True):
                for i in x:
                    seen[i] += share * n
        kept = seen[: p.none] + 0.05
        w[: p.none] = kept / kept.sum(axis=0) * (1 - 1e-7)
    assert np.allclose(p.learn(words, counts, rounds=3), w)
    model = langid.Model(["x", "y"], p, w, np.log([0.5, 0.5]))
    text = ["ab ABA, a.", "bb z", ""]
    sums, letters = langid.Scorer(model).batch(text)
    for t, row in zip(text, sums, strict=True):
        want = sum((np.log(sum(np.prod(w[x], axis=0) for x in ways("▁" + v))) for v in langid.words_of(t)), np.zeros(2))
        assert np.allclose(row, want)
    assert letters.tolist() == [True, True, False]


def test_patience_alignment():
    assert line_dedup.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert line_dedup.blocks([(1, 1), (2, 2), (4, 3)]) == [[1, 2], [4]]
    long = "x" * 50
    shared = [(0, 7, 3, 2), (1, 7, 4, 2), (3, 8, 0, 500)]
    assert line_dedup.removable([long] * 5, shared, rare=64, min_lines=2, min_chars=40) == [[0, 1]]  # a frequent line alone stays
    assert line_dedup.removable([long], [(0, 8, 0, 500)], rare=64, min_lines=2, min_chars=40) == [[0]]  # a whole document goes
