"""Line dedup: what an earlier document holds goes, at any frequency and wherever it stands there."""

import random

from kerbline.llm import line_dedup


def test_a_frequent_passage_goes(spark):
    passage = "one long passage on a single line, " * 3
    rows = [(i, f"first {i} own line\n{passage}\nlast {i} own line") for i in range(90)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i == 0 else f"first {i} own line\nlast {i} own line" for i, t in rows}


def plain(rows, least=40):
    """Texts without every stretch of lines, long enough or a whole document, that some earlier document holds."""
    out = {}
    lines = {d: t.split("\n") for d, t in rows}
    for d, own in lines.items():
        gone = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(map(len, own[i:j])) >= least or j - i == len(own):
                    if any(e < d and other[k : k + j - i] == own[i:j] for e, other in lines.items() for k in range(len(other))):
                        gone.update(range(i, j))
        out[d] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def test_blocks_of_any_earlier_document(spark):
    x, y, z = "a line of twenty three", "a second line of thirty", "and a third line there"
    rows = [(1, f"{x}\none"), (2, f"two\n{y}"), (3, f"{x}\n{y}\nthree"), (4, f"four\n{x}\n{y}\nfour")]  # both lines stand in others before 3
    rows += [(5, f"{x}\n{z}\n{x}\n{y}\n5"), (6, f"{z}\n{x}\n6\n{x}\n{y}\n66\n{x}\n{z}"), (7, "5"), (8, "4\n5"), (9, "3\n4\n5\n6"), (10, "4\n5")]
    rng = random.Random(22)
    pool = ["".join(rng.choice("abc") for _ in range(rng.choice((3, 9, 17, 26, 45)))) for _ in range(14)]
    rows += [(20 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[4] == "four\nfour"
    assert got == plain(rows)


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, f"one line that both of the documents hold, and a long one\n{i}", "s", i, 10 * i, 5, "w", 7) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shared string, n_removed long, n_blocks int, n_chars long, whole_text string, shared_by int")
    out = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert [out[i]["n_removed"] for i in range(3)] == [0, 1, 1] and [out[i]["shared"] for i in range(3)] == ["s"] * 3
    kept = line_dedup.keep_rest(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [tuple(rows[0]), (1, "1", "s", 1, 10, 1, "w", 7), (2, "2", "s", 2, 20, 1, "w", 7)]


def test_a_frequent_window_is_dealt_out(spark):
    passage = "a passage of more than forty characters on one line"
    rows = [(i, f"{passage}\nown line {i}") for i in range(2500)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.where("n_removed = 1").count() == 2499 and got.where("doc_id = 0").first()["text"] == rows[0][1]


def stretches(pairs):
    """What may go, without alignment: every stretch of pairs that is contiguous in both documents."""
    out, left = [], set(pairs)
    while left:
        p, q = min(left)
        b = []
        while (p, q) in left:
            left.remove((p, q))
            b.append(p)
            p, q = p + 1, q + 1
        out.append(b)
    return out


def cases(n=1500):
    rng = random.Random(23)
    for _ in range(n):
        pool = ["".join(rng.choice("ab") for _ in range(rng.choice((5, 20, 41)))) for _ in range(6)]
        one, two = ([rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(2))
        yield two, {(p, q) for p, x in enumerate(two) for q, y in enumerate(one) if x == y}


def removed(lines, pairs):
    return {p for b in line_dedup.removable(lines, [(p, 1, q, 2) for p, q in pairs], None, 2, 40) for p in b}


def test_alignment_decides_what_goes(monkeypatch):
    some = 0
    for lines, pairs in cases():
        runs = line_dedup.aligned(pairs)
        assert sorted(x for r in runs for x in r) == sorted(pairs)  # each shared line is aligned once
        assert all(a[0] < b[0] and a[1] < b[1] for r in runs for a, b in zip(r, r[1:], strict=False))
        want = {p for b in stretches(pairs) if sum(len(lines[p]) for p in b) >= 40 or len(b) == len(lines) for p in b}
        assert removed(lines, pairs) == want
        some += bool(want)
    assert some > 500
    spine = line_dedup.aligned({(0, 0), (1, 1), (2, 2), (3, 0)})[0]
    assert spine == [(1, 1), (2, 2)]
    monkeypatch.setattr(line_dedup, "runs", lambda pairs: [])  # without the other runs only the spine's blocks go
    only_spine = sum(removed(lines, pairs) != {p for b in stretches(pairs) if sum(len(lines[p]) for p in b) >= 40 or len(b) == len(lines) for p in b} for lines, pairs in cases(300))
    monkeypatch.setattr(line_dedup, "increasing", lambda pairs: [])  # and without a spine nothing does
    assert only_spine > 50 and not any(removed(lines, pairs) for lines, pairs in cases(300))


def test_long_repeats_and_reversed_order():
    line = "a line of more than forty characters, again and again"
    assert len(removed([line] * 30_000, {(p, 0) for p in range(30_000)})) == 30_000
    lines = [f"{line} {i}" for i in range(30_000)]
    assert len(removed(lines, {(p, 29_999 - p) for p in range(30_000)})) == 30_000
