"""Operators on small tables with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import ann, langid, license_scan, line_dedup, mixing, packing, pii, simhash, substring_dedup, topk
from kerbline.llm.license_texts import BSD_3, DIGESTS, ISC, MIT

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = ["\n".join(sentence(rng) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts += [texts[0], texts[1] + "\nand more", texts[2][:-3], None, "", " ", "12 34", "Of.", texts[3] + "\n" + texts[4], sentence(rng, 4000)]
    docs = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or ""), 1, 0.5) for i, t in enumerate(texts)]
    return [*docs, docs[5], (None, texts[6], "en", "s", 1, 1, 0.5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_license(spark):
    texts = [(1, f"Copyright (c) 2020 A\n\n{MIT.upper()}"), (2, ISC.replace(",", "")), (3, "x\nReleased under the  MIT Licence!\nReleased under the MIT License."), (4, None), (4, ""), (None, "x")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["license_id"], got[2]["license_id"], got[3]["license_id"]) == ("MIT", "ISC", None)
    assert (got[3]["n_notices"], got[3]["notices"]) == (2, "MIT") and got[4]["n_notices"] == 0


def wrapped(text, width):
    return "\n".join("\n".join(textwrap.wrap(x, width)) for x in text.split("\n"))


def test_license_forms(spark, docs, rows, empty):
    isc = wrapped(ISC, 70)
    assert "\ncopyright notice" in (odd := ISC.replace("above copyright", "above\ncopyright"))
    texts = [isc, odd, f"/* Copyright 2020 A. All rights reserved.\n * Copyright the B authors\n */\n{wrapped(BSD_3, 60)}", f"© A\n(c) 2021 B\n{wrapped(MIT, 33)}", "licence licence licence", "the sub\nlicence is", wrapped(BSD_3.upper(), 50), "x " * 400_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, of int")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [got[i]["license_id"] for i in range(8)] == ["ISC", "ISC", "BSD-3-Clause", "MIT", None, None, "BSD-3-Clause", None]
    shown = [r[0] for r in df.select(license_scan.canonical(F.col("text"))).collect()]
    assert shown[4] == "license license license" and shown[5] == "the sublicense is"
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == len(rows)


def test_license_lines_equal_texts_of_one_line(spark):
    rng = random.Random(18)
    parts = ["a", "Licence", "licence", " ", "  ", "\n", ".", "copyright 2020 x", "Copyright notice", "All rights reserved", "\t", "sub", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", license_scan.canonical_lines(F.col("t")).alias("l"))
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    alone = spark.createDataFrame(lines, "i int, k int, t string").select("i", "k", license_scan.canonical(F.col("t")).alias("c")).orderBy("i", "k").collect()
    for r in whole.collect():
        assert r["l"] == [x["c"] for x in alone if x["i"] == r["i"] and x["c"]]


def test_license_digests_are_those_of_the_public_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"GPL-3": "GPL-3.0-only", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1-only"}
    rows = [(i, (folder / f).read_text()) for f, i in names.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("the texts are not on this system")
    found = spark.createDataFrame(rows, "i string, t string").select("i", license_scan.digest(F.col("t"))).collect()
    assert {tuple(r) for r in found} <= set(DIGESTS)


def test_packing(docs, rows, empty):
    p = packing.pack(docs, capacity=64, block_size=20).toPandas()
    assert len(p[p.piece == 0]) == len(rows)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 64
    assert p.sequence_id.nunique() <= 1.05 * p.length.sum() / 64 + 1
    one = p[(p.doc_id == 49)].sort_values("piece")
    assert (one.length[:-1] == 64).all() and one.start.tolist() == [64 * i for i in range(len(one))]
    assert packing.pack(empty).count() == 0


def test_topk(spark):
    rng = random.Random(8)
    v = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(120)}
    v |= {200 + i: v[0] for i in range(10)}
    table = [*v.items(), (300, None), (301, [float("nan")] * 8), (302, [1.0] * 7 + [None]), (303, []), (None, v[1]), (5, v[5])]
    df = spark.createDataFrame([(a, b, "x") for a, b in table], "vec_id long, embedding array<double>, score string")
    q = topk.quantised(df)
    got = [tuple(r) for r in topk.top_k(q.where("id % 50 = 0"), q, 5, query_block=2, candidate_block=40).orderBy("query_id", "rank").collect()]
    whole = {i: [int(np.floor(256 * x)) for x in e] for i, e in v.items()}
    assert got == topk.bruteforce(whole, [i for i in whole if i % 50 == 0], 5)
    assert topk.top_k(q.where("id < 0"), q.where("id < 0")).count() == 0


def test_line_dedup(spark, docs, rows, empty):
    out = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect() if r["doc_id"] is not None}
    text = {r[0]: r[1] for r in rows}
    assert out[40]["text"] == "" and out[0]["text"] == text[0]
    assert out[41]["text"] == "and more" and out[48]["text"].strip() == ""
    assert out[43]["text"] is None and out[44]["text"] == "" and out[10]["n_removed"] == 0
    kept = line_dedup.keep_rest(docs)
    assert kept.columns == docs.columns and 40 not in {r["doc_id"] for r in kept.collect()}
    assert line_dedup.dedup(empty).count() == 0


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, mixing.label_domains(labels), {"high": 0.5, "low": 0.3, "toxic": 0.2}).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    total = (out.n * out.rate).sum()
    for d, w in (("high", 0.5), ("low", 0.3), ("toxic", 0.2)):
        assert (out.n * out.rate * out[f"p_{d}"]).sum() / total == pytest.approx(w, abs=1e-4)
    assert np.allclose(out[["p_high", "p_low", "p_toxic"]].sum(axis=1), 1)
    none = mixing.mix(docs, mixing.label_domains(labels.limit(0)))
    assert none.where("rate <> 1").count() == 0
    assert mixing.mix(empty, mixing.label_domains(labels)).count() == 0
    assert mixing.keep_mixed(docs, mixing.label_domains(labels)).columns == docs.columns


def test_posteriors_against_plain_naive_bayes(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(("red", "blue", "Green,", "sky", "mud.")) for _ in range(rng.randint(0, 30))) if i % 11 else None) for i in range(150)]
    labelled = [(i, "a" if i % 3 else "b") for i in range(100)] + [(3, "a"), (None, "a"), (4, None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labelled, "doc_id long, domain string")
    got = {r["doc_id"]: r for r in mixing.posteriors(df, lab, ["a", "b", "c"], size=64, sample_docs=1000, ratio=1.3).collect()}
    clean = lambda t: (t or "").lower().replace(",", " ").replace(".", " ").split()
    bucket = {w: spark.range(1).select(F.pmod(F.hash(F.lit(w)), F.lit(64))).first()[0] for w in ("red", "blue", "green", "sky", "mud")}
    domain = {}
    for i, d in labelled:
        if i is not None and d is not None:
            domain[i] = min(d, domain.get(i, d))
    count = {d: [0.5] * 64 for d in "ab"}
    for i, t in rows:
        for w in clean(t) if i in domain else []:
            count[domain[i]][bucket[w]] += 1
    for i, t in rows:
        words = clean(t)
        damp = 100 / (len(words) + 100)
        part = {d: np.array(count[d]) / sum(count[d]) for d in "ab"}
        telling = np.maximum(part["a"], part["b"]) > 1.3 * np.minimum(part["a"], part["b"])
        weight = {d: np.log(np.where(telling, part[d], part[d][~telling].sum())) for d in "ab"}
        log = {d: np.log(list(domain.values()).count(d) / len(domain)) + damp * sum(weight[d][bucket[w]] for w in words) for d in "ab"}
        want = 1 / (1 + np.exp(log["b"] - log["a"]))
        assert got[i]["n"] == len(words) and got[i]["p_a"] == pytest.approx(want, abs=1e-4) and got[i]["p_c"] == 0
    few = mixing.posteriors(df, lab, ["a", "b"], size=64, sample_docs=10)  # learns from a tenth or so
    assert few.count() == len(rows)


def test_rates_of_rows_that_share_an_id(spark):
    good, bad = "river stone meadow " * 20, "vile hate scum " * 20
    rows = [(i, good) for i in range(60)] + [(i, bad) for i in range(100, 160)] + [(200, good), (200, bad), (None, bad)]
    labels = spark.createDataFrame([(i, "high") for i in range(60)] + [(i, "toxic") for i in range(100, 160)], "doc_id long, domain string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("content", F.lit("c"))
    kept = mixing.keep_mixed(df, labels, {"high": 1.0, "toxic": 0.0}, ("high",))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted([(i, good) for i in range(60)] + [(200, good)])


def test_projected_gradient_against_plain_least_squares(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(1, 500, 200)
    soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n long, p_a double, p_b double, p_c double")
    r = mixing.fit(soft, {"a": 0.6, "b": 0.3, "c": 0.1}).orderBy("doc_id").toPandas().rate.to_numpy()
    goal, x = np.array([0.6, 0.3, 0.1]) * n.sum(), np.ones(200)
    g = np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(500):
        x = np.maximum(0, x - p @ (g @ ((p * n[:, None]).T @ x - goal)))
    assert np.allclose(r, x, atol=1e-3) and np.allclose((p * n[:, None]).T @ r, goal, rtol=1e-4)


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = [(r[0], simhash.fingerprint((r[1] or "").encode())) for r in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda t: (t[0] is None, t)
    assert sorted([(r["doc_id"], r["fp"]) for r in got], key=lambda t: (t[0] is None, t[0] or 0, t[1])) == sorted([(d, signed(f)) for d, f in fps], key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    del key
    comp = {f: f for _, f in fps}
    for _ in range(len(comp)):
        for a in comp:
            for b in comp:
                if (a ^ b).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for d, f in fps:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    want = {signed(f): least[comp[f]] for _, f in fps}
    assert all(r["component_id"] == want[r["fp"]] for r in got)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert 40 not in kept and 0 in kept and None in kept
    assert simhash.near_duplicates(empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group()))


def test_pii_base_spans(spark):
    rng = random.Random(10)
    parts = [*"aB1234567890..@@--++ ()_%é😀\n", "4111111111111111", "1.2.3.4", "300.1.1.1", "a@b.c", "+1 (017) 555-7713", "00255.0.0.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, "", "1" * 3000, "a@b.c " * 500, "1." * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.base(df)).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_ip"] == want.count("ip:")


def plain_terms(rows, window=96, disclosure=0.9):
    """doc_id -> spans of kind term, by counting documents."""
    word = re.compile(r"\w{2,}")
    words = {d: {w.lower() for w in word.findall(t or "")} for d, t in rows}
    base, near, entities = {}, {}, {}
    for d, t in rows:
        spans = [x.split(":") for x in plain_spans(t).split(",") if x]
        base[d] = [(int(s), int(e)) for _, s, e in spans]
        for k, s, e in ((k, int(s), int(e)) for k, s, e in spans):
            entities.setdefault((k, t[s:e].lower()), set()).add(d)
            for m in word.finditer(t):
                if m.end() <= s and (m.start() > s - window or s <= window) or m.start() >= e and m.end() < e + window:
                    near.setdefault((m.group().lower(), (k, t[s:e].lower())), set()).add(d)
    n, out = len(rows), {d: set() for d, _ in rows}
    for (w, e), ds in near.items():
        ic = np.log2(n / len(entities[e]))
        n_t = sum(w in x for x in words.values())
        if ic > 0 and np.log2(len(ds) * n / ((n_t + 1) * len(entities[e]))) >= disclosure * ic:
            for d in ds:
                out[d].add(w)
    return {d: [f"term:{m.start()}:{m.end()}" for m in word.finditer(t or "") if m.group().lower() in out[d] and not any(m.start() < e and s < m.end() for s, e in base[d])] for d, t in rows}


def test_pii_terms(spark):
    rng = random.Random(11)
    texts = [f"{sentence(rng)} Zebulon wrote from z@x.org {sentence(rng)}" for _ in range(4)] + [f"{sentence(rng)} wrote from home" for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, spans string")
    found = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    at = texts[0].index("Zebulon")
    assert f"term:{at}:{at + 7}" in found[0]["spans"] and "term:" not in found[10]["spans"] and found[64]["spans"] == ""
    assert all(found[0]["spans"].count(f":{m.start()}:") == 0 for m in re.finditer("wrote", texts[0]))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "[NAME] wrote from [EMAIL]" in clean[0] and clean[10] == texts[10] and clean[64] == ""
    assert found[0]["sanitised_sha256"] == hashlib.sha256(clean[0].encode()).hexdigest()
    assert pii.digest(pii.find(df.where("doc_id < 0"))).count() == 0


def test_pii_terms_against_plain_counts(spark):
    rng = random.Random(15)
    names = ["a@b.org", "z.y@mail.net", "10.20.30.40", "+1 (555) 123-4567", "4111111111111111"]
    rare = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(500)]

    def text():
        words = [rng.choice(rare) if rng.random() < 0.05 else sentence(rng, 1)[:3] for _ in range(rng.randint(5, 60))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            words.insert(rng.randrange(len(words)), rng.choice(names) if rng.random() < 0.5 else f"u{rng.randrange(99)}@x.org")
        return "".join(w + rng.choice((" ", ", ", "\n")) for w in words)

    rows = [(i, text()) for i in range(400)]
    want = plain_terms(rows, disclosure=0.75)
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("term:")] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), disclosure=0.75)).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def test_language(spark, empty):
    rng = random.Random(12)
    word = {"aa": "the and ing tion", "bb": "der und ung keit"}
    text = lambda l: " ".join("".join(rng.sample(word[l].split(), 2)) for _ in range(30))
    rows = [(i, text(l), l) for i in range(120) for l in [("aa", "bb")[i % 2]]] + [(500, None, "aa"), (501, "12 !", "bb"), (502, "x" * 5000, None), (None, text("aa"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert sum(got[i]["lang_pred"] == l for i, _, l in rows[:120]) == 120 and got[500]["lang_pred"] == got[501]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"]
    assert {r["doc_id"] for r in langid.keep_known(df).collect()} >= set(range(120)) and langid.keep_known(df).columns == df.columns
    assert langid.identify(df.drop("lang").withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty).count() == 0
    odd = [(600, "½ ② ²³ ٣", None), (601, "aª", None), (602, text("aa").replace(" ", "%%% "), "aa"), (603, "the.", "aa"), (1, text("bb"), "bb")]
    more = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(7))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(more).collect()}[600] == "und"
    kept = langid.keep_known(more)
    assert kept.columns == more.columns and kept.where("score <> 'mine' or lang_pred <> 7").count() == 0
    ids = {r["doc_id"] for r in kept.collect()}
    assert 600 not in ids and 602 not in ids and 603 in ids and ids >= set(range(120))


def test_language_learns_from_bounded_rows(spark):
    rows = [(7, f"the and {i}", "aa") for i in range(50)] + [(i, "der und", "bb") for i in range(100, 130)] + [(i, "und", f"l{i}") for i in range(200, 220)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df, sample_docs=5, sample_chars=100, languages=2).collect()
    assert len(got) <= 10 and {r["lang"] for r in got} <= {"bb", "aa", "l200"}


def test_substring_dedup(spark, rows, empty):
    rng = random.Random(13)
    shared = sentence(rng, 60)
    docs = [r[:2] for r in rows if r[0] is not None][:50] + [(60, f"{sentence(rng, 5)} {shared} end"), (61, f"start {shared}"), (62, "é" * 300), (63, "ab" * 700), (64, "\x00" * 250)]
    docs += [(70 + i, f"{shared[:300]} {sentence(rng, rng.randint(0, 2))} {shared[300:]}") for i in range(30)]  # near copies
    seen, want = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        want[d] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, content string").repartition(3)
    for split in (substring_dedup.SPLIT, 1):
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.dedup(df, split=split).drop("kept").collect()} == want
    assert substring_dedup.dedup(empty).count() == 0


def nearest_plain(ids, v, q, k=20):
    s = v @ v[np.searchsorted(ids, q)]
    s[ids == q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def test_nearest_neighbours(spark, empty):
    """With the query's own parameters; copies, clusters and very different lengths."""
    rng = np.random.default_rng(14)
    v = rng.standard_normal((1500, 16))
    v[200:500] = v[rng.integers(0, 5, 300)] + 0.05 * rng.standard_normal((300, 16))  # clusters
    v[600:900] = v[600]  # copies, more than any list holds
    table = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("inf")] * 16), (None, [1.0] * 16), (7, v[7].tolist()), (9003, [1.0])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in table], "vec_id long, embedding array<double>, rank int, node int")
    got = ann.nearest(ann.vectors(df), F.col("id") % 20 == 0, k=20).toPandas()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        top = nearest_plain(np.arange(1500), v, q)
        hit, total = hit + len(set(top) & set(g.vec_id)), total + 20
        assert len(g) == 20 and np.allclose(g.score, [v[i] @ v[q] for i in g.vec_id], rtol=1e-12)
        order = list(zip(-g.score, g.vec_id, strict=True))
        assert order == sorted(order)
        if 600 <= q < 900:
            assert g.vec_id.tolist() == top
    assert hit >= 0.95 * total and got.query_id.nunique() == 75
    few = ann.nearest(ann.vectors(df.where("vec_id < 3")), F.col("id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    none = df.where("vec_id < 0")
    assert ann.nearest(ann.vectors(none), F.col("id") == 0).count() == 0


def test_a_huge_vector_leaves_the_others_their_precision(spark):
    rng = np.random.default_rng(15)
    v = rng.standard_normal((300, 8))
    v[7] *= 1e12
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(ann.vectors(df), F.col("id") % 20 == 0, k=20).toPandas()
    hit = sum(len(set(nearest_plain(np.arange(300), v, q)) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= 0.95 * 20 * 15
