"""The pipeline's stages, one after the other, against plain versions on a small table."""

import random

import numpy as np
import pytest

import corpus_pipeline

from test_line_dedup import plain as plain_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_removed int, lang_pred int, content string, key int, component_id int, shared string"
EXTRA = ("mine", 5, 6, "c", 7, 8, "s")
SYLLABLES = ("the", "and", "ing", "tion", "of", "er", "re", "ly")


def text(rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def near_classes(texts):
    """Index -> smallest index reachable over five-word Jaccard similarities of 0.8 or more."""
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [text(rng) for _ in range(60)]
    texts += [texts[5], texts[7] + " more", "123 !", None, texts[1] + "\n" + texts[2] + "\n" + text(rng), "%%% ".join(text(rng).split()), text(rng, 3000), "", " \n ", texts[9].upper()]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[8], out[5], (None, texts[10], "en", None, None), (None, None, None, None, None)]


def test_pipeline(spark, tmp_path, rows):
    docs = written(spark, tmp_path, rows, [(i, 1, 0) for i in range(40)])
    kept, columns, got = docs, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == columns
        assert kept.where("score <> 'mine' OR n_removed <> 5 OR lang_pred <> 6 OR content <> 'c' OR key <> 7 OR component_id <> 8 OR shared <> 's'").count() == 0
        got[name] = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(d, t) for d, t, *_ in rows if t and t.strip() and d not in (62, 65)]  # no letters; symbols all over
    assert got["language_id"] == sorted(want, key=str)
    left = plain_lines({d: t for d, t in want if d is not None}.items())
    want = [(d, left.get(d, t)) for d, t in want if d is None or left[d]]
    assert got["line_dedup"] == sorted(want, key=str)
    ids = sorted({d for d, _ in want if d is not None})
    by_id = dict(want)
    root = near_classes([by_id[d] for d in ids])
    stay = {d for k, d in enumerate(ids) if root[k] == k}
    want = [(d, t) for d, t in want if d is None or d in stay]
    assert got["simhash_near_dedup"] == sorted(want, key=str)
    assert not {60, 61, 69} & stay and {5, 7, 9, 64, 66} <= stay
    assert got["mixing"] == got["simhash_near_dedup"]  # all labelled documents are clean

    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sorted((str(d), len(tk.encode(t, add_special_tokens=False).ids) + 1) for d, t in want)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    sums = [(str(None if np.isnan(d) else int(d)), int(n)) for d, n in zip(out.doc_id, out.length, strict=True)]
    assert sum(n for _, n in sums) == sum(n for _, n in tokens) and {d for d, _ in sums} == {d for d, _ in tokens}
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() <= -(-sum(n for _, n in tokens) // 2048) + 1


def test_pipeline_thins_what_is_too_much(spark, tmp_path):
    rng = random.Random(4)
    bad = ["".join(rng.choice("vxzkw") + rng.choice("aou") for _ in range(3)) for _ in range(9)]
    clean = [(i, text(rng), "en", "s", 1) for i in range(60)]
    toxic = [(100 + i, " ".join(rng.choice(bad) for _ in range(60)), "en", "s", 1) for i in range(60)]
    docs = written(spark, tmp_path, [*clean, *toxic], [(i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(100, 160)])
    kept = {r["doc_id"] for r in corpus_pipeline.mix_to_targets(spark, docs, str(tmp_path)).collect()}
    assert kept >= set(range(60)) and len(kept) <= 60 + 12


def test_pipeline_of_nothing(spark, tmp_path):
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = tmp_path / "one"
    one.mkdir()
    written(spark, one, [(1, text(random.Random(5)), None, None, None)], [])
    out = corpus_pipeline.run(spark, str(one))
    assert out.count() == 0  # no document names a language, so none is known
