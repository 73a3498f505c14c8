"""The pipeline's mixing stage: targets of unwanted domains are upper bounds."""

import random

import pytest
from kerbline.llm import mixing

WORDS = {"high": "river stone meadow cloud forest", "low": "click buy cheap deal offer", "toxic": "vile hate scum filth rot"}
SCHEMA = "doc_id long, text string, source string"


def corpus(spark, counts):
    rng = random.Random(31)
    domains = [d for d, n in counts.items() for _ in range(n)]
    rows = [(i, " ".join(rng.choice(WORDS[d].split()) for _ in range(60)), "s") for i, d in enumerate(domains)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(enumerate(domains)), "doc_id long, domain string"), domains


def test_scarce_unwanted_domains_cost_nothing(spark):
    docs, labels, domains = corpus(spark, {"high": 500, "low": 5, "toxic": 3})
    assert mixing.keep_mixed(docs, labels).count() == len(domains)


def test_only_what_is_too_much_goes(spark):
    docs, labels, domains = corpus(spark, {"high": 400, "low": 10, "toxic": 300})
    kept = {r["doc_id"] for r in mixing.keep_mixed(docs, labels).collect()}
    assert kept >= {i for i, d in enumerate(domains) if d != "toxic"}
    assert 5 <= sum(domains[i] == "toxic" for i in kept) <= 45  # 22 expected
    rows = mixing.thin(mixing.posteriors(docs, labels, list(mixing.TARGETS)), mixing.TARGETS, ("high",)).toPandas()
    assert (rows.rate * rows.n * rows.p_toxic).sum() / (rows.rate * rows.n).sum() == pytest.approx(mixing.TARGETS["toxic"], abs=1e-4)


def test_a_language_is_no_domain(spark):
    """Clean documents in a language that is labelled toxic a little more often stay clean."""
    rng = random.Random(32)
    words = {"en": "river stone meadow cloud forest", "es": "agua piedra prado nube bosque"}
    rows, labels = [], []
    for i in range(600):
        lang, toxic = ("es", i % 7 == 0) if i % 4 == 0 else ("en", i % 10 == 1)
        text = [rng.choice(words[lang].split()) for _ in range(300)]
        text[:: 12] = [rng.choice(WORDS["toxic"].split()) for _ in text[::12]] if toxic else text[::12]
        rows.append((i, " ".join(text), "s"))
        labels.append((i, "toxic" if toxic else "high"))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.posteriors(docs, spark.createDataFrame(labels, "doc_id long, domain string"), ["high", "toxic"]).toPandas().set_index("doc_id")
    assert all((got.p_toxic[i] > 0.5) == (d == "toxic") for i, d in labels)
