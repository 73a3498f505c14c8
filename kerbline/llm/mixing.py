"""Mixing by soft membership: domain posteriors, then nonnegative document rates that meet target token totals. Native only.

1. A labelled table (id, domain) trains a multinomial naive Bayes on hashed words. It learns from about ``sample_docs``
   documents a domain: of more labelled ones it takes those in the share of the hashed ids that so many are. What it learns
   are buckets x domains counts, whatever the input. Buckets whose share differs by more than a
   ``ratio`` between two domains tell the domains apart; all others count as one and the same word, so the words of a language
   that happens to be labelled a little more often say nothing, and a text without telling words is what such texts mostly are.
2. Every document gets its number of words n and a posterior p over the domains. Evidence is tempered: it counts as that of
   at most ``evidence`` average words, so that long documents keep soft memberships.
3. Rates r >= 0 (and <= ``max_rate`` if given) are fitted so that the expected totals sum(r * n * p) meet the targets t, by
   projected gradient on the least-squares error |A r - t| in the metric of G = sum(n * p * p'), starting from r = 1:

       r <- clip(r - p . inverse(G) (A r - t))

   An iteration is one aggregation over the posteriors that returns one number a domain; a document's rate is a function
   of its posterior and these numbers, so nothing else moves. Every ``hold`` iterations the rates are written out.

The budget is the sum of the targets: by default the words of all documents or, under max_rate, the most that no domain
runs short of. Defined cases: null text is empty (no words; posterior is the prior); unlabelled, repeated or contradicting
labels: the smallest domain of an id counts, null ones not; without any label every rate is 1; rows that repeat get one
rate each; an empty table gives no rows. Targets name the domains: labels of other domains are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, text_or_empty

#: Target weights of the corpus queries, by domain of the labels table.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic flags: toxic, else high or low."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "\n\t\r.,;:!?|\"()", "             "), " "), "")


def buckets(text: Column, size: int) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.hash(w), F.lit(size)))


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], size: int, sample_docs: int, ratio: float) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Log-priors and, for each domain, a log-weight for each bucket; domains without labelled documents are left out."""
    own = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row a domain
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.coalesce(*(F.when(F.col("domain") == d, F.lit(sample_docs / n)) for d, n in share.items()), F.lit(0.0))
    few = own.where(part < most)
    few = F.broadcast(few) if sample_docs * len(domains) <= 100_000 else few  # about so many rows of two columns: hashed ids are even
    seen = docs.select("doc_id", text_or_empty().alias("text")).join(few, "doc_id").select("domain", F.explode(buckets(F.col("text"), size)).alias("b"))
    counts = {d: [0.5] * size for d in share}
    for r in seen.groupBy("domain", "b").agg(F.count("*").alias("n")).collect():  # at most domains x buckets rows
        counts[r["domain"]][r["b"]] += r["n"]
    total = sum(share.values())
    part = {d: [x / sum(v) for x in v] for d, v in counts.items()}
    telling = [max(x) > min(x) * ratio for x in zip(*part.values(), strict=True)]
    rest = {d: sum(x for x, own in zip(v, telling, strict=True) if not own) for d, v in part.items()}
    return {d: math.log(share[d] / total) for d in share}, {d: [math.log(x if own else rest[d]) for x, own in zip(v, telling, strict=True)] for d, v in part.items()}


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], size: int = 8192, sample_docs: int = 3000, evidence: float = 100.0, ratio: float = 3.0) -> DataFrame:
    """doc_id, content (hashed text), n (words), p_<domain> for each domain; one row for each row of docs."""
    prior, weight = train(docs, labelled, domains, size, sample_docs, ratio)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("content"), buckets(text_or_empty(), size).alias("b"))
    if not prior:
        return rows.select("doc_id", "content", F.size("b").cast("long").alias("n"), *(F.lit(None).cast("double").alias(f"p_{d}") for d in domains))

    def total(d: str) -> Column:
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in weight[d])), ",").cast("array<double>")  # folded into a literal
        return F.aggregate("b", F.lit(0.0), lambda a, i: a + F.get(table, i))

    rows = rows.select("doc_id", "content", F.size("b").cast("long").alias("n"), *(total(d).alias(f"s_{d}") for d in prior))
    damp = F.lit(evidence) / (F.col("n") + F.lit(evidence))
    logs = {d: F.lit(prior[d]) + F.col(f"s_{d}") * damp for d in prior}
    top = F.greatest(*logs.values()) if len(logs) > 1 else next(iter(logs.values()))
    rows = rows.select("doc_id", "content", "n", *(F.exp(v - top).alias(f"e_{d}") for d, v in logs.items()))
    norm = sum((F.col(f"e_{d}") for d in logs), F.lit(0.0))
    return rows.select("doc_id", "content", "n", *((F.col(f"e_{d}") / norm if d in logs else F.lit(0.0)).alias(f"p_{d}") for d in domains))


def inverse(g: list[list[float]]) -> list[list[float]]:
    """Of a small symmetric matrix, with a slight ridge; Gauss-Jordan."""
    n, ridge = len(g), 1e-9 * max(g[i][i] for i in range(len(g))) + 1e-12
    a = [[*(g[i][j] + (ridge if i == j else 0) for j in range(n)), *(1.0 if i == j else 0.0 for j in range(n))] for i in range(n)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n:] for row in a]


def fit(soft: DataFrame, targets: Mapping[str, float], max_rate: float | None = None, budget: float | None = None, rounds: int = 40, hold: int = 12, tolerance: float = 1e-6) -> DataFrame:
    """Adds rate to soft (doc_id, n, p_...), which must be cheap to read again."""
    domains = list(targets)
    p, n = [F.col(f"p_{d}") for d in domains], F.col("n")
    pairs = [(i, j) for i in range(len(domains)) for j in range(i, len(domains))]
    stats = soft.agg(F.sum("n").alias("all"), *(F.sum(n * p[i]).alias(f"a{i}") for i in range(len(domains))), *(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    have = [stats[f"a{i}"] or 0.0 for i in range(len(domains))]
    rows = soft.withColumn("rate", F.lit(1.0))
    if not sum(have):
        return rows
    total = sum(targets.values())
    want = [targets[d] / total for d in domains]
    if budget is None:
        budget = stats["all"] if max_rate is None else max_rate * min(h / w for h, w in zip(have, want, strict=True) if w > 0 and h > 0)
    goal = [w * budget if h else 0.0 for w, h in zip(want, have, strict=True)]
    g = [[0.0] * len(domains) for _ in domains]
    for i, j in pairs:
        g[i][j] = g[j][i] = stats[f"g{i}_{j}"]
    inv = inverse(g)
    written = None
    for k in range(rounds):
        now = rows.agg(*(F.sum(F.col("rate") * n * x).alias(f"t{i}") for i, x in enumerate(p))).first()
        error = [now[f"t{i}"] - goal[i] for i in range(len(domains))]
        if max(map(abs, error)) <= tolerance * budget:
            break
        step = [sum(a * e for a, e in zip(row, error, strict=True)) for row in inv]
        new = F.greatest(F.lit(0.0), F.col("rate") - sum((x * F.lit(s) for x, s in zip(p, step, strict=True)), F.lit(0.0)))
        rows = rows.withColumn("rate", new if max_rate is None else F.least(F.lit(float(max_rate)), new))
        if k % hold == hold - 1:
            old, written = written, cut(rows, "rates")
            rows = written
            if old is not None:
                release(old)
    else:
        warnings.warn(f"the targets are not met within {rounds} rounds; largest error of the last round {max(map(abs, error)) / budget:.2g} of the budget", stacklevel=2)
    return rows


def thin(soft: DataFrame, targets: Mapping[str, float], wanted: Collection[str], rounds: int = 40, hold: int = 12, tolerance: float = 1e-6) -> DataFrame:
    """Adds rate (at most 1) to soft, which must be cheap to read again: the targets of domains that aren't wanted are upper bounds.

    Documents that belong mainly to wanted domains have rate 1. The others lose, by the membership in the domain they belong to
    most, what the domains beyond their bounds have too much of the words that stay; a scarce domain costs nothing.
    """
    limited = [d for d in targets if d not in wanted]
    rows = soft.withColumn("rate", F.lit(1.0))
    if not limited:
        return rows
    n, p = F.col("n"), [F.coalesce(f"p_{d}", F.lit(0.0)) for d in limited]
    clean = sum((F.coalesce(f"p_{d}", F.lit(0.0)) for d in targets if d in wanted), F.lit(0.0))
    free = F.greatest(F.lit(0.0), *p) > clean
    bound = [targets[d] / sum(targets.values()) for d in limited]
    main = [F.when(x == F.greatest(F.lit(0.0), *p), x).otherwise(0.0) for x in p]
    live = F.when(free & (F.col("rate") > 0), n).otherwise(0)
    written = None
    for k in range(rounds):
        now = rows.agg(F.sum(F.col("rate") * n).alias("all"), *(F.sum(F.col("rate") * n * x).alias(f"t{i}") for i, x in enumerate(p)), *(F.sum(live * x * y).alias(f"g{i}") for i, (x, y) in enumerate(zip(p, main, strict=True)))).first()
        total = now["all"] or 0.0
        over = [max(0.0, (now[f"t{i}"] or 0.0) - b * total) for i, b in enumerate(bound)]
        step = [x / now[f"g{i}"] if now[f"g{i}"] else 0.0 for i, x in enumerate(over)]
        if max(over) <= tolerance * total or not any(step):
            break
        less = F.greatest(F.lit(0.0), F.col("rate") - sum((x * F.lit(s) for x, s in zip(main, step, strict=True)), F.lit(0.0)))
        rows = rows.withColumn("rate", F.when(free, less).otherwise(1.0))
        if k % hold == hold - 1:
            old, written = written, cut(rows, "rates")
            rows = written
            if old is not None:
                release(old)
    return rows


def copied(rows: DataFrame) -> DataFrame:
    """Adds copies: rate, rounded up or down by the hashed id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float | None = None, budget: float | None = None, **bounds) -> DataFrame:
    """doc_id, n, p_<domain>, rate, copies: how often to take the document (rate, rounded up or down by its hashed id)."""
    soft = cut(posteriors(docs, labelled, list(targets), **bounds), "posteriors")
    return copied(fit(soft, targets, max_rate, budget)).drop("content")


def keep_mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, wanted: Collection[str] = ("high",), **bounds) -> DataFrame:
    """docs thinned so that no domain but the wanted ones has more than its target of the expected words; no document is repeated.

    Rows without a doc_id stay. Of rows that share a doc_id those of one text go together, those of others by their own rates.
    """
    soft = cut(posteriors(docs, labelled, list(targets), **bounds), "posteriors")
    gone = copied(thin(soft, targets, wanted)).where("copies = 0 and doc_id is not null").select(F.col("doc_id").alias("gone_id"), "content").distinct()
    same = (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["content"])
    return docs.join(gone, same, "left_anti")
