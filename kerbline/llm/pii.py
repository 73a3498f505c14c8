"""Personal data: base patterns, then information-theoretic sanitisation of the terms around them. Native expressions only.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. The patterns are written with possessive
quantifiers, which match the same text as greedy ones here and neither backtrack nor recurse, so long runs cost linear time.

Each value found is a protected entity e. For a term t that stands within a window of characters around e somewhere,

    IC(e) = log2(N / n_e)        PMI(t, e) = log2(n_te * N / ((n_t + s) * n_e))

count documents: N all, n_e with e, n_t with t anywhere, n_te with t in a window of e. PMI nears IC if t hardly occurs
without e. The smoothing s (1) keeps single counts from being taken at their face value: a term of two documents, one of
which holds an entity of one, loses 1.6 bits, which is too much in a small corpus and not in a large one. A term whose PMI
is at least ``disclosure`` times IC reveals e, in however few documents e stands (``support`` may ask for more): wherever
the term stands in a document that holds e it becomes a span of kind ``term``. Documents without a base span are never
touched. sanitise() replaces spans: base ones by their kind, capitalised terms and numbers by their class, and other terms
are removed.

Defined cases: null text is empty. A match that fails its check (parts, digits, Luhn sum) is dropped without another try.
Rows that repeat give rows that repeat; terms found for a doc_id hold for all its rows. Rows without a doc_id have base
spans only. With an empty table, or if every document holds e, nothing is revealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Pattern, and a cheap test that a text must pass to hold a match.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[ -]?+[0-9])++", lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]")),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
}
WORD = r"[\p{L}\p{N}_]{2,}"
_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,around:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^({_PART}\.){{3}}{_PART}$")
    if kind == "card":
        digits = _digits(v)
        return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, keep=None, window: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, end, value, around (whole words within the window); offsets are code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(gaps, lambda g: F.char_length(g).cast("long"))
    pairs = F.zip_with(sizes, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))  # one gap more than hits: the last pair holds no hit
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.char_length(x["h"])
        out = F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"), x["h"].alias("value")))
        grown = F.struct(e.alias("at"), (F.when(keep(x["h"]), out).otherwise(acc["out"]) if keep else out).alias("out"))
        return F.when(x["h"].isNull(), acc).otherwise(grown)

    def near(m: Column) -> Column:
        s, e = m["start"].cast("int"), m["end"].cast("int")
        tail = F.substring(text, F.greatest(F.lit(1), s - window + 1), F.least(F.lit(window), s))
        head = F.substring(text, e + 1, F.lit(window))
        tail = F.when(s > window, F.regexp_replace(tail, r"^[\p{L}\p{N}_]+", "")).otherwise(tail)
        head = F.when(F.char_length(head) == window, F.regexp_replace(head, r"[\p{L}\p{N}_]+\z", "")).otherwise(head)
        return F.concat(tail, F.lit("\n"), head)

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["value"], (near(m) if window else F.lit("")).alias("around")))


def base_spans(text: Column, kind: str, window: int) -> Column:
    pattern, may = PATTERNS[kind]
    found = F.when(F.regexp_count(text, F.lit(pattern)) > 0, located(text, pattern, lambda v: valid(kind, v), window))
    named = F.transform(F.when(may(text), found), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"], s["around"]))
    return F.coalesce(named, F.array().cast(_SPAN))


def base(docs: DataFrame, window: int = 96) -> DataFrame:
    """doc_id, text, spans (by kind as listed, then start)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    t = t.select("doc_id", "text", *(base_spans(F.col("text"), k, window).alias(k) for k in KINDS))
    return t.select("doc_id", "text", F.concat(*KINDS).alias("spans"))


def revealing(holders: DataFrame, docs: DataFrame, disclosure: float = 0.9, support: int = 1, smooth: float = 1.0) -> DataFrame:
    """doc_id, terms: for each document with entities, the terms that reveal one of them."""
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    entity = holders.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode("spans").alias("s"))
    entity = entity.select("doc_id", F.xxhash64("s.kind", F.lower("s.value")).alias("e"), F.col("s.around").alias("around"))
    pairs = cut(entity.select("doc_id", "e", F.explode(words(F.col("around"))).alias("t")).distinct(), "pairs")
    n_e = entity.select("e", "doc_id").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    n_te = pairs.groupBy("t", "e").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    n = float(docs.count())
    ic = F.log2(F.lit(n) / F.col("n_e"))
    # PMI >= disclosure * IC bounds n_t from above; the documents with t in any window bound it from below, so most terms need no look at the corpus
    n_w = pairs.select("t", "doc_id").distinct().groupBy("t").agg(F.count("*").alias("n_w"))
    most = F.col("n_te") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9) - smooth
    joint = cut(n_te.join(n_e, "e").join(n_w, "t").where((ic > 0) & (F.col("n_w") <= most)).drop("n_w"), "joint")
    n_t = docs.select(F.explode(words(text_or_empty())).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))  # combined before it is shuffled
    known = joint.join(n_t, "t")
    pmi = F.log2(F.col("n_te") * F.lit(n) / ((F.col("n_t") + F.lit(smooth)) * F.col("n_e")))
    strong = known.where(pmi >= disclosure * ic).select("t", "e")
    return pairs.join(strong, ["t", "e"]).groupBy("doc_id").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def find(docs: DataFrame, window: int = 96, disclosure: float = 0.9, support: int = 1, smooth: float = 1.0) -> DataFrame:
    """doc_id, text, spans: base spans, then spans of kind term in order of their start; one row for each row of docs."""
    found = base(docs, window)
    holders = cut(found.where(F.size("spans") > 0), "holders")
    terms = cut(revealing(holders, docs, disclosure, support, smooth), "terms")
    marked = holders.join(terms, "doc_id")
    hits = located(F.col("text"), WORD, lambda v: F.array_contains(F.col("terms"), F.xxhash64(F.lower(v))))
    inside = lambda s: F.exists("spans", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    extra = F.transform(F.filter(hits, lambda s: ~inside(s)), lambda s: F.struct(F.lit("term").alias("kind"), s["start"], s["end"], s["value"], s["around"]))
    extra = marked.select("doc_id", F.xxhash64("text").alias("content"), extra.alias("extra")).dropDuplicates(["doc_id", "content"])
    plain = found.where(F.size("spans") == 0)
    full = holders.withColumn("content", F.xxhash64("text")).join(extra, ["doc_id", "content"], "left")
    full = full.select("doc_id", "text", F.concat("spans", F.coalesce("extra", F.array().cast(_SPAN))).alias("spans"))
    return plain.unionByName(full)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """text with every span generalised or removed; of spans that overlap the first one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    capital = lambda v: v.rlike(r"^\p{Lu}")
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").when(capital(s["value"]), "[NAME]").otherwise("")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), label(s))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), kept.alias("out"))).otherwise(acc)

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find(), then n_term and the SHA-256 of the sanitised text."""
    own = F.filter("spans", lambda s: s["kind"] != "term")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")]
    clean = F.sha2(sanitised(F.col("text"), F.col("spans")), 256).alias("sanitised_sha256")
    return found.select("doc_id", *counts, F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), clean)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text with every span generalised or removed."""
    return find(docs, **options).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"))
