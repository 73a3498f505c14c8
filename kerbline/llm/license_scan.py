"""Licence scan by canonical digests.

A text is reduced to a canonical form: lower case, no copyright notices, everything but letters and digits a single space,
equivalent spellings made one, word by word. The SHA-256 of that form is joined, as a hash join, with the digests of known
licences, once for the whole text and once for each line (a licence notice is an entire text of one line). A notice is a
line that starts with the sign or the word followed by a sign, a year, a placeholder, ``by`` or ``the``; a line that happens
to be wrapped before "copyright notice" or "copyright holders" is none. Known are texts, and digests of longer public ones.

Defined cases: null text is empty, and the empty form matches nothing; rows that repeat stay; the notices of a doc_id are
counted over all its rows, those without a doc_id as one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_texts import DIGESTS, KNOWN

#: A notice and what may stand before it on its line: white space and comment marks.
COPYRIGHT = r"(^|\n)[ \t/*#;%-]*(copyright[ \t:]*(\(c\)|©)|(copyright[ \t:,]*|\(c\)[ \t]*)[0-9]|©|copyright[ \t:]*[\[{<]|copyright[ \t]+(by|the)[ \t])[^\n]*"
#: Spellings that mean the same in licence texts, whole words of the canonical form.
SPELLINGS = (
    ("all rights reserved", ""),
    ("licence", "license"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("authorised", "authorized"),
    ("http", "https"),
)


def _lines(text: Column) -> Column:
    """Words in lower case, single spaces between them, each line padded with one; notices taken out."""
    t = F.lower(text)
    t = F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")), F.regexp_replace(t, COPYRIGHT, "\n")).otherwise(t)
    return F.concat(F.lit(" "), F.replace(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))


def _spelt(words: Column) -> Column:
    """One spelling for each word: with two spaces between words, neighbours don't share what delimits them."""
    out = F.replace(words, F.lit(" "), F.lit("  "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return out


def canonical(text: Column) -> Column:
    """The whole text's form."""
    words = F.regexp_replace(F.replace(_lines(text), F.lit("\n"), F.lit(" ")), " +", " ")
    return F.trim(F.regexp_replace(_spelt(words), " +", " "))


def canonical_lines(text: Column) -> Column:
    """The form of each line that isn't empty; what canonical() gives for the line alone."""
    words = F.regexp_replace(_lines(text), " +", " ")
    return F.filter(F.transform(F.split(F.regexp_replace(_spelt(words), " +", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession, known=KNOWN, digests=DIGESTS, limit: int = 100_000) -> DataFrame:
    """digest, license_id of known (license_id, text) and (license_id, digest) pairs; small enough to broadcast, which ``limit`` makes sure of."""
    known, digests = list(known), list(digests)
    if len(known) + len(digests) > limit:
        raise ValueError(f"more than {limit} known texts")
    rows = spark.createDataFrame(known, "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
    rows = rows.unionByName(spark.createDataFrame(digests, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (null: none), n_notices long, notices (ids, sorted, comma-joined), one row for each row of docs."""
    known = F.broadcast(registry(docs.sparkSession)) if known is None else known
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    whole = texts.select("doc_id", digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    lines = texts.select("doc_id", F.explode(canonical_lines(F.col("text"))).alias("line"))
    hits = lines.select("doc_id", F.sha2("line", 256).alias("digest")).join(known, "digest")
    hits = hits.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    hits = hits.withColumnRenamed("doc_id", "of")
    joined = whole.join(hits, whole.doc_id.eqNullSafe(hits.of), "left")
    return joined.select("doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(text: str) -> str:
    """canonical() in DuckDB's SQL."""
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT)}, chr(10), 'g')"
    out = f"replace(concat(' ', regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ', '  ')"
    out = f"replace({out}, '    ', '  ')"  # a space at either end of the text
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(' ' + old.replace(' ', '  ') + ' ')}, {_quoted(' ' + new + ' ')})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def oracle(known=KNOWN, digests=DIGESTS) -> str:
    texts = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in known)
    values = ", ".join(f"({_quoted(i)}, {_quoted(d)})" for i, d in digests)
    return f"""
        WITH listed AS (SELECT i, sha256({_sql('t')}) AS d FROM (VALUES {texts}) AS k(i, t) UNION ALL SELECT i, d FROM (VALUES {values}) AS k(i, d)),
        known AS (SELECT d AS digest, min(i) AS license_id FROM listed GROUP BY 1),
        texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT doc_id, {_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)),
        hits AS (SELECT l.doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT k.license_id)), ',') AS notices
                 FROM lines l JOIN known k ON sha256(l.line) = k.digest WHERE l.line <> '' GROUP BY l.doc_id)
        SELECT t.doc_id, t.digest, k.license_id, coalesce(h.n_notices, 0) AS n_notices, coalesce(h.notices, '') AS notices
        FROM (SELECT doc_id, sha256({_sql('text')}) AS digest FROM texts) t
        LEFT JOIN known k ON t.digest = k.digest LEFT JOIN hits h ON t.doc_id IS NOT DISTINCT FROM h.doc_id"""
