"""Spelling variants by anagram hashing: words at one inserted, deleted or replaced letter, and the frequent form of each.

A word's key is the sum of its letters' code points to the fifth power, so words of the same letters share it in any order. Words
one letter apart have keys that differ by a letter's power (added or removed) or by the difference of two (exchanged). Every
word therefore sends a row for its own key and one for its key without each of its different letters: a removal meets the own
key of a shorter word, an exchange meets the removal of the other letter. Of two words one letter apart, either the first or the last half
is the same; rows join on the reduced key and on such a half, so letters that make many words meet only where half a
word agrees. The order of letters is then verified by edit distance.

Words are counted before they move: each task folds its texts into counts, and only these are shuffled. Near words of a word are
at most some 127 times its length, so no group grows with the corpus; forms are followed by doubling their links. No join is broadcast:
Spark sizes a side by its file and takes no account of the explode after it, which makes some 16 rows of a word.

Defined cases: null text has no words, a null doc_id is written as nothing before the colon; ties between forms go to the
smaller word in code-point order; a word is near another once, however many letters lead to it; an empty table gives no rows.
Columns besides doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, ship, text_or_empty

#: What is a letter (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case and all else a space, by Latin-1 code.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(doc: int | None, text: str, every: int = 199) -> Iterator[tuple[str, int]]:
    """The different words of a text with their number; one in every ``every`` by checksum loses a letter."""
    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if word.isascii() else word.encode(), head)
        if every and h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def counts(docs: DataFrame, least: int = 6, every: int = 199, room: int = 300_000) -> DataFrame:
    """word, n: words of at least ``least`` letters and their occurrences in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                for word, n in runs(doc.as_py(), text.as_py(), every):
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= room:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def power(letter: Column) -> Column:
    """A letter's share of a key; whole in a double's 53 bits up to code point 1,552."""
    return F.pow(F.ascii(letter).cast("double"), F.lit(5.0)).cast("long")


def reduced(words: DataFrame) -> DataFrame:
    """Every word with its own key and with its key without each of its letters: word, n, key, own, half (two rows each).

    half is the first or the last half of what is left of the word, whose length both partners share.
    """
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: F.try_add(s, power(c)))
    each = words.withColumn("_key", key).select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), letters))).alias("_letter"))
    each = each.withColumn("own", F.col("_letter") == "").withColumn("_left", F.length("word") - F.when(F.col("own"), 0).otherwise(1))
    rest = F.when(F.col("own"), F.col("_key")).otherwise(F.col("_key") - power(F.col("_letter")))
    mid = F.floor(F.col("_left") / 2).cast("int")
    first = F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), mid).alias("part"))
    last = F.struct(F.lit(1).alias("side"), F.expr("right(word, _left - cast(floor(_left / 2) as int))").alias("part"))
    return each.select("word", "n", rest.alias("key"), "own", F.col("_left").alias("left"), F.explode(F.array(first, last)).alias("half"))


def near(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of words that differ by one inserted, deleted or replaced letter, once each."""
    rows = reduced(words).withColumn("place", F.xxhash64("key", "left", "half"))
    a = rows.where(~F.col("own")).select("place", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("place", F.col("word").alias("b"), F.col("n").alias("b_n"), "own")
    met = a.join(b.hint("merge"), "place").where((F.col("own") | (F.col("a") < F.col("b"))) & (F.abs(F.length("a") - F.length("b")) <= 1))
    found = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    there = found.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    back = found.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    return there.unionByName(back)


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form (the near word of largest n, if ``ratio`` times as frequent) and form_n of every word."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    pairs = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(pairs.hint("merge"), "word", "left")
    form_n = -F.col("best.less")
    taken = form_n >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, form_n).alias("form_n"))


def roots(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found (word, form, ...) with root, the end of the chain of forms (counts rise along it, so it ends); and the links stored for it."""
    links = cut(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = cut(links.join(ahead.hint("merge"), "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("on")), "forms")
        release(links)
        links = moved.drop("on")
        links._kerbline_path = moved._kerbline_path
        if moved.where("on").isEmpty():
            break
    return found.join(links.hint("merge"), "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to"), links


def variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least`` letters that occurs ``often`` times in all texts."""
    words = cut(counts(docs, least, every).where(F.col("n") >= often), "words")
    found = cut(forms(words, ratio), "near")
    linked, links = roots(found)
    out = cut(linked.select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    release(words, found, links)
    return out


def oracle(least: int = 6, often: int = 5, ratio: int = 5, every: int = 199) -> str:
    """DuckDB SQL for ``variants``: checksums by table, near words by what is left after deleting a letter at each place."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH RECURSIVE crc AS (
          SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (
          SELECT doc_id, w, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{upper}', '{upper.lower()}') AS w FROM documents)
          GROUP BY ALL),
        bytes AS (
          SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
        marked AS (
          SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
        words AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % {every} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM marked)
          WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {often}),
        gaps AS (
          SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
          SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.rest = w.word
          UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.rest = w.word),
        ranked AS (
          SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
            row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS k FROM pairs p JOIN words o ON p.other = o.word),
        found AS (
          SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= {ratio} * w.n THEN r.other END AS form,
            CASE WHEN r.other_n >= {ratio} * w.n THEN r.other_n END AS form_n
          FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
        chain AS (
          SELECT word, word AS at, form AS next FROM found
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON c.next = f.word)
        SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON f.word = c.word AND c.next IS NULL"""
