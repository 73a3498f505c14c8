"""Merkle manifest of a table of documents: a tree for each language, a tree over their roots, and proofs of every row.

Every parent is stored by its preimage, the concatenated hashes of its children. A leaf joins the preimages of its ancestors,
cuts its own 64 characters out of each to get its siblings, and puts a replacement there to fold a changed leaf up to the root.

Leaves are numbered within their language by a range sort and the offsets of its partitions, so no language is sorted in one
task. The tree is built in tiers of eight levels: 256 consecutive nodes at most meet in one group, which yields the preimages of its
levels as arrays and hands its top to the next tier. Paths come back down tier by tier, so no join has a key of more than 256
rows and the rows moved add up to little more than the leaves.

Defined cases: a null is written as ``-`` in the leaf and null languages form the first tree; rows of equal doc_id are ordered by
their leaf and further repeats are leaves of their own; a language of one row has its leaf as root; an empty table gives no
rows. Extra columns are not part of the leaf and are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import numbered
from .common import cut, join_spread, release

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8  # a tier's height; a group holds 2^LEVELS nodes at most


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row; changed: columns to be hashed instead of the row's own."""
    return digest(F.concat(*(_field(changed.get(name, F.col(f"`{name}`"))) for name in FIELDS)))


def _levels(nodes: Column, total: Column) -> Column:
    """The preimages of a group by level: parents until one node is left, or a whole tier where the tree goes on."""
    found = F.array(F.array().cast("array<string>"))  # a first level that stands for the nodes themselves
    state = F.struct(nodes.alias("nodes"), found.alias("levels"))

    def up(s: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), ((F.size(s["nodes"]) - 1) / 2).cast("int")),
            lambda i: F.concat(F.get(s["nodes"], 2 * i), F.coalesce(F.get(s["nodes"], 2 * i + 1), F.lit(""))),
        )
        more = (total > 2**LEVELS) | (F.size(s["nodes"]) > 1)
        made = F.struct(F.transform(pairs, digest).alias("nodes"), F.concat(s["levels"], F.array(pairs)).alias("levels"))
        return F.when(more, made).otherwise(s)

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), state, up)
    return F.struct(whole["nodes"][0].alias("top"), F.slice(whole["levels"], F.lit(2), F.lit(LEVELS)).alias("levels"))


def _groups(nodes: DataFrame) -> DataFrame:
    """nodes (key, place, hash, total) in groups of 2^LEVELS: key, block, total, levels, top."""
    grouped = nodes.groupBy("key", F.shiftright("place", LEVELS).alias("block"), "total")
    held = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]).alias("nodes"))
    return held.select("key", "block", "total", _levels(F.col("nodes"), F.col("total")).alias("g")).select("key", "block", "total", "g.levels", "g.top")


def _own(levels: Column, place: Column) -> Column:
    """The ancestors of the node at a place of a group: its preimage of each level, with the half that is its own."""
    inner = place.bitwiseAND(F.lit(2**LEVELS - 1))

    def step(level: Column, k: Column) -> Column:
        node = F.floor(inner / F.pow(F.lit(2.0), k)).cast("int")
        return F.struct(F.get(level, F.shiftright(node, 1)).alias("preimage"), node.bitwiseAND(F.lit(1)).alias("half"))

    return F.transform(levels, step)


def paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """nodes (key, place, hash, total): each with path, its ancestors from below; the roots (key, root); and what was stored for them."""
    tiers, stored, level = [], [], nodes
    while True:
        groups = cut(_groups(level), "preimages")
        tiers.append(groups)
        if groups.where(F.col("total") > 2**LEVELS).isEmpty():
            break
        size = F.ceil(F.col("total") / 2**LEVELS).cast("long")
        level = groups.where(F.col("total") > 2**LEVELS).select("key", F.col("block").alias("place"), F.col("top").alias("hash"), size.alias("total"))
    roots = None
    for groups in tiers:
        tops = groups.where(F.col("total") <= 2**LEVELS).select("key", F.col("top").alias("root"))
        roots = tops if roots is None else roots.unionByName(tops)
    above = None  # key, place, path of the nodes of the tier above, which are the tops of the groups below
    for groups in reversed(tiers):
        if above is None:
            held = groups.withColumn("above", F.array().cast("array<struct<preimage:string,half:int>>"))
        else:
            joined = groups.join(above, (groups["key"] == above["_key"]) & (groups["block"] == above["_place"]), "left")
            held = joined.withColumn("above", F.coalesce("_path", F.array().cast("array<struct<preimage:string,half:int>>"))).drop("_key", "_place", "_path")
        if groups is not tiers[0]:
            sized = held.withColumn("_count", F.least(F.lit(2**LEVELS).cast("long"), F.col("total") - F.shiftleft("block", LEVELS)))
            places = sized.withColumn("_place", F.explode(F.sequence(F.shiftleft("block", LEVELS), F.shiftleft("block", LEVELS) + F.col("_count") - 1)))
            above = cut(places.select(F.col("key").alias("_key"), "_place", F.concat(_own(F.col("levels"), F.col("_place")), "above").alias("_path")), "paths")
            stored.append(above)
    blocks = held.select("key", "block", "levels", "above")
    joined = nodes.withColumn("block", F.shiftright("place", LEVELS)).join(blocks, ["key", "block"])
    return joined.withColumn("path", F.concat(_own(F.col("levels"), F.col("place")), "above")).drop("block", "levels", "above"), roots, tiers + stored


def siblings(path: Column) -> Column:
    """The hashes beside the path, from below: each preimage without its own 64 characters; nothing where a node has no sibling."""
    return F.concat_ws("", F.transform(path, lambda p: F.when(p["half"] == 0, F.substring(p["preimage"], 65, 64)).otherwise(F.substring(p["preimage"], 1, 64))))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from another hash in the node's place: spliced into each preimage on the way up."""

    def up(h: Column, p: Column) -> Column:
        return digest(F.when(p["half"] == 0, F.concat(h, F.substring(p["preimage"], 65, 64))).otherwise(F.concat(F.substring(p["preimage"], 1, 64), h)))

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (sibling hashes from the leaf to the root) and folded_root of every row.

    tampered: a condition on rows whose n_chars is changed by one before their leaf is folded up; none by default.
    """
    changed = F.lit(None).cast("string") if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf(n_chars=F.col("n_chars") + 1))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then bytewise
    rows = cut(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), changed.alias("other")), "leaves")
    placed, kept = numbered(rows, ["key"], ["doc_id", "hash"])
    leaves, subroots, stored = paths(placed)
    names = cut(subroots.select(F.lit(0).alias("key"), F.col("key").alias("name"), F.col("root").alias("hash")), "subroots")
    placed, kept_above = numbered(names, ["key"], ["name"])
    tops, root, stored_above = paths(placed)
    upper = tops.join(F.broadcast(root), "key").select(F.col("name").alias("key"), F.col("hash").alias("subroot"), "root", F.col("path").alias("upper"))
    upper = cut(upper.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key"), "upper")
    joined = leaves.join(F.broadcast(upper.drop("n")), "key") if upper.count() <= 1024 else join_spread(leaves, upper, ["key"], ["doc_id", "hash"])
    whole = F.concat("path", "upper")
    out = cut(joined.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", siblings(whole).alias("proof"), fold(F.coalesce("other", "hash"), whole).alias("folded_root")), "manifest")
    release(rows, names, upper, *kept, *kept_above, *stored, *stored_above)
    return out


def oracle() -> str:
    """DuckDB SQL for the manifest's digests where 7 divides the checksum of doc_id: levels by recursion, siblings by place."""

    def hashed(n_chars: str) -> str:
        values = ("doc_id", "source", "lang", n_chars, "text")
        return f"sha256({' || '.join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values)})"

    return f"""
        WITH RECURSIVE crc AS (
          SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        marked AS (
          SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, crc),
        hashed AS (
          SELECT coalesce('=' || lang, '') AS tree, doc_id, {hashed("n_chars")} AS leaf,
            CASE WHEN h % 7 = 0 THEN {hashed("n_chars + 1")} ELSE {hashed("n_chars")} END AS other FROM marked),
        leaves AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS row_id FROM hashed),
        low AS (
          SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS total FROM leaves
          UNION ALL
          SELECT tree, any_value(level) + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(total) + 1) // 2
          FROM low WHERE total > 1 GROUP BY tree, place // 2),
        subroots AS (SELECT tree, hash AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS nth FROM low WHERE total = 1),
        high AS (
          SELECT 0 AS level, nth AS place, subroot AS hash, count(*) OVER () AS total FROM subroots
          UNION ALL
          SELECT any_value(level) + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(total) + 1) // 2
          FROM high WHERE total > 1 GROUP BY place // 2),
        tops AS (SELECT hash AS root, level AS height FROM high WHERE total = 1),
        nodes AS (
          SELECT tree, level, place, hash FROM low WHERE total > 1
          UNION ALL SELECT s.tree, s.height + h.level, h.place, h.hash FROM subroots s, high h WHERE h.total > 1),
        walk AS (
          SELECT l.row_id, l.tree, 0 AS level, l.place, l.other AS hash, '' AS proof, s.height, s.nth, s.height + t.height AS whole
          FROM leaves l JOIN subroots s ON l.tree = s.tree, tops t
          UNION ALL
          SELECT w.row_id, w.tree, w.level + 1, w.spot // 2,
            sha256(CASE WHEN w.spot % 2 = 0 THEN w.hash || coalesce(n.hash, '') ELSE n.hash || w.hash END), w.proof || coalesce(n.hash, ''), w.height, w.nth, w.whole
          FROM (SELECT *, CASE WHEN level = height THEN nth ELSE place END AS spot FROM walk WHERE level < whole) w
          LEFT JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.place = xor(w.spot, 1))
        SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(w.proof) AS proof_sha256, w.hash AS folded_root, w.hash = t.root AS verified
        FROM leaves l JOIN walk w ON l.row_id = w.row_id AND w.level = w.whole JOIN subroots s ON l.tree = s.tree, tops t"""
