"""A Merkle manifest of a table: a tree a group, a tree over the groups, a proof a row.

Rows become leaves, the SHA-256 of their fields. Within a group the leaves ascend by an
order column and are numbered; on every level each node sends its digest to its siblings,
whose numbers follow from its own (the other one of a pair by XOR, else its run's other
slots), and one equijoin brings the siblings of all nodes together. The row of slot zero
then emits the parent. The groups' roots form a last tree the same way. Siblings of all
levels are kept as a table a level and handed down from the root, so a row's proof is
joined once.

Digests travel as 32 bytes; what is hashed is their lowercase hex form. A group that
holds most rows is spread like any other: rows are dealt by ranges of the order, nodes by
their number. A tree of n leaves takes log n joins, each over an arity-th of the last.

Null fields are written ``-``, others as their length in bytes, a colon and the value, so
a null and an empty text differ. A null group is a group of its own, before all
others; null ids come first in theirs. Rows with one id are ordered by leaf; equal rows
are leaves each. A group of one row is its leaf. Texts are hashed whole, whatever their
length. Empty table: no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import written

#: Nodes of a run.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it is hashed."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(fields: dict[str, Column]) -> Column:
    """The leaf of a row, from its fields in order."""
    return digest(F.concat(*(field(v) for v in fields.values())))


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, their place within ``tree`` from 0, and ``n``, the tree's size.

    ``tree`` must not be null. Ranges of (tree, order) are sorted apart; a row a range and
    tree says how many come before. Rows alike in ``order`` are told apart by an added key, so
    no number of them has to share a range.
    """
    keys = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order), F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = written(dealt.drop("_row").withColumn("_part", F.spark_partition_id()).withColumn("_line", F.monotonically_increasing_id()), "numbered")
    sizes = stored.groupBy(tree, "_part").agg(F.min("_line").alias("_first"), F.count("*").alias("_size"))  # a row a range and tree
    before = F.sum("_size").over(Window.partitionBy(tree).orderBy("_part")) - F.col("_size")
    starts = sizes.select(tree, "_part", "_first", before.alias("_before"), F.sum("_size").over(Window.partitionBy(tree)).alias("n"))
    at = (F.col("_line") - F.col("_first") + F.col("_before")).alias("at")
    return stored.join(starts, [tree, "_part"]).select(*rows.columns, at, "n")


def siblings(at: Column, n: Column, arity: int) -> Column:
    """Numbers of a node's siblings."""
    if arity == 2:
        others = F.array(at.bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = at % arity
        others = F.array(*(at - slot + (slot + shift) % arity for shift in range(1, arity)))
    return F.filter(others, lambda x: x < n)


def climb(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves up, and (tree, digest) of what remains of each tree.

    ``nodes``: tree, at, n, digest and, if the caller wants it back, payload. A level: tree,
    at, n, digest, payload, ``before`` and ``after`` (digests of the run's nodes on either
    side, joined; null in a tree that has only this node).
    """
    if "payload" not in nodes.columns:
        nodes = nodes.withColumn("payload", F.lit(None).cast("boolean"))
    levels: list[DataFrame] = []
    tops: DataFrame | None = None
    size = nodes.agg(F.max("n")).first()[0] or 0
    while size:
        sent = nodes.filter("n > 1").select("tree", F.explode(siblings(F.col("at"), F.col("n"), arity)).alias("at"), F.struct(F.col("at").alias("of"), "digest").alias("sibling"))
        met = nodes.join(sent, ["tree", "at"], "left").groupBy("tree", "at", "n", "digest").agg(F.first("payload").alias("payload"), F.array_sort(F.collect_list("sibling")).alias("s"))

        def side(keep) -> Column:
            own = F.transform(F.filter("s", lambda x: keep(x["of"])), lambda x: x["digest"])
            return F.when(F.col("n") > 1, F.aggregate(own, F.lit(b""), lambda got, d: F.concat(got, d)))

        level = met.select("tree", "at", "n", "digest", "payload", side(lambda of: of < F.col("at")).alias("before"), side(lambda of: of > F.col("at")).alias("after"))
        level = written(level, "merkle-level")
        levels.append(level)
        done = level.filter("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        parent = digest(hex_of(F.concat("digest", "after")))
        nodes = level.filter(f"n > 1 and at % {arity} = 0").select(
            "tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), parent.alias("digest"), F.lit(None).cast("boolean").alias("payload")
        )
        size = 0 if size == 1 else -(-size // arity)
    return levels, (nodes.select("tree", "digest") if tops is None else tops)


def hand_down(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaf level with ``steps``, (before, after) level by level to the root, and the columns of ``tops``.

    ``tops``: tree, steps above the tree, and whatever each leaf is to be given.
    """
    own = [c for c in tops.columns if c not in ("tree", "steps")]
    above: DataFrame | None = None
    for k, level in reversed(list(enumerate(levels))):
        payload = ["payload"] if k == 0 else []
        here = level.filter("n = 1").join(tops, "tree").select("tree", "at", "digest", *payload, "steps", *own)
        if above is not None:
            up = above.select("tree", F.col("at").alias("_up"), F.col("steps").alias("_steps"), *own)
            steps = F.concat(F.array(F.struct("before", "after")), F.col("_steps")).alias("steps")
            inner = level.filter("n > 1").withColumn("_up", F.expr(f"at div {arity}")).join(up, ["tree", "_up"])
            here = here.unionByName(inner.select("tree", "at", "digest", *payload, steps, *own))
        above = cut_lineage(here) if k else here
    assert above is not None
    return above


def fold(leaf_hex: Column, steps: Column) -> Column:
    """The root that a leaf leads to, by its steps."""
    return F.aggregate(steps, leaf_hex, lambda h, s: F.sha2(F.concat(hex_of(s["before"]), h, hex_of(s["after"])), 256))


def proof_text(steps: Column) -> Column:
    """All siblings on the way to the root, as they are hashed."""
    return F.array_join(F.transform(steps, lambda s: hex_of(F.concat(s["before"], s["after"]))), "")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> DataFrame:
    """``leaves`` (group, order columns, ``leaf`` as bytes, others) with subroot and root as bytes and ``steps``."""
    kept = F.struct(*leaves.columns).alias("payload")
    rows = leaves.withColumn("payload", kept).select(field(F.col(group)).alias("tree"), F.col(group).alias("_group"), *order, F.col("leaf").alias("digest"), "payload")
    nodes = numbered(rows, "tree", [*order, "digest"]).select("tree", "at", "n", "digest", "payload")
    levels, tops = climb(nodes, arity)
    if not levels:
        spare = leaves.select("*", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
        return spare.withColumn("steps", F.array(F.struct(F.col("leaf").alias("before"), F.col("leaf").alias("after")))).limit(0)
    # the order of groups is that of their values, not of their written form
    value = levels[0].groupBy("tree").agg(F.first(f"payload.{group}").alias("_group"))
    every = F.lit("").alias("_all")
    groups = numbered(tops.join(value, "tree").select(every, "_group", F.col("tree").alias("_tree"), "digest"), "_all", ["_group"])
    upper, root = climb(groups.select(F.col("_all").alias("tree"), "at", "n", "digest", F.struct("_tree", "digest").alias("payload")), arity)
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    seeds = hand_down(upper, root.select("tree", F.col("digest").alias("root"), none.alias("steps")), arity)
    seeds = cut_lineage(seeds.select(F.col("payload._tree").alias("tree"), F.col("payload.digest").alias("subroot"), "root", "steps"))
    return hand_down(levels, seeds, arity).select("payload.*", "subroot", "root", "steps")


def documents_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The rows of the query: every document with its proof, and what a tampered third folds to."""
    text = F.col("text").cast("string")
    values = {c: F.col(c) for c in FIELDS}
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    altered = F.when(third, leaf(values | {"text": F.translate(text, _UPPER, _LOWER)}))
    rows = manifest(docs.select("doc_id", "lang", leaf(values).alias("leaf"), altered.alias("altered")), "lang", ["doc_id"], arity)
    folded = fold(hex_of(F.coalesce("altered", "leaf")), F.col("steps"))
    out = rows.select("doc_id", *(hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The query in DuckDB. The check sum is worked out bit by bit; ``paths`` walks every row up its tree, then up the tree of groups.
ORACLE_SQL = """WITH RECURSIVE fields AS (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') AS f_id, coalesce(strlen(source)::VARCHAR || ':' || source, '-') AS f_source,
  coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS f_lang, coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS f_n, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS f_text,
  coalesce(strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS f_low,
  list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc FROM documents),
leaves AS (SELECT doc_id, f_lang AS tree, lang, sha256(f_id || f_source || f_lang || f_n || f_text) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295::UBIGINT) % 3 = 0 THEN sha256(f_id || f_source || f_lang || f_n || f_low) ELSE sha256(f_id || f_source || f_lang || f_n || f_text) END AS seen FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves),
nodes AS (SELECT tree, 0 AS level, spot, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL SELECT tree, level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, spot // 8),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM (SELECT * FROM nodes WHERE n = 1) JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree)),
tops AS (SELECT 0 AS level, spot, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, spot // 8),
ups AS (SELECT 0 AS part, a.tree, a.level, a.spot, coalesce(string_agg(b.h, '' ORDER BY b.spot) FILTER (b.spot < a.spot), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '') AS post
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.spot // 8 = b.spot // 8 WHERE a.n > 1 GROUP BY ALL
  UNION ALL SELECT 1, '', a.level, a.spot, coalesce(string_agg(b.h, '' ORDER BY b.spot) FILTER (b.spot < a.spot), ''), coalesce(string_agg(b.h, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '')
  FROM tops a JOIN tops b ON a.level = b.level AND a.spot // 8 = b.spot // 8 WHERE a.n > 1 GROUP BY ALL),
heights AS (SELECT tree, max(level) AS top FROM nodes GROUP BY tree),
stops AS (SELECT p.tree, p.spot AS leaf_spot, u.part, u.level, row_number() OVER (PARTITION BY p.tree, p.spot ORDER BY u.part, u.level) AS step, u.pre, u.post
  FROM placed p JOIN subroots s USING (tree) JOIN ups u ON (u.part = 0 AND u.tree = p.tree AND u.spot = p.spot // (8 ** u.level)::BIGINT) OR (u.part = 1 AND u.spot = s.spot // (8 ** u.level)::BIGINT)),
proofs AS (SELECT tree, leaf_spot, string_agg(pre || post, '' ORDER BY step) AS proof, max(step) AS steps FROM stops GROUP BY tree, leaf_spot),
paths AS (SELECT tree, spot AS leaf_spot, 0 AS step, seen AS h FROM placed
  UNION ALL SELECT p.tree, p.leaf_spot, p.step + 1, sha256(s.pre || p.h || s.post) FROM paths p JOIN stops s ON s.tree = p.tree AND s.leaf_spot = p.leaf_spot AND s.step = p.step + 1)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r LEFT JOIN proofs f ON f.tree = p.tree AND f.leaf_spot = p.spot
JOIN paths w ON w.tree = p.tree AND w.leaf_spot = p.spot AND w.step = coalesce(f.steps, 0)"""
