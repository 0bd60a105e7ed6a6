"""Merkle manifest of a dataset: a tree of leaf digests per group, a tree of the groups' roots over them, and a proof per row.

Rows get their place in the group from a range partitioning and the counts of its parts. Places are cut in blocks of
fanout ** HEIGHT rows, each a whole subtree. In a block all levels run on one sort: the node of a level stands at the first
row of its leaves, lag and lead columns at fixed offsets fetch the other nodes of its run, masked by the node's slot and by
where the run ends, and rows of first children hash their parent. Every row then takes the siblings last seen at or before
it, level by level. The nodes of whole blocks are the rows of the next tier. No task holds a group, however large it is.

A node with hash h and a proof step (before, after) has the parent H(before || h || after), H being hex SHA-256.

Defined results: a null group is a group of its own and the first; a null key sorts first; a null value of a field enters the
leaf as `-`, an empty one as `0:`; texts of any length are hashed whole; rows with one key are ordered by leaf, so equal rows
take neighbouring places with equal leaves; other columns are ignored, whatever their names; an empty table has an empty
manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import written

#: Levels per block of rows. Blocks of 256 rows at fanout 2 share one plan; the next tier has 1/256 of the rows.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """H of the values in turn, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(nodes: DataFrame, order: Sequence[str], fanout: int) -> DataFrame:
    """Adds `_pos`, the place in `_group` by `order`, and `_left`, the levels between it and the group's root.

    Parts of a range partitioning are numbered by themselves and moved on by the rows of the group's earlier parts. Equal
    rows are spread by where they were stored, so that a key of very many rows is no part of its own.
    """
    stored = written(nodes, "leaves")
    names = nodes.columns
    tied = stored.select(*names, F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("_tie"))
    parts = written(tied.repartitionByRange("_group", *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_group")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "_group", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(group).alias("_size"))
    levels = sum((F.col("_size") > F.lit(fanout ** i)).cast("int") for i in range(63) if fanout ** i < 1 << 63)
    place = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order, "_tie"))
    return (parts.withColumn("_place", place).join(counts, ["_part", "_group"])
            .select(*names, (F.col("_before") + F.col("_place") - 1).alias("_pos"), levels.alias("_left")))


def _climbed(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """Adds `_block`, `_steps` (the row's proof within its block) and, at a block's first row, `_top`, the block's node."""
    size = fanout ** height
    df = nodes.withColumns({"_block": F.floor(F.col("_pos") / F.lit(size)).cast("long"), "_q": F.pmod("_pos", F.lit(size)).cast("int"),
                            "_top": F.col("_node")})
    run = Window.partitionBy("_group", "_block").orderBy("_q")
    q, top = F.col("_q"), F.col("_top")
    for level in range(height):
        width = fanout ** level
        slot = F.floor(q / F.lit(width)) % fanout
        df = df.withColumns({f"_lag{j}": F.lag("_top", j * width).over(run) for j in range(1, fanout)}
                            | {f"_lead{j}": F.lead("_top", j * width).over(run) for j in range(1, fanout)})
        # a lead beyond the run's end is another run's node or null
        before = F.concat(*[F.when(slot >= j, F.col(f"_lag{j}")).otherwise("") for j in range(fanout - 1, 0, -1)])
        after = F.concat(*[F.when(slot + j < fanout, F.coalesce(f"_lead{j}", F.lit(""))).otherwise("") for j in range(1, fanout)])
        active = F.col("_left") > level
        df = df.withColumn(f"_step{level}", F.when(active & top.isNotNull(), F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(active, F.sha2(F.concat(top, F.col(f"_step{level}.after")), 256)).otherwise(top)
        df = df.withColumn("_top", F.when(q % (width * fanout) == 0, parent)).drop(*[f"_{d}{j}" for j in range(1, fanout) for d in ("lag", "lead")])
    seen = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [f"_step{level}" for level in range(height)]
    df = df.withColumns({s: F.last(s, ignorenulls=True).over(seen) for s in steps})
    return df.withColumn("_steps", F.array_compact(F.array(*steps)).cast(_STEP)).drop("_q", *steps)


def _grown(rows: DataFrame, fanout: int, height: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Tiers of nodes with the levels each climbs, and one row (`_group`, `_node`) per group with its root."""
    left, tiers = rows.agg(F.max("_left")).first()[0] or 0, []
    while left:
        levels = min(height, left)
        tiers.append((rows, levels))
        up = _climbed(rows, fanout, levels).filter(F.col("_top").isNotNull())
        rows = written(up.select("_group", F.col("_block").alias("_pos"), F.greatest(F.col("_left") - levels, F.lit(0)).alias("_left"),
                                 F.col("_top").alias("_node")), "nodes")
        left -= levels
    return tiers, rows.select("_group", "_node")


def _descended(rows: DataFrame, tiers: list[tuple[DataFrame, int]], proofs: DataFrame, fanout: int) -> DataFrame:
    """`rows`, the lowest nodes, with `proofs` (`_group`, `_proof`, ...) of their group's root put after their own steps."""
    if not tiers:
        return rows.drop("_left").join(proofs, "_group")
    carried = [c for c in proofs.columns if c not in ("_group", "_proof")]
    down = proofs.withColumn("_pos", F.lit(0).cast("long"))  # the root of a group is its block 0 of the last tier
    for nodes, levels in reversed(tiers):
        up = down.select("_group", F.col("_pos").alias("_block"), F.col("_proof").alias("_above"), *carried)
        own = [c for c in nodes.columns if c != "_left"]
        down = (_climbed(nodes, fanout, levels).join(up, ["_group", "_block"])
                .select(*own, F.concat("_steps", "_above").alias("_proof"), *carried))
        if nodes is not rows:
            down = written(down, "proofs")
    return down


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", fanout: int = 2,
             height: int = HEIGHT, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: key, group, leaf, place (in the group), subroot, root and proof, an array of (before, after)
    from the leaf to the root. `extra` adds columns computed from docs, which must be narrow."""
    extra = extra or {}
    named = F.col(f"`{group}`").cast("string")
    leaves = docs.select(F.col(f"`{key}`").alias("_key"), named.alias("_name"), F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("_group"),
                         leaf_hash([F.col(f"`{f}`") for f in fields]).alias("_node"), *[c.alias(n) for n, c in extra.items()])
    rows = _numbered(leaves, ["_key", "_node"], fanout)
    tiers, subroots = _grown(rows, fanout, height)
    uppers = _numbered(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), "_node"), ["_of"], fanout)
    upper_tiers, top = _grown(uppers, fanout, height)
    found = top.first()  # the root of all: one value
    root = F.lit(found["_node"] if found else None).cast("string")
    none = top.select("_group", F.array().cast(_STEP).alias("_proof"))
    proofs = _descended(uppers, upper_tiers, none, fanout).select(F.col("_of").alias("_group"), F.col("_node").alias("_subroot"), "_proof")
    return _descended(rows, tiers, written(proofs, "proofs"), fanout).select(
        F.col("_key").alias(key), F.col("_name").alias(group), F.col("_node").alias("leaf"), F.col("_pos").alias("place"),
        F.col("_subroot").alias("subroot"), root.alias("root"), F.col("_proof").alias("proof"), *extra)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_hash(proof: Column) -> Column:
    """H of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audit(docs: DataFrame, tampered: Column, changed: dict[str, Column], **tree) -> DataFrame:
    """The manifest of docs, checked against rows in which, where `tampered` holds, fields have the values of `changed`:
    doc_id, leaf, subroot, root, proof, folded_root, verified."""
    fields = [changed.get(f, F.col(f"`{f}`")) for f in FIELDS]
    made = manifest(docs, extra={"_seen": F.when(tampered, leaf_hash(fields))}, **tree)
    made = made.withColumn("folded_root", folded(F.coalesce("_seen", "leaf"), F.col("proof")))
    return made.select("doc_id", "lang", "place", "leaf", "subroot", "root", "proof", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def audit_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one more in n_chars where 7 divides the CRC-32 of doc_id."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = audit(docs, F.coalesce(tampered, F.lit(False)), {"n_chars": F.col("n_chars") + 1})
    return made.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _field(name: str, value: str | None = None) -> str:
    value = value or name
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(_field(f, chars if f == "n_chars" else None) for f in FIELDS) + ")"


#: Levels are grown by a recursive query, and each document's fold climbs them one by one.
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS changed,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT) AS digits
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda c, d: list_reduce(
      list_prepend(xor(c, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT) AS crc
  FROM leaves),
nodes AS (
  SELECT 0 AS level, g, place AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT level + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY level, g, i // 2),
subroots AS (SELECT g, h, level AS top, row_number() OVER (ORDER BY g) - 1 AS place FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, place AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, i // 2),
tree AS (
  SELECT n.level, n.g, n.i, n.h, s.top FROM nodes n JOIN subroots s USING (g)),
fold AS (
  SELECT p.r, p.g, 0 AS step, p.place AS i, CASE WHEN p.crc % 7 = 0 AND p.crc IS NOT NULL THEN p.changed ELSE p.leaf END AS h, '' AS proof,
    s.top, s.place AS upper_place, s.h AS subroot FROM placed p JOIN subroots s USING (g)
  UNION ALL
  SELECT f.r, f.g, f.step + 1, CASE WHEN f.step + 1 = f.top THEN f.upper_place ELSE f.i // 2 END,
    sha256(CASE WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), f.proof || coalesce(t.h, ''), f.top, f.upper_place, f.subroot
  FROM fold f LEFT JOIN tree t ON t.g = f.g AND t.level = f.step AND t.i = xor(f.i, 1) WHERE f.step < f.top),
climb AS (
  SELECT r, 0 AS step, upper_place AS i, h, proof, subroot FROM fold WHERE step = top
  UNION ALL
  SELECT c.r, c.step + 1, c.i // 2, sha256(CASE WHEN c.i % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), c.proof || coalesce(t.h, ''), c.subroot
  FROM climb c LEFT JOIN upper t ON t.level = c.step AND t.i = xor(c.i, 1) WHERE c.step < (SELECT max(level) FROM upper)),
root AS (SELECT h FROM upper WHERE level = (SELECT max(level) FROM upper))
SELECT p.doc_id, p.leaf, c.subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = root.h AS verified
FROM climb c JOIN placed p USING (r) CROSS JOIN root WHERE c.step = (SELECT max(level) FROM upper)
"""
