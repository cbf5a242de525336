"""A manifest of a table: Merkle trees of its sources under one root, and a proof for each row.

Leaves are SHA-256 of a row's fields (each its UTF-8 byte count, a colon and the value, or
`-` for null), in hexadecimal. In each source they ascend by id, and while more than one
node is left, every run of `FAN` consecutive ones becomes the hash of their hexadecimal digests.
The roots of the sources, in order of the sources, give the root of all in the same way.

Checkpoint and recompute: of the interior nodes only every `LEVELS`-th level is stored, so a
stored node covers an aligned subtree of 16^3 stored ones below. Building groups the
stored nodes by subtree and writes one node each. Proofs come from the top down: a subtree
meets the siblings of its own root, makes its missing inner levels again from its stored
nodes, gives every one of these its siblings within the subtree and those above, and forgets the
levels. A task holds one subtree at a time, and a source of any size is many subtrees.

Defined results: nulls count as `-`, the source null is a source and comes first, and rows without
id come first in theirs; rows of one id are ordered by their leaves, equal rows
have equal leaves and follow one another in any order; texts of any length are hashed
whole; an empty table gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.text import thrifty_group
from geomill.llm.workspace import written

FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows are tampered with where this divides the CRC-32 of their id.
TAMPER = 5


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def inner_levels(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """Levels of one subtree from its stored nodes up to a single node; in a tree of more nodes than a subtree holds it has all `depth` levels, even of single nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1 or (total > FAN**depth and len(levels) <= depth):
        low = levels[-1]
        levels.append([_hash(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's ancestors in their runs, level by level."""
    left, right = [], []
    for level in levels[:-1]:
        first = at - at % FAN
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + FAN]))
        at //= FAN
    return left, right


def folded(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a node and its siblings give."""
    for a, b in zip(left, right):
        node = _hash((a, node, b))
    return node


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with `pos`, from 0 in the given order within each group, and the group's `total`.

    Rows are dealt by ranges of (group, order), so a large group is many partitions; each
    row's place in its partition is counted, and the counts of (group, partition), a row each, give what stands before.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*keys, "uid").sortWithinPartitions(*keys, "uid")
    placed = written(dealt.drop("uid").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    before = F.sum("n").over(w.orderBy("part")) - F.col("n")
    runs = runs.select(F.col(group).alias("g"), F.col("part").alias("p"), (before - F.col("low")).alias("shift"), F.sum("n").over(w).alias("total"))
    near = placed.join(runs, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return near.withColumn("pos", F.col("at") + F.col("shift")).drop("g", "p", "shift", "at", "part")


def checkpoints(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The stored levels (grp, pos, total, digest), from the given one up to a node for each tree."""
    schema = T.StructType([nodes.schema[c] for c in ("grp", "pos", "total", "digest")])
    span = FAN**depth

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table["total"][0].as_py()
        top = inner_levels(table["digest"].to_pylist(), total, depth)[-1]
        one = table.slice(0, 1)
        return pa.table([one["grp"], pa.array([one["pos"][0].as_py() // span], pa.int64()), pa.array([-(-total // span)], pa.int64()), pa.array(top)], names=schema.names)

    stored = [nodes]
    while True:
        low = stored[-1].select("grp", "pos", "total", "digest")
        stored.append(written(low.groupBy("grp", F.floor(F.col("pos") / span).alias("block")).applyInArrow(thrifty_group(up), schema)))
        if not stored[-1].filter("total > 1").limit(1).count():
            return stored


def _met(paths: DataFrame, nodes: DataFrame, depth: int, run, schema: T.StructType) -> DataFrame:
    """Each subtree of stored nodes with the one row of its root's path."""
    below = nodes.withColumn("block", F.floor(F.col("pos") / FAN**depth)).groupBy("grp", "block")
    return paths.groupBy("grp", "pos").cogroup(below).applyInArrow(run, schema)


def paths_down(paths: DataFrame, stored: Sequence[DataFrame], depth: int) -> DataFrame:
    """(grp, pos, left, right, subroot) of the nodes of the lowest stored level given, from those of the trees' roots."""

    def down(path: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = inner_levels(table["digest"].to_pylist(), table["total"][0].as_py(), depth)
        own = [siblings(levels, i) for i in range(table.num_rows)]
        upper = path.to_pylist()[0]
        return pa.table([table["grp"], table["pos"], pa.array([a + upper["left"] for a, _ in own], pa.list_(pa.string())), pa.array([b + upper["right"] for _, b in own], pa.list_(pa.string())), pa.array([upper["subroot"]] * table.num_rows, pa.string())], names=path.schema.names)

    for nodes in reversed(stored):
        paths = written(_met(paths, nodes.select("grp", "pos", "total", "digest"), depth, down, paths.schema))
    return paths


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group: str = "source", tampered: Column | None = None, when: Column | None = None, with_siblings: bool = False, depth: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    `tampered` is what the last field becomes where `when` holds: the proof is checked
    against the row as it then is. With `with_siblings` the proof itself follows as
    `left` and `right`, the digests beside each node of the path, joined. Every `depth`-th level is stored.
    """
    *most, last = (F.col(c) for c in fields)
    other = F.when(when, leaf([*most, tampered])) if when is not None else F.lit(None).cast("string")
    leaves = written(rows.select(F.col(group).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf([*most, last]).alias("digest"), other.alias("other")))
    tree = checkpoints(written(numbered(leaves, "grp", ("id", "digest"))), depth)
    subroots = tree[-1].select(F.col("grp").alias("name"), "digest", F.lit(0).alias("grp"))
    top = checkpoints(written(numbered(subroots, "grp", ("name",))), depth)
    found = top[-1].first()
    root = found["digest"] if found else None
    array = F.array().cast("array<string>")
    above = top[-1].select("grp", "pos", array.alias("left"), array.alias("right"), F.lit("").alias("subroot"))
    ends = paths_down(above, top[:-1], depth).alias("p").join(top[0].alias("t"), "pos").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("subroot"))
    paths = paths_down(written(ends), tree[1:-1], depth)
    more = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("left", "right")] if with_siblings else []
    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *texts, T.StructField("verified", T.BooleanType()), *more])

    def prove(path: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, given = table["digest"].to_pylist(), table["other"].to_pylist()
        levels, upper = inner_levels(nodes, table["total"][0].as_py(), depth), path.to_pylist()[0]
        out: list[tuple] = []
        for i, (node, changed) in enumerate(zip(nodes, given)):
            left, right = (a + upper[c] for a, c in zip(siblings(levels, i), ("left", "right")))
            proof = _hash([s for pair in zip(left, right) for s in pair])
            end = folded(changed or node, left, right)
            out.append((node, upper["subroot"], root, proof, end, end == root, left, right)[: 6 + len(more)])
        return pa.table([table["id"], *(pa.array(v, f.type) for v, f in zip(zip(*out), result))], names=schema.names)

    result = [pa.field(f.name, {"boolean": pa.bool_(), "string": pa.string()}.get(f.dataType.simpleString(), pa.list_(pa.string()))) for f in schema.fields[1:]]
    return _met(paths, tree[0].select("grp", "pos", "total", "digest", "id", "other"), depth, prove, schema)


def tamper_proof(rows: DataFrame, depth: int = LEVELS) -> DataFrame:
    """The manifest of documents whose texts are lower-cased (A-Z) where `TAMPER` divides the CRC-32 of the id."""
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(rows, tampered=changed, when=F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, depth=depth)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _sql_tree(name: str, levels: int) -> str:
    """Levels {name}1 and up over {name}0 (g, pos, n, h), and for each level the digests beside each node."""
    out = []
    for i in range(levels):
        w = f"OVER (PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}{i}_beside AS MATERIALIZED (SELECT g, pos, n, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs FROM {name}{i})")
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, pos // {FAN} AS pos, (any_value(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{i} GROUP BY g, pos // {FAN})")
    return ",\n".join(out)


def _sql_fold(name: str, levels: int, start: str, g: str, place: str) -> str:
    """Follows each row's path through a tree: `node` is folded, `proof` collects what stands beside."""
    out = []
    for i in range(levels):
        out.append(f"{name}{i}_fold AS (SELECT f.* EXCLUDE (node, proof), CASE WHEN b.n > 1 THEN sha256(b.lhs || node || b.rhs) ELSE node END AS node, proof || b.lhs || b.rhs AS proof FROM {start} f JOIN {name}{i}_beside b ON b.g = f.{g} AND b.pos = f.{place} // {FAN**i})")
        start = f"{name}{i}_fold"
    return ",\n".join(out)


#: Levels that the SQL has for a source's leaves and for the sources: it states the same result up to 16^5 rows a source and 16^3 sources.
_DEEP, _HIGH = 5, 3

#: The same result in SQL, level by level; CRC-32 bit by bit.
ORACLE_SQL = f"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_sql_leaf("text")} AS leaf,
         CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) % {TAMPER} = 0
              THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents
), numbered AS MATERIALIZED (
  SELECT *, 0 AS one, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM doc
), s0 AS (SELECT g, place AS pos, n, leaf AS h FROM numbered),
{_sql_tree("s", _DEEP)},
t0 AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM s{_DEEP}),
{_sql_tree("t", _HIGH)},
begun AS (SELECT *, coalesce(other, leaf) AS node, '' AS proof FROM numbered),
{_sql_fold("s", _DEEP, "begun", "g", "place")},
{_sql_fold("t", _HIGH, f"s{_DEEP - 1}_fold", "one", "g")}
SELECT doc_id, leaf, t0.h AS subroot, t{_HIGH}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t{_HIGH}.h AS verified
FROM t{_HIGH - 1}_fold f JOIN t0 ON t0.pos = f.g CROSS JOIN t{_HIGH}
"""
