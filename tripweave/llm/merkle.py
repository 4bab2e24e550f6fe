"""Merkle manifest of a table: one tree per source, one over the sources' roots, inclusion proofs and tampered versions.

A leaf is the SHA-256 of a row's fields, each written as its UTF-8 length, a colon and its value (``-`` for null). In each source the leaves
stand by doc_id (null first; rows of one id by their leaf, so repeated rows are leaves of their own side by side). Sixteen consecutive nodes
become one node until one is left. The roots of the sources, by source (null first, then in byte order), form the upper tree.

Spark deals the leaves out in aligned blocks of 16^3, whatever source they belong to: a source of a third of all rows is many blocks. A block
is folded by one task; its top node is a leaf of the next round, so 4096^r leaves need r rounds. Paths then come down the same rounds: a block
joins the path of its top node, which is a few kilobytes. A tampered leaf is a version of the persistent tree: within its block the ancestors
are copied and all other nodes are those of the original; above the block the version goes on along the path that was joined.

Null columns are encoded, an empty table has no rows, further columns are not read. Texts are hashed whole by Spark's own ``sha2`` before any
shuffle, so the length of a text does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.sources.storage import stage, unstage

#: Children of a node, and levels that a block spans.
ARITY, DEPTH = 16, 3
BLOCK = ARITY**DEPTH
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"
_NODE = "tree string, pos long, total long, digest string"
_CONTEXT = f"tree string, block long, path {_PATH}, subroot string, root string"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """Length and value of one field; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


# ---- one block, in a task -----------------------------------------------------------------------------------------------------------


def height(total: int) -> int:
    """Levels that a block adds in a tree of ``total`` nodes: all up to the root if the tree is one block, else those of a block."""
    if total > BLOCK:
        return DEPTH
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, lowest first."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return out


def siblings(tree: list[list[str]], level: int, index: int) -> tuple[str, str]:
    """What stands before and after a node in its run."""
    run = index - index % ARITY
    return "".join(tree[level][run:index]), "".join(tree[level][index + 1 : run + ARITY])


def copied(tree: list[list[str]], index: int, changed: str) -> list[str]:
    """A version of the tree with another leaf: the copied nodes from that leaf up to the top; all other nodes are shared."""
    path = [changed]
    for level in range(len(tree) - 1):
        before, after = siblings(tree, level, index)
        path.append(digest(before + path[-1] + after))
        index //= ARITY
    return path


def _rows(table: pa.Table, *order: str) -> list[dict]:
    return table.sort_by([(c, "ascending") for c in order]).to_pylist()


def _arrow(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), _PATH: pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))}
    fields = [part.split(" ", 1) for part in ddl.split(", ")]
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


def fold_block(table: pa.Table) -> pa.Table:
    """The top node of a block."""
    rows = _rows(table, "pos")
    first = rows[0]
    top = climb([r["digest"] for r in rows], height(first["total"]))[-1][0]
    return _arrow([{"tree": first["tree"], "pos": first["pos"] // BLOCK, "total": -(-first["total"] // BLOCK), "digest": top}], _NODE)


def _block(nodes: pa.Table) -> tuple[list[dict], list[list[str]], list[list[tuple[str, str]]]]:
    rows = _rows(nodes, "pos")
    tree = climb([r["digest"] for r in rows], height(rows[0]["total"]))
    sides = [[siblings(tree, level, i) for i in range(len(tree[level]))] for level in range(len(tree) - 1)]
    return rows, tree, sides


def extend_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The path from each node of a block up to the root of all."""
    rows, _, sides = _block(nodes)
    top = above.to_pylist()[0]
    out = []
    for i, row in enumerate(rows):
        own = [dict(zip(("before", "after"), sides[level][i // ARITY**level], strict=True)) for level in range(len(sides))]
        out.append(top | {"tree": row["tree"], "block": row["pos"], "path": own + top["path"]})
    return _arrow(out, _CONTEXT)


def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a block; a tampered leaf makes a version by path copying."""
    rows, tree, sides = _block(nodes)
    top = above.to_pylist()[0]
    upper = "".join(s["before"] + s["after"] for s in top["path"])
    out = []
    for i, row in enumerate(rows):
        proof = "".join("".join(sides[level][i // ARITY**level]) for level in range(len(sides))) + upper
        folded = copied(tree, i, row["changed"] or row["digest"])[-1]
        for step in top["path"]:
            folded = digest(step["before"] + folded + step["after"])
        out.append({
            "doc_id": row["doc_id"], "leaf": row["digest"], "subroot": top["subroot"], "root": top["root"],
            "proof_sha256": digest(proof), "folded_root": folded, "verified": folded == top["root"],
        })
    return _arrow(out, _RESULT)


# ---- the blocks of all trees --------------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, their place in their tree, and ``total``, its size.

    Rows are dealt out by ranges of (tree, order), so no tree is one task; only counts of (tree, range) go through a window.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    dealt = stage(dealt, "merkle-order").withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return dealt.join(parts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of each round, from ``nodes`` (tree, pos, total, digest, ...) up to one root per tree; all but the first are staged."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        folded = _blocks(out[-1].select("tree", "pos", "total", "digest")).groupBy("tree", "block").applyInArrow(fold_block, _NODE)
        out.append(stage(folded, "merkle-nodes"))
    return out


def _join_blocks(nodes: DataFrame, context: DataFrame, fn, schema: str) -> DataFrame:
    return _blocks(nodes).groupBy("tree", "block").cogroup(context.groupBy("tree", "block")).applyInArrow(fn, schema)


def descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Contexts (tree, block, path, subroot, root) of the blocks of the lowest round, from those of the trees' roots (block 0)."""
    context = roots
    for nodes in reversed(levels[1:-1]):
        context = _join_blocks(nodes, context, extend_paths, _CONTEXT)
    return context


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, changed: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, proof digest and verification of every row of ``docs`` (doc_id, source and the fields).

    ``changed`` is the leaf from which a row is verified where it is not null; the tree and the proofs are always the original ones.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # null before every source, as "-" is before "="
    own = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(tree.alias("tree"), "doc_id", leaf([F.col(c) for c in fields]).alias("digest"), own.alias("changed"))
    leaves = stage(numbered(rows, ["doc_id", "digest"]), "merkle-leaves")
    low = rounds(leaves)
    sources = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = stage(numbered(sources, ["source"]), "merkle-sources")
    high = rounds(sources)

    no_path = F.from_json(F.lit("[]"), _PATH)
    root = high[-1].select("tree", F.lit(0).cast("long").alias("block"), no_path.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = _join_blocks(sources, descend(high, root), extend_paths, _CONTEXT).select(F.col("block").alias("pos"), "path", "root")
    roots = sources.join(paths, "pos").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    roots = stage(roots, "merkle-paths")
    unstage(*high)
    return _join_blocks(leaves, descend(low, roots), prove, _RESULT)


def changed_leaf(fields: Sequence[str] = FIELDS, text: str = "text") -> Column:
    """The leaf of a row whose text has its capital letters A-Z made small."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return leaf([F.translate(c, upper, upper.lower()) if c == text else F.col(c) for c in fields])
