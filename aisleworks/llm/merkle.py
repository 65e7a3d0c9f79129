"""A Merkle manifest of a table: a leaf per row, a tree per group of rows, one root over all groups.

Method: SHA midstate tree. A parent hashes its children in a row and keeps a copy of the hash state before each child
slot. A changed child is folded in by resuming the copy of its slot with the new digest and the siblings to its right
only; what lies to the left is never hashed again.

Rows are numbered within their group by a range sort and counts of ranges, so no task sees a whole group. Four levels
of eight children make a block of at most 4,096 nodes, the unit of a task: block tops are numbered alike and form the
next storey, until one node is left per group; the groups' nodes then form a tree of their own. Paths come
down the same storeys: a block takes its top's path, from which the upper states before its slots are made once for all its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.llm.common import crc_mod, written

#: Children of a node, levels of a block.
ARITY, LEVELS = 8, 4

PATH = "array<struct<left: string, right: string>>"


def sized(value: Column) -> Column:
    """A value with its byte count before it, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def levels_of(nodes: int) -> int:
    """Levels of hashing that leave one of ``nodes`` nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


class Parent:
    """A node with the hash states before each of its children."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[str]):
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, child: str) -> str:
        """The digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update("".join([child, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


class UpperStep:
    """One level above a block: the state before its slot, made from the siblings to the left, and those to the right."""

    __slots__ = ("right", "siblings", "state")

    def __init__(self, left: str, right: str):
        self.siblings, self.right = (left + right).encode(), right.encode()
        self.state = hashlib.sha256(left.encode())

    def folded(self, child: str) -> str:
        state = self.state.copy()
        state.update(child.encode() + self.right)
        return state.hexdigest()


def grown(nodes: list[str], levels: int) -> list[list[Parent]]:
    """Parents of each level over the nodes of a block."""
    storey = []
    for _ in range(levels):
        storey.append([Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [parent.digest for parent in storey[-1]]
    return storey


def numbered(nodes: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """The nodes, written, with ``pos`` (from 0, in order within the group) and ``nodes`` (how many the group has)."""
    fields = nodes.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ranks = []
            for key in batch.column(batch.schema.get_field_index(group)).to_pylist():
                seen = seen + 1 if key == last else 0
                last = key
                ranks.append(seen)
            extra = [pa.array([task] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "task", "in_task"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", task int, in_task long"
    ranked = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(count, shape)
    ranked = written(ranked, label)
    ranges = ranked.groupBy(group, "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy("task")
    ranges = ranges.select(
        group,
        "task",
        F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("nodes"),
    )
    placed = ranked.join(ranges, [group, "task"])
    return placed.select(*fields.names, (F.col("before") + F.col("in_task")).alias("pos"), "nodes")


def with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels))


def block_parents(table: pa.Table, levels: int) -> tuple[list[str], list[list[Parent]]]:
    """The nodes of a block, sorted by place, and the parents above them: fewer levels where the tree has fewer."""
    nodes = table["node"].to_pylist()
    return nodes, grown(nodes, min(levels, levels_of(table["nodes"][0].as_py())))


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top node of each block of ``tree, block, pos, nodes, node``; its place is the block's number."""

    def top(table: pa.Table) -> pa.Table:
        leaves, storey = block_parents(table.sort_by("pos"), levels)
        total = -(-table["nodes"][0].as_py() // ARITY**levels)
        node = storey[-1][0].digest if storey else leaves[0]
        columns = [table["tree"].slice(0, 1).combine_chunks(), table["block"].slice(0, 1).combine_chunks()]
        return pa.table([*columns, pa.array([total], pa.int64()), pa.array([node])], names=["tree", "pos", "nodes", "node"])

    needed = nodes.select("tree", "block", "pos", "nodes", "node")
    return needed.groupBy("tree", "block").applyInArrow(top, "tree string, pos long, nodes long, node string")


def storeys(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The written storeys above numbered nodes, the last with one node per tree."""
    found = [nodes]
    while True:
        above = written(with_block(tops(found[-1], levels), levels), "storey")
        found.append(above)
        if above.agg(F.max("nodes")).first()[0] in (None, 1):
            return found


def paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Per node of a storey its path upwards, from its own block and from the path of the block's top."""

    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves, storey = block_parents(table, levels)
        upper = top["path"][0].as_py()
        found = []
        for pos in range(len(leaves)):
            own = []
            for parents in storey:
                pos, slot = divmod(pos, ARITY)
                left, right = parents[pos].siblings(slot)
                own.append({"left": left, "right": right})
            found.append(own + upper)
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([table["tree"], table["pos"], table["node"], pa.array(found, kind)], names=["tree", "pos", "node", "path"])

    below = nodes.select("tree", "block", "pos", "nodes", "node").groupBy("tree", "block")
    tops_of = above.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")
    return below.cogroup(tops_of).applyInArrow(run, f"tree string, pos long, node string, path {PATH}")


def downwards(above: list[DataFrame], last: DataFrame, levels: int) -> DataFrame:
    """Paths of the storey just above the lowest, from those of the last one."""
    found = last
    for storey in reversed(above[1:-1]):
        found = written(paths(storey, found, levels), "paths")
    return found


def fold_block(table: pa.Table, top: pa.Table, levels: int) -> pa.Table:
    """Proof and folded root of every row of a block of leaves."""
    table = table.sort_by("pos")
    leaves, storey = block_parents(table, levels)
    upper = [UpperStep(step["left"], step["right"]) for step in top["path"][0].as_py()]
    above = b"".join(step.siblings for step in upper)
    proofs, roots = [], []
    for place, changed in enumerate(table["changed"].to_pylist()):
        pos, node = place, changed
        proof = hashlib.sha256()
        for parents in storey:
            pos, slot = divmod(pos, ARITY)
            left, right = parents[pos].siblings(slot)
            proof.update((left + right).encode())
            node = parents[pos].folded(slot, node)
        proof.update(above)
        for step in upper:
            node = step.folded(node)
        proofs.append(proof.hexdigest())
        roots.append(node)
    rows = len(leaves)
    subroot, root = top["subroot"][0].as_py(), top["root"][0].as_py()
    return pa.table(
        [
            table["doc_id"],
            table["node"],
            pa.array([subroot] * rows),
            pa.array([root] * rows),
            pa.array(proofs),
            pa.array(roots),
            pa.array([found == root for found in roots]),
        ],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    )


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def merkle_manifest(
    docs: DataFrame, leaf: Column, changed: Column, id_column: str = "doc_id", group_column: str = "lang", levels: int = LEVELS
) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf`` is the row's digest (hexadecimal text), ``changed`` the digest to fold in its place. Rows of a group ascend by
    id, null ids first; rows of one id by ``leaf``, then ``changed``. Groups ascend by the bytes of their text,
    the null group first. A lone node is its own tree: with a single row ``root`` is its leaf and the proof is the digest
    of nothing. Repeated rows are leaves each; an empty table gives no row. Other columns are not read.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_column).cast("string")), F.lit(""))
    rows = docs.select(
        tree.alias("tree"), F.col(id_column).cast("long").alias("doc_id"), leaf.alias("node"), changed.alias("changed")
    )
    # a place of its own keeps many rows that are equal in all else from forming one range
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "leaves")
    leaves = with_block(numbered(rows, "tree", ["doc_id", "node", "changed", "place"], "numbered"), levels)
    low = storeys(leaves, levels)
    subroots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    groups = with_block(written(numbered(subroots, "tree", ["name"], "subroots"), "groups"), levels)
    high = storeys(groups, levels)
    root = high[-1].select("tree", F.col("pos"), "node", F.array().cast(PATH).alias("path"))
    top = written(root, "root")
    root_row = top.first()  # one row, none for an empty table
    of_groups = paths(groups, downwards(high, top, levels), levels)
    # every group once more, now with its path to the root, as the last storey of its own tree
    named = groups.select("pos", F.col("name").alias("tree")).join(of_groups.drop("tree"), "pos")
    last = written(
        named.select(
            "tree",
            F.lit(0).cast("long").alias("pos"),
            F.col("node").alias("subroot"),
            F.lit(root_row["node"] if root_row else "").alias("root"),
            "path",
        ),
        "subroot-paths",
    )
    of_tops = downwards(low, last.select("tree", "pos", F.col("subroot").alias("node"), "path"), levels)
    named_roots = last.select("tree", "subroot", "root")
    of_blocks = of_tops.select("tree", F.col("pos").alias("block"), "path").join(named_roots, "tree")
    blocks = leaves.groupBy("tree", "block").cogroup(of_blocks.groupBy("tree", "block"))
    return blocks.applyInArrow(lambda rows, path: fold_block(rows, path, levels), MANIFEST)


#: Every third id's row is folded with its text lower-cased.
TAMPERED = 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``doc_id, source, lang, n_chars, text`` rows, each third id with its text's A-Z lower-cased.

    Each null field is ``-`` in the leaf; a null id counts as empty text where the third is chosen.
    """
    before = [sized(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.when(crc_mod("doc_id", TAMPERED) == 0, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))
    leaf, changed = (F.sha2(F.concat(*before, sized(text)).cast("binary"), 256) for text in (F.col("text"), lowered))
    return merkle_manifest(docs, leaf, changed, levels=levels)
