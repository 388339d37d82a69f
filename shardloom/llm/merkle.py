"""Merkle manifest of a dataset whose parents keep the hash states before each child.

A leaf is the hash of a row's fields, a subtree the rows of one group in order of their key, and the
root stands over the subtrees in order of their groups. A parent is the hash of its children's hexadecimal
digests. While it is made, the state before each child is copied and kept. To put another value into a
slot, the copied state of the slot takes the value and the siblings to its right: what stands to the left
is never hashed again.

The tree is cut into blocks of some 4,096 nodes that lie next to each other. Rows are numbered within their
group by ranges, a task builds a block with all its states, and the roots of the blocks are the nodes of the
next round, until one is left. Downwards, each block learns the siblings on its way to the root, from which
it makes the states of its upper parents once, for all its rows. No task sees more than a block and its way
up, and the driver sees sizes and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import parts, stored

BLOCK_NODES = 4096
PART_ROWS = 250_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


class Block:
    """Consecutive nodes and all that stands over them, up to ``levels`` levels or to a single node."""

    def __init__(self, digests: list[bytes], arity: int, levels: int | None):
        self.arity, self.nodes, self.states = arity, [digests], []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            below, above, kept = self.nodes[-1], [], []
            for i in range(0, len(below), arity):
                state = hashlib.sha256()
                for child in below[i : i + arity]:
                    kept.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.nodes.append(above)
            self.states.append(kept)

    @property
    def root(self) -> bytes:
        return self.nodes[-1][0]

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """Left and right siblings of node ``i`` and of its ancestors, joined, a pair for each level."""
        for level in self.nodes[: len(self.states)]:
            first = i - i % self.arity
            yield b"".join(level[first:i]), b"".join(level[i + 1 : first + self.arity])
            i //= self.arity

    def fold(self, i: int, value: bytes) -> bytes:
        """The block's root with ``value`` in place of node ``i``."""
        for level, kept in zip(self.nodes, self.states):
            state = kept[i].copy()
            state.update(value)
            for right in level[i + 1 : i - i % self.arity + self.arity]:
                state.update(right)
            value, i = state.hexdigest().encode(), i // self.arity
        return value


class Way:
    """From a block to the root: for each parent the state before the block's slot, and what follows."""

    def __init__(self, steps: list[dict]):
        self.proof = "".join(s["left"] + s["right"] for s in steps).encode()
        self.parents = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in steps]

    def fold(self, value: bytes) -> bytes:
        for before, right in self.parents:
            state = before.copy()
            state.update(value)
            state.update(right)
            value = state.hexdigest().encode()
        return value


def _block(rows: pa.Table, arity: int, height: int) -> tuple[pa.Table, Block]:
    rows = rows.sort_by("pos")
    single = rows["n"][0].as_py() <= arity**height
    return rows, Block([x.encode() for x in rows["digest"].to_pylist()], arity, None if single else height)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their place within their ``tree``, and ``n``, the size of the tree.

    Identical rows are dealt over the ranges by a random last key; which is which makes no difference.
    """
    rows = rows.withColumn("deal", F.rand(12))
    keys = ["tree", *order, "deal"]
    ranges = rows.repartitionByRange(parts(rows.count(), PART_ROWS), *keys).sortWithinPartitions(*keys)
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(ranges.drop("deal").withColumns({"part": F.spark_partition_id(), "at": in_part}), "merkle-rows")
    sizes = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(
        F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sizes = sizes.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    return placed.join(sizes, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _rounds(rows: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """(tree, pos, digest, n) tables: the rows, the roots of their blocks, and so on to one node a tree."""
    span = arity**height

    def build(key, block):
        rows, made = _block(block, arity, height)
        blocks = -(-rows["n"][0].as_py() // span)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [made.root.decode()], "n": [blocks]})

    tables = [rows.withColumn("block", F.expr(f"pos div {span}"))]
    while (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:
        nodes = tables[-1].select("tree", "block", "pos", "digest", "n")
        found = nodes.groupBy("tree", "block").applyInArrow(build, "tree string, pos long, digest string, n long")
        tables.append(stored(found.withColumn("block", F.expr(f"pos div {span}")), "merkle-blocks"))
    return tables


def _ways(nodes: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """Of each node: the siblings from it to the root. ``above`` has those of the nodes' blocks."""

    def down(key, block, over):
        rows, made = _block(block, arity, height)
        up, count = over["steps"].to_pylist()[0], rows.num_rows
        own = [[{"left": a.decode(), "right": b.decode()} for a, b in made.siblings(i)] for i in range(count)]
        return pa.table({
            "tree": rows["tree"], "block": rows["pos"], "subroot": pa.repeat(over["subroot"][0], count),
            "steps": pa.array([x + up for x in own], pa.list_(_STEP)),
        })

    nodes = nodes.select("tree", "block", "pos", "digest", "n").groupBy("tree", "block")
    schema = f"tree string, block long, subroot string, steps {STEPS}"
    return stored(nodes.cogroup(above.groupBy("tree", "block")).applyInArrow(down, schema), "merkle-ways")


def merkle_manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    replaced: Mapping[str, Column] | None = None,
    arity: int = 2,
    with_proof: bool = False,
    block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """Leaf, subtree and root of every row, its proof, and the root with fields replaced.

    ``replaced`` has other values for some of ``fields`` (as it might be read from a copy of the table); the
    leaf of these values is folded upwards. Returns ``key`` and ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (hash of all siblings, level by level), ``folded_root`` and ``verified`` (whether it is
    the root), a row for each row; ``with_proof`` adds ``proof``: the siblings left and right, for each level.

    Null fields hash as ``-``. A null group is a group, the first one. Null keys come first in their group.
    Rows with equal keys are ordered by their leaf, so that the order of the input does not matter, and
    identical rows are leaves of their own. A group of one row has that row's leaf as its subtree.
    """
    if arity < 2:
        raise ValueError("a parent needs two children at least")
    height = 1
    while arity ** (height + 1) <= block_nodes:
        height += 1
    values = [F.col(f) for f in fields]
    other = [(replaced or {}).get(f, F.col(f)) for f in fields]
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("tree"),
        leaf_hash(values).alias("digest"), (leaf_hash(other) if replaced else F.lit(None).cast("string")).alias("other"),
    ).withColumn("other", F.nullif("other", "digest"))
    leaves = numbered(rows, ["key", "digest"])
    groups = _rounds(leaves, arity, height)
    if not groups[-1].isEmpty():
        subroots = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
        tops = _rounds(numbered(subroots, ["group"]), arity, height)
        root = tops[-1].first()["digest"]
    else:
        return docs.limit(0).select(key).withColumns(_nothing(with_proof))
    start = docs.sparkSession.createDataFrame([("", 0, None, [])], f"tree string, block long, subroot string, steps {STEPS}")
    for nodes in reversed(tops):
        start = _ways(nodes, start, arity, height)
    # A subtree's way up is that of its place among the subtrees.
    over = tops[0].select("group", "digest", F.col("pos").alias("block")).join(start.drop("subroot", "tree"), "block")
    above = over.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "steps")
    for nodes in reversed(groups[1:-1]):
        above = _ways(nodes, above, arity, height)
    kind = docs.schema[key].dataType.simpleString()

    def finish(_, block, over):
        rows, made = _block(block, arity, height)
        steps = over["steps"].to_pylist()[0]
        way, hashes, folded, proofs = Way(steps), [], [], []
        for i, (leaf, other) in enumerate(zip(rows["digest"].to_pylist(), rows["other"].to_pylist(), strict=True)):
            own = list(made.siblings(i))
            proof = hashlib.sha256(b"".join(a + b for a, b in own))
            proof.update(way.proof)
            hashes.append(proof.hexdigest())
            folded.append(way.fold(made.fold(i, (other or leaf).encode())).decode())
            if with_proof:
                proofs.append([{"left": a.decode(), "right": b.decode()} for a, b in own] + steps)
        columns = {
            "key": rows["key"], "leaf": rows["digest"], "subroot": pa.repeat(over["subroot"][0], rows.num_rows),
            "proof_sha256": hashes, "folded_root": folded,
        }
        return pa.table(columns | ({"proof": pa.array(proofs, pa.list_(_STEP))} if with_proof else {}))

    schema = f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    schema += f", proof {STEPS}" if with_proof else ""
    found = leaves.withColumn("block", F.expr(f"pos div {arity**height}")).groupBy("tree", "block")
    found = found.cogroup(above.groupBy("tree", "block")).applyInArrow(finish, schema)
    return found.select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"), *(["proof"] if with_proof else []),
    )


def _nothing(with_proof: bool) -> dict[str, Column]:
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    out = {c: F.lit(None).cast("string") for c in names} | {"verified": F.lit(None).cast("boolean")}
    return out | ({"proof": F.lit(None).cast(STEPS)} if with_proof else {})


def proof_root(leaf: str, proof: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to, for a reader who has no tree."""
    for left, right in proof:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf
