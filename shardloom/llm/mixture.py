"""Mixing sources to target weights.

Method: a multivariate-hypergeometric splitting tree. Documents of a source are dealt to blocks by a
hash, and the blocks stand in an order permuted by a hash. A source draws a fixed number of words, so it
draws whole passes over its blocks and then blocks of one more pass, in the permuted order, up to its
target. The number of blocks drawn from every source is split among the output shards by a binary
tree: at each node the blocks that go left are drawn without replacement from those that arrived, all
sources at once (a multivariate hypergeometric draw). So every shard gets a fixed number of blocks,
every block lands in exactly one shard, and the mixture within each shard varies as if all blocks had
been shuffled. Within a shard the documents follow a random key, which a local sort turns into order.

Only sizes, never texts, are shuffled. The driver holds one row per source and the tree's counts
(sources x shards); documents meet their block's fate in a join on (source, block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import slices

# Documents per block, and the most blocks of one source.
BLOCK_DOCS = 16
MOST_BLOCKS = 4096
# Rows of the table of sources that the driver accepts.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class MixPlan:
    """``budget``: words of the mix as a share of all words; ``weights`` repeat over the sources
    in code point order, null last; no source exceeds ``most`` times its words."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    budget: float = 1.5
    most: float = 2.0
    shards: int = 16
    seed: int = 7


def word_sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words of the whole text; null: 0) and the long columns ``keep``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(2)):
                part.find_words()
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(part.bounds), pa.int64()), *rows.columns[3:]],
                    ["doc_id", "source", "size", *keep],
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", *keep
    ).mapInArrow(run, ", ".join(["doc_id long, source string, size long", *(f"{c} long" for c in keep)]))


def targets(sizes: list[int], plan: MixPlan) -> list[float]:
    """Words to take of every source: shares by weight, each at most ``most`` times its size,
    the excess shared again by weight among the others until none is above."""
    weight = [plan.weights[i % len(plan.weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = plan.budget * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        share = {i: left * weight[i] / total for i in open_}
        full = [i for i in open_ if share[i] > plan.most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = plan.most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def splitting_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of every source (rows) that go to every shard (columns)."""
    out = np.zeros((len(counts), shards), np.int64)

    def split(counts, lo, hi):
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        total = int(counts.sum())
        left = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi])
        taken, rest_total = np.zeros_like(counts), total
        for s, k in enumerate(counts):  # one source after another, given those before
            rest_total -= int(k)
            taken[s] = draw.hypergeometric(int(k), rest_total, left) if left and k else 0
            left -= int(taken[s])
        split(taken, lo, mid)
        split(counts - taken, mid, hi)

    split(np.asarray(counts, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), keep: tuple[str, ...] = ()) -> DataFrame:
    """What a mix takes of every row of ``docs(doc_id, source, text, ...)``.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``: an
    array of (``shard``, ``order_key``, ``words``), one per time the document is taken. All but the last
    copy of a source's last document are whole; that one is cut so that the source's words equal its
    target, rounded. Reading a shard in the order of ``order_key`` gives its shuffled contents.

    Sources are ordered by code point with null last; a null source is one source. A text without words
    has size 0 and takes nothing. Rows with a null id and repeated rows are documents of their own; which
    of two identical rows is taken does not show. The long columns ``keep`` are returned too; others are ignored. Without words every target
    is 0; an empty table gives no rows. More than ``MOST_SOURCES`` sources raise an error, because a
    weight per source is then not a sensible request.
    """
    spark = docs.sparkSession
    seed = plan.seed
    sizes = word_sizes(docs, keep).withColumn("salt", F.monotonically_increasing_id())
    sizes = stored(sizes, "mixture-sizes")
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .limit(MOST_SOURCES + 1).collect()
    )
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goals = targets([r["size"] for r in sources], plan)
    table = [
        (i, r["source"], r["size"], goals[i], min(MOST_BLOCKS, max(1, math.ceil(r["n"] / BLOCK_DOCS))),
         round(goals[i]) // r["size"] if r["size"] else 0,
         round(goals[i]) % r["size"] if r["size"] else 0)
        for i, r in enumerate(sources)
    ]
    schema = "src int, source string, source_size long, target double, blocks int, passes long, rest long"
    known = spark.createDataFrame(table, schema)  # bounded by MOST_SOURCES
    # Equal rows differ in nothing that is hashed; ``salt`` only breaks their tie within a block.
    body = F.xxhash64(F.lit(seed), "doc_id", "size", "source")
    rows = (
        sizes.join(F.broadcast(known), sizes["source"].eqNullSafe(known["source"]))
        .drop(known["source"])
        .withColumn("body", body)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "body"), F.col("blocks")).cast("int"))
    )
    block = rows.groupBy("src", "block").agg(
        F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")
    )
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block"), "block")
    block = stored(
        block.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("until", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("until") - F.col("words")),
        "mixture-blocks",
    )
    drawn = block.groupBy("src").agg(
        F.count(F.lit(1)).alias("all"), F.sum((F.col("before") < F.col("rest")).cast("long")).alias("more"),
        F.first("passes").alias("passes"),
    )
    counts = np.zeros(len(table), np.int64)
    for r in drawn.collect():  # a row per source
        counts[r["src"]] = r["all"] * r["passes"] + r["more"]
    quota = splitting_tree(counts, plan.shards, seed)
    ends = spark.createDataFrame(
        [(i, np.cumsum(q).tolist()) for i, q in enumerate(quota)], "src int, ends array<long>"
    )
    every = drawn.select("src", "all").join(F.broadcast(ends), "src")
    fate = block.select("src", "block", "place", "before", "until", "words").join(
        F.broadcast(every), "src"  # a row per source
    ).withColumnRenamed("words", "block_words")
    rows = rows.join(fate, ["src", "block"])
    cut = (F.col("before") < F.col("rest")) & (F.col("until") > F.col("rest"))
    inner = Window.partitionBy("src", "block").orderBy("body", "doc_id", "size", "salt")
    partial = (
        rows.filter(cut)  # at most one block of a source
        .withColumn("sofar", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.col("sofar"))))
        .drop("sofar")
    )
    whole = rows.filter(~cut).withColumn(
        "last", F.when(F.col("until") <= F.col("rest"), F.col("size")).otherwise(0)
    )
    # The draw of pass p has number p * all + place among the draws of its source.
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda p: F.struct(
            F.size(F.filter("ends", lambda e: e <= p * F.col("all") + F.col("place"))).alias("shard"),
            F.xxhash64(F.lit(seed + 3), "body", p).alias("order_key"),
            F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("last")).cast("long").alias("words"),
        ),
    )
    return whole.unionByName(partial).select(
        "doc_id", sizes["source"], "size", "source_size", "target",
        (F.col("size") * F.col("passes") + F.col("last")).cast("long").alias("taken"),
        F.filter(copies, lambda c: c["words"] > 0).alias("copies"), *keep,
    )
