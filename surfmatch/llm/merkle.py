"""Merkle dataset manifest (operator 11): a persistent path-copying tree over aligned blocks.

Leaves are numbered within their tree (one for each language) by a range sort of
digests and per-partition counts, so a language that holds most rows is spread over
all tasks. 2**bits consecutive leaves are an aligned block, which one task folds into
one node; the nodes of all blocks are the leaves of the next round, in blocks again,
until every tree has one node. The subroots are the leaves of one more such tree.

Paths come down the same rounds: a block learns its siblings above once and shares
them with all its leaves. A tampered leaf makes a version of the tree: it copies only
the ancestors of that leaf, inside its block and on along the block's shared path
above; all other nodes are those of the tree as it was. Versions are rows beside
their leaf and never meet in one task, however high they rise.

``build`` makes the rounds, ``prove`` opens them again: digest, siblings, copied nodes
and folded root of every leaf; ``copied_nodes`` lists what versions do not share.

Cases: a null is encoded as ``-``; null lang is a tree of its own, before all others;
null doc_id stands first in its tree and is never tampered; repeated rows are leaves
of their own, ties in doc_id go by digest; a lone leaf is its tree's root and has no
siblings; an empty table gives no rows; texts are hashed whole by built-in functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surfmatch.llm.common import materialize, pick, small_batches

#: Levels that one block spans.
BITS = 10
#: Runs of (tree, partition) that may be broadcast; more are joined by shuffle.
FEW = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, or ``-`` for null: no two rows encode alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """name (doc_id), tree, digest and version (digest of the tampered row, else null) of every row; tampering adds 1 to n_chars."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    more = n_chars.cast("decimal(20,0)") + 1
    return pick(docs, *FIELDS).select(
        doc_id.alias("name"),
        F.coalesce(F.concat(F.lit("1"), lang), F.lit("0")).alias("tree"),
        row_digest(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(tampered, row_digest(doc_id, source, lang, more, text)).alias("version"),
    )


def numbered(items: DataFrame, *order: str) -> DataFrame:
    """items with at, their place in their tree from 0, and total, the tree's size."""
    ranged = items.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ranged")
    runs = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    below = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = materialize(runs.select("tree", "part", (F.coalesce(below, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), "runs")
    out = ranged.join(F.broadcast(runs) if runs.count() <= FEW else runs, ["tree", "part"])
    return out.withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def node(*below: str) -> str:
    return hashlib.sha256("".join(below).encode()).hexdigest()


class Block:
    """All nodes of an aligned block: levels[0] are its leaves, the last level its root."""

    def __init__(self, digests: list[str], total: int, bits: int):
        self.levels = [digests]
        for _ in range(min(bits, (total - 1).bit_length())):
            below = self.levels[-1]
            self.levels.append([node(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[str]:
        """Level by level: L or R and the sibling on that side, or nothing where there is none."""
        steps = []
        for level in self.levels[:-1]:
            steps.append("L" + level[i - 1] if i & 1 else "R" + level[i + 1] if i + 1 < len(level) else "")
            i >>= 1
        return steps


def ancestors(digest: str, path: list[str]) -> Iterator[str]:
    """The copies that a leaf of this digest makes of the nodes above it."""
    for step in path:
        digest = node(step[1:], digest) if step[:1] == "L" else node(digest, step[1:])
        yield digest


def blocks(items: DataFrame, bits: int) -> DataFrame:
    """Aligned blocks of items(tree, at, total, digest, name, version), each with its entries in order and its root."""

    @F.pandas_udf("string")
    def root(digests: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([Block(list(d), n, bits).root for d, n in zip(digests, total)], dtype=object)

    held = items.groupBy("tree", F.shiftright("at", bits).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "name", "version"))).alias("entries"))
    return held.withColumn("root", root("entries.digest", "total"))


class Manifest(NamedTuple):
    trees: list[DataFrame]  # rounds of blocks, leaves first, of all trees of documents
    forest: list[DataFrame]  # the same over their roots
    bits: int


def rounds(items: DataFrame, bits: int) -> list[DataFrame]:
    """Blocks round by round until no tree has more than one."""
    out = []
    while True:
        out.append(materialize(blocks(items, bits), "blocks"))
        most = out[-1].agg(F.max("total")).first()[0]
        if most is None or most <= 1 << bits:
            return out
        items = out[-1].select("tree", F.col("block").alias("at"), F.shiftright(F.col("total") + ((1 << bits) - 1), bits).alias("total"), F.col("root").alias("digest"), *nothing())


def nothing() -> list[Column]:
    return [F.lit(None).cast("long").alias("name"), F.lit(None).cast("string").alias("version")]


def build(leaf_rows: DataFrame, bits: int = BITS) -> Manifest:
    """The manifest of leaf_rows(tree, name, digest, version): every tree in rounds of blocks, and one tree over their roots."""
    small_batches(leaf_rows.sparkSession)
    trees = rounds(numbered(materialize(leaf_rows, "leaves"), "name", "digest"), bits)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("version"))
    return Manifest(trees, rounds(numbered(tops, "name"), bits), bits)


def opened(held: DataFrame, bits: int, name: str) -> DataFrame:
    """Blocks with the path above them, as rows of their entries with their own whole path."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                entries = row["entries"]
                block = Block([e["digest"] for e in entries], row["total"], bits)
                n = len(entries)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n),
                        pa.array([e["at"] for e in entries], pa.int64()),
                        pa.array([e["name"] for e in entries], batch.schema.field("entries").type.value_type.field("name").type),
                        pa.array([e["digest"] for e in entries]),
                        pa.array([block.path(i) + row["path"] for i in range(n)], pa.list_(pa.string())),
                        pa.array([row["top"]] * n),
                    ],
                    ["tree", "at", "name", "digest", "path", "top"],
                )

    return held.mapInArrow(run, f"tree string, at long, name {name}, digest string, path array<string>, top string")


def with_paths(levels: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The blocks of the first round with path and top, given those of each tree in above(tree, path, top)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(levels):
        held = level.join(above, ["tree", "block"])
        if level is not levels[0]:
            above = opened(held, bits, "long").select("tree", F.col("at").alias("block"), "path", "top")
    return held


def prove(manifest: Manifest) -> DataFrame:
    """name, tree, leaf, subroot, root, siblings (joined), folded_root, copied (nodes of the leaf's version, leaf first; null if it has none) of every leaf."""
    bits = manifest.bits
    start = manifest.forest[-1].select("tree", F.array().cast("array<string>").alias("path"), F.col("root").alias("top"))
    forest = opened(with_paths(manifest.forest, start, bits), bits, "string")
    above = materialize(forest.select(F.col("name").alias("tree"), "path", "top", F.col("digest").alias("subroot")), "paths")
    held = with_paths(manifest.trees, above.drop("subroot"), bits).join(above.select("tree", "subroot"), "tree")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                entries, above, known = row["entries"], row["path"], {}
                block = Block([e["digest"] for e in entries], row["total"], bits)
                shared = "".join(s[1:] for s in above)
                siblings, folded, copied = [], [], []
                for i, e in enumerate(entries):
                    path = block.path(i)
                    nodes = [e["version"] or e["digest"], *ancestors(e["version"] or e["digest"], path)]
                    if nodes[-1] not in known:  # the block's root as it was, or a version's
                        known[nodes[-1]] = list(ancestors(nodes[-1], above))
                    higher = known[nodes[-1]]
                    siblings.append("".join(s[1:] for s in path) + shared)
                    folded.append((higher or nodes)[-1])
                    copied.append(nodes + higher if e["version"] else None)
                n = len(entries)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e["name"] for e in entries], pa.int64()),
                        *(pa.array(x, pa.string()) for x in ([row["tree"]] * n, block.levels[0], [row["subroot"]] * n, [row["top"]] * n, siblings, folded)),
                        pa.array(copied, pa.list_(pa.string())),
                    ],
                    ["name", "tree", "leaf", "subroot", "root", "siblings", "folded_root", "copied"],
                )

    return held.mapInArrow(run, "name long, tree string, leaf string, subroot string, root string, siblings string, folded_root string, copied array<string>")


def copied_nodes(proved: DataFrame) -> DataFrame:
    """version (its leaf's name), level and digest of every node that a version does not share."""
    return proved.select(F.col("name").alias("version"), F.posexplode("copied").alias("level", "digest"))


def manifest_proofs(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: rows whose doc_id has a CRC-32 divisible by 7 are tampered."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    proved = prove(build(leaves(docs, tampered), bits))
    return proved.select(
        F.col("name").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
