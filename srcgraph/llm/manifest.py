"""Merkle manifest of a table: a persistent tree whose versions copy only the path of a changed leaf.

Every row is a leaf, every language (the key) a binary tree over its leaves in ascending ``doc_id``, and
the subroots, ordered by language, are the leaves of one more tree with the root.  A changed leaf makes a
*version* of the tree: it shares every untouched node with the original and copies the nodes from the
leaf to the root only.

The tree is cut into aligned blocks of ``2 ** height`` neighbouring nodes.  A task builds a block's
nodes, hands every leaf its siblings there, and copies the path of each version up to the block's top.
Tops are the leaves of the next round, which is grouped in blocks again, so a tree over any number of
rows takes a few rounds, each a 1024th of the one before.  Versions are not grouped upwards: each carries
its block's copy on along the path of its own block (one row a block), so no block above gathers them.

Places are found without ordering a language in one task: rows are dealt by range of (language, doc_id,
leaf, row number), counted inside each part, and parts are shifted by the running sum of their counts.

Defined results: a null column is written as ``-``; null ids come first and are never changed; rows of one
id are ordered by their leaves; repeated rows are leaves of their own; a null ``n_chars`` stays null when
changed, so its version equals the original; a language of one row has its leaf as subroot; an empty
table gives an empty result; texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.stage import Stage

#: Levels of a block: 1024 nodes at its bottom.
BLOCK_LEVELS = 10
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One in so many ids (by crc32) is changed in the manifest's trial.
CHANGED = 7


def digest(*nodes: str) -> str:
    """Hash of the concatenated digests."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    return max(0, (n - 1).bit_length())


def written(column: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*[written(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the language; null sorts first), digest, changed (digest of the changed row or null), row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"))
    hit = F.crc32(F.col("doc_id").cast("string")) % CHANGED == 0
    return rows.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("key"), leaf_digest().alias("digest"),
        F.when(hit, leaf_digest(n_chars=F.col("n_chars") + 1)).alias("changed"),
        F.monotonically_increasing_id().alias("row"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key first) of a part with their place among the part's rows of the key."""
    last, count = None, 0
    for batch in batches:
        places = []
        for key in batch.column(0).to_pylist():
            count = count + 1 if key == last else 0
            last = key
            places.append(count)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())],
                                         names=[*batch.schema.names, "local"])


def placed(rows: DataFrame, order: list, stage: Stage) -> DataFrame:
    """``rows`` (key first) with ``pos``, their place in the key by ``order``, and ``n``, the key's rows."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    dealt, _ = stage.save(dealt.mapInArrow(_number, f"{fields}, local long"))
    counts = dealt.groupBy("key", "part").agg((F.max("local") + 1).alias("c"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("c").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "part", before.alias("before"), F.sum("c").over(key).alias("n"))
    return dealt.join(starts, ["key", "part"]).withColumn("pos", F.col("local") + F.col("before")).drop(
        "part", "local", "before")


def build_block(bottom: list[str], levels: int) -> list[list[str]]:
    """Nodes of every level over ``bottom``, lowest first; a last node without a neighbour is hashed alone."""
    tree = [bottom]
    for _ in range(levels):
        below = tree[-1]
        tree.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return tree


def copy_path(tree: list[list[str]], at: int, changed: str) -> list[str]:
    """The nodes that a version with another leaf at ``at`` copies, above the leaf; the others are shared."""
    out, node = [], changed
    for level in tree[:-1]:
        other = level[at ^ 1:(at ^ 1) + 1]
        node = digest(node, *other) if at % 2 == 0 else digest(*other, node)
        out.append(node)
        at //= 2
    return out


def carry_up(node: str, pos: int, siblings: list[str | None]) -> list[str]:
    """Digests above ``node``, level by level."""
    out = []
    for other in siblings:
        node = digest(node) if other is None else digest(node, other) if pos % 2 == 0 else digest(other, node)
        out.append(node)
        pos //= 2
    return out


def _block(height: int):
    """applyInArrow function: the rows of one block with their siblings, their versions' copies and the
    block's top."""
    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        rows = group.to_pydict()
        tree = build_block(rows["digest"], min(height, levels_of(rows["n"][0])))
        siblings, copies = [], []
        for i, changed in enumerate(rows["changed"]):
            siblings.append(
                [level[j] if (j := (i >> h) ^ 1) < len(level) else None for h, level in enumerate(tree[:-1])])
            copies.append(None if changed is None else copy_path(tree, i, changed))
        strings = pa.list_(pa.string())
        return group.append_column("siblings", pa.array(siblings, strings)).append_column(
            "copies", pa.array(copies, strings)).append_column(
            "top", pa.array([tree[-1][0]] * len(siblings), pa.string()))

    return build


def grow(rows: DataFrame, stage: Stage, height: int) -> list[DataFrame]:
    """Rounds of blocks over ``rows`` (key, digest, changed, n, pos and more), lowest first."""
    width = 1 << height
    out = []
    while True:
        block = rows.withColumn("block", F.shiftright("pos", height))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in block.schema)
        now, got = stage.save(block.groupBy("key", "block").applyInArrow(
            _block(height), f"{fields}, siblings array<string>, copies array<string>, top string"), n=F.max("n"))
        out.append(now)
        if (got["n"] or 0) <= width:
            return out
        rows = now.where((F.col("n") > width) & (F.col("pos") % width == 0)).select(
            "key", F.col("top").alias("digest"), F.lit(None).cast("string").alias("changed"),
            F.shiftright(F.col("n") + width - 1, height).alias("n"), F.col("block").alias("pos"))


def paths(rounds: list[DataFrame], height: int) -> tuple[DataFrame, DataFrame]:
    """Of every block of the lowest round the siblings above its top (key, block, path), and of every key
    the node that remains (key, subroot)."""
    def first(table):
        return table.where(F.col("pos") % (1 << height) == 0)

    none = F.array().cast("array<string>")
    path = first(rounds[-1]).select("key", "block", none.alias("path"))
    for table, below in zip(rounds[:0:-1], rounds[-2::-1], strict=True):
        here = table.join(path, ["key", "block"]).select(
            "key", F.col("pos").alias("block"), F.concat("siblings", "path").alias("path"))
        path = first(below).select("key", "block").join(here, ["key", "block"], "left").select(
            "key", "block", F.coalesce("path", none).alias("path"))
    roots = [t.where((F.col("pos") == 0) & (F.col("n") <= 1 << height)).select(
        "key", F.col("top").alias("subroot")) for t in rounds]
    root = roots[0]
    for r in roots[1:]:
        root = root.union(r)
    return path, root


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``copies`` up to the root (of the version, or of the unchanged leaf recomputed)."""
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for i, leaf in enumerate(rows["digest"]):
            inside, above, across = rows["siblings"][i], rows["path"][i], rows["lang_path"][i]
            pos, copied = rows["pos"][i], rows["copies"][i]
            if rows["changed"][i] is None:
                copied = carry_up(leaf, pos, inside)
            node = copied[-1] if copied else rows["changed"][i] or leaf
            copied = copied + carry_up(node, pos >> len(inside), above)
            node = copied[-1] if copied else node
            out.append(copied + carry_up(node, rows["lang_pos"][i], across))
        at = batch.schema.get_field_index("copies")
        yield batch.set_column(at, "copies", pa.array(out, pa.list_(pa.string())))


def merkle_manifest(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """One row a document: doc_id, key, pos (place in its language), digest (leaf), changed (leaf of its
    version, or null), siblings (from the leaf to the root; null where a node is alone), copies (digests of
    the nodes above the leaf in its version, or recomputed from the unchanged leaf), subroot, root."""
    stage = Stage(docs.sparkSession, "manifest")
    leaves, _ = stage.save(leaves_of(docs).select("key", "doc_id", "digest", "changed", "row"))
    order = ["key", F.col("doc_id").asc_nulls_first(), "digest", "row"]
    rounds = grow(placed(leaves, order, stage).drop("row"), stage, height)
    path, subroots = paths(rounds, height)
    # the subroots are the leaves of the upper tree, under one key
    langs = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang"), F.col("subroot").alias("digest"),
                                   F.lit(None).cast("string").alias("changed")), ["key", "lang"], stage)
    upper = grow(langs, stage, height)
    above, root = paths(upper, height)
    langs = upper[0].join(above, ["key", "block"]).join(root.withColumnRenamed("subroot", "root"), "key").select(
        F.col("lang").alias("key"), F.col("digest").alias("subroot"), F.col("pos").alias("lang_pos"),
        F.concat("siblings", "path").alias("lang_path"), "root")
    # one row a block, so that a frequent language is no frequent join key
    blocks, _ = stage.save(path.join(langs, "key"))
    names = ["doc_id", "key", "pos", "digest", "changed", "siblings", "copies", "path", "lang_pos", "lang_path",
             "subroot", "root"]
    rows = rounds[0].join(blocks, ["key", "block"]).select(*names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_versions, fields).select(
        "doc_id", "key", "pos", "digest", "changed", F.concat("siblings", "path", "lang_path").alias("siblings"),
        "copies", "subroot", "root")


def verify_manifest(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    last = F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.coalesce("changed", "digest"))
    return merkle_manifest(docs, height).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), last.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
