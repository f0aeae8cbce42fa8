"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by hash.  A source's target is met by whole passes over
all its blocks and a part of one more pass: blocks in permuted order, and the block on the border to
the word.  The exact block quotas of the sources are split among output shards by a tree: a node of
the tree deals its blocks to its two halves by a multivariate-hypergeometric draw, seeded by the
node's place, so any task can walk from the root to a leaf by itself.  A shard then owns disjoint
runs of every source's permuted blocks, and its rows are ordered by hash.

Per-source sums and block counts (one row a source) go through the driver; documents and blocks don't.

Defined results: null texts have size 0; a source without words has target 0; null is a source of
its own, the last; rows without words are taken 0 times; repeated rows are rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix's words as a multiple of all words, and the most of a source and of a document.
SHARE, MOST = 1.5, 2.0
#: Documents a block, and blocks an output shard, on average.
BLOCK_DOCS, SHARD_BLOCKS = 256, 64

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of every source (in order); the excess over ``most`` sizes is shared anew."""
    n = len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    out: list[float | None] = [None] * n
    rest = share * sum(sizes)
    while True:
        open_ = [i for i in range(n) if out[i] is None]
        total = sum(weight[i] for i in open_)
        if not open_:
            break
        above = [i for i in open_ if rest * weight[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = rest * weight[i] / total
            break
        for i in above:
            out[i] = most * sizes[i]
        rest -= sum(most * sizes[i] for i in above)
    return [float(x) for x in out]


class SplitTree:
    """Deals exact quotas of blocks to shards; every draw depends on the node's place alone."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas = np.array(quotas, dtype=np.int64)
        self.shards, self.seed = shards, seed
        self._left: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, quotas: np.ndarray) -> np.ndarray:
        """Blocks that the lower half of the shards lo .. hi - 1 gets."""
        if (lo, hi) not in self._left:
            total = int(quotas.sum())
            mid = (lo + hi) // 2
            rng = np.random.default_rng([self.seed, lo, hi])
            self._left[lo, hi] = rng.multivariate_hypergeometric(
                quotas, total * (mid - lo) // (hi - lo), method="marginals")
        return self._left[lo, hi]

    def shard(self, source: int, index: int) -> int:
        """Shard of the ``index``-th block that the mix draws of ``source``."""
        lo, hi, quotas = 0, self.shards, self.quotas
        while hi - lo > 1:
            first = self.left(lo, hi, quotas)
            if index < first[source]:
                hi, quotas = (lo + hi) // 2, first
            else:
                index -= int(first[source])
                lo, quotas = (lo + hi) // 2, quotas - first
        return lo


def _same_source(a, b):
    return F.col(a).eqNullSafe(F.col(b))


def plan_sources(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> list[dict]:
    """One row a source: size, target, passes, rest of the target, blocks."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in rows], weights, share, most)
    out = []
    for i, (r, t) in enumerate(zip(rows, goal, strict=True)):
        passes = int(t // r["size"]) if r["size"] else 0
        out.append({"number": i, "name": r["source"], "source_size": int(r["size"]), "target": t, "passes": passes,
                    "rest": int(round(t)) - passes * int(r["size"]) if r["size"] else 0,
                    "blocks": -(-int(r["n"]) // BLOCK_DOCS)})
    return out


SOURCES = T.StructType([
    T.StructField("number", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
    T.StructField("passes", T.IntegerType()), T.StructField("rest", T.LongType()),
    T.StructField("blocks", T.LongType())])


def mix_sources(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE,
                most: float = MOST) -> DataFrame:
    """What the mix takes of every document.

    Columns doc_id, row_key, size, source_size, target, taken, shards (output shard of every draw of
    the document's block) and the rank inside the shard is ``xxhash64(row_key, shard)``.
    """
    spark: SparkSession = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("row_key"), word_count().alias("size"))
    plan = plan_sources(sized, weights, share, most)
    table = spark.createDataFrame([tuple(p[f.name] for f in SOURCES) for p in plan], SOURCES)
    dealt = sized.join(table, _same_source("source", "name")).withColumn(
        "block", F.pmod(F.xxhash64("row_key", F.lit(1)), F.col("blocks")))

    # permuted order of the blocks, and where the last pass ends among them
    blocks = dealt.groupBy("number", "block").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    order = Window.partitionBy("number").orderBy(F.xxhash64("number", "block", F.lit(seed)), "block")
    blocks = blocks.select(
        "number", "block", "rest", "words",
        (F.row_number().over(order) - 1).alias("rank"),
        F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        "passes", F.count("*").over(Window.partitionBy("number")).alias("full"))
    blocks = blocks.withColumn("left", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))

    counts = {r["number"]: r for r in blocks.groupBy("number").agg(
        F.count("*").alias("full"), F.sum((F.col("left") > 0).cast("long")).alias("part")).collect()}
    quotas = [counts[p["number"]]["full"] * p["passes"] + counts[p["number"]]["part"] for p in plan]
    shards = max(1, -(-sum(quotas) // SHARD_BLOCKS))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = SplitTree(quotas, shards, seed)
        for b in batches:
            out = []
            for number, rank, passes, full, left in zip(
                    b.number, b["rank"], b.passes, b.full, b.left, strict=True):
                draws = passes + (left > 0)
                out.append([tree.shard(number, p * full + rank) for p in range(draws)])
            yield pd.DataFrame({"number": b.number, "block": b.block, "left": b.left,
                                "words": b.words, "shards": out})

    placed = blocks.mapInPandas(
        walk, "number int, block long, left long, words long, shards array<long>")
    inside = Window.partitionBy("number", "block").orderBy("row_key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = dealt.join(placed, ["number", "block"]).withColumn(
        "before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    return rows.select(
        "doc_id", "row_key", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), "shards")


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: documents once for every draw, the last draw cut to its words.

    Columns of ``docs`` (``n_chars`` follows the text).  Rows are ordered by hash inside their shard,
    and a shard is one part of the result.
    """
    names = docs.columns
    taken = mix_sources(docs, seed, **options).where(F.col("taken") > 0).select(
        F.col("row_key").alias("__row"), F.col("taken").alias("__taken"), F.col("size").alias("__size"),
        F.col("shards").alias("__shards")).dropDuplicates(["__row"])
    keyed = docs.withColumn("__row", F.xxhash64(F.lit(seed), "doc_id", "text"))
    draws = keyed.join(taken, "__row").withColumn("__draw", F.explode(F.expr(
        "sequence(0L, cast((__taken + __size - 1) div __size as long) - 1)")))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__draw") * F.col("__size"))
    # the first words of a text, with the white space before each
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.when(words >= F.col("__size"), F.col("text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    out = draws.withColumn("__text", head).withColumn(
        "__shard", F.coalesce(F.try_element_at("__shards", (F.col("__draw") + 1).cast("int")), F.lit(0)))
    keep = [F.col("__text").alias("text") if c == "text"
            else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col(f"`{c}`") for c in names]
    return out.select("__shard", "__row", *keep).repartition("__shard").sortWithinPartitions(
        "__shard", F.xxhash64("__row", "__shard")).select(*[F.col(f"`{c}`") for c in names])
