"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents are dealt by hash to groups of bounded size, and every group is packed by itself: pieces in
descending size, bins ordered by what they have left.  A bin carries a bitmap of the sources that have
used up their share of it and a bitmap of the duplicate clusters it holds.  The successor search
starts at the tightest bin that has room and goes on to the next until one is compatible; if none is,
a new bin opens.  Documents longer than a bin are cut into pieces of a bin's size and a rest.

Defined results: null and empty texts are pieces of 0 words; null source and null cluster are values
of their own; repeated rows are copies of each other (one cluster), so they never share a bin; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.mixing import word_count

#: Words a bin, the most of a bin that one source may have before it is closed to it, rows a group.
CAPACITY, SOURCE_SHARE, GROUP_ROWS = 2048, 0.5, 2048


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int,
         source_share: float) -> list[int]:
    """Bin of every piece; pieces must come in descending size."""
    free: list[tuple[int, int]] = []  # (words left, bin), ordered
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    words: list[dict[int, int]] = []
    limit = capacity * source_share
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(free, (size, -1))
        while at < len(free):
            b = free[at][1]
            if not (source_bits[b] & source_bit or cluster_bits[b] & cluster_bit):
                break
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(words)
            source_bits.append(0)
            cluster_bits.append(0)
            words.append({})
        cluster_bits[b] |= cluster_bit
        words[b][source] = words[b].get(source, 0) + size
        if words[b][source] >= limit:
            source_bits[b] |= source_bit
        if left > size or size == 0:
            insort(free, (left - size, b))
        out.append(b)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, source_share: float = SOURCE_SHARE,
                   group_rows: int = GROUP_ROWS, cluster: Column | None = None) -> DataFrame:
    """Bins of every piece of every document.

    ``cluster`` names the duplicate cluster of a row; by default equal texts are a cluster.
    Columns: doc_id, piece (from 0), n_pieces, first_word, n_words, pack_group, bin, bin_words.
    """
    groups = max(1, -(-docs.count() // group_rows))
    key = F.xxhash64("text") if cluster is None else F.xxhash64(cluster)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("cluster"),
        word_count().alias("size"), F.monotonically_increasing_id().alias("row"))
    # rows of a hot cluster or source are dealt to all groups, as the group is by row
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(groups)))
    rows = rows.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).select(
        "doc_id", "source", "cluster", "pack_group", "n_pieces", "piece",
        (F.col("piece") * F.lit(capacity)).cast("long").alias("first_word"),
        F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("n_words"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        # full pieces are bins of their own; the others go by size, ties by id
        part = part.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True],
                                kind="stable")
        bins = pack(part.n_words.tolist(), pd.factorize(part.source.fillna("\0"))[0].tolist(),
                    pd.factorize(part.cluster)[0].tolist(), capacity, source_share)
        part = part.assign(bin=bins)
        part["bin_words"] = part.groupby("bin").n_words.transform("sum")
        return part[["doc_id", "piece", "n_pieces", "first_word", "n_words", "pack_group", "bin", "bin_words"]]

    return pieces.groupBy("pack_group").applyInPandas(
        fill, "doc_id long, piece int, n_pieces int, first_word long, n_words long, pack_group long, "
              "bin long, bin_words long")
