"""Near copies among embeddings by an inverted multi-index.

Two codebooks, trained apart on the halves of the vectors, form a product grid of cells; every vector
is in the cell of its nearest centroids.  A vector visits cells in ascending distance (multi-sequence
order: the next cell is the smallest sum of two sorted distance lists) up to the number that reaches
the target recall, and is compared with all vectors of its label there, in double precision.

That number is calibrated on the training sample: every sampled vector is turned by random noise to
the link's least cosine, the hardest case, and the visits must reach the noisy vector's cell for the
target share of them.  A pair is found if either of its vectors visits the other's cell.

Every length of vectors has its own codebooks and visits, fitted on a bounded sample (``sample``
vectors of the length, in hash order); all vectors are indexed and all visit, within their length.
Vectors of one component have no halves: those of a label with the same sign are copies.  Vectors whose
largest component lies outside 1e-100 .. 1e100 are divided by it.  Equal vectors of a label are one class; their copies are counted, not paired.
Cells and their visitors are compared in blocks of bounded size, so a hot cell spreads over tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with nothing and are their own component; repeated rows
are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.linking import components
from srcgraph.stage import Stage

#: Vectors that the codebooks are fitted on, centroids a half, share of hardest pairs to reach.
SAMPLE, CENTROIDS, RECALL = 8192, 32, 0.95
#: Vectors and visitors in a block.
BLOCK, VISITORS = 2048, 4096


def fit_codebook(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's method."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def multi_sequence(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells with the least sum of distances, in ascending order."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    heap, seen, out = [(x[0] + y[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (x[p] + y[q], p, q))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def calibrate(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float, recall: float,
              seed: int = 11) -> int:
    """Cells to visit so that ``recall`` of vectors at cosine ``least`` are reached from either side."""
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(1)[:, None] * x)
    y = least * x + np.sqrt(1 - least * least) * noise
    half = x.shape[1] // 2
    ranks = []
    for here, there in ((x, y), (y, x)):
        d1, d2 = distances(here[:, :half], books[0]), distances(here[:, half:], books[1])
        c1, c2 = distances(there[:, :half], books[0]).argmin(1), distances(there[:, half:], books[1]).argmin(1)
        score = d1[np.arange(len(x)), c1] + d2[np.arange(len(x)), c2]
        # cells before it in multi-sequence order
        d1, d2 = np.sort(d1, axis=1), np.sort(d2, axis=1)
        ranks.append(np.array([np.searchsorted(d2[i], score[i] - d1[i], side="left").sum() for i in range(len(x))]))
    rank = np.minimum(*ranks)
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1


def link_embeddings(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE, centroids: int = CENTROIDS,
                    recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    stage = Stage(spark, "embeddings")
    v = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    whole = (F.col("embedding").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
             & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("ok", F.coalesce(whole, F.lit(False))).withColumn("embedding", F.when(
        F.col("ok") & (F.size("embedding") == 1), F.transform("embedding", F.signum)).otherwise(F.col("embedding")))
    v = v.withColumn(
        "key", F.when(F.col("ok"), F.xxhash64("label", "embedding")).otherwise(F.xxhash64(F.lit("x"), "vec_id")))
    # norms of very small and very large vectors leave the range of a double; their directions do not
    top = F.array_max(F.transform("embedding", F.abs))
    v = v.withColumn("embedding", F.when(F.col("ok") & ~top.between(1e-100, 1e100), F.transform(
        "embedding", lambda x: x / top)).otherwise(F.col("embedding")))
    widths = [r["n"] for r in v.where("ok").select(F.size("embedding").alias("n")).distinct().collect()]
    if not widths:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.lit(True).alias("kept"))
    classes, _ = stage.save(v.where("ok").groupBy("key").agg(
        F.first("label").alias("label"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    fitted = {}
    for width in widths:
        if width == 1:
            continue
        drawn = classes.where(F.size("embedding") == width).orderBy("key").select("embedding").limit(sample).collect()
        x = unit(np.array([r["embedding"] for r in drawn], dtype=np.float64))
        half, k = width // 2, min(centroids, len(x))
        books = (fit_codebook(x[:, :half], k), fit_codebook(x[:, half:], k))
        fitted[width] = (half, k, books, calibrate(x[:2048], books, least, recall))

    def place(batches):
        for b in batches:
            for width, part in b.groupby(b.embedding.map(len)):
                if width == 1:
                    yield part.assign(n=1, cell=0, visits=[[0]] * len(part))
                    continue
                half, k, books, visits = fitted[width]
                y = unit(np.array(part.embedding.tolist(), dtype=np.float64))
                d1, d2 = distances(y[:, :half], books[0]), distances(y[:, half:], books[1])
                yield part.assign(
                    n=width, cell=d1.argmin(1) * k + d2.argmin(1),
                    visits=[[i * k + j for i, j in multi_sequence(d1[r], d2[r], visits)] for r in range(len(part))])

    label = classes.schema["label"].dataType.simpleString()
    placed, _ = stage.save(classes.select("key", "label", "embedding").mapInPandas(
        place, f"key long, label {label}, embedding array<double>, n long, cell long, visits array<long>"))
    visitors = placed.select("key", "label", "embedding", "n", F.explode("visits").alias("cell"))
    at = ["label", "n", "cell"]
    held = placed.groupBy(*at).agg(F.count("*").alias("held"))
    come = placed.select("label", "n", F.explode("visits").alias("cell")).groupBy(*at).agg(
        F.count("*").alias("come"))
    cells, _ = stage.save(held.join(come, at).select(
        *at, F.ceil(F.col("held") / BLOCK).alias("rows"), F.ceil(F.col("come") / VISITORS).alias("cols")))
    # every block of a cell's vectors meets every block of its visitors
    index = placed.select("key", "label", "embedding", "n", "cell").join(cells, at).select(
        *at, F.pmod(F.xxhash64("key"), "rows").alias("row"), F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("col"), "key", "embedding")
    visitors = visitors.join(cells, at).select(
        *at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"),
        F.pmod(F.xxhash64("key"), "cols").alias("col"), "key", "embedding")
    visitors = visitors.select(*[F.col(c).alias(c) for c in visitors.columns])  # names of its own

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return none
        left, right = np.array(a.embedding.tolist()), np.array(b.embedding.tolist())
        lk, rk = a.key.to_numpy(), b.key.to_numpy()
        ln, rn = np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1))
        i, j = np.nonzero(left @ right.T >= (least - 1e-9) * ln[:, None] * rn[None, :])
        exact = (left[i] * right[j]).sum(1) / (ln[i] * rn[j]) >= least
        i, j = i[exact], j[exact]
        other = lk[i] != rk[j]
        p, q = lk[i][other], rk[j][other]
        return pd.DataFrame({"a": np.maximum(p, q), "b": np.minimum(p, q)}).drop_duplicates()

    by = [*at, "row", "col"]
    links, _ = stage.save(index.groupBy(*by).cogroup(visitors.groupBy(*by)).applyInPandas(
        compare, "a long, b long").distinct())
    roots = components(links, stage)
    both = links.union(links.select("b", "a")).toDF("key", "other")
    around = both.join(classes.select(F.col("key").alias("other"), "copies"), "other").groupBy("key").agg(
        F.sum("copies").alias("around"))
    own = v.select("vec_id", "key", "ok")
    own = own.join(classes.select("key", "copies"), "key", "left").join(around, "key", "left").join(
        roots.withColumnRenamed("node", "key"), "key", "left")
    own = own.withColumn("root", F.coalesce("root", "key"))
    smallest = own.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    own = own.join(smallest, "root").withColumn("component_id", F.when(F.col("ok"), F.col("component_id")).otherwise(
        F.col("vec_id")))
    n_links = F.when(F.col("ok"), F.coalesce("around", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0)
    return own.select("vec_id", n_links.cast("long").alias("n_links"), "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
