"""Language of a text by the nearest of several centroids a language, with rejection by distance.

A text is lower-cased and composed (NFC); everything but letters becomes one space.  Its features are the
runs of one to three characters, hashed to ``DIMS`` places.  Their damped counts are weighted by inverse
document frequency and scaled to length one.  The vectors of each language's training sample are
clustered by cosine (k-means on the sphere, started with the texts farthest from each other), and the
normalised means are the language's centroids.  A text gets the language of the centroid with the highest
cosine.  Every centroid keeps the distance that holds nearly all texts of its own cluster; a text farther
away than ``slack`` times that is marked as rejected.

Learned from: text and lang (not null) of the rows whose ``crc32(doc_id) mod 4`` is not 2.  Document
frequencies count all of these rows.  Centroids are fitted on at most ``sample`` ids a language, in hash
order; each language's sample is clustered in one task.  What the driver holds and sends out is
``clusters`` centroids a language of ``DIMS`` numbers each.

Defined results: null texts and texts without a letter are ``und`` with score 0, and not rejected; so is
every text if nothing could be learned; texts are taken whole; ties go to the language that sorts first;
repeated rows give repeated results; a null ``doc_id`` is neither held out nor learned from; of training
rows that share an id and a language one is drawn into the sample; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.llm.wordhash import mix
from srcgraph.stage import Stage

#: Places that features are hashed to; characters a feature at most.
DIMS, LONGEST = 1 << 14, 3
#: Training ids a language for the centroids, centroids a language, rounds of clustering.
SAMPLE, CLUSTERS, ROUNDS = 400, 4, 12
#: Share of a cluster inside its radius, and how many radii away a text is rejected.
INSIDE, SLACK = 0.99, 1.15
#: Characters of text that are counted together.
_PIECE = 1 << 20

_NO_LETTER = re.compile(r"[\W\d_]+")


def clean(text: str | None) -> str:
    """Letters in lower case, with one space between, before and after words; empty without a letter."""
    if not text:
        return ""
    words = _NO_LETTER.sub(" ", unicodedata.normalize("NFC", text).lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of a cleaned text, and how often each is there."""
    total = np.zeros(DIMS, dtype=np.int64)
    # pieces overlap by the longest feature less one character, and each counts those that start in it
    for start in range(0, len(text), _PIECE):
        part = text[start:start + _PIECE + LONGEST - 1]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        run = np.zeros(len(code), dtype=np.uint64)
        for length in range(1, LONGEST + 1):
            if length > len(code):
                break
            run = (run[:len(code) - length + 1] * np.uint64(0x10FFFF + 2)) + code[length - 1:] + np.uint64(1)
            total += np.bincount((mix(run[:_PIECE]) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of a cleaned text, as places and weights."""
    at, n = counts(text)
    w = (1 + np.log(n)) * idf[at]
    return at, w / np.sqrt((w * w).sum())


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text of the rows that may be learned from."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
        & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (place, n): the texts of this task that hold a feature; place -1 counts the texts."""
    held = np.zeros(DIMS + 1, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = clean(text)
            if words:
                held[counts(words)[0]] += 1
                held[DIMS] += 1
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.where(at == DIMS, -1, at)), pa.array(held[at])], names=["place", "n"])


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """Weight of every place, counted over all training rows."""
    rows = train.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).collect()  # DIMS rows at most
    held = np.zeros(DIMS + 1)
    for r in rows:
        held[r["place"]] = r["n"]  # -1 is the last
    return np.log((1 + held[DIMS]) / (1 + held[:DIMS])) + 1


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` unit centroids of the unit rows of ``x``, and every row's centroid."""
    chosen = [int((x @ x.sum(0)).argmin())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:  # only copies are left
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1))[:, None]
        moved = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres, (x @ centres.T).argmax(1)


def fit_languages(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> dict:
    """languages, centroids (a row each), radius of each, idf."""
    spark = docs.sparkSession
    train = learnable(docs)
    idf = inverse_frequencies(train)
    # the first `sample` ids by hash lie below a bound that about twice as many pass: only these are ordered
    ids, _ = Stage(spark, "language_id").save(train.select("lang", "doc_id").distinct())
    share = ids.groupBy("lang").agg((2.0 * sample / F.count("*")).alias("share"))
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    drawn = ids.join(F.broadcast(share), "lang").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).where(
        F.col("place") < F.col("share") * (1 << 40)).withColumn("rank", F.row_number().over(first)).where(
        F.col("rank") <= sample).select("lang", "doc_id")
    # one text an id; equal rows are combined before they are sent
    texts = train.join(F.broadcast(drawn), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    shared = spark.sparkContext.broadcast(idf)

    def centroids(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        kept = [c for c in map(clean, group.column("text").to_pylist()) if c]
        x = np.zeros((len(kept), DIMS))
        for row, text in zip(x, kept, strict=True):
            at, w = vector(text, shared.value)
            row[at] = w
        centres, own = cluster(x, clusters) if kept else (x, np.zeros(0, dtype=np.int64))
        far = 1 - (x * centres[own]).sum(1)
        radius = [float(np.quantile(far[own == i], INSIDE)) if (own == i).any() else 0.0 for i in range(len(centres))]
        return pa.table({
            "lang": pa.array([group.column("lang")[0].as_py()] * len(centres), pa.string()),
            "part": pa.array(range(len(centres)), pa.int64()), "radius": pa.array(radius, pa.float64()),
            "weights": pa.array([c.astype(np.float32) for c in centres], pa.list_(pa.float32()))})

    rows = texts.groupBy("lang").applyInArrow(
        centroids, "lang string, part long, radius double, weights array<float>").toArrow().sort_by(
        [("lang", "ascending"), ("part", "ascending")])
    weights = rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return {"languages": rows.column("lang").to_pylist(), "idf": idf,
            "centroids": np.asarray(weights, dtype=np.float32).reshape(rows.num_rows, DIMS),
            "radius": np.array(rows.column("radius").to_pylist(), dtype=np.float64)}


def classify(text: str | None, model: dict, slack: float = SLACK) -> tuple[str, float, bool]:
    """(language, cosine, rejected) of one text."""
    words = clean(text)
    if not words or not model["languages"]:
        return "und", 0.0, False
    at, w = vector(words, model["idf"])
    cosine = model["centroids"][:, at] @ w
    best = int(cosine.argmax())
    score = float(min(1.0, max(0.0, cosine[best])))
    return model["languages"][best], score, 1 - score > slack * model["radius"][best]


def identify_languages(docs: DataFrame, model: dict, slack: float = SLACK) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t, shared.value, slack) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean").select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
