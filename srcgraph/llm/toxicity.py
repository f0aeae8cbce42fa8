"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding maps lower-cased homoglyphs of other scripts and digits or signs that stand for letters to
Latin letters; other signs become spaces.  Lexicon entries are word beginnings whose presence tells
the labels apart (log-likelihood ratio against all other beginnings, smoothed log odds as weight).
Matches inside an exception phrase don't count.  The weights found in a text are normalised by its
length, and a logistic curve turns them into a score.

The lexicon is fitted on a bounded sample of the labelled rows (``sample`` rows of
``crc32(doc_id) mod 5 != 0``, in hash order); texts, labels of the sample and nothing else go in.

Defined results: null and empty texts get the score of a text without matches; very long texts are
scored whole; without labelled rows of both kinds every score is 0; repeated rows and ties give
equal scores; a null ``doc_id`` is not held out and never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Homoglyphs and substitutions (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Harmless phrases around words of the lexicon (fixed values; a parameter).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "class clown", "pond scum",
    "loser bracket", "oxymoron")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {i: " " for i in range(128) if not chr(i).isalnum()}
_FOLD |= {ord(k): v for k, v in SUBSTITUTES.items()}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
_FOLD |= {i: None for i in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}  # unseen characters

#: Lengths of the word beginnings that may enter the lexicon; longer words enter whole up to the last.
STEMS = (3, 4, 5, 6, 8, 12)


def fold(text: str | None) -> str:
    return f" {(text or '').lower().translate(_FOLD)} "


def labelled(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` that may be learned from: doc_id, toxic."""
    return labels.where(
        F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def _stems_of(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {w[:n] for w in words for n in STEMS if len(w) >= 3}


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 10_000,
                size: int = 20_000) -> dict:
    """Weights of word beginnings and the curve, as a small plain dictionary."""
    rows = labelled(labels).dropDuplicates(["doc_id"])
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}  # of this task's part of the bounded sample
        totals = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[label] += 1
                for stem in _stems_of(text):
                    counts.setdefault(stem, [0, 0])[label] += 1
        counts[""] = totals
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
             pa.array([c[1] for c in counts.values()], pa.int64())], names=["stem", "clean", "toxic"])

    # the sample is bounded, so its counts are too
    counted = train.mapInArrow(stems, "stem string, clean long, toxic long").groupBy("stem").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.where(F.col("stem") == "").first()
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    empty = {"weights": {}, "curve": [0.0, 0.0, -60.0]}
    if not n0 or not n1:
        return empty
    share = n1 / (n0 + n1)
    seen = F.col("clean") + F.col("toxic")

    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), seen * share) + part(F.col("clean"), seen * (1 - share)))
    picked = (counted.where((F.col("stem") != "") & (F.col("toxic") >= 3)
                            & (F.col("toxic") * n0 > F.col("clean") * n1 * 6))
              .withColumn("ratio", ratio).where(F.col("ratio") > 22.0)
              .orderBy(F.desc("ratio"), F.length("stem"), "stem").limit(size).collect())
    count = {r["stem"]: r["toxic"] for r in picked}
    # a beginning gives way to a longer one that nearly all of its documents have: that one says more
    follow = {stem: [] for stem in count}
    for stem in count:
        for n in STEMS:
            if n < len(stem) and stem[:n] in follow:
                follow[stem[:n]].append(stem)
    general = {u for u in count if any(count[v] >= 0.9 * count[u] for v in follow[u])}
    weights: dict[str, float] = {}
    for r in sorted(picked, key=lambda r: (len(r["stem"]), r["stem"])):
        stem = r["stem"]
        if stem not in general and not any(stem[:n] in weights for n in STEMS if n < len(stem)):
            weights[stem] = float(np.log((r["toxic"] + 0.5) / (n1 + 1)) - np.log((r["clean"] + 0.5) / (n0 + 1)))
    if not weights:
        return empty

    features = train.mapInArrow(_scorer({"weights": weights}, EXCEPTIONS, "toxic"),
                                "toxic int, total double, density double").collect()
    x = np.array([[r["total"], r["density"], 1.0] for r in features])
    y = np.array([r["toxic"] for r in features], dtype=float)
    w = np.zeros(3)
    for _ in range(60):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return {"weights": weights, "curve": w.tolist()}


def automaton(weights: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Lexicon entries at word starts (weight > 0) and whole exception phrases (weight 0)."""
    out = ahocorasick.Automaton()
    for stem, weight in weights.items():
        out.add_word(f" {stem}", (len(stem), weight))
    for phrase in exceptions:
        out.add_word(f" {' '.join(fold(phrase).split())} ", (len(phrase) + 1, 0.0))
    out.make_automaton()
    return out


def features(text: str | None, matcher: ahocorasick.Automaton) -> tuple[float, float]:
    """(log of the weights found, weights found a hundred words)."""
    folded = fold(text)
    hits = [(end - value[0], end, value[1]) for end, value in matcher.iter(folded)]
    if not hits:
        return 0.0, 0.0
    spared = [(s, e) for s, e, w in hits if not w]
    total = sum(w for s, e, w in hits if w and not any(a <= s and e <= b for a, b in spared))
    return float(np.log1p(total)), float(min(10.0, 100 * total / (folded.count(" ") + 1)))


def _scorer(model: dict, exceptions: tuple[str, ...], first: str):
    """mapInArrow function: (text, first) to (first, features)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(model["weights"], exceptions)
        for batch in batches:
            found = [features(t, matcher) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.float64())], names=[first, "total", "density"])
    return run


def score_column(model: dict):
    a, b, c = model["curve"]
    z = F.lit(a) * F.col("total") + F.lit(b) * F.col("density") + F.lit(c)
    return F.when(F.lit(bool(model["weights"])), 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))


def score_toxicity(docs: DataFrame, model: dict, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).mapInArrow(
        _scorer(model, exceptions, "doc_id"), "doc_id long, total double, density double")
    return found.select(
        "doc_id", held.alias("held_out"), score_column(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: dict, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Documents that are not predicted to be toxic; all columns stay."""
    a, b, c = model["curve"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(model["weights"], exceptions)
        for batch in batches:
            found = [features(t, matcher) for t in batch.column(at).to_pylist()]
            keep = [a * total + b * density + c < 0 for total, density in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if model["weights"] else docs
