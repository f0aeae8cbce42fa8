"""Removal of repeated passages: recurring phrases in Aho-Corasick automata.

A window of ``width`` words that also starts in a document with a smaller id goes.  Phrases that recur
in several documents (anchors of windows, see ``repeats``) are confirmed by a count over the corpus and
dealt into shards by hash.  A shard compiles its phrases into an Aho-Corasick automaton over word
numbers and streams the stretches of all documents around such phrases through it; the matches line
the stretches up, and windows that hold the same words as one of a smaller document are found exactly.

Defined results: null and empty texts have no words; texts shorter than a window are kept; a document
with a null id neither loses words nor makes others lose them; repeated rows with one id keep their
words; very long texts are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm import repeats
from srcgraph.llm.wordhash import as_bytes
from srcgraph.stage import Stage

#: Words a window, and a phrase.
WIDTH, PHRASE = 50, 16


def phrase_automaton(phrases: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    """Automaton over word numbers; a match gives the phrase's number."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(phrases):
        out.add_word(p, i + 1)
    out.make_automaton()
    return out


def _classes(columns: np.ndarray) -> list[np.ndarray]:
    """Class of every row by its first 0, 1, ... columns."""
    n, width = columns.shape
    out = [np.zeros(n, dtype=np.int64)]
    top = int(columns.max(initial=0)) + 2
    for k in range(width):
        _, c = np.unique(out[-1] * top + columns[:, k] + 1, return_inverse=True)
        out.append(c.astype(np.int64))
    return out


def solver(unit: repeats.Unit) -> repeats.Solver:
    def solve(h, value, before, behind):
        texts = [x.split() for x in before], [x.split() for x in behind]
        number: dict[bytes, int] = {}
        numbered = [[[number.setdefault(w, len(number)) for w in words] for words in side] for side in texts]
        phrases = list(dict.fromkeys(tuple(x[:unit.seed]) for x in numbered[1]))
        automaton = phrase_automaton(phrases)
        n = len(h)
        left = np.full((n, unit.reach), -1, dtype=np.int64)
        right = np.full((n, unit.width), -1, dtype=np.int64)
        sizes = np.zeros((2, n), dtype=np.int64)
        for i, (b, a) in enumerate(zip(*numbered, strict=True)):
            stretch = b + a
            # the stretch lies around one phrase: the match there lines it up
            for end, _ in automaton.iter(tuple(stretch)):
                at = end - unit.seed + 1
                if at == len(b):
                    left[i, :at] = stretch[at - 1::-1] if at else []
                    right[i, :len(a)] = stretch[at:]
                    sizes[:, i] = at, len(a)
                    break
        return repeats.mark(_classes(left), _classes(right), *sizes, value, True, unit)
    return solve


def remove_passages(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (words joined by a space) of every document."""
    unit = repeats.Unit(True, width, phrase)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long").alias("id"),
                       F.col("text").cast("string").alias("text"))
    found = repeats.spans(rows, unit, solver(unit), True, Stage(docs.sparkSession, "passage_dedup"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for data, spans in zip(as_bytes(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                words = data.split()  # of bytes: at the six white-space bytes
                n = len(words)
                kept, at = [], 0
                for s, e in repeats.merged(spans, n):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                text = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(text).hexdigest(),
                                               text.decode("utf-8", "surrogatepass")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(found, "uid", "left").select(F.col("id"), "text", "spans").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
