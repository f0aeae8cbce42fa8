"""Removal of repeated byte strings by suffix arrays built in linear grouping steps.

Every byte covered by a ``width``-byte string that also starts anywhere else goes.  The corpus is cut
into contexts around repeated anchors (see ``repeats``); contexts of an anchor meet in one task.  There
two suffix arrays, one of what stands from the anchors on and one of what stands before them, read
backwards, order all contexts; neighbours' common lengths give classes of equal left and right parts,
and a window repeats where both its parts do.  The arrays are built over blocks of bytes, named in
their lexicographic order, so a context is a few symbols.

Defined results: null and empty texts keep nothing and remove nothing; texts shorter than a window
are kept; repeated rows remove each other whole when they hold a window; very long texts are taken
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm import repeats
from srcgraph.llm.suffix_array import suffix_array
from srcgraph.llm.wordhash import as_bytes
from srcgraph.stage import Stage

#: Bytes a window, and an anchor.
WIDTH, SEED = 200, 32
#: Bytes that make one symbol of the suffix arrays.
SYMBOL = 50


def sorted_classes(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For every length 0 .. width a class number of each string by its first bytes.

    Strings of the same class that are long enough have equal beginnings of that length.
    """
    n = len(parts)
    wide = -(-width // SYMBOL) * SYMBOL
    # a byte is two: 0 stands for none, so that a string ends before any that goes on
    cells = np.zeros((n, wide), dtype=">u2")
    length = np.fromiter((len(p) for p in parts), dtype=np.int64, count=n)
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
    cells[np.arange(wide) < length[:, None]] = flat.astype(np.uint16) + 1
    blocks = cells.reshape(-1, SYMBOL).view(f"S{2 * SYMBOL}").ravel()
    _, names = np.unique(blocks, return_inverse=True)
    per = wide // SYMBOL
    rows = np.zeros((n, per + 1), dtype=np.int64)  # the last symbol, 0, parts the strings
    rows[:, :per] = names.reshape(n, per) + 1
    order = np.array(suffix_array(rows.ravel().tolist()), dtype=np.int64)
    order = order[order % (per + 1) == 0] // (per + 1)
    inside = cells[order]
    differ = inside[1:] != inside[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    out = []
    for k in range(width + 1):
        c = np.empty(n, dtype=np.int64)
        c[order] = np.concatenate(([0], np.cumsum(common < k)))
        out.append(c)
    return out


def solver(unit: repeats.Unit) -> repeats.Solver:
    def solve(h, value, before, behind):
        left = sorted_classes([x[::-1] for x in before], unit.reach)
        right = sorted_classes(behind, unit.width)
        sizes = [np.fromiter((len(x) for x in side), dtype=np.int64, count=len(h)) for side in (before, behind)]
        return repeats.mark(left, right, *sizes, value, False, unit)
    return solve


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every document."""
    unit = repeats.Unit(False, width, seed)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long").alias("id"),
                       F.col("text").cast("string").alias("text"))
    found = repeats.spans(rows, unit, solver(unit), False, Stage(docs.sparkSession, "suffix_dedup"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for data, spans in zip(as_bytes(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                runs = repeats.merged(spans, len(data))
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join((*kept, data[at:]))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(runs),
                                               hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()),
                 pa.array(out[4], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(found, "uid", "left").select(F.col("id"), "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
