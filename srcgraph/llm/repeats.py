"""Repeated windows of a corpus: the frame that the two substring operators share.

A window is ``width`` consecutive units (bytes or words) of one document.  Its *anchor* is the run of
``seed`` units with the least hash inside it, so equal windows have equal anchors at equal places, and
about one unit in ``(width - seed) / 2`` is an anchor.

1.  One scan counts the anchors' hashes; the others are unique and no window around them repeats.
2.  A second scan finds the places of repeated anchors, with a hash of the *context*: all units that
    windows around the anchor can hold.  Equal contexts are combined before anything is sent, so a
    passage in a third of all documents is a few rows.
3.  One copy of every context of an anchor with several contexts is read; contexts that share an anchor
    meet in one task and are compared exactly there.  The result is how far repeated windows reach to
    the left and right of the anchor in that context.
4.  Places join their context's reach; that gives covered stretches of every document.

No step expands a group into pairs, and texts move only to contexts' first places and to the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.wordhash import Bytes, Rolling, Words, as_bytes, in_chunks, mix
from srcgraph.llm.wordhash import anchors as find_anchors
from srcgraph.stage import Stage

#: Contexts that are compared together; an anchor's contexts are never parted.
BLOCK = 8192


@dataclass(frozen=True)
class Unit:
    """``words``: units are words, else bytes.  Windows hold ``width`` units, anchors ``seed``."""

    words: bool
    width: int
    seed: int

    @property
    def reach(self) -> int:
        return self.width - self.seed


class _Chunk:
    """Units of some texts: hashes of runs, and where every text's units begin."""

    def __init__(self, texts: list[bytes], unit: Unit):
        if unit.words:
            self.source = Words(texts)
            self.rolling = Rolling(self.source.word)
            self.first = self.source.first
            self.count = np.diff(self.first)
        else:
            self.source = Bytes(texts, separator=b"\0")
            self.rolling = self.source
            self.first = np.concatenate((self.source.starts, [len(self.source.data)]))
            self.count = self.source.ends - self.source.starts
        self.unit = unit

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, place in the chunk, hash) of every anchor."""
        seeds = self.rolling.runs(self.unit.seed)
        width = self.unit.reach + 1
        valid = np.zeros(max(0, len(seeds) - width + 1), dtype=bool)
        for a, n in zip(self.first.tolist(), self.count.tolist(), strict=False):
            if n >= self.unit.width:
                valid[a:a + n - self.unit.width + 1] = True
        at = find_anchors(seeds, width, valid)
        return np.searchsorted(self.first, at, side="right") - 1, at, seeds[at]

    def contexts(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the units around anchors, and of how many stand before and behind."""
        begin = self.first[doc]
        end = begin + self.count[doc]
        lo, hi = np.maximum(begin, at - self.unit.reach), np.minimum(end, at + self.unit.width)
        shape = ((at - lo) * 1024 + (hi - at)).astype(np.uint64)
        return mix(self.rolling.hashes(lo, hi) ^ mix(shape))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count_anchors(unit: Unit):
    """(text, id) to (h, n, lo, hi): anchors of a batch with their number and their ids' range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0).to_pylist())
            ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            hashes, owners = [], []
            for lo, hi in in_chunks(texts):
                doc, _, h = _Chunk(texts[lo:hi], unit).anchors()
                hashes.append(h)
                owners.append(ids[lo:hi][doc])
            if not hashes or not sum(map(len, hashes)):
                continue
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            border = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            yield pa.RecordBatch.from_arrays(
                [_signed(h[border]), pa.array(np.diff(np.append(border, len(h)))),
                 pa.array(np.minimum.reduceat(owner, border)), pa.array(np.maximum.reduceat(owner, border))],
                names=["h", "n", "lo", "hi"])
    return run


def _place_anchors(unit: Unit):
    """(text, uid, id) to (h, c, uid, id, pos)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0).to_pylist())
            uid = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2)
            for lo, hi in in_chunks(texts):
                chunk = _Chunk(texts[lo:hi], unit)
                doc, at, h = chunk.anchors()
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(chunk.contexts(doc, at)), pa.array(uid[lo:hi][doc]),
                     ids.slice(lo, hi - lo).take(pa.array(doc)),
                     pa.array((at - chunk.first[doc]).astype(np.int32))], names=["h", "c", "uid", "id", "pos"])
    return run


def _cut_contexts(unit: Unit):
    """(text, [(h, c, v, pos)]) to (h, c, v, before, behind): the units around, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = as_bytes([text])[0]
                if unit.words:
                    words = Words([data])
                    starts, ends = words.word_start, words.word_end
                for p in places:
                    pos = p["pos"]
                    if unit.words:
                        lo, hi = max(0, pos - unit.reach), min(len(starts), pos + unit.width) - 1
                        cut = starts[pos]
                        before, behind = data[starts[lo]:cut], data[cut:ends[hi]]
                    else:
                        before = data[max(0, pos - unit.reach):pos]
                        behind = data[pos:pos + unit.width]
                    for column, value in zip(out, (p["h"], p["c"], p["v"], before, behind), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(x, pa.binary()) for x in out[3:]],
                names=["h", "c", "v", "before", "behind"])
    return run


#: (h, v, before, behind) of whole groups to (marked, left, right).
Solver = Callable[[np.ndarray, np.ndarray, list, list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _solve(solver: Solver):
    """Rows sorted by h, c to (h, c, left, right) where repeated windows reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table) -> pa.RecordBatch:
            h, c, v = (table.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))  # repeated rows of a document
            if not new.all():
                table = table.filter(pa.array(new))
                h, c, v = h[new], c[new], v[new]
            marked, left, right = solver(h, v, table.column(3).to_pylist(), table.column(4).to_pylist())
            return pa.RecordBatch.from_arrays(
                [pa.array(h[marked]), pa.array(c[marked]), pa.array(left[marked].astype(np.int32)),
                 pa.array(right[marked].astype(np.int32))], names=["h", "c", "left", "right"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield solved(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows -= cut
        if rows:
            yield solved(pa.Table.from_batches(held))
    return run


def spans(docs: DataFrame, unit: Unit, solver: Solver, owner: bool, stage: Stage) -> DataFrame:
    """``uid, spans`` (array of start, end in units) of documents (uid, id, text) with covered stretches.

    ``owner``: only windows that also start in a document of a smaller id are covered; else windows
    that start anywhere else too.  Stretches may overlap and reach beyond the document.
    """
    anchored = docs.where(F.col("id").isNotNull()) if owner else docs
    counted = anchored.select("text", "id").mapInArrow(_count_anchors(unit), "h long, n long, lo long, hi long")
    again: Column = F.min("lo") < F.max("hi") if owner else F.sum("n") > 1
    repeated, _ = stage.save(counted.groupBy("h").agg(again.alias("again")).where("again").select("h"))
    places, _ = stage.save(anchored.select("text", "uid", "id").mapInArrow(
        _place_anchors(unit), "h long, c long, uid long, id long, pos int").join(repeated, "h", "left_semi"))

    # v: the smallest id of a context's documents, or the number of its places
    value: Column = F.min("id") if owner else F.count("*")
    contexts, _ = stage.save(places.groupBy("h", "c").agg(
        value.alias("v"), F.min(F.struct("uid", "pos")).alias("at")))
    if owner:
        open_: Column = F.min("v") < F.max("v")
    else:
        open_ = (F.count("*") > 1) & (F.min("v") == 1)
    several = contexts.groupBy("h").agg(open_.alias("open")).where("open").select("h")
    first = contexts.join(several, "h", "left_semi").groupBy("at.uid").agg(
        F.collect_list(F.struct("h", "c", "v", F.col("at.pos").alias("pos"))).alias("places"))
    cut = docs.select("uid", "text").join(first, "uid").select("text", "places").mapInArrow(
        _cut_contexts(unit), "h long, c long, v long, before binary, behind binary")
    reach, _ = stage.save(cut.repartition("h").sortWithinPartitions("h", "c").mapInArrow(
        _solve(solver), "h long, c long, left int, right int"))

    known = contexts.select("h", "c", "v").join(reach, ["h", "c"], "left")
    whole = F.col("id") > F.col("v") if owner else F.col("v") > 1
    known = known.where(F.col("left").isNotNull() | (F.lit(True) if owner else F.col("v") > 1))
    covered = places.join(known, ["h", "c"]).select(
        "uid", (F.col("pos") - F.when(whole, unit.reach).otherwise(F.col("left"))).alias("start"),
        (F.col("pos") + F.when(whole, unit.width).otherwise(F.col("right"))).alias("end")).where("start is not null")
    return covered.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(found: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs inside 0 .. n of overlapping or touching stretches."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((max(0, x["start"]), min(n, x["end"])) for x in found or ()):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        elif e > s:
            out.append((s, e))
    return out


def mark(left: list[np.ndarray], right: list[np.ndarray], before: np.ndarray, behind: np.ndarray,
         value: np.ndarray, owner: bool, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts hold repeated windows, and how far these reach.

    ``left[d]`` is a class for every context by its d units before the anchor, ``right[r]`` by its r
    units from the anchor on; ``before`` and ``behind`` are the units there are.
    """
    n = len(value)
    reach_left = np.full(n, -1, dtype=np.int64)
    reach_right = np.full(n, -1, dtype=np.int64)
    for d in range(unit.reach + 1):
        r = unit.width - d
        has = np.flatnonzero((before >= d) & (behind >= r))
        if len(has) < 2:
            continue
        key = left[d][has].astype(np.int64) * n + right[r][has]
        order = np.argsort(key, kind="stable")
        key, at = key[order], has[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        if owner:
            least = np.minimum.reduceat(value[at], np.flatnonzero(new))
            hit = at[value[at] > least[group]]
        else:
            hit = at[np.bincount(group)[group] > 1]
        reach_left[hit] = d
        first = hit[reach_right[hit] < 0]
        reach_right[first] = r
    return reach_left >= 0, reach_left, reach_right
