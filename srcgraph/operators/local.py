"""Searches and ranks of whole repositories inside tasks.

A repository of at most ``IN_TASK`` nodes and edges goes to one task, so that all rounds of an operator
cost one shuffle of its graph; larger ones take the operator's staged rounds.  The task works on arrays:
many origins at once, level by level.  Only nodes that an origin reaches take a place, and origins are taken
in blocks of at most ``SLOTS`` places, so memory follows the graph and not the answer, which leaves the task
in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.stage import Stage

#: Nodes and edges of a repository up to which one task runs all its rounds.
IN_TASK = 4_000_000
#: Places (origin, node that it reaches) that a task holds at a time; a single origin may take more.
SLOTS = 2_000_000
#: Rows of an answer that leave the task at a time.
ROWS = 500_000


class Graph:
    """The graph of one repository: ids in order, deduplicated edges by source, marks and values of the node rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], reverse: bool = False):
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        self.repo = rows["repo"].combine_chunks().slice(0, 1)
        mark = rows["mark"].to_numpy()
        source, target = rows["source"].combine_chunks(), rows["target"].combine_chunks()
        ids = pc.unique(pa.concat_arrays([source, target.drop_null()]))
        self.ids = ids.take(pc.sort_indices(ids))
        self.n = n = len(self.ids)
        s = pc.index_in(source, value_set=self.ids).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = mark == 0
        t = pc.index_in(target.filter(pa.array(edge)), value_set=self.ids).to_numpy(
            zero_copy_only=False).astype(np.int64)
        self.mark = np.zeros(n, np.int8)
        np.bitwise_or.at(self.mark, s[~edge], mark[~edge].astype(np.int8))
        self.value = np.zeros(n)
        if "value" in rows.column_names:
            given = rows["value"].is_valid().to_numpy()
            self.value[s[given]] = rows["value"].drop_null().to_numpy()
        s = s[edge]
        if reverse:
            s, t = t, s
        key = np.unique(s * n + t)
        self.source, self.to = key // max(n, 1), key % max(n, 1)
        self.deg = np.bincount(self.source, minlength=n)
        self.first = np.cumsum(self.deg) - self.deg

    def marked(self, bit: int) -> np.ndarray:
        return np.flatnonzero(self.mark & bit)

    def weak(self) -> np.ndarray:
        """Smallest node of the weak component of every node."""
        label = np.arange(self.n)
        while True:
            a, b = label[self.source], label[self.to]
            apart = a != b
            if not apart.any():
                return label
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up

    def step(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges from the nodes ``v``: the place in ``v`` and the target of each."""
        deg = self.deg[v]
        at = np.repeat(np.arange(len(v)), deg)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(deg) - deg, deg)
        return at, self.to[self.first[v][at] + inside]

    def rows(self, **columns) -> Iterator[pa.RecordBatch]:
        """Answer rows; integer arrays named as ids (a leading underscore) stand for nodes, -1 for null."""
        total = len(next(iter(columns.values())))
        for a in range(0, total, ROWS):
            b = min(total, a + ROWS)
            out = {"repo": self.repo.take(pa.array(np.zeros(b - a, np.int64)))}
            for name, x in columns.items():
                if name.startswith("_"):
                    out[name[1:]] = self.ids.take(pa.array(x[a:b], mask=x[a:b] < 0))
                else:
                    out[name] = x.slice(a, b - a) if isinstance(x, pa.Array) else pa.array(x[a:b])
            yield pa.RecordBatch.from_pydict(out)


class Block:
    """Breadth-first search from a block of origins, which are cut to their first half while it needs too much room.

    A level holds, by origin and node, the place of the origin, the node, and the place in the level before of the
    smallest node that leads to it.
    """

    def __init__(self, g: Graph, origins: np.ndarray, depth: int = -1):
        self.g, self.origins = g, origins
        o, v = np.arange(len(origins)), origins
        self.levels = [(o, v, np.full(len(o), -1))]
        # sorted runs of the places seen, each longer than all later ones
        self.seen = [o * g.n + v]
        self.places = len(o)
        while len(v) and (depth < 0 or len(self.levels) <= depth):
            while len(self.origins) > 1 and self.places + g.deg[v].sum() > SLOTS:
                self._halve()
                o, v, _ = self.levels[-1]
            at, w = g.step(v)
            # the first of equal places comes from the smallest predecessor
            key, at = self._fresh(*np.unique(o[at] * g.n + w, return_index=True), at)
            o, v = key // g.n, key % g.n
            if len(v):
                self.levels.append((o, v, at))
                self._add(key)

    def _fresh(self, key: np.ndarray, one: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[one]
        for run in self.seen:
            if len(run):
                new = run[np.minimum(np.searchsorted(run, key), len(run) - 1)] != key
                key, at = key[new], at[new]
        return key, at

    def _add(self, key: np.ndarray) -> None:
        self.places += len(key)
        self.seen.append(key)
        while len(self.seen) > 1 and len(self.seen[-2]) < 2 * len(self.seen[-1]):
            last = self.seen.pop()
            self.seen[-1] = np.sort(np.concatenate([self.seen[-1], last]), kind="stable")

    def _halve(self) -> None:
        half = len(self.origins) // 2
        self.origins = self.origins[:half]
        for i, level in enumerate(self.levels):
            stop = np.searchsorted(level[0], half)
            self.levels[i] = tuple(x[:stop] for x in level)
        while len(self.levels) > 1 and not len(self.levels[-1][0]):
            self.levels.pop()
        self.seen = [x[:np.searchsorted(x, half * self.g.n)] for x in self.seen]
        self.places = sum(map(len, self.seen))


def blocks(g: Graph, origins: np.ndarray, depth: int = -1) -> Iterator[Block]:
    """All origins block by block, as many at a time as the places of the last block let expect."""
    start, take = 0, max(SLOTS // 16, 1)
    while start < len(origins):
        b = Block(g, origins[start:start + take], depth)
        del b.seen
        yield b
        done = len(b.origins)
        start += done
        take = max(1, min(4 * done, done * SLOTS // (2 * b.places)))


def entries(g: Graph, bit: int) -> np.ndarray:
    """Marked nodes that nothing imports."""
    nodes = g.marked(bit)
    return nodes[np.bincount(g.to, minlength=g.n)[nodes] == 0]


def pairs(depth: int):
    """Nodes around every marked node with their distance."""
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        for b in blocks(g, g.marked(1), depth):
            for d, (o, v, _) in enumerate(b.levels):
                if d:
                    yield from g.rows(_origin=b.origins[o], _id=v, dist=np.full(len(v), d, np.int32))
    return work


def deepest(g: Graph) -> Iterator[pa.RecordBatch]:
    """Largest distance from any entry."""
    far = max((len(b.levels) - 1 for b in blocks(g, entries(g, 1))), default=0)
    yield from g.rows(d=np.array([far], np.int32))


def depths(g: Graph) -> Iterator[pa.RecordBatch]:
    """Distance of every marked node from the nearest entry, 0 where none leads to it."""
    dist = np.full(g.n, -1, np.int32)
    v, d = entries(g, 1), 0
    while len(v):
        dist[v] = d
        d += 1
        v = np.unique(g.step(v)[1])
        v = v[dist[v] < 0]
    nodes = g.marked(1)
    yield from g.rows(_id=nodes, depth=np.maximum(dist[nodes], 0))


def reach(g: Graph) -> Iterator[pa.RecordBatch]:
    """Nodes that every marked node reaches (itself too), the sum of their distances, and the marked nodes."""
    nodes = g.marked(1)
    for b in blocks(g, nodes):
        r, total = np.zeros(len(b.origins), np.int64), np.zeros(len(b.origins), np.int64)
        for d, (o, _, _) in enumerate(b.levels):
            np.add.at(r, o, 1)
            np.add.at(total, o, d)
        yield from g.rows(_id=b.origins, r=r, total=total, n=np.full(len(r), len(nodes)))


def impacts(depth: int, ranked: bool):
    """What a change of every marked node hits, on reversed edges: nodes, direct ones, the sum of their ranks.

    Next to it stand the node's own rank, whether it is a node (mark 2), and the counted nodes (mark 4).
    Ranks are the values of the nodes if these are ``ranked``, else they are found here.
    """
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        n = len(g.marked(4))
        score = g.value if ranked else own_ranks(g, 2, True)
        for b in blocks(g, g.marked(1), depth):
            size = len(b.origins)
            hit, direct, mass = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            for d, (o, v, _) in enumerate(b.levels[1:]):
                np.add.at(hit, o, 1)
                np.add.at(mass, o, score[v])
                if not d:
                    direct = hit.copy()
            yield from g.rows(_target=b.origins, all=hit, direct=direct, mass=mass, pagerank=score[b.origins],
                              known=(g.mark[b.origins] & 2) > 0, n=np.full(size, n))
    return work


def dependencies(g: Graph, origins: np.ndarray) -> np.ndarray:
    """Sum of the dependencies of all origins on every node (Brandes)."""
    whole = np.zeros(g.n)
    for b in blocks(g, origins):
        sigma, arcs = [np.ones(len(b.origins))], []
        for (o, v, _), (p, w, _) in zip(b.levels, b.levels[1:]):
            at, t = g.step(v)
            key, t = p * g.n + w, o[at] * g.n + t
            to = np.minimum(np.searchsorted(key, t), len(key) - 1)
            on = key[to] == t
            at, to = at[on], to[on]
            sigma.append(np.bincount(to, sigma[-1][at], len(p)))
            arcs.append((at, to))
        delta = np.zeros(len(sigma[-1]))
        for d in range(len(arcs) - 1, 0, -1):
            at, to = arcs[d]
            delta = sigma[d] * np.bincount(at, ((1.0 + delta) / sigma[d + 1])[to], len(sigma[d]))
            np.add.at(whole, b.levels[d][1], delta)
    return whole


def betweenness(g: Graph) -> Iterator[pa.RecordBatch]:
    """Dependencies of the origins (mark 1) on every node (mark 2), with the numbers of both."""
    origins, nodes = g.marked(1), g.marked(2)
    delta = dependencies(g, origins)[nodes]
    yield from g.rows(_id=nodes, delta=delta, n=np.full(len(nodes), len(nodes)),
                      k=np.full(len(nodes), len(origins)))


def _peel(n: int, source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Nodes left when those without importers are taken off one after the other."""
    order = np.argsort(source, kind="stable")
    source, to = source[order], to[order]
    deg = np.bincount(source, minlength=n)
    first = np.cumsum(deg) - deg
    left, gone = np.bincount(to, minlength=n), np.zeros(n, bool)
    v = np.flatnonzero(left == 0)
    while len(v):
        gone[v] = True
        d = deg[v]
        w = to[np.repeat(first[v] - np.cumsum(d) + d, d) + np.arange(int(d.sum()))]
        w, c = np.unique(w, return_counts=True)
        left[w] -= c
        v = w[left[w] == 0]
    return ~gone


def strong_labels(g: Graph, inside: np.ndarray | None = None) -> np.ndarray:
    """Smallest node of the strong component of every node, along edges between the nodes ``inside``."""
    label = np.arange(g.n)
    keep = g.source != g.to
    if inside is not None:
        keep &= inside[g.source] & inside[g.to]
    s, t = g.source[keep], g.to[keep]
    for _ in range(2):  # from both ends; what is left lies on cycles or between them
        on = _peel(g.n, s, t)
        on = on[s] & on[t]
        s, t = t[on], s[on]
    nodes = np.unique(s)
    heads = np.split(t[np.argsort(s, kind="stable")], np.searchsorted(np.sort(s), nodes)[1:]) if len(nodes) else []
    after = {int(v): w.tolist() for v, w in zip(nodes, heads)}
    # Tarjan without recursion
    index, low, stack, on_stack = {}, {}, [], set()
    for start in after:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on_stack.add(start)
        work = [(start, iter(after[start]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on_stack.add(w)
                    work.append((w, iter(after.get(w, ()))))
                    break
                if w in on_stack:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    up = work[-1][0]
                    low[up] = min(low[up], low[v])
                if low[v] == index[v]:
                    group = [stack.pop()]
                    while group[-1] != v:
                        group.append(stack.pop())
                    on_stack.difference_update(group)
                    label[group] = min(group)
    return label


def standing(between: bool, ranked: bool):
    """Degrees of every marked node and whether it lies on a cycle of marked nodes (of more than one).

    ``external`` tells marks 2 (not) and 4 (it is), null without them.  ``between`` adds the node's rank and what
    ``betweenness`` gives with all nodes as origins (else null).  Ranks are values or found here, as in ``impacts``.
    """
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        nodes = g.marked(1)
        label = strong_labels(g, (g.mark & 1) > 0)
        none = pa.nulls(len(nodes), pa.float64())
        score = g.value if ranked or not between else own_ranks(g, 1)
        yield from g.rows(
            _id=nodes, external=pa.array((g.mark[nodes] & 4) > 0, mask=(g.mark[nodes] & 6) == 0),
            import_count=g.deg[nodes], imported_by_count=np.bincount(g.to, minlength=g.n)[nodes],
            cycle_count=(np.bincount(label, minlength=g.n)[label[nodes]] > 1).astype(np.int64),
            pagerank=score[nodes] if between else none, delta=dependencies(g, nodes)[nodes] if between else none,
            n=np.full(len(nodes), len(nodes)), k=np.full(len(nodes), len(nodes)))
    return work


def strong_components(marked_only: bool):
    """Components of more than one node, along all edges or only those between marked nodes."""
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        own = (g.mark & 1) > 0
        label = strong_labels(g, own if marked_only else None)
        v = np.flatnonzero(own & (np.bincount(label, minlength=g.n)[label] > 1))
        yield from g.rows(_id=v, _label=label[v])
    return work


def report(strong: bool, top: int = 5):
    """Counts of a metrics report in one row: marks 2 and 4 tell internal and external nodes.

    ``strong`` asks for the largest strong component of the internal nodes too (null without it).
    """
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        nodes = g.marked(1)
        if not len(nodes):
            return
        node, own, foreign = ((g.mark & bit) > 0 for bit in (1, 2, 4))
        incoming = np.bincount(g.to, minlength=g.n)
        between = node[g.source] & node[g.to]
        s, t = g.source[between], g.to[between]
        inner = np.flatnonzero(own)
        out, into = g.deg[inner], incoming[inner]
        first = lambda c: inner[[np.argmax(c)]] if len(inner) else np.array([-1])
        counts = {
            "total_files": len(inner), "external_node_count": int(foreign.sum()), "nodes": len(nodes),
            "links": len(g.to), "total_edges": len(s), "internal_edges": int((own[s] & own[t]).sum()),
            "external_edges": int(foreign[t].sum()), "imports": int(out.sum()),
            "max_imports_in_file": int(out.max(initial=0)), "most_imported_count": int(into.max(initial=0)),
            "isolated_count": int(((out == 0) & (into == 0)).sum()), "entry_points_count": int((into == 0).sum())}
        size = None
        if strong:
            label = strong_labels(g, own)[inner]
            size = int(np.bincount(label).max()) if len(inner) else 0
        far = max((len(b.levels) - 1 for b in blocks(g, entries(g, 1))), default=0)
        lists = {}
        for name, c in (("importers", g.deg[nodes]), ("imported", incoming[nodes])):
            best = np.lexsort((nodes, -c))[:top]
            lists[f"top_{name}"] = pa.array([g.ids.take(pa.array(nodes[best])).to_pylist()], pa.list_(g.ids.type))
            lists[f"{name}_counts"] = pa.array([c[best].astype(float).tolist()], pa.list_(pa.float64()))
        yield from g.rows(
            **{k: np.array([v], np.int64) for k, v in counts.items()},
            _max_imports_file=first(out), _most_imported_module=first(into),
            d=np.array([far], np.int32), largest_scc_size=pa.array([size], pa.int64()), **lists)
    return work


REPORT = (
    "total_files long, external_node_count long, nodes long, links long, total_edges long, internal_edges long, "
    "external_edges long, imports long, max_imports_in_file long, most_imported_count long, isolated_count long, "
    "entry_points_count long, max_imports_file, most_imported_module, d integer, largest_scc_size long, "
    "top_importers ids, importers_counts doubles, top_imported ids, imported_counts doubles")


def clustering(g: Graph) -> float:
    """Sum of the clustering coefficients of all nodes, edges taken as undirected."""
    apart = g.source != g.to
    a, b = g.source[apart], g.to[apart]
    n = max(g.n, 1)
    both = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = both // n, both % n
    degree = np.bincount(np.concatenate([a, b]), minlength=n)
    # from the lower-degree end to the higher one, so that lists of hubs stay short
    rank = np.empty(n, np.int64)
    order = np.lexsort((np.arange(n), degree))
    rank[order] = np.arange(n)
    key = np.sort(np.minimum(rank[a], rank[b]) * n + np.maximum(rank[a], rank[b]))
    lo, hi = key // n, key % n
    later = np.searchsorted(lo, lo, "right") - np.arange(len(lo)) - 1
    ends, start = np.cumsum(later), 0
    triangles = np.zeros(n, np.int64)
    while start < len(lo):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLOTS, "right")))
        e = np.repeat(np.arange(start, stop), later[start:stop])
        other = e + 1 + np.arange(len(e)) - np.repeat(ends[start:stop] - later[start:stop] - base, later[start:stop])
        close = hi[e] * n + hi[other]
        at = np.searchsorted(key, close)
        found = key[np.minimum(at, len(key) - 1)] == close
        e, other = e[found], other[found]
        triangles += np.bincount(np.concatenate([lo[e], hi[e], hi[other]]), minlength=n)
        start = stop
    d = degree[order].astype(float)
    hit = np.flatnonzero(triangles)
    return math.fsum(2 * triangles[hit] / (d[hit] * (d[hit] - 1)))


def shape(g: Graph) -> Iterator[pa.RecordBatch]:
    """Totals, degrees, weak components of the marked nodes and the sum of clustering coefficients."""
    degree = g.deg + np.bincount(g.to, minlength=g.n)
    nodes = g.marked(1)
    if not len(nodes):
        return
    counts = {"total_nodes": g.n, "total_edges": len(g.to), "degrees": int(degree.sum()),
              "max_degree": int(degree.max()), "num_components": int((g.weak()[nodes] == nodes).sum())}
    yield from g.rows(**{k: np.array([v], np.int64) for k, v in counts.items()}, c=np.array([clustering(g)]))


def weak_components(g: Graph) -> Iterator[pa.RecordBatch]:
    nodes = g.marked(1)
    yield from g.rows(_id=nodes, _component=g.weak()[nodes])


def dominator_tree(size: int, source: np.ndarray, to: np.ndarray, root: int) -> np.ndarray:
    """Parent of every node in the dominator tree from ``root`` (its own parent), -1 where no walk leads.

    Starts as a breadth-first tree; a round moves nodes up to the nearest common ancestor of their importers,
    all at once, until every arc comes from below the parent of its end.
    """
    order = np.argsort(source, kind="stable")
    source, to = source[order], to[order]
    deg = np.bincount(source, minlength=size)
    first = np.cumsum(deg) - deg
    parent, depth = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    parent[root] = root
    levels, v = [], np.array([root])
    while len(v):
        d = deg[v]
        at = np.repeat(v, d)
        w = to[np.repeat(first[v], d) + np.arange(len(at)) - np.repeat(np.cumsum(d) - d, d)]
        fresh = parent[w] < 0
        v, one = np.unique(w[fresh], return_index=True)
        parent[v] = at[fresh][one]
        if len(v):
            levels.append(v)
            depth[v] = len(levels)
    # a node with one importer hangs below it for good
    live = (parent[source] >= 0) & (np.bincount(to, minlength=size)[to] > 1) & (to != root)
    source, to = source[live], to[live]
    while True:
        a, b = parent[to], source.copy()
        apart = np.flatnonzero(a != b)
        while len(apart):
            x, y = a[apart], b[apart]
            dx, dy = depth[x], depth[y]
            a[apart], b[apart] = np.where(dx >= dy, parent[x], x), np.where(dy >= dx, parent[y], y)
            apart = apart[a[apart] != b[apart]]
        up = np.flatnonzero(depth[a] < depth[parent[to]])
        if not len(up):
            return parent
        up = up[np.lexsort((depth[a[up]], to[up]))]
        moved, one = np.unique(to[up], return_index=True)
        parent[moved] = a[up[one]]
        for v in levels:
            depth[v] = depth[parent[v]] + 1


def orphans(g: Graph) -> Iterator[pa.RecordBatch]:
    """Rows of ``impact.removal_orphans`` for the marked nodes (the pool)."""
    n, pool = g.n, (g.mark & 1) > 0
    importers = np.bincount(g.to, minlength=n)
    sole = pool & (importers == 1)
    other = g.source != g.to
    s, t = g.source[other], g.to[other]
    only = sole[t]
    doubled = np.zeros(n, bool)
    doubled[s[only]] = True
    # the stand-in of v is n + v, all roots hang below 2 * n
    u = np.where(only, s + n, s)
    twice, roots = doubled[t], np.flatnonzero(pool & (importers == 0))
    starts = np.concatenate([roots, roots[doubled[roots]] + n])
    parent = dominator_tree(
        2 * n + 1, np.concatenate([u, u[twice], np.full(len(starts), 2 * n)]),
        np.concatenate([t, t[twice] + n, starts]), 2 * n)
    kept = np.flatnonzero(pool & (parent[:n] >= 0))
    above = parent[kept]
    while len(kept):
        kept, above = kept[above < 2 * n], above[above < 2 * n]
        counted = above < n
        yield from g.rows(_gone=above[counted], _id=kept[counted], lost=np.zeros(int(counted.sum()), bool))
        above = parent[above]
    unreached = parent[:n] < 0
    lost = unreached & pool
    # a lost node whose only importer goes comes alive, and what it leads to
    opened = only & lost[t]
    gone, v = s[opened], t[opened]
    seen = np.zeros(0, np.int64)
    while len(v):
        seen = np.union1d(seen, gone * n + v)
        yield from g.rows(_gone=gone[lost[v]], _id=v[lost[v]], lost=np.ones(int(lost[v].sum()), bool))
        at, w = g.step(v)
        on = unreached[w] & (w != gone[at])
        key = np.setdiff1d(gone[at][on] * n + w[on], seen)
        gone, v = key // n, key % n
    lost = np.flatnonzero(lost)
    yield from g.rows(_gone=np.full(len(lost), -1), _id=lost, lost=np.ones(len(lost), bool))


def rank(
    inside: np.ndarray, source: np.ndarray, to: np.ndarray, alpha: float, max_iter: int, tol: float | None,
) -> tuple[np.ndarray, bool]:
    """PageRank of the nodes ``inside`` (others 0), and whether the last change is below the tolerance."""
    size = len(inside)
    n = max(int(inside.sum()), 1)
    deg = np.bincount(source, minlength=size)
    got, loose, share = np.where(inside, 1.0 / n, 0.0), inside & (deg == 0), 1.0 / np.maximum(deg, 1)
    done = False
    for _ in range(max_iter):
        sent = np.bincount(to, (got * share)[source], size)
        fresh = np.where(inside, alpha * (sent + got[loose].sum() / n) + (1.0 - alpha) / n, 0.0)
        done = tol is not None and np.abs(fresh - got).sum() < n * tol
        got = fresh
        if done:
            break
    return got, done or tol is None


def ranks(alpha: float, max_iter: int, tol: float | None):
    """PageRank; ``done`` tells whether the last change is below the tolerance."""
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        nodes = g.marked(1)
        got, done = rank((g.mark & 1) > 0, g.source, g.to, alpha, max_iter, tol)
        yield from g.rows(_id=nodes, pagerank=got[nodes], done=np.full(len(nodes), done))
    return work


def own_ranks(g: Graph, bit: int, reverse: bool = False) -> np.ndarray:
    """``spectral.pagerank`` by its defaults of the nodes with this mark."""
    s, t = (g.to, g.source) if reverse else (g.source, g.to)
    got, done = rank((g.mark & bit) > 0, s, t, 0.85, 100, 1e-6)
    if not done:
        raise ValueError("page rank has not converged in 100 rounds")
    return got


def chains(k: int | None, bit: int = 2, first: bool = False):
    """A shortest path from the first ``k`` seeds (of this mark) to every target (mark 1), on reversed edges.

    ``first`` takes as seeds only those that nothing imports.
    """
    def work(g: Graph) -> Iterator[pa.RecordBatch]:
        seed = (g.mark & bit) > 0
        if first:
            seed &= g.deg == 0
        for b in blocks(g, g.marked(1)):
            none = [np.zeros(0, np.int64)]
            hits = [np.flatnonzero(seed[v]) for _, v, _ in b.levels[1:]]
            here = np.concatenate(hits or none)
            o = np.concatenate([x[0][i] for x, i in zip(b.levels[1:], hits)] or none)
            v = np.concatenate([x[1][i] for x, i in zip(b.levels[1:], hits)] or none)
            d = np.repeat(np.arange(1, len(hits) + 1), [len(i) for i in hits])
            order = np.lexsort((v, o))
            nth = np.arange(len(o)) - np.searchsorted(o[order], o[order])
            if k is not None:
                order, nth = order[nth < k], nth[nth < k]
            o, v, d, here = o[order], v[order], d[order], here[order]
            ends = np.cumsum(d + 1)
            path = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
            # the longest paths first: those that a level is part of stand at the front
            order = np.argsort(-d, kind="stable")
            at, far, here = (ends - d - 1)[order], d[order], here[order]
            for level in range(len(b.levels) - 1, -1, -1):
                live = int(np.searchsorted(-far, -level, "right"))
                path[at[:live] + far[:live] - level] = b.levels[level][1][here[:live]]
                here[:live] = b.levels[level][2][here[:live]]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), g.ids.take(pa.array(path)))
            yield from g.rows(_target=b.origins[o], _entry=v, path=lists, rank=(nth + 1).astype(np.int32))
    return work


def by_repo(
    nodes: DataFrame, edges: DataFrame, work: Callable[[Graph], Iterator[pa.RecordBatch]], fields: str,
    in_task: int | None = None, reverse: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Answers of the repositories that fit a task, and the others (``repo``; None if there are none).

    ``nodes`` has ``repo, id`` and may have ``mark`` (bits, default 1) and ``value`` (double, one row a node at most).  ``fields`` names the columns of an
    answer, those without a type being ids.
    """
    stage = Stage(edges.sparkSession, "local")
    repo, kind = nodes.schema["repo"].dataType, nodes.schema["id"].dataType
    mark = F.col("mark") if "mark" in nodes.columns else F.lit(1)
    value = ["value"] if "value" in nodes.columns else []
    rows, _ = stage.save(
        edges.where("source IS NOT NULL AND target IS NOT NULL").select(
            "repo", "source", "target", F.lit(0).cast("byte").alias("mark"))
        .unionByName(nodes.where("id IS NOT NULL").select(
            "repo", F.col("id").alias("source"), F.lit(None).cast(kind).alias("target"),
            mark.cast("byte").alias("mark"), *value), bool(value)))
    limit = IN_TASK if in_task is None else in_task
    large, got = stage.save(
        rows.groupBy("repo").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select("repo"),
        n=F.count(F.lit(1)))
    if got["n"]:
        rows = rows.join(large, "repo", "left_anti")
    schema = T.StructType([T.StructField("repo", repo)])
    for field in fields.split(", "):
        name, _, type_ = field.partition(" ")
        lists = {"ids": kind, "doubles": T.DoubleType()}
        schema = schema.add(name, T.ArrayType(lists[type_]) if type_ in lists else type_ or kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(Graph(batches, reverse))

    return rows.groupBy("repo").applyInArrow(run, schema), large if got["n"] else None


def only(df: DataFrame, repos: DataFrame) -> DataFrame:
    return df.join(repos, "repo", "left_semi")
