"""Directed graphs whose vertices fit in arrays on the driver, with edges in packed chunks.

Vertices are 0 .. n-1; what is known of each is an array. Each edge stands at its
tail and at its head, in chunks sorted by that end, so a pass over the chunks has
what it needs of a vertex in one place, or in a few chunks for a vertex of many
edges. A pass broadcasts arrays, runs one NumPy kernel on each chunk, and returns
about a row a vertex. Edges stay on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import erase, written

#: Rows of a chunk (an edge makes two), about.
CHUNK = 1 << 18
_TYPES = {"a": np.int32, "b": np.int32, "w": np.float64, "d": np.int8}
_EDGES = {c: _TYPES[c] for c in "abw"}
#: Keys (pairs of vertices) that a chunk gives to the sample that ranges come from.
SAMPLE = 512


def _batch(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in order, those between the same two vertices as one."""
    key = a.astype(np.int64) * n + b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    w = np.add.reduceat(w[order], first) if len(first) else w
    return (key[first] // n).astype(np.int32), (key[first] % n).astype(np.int32), w


def _blob(names: dict, columns: dict):
    """One row: arrays as binary, numbers as they are."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([columns[c].tobytes()], pa.binary()) if t else pa.array([columns[c]], pa.int64()) for c, t in names.items()], names=list(names))


def _arrays(batch, names=_TYPES) -> Iterator[list[np.ndarray]]:
    """The arrays (a, b, w, d) of each row."""
    for k in range(batch.num_rows):
        yield [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in names.items()]


def _starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))


class PackedGraph:
    """``n`` vertices, and ``m`` edges as a table of chunks."""

    def __init__(self, table: DataFrame, edges, n: int, m: int) -> None:
        """``edges(batch)`` gives arrays (a, b, w) of the edges in an Arrow batch of ``table``; ``m``: their number, about."""
        chunks = max(1, -(-2 * m // CHUNK))

        def sample(batches) -> Iterator:
            for batch in batches:
                for a, b, _ in edges(batch):
                    some = slice(None, None, max(1, 2 * len(a) // SAMPLE))
                    yield _batch({"k": np.concatenate([a[some].astype(np.int64) * n + b[some], b[some].astype(np.int64) * n + a[some]])})

        # Ranges of (end, other end): a vertex of many edges is spread over chunks.
        keys = np.sort(table.mapInArrow(sample, "k long").toArrow().column("k").to_numpy()) if chunks > 1 else np.zeros(0, np.int64)
        bounds = keys[np.arange(1, chunks) * len(keys) // chunks] if len(keys) else keys

        def deal(batches) -> Iterator:
            for batch in batches:
                for a, b, w in edges(batch):
                    a, b, w = _summed(a, b, w, n)
                    d = np.repeat(np.arange(2, dtype=np.int8), len(a))
                    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
                    # Sixteen bits are sorted by radix.
                    to = np.searchsorted(bounds, a.astype(np.int64) * n + b, "right").astype(np.uint16 if chunks < 1 << 16 else np.int64)
                    order = np.argsort(to, kind="stable")
                    cuts = np.searchsorted(to[order], np.arange(chunks + 1))
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        own = order[cuts[k] : cuts[k + 1]]
                        yield _blob({"k": None, **_TYPES}, {"k": k, "a": a[own], "b": b[own], "w": w[own], "d": d[own]})

        def pack(batches) -> Iterator:
            have: dict[int, list] = {}
            for batch in batches:
                for k, own in zip(batch.column("k").to_pylist(), _arrays(batch)):
                    have.setdefault(k, []).append(own)
            for k in sorted(have):
                a, b, w, d = (np.concatenate(x) for x in zip(*have.pop(k)))
                a, b, w = _summed(a, b.astype(np.int64) * 2 + d, w, 2 * n)
                d = (b & 1).astype(np.int8)
                yield _blob({**_TYPES, "m": None}, {"a": a, "b": b >> 1, "w": w, "d": d, "m": int((d == 0).sum())})

        ends = ", ".join(f"{c} binary" for c in _TYPES)
        self.n, self._singles = n, None
        self.chunks = written(table.mapInArrow(deal, f"k long, {ends}").repartition(chunks, "k").mapInArrow(pack, f"{ends}, m long"))
        self.m = self.chunks.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]

    def erase(self) -> None:
        erase(self.chunks)

    def rows(self, kernel, names: str, *shared) -> list[np.ndarray]:
        """Columns of what ``kernel(a, b, w, d, *shared)`` returns for each chunk, all chunks' together."""
        sent = self.chunks.sparkSession.sparkContext.broadcast(shared)
        columns = [x.split()[0] for x in names.split(", ")]

        def part(batches) -> Iterator:
            for batch in batches:
                for own in _arrays(batch):
                    yield _batch(dict(zip(columns, kernel(*own, *sent.value))))

        t = self.chunks.select(*_TYPES).mapInArrow(part, names).toArrow()
        sent.unpersist()
        return [t.column(c).to_numpy() for c in columns]

    def edges(self) -> list[np.ndarray]:
        """u, v, w of all edges, on the driver."""
        return self.rows(lambda a, b, w, d: (a[d == 0], b[d == 0], w[d == 0]), "u int, v int, w double")

    def heaviest(self) -> np.ndarray:
        """The neighbour at each vertex's heaviest edge, the least of equal ones; -1 without an edge."""

        def kernel(a, b, w, d):
            s = _starts(a)
            top = np.maximum.reduceat(w, s)
            size = np.diff(np.append(s, len(a)))
            return a[s], top, np.minimum.reduceat(np.where(w == np.repeat(top, size), b, np.int32(self_n)), s)

        self_n = self.n
        a, w, b = self.rows(kernel, "a int, w double, b int")
        order = np.lexsort((b, -w, a))
        order = order[_starts(a[order])] if len(a) else order
        out = np.full(self.n, -1, np.int32)
        out[a[order]] = b[order]
        return out

    def single(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The vertices with one edge in direction ``d`` (0: to a successor), and the other ends. One pass serves both directions."""

        def kernel(a, b, w, way):
            s = _starts(a)
            out = [x for k in (0, 1) for x in (np.add.reduceat((way == k).astype(np.int64), s), np.add.reduceat(np.where(way == k, b, 0).astype(np.int64), s))]
            some = (out[0] == 1) | (out[2] == 1)
            some[0] = some[-1] = True  # maybe with more edges in other chunks
            return a[s][some], *(x[some] for x in out)

        if self._singles is None:
            a, *ends = self.rows(kernel, "a int, n0 long, b0 long, n1 long, b1 long")
            n0, b0, n1, b1 = (np.bincount(a, weights=x, minlength=self.n).astype(np.int64) for x in ends)
            self._singles = [(np.flatnonzero(c == 1), b[c == 1]) for c, b in ((n0, b0), (n1, b1))]
        return self._singles[d]

    def levels(self) -> np.ndarray:
        """Most edges of a path from a source; vertices on or behind a cycle are an error."""

        def into(a, b, w, d):
            a = a[d == 1]
            s = _starts(a) if len(a) else np.zeros(0, np.int64)
            return a[s], np.diff(np.append(s, len(a)))

        def reached(a, b, w, d, level):
            mine = (d == 1) & (level[a] < 0)
            a, from_level = a[mine], level[b[mine]]
            if not len(a):
                return a, np.zeros(0, np.int64), from_level
            s = _starts(a)
            c, top = np.add.reduceat((from_level >= 0).astype(np.int64), s), np.maximum.reduceat(from_level, s)
            return a[s][c > 0], c[c > 0], top[c > 0]

        a, c = self.rows(into, "a int, c long")
        need = np.bincount(a, weights=c, minlength=self.n)
        level = np.where(need == 0, 0, -1).astype(np.int32)
        while (level < 0).any():
            a, c, top = self.rows(reached, "a int, c long, top int", level)
            full = np.bincount(a, weights=c, minlength=self.n) == need
            most = np.full(self.n, -1, np.int32)
            np.maximum.at(most, a, top)
            now = full & (level < 0)
            if not now.any():
                raise ValueError("the graph has a cycle")
            level[now] = most[now] + 1
        return level

    def contract(self, leader: np.ndarray, n: int) -> PackedGraph:
        """The graph of ``n`` vertices in which i is part of leader[i]."""
        sent = self.chunks.sparkSession.sparkContext.broadcast(leader.astype(np.int32))

        def edges(batch) -> Iterator:
            for a, b, w, d in _arrays(batch):
                a, b = sent.value[a], sent.value[b]
                own = (d == 0) & (a != b)
                yield a[own], b[own], w[own]

        out = PackedGraph(self.chunks.select(*_TYPES), edges, n, self.m)
        sent.unpersist()
        return out

    def wishes(self, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vertices, parts, gains): where vertices gain by a move that keeps the parts' order.

        Allowed are the parts from the last of its predecessors' to the first of its
        successors'. Of equal gains the last part counts.
        """

        def kernel(a, b, w, d, part):
            s, q = _starts(a), part[b]
            seg = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(a))))
            lo = np.maximum.reduceat(np.where(d == 1, q, np.int32(0)), s)
            hi = np.minimum.reduceat(np.where(d == 0, q, np.int32(k - 1)), s)
            i, q, w = _summed(seg, q, w, k)
            # A chunk's first and last vertex may have edges in others: their sums go on.
            open_ = (i == 0) | (i == len(s) - 1)
            own = part[a[s]]
            keep = np.zeros(len(s))
            keep[i[q == own[i]]] = w[q == own[i]]
            gain = w - keep[i]
            good = open_ | ((q != own[i]) & (lo[i] <= q) & (q <= hi[i]) & (gain > 0))
            i, q, x = i[good], q[good], np.where(open_, w, gain)[good]
            return a[s][i], q, x, lo[i], hi[i], open_[good]

        a, q, x, lo, hi, open_ = self.rows(kernel, "a int, q int, x double, lo int, hi int, o boolean", part)
        o = open_.astype(bool)
        ids, at = np.unique(a[o], return_inverse=True)
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), k - 1, np.int64)
        np.maximum.at(low, at, lo[o])
        np.minimum.at(high, at, hi[o])
        i, p, w = _summed(at, q[o], x[o], k)
        keep = np.zeros(len(ids))
        own = part[ids]
        keep[i[p == own[i]]] = w[p == own[i]]
        gain = w - keep[i]
        good = (p != own[i]) & (low[i] <= p) & (p <= high[i]) & (gain > 0)
        a, q, x = np.concatenate([a[~o], ids[i[good]]]), np.concatenate([q[~o], p[good]]), np.concatenate([x[~o], gain[good]])
        order = np.lexsort((-q, -x, a))
        order = order[_starts(a[order])] if len(a) else order
        return a[order], q[order], x[order]

    def beaten(self, rank: np.ndarray) -> np.ndarray:
        """The vertices of a rank over 0 that have a neighbour of a higher one."""

        def kernel(a, b, w, d, rank):
            return (np.unique(a[(rank[a] > 0) & (rank[b] > rank[a])]),)

        return self.rows(kernel, "a int", rank)[0]


def packed_graph(edges: DataFrame, ids: np.ndarray) -> PackedGraph:
    """The graph of edges (u, v, w) over the sorted ``ids``, numbered in order.

    Edges to other ids and loops are left out.
    """
    sent, n = edges.sparkSession.sparkContext.broadcast(ids), len(ids)

    def number(batches) -> Iterator:
        ids, have, rows = sent.value, [], 0

        def send():
            a, b, w = (np.concatenate(x) for x in zip(*have))
            return _blob({**_EDGES, "m": None}, {"a": a, "b": b, "w": w, "m": len(a)})

        for batch in batches:
            u, v, w = (batch.column(c).to_numpy() for c in ("u", "v", "w"))
            a, b = (np.minimum(np.searchsorted(ids, x), n - 1) for x in (u, v)) if n else (u, v)
            own = (ids[a] == u) & (ids[b] == v) & (a != b) if n else np.zeros(len(u), bool)
            have.append((a[own].astype(np.int32), b[own].astype(np.int32), w[own]))
            rows += len(u)
            if rows >= CHUNK // 2:
                yield send()
                have, rows = [], 0
        if have:
            yield send()

    named = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    numbered = written(named.mapInArrow(number, "a binary, b binary, w binary, m long"))
    m = numbered.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    out = PackedGraph(numbered.select(*_EDGES), lambda batch: _arrays(batch, _EDGES), n, m)
    erase(numbered)
    sent.unpersist()
    return out
