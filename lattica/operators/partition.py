"""Partition metrics and a multilevel acyclic partitioner.

Metrics are joins and sums. The partitioner coarsens on the cluster, by
contracting vertices whose levels rule out a cycle, until the graph is small
(``stop_size`` vertices, ``stop_edges`` edges); bisection and refinement then work on that on the
driver, and the parts are projected back and refined at each level. Edges are packed in
chunks and vertices are arrays; with more than ``BROADCAST_VERTICES`` vertices both are
tables, and the steps are joins.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import cut
from lattica.operators.graph import BROADCAST_VERTICES, _beside, _together, _union, top_levels
from lattica.operators.packed import PackedGraph, packed_graph


def _labelled(edges: DataFrame, parts: DataFrame, n: int | None = None) -> DataFrame:
    """Edges with the parts of both ends; ``n`` is the number of vertices, if known."""
    p = parts.select(F.col("id").alias("u"), F.col("part").alias("pu"))
    q = parts.select(F.col("id").alias("v"), F.col("part").alias("pv"))
    return edges.join(_beside(p, n), "u").join(_beside(q, n), "v")


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    return _labelled(edges, parts).where("pu <> pv").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("edge_cut"), F.count(F.lit(1)).alias("cut_edges"))


def communication_volume(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Each vertex counts once for each other part it has an edge to, with its first such edge's weight."""
    first = _labelled(edges, parts).where("pu <> pv").groupBy("u", "pv").agg(F.min_by("w", "v").alias("w"))
    return first.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("comm_volume"), F.count(F.lit(1)).alias("messages"))


def latency(edges: DataFrame, vertices: DataFrame, parts: DataFrame, inside: float = 1.0, across: float = 11.0) -> DataFrame:
    """Longest path where an edge costs 1 and ``inside`` or, between parts, ``across``."""
    e = _labelled(edges, parts).select("u", "v", "w", F.when(F.col("pu") == F.col("pv"), 1 + inside).otherwise(1 + across).alias("cost"))
    return top_levels(e, vertices, "cost").agg(F.max("level").alias("latency"))


def part_weights(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    return vertices.join(parts, "id").groupBy("part").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def is_balanced(vertices: DataFrame, parts: DataFrame, k: int, ratio: float) -> DataFrame:
    """One row: whether no part weighs more than ``ratio`` times the mean of ``k`` parts."""
    w = part_weights(vertices, parts)
    return w.agg((F.max("w") <= ratio * F.sum("w") / k).alias("balanced"), (F.max("w") * k / F.sum("w")).alias("imbalance"))


def order_by_part(edges: DataFrame, vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part, part_level, level): a topological order with parts contiguous when sorted."""
    q = _labelled(edges, parts).where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w"))
    pl = top_levels(q, parts.select(F.col("part").alias("id")).distinct()).select(F.col("id").alias("part"), F.col("level").alias("part_level"))
    return top_levels(edges, vertices).join(parts, "id").join(pl, "part").select("id", "part", "part_level", "level")


def task_memory(tasks: DataFrame, memory: DataFrame) -> DataFrame:
    """(part, bytes): live memory of the tasks of a part, each named block once."""
    named = tasks.join(memory, "task_id").groupBy("part", "name").agg(F.max("bytes").alias("bytes"))
    return named.groupBy("part").agg(F.sum("bytes").alias("bytes"))


def coarsen_once(edges: DataFrame, vertices: DataFrame, turn: int = 0, loose: bool = False, together: int = 4) -> DataFrame:
    """(id, leader): vertices that may be contracted without closing a cycle.

    Turns go round. Siblings: vertices of one level with the same heaviest neighbour
    (if ``loose``, any of one level) about ``together`` at a time; edges only lead to higher
    levels, so whatever is merged inside a level closes no cycle. Funnels: a vertex
    with one successor joins it, or one with one predecessor joins that; a path out
    of the merged pair and back would have been a cycle before. Of a chain, those
    join whose hash says so and whose neighbour's doesn't. Vertices may bring their
    ``level``; a merge of siblings leaves the levels as they are.
    """
    if turn % 3 == 0 or loose:
        near = edges.select(F.col("u").alias("id"), F.col("v").alias("nb"), "w").union(edges.select(F.col("v").alias("id"), F.col("u").alias("nb"), "w"))
        best = near.groupBy("id").agg(F.max(F.struct("w", (-F.col("nb")).alias("n"))).alias("x")).select("id", F.lit(0).cast("long").alias("nb") if loose else F.col("x.n").alias("nb"))
        levels = vertices.select("id", "level") if "level" in vertices.columns else top_levels(edges, vertices)
        g = cut(levels.join(best, "id", "left").select("id", "level", F.coalesce("nb", F.lit(1)).alias("nb")))
        slots = g.groupBy("level", "nb").agg(F.ceil(F.count(F.lit(1)) / together).alias("slots"))
        g = g.join(slots, ["level", "nb"]).withColumn("slot", F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("slots")))
        leader = g.groupBy("level", "nb", "slot").agg(F.min("id").alias("leader"))
        return g.join(leader, ["level", "nb", "slot"]).select("id", "leader")
    one, other = ("u", "v") if turn % 3 == 1 else ("v", "u")
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
    only = edges.groupBy(F.col(one).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias("leader")).where("n = 1")
    only = only.where(coin("id") & ~coin("leader")).select("id", "leader")
    return vertices.select("id").join(only, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def contract(edges: DataFrame, vertices: DataFrame, leaders: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of the leaders; a leader keeps its own level, if vertices have one."""
    a = leaders.select(F.col("id").alias("u"), F.col("leader").alias("a"))
    b = leaders.select(F.col("id").alias("v"), F.col("leader").alias("b"))
    e = edges.join(_beside(a, n), "u").join(_beside(b, n), "v").where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    level = [F.max(F.when(F.col("id") == F.col("leader"), F.col("level"))).alias("level")] if "level" in vertices.columns else []
    v = vertices.join(leaders, "id").groupBy("leader").agg(F.sum("w").alias("w"), *level)
    return e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w"), v.withColumnRenamed("leader", "id")


def _kahn(ids: list[int], out: dict[int, dict[int, float]], into: dict[int, dict[int, float]], gain) -> list[int]:
    left = {i: len(into.get(i, ())) for i in ids}
    heap = [(gain(i), i) for i in ids if not left[i]]
    heapq.heapify(heap)
    order = []
    while heap:
        _, i = heapq.heappop(heap)
        order.append(i)
        for j in out.get(i, ()):
            left[j] -= 1
            if not left[j]:
                heapq.heappush(heap, (gain(j), j))
    return order


class _Halves:
    """A two-way partition of a small graph; ``up`` is closed under predecessors."""

    def __init__(self, ids: list[int], weight: dict[int, float], edges: list[tuple[int, int, float]]) -> None:
        self.ids, self.weight = ids, weight
        self.out: dict[int, dict[int, float]] = {}
        self.into: dict[int, dict[int, float]] = {}
        for u, v, w in edges:
            self.out.setdefault(u, {})[v] = w
            self.into.setdefault(v, {})[u] = w
        self.total = sum(weight[i] for i in ids)
        self.flow = {i: sum(self.out.get(i, {}).values()) - sum(self.into.get(i, {}).values()) for i in ids}

    def order(self, kind: str) -> list[int]:
        """A topological order: what is tied most to what is taken, level by level, depth first, or by hash."""
        level: dict[int, int] = {}
        for i in _kahn(self.ids, self.out, self.into, lambda i: 0):
            level[i] = 1 + max((level[j] for j in self.into.get(i, ())), default=-1)
        turn = itertools.count()
        gain = {
            "greedy": lambda i: -sum(self.into.get(i, {}).values()),
            "flow": lambda i: self.flow[i],
            "level": lambda i: level[i],
            "depth": lambda i: -next(turn),
            "hash": lambda i: (i * 2654435761) % 4294967291,
        }[kind]
        return _kahn(self.ids, self.out, self.into, gain)

    def prefix(self, order: list[int], low: float, high: float) -> set[int]:
        """The prefix of an order with the least cut among those of allowed weight, or else the nearest one."""
        w, cut_w, best = 0.0, 0.0, None
        for n, i in enumerate(order[:-1]):
            w += self.weight[i]
            cut_w += self.flow[i]
            far = max(low - w, w - high, 0.0)
            if best is None or (far, cut_w) < best[0]:
                best = ((far, cut_w), n + 1)
        return set(order[: best[1]]) if best else set(order)

    def cut(self, up: set[int]) -> float:
        return sum(self.flow[i] for i in up)

    def free(self, i: int, up: set[int]) -> bool:
        """Whether i may change sides: nothing that it leads to stays behind it."""
        return not any(j in up for j in self.out.get(i, ())) if i in up else all(j in up for j in self.into.get(i, ()))

    def refine(self, up: set[int], low: float, high: float, passes: int = 8, swaps: bool = False) -> set[int]:
        """Boundary moves by gain with rollback.

        A pass moves each vertex once at most, the best free one first even at a loss,
        and then goes back to its best state. With ``swaps`` sides take turns
        (Kernighan and Lin), else the allowed weights say who may move.
        """
        up = set(up)
        w_up = sum(self.weight[i] for i in up)
        for _ in range(passes):
            side = {True: [], False: []}
            for i in self.ids:
                if self.free(i, up):
                    heapq.heappush(side[i in up], (-self.flow[i] if i in up else self.flow[i], i))
            locked: set[int] = set()
            moves: list[int] = []
            gain, best, at, w = 0.0, 0.0, 0, w_up
            lost = 0
            turn = True
            while lost < 200:
                pick = None
                for s in (turn, not turn) if swaps else sorted((True, False), key=lambda s: side[s][0] if side[s] else (float("inf"), 0)):
                    while side[s] and (side[s][0][1] in locked or (side[s][0][1] in up) != s or not self.free(side[s][0][1], up)):
                        heapq.heappop(side[s])
                    if side[s]:
                        i = side[s][0][1]
                        after = w - self.weight[i] if s else w + self.weight[i]
                        if low <= after <= high or abs(after - (low + high) / 2) < abs(w - (low + high) / 2):
                            pick = (s, i, after)
                            break
                        heapq.heappop(side[s])
                if pick is None:
                    break
                s, i, w = pick
                heapq.heappop(side[s])
                # Up has flow out less flow in on the cut: to leave it, i takes its own along.
                gain += self.flow[i] if s else -self.flow[i]
                (up.discard if s else up.add)(i)
                locked.add(i)
                moves.append(i)
                for j in self.into.get(i, ()) if s else self.out.get(i, ()):
                    if j not in locked and self.free(j, up):
                        heapq.heappush(side[j in up], (-self.flow[j] if j in up else self.flow[j], j))
                lost += 1
                if gain > best + 1e-12:
                    best, at, lost, w_best = gain, len(moves), 0, w
                turn = not s
            for i in moves[at:]:
                (up.discard if i in up else up.add)(i)
            if not at:
                break
            w_up = w_best
        return up


def bisect(ids: list[int], weight: dict[int, float], edges: list[tuple[int, int, float]], share: float = 0.5, slack: float = 0.1, kinds: tuple[str, ...] = ("greedy", "flow", "level", "depth", "hash"), refinement: str = "fm") -> set[int]:
    """The upstream half: no edge leads back into it. The best of several initial orders, each refined.

    ``refinement``: ``fm`` (single moves), ``kl`` (swaps), ``kl+fm`` or ``none``.
    """
    g = _Halves(ids, weight, edges)
    low, high = (share - slack / 2) * g.total, (share + slack / 2) * g.total
    best = None
    for kind in kinds:
        up = g.prefix(g.order(kind), low, high)
        for step in [] if refinement == "none" else refinement.split("+"):
            up = g.refine(up, low, high, swaps=step == "kl")
        w = sum(weight[i] for i in up)
        key = (max(low - w, w - high, 0.0), g.cut(up))
        if best is None or key < best[0]:
            best = (key, up)
    return best[1]


def _split(weight: dict[int, float], links: list[tuple[int, int, float]], k: int, slack: float, refinement: str, max_weight: float | None) -> dict[int, int]:
    """Recursive bisection; with ``max_weight`` (memory of a part) it goes on until parts are no heavier."""
    out: dict[int, int] = {}
    number = itertools.count()

    def go(ids: list[int], own: list, parts: int) -> None:
        light = max_weight is None or sum(weight[i] for i in ids) <= max_weight
        if len(ids) <= 1 or (parts <= 1 and light):
            out.update(dict.fromkeys(ids, next(number)))
            return
        parts = max(parts, 2)
        left = parts // 2
        up = bisect(ids, weight, own, left / parts, slack, refinement=refinement)
        if not 0 < len(up) < len(ids):
            up = set(_Halves(ids, weight, own).order("greedy")[: len(ids) // 2])
        for side, n in ((up, left), (set(ids) - up, parts - left)):
            if side:
                go(sorted(side), [x for x in own if x[0] in side and x[1] in side], n)

    go(sorted(weight), links, k)
    return out


def refine_once(edges: DataFrame, vertices: DataFrame, parts: DataFrame, limit: float, turn: int = 0, n: int | None = None) -> DataFrame:
    """One round of boundary moves on the cluster: (id, part), part numbers in topological order.

    A vertex may go to its neighbours' parts between the last of its predecessors
    and the first of its successors, which keeps the quotient acyclic. It goes
    where it gains most, if none of its neighbours moves in this round (the one
    with the greater gain does) and all that want to go there fit under ``limit``.
    ``n`` is the number of vertices, if known.
    """
    p = _labelled(edges, parts, n)
    end = lambda i, own, q, to: F.struct(F.col(i).alias("id"), F.col(own).alias("own"), F.col(q).alias("q"), "w", F.lit(to).alias("to"))
    near = p.select(F.explode(F.array(end("u", "pu", "pv", 1), end("v", "pv", "pu", 0))).alias("x")).select("x.*")
    # A row for each vertex and part beside it; the edges aren't written again.
    tie = near.groupBy("id", "own", "q").agg(F.sum("w").alias("w"), F.min("to").alias("a"), F.max("to").alias("b"))
    span = tie.groupBy("id", "own").agg(
        F.max(F.when(F.col("a") == 0, F.col("q"))).alias("lo"),
        F.min(F.when(F.col("b") == 1, F.col("q"))).alias("hi"),
        F.sum(F.when(F.col("q") == F.col("own"), F.col("w")).otherwise(0.0)).alias("keep"),
        F.collect_list(F.struct("q", "w")).alias("ties"),
    )
    may = F.expr("filter(ties, t -> t.q <> own AND (lo IS NULL OR t.q >= lo) AND (hi IS NULL OR t.q <= hi))")
    best = F.array_max(F.transform(may, lambda t: F.struct((t["w"] - F.col("keep")).alias("gain"), t["q"].alias("q"))))
    wish = span.select("id", best.alias("x")).where("x.gain > 0").select("id", "x.gain", "x.q")
    wish = cut(wish.withColumn("rank", F.struct("gain", F.xxhash64(F.lit(turn), "id"))))
    a, b = wish.select(F.col("id").alias("u"), F.col("rank").alias("ru")), wish.select(F.col("id").alias("v"), F.col("rank").alias("rv"))
    both = edges.join(_beside(a, n), "u").join(_beside(b, n), "v")
    loser = both.select(F.when(F.col("ru") < F.col("rv"), F.col("u")).otherwise(F.col("v")).alias("id")).distinct()
    wish = cut(wish.join(loser, "id", "left_anti")).join(vertices.select("id", F.col("w").alias("vw")), "id")
    weight = part_weights(vertices, parts).select(F.col("part").alias("q"), F.col("w").alias("now"))
    room = wish.groupBy("q").agg(F.sum("vw").alias("more")).join(weight, "q", "left").where(F.coalesce("now", F.lit(0.0)) + F.col("more") <= limit).select("q")
    move = wish.join(F.broadcast(room), "q").select("id", "q")
    return parts.join(move, "id", "left").select("id", F.coalesce("q", "part").alias("part"))


def _packed_siblings(heaviest: np.ndarray, level: np.ndarray, loose: bool, together: int) -> np.ndarray:
    """Leaders as in coarsen_once(): of one level and heaviest neighbour (if ``loose``, of one level), in groups of even size."""
    order = np.lexsort((heaviest, level))
    new = level[order[1:]] != level[order[:-1]]
    if not loose:
        new |= heaviest[order[1:]] != heaviest[order[:-1]]
    first = np.flatnonzero(np.concatenate([[True], new]))
    size = np.diff(np.append(first, len(order)))
    rank = np.arange(len(order)) - np.repeat(first, size)
    slot = rank * np.repeat(-(-size // together), size) // np.repeat(size, size)
    start = np.concatenate([[True], new | (slot[1:] != slot[:-1])])
    leader = np.empty(len(order), np.int64)
    leader[order] = np.repeat(np.minimum.reduceat(order, np.flatnonzero(start)), np.diff(np.append(np.flatnonzero(start), len(order))))
    return leader


def _packed_funnels(graph: PackedGraph, turn: int) -> np.ndarray:
    one, other = graph.single(0 if turn % 3 == 1 else 1)
    coin = lambda x: _mixed(x, turn) % np.uint64(2) == 0
    take = coin(one) & ~coin(other)
    leader = np.arange(graph.n)
    leader[one[take]] = other[take]
    return leader


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _refined(graph: PackedGraph, weight: np.ndarray, part: np.ndarray, limit: float, turn: int) -> np.ndarray:
    """A round as in refine_once(); of those that want to go to a part, the ones that gain most do, as long as they fit."""
    k = int(part.max()) + 1
    ids, to, gain = graph.wishes(part, k)
    rank = np.zeros(graph.n, np.int32)
    rank[ids[np.lexsort((_mixed(ids, turn), gain))]] = np.arange(1, len(ids) + 1)
    stay = np.zeros(graph.n, bool)
    stay[graph.beaten(rank)] = True
    some = np.flatnonzero(~stay[ids])
    some = some[np.lexsort((-rank[ids[some]], to[some]))]
    now = np.bincount(part, weights=weight, minlength=k)
    part = part.copy()
    for q in np.unique(to[some]).tolist():
        mine = ids[some[to[some] == q]]
        fit = now[q] + np.cumsum(weight[mine]) <= limit
        part[mine[fit]] = q
    return part


def _packed_partition(edges: DataFrame, vertices: DataFrame, k: int, stop_size: int, turns: range, slack: float, refinement: str, rounds: int, max_weight: float | None, stop_edges: int) -> DataFrame:
    """acyclic_partition() of up to ``BROADCAST_VERTICES`` vertices: labels on the driver, edges in packed chunks on the cluster."""
    t = vertices.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")).toArrow()
    ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
    weight = t.column("w").to_numpy()[first]
    graph, steps, made = packed_graph(edges, ids), [], []
    made.append(graph)
    level, loose, stuck, before, stale = None, False, 0, graph.n, True
    try:
        for turn in turns:
            if graph.n <= stop_size and (graph.m <= stop_edges or stuck >= 3):
                break
            if turn % 3 == 0:
                # Three turns that leave over half of the vertices: few have a heaviest neighbour in common.
                loose, before = loose or (turn > 0 and graph.n > before / 2), graph.n
            siblings = loose or turn % 3 == 0
            if siblings:
                # Levels from before a merge of funnels still go up along edges; where few share one, they are found again.
                if level is None or (loose and stale):
                    level, stale = graph.levels(), False
                leader = _packed_siblings(graph.heaviest(), level, loose, 16 if loose and graph.m > 10 * stop_edges else 4)
            else:
                leader = _packed_funnels(graph, turn)
            heads, to = np.unique(leader, return_inverse=True)
            stuck = stuck + 1 if loose and len(heads) == graph.n else 0
            # A few funnels aren't worth a pass over all edges.
            if len(heads) == graph.n or (not siblings and len(heads) > 0.95 * graph.n):
                continue
            steps.append((graph, weight, to))
            # A leader keeps its level: a funnel's vertex leads to, or comes from, its leader alone.
            level, stale = None if level is None else level[heads], stale or not siblings
            weight, graph = np.bincount(to, weights=weight), graph.contract(to, len(heads))
            made.append(graph)
        if graph.n > stop_size or graph.m > 10 * stop_edges:
            raise ValueError(f"{graph.n} vertices and {graph.m} edges are left after {turns.stop} rounds of coarsening, more than {stop_size} and {10 * stop_edges}")
        links = list(zip(*(x.tolist() for x in graph.edges())))
        found = _split(dict(enumerate(weight.tolist())), links, k, slack, refinement, max_weight)
        part = np.array([found[i] for i in range(graph.n)], np.int32)
        limit = max_weight or (1 + slack) * float(weight.sum()) / k
        for graph, weight, to in reversed(steps):
            part = part[to]
            for turn in range(rounds):
                part = _refined(graph, weight, part, limit, turn)
    finally:
        for g in made:
            g.erase()
    return cut(edges.sparkSession.createDataFrame(pa.table({"id": ids, "part": part}), "id long, part int"))


def acyclic_partition(edges: DataFrame, vertices: DataFrame, k: int, stop_size: int = 20_000, max_levels: int = 40, slack: float = 0.1, refinement: str = "fm", rounds: int = 1, max_weight: float | None = None, stop_edges: int = 200_000) -> DataFrame:
    """(id, part) with ``k`` parts, or as many as ``max_weight`` asks for, whose quotient graph is acyclic.

    Parts are refined at each level on the way back. A graph that can't be
    coarsened to ``stop_size`` vertices isn't gathered on the driver: it is an error.
    Below that it is coarsened as long as it has over ``stop_edges`` edges and gets
    smaller; over ten times as many are an error, too.

    From ``BROADCAST_VERTICES`` vertices down, labels are arrays and edges are packed
    chunks; larger graphs are coarsened to that size by joins.
    """
    steps: list[tuple[DataFrame, DataFrame, DataFrame, int]] = []
    v = cut(vertices.select("id", F.col("w").cast("double").alias("w")))
    n, turn = v.count(), 0
    e = edges if n <= BROADCAST_VERTICES else cut(edges.groupBy("u", "v").agg(F.sum("w").alias("w")))
    loose, before = False, n
    while n > BROADCAST_VERTICES and turn < max_levels:
        if turn % 3 == 0:
            loose, before = loose or (turn > 0 and n > before / 2), n
        siblings = loose or turn % 3 == 0
        if siblings and "level" not in v.columns:
            v = cut(v.join(top_levels(e, v), "id"))
        leaders = cut(coarsen_once(e, v, turn, loose))
        left = leaders.where("id = leader").count()
        turn += 1
        if left == n or (not siblings and left > 0.95 * n):
            continue
        ce, cv = contract(e, v if siblings else v.drop("level"), leaders, n)
        steps.append((leaders, e, v, n))
        e, v, n = cut(ce), cut(cv), left
    if n > BROADCAST_VERTICES:
        raise ValueError(f"{n} vertices are left after {max_levels} rounds of coarsening, more than {stop_size}")
    total = v.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] if steps else 0.0
    out = _packed_partition(e, v, k, stop_size, range(turn, max_levels), slack, refinement, rounds, max_weight, stop_edges)
    limit = max_weight or (1 + slack) * total / k
    for leaders, fe, fv, n in reversed(steps):
        out = cut(leaders.join(out.withColumnRenamed("id", "leader"), "leader").select("id", "part"))
        for turn in range(rounds):
            out = cut(refine_once(fe, fv, out, limit, turn, n))
    return out


def fix_acyclicity(edges: DataFrame, parts: DataFrame, max_rounds: int = 10_000, up: bool = False) -> DataFrame:
    """Two-way parts (0 upstream, 1 downstream) without an edge from 1 to 0.

    Successors of downstream vertices move downstream, or with ``up`` predecessors
    of upstream vertices move upstream.
    """
    side, a, b = (0, "v", "u") if up else (1, "u", "v")
    p = cut(parts.select("id", "part"))
    front = p.where(F.col("part") == side).select("id")
    changed: list[DataFrame] = []
    for _ in range(max_rounds):
        bad = edges.join(front.select(F.col("id").alias(a)), a).select(F.col(b).alias("id")).distinct().join(p.where(F.col("part") != side), "id", "left_semi")
        if changed:
            bad = bad.join(_union(changed), "id", "left_anti")
        front = cut(bad.select("id"))
        if front.isEmpty():
            break
        changed = _together([*changed, front])
    if not changed:
        return p
    return p.join(_union(changed).withColumn("__hit", F.lit(1)), "id", "left").select("id", F.when(F.col("__hit").isNotNull(), side).otherwise(F.col("part")).alias("part"))


def refine_blocks(fine: DataFrame, coarse_parts: DataFrame) -> DataFrame:
    """Parts of finer tasks (id, parent) from those of the coarse tasks they come from."""
    return fine.join(coarse_parts.select(F.col("id").alias("parent"), "part"), "parent").select("id", "part")


def heaviest(vertices: DataFrame, k: int) -> DataFrame:
    """Top k by weight; ties by id (what a heap gives)."""
    return vertices.orderBy(F.desc("w"), "id").limit(k)


def top_neighbours(edges: DataFrame) -> DataFrame:
    """Neighbour lists sorted by id: (u, vs). A list has as many entries as u has edges."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("vs"))


def mutual_best(edges: DataFrame) -> DataFrame:
    """Pairs (u, v) that are each other's heaviest neighbour; ties by id."""
    both = edges.select("u", "v", "w").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    best = both.groupBy("u").agg(F.max(F.struct("w", (-F.col("v")).alias("n"))).alias("x")).select("u", (-F.col("x.n")).alias("v"))
    return best.join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u < v")
