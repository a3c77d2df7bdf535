"""Directed graphs as edges (u, v, w) and vertices (id, w).

Loops run once per level of the graph; each round's frontier is written to the
checkpoint folder, and only vertices whose value changed go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.storage import cut

#: Tables with a row a vertex are broadcast up to this many rows; larger ones are shuffled.
BROADCAST_VERTICES = 2_000_000


def _beside(vertices: DataFrame, n: int | None) -> DataFrame:
    """``vertices`` of ``n`` rows (None: not known) as the smaller side of a join with edges."""
    return F.broadcast(vertices) if n is not None and n <= BROADCAST_VERTICES else vertices


def reverse(edges: DataFrame) -> DataFrame:
    """In-adjacency from out-adjacency and the other way round."""
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, n_in, n_out)."""
    both = edges.select(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = both.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def degree_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    d = degrees(edges, vertices)
    return d.agg(*[f(c).alias(f"{n}_{c[2:]}") for c in ("n_in", "n_out") for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))])


def sources(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.select("id").join(edges.select(F.col("v").alias("id")), "id", "left_anti")


def sinks(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.select("id").join(edges.select(F.col("u").alias("id")), "id", "left_anti")


def part_sources(edges: DataFrame, vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part): vertices without an in-edge from their own part."""
    p = parts.select(F.col("id").alias("u"), F.col("part").alias("pu"))
    q = parts.select(F.col("id").alias("v"), F.col("part").alias("pv"))
    inner = edges.join(p, "u").join(q, "v").where("pu = pv").select(F.col("v").alias("id"))
    return vertices.select("id").join(parts, "id").join(inner, "id", "left_anti").select("id", "part")


def _together(tables: list[DataFrame]) -> list[DataFrame]:
    """Tables of rounds; every sixteenth time they are written as one, so that plans stay short."""
    if len(tables) < 16:
        return tables
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return [cut(out)]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def top_levels(edges: DataFrame, vertices: DataFrame, step: str = "1", max_rounds: int = 100_000) -> DataFrame:
    """(id, level): longest path from a source; ``step`` is an edge's length over u, v, w.

    A vertex is settled when all its in-edges come from settled vertices (Kahn),
    so each edge is relaxed once; a round writes only the vertices that it
    reaches and those that are reached but not settled. Vertices on or behind a
    cycle get no level.
    """
    e = cut(edges.withColumn("__s", F.expr(step).cast("double")).select("u", "v", "__s"))
    need = cut(e.groupBy("v").agg(F.count(F.lit(1)).alias("need")))
    ready = cut(vertices.select("id").join(need, F.col("id") == F.col("v"), "left_anti").select("id", F.lit(0.0).alias("level")))
    done, waiting, n = [ready], None, ready.count()
    for _ in range(max_rounds):
        reached = e.join(_beside(ready.withColumnRenamed("id", "u"), n), "u").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("level") + F.col("__s")).alias("l"))
        if waiting is not None:
            reached = reached.unionByName(waiting).groupBy("v").agg(F.sum("n").alias("n"), F.max("l").alias("l"))
        now = cut(reached.join(need, "v").select("v", "n", F.greatest("l", F.lit(0.0)).alias("l"), (F.col("n") == F.col("need")).alias("full")))
        ready, waiting = now.where("full").select(F.col("v").alias("id"), F.col("l").alias("level")), now.where("NOT full").drop("full")
        n = ready.count()
        if not n:
            break
        done = _together([*done, ready])
    return _union(done)


def bottom_levels(edges: DataFrame, vertices: DataFrame, step: str = "1") -> DataFrame:
    """(id, level): longest path to a sink."""
    return top_levels(reverse(edges), vertices, step)


def topological_order(edges: DataFrame, vertices: DataFrame, kind: str = "level", seed: int = 0) -> DataFrame:
    """(id, level, place): by level, then as ``kind`` says; places count up within a level.

    ``level``: by id; ``random``: by a hash of ``seed`` and id; ``priority``: heaviest
    vertices (w) first; ``mixed``: heavy ones first, by powers of two, in random order.
    Sorted by range, so a large level is dealt over many tasks.
    """
    h = F.xxhash64(F.lit(seed), "id")
    keys = {"level": [], "random": [h], "priority": [F.desc("w")], "mixed": [F.desc(F.floor(F.log2(F.greatest("w", F.lit(1e-9))))), h]}[kind]
    t = top_levels(edges, vertices)
    if kind in ("priority", "mixed"):
        t = t.join(vertices.select("id", "w"), "id")
    order = ["level", *keys, "id"]
    t = cut(t.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "level", F.monotonically_increasing_id().alias("__m"), F.spark_partition_id().alias("__p")))
    # One row for each range of rows of a level: as many as levels and tasks.
    part = t.groupBy("level", "__p").agg(F.min("__m").alias("__a"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("level").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("level", "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__a") + 1).alias("__o"))
    return t.join(part, ["level", "__p"]).select("id", "level", (F.col("__m") + F.col("__o")).cast("int").alias("place"))


def depth_first_order(edges: DataFrame, vertices: DataFrame, limit: int = 200_000) -> list[int]:
    """Topological order by depth-first search on the driver, for graphs of up to ``limit`` edges.

    Sequential by nature; beyond the bound use topological_order().
    """
    rows = edges.select("u", "v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges")
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r.u, []).append(r.v)
    ids = sorted(r.id for r in vertices.select("id").limit(limit + 1).collect())
    state: dict[int, int] = {}
    order: list[int] = []
    for s in ids:
        stack = [(s, iter(sorted(out.get(s, ()))))] if s not in state else []
        state.setdefault(s, 1)
        while stack:
            x, it = stack[-1]
            y = next((y for y in it if y not in state), None)
            if y is None:
                order.append(x)
                stack.pop()
            else:
                state[y] = 1
                stack.append((y, iter(sorted(out.get(y, ())))))
    return order[::-1]


def distances(edges: DataFrame, source: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(id, dist): fewest edges from the nearest source vertex (id)."""
    front, k = cut(source.select("id", F.lit(0).alias("dist")).distinct()), 0
    rounds = [front]
    while k < max_rounds:
        k += 1
        nxt = edges.join(front.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(_union(rounds), "id", "left_anti")
        front = cut(nxt.select("id", F.lit(k).alias("dist")))
        if front.isEmpty():
            break
        rounds = _together([*rounds, front])
    return _union(rounds)


def farthest(edges: DataFrame, source: DataFrame) -> DataFrame:
    """The vertex farthest from the source; ties by least id."""
    return distances(edges, source).orderBy(F.desc("dist"), "id").limit(1)


def connected_components(edges: DataFrame, vertices: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): least id of the undirected component.

    Alternating large-star and small-star rounds; logarithmic in number also on
    long chains, where passing labels from neighbour to neighbour isn't.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return vertices.select("id").join(e.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


def is_acyclic(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: whether peeling sources leaves nothing."""
    n = top_levels(edges, vertices).count()
    return vertices.agg((F.count(F.lit(1)) == n).alias("acyclic"))


def quotient(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(pu, pv, n_edges, w): number and weight of the edges between parts, those inside a part too."""
    p = parts.select(F.col("id").alias("u"), F.col("part").alias("pu"))
    q = parts.select(F.col("id").alias("v"), F.col("part").alias("pv"))
    return edges.join(p, "u").join(q, "v").groupBy("pu", "pv").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"))


def partition_is_acyclic(edges: DataFrame, parts: DataFrame) -> DataFrame:
    q = quotient(edges, parts).where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"), "w")
    return is_acyclic(cut(q), parts.select(F.col("part").alias("id")).distinct())


def transitive_reduction(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The edges for which there is no longer path between their ends; weights unchanged.

    Only edges over two levels or more can have one. From the tails of these a
    search goes on below the level of their farthest head. Edges on or behind a
    cycle stay.
    """
    e = edges.select("u", "v").distinct()
    ids = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    lv = cut(top_levels(e.withColumn("w", F.lit(1.0)), ids))
    e = e.join(lv.select(F.col("id").alias("u"), F.col("level").alias("lu")), "u").join(lv.select(F.col("id").alias("v"), F.col("level").alias("lv")), "v")
    e = cut(e)
    over = e.where("lv - lu >= 2")
    far = cut(over.groupBy("u").agg(F.max("lv").alias("far")))
    step = e.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("lv").alias("ly"))
    front = cut(e.join(far, "u").where("lv < far").select("u", F.col("v").alias("x"), "far"))
    seen: list[DataFrame] = []
    for _ in range(max_rounds):
        nxt = front.join(step, "x").where("ly <= far").select("u", F.col("y").alias("x"), "far", "ly").distinct()
        if seen:
            nxt = nxt.join(_union(seen).select("u", "x"), ["u", "x"], "left_anti")
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        seen = _together([*seen, nxt])
        front = nxt.where("ly < far").select("u", "x", "far")
    if not seen:
        return edges
    return edges.join(_union(seen).select("u", F.col("x").alias("v")), ["u", "v"], "left_anti")


def with_single_ends(edges: DataFrame, vertices: DataFrame, source_id: int, target_id: int) -> tuple[DataFrame, DataFrame]:
    """Adds one source before all sources and one target behind all sinks, with weight 0."""
    e = edges.select("u", "v", "w")
    first = sources(edges, vertices).select(F.lit(source_id).cast("long").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w"))
    last = sinks(edges, vertices).select(F.col("id").alias("u"), F.lit(target_id).cast("long").alias("v"), F.lit(0.0).alias("w"))
    more = vertices.sparkSession.createDataFrame([(source_id,), (target_id,)], "id long")
    return e.union(first).union(last), vertices.select("id").union(more)


def scaled_to_ratio(edges: DataFrame, vertices: DataFrame, ratio: float) -> DataFrame:
    """Edge weights scaled so that their sum is ``ratio`` times the vertices'."""
    v = vertices.agg(F.sum("w")).first()[0] or 0.0
    e = edges.agg(F.sum("w")).first()[0] or 1.0
    return edges.withColumn("w", F.col("w") * (ratio * v / e))


def hashed_weights(edges: DataFrame, low: int, high: int, seed: int = 0) -> DataFrame:
    """Reproducible random integer weights in low .. high."""
    return edges.withColumn("w", (low + F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(high - low + 1))).cast("double"))
