"""Mixing sources to target weights (built-in functions only).

Targets. ``rate`` times all words are shared among the sources by weight; no
source gets more than ``max_epochs`` times its own words, and what it can't use
is shared again by weight. In closed form: with one level L for all, a source
gets ``min(max_epochs * size, L * weight)``; the sources at their limit are a
prefix in the order of size / weight, so a running sum finds L.

Blocks. A source's documents are dealt by hash into cells, ``PER`` cells make a
block. The order of the hash is the permutation: whole passes take every block,
the last, partial pass takes the first blocks. Where it ends inside a cell, that
cell's documents are taken in hash order while they fit, and then one document
of each size class fills what is left, largest first. The number of output
shards follows from the words that the mix takes (``SHARD_WORDS`` each), and
each source has ``BLOCKS`` times as many blocks as there are 16 shards.

Splitting tree. The vector of blocks that each source gives in each pass is split
in halves, again and again, until each leaf is an output shard. A split draws how
many blocks of each source go left from the multivariate hypergeometric law:
source by source, given what is left of the half, by inverting the distribution
(out to eight standard deviations) with a hashed uniform number. So shards get
exact quotas that add up. The blocks that a pass takes are put in an order drawn
anew for each pass, and the shards take theirs from it one after the other: no
block is drawn twice. Inside a shard, rows have a hashed place to sort by.

Documents are never shuffled with their texts. A row of the tree holds the block
counts of all sources, so sources are taken to fit one row (24 bytes each); side
tables are broadcast up to ``BROADCAST`` rows and joined beyond.

Null texts have 0 words and are never taken; empty texts, too. Very long texts are
counted whole; one may be more than its source's target. Null sources are one
source, last by order. Rows that are alike share a hash and are taken alike; so
ties in the hash are one unit. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, table, without, words

#: Blocks of a source, for 16 shards, and cells of a block.
BLOCKS = 256
PER = 16
SHARD_WORDS = 64_000_000
BROADCAST = 200_000
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, rate: float = 1.5, max_epochs: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__t", F.sum("source_size").over(every) * F.lit(rate)).withColumn("__w", F.sum("weight").over(every))
    # The level if all sources before this one are at their limit and no other.
    level = (F.col("__t") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("__w") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("__l", level).withColumn("__open", F.col("__l") * F.col("weight") <= max_epochs * F.col("source_size"))
    s = s.withColumn("__level", F.min(F.when(F.col("__open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", F.col("__l").alias("l")))).over(every).l)
    target = F.least((F.lit(max_epochs) * F.col("source_size")).cast("double"), F.coalesce(F.col("__level") * F.col("weight"), (F.lit(max_epochs) * F.col("source_size")).cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws`` out of ``total``, by inversion at ``u``."""
    mean = good * draws / F.greatest(total, F.lit(1)).cast("double")
    sd = F.sqrt(mean * (1 - draws / F.greatest(total, F.lit(1)).cast("double")))
    # Beyond eight standard deviations there is no number that u could tell.
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean - 8 * sd - 8))
    high = F.least(good, draws, F.ceil(mean + 8 * sd + 8))
    # Weights relative to the lowest value, by the ratio of neighbours.
    ratio = lambda k: (good - k + 1) * (draws - k + 1) / (k * (total - good - draws + k)).cast("double")
    ks = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"))
    total_w = F.aggregate(ks, start, lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w * ratio(k)).alias("s")), lambda a: a.s)
    pick = F.aggregate(
        ks,
        F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), low.cast("long").alias("k")),
        lambda a, k: F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w * ratio(k)).alias("s"), F.when(a.s < u * total_w, k).otherwise(a.k).cast("long").alias("k")),
        lambda a: a.k,
    )
    return pick


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: (source, epoch, n blocks) -> (source, epoch, shard, first, n).

    One row per node holds the counts of all sources; a level doubles the rows.
    """
    from pyspark.sql import types as T

    item = "array<struct<source:string,epoch:int,n:bigint>>"
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), F.col("epoch").cast("int").alias("epoch"), F.col("n").cast("long").alias("n")))).cast(item).alias("v")).select(F.lit(0).cast("long").alias("shard"), "v")
    for level in range(levels):
        node = node.withColumn("__n", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.n)).withColumn("__half", F.expr("(__n + 1) div 2")).withColumn("__level", F.lit(level))
        start = F.struct(F.col("__n").alias("rest"), F.col("__half").alias("room"), F.array().cast("array<bigint>").alias("left"))

        def one(a: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("__level"), F.col("shard"), x.source, x.epoch)
            k = _hypergeometric(a.rest, x.n, a.room, u)
            return F.transform(F.array(k), lambda k: F.struct((a.rest - x.n).alias("rest"), (a.room - k).alias("room"), F.concat(a.left, F.array(k)).alias("left")))[0]

        node = node.withColumn("__left", F.aggregate("v", start, one, lambda a: a.left))
        with_n = lambda right: F.transform("v", lambda x, i: F.struct(x.source.alias("source"), x.epoch.alias("epoch"), ((x.n - F.get("__left", i)) if right else F.get("__left", i)).alias("n")))
        node = node.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), with_n(False).alias("v")), F.struct((F.col("shard") * 2 + 1).alias("shard"), with_n(True).alias("v")))).alias("c")).select("c.shard", "c.v")
    leaf = node.select("shard", F.explode("v").alias("x")).select(F.col("x.source").alias("source"), F.col("x.epoch").alias("epoch"), "shard", F.col("x.n").alias("n"))
    upto = Window.partitionBy("source", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", rate: float = 1.5, max_epochs: int = 2, weights: tuple = WEIGHTS, shards: int | None = None, seed: int = 11) -> DataFrame:
    """``docs`` with size, source_size, target and ``draws``.

    ``draws`` has one struct (epoch, shard, place) for each time the mix takes
    the document; it is empty for those left out. ``shards`` is a power of two;
    if None it follows from the words. Columns of ``docs`` that are named as those added are replaced.
    """
    docs = without(docs, "size", "source_size", "target", "draws")
    size = F.size(words(F.col(text))).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(source), F.length(F.coalesce(F.col(text), F.lit(""))))
    narrow = materialize(docs.select(F.col(source).cast("string").alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    sizes = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = sizes.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    if shards is None:
        shards = 16
        while shards * SHARD_WORDS < n.words * rate:
            shards *= 2
    levels, blocks = shards.bit_length() - 1, BLOCKS * max(1, shards // 16)
    side = lambda df, rows=1: F.broadcast(df) if n.sources * rows <= BROADCAST else df

    cell = F.pmod("h", F.lit(blocks * PER)).cast("int")
    narrow = narrow.withColumn("cell", cell)
    cells = materialize(narrow.groupBy("source", "cell").agg(F.sum("size").alias("n")), "mix-cells")
    goal = materialize(targets(sizes, rate, max_epochs, weights), "mix-targets")
    # How many words the partial pass takes, and after how many whole passes.
    goal = goal.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))

    run = Window.partitionBy("source").orderBy("cell")
    upto = cells.withColumn("upto", F.sum("n").over(run))
    at = upto.join(goal.select(F.col("source").alias("__s"), "rest", "full"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # The first cell that doesn't fit wholly.
    edge = at.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min("cell").alias("edge"), F.min_by(F.col("rest") - (F.col("upto") - F.col("n")), "cell").alias("gap"), F.max("full").alias("full"))
    in_edge = narrow.join(side(edge.select(F.col("source").alias("__s"), "edge", "gap")), F.col("source").eqNullSafe(F.col("__s")) & (F.col("cell") == F.col("edge"))).drop("__s")
    in_edge = in_edge.groupBy("source", "h", "gap").agg(F.sum("size").alias("n")).where("n > 0")
    order = Window.partitionBy("source").orderBy("h")
    in_edge = in_edge.withColumn("fits", F.sum("n").over(order) <= F.col("gap"))
    taken = in_edge.where("fits").groupBy("source").agg(F.sum("n").alias("got"), F.max("h").alias("last"))
    gaps = edge.join(taken.select(F.col("source").alias("__s"), "got", "last"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "edge", "last", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"), "full")
    gaps = materialize(gaps, "mix-gaps")

    # One document of each size class and of four hash classes may still fill the gap.
    g = gaps.select(F.col("source").alias("__s"), "edge", "last", "gap")
    after = (F.col("cell") > F.col("edge")) | ((F.col("cell") == F.col("edge")) & (F.col("last").isNull() | (F.col("h") > F.col("last"))))
    spare = narrow.join(side(g), F.col("source").eqNullSafe(F.col("__s")) & after & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)).drop("__s")
    spare = spare.groupBy("source", "gap", F.floor(F.log2(F.col("size").cast("double")) * 2).alias("class"), F.pmod(F.shiftright("h", 20), F.lit(4)).alias("salt")).agg(F.min(F.struct("h", F.col("size").alias("n"))).alias("d"))
    spare = spare.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct(F.col("d.n").alias("n"), F.col("d.h").alias("h"))), asc=False).alias("ds"))
    fill = F.aggregate("ds", F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("hs")), lambda a, x: F.when(x.n <= a.gap, F.struct((a.gap - x.n).alias("gap"), F.concat(a.hs, F.array(x.h)).alias("hs"))).otherwise(a), lambda a: a.hs)
    fills = spare.select("source", fill.alias("fill"))

    plan = goal.join(gaps.select(F.col("source").alias("__a"), "edge", "last"), F.col("source").eqNullSafe(F.col("__a")), "left").join(fills.select(F.col("source").alias("__b"), "fill"), F.col("source").eqNullSafe(F.col("__b")), "left").drop("__a", "__b")
    plan = materialize(plan.withColumn("edge", F.coalesce("edge", F.when(F.col("rest") > 0, F.lit(blocks * PER)).otherwise(F.lit(0)))), "mix-plan")

    # Blocks that each pass takes: all, or those up to the one where the partial pass ends.
    whole = plan.where("full > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), F.lit(blocks).cast("long").alias("n"))
    part = plan.where("rest > 0").select("source", F.col("full").alias("epoch"), F.least(F.lit(blocks), F.expr(f"edge div {PER}") + 1).cast("long").alias("n"))
    quota = materialize(whole.unionByName(part), "mix-quotas")
    leaves = splitting_tree(quota, levels, seed).where("n > 0")
    # Each pass has its own order of blocks; a shard takes as many in a row as its quota says.
    drawn = quota.select("source", "epoch", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("block"))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block")
    drawn = drawn.withColumn("turn", F.row_number().over(turn) - 1)
    slots = leaves.select(F.col("source").alias("__s"), F.col("epoch").alias("__e"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("__turn"))
    drawn = drawn.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("epoch") == F.col("__e")) & (F.col("turn") == F.col("__turn")))
    of_block = drawn.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "shard"))).alias("shards"))
    of_block = materialize(of_block, "mix-blocks").select(F.col("source").alias("__b"), F.col("block").alias("__bb"), "shards")
    last = F.expr(f"least(edge, {blocks * PER - 1}) div {PER}").cast("int").alias("last_block")
    per_source = plan.select(F.col("source").alias("__s"), "source_size", "target", "full", "edge", "last", "fill", last)
    # Documents that fill the gap come from later blocks; the pass's last block stands for theirs.
    ends = of_block.select(F.col("__b").alias("__eb"), F.col("__bb").alias("__ebb"), F.col("shards").alias("end_shards"))
    per_source = per_source.join(ends, F.col("__s").eqNullSafe(F.col("__eb")) & (F.col("last_block") == F.col("__ebb")), "left").drop("__eb", "__ebb")

    rows = docs.withColumn("size", size).withColumn("__h", h).withColumn("__src", F.col(source).cast("string"))
    rows = rows.withColumn("__cell", F.pmod("__h", F.lit(blocks * PER)).cast("int")).withColumn("__block", F.expr(f"cast(__cell div {PER} as int)"))
    d = rows.join(side(per_source), rows["__src"].eqNullSafe(F.col("__s")), "left")
    d = d.join(side(of_block, blocks), d["__src"].eqNullSafe(F.col("__b")) & (d["__block"] == F.col("__bb")), "left")
    c = F.col
    partial = (c("__cell") < c("edge")) | ((c("__cell") == c("edge")) & c("last").isNotNull() & (c("__h") <= c("last"))) | F.coalesce(F.array_contains("fill", c("__h")), F.lit(False))
    times = F.when(c("size") > 0, c("full") + F.coalesce(partial, F.lit(False)).cast("int")).otherwise(0)

    def draw(e: Column) -> Column:
        shard = F.coalesce(F.try_element_at("shards", e), F.try_element_at("end_shards", e))
        return F.struct(e.alias("epoch"), shard.alias("shard"), F.xxhash64(F.lit(seed), e, c("__h")).alias("place"))

    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), draw)).otherwise(F.array().cast("array<struct<epoch:int,shard:bigint,place:bigint>>"))
    return d.select(*docs.columns, "size", "source_size", "target", draws.alias("draws"))


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each draw, dealt to its shard and shuffled inside it.

    A shard (``SHARD_WORDS`` words or fewer in the mean) is dealt over eight tasks.
    """
    rows = mixed.select(*columns, F.explode("draws").alias("__d"))
    return rows.repartition(F.col("__d.shard"), F.pmod("__d.place", F.lit(8))).sortWithinPartitions("__d.shard", "__d.place").drop("__d")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws")
