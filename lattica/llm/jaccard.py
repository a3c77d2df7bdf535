"""N-gram Jaccard self-join by parity sketches.

A document's set are its distinct ``N``-word shingles, hashed to 64 bits; all
documents of one set are one node. Nodes link if 100 * intersection >= 75 *
union. For sets of a and b shingles that link, the symmetric difference is at
most (a + b) / 7, and 3 a <= 4 b.

Sketches
    Sets of over ``SMALL`` shingles, by size band (2^(b-1) <= n < 2^b): the hash
    space is cut into segments, and a segment's sketch is the XOR of the hashes
    that fall into it. A shingle that two sets don't share changes one segment at
    most, so the number of differing segments bounds the symmetric difference from
    below: of a set's f sketches all but n // 3 are those of any set that links
    with it. A set in reach of the next band has that band's sketches, too. Sets up
    to 4/3 ``SMALL``: segments are single shingles, and all but n // 4 agree.
Candidates
    Small sets: by the pigeonhole principle the first n // 4 + 1 sketches in any
    order that is the same for all have one in common. The order is that of
    hashes; ``_spare`` more are joined, so that as many more agree, and then each
    node drops the most frequent ones of as many (those of passages that many
    documents hold). No linked pair is lost. Large sets: all sketches would be in
    proportion to the texts, so ``SEGMENTS`` of 2^b / 2.3 are joined, the same for
    all sets of a band. Of these a linked pair shares 26 or more in the mean, and
    up to ``DROP`` are dropped: a pair is missed if it shares no more than that,
    with a chance of about 1e-8 at the threshold and far less above it.
Pairs
    In a bucket of up to ``PAIRWISE`` nodes all pairs are candidates. In a larger
    one the most central node (its sketches are shared most) is held against all
    others, so a group of n near copies makes n candidates.
    What is then left are buckets with nodes of several components ("open" ones).
    Their nodes take all their sketches in order of rarity among open nodes and
    join the rarest n // 3 + 1 (n // 4 + 1), so that a passage that many texts
    share brings together only texts that have little else. In these buckets, nodes
    that aren't of the bucket's largest component are held against all others in
    blocks, by bit sketches (parities of ``BITS`` hash classes) whose Hamming
    distance is at most the symmetric difference: a pass keeps a spanning forest
    of the clear pairs, and all those near the threshold; a second pass, after
    these are verified, keeps all that are still of two components.
Verification
    Candidates are verified on the texts' shingles exactly. Only documents with
    a candidate have their text shuffled, one for each set.

Sets of 1024 and more shingles have bit sketches of a sample of their hashes; a
bound of the mean and eight standard deviations (chance under 1e-14) stands in
for the exact one there.

Lower-cases A-Z. Texts of fewer than N words have one shingle, their whole word
sequence; those without words, and nulls, have none and link with nothing. Very
long texts are read whole; memory is a few times one text. Rows with a null id
get a null component. Rows of one id are one document, with the links of all its
texts. Ties: a pair at exactly 75 % links; a component is named by its least id.
Other columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import lower_words, materialize, release, table, text_chunks
from lattica.llm.components import components

N = 5
SMALL = 192
SEGMENTS, DROP = 64, 6
PAIRWISE = 16
BITS = 2048
#: Nodes of a block, on either side.
BLOCK = (256, 1024)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[k % 5])
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each Arrow string."""
    import xxhash

    codes, offsets, vocab = lower_words(texts)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))[codes]
    out = []
    h = np.zeros(len(word), np.uint64)
    for k in range(n):
        m = max(len(word) - k, 0)
        h[:m] = _mix(h[:m] + word[k:], k)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = _mix(x + word[k : k + 1], 3)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _spare(n: int) -> int:
    """Sketches of small sets joined beyond those that the pigeonhole principle asks for."""
    return min(n // 12 + 2, n - n // 4 - 1) if n else 0


def _segments(s: np.ndarray, band: int, parts: int, some: int) -> np.ndarray:
    """XOR sketches of the first ``some`` of ``parts`` segments, without empty ones."""
    h = _mix(s, 4)
    segment = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    if some < parts:
        mine = segment < some
        h, segment = h[mine], segment[mine]
    order = np.argsort(segment, kind="stable")
    h, segment = h[order], segment[order]
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(h) else np.zeros(0, np.int64)
    x = np.bitwise_xor.reduceat(_mix(h, 0), first) if len(h) else h
    return _mix(_mix(x + segment[first], 3) + np.uint64(band * 1000 + parts), 2)


def _bands(n: int) -> list[int]:
    b = n.bit_length()
    return [b] + [b + 1] * (4 * n >= 3 << b) if n > SMALL else []


def joined(s: np.ndarray) -> tuple[np.ndarray, int]:
    """The sketches that a set joins first, and how many of them it may drop."""
    n, out = len(s), [np.zeros(0, np.uint64)]
    # The least set that may link shares that many more than needed.
    drop = DROP if n > SMALL * 4 // 3 else _spare(3 * n // 4)
    if 0 < n <= SMALL * 4 // 3:
        out.append(np.sort(_mix(s, 1))[: n // 4 + 1 + _spare(n)])
    for band in _bands(n):
        out.append(_segments(s, band, int(2**band / 2.3), SEGMENTS))
        drop = min(drop, DROP)
    return np.concatenate(out), drop


def sketches(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """All sketches of a set, and how many must be joined; one pair for each size band."""
    n = len(s)
    out = [(_mix(s, 1), n // 4 + 1)] if 0 < n <= SMALL * 4 // 3 else []
    return out + [(_segments(s, band, 1 << band, 1 << band), n // 3 + 1) for band in _bands(n)]


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the classes of a set's hashes: two rows of bits, by level.

    Level 0 takes all hashes, level k one in 2^k. A set of n has the levels
    _level(n) and the one after, so that two sets that may link have one in common.
    """
    h = _mix(_mix(s, 3), 1)
    out = np.zeros((2, BITS), np.uint8)
    for row, level in enumerate((_level(len(s)), _level(len(s)) + 1)):
        x = h[(h >> np.uint64(40)) & np.uint64((1 << level) - 1) == 0] & np.uint64(BITS - 1)
        out[row] = np.bincount(x.astype(np.int64), minlength=BITS) & 1
    return np.packbits(out, axis=1)


def _level(n: int) -> int:
    return max(0, n.bit_length() - 10)


def _sketch_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    def part(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in text_chunks(batch, "t"):
                size, node, spare, values, offsets = [], [], [], [np.zeros(0, np.uint64)], [0]
                for s in shingle_sets(b.column("t")):
                    x, drop = joined(s)
                    size.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    spare.append(drop)
                    values.append(x)
                    offsets.append(offsets[-1] + len(x))
                sigs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(spare, pa.int32()), sigs], names=["k", "n", "node", "spare", "sigs"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(part, "k long, n long, node long, spare int, sigs array<bigint>")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(sig, node, n, c, score): the sketches that a node keeps and shares; c documents have it, copies too."""
    rows = nodes.where(F.col("node").isNotNull()).select("node", "n", "spare", F.explode("sigs").alias("sig"))
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("sig", "c")
    own = rows.join(shared, "sig").groupBy("node", "n", "spare").agg(F.sort_array(F.collect_set(F.struct("c", "sig"))).alias("s"))
    kept = F.slice("s", F.lit(1), F.greatest(F.size("s") - F.col("spare"), F.lit(0)))
    score = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.c)
    return own.select("node", "n", score.alias("score"), F.explode(kept).alias("x")).select("x.sig", "node", "n", "x.c", "score")


def _in_reach(a: str, b: str):
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b))


def _small_pairs(buckets: DataFrame) -> DataFrame:
    g = buckets.where(f"c <= {PAIRWISE}").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.node.alias("a"), x.n.alias("na"), y.node.alias("b"), y.n.alias("nb")))))
    return g.select(F.explode(pairs).alias("p")).select("p.*").where("a < b").where(_in_reach("na", "nb")).select("a", "b")


def _pivot_pairs(large: DataFrame) -> DataFrame:
    """large (sig, node, n, c, score): the most central node of a bucket with each other.

    A bucket is dealt over c / 1024 salts.
    """
    salts = F.expr("cast((c + 1023) div 1024 as int)")
    pivot = large.groupBy("sig").agg(F.max(F.struct("score", "node", "n")).alias("p"), F.max("c").alias("c"))
    pivot = pivot.select("sig", F.col("p.node").alias("pivot"), F.col("p.n").alias("np"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    p = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).join(pivot, ["sig", "salt"]).where("node <> pivot").where(_in_reach("n", "np"))
    return p.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _open_members(large: DataFrame, label: DataFrame) -> DataFrame:
    """Members (with comp) of the buckets that hold nodes of several components."""
    m = large.join(label, "node")
    mixed = m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    return m.join(mixed, "sig", "left_semi")


def _all_sketches(texts: DataFrame) -> DataFrame:
    """texts (node, t) -> (node, n, band, need, sigs, bits): all sketches of a node, one row for each band."""

    def part(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in text_chunks(batch, "t"):
                out = []
                for node, s in zip(b.column("node").to_pylist(), shingle_sets(b.column("t"))):
                    if _node(s) == node:
                        bits = bit_sketch(s).tobytes()
                        out += [(node, len(s), k, need, x.view(np.int64), bits) for k, (x, need) in enumerate(sketches(s))]
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["node", "n", "band", "need", "sigs", "bits"])

    return texts.mapInArrow(part, "node long, n long, band int, need int, sigs array<bigint>, bits binary")


def _rare_buckets(full: DataFrame) -> DataFrame:
    """full: _all_sketches() -> (sig, node, n): each node's rarest sketches, as far as it shares them."""
    rows = full.select("node", "n", "band", "need", F.explode("sigs").alias("sig"))
    count = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    # Sketches that only one node has come first; just their number is needed.
    shared = count.where("c > 1")
    own = rows.join(shared, "sig").groupBy("node", "n", "band").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("s"))
    alone = full.select("node", "band", "need", F.size("sigs").alias("f"))
    own = own.join(alone, ["node", "band"])
    keep = F.greatest(F.lit(0), F.col("need") - (F.col("f") - F.size("s")))
    return own.select("node", "n", F.explode(F.slice("s", F.lit(1), keep)).alias("x")).select("x.sig", "node", "n")


def _held(a: np.ndarray, b: np.ndarray, level: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether bit sketches a[i], b[j] may be of linked sets of ``total[i, j]`` shingles, and whether that is clear."""
    far = np.empty(total.shape, np.int32)
    for k in range(0, len(a), 16):
        far[k : k + 16] = np.bitwise_count(a[k : k + 16, None, :] ^ b[None, :, :]).sum(2, dtype=np.int32)
    d = (total // 7).astype(np.float64) / (1 << level)
    return far <= (d + 8 * np.sqrt(d) + 8 if level else d), far <= 0.8 * d


def _block_pairs(members: DataFrame, full: DataFrame, every: bool) -> DataFrame:
    """members (sig, node, n, comp) of open buckets -> candidates (a, b) of different components.

    Nodes that aren't of the bucket's largest component ("o") are held against all.
    """
    per = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy("sig").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("k"))
    top = top.select("sig", F.col("m.comp").alias("main"), F.ceil(F.col("k") / BLOCK[1]).cast("int").alias("na"), F.ceil((F.col("k") - F.col("m.k") + 1) / BLOCK[0]).cast("int").alias("no"))
    bits = full.groupBy("node").agg(F.first("bits").alias("bits"))
    m = members.join(top, "sig").join(bits, "node")
    h = F.xxhash64("node")
    o = m.where("comp <> main").select("sig", F.pmod(h, F.col("no")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("y"), F.lit(True).alias("o"), "node", "n", "comp", "bits")
    y = m.select("sig", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("x"), F.pmod(h, F.col("na")).cast("int").alias("y"), F.lit(False).alias("o"), "node", "n", "comp", "bits")

    def pairs(table: dict) -> list[tuple[int, int]]:
        node, n, comp, o = (np.array(table[c]) for c in ("node", "n", "comp", "o"))
        bits = np.frombuffer(b"".join(table["bits"]), np.uint64).reshape(len(node), 2, -1)
        level = np.array([_level(k) for k in n.tolist()])
        i, j = np.flatnonzero(o), np.flatnonzero(~o)
        clear, near = [], []
        for la in np.unique(level[i]):
            for lb in np.unique(level[j]):
                if abs(int(la) - int(lb)) > 1:
                    continue
                p, q, top = i[level[i] == la], j[level[j] == lb], max(la, lb)
                fits = (comp[p][:, None] != comp[q][None, :]) & (4 * np.minimum(n[p][:, None], n[q][None, :]) >= 3 * np.maximum(n[p][:, None], n[q][None, :]))
                may, sure = _held(bits[p, top - la], bits[q, top - lb], int(top), n[p][:, None] + n[q][None, :])
                may &= fits
                r, c = np.nonzero(may)
                s = sure[r, c]
                clear += zip(p[r[s]].tolist(), q[c[s]].tolist())
                near += zip(p[r[~s]].tolist(), q[c[~s]].tolist())
        if not every:
            up: dict = {}

            def root(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            forest = []
            for p, q in clear:
                a, b = root(int(comp[p])), root(int(comp[q]))
                if a != b:
                    up[a] = b
                    forest.append((p, q))
            clear, near = forest, [(p, q) for p, q in near if root(int(comp[p])) != root(int(comp[q]))]
        return [(int(node[p]), int(node[q])) for p, q in clear + near]

    def part(batches) -> Iterator:
        import pyarrow as pa

        key, rows = None, {c: [] for c in ("node", "n", "comp", "o", "bits")}

        def out() -> Iterator:
            found = pairs(rows) if len(rows["node"]) > 1 else ()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "x", "y")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            cols = {c: batch.column(c).to_pylist() for c in rows}
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if z == a:
                    continue
                if (k := tuple(keys[a].tolist())) != key:
                    yield from out()
                    key, rows = k, {c: [] for c in rows}
                for c in rows:
                    rows[c] += cols[c][a:z]
        yield from out()

    dealt = o.unionByName(y).repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(part, "a long, b long").distinct()


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b) that link, by their texts (node, t).

    The node with more pairs leads: its text goes once to every block of its
    pairs, and each partner's text once to its block.
    """
    spark = pairs.sparkSession
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    p = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    lead = F.when(F.col("da") >= F.col("db"), F.struct(F.col("a").alias("l"), F.col("b").alias("f"), F.col("da").alias("d"))).otherwise(F.struct(F.col("b").alias("l"), F.col("a").alias("f"), F.col("db").alias("d")))
    p = p.select(lead.alias("x")).select("x.*").withColumn("block", F.pmod(F.xxhash64("f"), F.ceil(F.col("d") / 256)).cast("int"))
    p = materialize(p, "candidates")
    heads = p.select("l", "block").distinct().join(texts.withColumnRenamed("node", "l"), "l").select("l", "block", F.lit(None).cast("long").alias("f"), "t")
    rows = p.select("l", "f", "block").join(texts.withColumnRenamed("node", "f"), "f").select("l", "block", "f", "t")

    def check(batches) -> Iterator:
        import pyarrow as pa

        at, head = None, None
        for batch in batches:
            for b in text_chunks(batch, "t"):
                out_a, out_b = [], []
                for lead, block, follower, s in zip(b.column("l").to_pylist(), b.column("block").to_pylist(), b.column("f").to_pylist(), shingle_sets(b.column("t"))):
                    if _node(s) != (lead if follower is None else follower):
                        continue  # another text of the same id
                    if follower is None:
                        at, head = (lead, block), s
                    elif at == (lead, block):
                        both = len(s) + len(head) - len(np.union1d(s, head))
                        if 100 * both >= threshold * (len(s) + len(head) - both):
                            out_a.append(lead)
                            out_b.append(follower)
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    dealt = heads.unionByName(rows).repartition("l", "block").sortWithinPartitions("l", "block", F.col("f").asc_nulls_first())
    return dealt.mapInArrow(check, "a long, b long")


def _labels(links: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of document ids, and each node's."""
    named = links.join(first.select(F.col("node").alias("a"), F.col("id").alias("u")), "a").join(first.select(F.col("node").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
    comp = materialize(components(named), "components")
    return comp, first.join(comp, first["id"] == comp["id"], "left").select("node", F.coalesce("component", first["id"]).alias("comp"))


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every document; ``threshold`` is 75."""
    if threshold != 75:
        raise ValueError("sketch sizes are laid out for a threshold of 75")
    all_docs = materialize(_sketch_table(docs, text, key), "sketches")
    first = materialize(all_docs.where(F.col("node").isNotNull() & F.col("k").isNotNull()).groupBy("node").agg(F.min("k").alias("id")), "nodes")
    named = all_docs.where("k IS NOT NULL")
    buckets = materialize(_buckets(named), "buckets")
    # From here on the sketches aren't needed.
    rows = materialize(all_docs.select("k", "n", "node"), "rows")
    release(all_docs)
    large = buckets.where(f"c > {PAIRWISE}")
    pairs = materialize(_small_pairs(buckets).union(_pivot_pairs(large)).distinct(), "pairs")

    # Texts of the nodes that have a candidate, one document each.
    wanted = buckets.select("node").distinct().join(first, "node").select("node", F.col("id").alias("__id"))
    t = docs.select(F.col(key).alias("__id"), F.col(text).alias("t")).join(wanted.hint("shuffle_hash"), "__id").select("node", "t")
    texts = materialize(t, "texts")

    links = materialize(_verified(pairs, texts, threshold), "links")
    comp, label = _labels(links, first)
    rest = materialize(_open_members(large, label).select("node").distinct(), "open")
    if not rest.isEmpty():
        full = materialize(_all_sketches(texts.join(rest, "node")).dropDuplicates(["node", "band"]), "full")
        rare = materialize(_rare_buckets(full), "rare")
        for every in (False, True):
            members = _open_members(rare, label)
            more = materialize(_block_pairs(members, full, every).join(pairs, ["a", "b"], "left_anti"), "pairs")
            if more.isEmpty() and not every:
                continue
            pairs = pairs.union(more)
            links = materialize(links.union(_verified(more, texts, threshold)), "links")
            comp, label = _labels(links, first)
    release(buckets, texts)
    out = rows.join(first.select("node", F.col("id").alias("first")), "node", "left").withColumn("first", F.coalesce("first", "k"))
    out = out.join(comp.withColumnRenamed("id", "first"), "first", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), F.coalesce("component", "first")).alias("component_id"))


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
lk AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, m) AS (SELECT DISTINCT a, a FROM lk UNION SELECT lk.b, r.m FROM r JOIN lk ON r.id = lk.a WHERE r.m < lk.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT id, min(m) AS m FROM r GROUP BY id) m ON m.id = d.doc_id
"""
