"""Language-model scoring with a small causal self-attention model in numpy.

Tokens. A text's words (A-Z lower-cased) are encoded with a public byte-level
vocabulary, each with a blank before it, then an end id. Ids are written once
and read by the passes below.

Counts over all training documents: ids, pairs of ids, words.

Model. The ``OWN`` most frequent ids are a symbol each, the others share the rest
of ``SYMBOLS`` (an id has its part of its symbol's count). Symbols fall into
``GROUPS`` groups of like neighbours. The next id is a group, a symbol in it, an id
in that. The group comes from causal attention over the symbols before: ``HEADS``
heads of ``DIM`` numbers with an embedding of each symbol as query, key and value,
in windows of ``CONTEXT + SCORED`` places of which the last ``SCORED`` are scored,
so windows overlap and each id is scored once; the logits are what attention adds
to the counted group after the last symbol. The symbol in its group comes from the
counted pairs of symbols. So each step is a distribution over all ids, and the
score is the probability of the text's ids up to the end id. The model has the same
form for any input: only counts and parameters follow the corpus.

Training. All windows of all training documents in ``ROUNDS`` rounds, each over
another part of the documents (by hash): partitions start from the same parameters
(first from a warm-up on at most ``WARM`` documents), run Adam over their windows,
and their parameters are averaged by numbers of ids. Which windows are averaged
and which follow each other hangs on how the input is dealt to tasks, so scores
of another partitioning differ a little; base scores and counts don't.

The base score's counts are exact: a table of the more frequent words is broadcast
to save work, all others are joined. Words are keyed by a 64-bit hash of their ids.

Null texts are empty: they have the end token only. Repeated rows are scored
each and count each; very long texts are read whole, in windows. Ties between
equally frequent ids go to the smaller id. Without training documents (or rows)
the counts are 0 and smoothing is all. Columns named as those added are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, lower_words, materialize, table, text_chunks

SYMBOLS, OWN = 1024, 960
GROUPS = 32
HEADS, DIM = 2, 6
CONTEXT, SCORED = 8, 16
#: Documents of the warm-up, their longest in bytes of ids, and passes over them.
WARM, WARM_BYTES, WARM_PASSES = 200, 1 << 15, 6
ROUNDS = 3
#: Words that are at least 1 / 2^WORDS_BOUND of all are broadcast, the others joined: how, not what, is counted.
WORDS_BOUND = 21
END = 50256
VOCAB = 50257
_P = np.uint64(0x9E3779B97F4A7C15)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """This process's tokenizer and cache of words; they serve all tasks of the worker."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        _TOKENIZERS[path] = (tok, {})
    return _TOKENIZERS[path]


#: Words that a worker keeps the ids of (some 200 bytes each), and words that are encoded as one string.
CACHED, JOINED = 200_000, 200


def encode_words(tok, path: str, words: list[str]) -> list[bytes]:
    """16-bit ids of each word with a blank before it.

    Words are joined with blanks: the vocabulary splits there, and ids that begin a
    word say where. Where a word has other white space (or places don't agree), its
    group is encoded word by word.
    """
    starts = word_starts(path)
    out: list[bytes] = []
    for a in range(0, len(words), 100 * JOINED):
        parts = [words[x : x + JOINED] for x in range(a, min(len(words), a + 100 * JOINED), JOINED)]
        joined = [" " + " ".join(p) for p in parts]
        for p, s, e in zip(parts, joined, tok.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            cuts = [*(2 * np.flatnonzero(starts[ids])).tolist(), 2 * len(ids)]
            if len(cuts) == len(p) + 1 and len(s.split()) == len(p):
                flat = ids.tobytes()
                out += [flat[b:c] for b, c in zip(cuts, cuts[1:])]
            else:
                out += [array("H", e.ids).tobytes() for e in tok.encode_batch_fast([" " + w for w in p], add_special_tokens=False)]
    return out


def encode_table(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with, in place of the text, ``ids``: 16-bit ids, the end id last."""
    from pyspark.sql import types as T

    path = path or vocabulary()
    rest = [c for c in docs.columns if c not in (text, "ids")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("ids", T.BinaryType())])

    def part(batches) -> Iterator:
        import pyarrow as pa

        tok, cache = _tokenizer(path)
        for batch in batches:
            for b in text_chunks(batch, text):
                codes, offsets, vocab = lower_words(b.column(text))
                words = vocab.to_pylist()
                new = [w for w in words if w not in cache]
                if len(cache) + len(new) > CACHED:
                    cache.clear()
                    new = words
                cache.update(zip(new, encode_words(tok, path, new)))
                parts = [cache[w] for w in words]
                size = np.array([len(p) for p in parts], np.int64) // 2
                flat = np.frombuffer(b"".join(parts), np.uint16)
                n = size[codes]
                at = np.cumsum(n) - n
                ids = flat[np.repeat((np.cumsum(size) - size)[codes] - at, n) + np.arange(n.sum())]
                upto = np.concatenate([[0], np.cumsum(n)])[offsets]
                out = [np.append(ids[a:z], np.uint16(END)).tobytes() for a, z in zip(upto[:-1].tolist(), upto[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, "ids"])

    return docs.mapInArrow(part, schema)


@lru_cache(maxsize=4)
def word_starts(path: str) -> np.ndarray:
    """Which ids begin a word (their string begins with the blank's letter)."""
    from tokenizers import Tokenizer

    out = np.zeros(1 << 16, bool)
    for s, i in Tokenizer.from_file(path).get_vocab().items():
        out[i] = s.startswith("Ġ") or i == END
    return out


def word_keys(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's ids, and where each word begins."""
    begin = np.flatnonzero(starts[ids])
    size = np.diff(np.append(begin, len(ids)))
    h = np.zeros(len(begin), np.uint64)
    live, k = np.arange(len(begin)), 0
    while len(live):
        x = (h[live] ^ (ids[begin[live] + k].astype(np.uint64) + np.uint64(1))) * _P
        h[live] = x ^ (x >> np.uint64(31))
        k += 1
        live = live[size[live] > k]
    return h, begin


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow batch and each document's first place."""
    import pyarrow.compute as pc

    col = batch.column("ids")
    size = pc.binary_length(col).to_numpy(zero_copy_only=False) // 2
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c[order], first)


#: Bytes of ids that are counted at a time, and counts that a task holds (16 bytes each, a few times that in a sort).
COUNTED, HELD = 2 << 20, 1_000_000


def counted(batches, path: str) -> Iterator:
    """Arrow batches with ids -> batches of (kind, key, c), where keys may come again."""
    import pyarrow as pa

    starts = word_starts(path)
    have: dict[int, list] = {0: [[], []], 1: [[], []]}
    n = 0

    def send():
        for kind, (ks, cs) in have.items():
            if ks:
                k, c = _summed(ks, cs)
                have[kind] = [[], []]
                for a in range(0, len(k), 100_000):
                    z = min(a + 100_000, len(k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, kind, np.int32)), pa.array(k[a:z].view(np.int64)), pa.array(c[a:z])], names=["kind", "key", "c"])

    for batch in batches:
        for b in text_chunks(batch, "ids", COUNTED):
            ids, at = _ids(b)
            n += b.num_rows
            pairs = np.concatenate([[END], ids[:-1]]).astype(np.uint32) << np.uint32(16) | ids
            for kind, keys in ((0, word_keys(ids, starts)[0]), (1, pairs)):
                k, c = np.unique(keys, return_counts=True)
                have[kind][0].append(k.astype(np.uint64))
                have[kind][1].append(c)
            # Keys that come again are added up in the task, before the shuffle.
            if sum(len(k) for k in have[0][0]) + sum(len(k) for k in have[1][0]) > HELD:
                for kind in (0, 1):
                    k, c = _summed(*have[kind])
                    have[kind] = [[k], [c]]
                if len(have[0][0][0]) + len(have[1][0][0]) > HELD // 2:
                    yield from send()
    yield from send()
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["kind", "key", "c"])


def count_table(train: DataFrame, path: str) -> DataFrame:
    """(kind, key, c): words (0, hash), pairs of ids (1, before << 16 | id), documents (2, 0)."""
    return train.select("ids").mapInArrow(lambda batches: counted(batches, path), "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def symbols(id_counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each id. Ids that share one begin a word all, or none does."""
    order = np.argsort(-id_counts, kind="stable")
    order = np.concatenate([[END], order[order != END]])
    out = np.empty(VOCAB, np.int64)
    out[order[:OWN]] = np.arange(OWN)
    rest, half = order[OWN:], (SYMBOLS - OWN) // 2
    for first, ids in ((OWN, rest[starts[rest]]), (OWN + half, rest[~starts[rest]])):
        out[ids] = first + np.arange(len(ids)) % half
    return out


def groups(after: np.ndarray, weight: np.ndarray, passes: int = 15) -> np.ndarray:
    """Groups of symbols with like followers and like predecessors (k-means on leading components)."""
    joint = after * weight[:, None]
    before = joint.T / np.maximum(joint.T.sum(1, keepdims=True), 1e-30)
    x = np.concatenate([np.sqrt(after), np.sqrt(before)], 1)
    x = x - weight @ x / weight.sum()
    root = np.sqrt(weight)[:, None]
    values, vectors = np.linalg.eigh((x * root) @ (x * root).T)
    z = vectors[:, -24:] * np.sqrt(np.maximum(values[-24:], 0)) / root
    centre = z[np.argsort(-weight, kind="stable")[:GROUPS]]
    for _ in range(passes):
        of = ((z[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(GROUPS):
            if (of == g).any():
                centre[g] = np.average(z[of == g], axis=0, weights=weight[of == g])
    return of


class Model:
    """Counted tables, and the attention layer's parameters."""

    def __init__(self, pairs: np.ndarray, id_counts: np.ndarray, starts: np.ndarray) -> None:
        """``pairs``: counts of symbol pairs, [SYMBOLS, SYMBOLS]."""
        self.sym = symbols(id_counts, starts)
        smooth = id_counts + 0.05
        self.inside = np.log(smooth / np.bincount(self.sym, weights=smooth, minlength=SYMBOLS)[self.sym]).astype(np.float32)
        single = pairs.sum(0) + 0.5
        single = single / single.sum()
        # Witten and Bell: as much weight for single symbols as there are kinds of pairs.
        kinds = (pairs > 0).sum(1, keepdims=True) + 1
        after = (pairs + kinds * single) / (pairs.sum(1, keepdims=True) + kinds)
        self.group = groups(after, single)
        member = np.zeros((SYMBOLS, GROUPS))
        member[np.arange(SYMBOLS), self.group] = 1
        of_group = np.maximum(after @ member, 1e-30)
        self.given = np.log(after / of_group[:, self.group]).astype(np.float32).ravel()
        # The last row stands for padding.
        self.bias = np.vstack([np.log(of_group), np.zeros((1, GROUPS))]).astype(np.float32)
        rng = np.random.default_rng(1)
        r = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.par = {"out": r(HEADS * DIM, GROUPS) * 0.1}
        for k in range(HEADS):
            self.par |= {f"q{k}": r(SYMBOLS + 1, DIM), f"k{k}": r(SYMBOLS + 1, DIM), f"v{k}": r(SYMBOLS + 1, DIM), f"place{k}": np.zeros((SCORED, CONTEXT + SCORED), np.float32)}

    def windows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input symbols [n, CONTEXT + SCORED], scored places [n, SCORED] (-1: none) and symbols of all ids."""
        c = self.sym[ids]
        before = np.concatenate([[self.sym[END]], c[:-1]])
        size = np.diff(at)
        before[at[:-1][size > 0]] = self.sym[END]
        per = -(-size // SCORED)
        first = np.repeat(at[:-1], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SCORED
        start, end = np.repeat(at[:-1], per), np.repeat(at[1:], per)
        place = first[:, None] + np.arange(-CONTEXT, SCORED)
        x = np.where((place >= start[:, None]) & (place < end[:, None]), before[np.clip(place, 0, len(c) - 1)], SYMBOLS)
        scored = np.where(place[:, CONTEXT:] < end[:, None], place[:, CONTEXT:], -1)
        return x, scored, c

    #: What a place mustn't see gets no weight.
    _CAUSAL = np.where(np.arange(CONTEXT + SCORED)[None, :] <= np.arange(SCORED)[:, None] + CONTEXT, 0, -1e4).astype(np.float32)
    _ROW = np.ones(GROUPS, np.float32)

    def forward(self, x: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """What each head saw, hidden states and group logits of the scored places.

        Weights are divided by their sum after they have met the values; the sum
        comes from a value that is always one.
        """
        p, last, heads = self.par, x[:, CONTEXT:], []
        pad = x == SYMBOLS
        some = np.flatnonzero(pad.any(1))
        free = ~pad[some][:, None, :]
        h = np.empty((last.size, HEADS * DIM), np.float32)
        for n in range(HEADS):
            q, k = (p[f"q{n}"] * np.float32(DIM**-0.5))[last], p[f"k{n}"][x]
            v = np.concatenate([p[f"v{n}"], np.ones((SYMBOLS + 1, 1), np.float32)], 1)[x]
            s = np.matmul(q, k.transpose(0, 2, 1))
            s += p[f"place{n}"] + self._CAUSAL
            np.exp(s, out=s)
            s[some] *= free
            o = np.matmul(s, v).reshape(-1, DIM + 1)
            # A padded place sees nothing; it isn't scored.
            total = o[:, DIM:] + np.float32(1e-20)
            h[:, n * DIM : (n + 1) * DIM] = o[:, :DIM] / total
            heads.append((q, k, v[:, :, :DIM], s, total))
        o = h @ p["out"]
        o += self.bias[last.ravel()]
        return heads, h, o

    def step(self, x: np.ndarray, y: np.ndarray, adam: dict, rate: float = 0.01) -> float:
        """One Adam step on windows x with target groups y (-1: none)."""
        heads, h, o = self.forward(x)
        y = y.ravel()
        real = y >= 0
        e = np.exp(np.minimum(o, 60, out=o), out=o)
        e /= (e @ self._ROW)[:, None]
        rows = np.flatnonzero(real)
        loss = -np.log(e[rows, y[rows]] + 1e-30).mean()
        e[rows, y[rows]] -= 1
        e[~real] = 0
        e /= len(rows)
        g = {"out": h.T @ e}
        dh = e @ self.par["out"].T
        add = lambda xs, d: np.stack([np.bincount(xs, weights=d[:, j], minlength=SYMBOLS + 1) for j in range(DIM)], 1).astype(np.float32)
        flat, last = x.ravel(), x[:, CONTEXT:].ravel()
        for n, (q, k, v, a, total) in enumerate(heads):
            own = slice(n * DIM, (n + 1) * DIM)
            d = np.ascontiguousarray(dh[:, own])
            a /= total.reshape(len(x), SCORED, 1)
            ds = np.matmul(d.reshape(len(x), SCORED, DIM), v.transpose(0, 2, 1))
            ds -= (d * h[:, own]).sum(1).reshape(len(x), SCORED, 1)
            ds *= a
            g[f"place{n}"] = ds.sum(0)
            g[f"q{n}"] = add(last, np.matmul(ds, k).reshape(-1, DIM)) * np.float32(DIM**-0.5)
            # The queries are scaled, so the keys' gradient is, too.
            g[f"k{n}"] = add(flat, np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, DIM))
            g[f"v{n}"] = add(flat, np.matmul(a.transpose(0, 2, 1), d.reshape(len(x), SCORED, DIM)).reshape(-1, DIM))
        adam["t"] = t = adam.get("t", 0) + 1
        for n, grad in g.items():
            m = adam[n, 0] = 0.9 * adam.get((n, 0), 0) + 0.1 * grad
            s = adam[n, 1] = 0.99 * adam.get((n, 1), 0) + 0.01 * grad**2
            new = self.par[n] - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
            # Bounds keep all exponents in range.
            self.par[n] = np.clip(new, -4, 4).astype(np.float32)
        return float(loss)

    def train(self, ids: np.ndarray, at: np.ndarray, adam: dict, size: int = 512, rate: float = 0.01) -> None:
        x, scored, c = self.windows(ids, at)
        y = np.where(scored >= 0, self.group[c[scored]], -1)
        for a in range(0, len(x), size):
            self.step(x[a : a + size], y[a : a + size], adam, rate)

    def log_probability(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each id."""
        x, scored, c = self.windows(ids, at)
        target, out = self.group[c], np.empty(len(ids), np.float64)
        for a in range(0, len(x), 512):
            last = x[a : a + 512, CONTEXT:].ravel()
            o = self.forward(x[a : a + 512])[2]
            z = scored[a : a + 512].ravel()
            rows = np.flatnonzero(z >= 0)
            z = z[rows]
            np.minimum(o, 60, out=o)
            own = o[rows, target[z]]
            out[z] = own - np.log((np.exp(o, out=o) @ self._ROW)[rows]) + self.given[last[rows] * SYMBOLS + c[z]]
        return out + self.inside[ids]


def fit(train: DataFrame, counts: DataFrame, path: str) -> Model:
    """train: (ids) of all training documents; counts: count_table()."""
    spark = train.sparkSession
    pairs, starts = counts.where("kind = 1"), word_starts(path)
    ids = np.zeros(VOCAB)
    for r in pairs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("i")).agg(F.sum("c").alias("c")).collect():  # VOCAB rows at most
        ids[r.i] = r.c
    # VOCAB rows of two numbers.
    of = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(symbols(ids, starts))], "i long, s int"))
    a = of.select(F.col("i").alias("i"), F.col("s").alias("a"))
    b = of.select(F.col("i").alias("j"), F.col("s").alias("b"))
    p = pairs.select(F.shiftright("key", 16).alias("i"), F.col("key").bitwiseAND(0xFFFF).alias("j"), "c").join(a, "i").join(b, "j")
    p = p.groupBy((F.col("a") * SYMBOLS + F.col("b")).alias("k")).agg(F.sum("c").alias("c")).toArrow()  # SYMBOLS^2 rows at most
    table = np.zeros(SYMBOLS * SYMBOLS)
    table[p.column("k").to_numpy()] = p.column("c").to_numpy()
    model = Model(table.reshape(SYMBOLS, SYMBOLS), ids, starts)
    n = train.count()
    if not n:
        return model
    # WARM documents at most, none over WARM_BYTES, copies once.
    share = int(min(1.0, 4 * WARM / n) * (1 << 30))
    some = train.select("ids", F.xxhash64("ids").alias("h")).where((F.length("ids") <= WARM_BYTES) & (F.pmod("h", F.lit(1 << 30)) <= share))
    warm = some.dropDuplicates(["h"]).orderBy("h").limit(WARM).select("ids").toArrow()
    if warm.num_rows:
        adam: dict = {}
        for _ in range(WARM_PASSES):
            for b in warm.combine_chunks().to_batches(max_chunksize=32):
                model.train(*_ids(b), adam, 256)
    shapes = [(k, v.shape) for k, v in model.par.items()]
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rate = 0.01 / (r + 1)

        def part(batches, shared=shared, rate=rate) -> Iterator:
            import copy

            import pyarrow as pa

            m, adam, seen = copy.copy(shared.value), {}, 0
            m.par = dict(m.par)
            for batch in batches:
                for b in text_chunks(batch, "ids", 1 << 20):
                    i, at = _ids(b)
                    m.train(i, at, adam, rate=rate)
                    seen += len(i)
            if seen:
                flat = np.concatenate([m.par[k].ravel() for k, _ in shapes]).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, seen))], names=["i", "x"])

        mine = train.select("ids").where(F.pmod(F.xxhash64(F.lit(3), "ids"), F.lit(ROUNDS)) == r)
        sums = mine.mapInArrow(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow().column("x").to_numpy()
        if len(sums):
            flat, at = sums[:-1] / sums[-1], 0
            for k, s in shapes:
                model.par[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
                at += int(np.prod(s))
    return model


def lm_scores(docs: DataFrame, train: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without the text, with the scores; ``train``: name of the column that says what to learn from.

    Adds n_tokens, n_known, train_tokens, base_score, score (log10), in place of
    columns so named.
    """
    from pyspark.sql import types as T

    path = path or vocabulary()
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c not in (text, *added)]
    rows = materialize(encode_table(docs.select(*keep, F.monotonically_increasing_id().alias("__row"), text), text, path), "ids")
    counts = materialize(count_table(rows.where(F.col(train)), path), "counts")
    words = counts.where("kind = 0")
    t = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, log_all = t.n, float(np.log10(max(t.n + 0.5 * (t.v + 1), 1e-300)))
    model = fit(rows.where(F.col(train)), counts, path)
    # At most 2^WORDS_BOUND words are that frequent: two numbers each.
    often = words.where(F.col("c") * (1 << WORDS_BOUND) >= total).select(F.col("key").alias("k"), "c").orderBy("k").toArrow()
    often_k, often_c = often.column("k").to_numpy(), often.column("c").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((model, often_k, often_c))
    rare_type = T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.IntegerType())]))
    out_fields = [T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("__rare", rare_type)]
    schema = T.StructType([*(rows.schema[c] for c in (*keep, "__row")), *out_fields])

    def part(batches) -> Iterator:
        import pyarrow as pa

        m, often_k, often_c = shared.value
        starts = word_starts(path)
        for batch in batches:
            for b in text_chunks(batch, "ids", 1 << 20):
                ids, at = _ids(b)
                lp = m.log_probability(ids, at)
                keys, begin = word_keys(ids, starts)
                keys = keys.view(np.int64)
                doc = np.searchsorted(at, begin, "right") - 1
                c = np.zeros(len(keys), np.int64)
                if len(often_k):
                    k = np.minimum(np.searchsorted(often_k, keys), len(often_k) - 1)
                    c = np.where(often_k[k] == keys, often_c[k], 0)
                size = b.num_rows
                known = c > 0
                base = np.where(known, np.log10(c + 0.5) - log_all, 0)
                r_doc, r_key = doc[~known], keys[~known]
                order = np.lexsort((r_key, r_doc))
                r_doc, r_key = r_doc[order], r_key[order]
                new = np.flatnonzero(np.concatenate([[True], (r_doc[1:] != r_doc[:-1]) | (r_key[1:] != r_key[:-1])])) if len(r_doc) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(r_doc))).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(r_doc[new], minlength=size))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(r_key[new]), pa.array(n)], names=["k", "n"]))
                sums = lambda w: np.bincount(doc, weights=w, minlength=size)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in (*keep, "__row")), pa.array(np.bincount(doc, minlength=size)), pa.array(sums(known).astype(np.int64)), pa.array(sums(base)), pa.array(np.add.reduceat(lp, at[:-1]) / np.log(10) if size else lp), rare], names=schema.names)

    scored = materialize(rows.mapInArrow(part, schema), "scored")
    r = scored.select("__row", F.explode("__rare").alias("x")).select("__row", "x.k", "x.n")
    r = r.join(words.select(F.col("key").alias("k"), "c"), "k", "left")
    c = F.coalesce("c", F.lit(0))
    r = r.groupBy("__row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__k"), F.sum(F.col("n") * (F.log10(c + 0.5) - log_all)).alias("__b"))
    j = scored.drop("__rare").join(r, "__row", "left")
    return j.select(*keep, "n_tokens", (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("__base") + F.coalesce("__b", F.lit(0.0))).alias("base_score"), "score")


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 1)
    s = lm_scores(docs.withColumn("__train", ~F.col("held_out")), "__train")
    return s.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
