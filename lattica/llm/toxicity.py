"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult, threat, target, negation, reported speech, other.
Left-to-right transducers for negation, reported speech and targets are composed
into one; a right-to-left one reads its output and sees targets that follow
(together a bimachine). They rewrite what a pattern governs: an insult with a
target on either side, a threat with its target behind or before it, each
weakened by negation or reported speech. What is left of a clause is weighed by
an acceptor. A lone insult weighs too little to be predicted toxic; it takes a
clause that matches a pattern, or several insults.

The grammar's insult and threat words are seeds plus words and stems learnt
from labelled texts: those that occur with label 1 in many different contexts
and almost never with label 0. Contexts (the words on either side), not
documents, are counted, so that copies of a text teach no more than the text.
The acceptor's weights are fitted to the same texts, by maximum a posteriori
about set values and inside bounds (``WEIGHTS``), with score 1 - exp(-weight).
At most about ``MAX_TRAIN`` labelled texts are read for this; which ones, the
hash of their id says.

Nulls and empty texts score 0. Repeated rows get the same score. Very long texts
are read whole: a text's weights add up over its clauses. Ties at the threshold
count as toxic. Columns of the input that are named as those added are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, lower_words, materialize, table, text_chunks

#: Bound on the labelled texts that the lexicon is learnt from.
MAX_TRAIN = 12_000
STEMS = (4, 5, 6)

OTHER, INSULT, THREAT, TARGET, NEG, REPORT = range(6)
#: Classes that the transducers write: weakened, with a target, threat behind or before its target.
INSULT_W, THREAT_W, INSULT_T, THREAT_L, THREAT_T = range(6, 11)
SYMBOLS = 11
CLAUSE_END = 32
#: class -> set weight, least, most
WEIGHTS = {
    INSULT: (0.2, 0.0, 0.23),
    INSULT_T: (1.0, 0.4, 3.0),
    INSULT_W: (0.08, 0.0, 0.15),
    THREAT: (0.1, 0.0, 0.2),
    THREAT_L: (0.2, 0.0, 0.3),
    THREAT_T: (1.0, 0.4, 3.0),
    THREAT_W: (0.05, 0.0, 0.1),
}

SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers pathetic worthless scum trash disgusting clown fool dumb imbecile".split(),
    THREAT: "kill murder destroy hurt stab strangle shoot burn".split(),
    TARGET: "you u he she they him her them du ihr er sie tu vous il elle ils usted ella ellos".split(),
    NEG: "not never no isn't aren't don't wasn't nicht kein nie ne pas jamais no nunca".split(),
    REPORT: "said says say called calls wrote quote quoted claimed sagte dit dijo".split(),
}


class Transducer:
    """Weighted deterministic transducer over word classes (max-plus weights).

    ``arcs[state][symbol] = (next state, output symbol, weight)``; symbols
    without an arc pass unchanged and lead to state 0.
    """

    def __init__(self, arcs: dict[int, dict[int, tuple[int, int, float]]]) -> None:
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get(state, {}).get(symbol, (0, symbol, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` makes of this one's output, as one transducer."""
        ids, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            p, q = todo.pop()
            row = arcs[ids[p, q]] = {}
            for s in range(SYMBOLS):
                p2, mid, w = self.step(p, s)
                q2, out, v = other.step(q, mid)
                if (p2, q2) not in ids:
                    ids[p2, q2] = len(ids)
                    todo.append((p2, q2))
                row[s] = (ids[p2, q2], out, w + v)
        return Transducer(arcs)

    def rewrite(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, o, _ = self.step(state, s)
            out.append(o)
        return out


def _span(trigger: int, rewrite: dict[int, int], reach: int) -> Transducer:
    """After ``trigger``, classes in ``rewrite`` are rewritten for ``reach`` words."""
    arcs: dict[int, dict] = {0: {trigger: (1, trigger, 0.0)}}
    for k in range(1, reach + 1):
        n = k + 1 if k < reach else 0
        arcs[k] = {s: (n, rewrite.get(s, s), 0.0) for s in range(SYMBOLS)} | {trigger: (1, trigger, 0.0)}
    return Transducer(arcs)


class Grammar:
    """The composed bimachine, and the acceptor behind it."""

    def __init__(self, weights: dict[int, float] | None = None) -> None:
        weak = {INSULT: INSULT_W, THREAT: THREAT_W}
        self.forward = _span(NEG, weak, 3).compose(_span(REPORT, weak, 6)).compose(_span(TARGET, {INSULT: INSULT_T, THREAT: THREAT_L}, 6))
        self.backward = _span(TARGET, {INSULT: INSULT_T, THREAT: THREAT_T, THREAT_L: THREAT_T}, 3)
        weights = weights or {c: w for c, (w, _, _) in WEIGHTS.items()}
        self.acceptor = Transducer({0: {c: (0, c, w) for c, w in weights.items()}})

    def patterns(self, classes: list[int]) -> list[int]:
        """The classes of a clause as the transducers rewrite them."""
        return self.backward.rewrite(self.forward.rewrite(classes)[::-1])[::-1]

    def weight(self, classes: list[int], strengths: list[float]) -> float:
        """What the acceptor gives a clause; ``strengths`` are the words' own."""
        state, total = 0, 0.0
        for c, s in zip(self.patterns(classes), strengths):
            state, _, w = self.acceptor.step(state, c)
            total += w * s
        return total


_EDGE = re.compile(r"^\W+|\W+$")


class Lexicon:
    """Classes of words: exact words first, then stems (prefixes)."""

    def __init__(self, learnt: dict[str, float]) -> None:
        self.words = {w: (c, 1.0) for c, ws in SEEDS.items() for w in ws}
        self.stems: dict[str, float] = {}
        for key, weight in learnt.items():
            if key.endswith("^"):
                self.stems[key[:-1]] = weight
            else:
                self.words[key] = (INSULT, weight)

    def classify(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cls, wt = np.zeros(len(words), np.uint8), np.ones(len(words))
        known, stems = self.words, self.stems
        for k, raw in enumerate(words):
            end = CLAUSE_END if raw[-1] in ".!?;:|" else 0
            w = _EDGE.sub("", raw).lower()
            hit = known.get(w)
            if hit is None and stems:
                for n in STEMS:
                    if len(w) >= n and (s := stems.get(w[:n])) is not None:
                        hit = (INSULT, s)
                        break
            if hit:
                cls[k], wt[k] = hit[0] | end, hit[1]
            else:
                cls[k] = end
        return cls, wt


def clauses(texts, lexicon: Lexicon) -> Iterator[tuple[int, list[int], list[float]]]:
    """(row, classes, strengths) of the clauses of Arrow strings that hold an insult or a threat."""
    codes, offsets, vocab = lower_words(texts)
    ucls, uwt = lexicon.classify(vocab.to_pylist())
    cls, wt = ucls[codes], uwt[codes]
    kind = cls & 31
    hot = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    rows = np.searchsorted(offsets, hot, "right") - 1
    ends = np.concatenate([[0], np.flatnonzero(cls & CLAUSE_END) + 1, [len(cls)]])
    k = np.searchsorted(ends, hot, "right")
    a, b = np.maximum(ends[k - 1], offsets[rows]), np.minimum(ends[k], offsets[rows + 1])
    last = (-1, -1)
    for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist()):
        if (r, x) != last:
            last = (r, x)
            yield r, kind[x:y].tolist(), wt[x:y].tolist()


def score_texts(texts, lexicon: Lexicon, machine: Grammar) -> tuple[list[float], list[int]]:
    """Scores and numbers of matched clauses of Arrow strings."""
    total, n = np.zeros(len(texts)), [0] * len(texts)
    for r, classes, strengths in clauses(texts, lexicon):
        w = machine.weight(classes, strengths)
        if w > 0:
            total[r] += w
            n[r] += 1
    return (1.0 - np.exp(-total)).tolist(), n


def pattern_sums(texts, lexicon: Lexicon, machine: Grammar) -> np.ndarray:
    """Sums of word strengths by text and class of ``WEIGHTS``."""
    at = {c: k for k, c in enumerate(WEIGHTS)}
    out = np.zeros((len(texts), len(WEIGHTS)))
    for r, classes, strengths in clauses(texts, lexicon):
        for c, s in zip(machine.patterns(classes), strengths):
            if c in at:
                out[r, at[c]] += s
    return out


def fit_weights(sums: np.ndarray, label: np.ndarray, spread: float = 0.3, steps: int = 400) -> dict[int, float]:
    """Weights of the acceptor: score 1 - exp(-sums @ w) against labels, with a normal prior and bounds."""
    mean, low, high = (np.array(x) for x in zip(*WEIGHTS.values()))
    w = mean.copy()
    hit = sums.sum(1) > 0
    x, y = sums[hit], label[hit].astype(bool)
    if not len(x):
        return dict(zip(WEIGHTS, w.tolist()))
    rate = 0.05
    for _ in range(steps):
        z = np.maximum(x @ w, 1e-6)
        # d/dz of the log likelihood: e^-z / (1 - e^-z) with label 1, -1 with label 0.
        g = np.where(y, 1 / np.expm1(z), -1.0) @ x / len(x) - (w - mean) / spread**2 / len(x)
        w = np.clip(w + rate * g, low, high)
    return dict(zip(WEIGHTS, w.tolist()))


def _training_rows(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, max_train: int) -> DataFrame:
    """(t, y): at most about ``max_train`` labelled texts, by hash of the id."""
    labels = labels.select(key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    total = labels.count()
    if total > max_train:
        labels = labels.where(F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(1 << 20)) < int(max_train / total * (1 << 20)))
    # The sample has about max_train rows of two numbers, however many labels there are.
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(labels), key)
    return rows.select(F.col(text).alias("t"), F.col(label).alias("y"))


def learn_grammar(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_train: int = MAX_TRAIN) -> tuple[dict[str, float], dict[int, float]]:
    """The lexicon and the acceptor's weights, from texts with a label of 0 or 1."""
    rows = materialize(_training_rows(docs, labels, text, label, key, max_train), "labelled")
    learnt = learn_lexicon(rows)

    def part(batches) -> Iterator:
        import pyarrow as pa

        lexicon, machine = Lexicon(learnt), Grammar()
        for batch in batches:
            for b in text_chunks(batch, "t"):
                x = pattern_sums(b.column("t"), lexicon, machine)
                yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    # Rows that are alike are one with a count, so the order of rows doesn't matter; max_train rows at most.
    found = rows.mapInArrow(part, "y int, x array<double>").groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "x").collect()
    x, y = np.array([r.x for r in found for _ in range(r.n)]).reshape(-1, len(WEIGHTS)), np.array([r.y for r in found for _ in range(r.n)])
    return learnt, fit_weights(x, y)


def learn_lexicon(rows: DataFrame, min_contexts: int = 5, purity: float = 0.97) -> dict[str, float]:
    """Words and stems (ending in ``^``) -> weight, from rows (t, y) of texts and labels.

    As the texts are a bounded sample, so is the lexicon.
    """

    def part(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        pos: dict[str, int] = {}
        neg: dict[str, int] = {}
        ctx: dict[str, set[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
                ws = [_EDGE.sub("", w).lower() for w in t.split()]
                seen = set()
                for k, w in enumerate(ws):
                    if not w:
                        continue
                    for s in (w, *(w[:n] + "^" for n in STEMS if len(w) >= n)):
                        if y:
                            ctx.setdefault(s, set()).add(xxhash.xxh32_intdigest(f"{ws[k - 1] if k else ''} {ws[k + 1] if k + 1 < len(ws) else ''}"))
                        seen.add(s)
                into = pos if y else neg
                for s in seen:
                    into[s] = into.get(s, 0) + 1
        keys = [*pos, *(k for k in neg if k not in pos)]
        for a in range(0, len(keys), 50_000):
            ks = keys[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"s": ks, "p": [pos.get(k, 0) for k in ks], "n": [neg.get(k, 0) for k in ks], "c": [list(ctx.get(k, ())) for k in ks]}, schema=pa.schema([("s", pa.string()), ("p", pa.int64()), ("n", pa.int64()), ("c", pa.list_(pa.int64()))]))

    counts = rows.mapInArrow(part, "s string, p long, n long, c array<bigint>")
    # Both sums first, so that contexts are only gathered for pure words.
    pure = counts.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where((F.col("p") >= min_contexts) & (F.col("p") >= purity * (F.col("p") + F.col("n"))))
    contexts = counts.select("s", F.explode("c").alias("c")).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    found = pure.join(contexts, "s").where(F.col("c") >= min_contexts).collect()
    return {r.s: min(1.5, 0.5 + float(np.log10(r.c))) for r in found}


def toxicity(docs: DataFrame, learnt: dict[str, float], weights: dict[int, float] | None = None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the text and with, in place of columns so named, score, predicted and n_clauses."""
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c not in (text, *("score", "predicted", "n_clauses"))]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_clauses", T.LongType())])

    def score(batches) -> Iterator:
        import pyarrow as pa

        lexicon, machine = Lexicon(learnt), Grammar(weights)
        for batch in batches:
            for b in text_chunks(batch, text):
                s, n = score_texts(b.column(text), lexicon, machine)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array(n, pa.int64())], names=[*rest, "score", "predicted", "n_clauses"])

    return docs.mapInArrow(score, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return toxicity(docs.select("doc_id", "held_out", "text"), *learn_grammar(docs, labels))
