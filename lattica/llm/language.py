"""Language identification with hyperdimensional profiles.

Each letter class has a random +1/-1 vector. The vector of an n-gram binds
(multiplies) its letters' vectors, each rotated by its place; a text bundles
(adds) the vectors of its n-grams, a language those of its training texts. A
text gets the language whose prototype has the highest cosine.

Letters are folded into ``SYMBOLS`` classes (a-z each their own, other letters
by code point), all else is a word boundary. Texts without a letter and nulls
get ``und`` with score 0. Training adds up all training texts in the partitions
and sends one vector per language and partition; nothing grows with the number
of documents. Repeated rows count repeatedly; ties go to the first language by
name. Very long texts are read whole. Columns named as those added are replaced;
without training texts every prediction is ``und``. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, table, text_chunks

SYMBOLS = 64
DIM = 1024
N = 3


class Space:
    """Letter classes and n-gram vectors; the same in every process."""

    def __init__(self, dim: int = DIM, seed: int = 7) -> None:
        self.dim = dim
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(letters, N - 1 - k, axis=1) for k in range(N)]
        self.code = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
                low = ord(c.lower()[0])
                self.code[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
        self.known: dict[int, np.ndarray] = {}

    def grams(self, text: str) -> np.ndarray:
        """Indices of the n-grams of ``text``; empty if it has no letter."""
        cp = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.code[cp]
        c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))].astype(np.int32)
        if len(c) < N or not c.any():
            return np.zeros(0, np.int32)
        g = c[: len(c) - N + 1].copy()
        for k in range(1, N):
            g = g * SYMBOLS + c[k : len(c) - N + 1 + k]
        return g

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = self.placed[N - 1][grams % SYMBOLS]
        for k in range(N - 2, -1, -1):
            grams = grams // SYMBOLS
            out = out * self.placed[k][grams % SYMBOLS]
        return out

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the vectors of all n-grams."""
        u, n = np.unique(grams, return_counts=True)
        total = np.zeros(self.dim, np.float64)
        for a in range(0, len(u), 2048):
            total += n[a : a + 2048].astype(np.float32) @ self.vectors(u[a : a + 2048]).astype(np.float32)
        return total


def fit_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Language -> bundle of all its texts. Rows without text or language teach nothing."""

    def part(batches) -> Iterator:
        import pyarrow as pa

        space, sums = Space(dim), {}
        for batch in batches:
            for b in text_chunks(batch, "text"):
                by: dict[str, list[np.ndarray]] = {}
                for t, lg in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    if len(g := space.grams(t)):
                        by.setdefault(lg, []).append(g)
                for lg, gs in by.items():
                    sums[lg] = sums.get(lg, 0) + space.bundle(np.concatenate(gs))
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sums = rows.mapInArrow(part, "lang string, v array<double>")
    dims = sums.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in dims.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect():  # languages x dim numbers
        out[r.lang] = np.array([p.x for p in r.v])
    return dict(sorted(out.items()))


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM) -> DataFrame:
    """``docs`` without the text and with, in place of columns so named, ``lang_pred`` and ``score`` (cosine, at least 0)."""
    from pyspark.sql import types as T

    names = list(prototypes)
    m = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names]).reshape(len(names), dim)
    rest = [c for c in docs.columns if c not in (text, *("lang_pred", "score"))]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches) -> Iterator:
        import pyarrow as pa

        space = Space(dim)
        for batch in batches:
            for b in text_chunks(batch, text):
                lang, best = [], []
                for t in b.column(text).to_pylist():
                    g = space.grams(t or "")
                    if len(g) and names:
                        v = space.bundle(g)
                        cos = m @ v / max(np.linalg.norm(v), 1e-12)
                        k = int(cos.argmax())
                        lang.append(names[k])
                        best.append(min(1.0, max(0.0, float(cos[k]))))
                    else:
                        lang.append("und")
                        best.append(0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(best, pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = fit_prototypes(docs.where(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), model)
