"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and items are compared with A-Z lower-cased and white space as one blank.

1. An item gives a window at every character, a document at every ``stride``
   characters, of a width by the item's length class (``CLASSES``). Whatever
   place a leak has, each document window inside it has its fellow in the item,
   so no word has to stay whole and nothing hangs on where words begin.
2. CGK: a random walk reads a window and moves on, or not, as a random function
   of step and character says. Two windows at a small edit distance give strings
   at a small Hamming distance.
3. LSH: ``WALKS * TABLES`` tables of sampled places of the walks. Windows that
   agree in a table are a hit; hits of an item that lie within ``max_edits`` of
   its length of each other (as shifts against the document) are a candidate,
   from as many hits on as the class asks for. An item has many windows, of
   which some have few edits.
4. The edit distance between the whole item and its best place in the document
   around the candidate is computed exactly (bit-parallel); up to
   ``max_edits`` of the item's length counts as a leak.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters, each
broadcast for one pass over the documents, so its size isn't bounded.

Null and empty texts have no leaks. Items of fewer than 8 characters, which
occur by chance, are left out, null items too. Equal items of a block are one.
Repeated rows are matched each; rows with a null id too. Very long texts are
searched whole, a few thousand windows at a time. Ties: of an item's places in a
document the first with the fewest edits found is reported. Other columns pass
through decontaminate() and aren't returned by find_leaks().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import table, text_chunks

#: A character of an item costs about 200 bytes of tables.
BLOCK_CHARS = 1_000_000
MIN_CHARS = 8
WALKS, TABLES = 2, 8
#: Least item length -> width of the windows, stride in documents, places of a table, hits of a candidate.
CLASSES = {8: (8, 1, 5, 1), 32: (16, 4, 8, 1), 80: (32, 4, 11, 4)}
#: Windows whose walks are taken at a time.
STEP = 1 << 14
MAX_EDITS = 0.2


_UPPER = {c: c + 32 for c in range(65, 91)}
_BLANK = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}


def _normal(text: str) -> str:
    return " ".join(w for w in text.translate(_UPPER | _BLANK).split(" ") if w)


def fitting_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where that part ends.

    Bit-parallel dynamic programming (Myers), a machine word as long as the pattern.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Walks:
    """CGK walks and sampled places for one window width."""

    def __init__(self, width: int, places: int, seed: int = 5) -> None:
        rng = np.random.default_rng((seed, width))
        # A walk moves on at every other step in the mean.
        self.width, self.steps = width, width * 7 // 4
        # A code's word: whether a walk moves on at it, a bit for each step; the code itself on top.
        self.word = rng.integers(0, 1 << self.steps, (WALKS, 64), dtype=np.int64).view(np.uint64) | (np.arange(64, dtype=np.uint64) << np.uint64(58))
        # Spread over the walk, one place in each part of it.
        cuts = np.linspace(0, self.steps, places + 1).astype(int)
        self.places = rng.integers(cuts[:-1], cuts[1:], (WALKS, TABLES, places))
        self.mark = rng.integers(0, 1 << 62, (WALKS, TABLES), dtype=np.uint64)

    def words(self, codes: np.ndarray) -> list[np.ndarray]:
        """What keys() reads, for a text's codes."""
        return [w.view(np.int64)[codes] for w in self.word]

    def keys(self, words: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Windows of a text (``steps`` zeros behind) -> uint64 [WALKS * TABLES, n]."""
        n = len(starts)
        out = np.empty((WALKS * TABLES, n), np.uint64)
        read, move = np.empty((self.steps, n), np.int64), np.empty(n, np.int64)
        for w in range(WALKS):
            at = starts.astype(np.intp)
            for t in range(self.steps):
                # Places are in range; "clip" only spares numpy a copy.
                np.take(words[w], at, out=read[t], mode="clip")
                np.right_shift(read[t], t, out=move)
                move &= 1
                at += move
            seen = read.view(np.uint64)
            seen >>= np.uint64(58)
            for k in range(TABLES):
                x = out[w * TABLES + k]
                x[:] = self.mark[w, k]
                for p in self.places[w, k]:
                    x <<= np.uint64(6)
                    x ^= seen[p]
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
        return out


def _code_table() -> np.ndarray:
    """6-bit codes of the first 65,536 code points: letters, blank, digits, and 26 classes of all else."""
    out = 38 + np.arange(1 << 16) % 26
    out[97:123], out[32], out[48:58] = np.arange(1, 27), 27, np.arange(28, 38)
    return out.astype(np.uint8)


_CODE = _code_table()


def _codes(text: str, behind: int) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([_CODE[cp & 0xFFFF], np.zeros(behind, np.uint8)])


class Table:
    """The keys of all windows of the items of one length class."""

    def __init__(self, items: list[tuple[int, str]], width: int, stride: int, places: int, hits: int) -> None:
        self.walks, self.stride, self.hits = Walks(width, places), stride, hits
        keys, item, shift = [], [], []
        for k, s in items:
            at = np.arange(len(s) - width + 1)
            keys.append(self.walks.keys(self.walks.words(_codes(s, self.walks.steps)), at))
            item.append(np.full(len(at), k, np.int32))
            shift.append(at.astype(np.int32))
        self.item, self.shift = np.concatenate(item), np.concatenate(shift)
        keys = np.concatenate(keys, axis=1)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.source = keys.ravel()[order], (order % len(self.item)).astype(np.int32)
        # Keys by their first bits, to tell most of those that the items lack.
        self.bits = max(16, (len(self.keys) * 64).bit_length())
        has = np.zeros(1 << self.bits, bool)
        has[self.keys >> np.uint64(64 - self.bits)] = True
        self.has = np.packbits(has, bitorder="little")

    def near(self, codes: np.ndarray, offsets: np.ndarray):
        """(row, item, shift) of the hits; row r is codes[offsets[r]:offsets[r + 1] - 1].

        A row shorter than the windows has none.
        """
        size = np.diff(offsets) - 1
        # Strides from the row's start, and one window at its very end.
        count = np.where(size >= self.walks.width, (size - self.walks.width) // self.stride + 2, 0)
        rows = np.repeat(np.arange(len(size)), count)
        at = (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)) * self.stride
        at = np.minimum(at, size[rows] - self.walks.width)
        words, out = self.walks.words(codes) if len(rows) else [], []
        for lo in range(0, len(rows), STEP):
            r, a = rows[lo : lo + STEP], at[lo : lo + STEP]
            keys = self.walks.keys(words, offsets[r] + a)
            h = (keys >> np.uint64(64 - self.bits)).view(np.int64)
            t, q = np.nonzero(np.take(self.has, h >> 3, mode="clip") >> (h & 7).astype(np.uint8) & 1)
            x = keys[t, q]
            first = np.searchsorted(self.keys, x, "left")
            n = np.searchsorted(self.keys, x, "right") - first
            q = np.repeat(q, n)
            src = self.source[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(q))]
            out.append((r[q], self.item[src], a[q] - self.shift[src]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


class Index:
    """Tables of one block of items: [(item id, text)]."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS) -> None:
        equal: dict[str, list[int]] = {}
        for i, t in items:
            if t and len(s := _normal(t)) >= MIN_CHARS:
                equal.setdefault(s, []).append(i)
        self.items = [(min((i for i in ids if i is not None), default=None), s, len(ids)) for s, ids in equal.items()]
        self.max_edits = max_edits
        self.size = np.array([len(s) for _, s, _ in self.items], np.int64)
        ends = [*list(CLASSES)[1:], 1 << 62]
        self.tables = []
        for (least, layout), end in zip(CLASSES.items(), ends):
            mine = [(k, s) for k, (_, s, _) in enumerate(self.items) if least <= len(s) < end]
            if mine:
                self.tables.append(Table(mine, *layout))

    def find(self, texts) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, start, end, edits) in normalised characters."""
        import pyarrow.compute as pc

        if not self.tables or not len(texts):
            return []
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\t-\r ]+", " ")
        rows = [s.strip(" ") for s in plain.to_pylist()]
        offsets = np.cumsum([0] + [len(s) + 1 for s in rows])
        codes = _codes("\n".join(rows), 1 + max(t.walks.steps for t in self.tables))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t in self.tables:
            r, k, shift = t.near(codes, offsets)
            if not len(r):
                continue
            order = np.lexsort((shift, k, r))
            r, k, shift = r[order], k[order], shift[order]
            slack = (self.max_edits * self.size[k]).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(r) > 0) | (np.diff(k) != 0) | (np.diff(shift) > slack[1:])]))
            last = np.append(first[1:], len(r)) - 1
            enough = last - first + 1 >= t.hits
            for a, b in zip(first[enough].tolist(), last[enough].tolist()):
                row, item = int(r[a]), int(k[a])
                if (found := self._verified(rows[row], item, int(shift[a]), int(shift[b]))) and ((row, item) not in best or found[2] < best[row, item][2]):
                    best[row, item] = found
        return [(row, item, *v) for (row, item), v in sorted(best.items())]

    def _verified(self, text: str, item: int, first: int, last: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the item's best place between two shifts, if near enough."""
        s = self.items[item][1]
        slack = int(self.max_edits * len(s))
        lo = max(0, first - slack)
        region = text[lo : last + len(s) + slack]
        if (x := region.find(s)) >= 0:
            return lo + x, lo + x + len(s), 0
        # An edit takes three of the item's 3-grams at most, or four of its 4-grams.
        for q in (3, 4):
            grams = {region[i : i + q] for i in range(len(region) - q + 1)}
            if sum(s[i : i + q] in grams for i in range(len(s) - q + 1)) < len(s) - q + 1 - q * slack:
                return None
        edits, end = fitting_distance(s, region)
        if edits > slack:
            return None
        begin = end - fitting_distance(s[::-1], region[:end][::-1])[1]
        return lo + begin, lo + end, edits


def benchmark_blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that fit the driver and a broadcast, by hash of the id."""
    b = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_CHARS) or 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", max_edits: float = MAX_EDITS) -> DataFrame:
    """(key, item key, start, end, edits, item_chars, equal_items): every leak of an item in a document.

    Items of one normalised text (in a block) are one, named by the least id and counted.
    """
    spark, out = docs.sparkSession, None
    schema = T.StructType([docs.schema[key], benchmark.schema[item_key], *(T.StructField(c, T.LongType()) for c in ("start", "end", "edits", "item_chars", "equal_items"))])
    rows = docs.select(key, F.col(text).alias("__t"))
    for items in benchmark_blocks(benchmark, item_text, item_key):
        index = spark.sparkContext.broadcast(Index(items, max_edits))

        def part(batches, index=index) -> Iterator:
            import pyarrow as pa

            x = index.value
            for batch in batches:
                for b in text_chunks(batch, "__t"):
                    hits = x.find(b.column("__t"))
                    if hits:
                        cols = [b.column(key).take(pa.array([h[0] for h in hits])), pa.array([x.items[h[1]][0] for h in hits], pa.int64()), *(pa.array([h[c] for h in hits], pa.int64()) for c in (2, 3, 4)), pa.array([len(x.items[h[1]][1]) for h in hits], pa.int64()), pa.array([x.items[h[1]][2] for h in hits], pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        found = rows.mapInArrow(part, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents without a leak, unchanged; no shuffle."""
    spark = docs.sparkSession
    for items in benchmark_blocks(benchmark, item_text, item_key):
        index = spark.sparkContext.broadcast(Index(items, max_edits))

        def part(batches, index=index) -> Iterator:
            for batch in batches:
                for b in text_chunks(batch, text):
                    keep = np.ones(b.num_rows, bool)
                    keep[[h[0] for h in index.value.find(b.column(text))]] = False
                    yield b.filter(keep)

        docs = docs.mapInArrow(part, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
