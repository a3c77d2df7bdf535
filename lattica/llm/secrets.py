"""Secret scans: fixed patterns and a randomness test battery (built-in functions only).

Fixed patterns find assigned credentials, access key ids and long hex strings.
The battery looks at every other run of 20 or more characters of the base-64
alphabets that holds a letter and a digit:

1. An encoding is inferred (hex, base 32, base 36, base 62, base 64), which
   gives the alphabet of k symbols and each character's value.
2. Three tests ask if the values look random: chi-squared uniformity over the
   alphabet (exact for up to ``EXACT`` characters, as short runs are far from the
   limiting law), Wald-Wolfowitz runs about the middle value, serial correlation
   at lag 1. The least of the three p-values times three is the run's p_random.
3. The same chi-squared statistic is held against the law it has for text of
   that length, which uses few symbols often; its lower tail is p_text, the p-value
   of "this is text". Short runs can't get a small one, so length is accounted for.
4. Benjamini-Hochberg over all runs of the corpus in a length class, on p-values
   rounded up to tenths of a decade, controls both decisions: runs whose p_random is
   significant (at ``alpha``) aren't random, and of the others those whose p_text is
   significant (at ``fdr``) are secrets.

Spans are whole matches in code points, end exclusive. Nulls count as empty
texts and have no spans. Repeated rows are scanned each. Very long texts are
scanned whole, in time about linear in their matches. Ties: spans of one start are
in the order of kinds. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the length inside the pattern changes nothing.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
KINDS = ("assign", "access", "hex", "random")
LENGTH_CLASSES = 8
SHORT, EXACT = 20, 64
#: Entries of an array that are summed in one go.
CHUNK = 128
BINS = 70


def _running(d: DataFrame, values: str, out: str, join) -> DataFrame:
    """Adds ``out``: what ``join`` makes of the values up to each entry (an array of longs).

    By chunks, since an array that grows entry by entry is copied each time. Here
    and below arrays meet by zipping: a column inside a lambda may be moved there
    by the optimizer and be computed again for each entry.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    start = F.struct(zero.alias("x"), none.alias("xs"))

    def up_to(xs: Column) -> Column:
        step = lambda a, x: F.struct(join(a.x, x).alias("x"), F.concat(a.xs, F.array(join(a.x, x))).alias("xs"))
        return F.aggregate(xs, start, step, lambda a: a.xs)

    n = F.size(values)
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.expr(f"(size({values}) - 1) div {CHUNK}").cast("int")), lambda k: up_to(F.slice(values, k * CHUNK + 1, CHUNK))))
    d = d.withColumn("__chunks", chunks)
    d = d.withColumn("__ends", F.concat(F.array(zero), up_to(F.transform("__chunks", lambda c: F.element_at(c, -1)))))
    whole = F.flatten(F.zip_with("__chunks", F.slice("__ends", F.lit(1), F.size("__chunks")), lambda c, e: F.transform(c, lambda x: join(e, x))))
    return d.withColumn(out, F.coalesce(whole, none)).drop("__chunks", "__ends")


def _find(d: DataFrame, text: str, pattern: str, out: str, group: int = 0, least: int = 0) -> DataFrame:
    """Adds ``out``: array of (s, e, v) of the matches whose ``group`` has ``least`` characters."""
    p = F.lit(pattern)
    d = d.withColumn("__m", F.regexp_extract_all(text, p, F.lit(0)))
    d = d.withColumn("__v", F.regexp_extract_all(text, p, F.lit(group)) if group else F.col("__m"))
    # What lies between the matches gives their places.
    d = d.withColumn("__g", F.when(F.size("__m") > 0, F.transform(F.split(text, pattern, -1), F.length)))
    d = d.withColumn("__n", F.zip_with("__m", F.slice("__g", F.lit(1), F.size("__m")), lambda m, g: (g + F.length(m)).cast("long")))
    d = _running(d, "__n", "__to", lambda a, x: a + x)
    spans = F.transform(F.arrays_zip("__m", "__v", "__to"), lambda x: F.struct((x["__to"] - F.length(x["__m"])).cast("int").alias("s"), x["__to"].cast("int").alias("e"), x["__v"].alias("v")))
    spans = F.when(F.size("__m") > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))
    return d.withColumn(out, F.filter(spans, lambda x: F.length(x.v) >= least) if least else spans).drop("__m", "__v", "__g", "__n", "__to")


def _apart(d: DataFrame, runs: str, base: str) -> DataFrame:
    """Leaves in ``runs`` those that overlap no span of ``base``.

    In order of the runs' ends and the spans' starts, a run overlaps a span if
    the furthest end of the spans before it lies behind the run's start.
    """
    nothing = F.lit(None).cast("struct<s:int,e:int,v:string>")
    ends = F.transform(runs, lambda r: F.struct(r.e.alias("p"), F.lit(0).alias("o"), r.s.alias("s"), F.lit(0).cast("long").alias("to"), r.alias("r")))
    starts = F.transform(base, lambda b: F.struct(b.s.alias("p"), F.lit(1).alias("o"), F.lit(0).alias("s"), b.e.cast("long").alias("to"), nothing.alias("r")))
    d = d.withColumn("__e", F.when((F.size(runs) > 0) & (F.size(base) > 0), F.array_sort(F.concat(ends, starts))))
    d = d.withColumn("__to", F.transform("__e", lambda x: x.to))
    d = _running(d, "__to", "__far", lambda a, x: F.greatest(a, x))
    free = F.filter(F.arrays_zip("__e", "__far"), lambda x: (x["__e"].o == 0) & (x["__far"] <= x["__e"].s))
    free = F.array_sort(F.transform(free, lambda x: x["__e"].r))
    return d.withColumn(runs, F.when(F.col("__e").isNotNull(), free).otherwise(F.col(runs))).drop("__e", "__to", "__far")


@lru_cache(maxsize=1)
def uniform_tails() -> list[dict]:
    """Chance p that n uniform draws of k symbols have a sum of squared counts of s or more.

    Exact, by adding symbols one by one, for n from ``SHORT`` to ``EXACT``; only
    chances from 1e-9 to 0.5 have a row.
    """
    import numpy as np

    out, cap = [], 16 * EXACT
    log_fact = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, EXACT + 1))]))
    for k in sorted({len(a) for a in ALPHABETS.values()}):
        f = np.zeros((EXACT + 1, cap))
        f[0, 0] = 1
        for _ in range(k):
            g = np.zeros_like(f)
            # A symbol's count c weighs k^-c / c!; counts of 30 and more are beyond the cap.
            for c in range(30):
                g[c:, c * c :] += math.exp(-c * math.log(k) - log_fact[c]) * f[: EXACT + 1 - c, : cap - c * c]
            f = g
        for n in range(SHORT, EXACT + 1):
            p = f[n] * math.exp(log_fact[n])
            tail = np.concatenate([[1.0], 1 - np.cumsum(p)[:-1]])
            out += [{"k": k, "n": n, "s": int(s), "p": float(f"{tail[s]:.4g}")} for s in np.flatnonzero((p > 1e-12) & (tail > 1e-9) & (tail <= 0.5))]
    return out


def _phi(z: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(runs: DataFrame, value: str) -> DataFrame:
    """Adds encoding, n, p_random (Bonferroni over the tests) and p_text."""
    c = F.col
    spark = runs.sparkSession
    rows = F.from_json(F.lit(json.dumps(uniform_tails())), "array<struct<k:int,n:int,s:int,p:double>>")
    exact = F.broadcast(spark.range(1).select(F.explode(rows).alias("x")).select(F.col("x.k").alias("__tk"), F.col("x.n").alias("__tn"), F.col("x.s").alias("__ts"), F.col("x.p").alias("__tp")))
    v = F.rtrim(F.translate(value, "-_", "+/"), F.lit("="))
    d = runs.withColumn("__t", v).withColumn(
        "encoding",
        F.when(c("__t").rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hex").when(c("__t").rlike("^[A-Z2-7]+$"), "base32").when(c("__t").rlike("^[0-9a-z]+$"), "base36").when(c("__t").rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64"),
    )
    alphabet = F.lit("")
    for name, a in ALPHABETS.items():
        alphabet = F.when(c("encoding") == name, F.lit(a)).otherwise(alphabet)
    d = d.withColumn("__a", alphabet).withColumn("__t", F.when(c("encoding") == "hex", F.lower("__t")).otherwise(c("__t")))
    d = d.withColumn("__x", F.transform(F.filter(F.split("__t", ""), lambda x: x != ""), lambda x: (F.instr(c("__a"), x) - 1).cast("double")))
    d = d.withColumn("n", F.size("__x").cast("double")).withColumn("__k", F.length("__a").cast("double"))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, x: a + f(x))
    d = d.withColumn("__ss", total(F.array_distinct("__x"), lambda s: F.pow(F.size(F.filter("__x", lambda x: x == s)).cast("double"), F.lit(2.0))))
    d = d.withColumn("__mean", total(c("__x"), lambda x: x) / c("n"))
    d = d.withColumn("__high", F.transform("__x", lambda x: x >= c("__k") / 2))
    d = d.withColumn("__n1", F.size(F.filter("__high", lambda x: x)).cast("double")).withColumn("__n0", c("n") - c("__n1"))
    d = d.withColumn("__runs", 1 + F.size(F.filter(F.transform("__high", lambda x, i: (i > 0) & (x != F.get("__high", i - 1))), lambda x: x)))
    d = d.withColumn("__var", total(c("__x"), lambda x: (x - c("__mean")) * (x - c("__mean"))))
    d = d.withColumn("__cov", total(F.transform("__x", lambda x, i: F.when(i > 0, (x - c("__mean")) * (F.get("__x", i - 1) - c("__mean"))).otherwise(0.0)), lambda x: x))
    n, k = c("n"), c("__k")
    chi = k / n * c("__ss") - n
    # Longer runs: a gamma law of the same mean and variance, by its cube root.
    shape = (k - 1) * n / (2 * (n - 1))
    z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 1 / (9 * shape))) * F.sqrt(9 * shape)
    d = d.join(exact, (c("__tk") == k.cast("int")) & (c("__tn") == n.cast("int")) & (c("__ts") == c("__ss").cast("int")), "left")
    p_chi = F.when((n >= SHORT) & (n <= EXACT), F.coalesce(c("__tp"), F.when(chi > k - 1, 0.0).otherwise(1.0))).otherwise(1 - _phi(z_chi))
    mu = 2 * c("__n1") * c("__n0") / n + 1
    sd = F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
    z_runs = (c("__runs") - mu) / sd
    z_serial = F.when(c("__var") > 0, c("__cov") / c("__var") * F.sqrt(n)).otherwise(99.0)
    two = lambda z: 2 * _phi(-F.abs(z))
    d = d.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least(p_chi, two(z_runs), two(z_serial))))
    # Text of one alphabet: chance that two characters, or three, are the same.
    two_same = F.when(c("encoding") == "hex", 0.16).otherwise(0.066)
    three_same = F.when(c("encoding") == "hex", 0.033).otherwise(0.0055)
    mean_text = n + n * (n - 1) * two_same
    var_text = 4 * n * n * n * (three_same - two_same * two_same) + 2 * n * n * two_same
    return d.withColumn("p_text", _phi((c("__ss") - mean_text) / F.sqrt(var_text))).drop("__t", "__a", "__x", "__k", "__ss", "__mean", "__high", "__n1", "__n0", "__runs", "__var", "__cov", "__tk", "__tn", "__ts", "__tp")


def _length_class(n: Column) -> Column:
    return F.least(F.lit(LENGTH_CLASSES - 1), F.greatest(F.lit(0), F.floor(2 * F.log2(n / 20)))).cast("int")


def _bin(p: Column) -> Column:
    """Tenths of a decade, so that 10^(-bin/10) is at least p."""
    return F.floor(F.least(F.lit(float(BINS)), -10 * F.log10(F.greatest(p, F.lit(1e-9))))).cast("int")


def thresholds(runs: DataFrame, bins: str, fdr: float) -> list[int]:
    """Least bin that Benjamini-Hochberg accepts, by length class (BINS + 1: none)."""
    counts = runs.groupBy("length_class", F.col(bins).alias("bin")).count().collect()  # LENGTH_CLASSES x BINS rows at most
    out = []
    for lc in range(LENGTH_CLASSES):
        n = {r.bin: r["count"] for r in counts if r.length_class == lc}
        total, at, best = sum(n.values()), 0, BINS + 1
        for b in range(BINS, -1, -1):
            at += n.get(b, 0)
            if at and 10 ** (-b / 10) * total <= fdr * at:
                best = b
        out.append(best)
    return out


def scan_secrets(docs: DataFrame, text: str = "text", fdr: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """``docs`` without the text, with ``spans``: array of (s, kind number, e, kind).

    Columns of ``docs`` named base_spans or spans are replaced. Random runs that
    overlap a base span aren't added.
    """
    rest = [c for c in docs.columns if c not in (text, "base_spans", "spans")]
    d = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    d = _find(d, "__text", ASSIGN, "__assign", group=2, least=12)
    d = _find(d, "__text", ACCESS, "__access")
    d = _find(d, "__text", HEX, "__hex")
    d = _find(d, "__text", RUN, "__run")
    base = F.concat(*[_typed(f"__{k}", i, k) for i, k in enumerate(KINDS[:3])])
    d = d.select(*rest, F.array_sort(base).alias("__base"), F.col("__run"))
    d = _apart(d, "__run", "__base")
    d = materialize(d.withColumn("__row", F.monotonically_increasing_id()), "secrets-base")

    runs = battery(d.where(F.size("__run") > 0).select("__row", F.explode("__run").alias("r")).select("__row", "r.s", "r.e", "r.v"), "v")
    runs = runs.select("__row", "s", "e", _length_class(F.col("n")).alias("length_class"), _bin(F.col("p_random")).alias("random_bin"), _bin(F.col("p_text")).alias("text_bin"))
    runs = materialize(runs, "secrets-runs")
    at = lambda bins, q: F.get(F.array(*[F.lit(x) for x in thresholds(runs, bins, q)]), F.col("length_class"))
    found = runs.where((F.col("random_bin") < at("random_bin", alpha)) & (F.col("text_bin") >= at("text_bin", fdr)))
    found = found.groupBy("__row").agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e", F.lit("random").alias("kind"))).alias("__more"))
    d = d.join(found, "__row", "left")
    return d.select(*rest, F.col("__base").alias("base_spans"), F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")))).alias("spans"))


def _typed(column: str, i: int, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(x.s.alias("s"), F.lit(i).alias("k"), x.e.alias("e"), F.lit(kind).alias("kind")))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    d = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
