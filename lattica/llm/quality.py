"""Quality rules with cross-document line frequency (built-in functions only).

Rules on one text
    too few words; too many words inside 8-word windows that the text repeats.
Rule across documents
    Lines are normalised (lower case, digits to 0, white space to one blank)
    and hashed; per host the documents that hold a line are counted, each once,
    and the line's contexts (the lines on either side). A line is boilerplate if
    more than ``min_line_docs`` documents of the host hold it, whatever the
    host's size, in more than half as many contexts. The contexts tell a
    line that is put into many documents from one of a document that is copied
    many times, whose neighbours recur with it; copies are for the near-duplicate
    operators. Boilerplate is removed (``cleaned``). A document is depleted, and
    rejected, if less than ``min_words`` words or less than ``min_left`` of its
    words are left.

Nulls and empty texts have no words and are rejected. A null host is a host of
its own. Repeated rows count as documents of their own. Very long texts are read
whole; sorting them takes memory of a few times one text. Counts at a limit
(ties) don't exceed it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, WS, materialize, table, without, words

#: Boilerplate lines, of all hosts and of one, up to which hosts' lists are broadcast.
MAX_BROADCAST_LINES = 200_000
MAX_HOST_LINES = 2_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d", "0"), WS, " "))


def with_repeated_words(d: DataFrame, w: str, out: str, window: int = 8) -> DataFrame:
    """Adds the number of words of ``w`` inside windows that occur twice or more.

    Each step is a column of its own: inside a lambda an array expression would
    be evaluated again for each element.
    """
    ok = F.size(w) >= window
    d = d.withColumn("__h", F.when(ok, F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))))
    # Few texts repeat a window; only they pay for the sort.
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("__s", j).h == x.h, F.lit(False))
    d = d.withColumn("__p", F.array_sort(F.transform(F.filter("__s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.i)))
    steps = F.transform("__p", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("__p", k + 1) - x, F.lit(window))))
    return d.withColumn(out, F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def text_features(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__w", words(F.col(text)))
    d = with_repeated_words(d, "__w", "__r", window)
    lines = _lines(F.col(text))
    return d.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("__r").alias("n_repeat_words"),
    )


def boilerplate(docs: DataFrame, host: str, text: str, min_line_docs: int) -> DataFrame:
    """(__host, __line): hashes of the normalised lines that are boilerplate in a host."""
    d = docs.select(F.col(host).alias("__host"), F.transform(_lines(F.col(text)), lambda x: F.xxhash64(_normal(x))).alias("__l"))
    at = lambda i: F.coalesce(F.get("__l", i), F.lit(0).cast("long"))
    # Each line of a document once without a context, for the number of documents, and once with each.
    once = F.transform(F.array_distinct("__l"), lambda x: F.struct(x.alias("l"), F.lit(None).cast("long").alias("c")))
    every = F.transform("__l", lambda x, i: F.struct(x.alias("l"), F.xxhash64(at(i - 1), at(i + 1)).alias("c")))
    n = d.select("__host", F.explode(F.concat(once, every)).alias("x")).groupBy("__host", "x.l", "x.c").agg(F.count(F.lit(1)).alias("n"))
    # The pair (host, line) of a hot line has as many rows here as contexts; they are summed before they are dealt.
    n = n.groupBy("__host", F.col("l").alias("__line")).agg(F.max(F.when(F.col("c").isNull(), F.col("n"))).alias("docs"), F.count("c").alias("contexts"))
    return n.where((F.col("docs") > min_line_docs) & (2 * F.col("contexts") > F.col("docs"))).select("__host", "__line")


def _with_hits(d: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """Adds ``__hit``: the hashes of the boilerplate lines that a document holds (null: none)."""
    size = bad.groupBy("__host").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hashes = F.transform("__lines", lambda x: x.h)
    if size[0] <= MAX_BROADCAST_LINES and size[1] <= MAX_HOST_LINES:
        lists = F.broadcast(bad.groupBy("__host").agg(F.collect_list("__line").alias("__bad")))
        j = d.join(lists, d[host].eqNullSafe(lists["__host"]), "left")
        return j.withColumn("__hit", F.when(F.col("__bad").isNotNull(), F.array_intersect(hashes, F.col("__bad")))).drop("__bad", "__host")
    # Lists too long to broadcast: lines meet them one by one, and go back by the text's hash.
    d = d.withColumn("__key", F.xxhash64(F.col(host), F.col(text)))
    lines = d.select(F.col(host).alias("__h"), "__key", F.explode(F.array_distinct(hashes)).alias("__x"))
    hits = lines.join(bad, F.col("__h").eqNullSafe(F.col("__host")) & (F.col("__x") == F.col("__line")))
    hits = hits.groupBy(F.col("__key").alias("__k")).agg(F.collect_set("__x").alias("__hit"))
    return d.join(hits, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 20, max_repeat_pct: int = 30, min_line_docs: int = 20, min_left: float = 0.5, window: int = 8) -> DataFrame:
    """``docs`` with the features, ``removed_words``, ``base_failed``, ``kept``, ``cleaned``.

    ``cleaned`` is the text without boilerplate lines. Columns of ``docs`` that
    are named as those added are replaced.
    """
    docs = without(docs, *FEATURES, "removed_words", "base_failed", "kept", "cleaned")
    f = text_features(docs.withColumn("__lines", F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), x.alias("x")))), text, window)
    bad = materialize(boilerplate(docs, host, text, min_line_docs), "lines")
    j = _with_hits(f, bad, host, text)
    gone = F.filter("__lines", lambda x: F.array_contains("__hit", x.h))
    j = j.withColumn("__gone", F.when(F.size("__hit") > 0, F.transform(gone, lambda x: x.x)))
    j = j.withColumn("removed_words", F.coalesce(F.aggregate("__gone", F.lit(0), lambda a, x: a + F.size(words(x))), F.lit(0)).cast("long"))
    cleaned = F.when(F.col("removed_words") > 0, F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("__gone", x)), "\n")).otherwise(F.col(text))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < min_words) | (left < min_left * F.col("n_words"))
    # Not deterministic to the optimizer: else a filter on ``kept`` would be moved
    # below and drag copies of all the array expressions with it.
    fence = F.monotonically_increasing_id() >= 0
    j = j.withColumn("cleaned", cleaned).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted & fence)
    return j.drop("__lines", "__hit", "__gone")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS c FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM dup) GROUP BY r),
l0 AS (SELECT r, source, i, x, trim(regexp_replace(regexp_replace(lower(x), '\d', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM (SELECT r, source, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM w)),
l AS (SELECT *, coalesce(lag(k) OVER p, '') || chr(10) || coalesce(lead(k) OVER p, '') AS c FROM l0 WINDOW p AS (PARTITION BY r ORDER BY i)),
bad AS (SELECT source, k FROM l GROUP BY source, k HAVING count(DISTINCT r) > 20 AND 2 * count(DISTINCT c) > count(DISTINCT r)),
rem AS (SELECT l.r, sum(len(list_filter(regexp_split_to_array(l.x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS c FROM l JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k GROUP BY l.r),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.c, 0)::BIGINT AS n_repeat_words, coalesce(rem.c, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN rem ON w.r = rem.r),
g AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_words - removed_words AS lft FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND lft >= 20 AND lft >= 0.5 * n_words) AS kept, removed_words FROM g
"""
