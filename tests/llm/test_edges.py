"""Nulls, empty and long texts, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from lattica.llm import attention, decontamination, jaccard, language, mixing, quality, secrets, substrings, tokenization, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "the idiot said that he is not here and nobody else was there either today", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "de", "b", 4),
    (5, LONG, "en", "b", 1),
    (6, "the idiot said that he is not here and nobody else was there either today", "en", "a", 1),
    (6, "the idiot said that he is not here and nobody else was there either today", "en", "a", 1),
    (None, "no id here but some words to read in any case", "en", None, 3),
    (8, "日本語 テスト 🙂 ß É", "ja", "c", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a benchmark item of some length that nobody has"), (2, None), (3, ""), (4, "x")], "item_id long, text string")


CLASH = ["score", "predicted", "lang_pred", "size", "target", "draws", "kept", "n_words", "spans", "base_spans", "n_tokens", "ids", "cleaned", "removed_words", "n_clauses", "source_size", "n", "node", "k", "t"]

OPS = {
    "toxicity": lambda s, d, b: toxicity.toxicity(d, *toxicity.learn_grammar(d, d.select("doc_id", F.lit(1).alias("toxic")))),
    "lm": lambda s, d, b: attention.lm_scores(d.withColumn("__train", F.lit(True)), "__train"),
    "secrets": lambda s, d, b: secrets.scan_secrets(d),
    "quality": lambda s, d, b: quality.quality_rules(d),
    "mixing": lambda s, d, b: mixing.mix(d),
    "decontaminate": lambda s, d, b: decontamination.decontaminate(d, b),
    "tokens": lambda s, d, b: tokenization.encode_and_read_back(d),
    "jaccard": lambda s, d, b: jaccard.jaccard_components(d),
    "language": lambda s, d, b: language.predict_language(d, language.fit_prototypes(d)),
}


@pytest.mark.parametrize("op", OPS)
def test_rows_stay_whole(spark, docs, bench, op):
    extra = docs.withColumns({c: F.lit(7) for c in CLASH})
    out = OPS[op](spark, extra, bench)
    assert len(out.columns) == len(set(out.columns))
    assert out.count() == len(ROWS)


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, docs, bench, op):
    assert OPS[op](spark, docs.limit(0), bench).count() == 0


def test_substrings_and_leaks_on_edges(spark, docs, bench):
    assert substrings.repeated_passages(docs).count() == 0
    assert substrings.repeated_passages(docs.limit(0)).count() == 0
    assert decontamination.find_leaks(docs, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_defined_results(spark, docs, bench):
    q = {(r.doc_id, r.n_words, r.kept) for r in quality.quality_rules(docs).collect()}
    assert {(2, 0, False), (4, 0, False), (5, 20_000, True)} <= q
    j = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert {(1, 11, 1), (2, 0, 2), (3, 0, 3), (6, 11, 1), (8, 1, 8), (None, 7, None)} <= j
    lang = {(r.doc_id, r.lang_pred) for r in language.predict_language(docs, language.fit_prototypes(docs)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "ja")} <= lang
    m = {(r.doc_id, r.size, len(r.draws)) for r in mixing.mix(docs).collect()}
    assert {(2, 0, 0), (3, 0, 0)} <= m and all(n <= 2 for _, _, n in m)
