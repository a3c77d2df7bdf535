"""From raw documents to token files: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, packed, table
from lattica.llm.decontamination import decontaminate
from lattica.llm.jaccard import jaccard_components
from lattica.llm.mixing import mix, mixed_rows
from lattica.llm.quality import quality_rules
from lattica.llm.tokenization import encode_and_read_back


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines; n_chars follows the text.

    Null and empty texts are rejected; repeated rows stay, each on its own.
    """
    q = quality_rules(packed(docs, "text", "source")).where("kept")
    changed = F.col("removed_words") > 0
    doc = {c: F.col(f"__doc.{c}") for c in docs.columns}
    doc["text"] = F.col("cleaned")
    if "n_chars" in doc:
        doc["n_chars"] = F.when(changed, F.length("cleaned")).otherwise(doc["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return q.select(*[x.alias(c) for c, x in doc.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row with the least id, then the least hash.

    A row is known by the hash of its columns, so rows of one id with different
    texts, and rows without an id, are rows of their own; rows alike in all
    columns are one. Texts without words link with nothing and stay.
    """
    rows = docs.withColumn("__key", F.xxhash64(*docs.columns))
    c = jaccard_components(rows.select("__key", "text"), key="__key").select("__key", "component_id").distinct()
    ids = rows.select(F.col("__key").alias("__k"), F.struct(F.col("doc_id").isNull(), "doc_id", "__key").alias("__o"))
    least = c.join(ids, F.col("__key") == F.col("__k")).groupBy("component_id").agg(F.min("__o").alias("__o")).select(F.col("__o.__key").alias("__k"))
    stay = rows.join(least.hint("shuffle_hash"), F.col("__key") == F.col("__k"), "left_semi")
    return stay.dropDuplicates(["__key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are alike."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, by shard and shuffled inside it.

    Texts without words are never taken; rows that are alike are taken alike.
    """
    m = mix(packed(docs, "doc_id", "source", "text"))
    return mixed_rows(m, ["__doc"]).select("__doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold: a row for each document of the mix, repeats and null ids too."""
    return encode_and_read_back(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", token_output),
]

#: Neither the sketches' hashes nor the tokenizer can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
