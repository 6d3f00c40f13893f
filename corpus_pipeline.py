"""A corpus from raw documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.llm.mixing import mix_texts
from axisflow.llm.packing import pack_by_retrieval
from axisflow.llm.pii import fit_candidates, redact_pii
from axisflow.llm.shared import small_batches, written
from axisflow.llm.shingle_join import similarity_classes
from axisflow.llm.toxicity import fit_toxicity, held_out, score_toxicity


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table that is written in small Arrow batches: whole documents take much memory in large ones."""
    with small_batches(df.sparkSession):
        return written(df, label)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.5; its words are learned from `labels`, as in the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col="_axisflow_score")
    return settled(scored.filter("_axisflow_score < 0.5").select(docs.columns), "clean")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word shingles at 0.8 connect, the one of the smallest id.

    Rows that share an id count as one document. Rows without an id go if their text equals that of a
    document with one, and stay once for each text otherwise.
    """
    classes = written(similarity_classes(docs), "classes")
    first = classes.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return kept
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.filter("doc_id is not null").select(F.sha2(text, 256).alias("_axisflow_text"))
    nameless = nameless.withColumn("_axisflow_text", F.sha2(text, 256)).join(known, "_axisflow_text", "left_anti").dropDuplicates(["_axisflow_text"])
    return kept.unionByName(nameless.select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; n_chars is that of the new text."""
    out = redact_pii(docs, fit_candidates(spark, docs))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix's blocks, by document and pass; n_chars is that of the words taken.

    Documents without words have nothing to take and go; an empty table stays empty.
    """
    out = settled(mix_texts(docs.withColumn("_axisflow_row", F.xxhash64(*docs.columns)), "_axisflow_row").select(docs.columns), "mixed")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_by_retrieval(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("pii", redact_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: Learning, the similarity join, the mix and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
