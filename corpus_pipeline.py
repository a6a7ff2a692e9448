"""A corpus made ready for training: four stages, each on all that the one before kept.

Toxic documents go, then those in no language the corpus teaches, then all but one
of each group of near copies; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import language_filters, lsh_forest, residual_packing, toxicity_chain
from salesmart.llm.shared import shared_folder, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Categories in the order of the chain; documents toxic by the last one go.
CATEGORIES = ["quality", "toxic"]

#: The near-copy stage is op6 and takes its shingles; longer ones drop fewer texts.
SHINGLE_WORDS = 2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity_chain.fit(docs, labels, CATEGORIES, shared_folder(spark, "stage-toxicity"))
    # Under plain names, so that no column of the documents has the name of a probability.
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    told = chain.predict(docs.toDF(*plain.values()), text=plain["text"])
    return told.where(~toxicity_chain.toxic()).select(*plain.values()).toDF(*plain)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those with far fewer n-grams of their best language
    than its training documents; a corpus without language labels can teach none, and is kept."""
    model = language_filters.fit(docs)
    if not model.languages:
        return docs
    return language_filters.in_known_language(docs, model, language_filters.usual_rates(docs, model))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, longer where the documents have a column of that name."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group, and all rows without a doc_id.

    Rows are documents of their own, also where a doc_id repeats: then numbers in the
    order of doc_id (and of a hash of the text, and of the row) tell them apart.
    """
    folder = shared_folder(spark, "stage-near-copies")
    named, key = docs.where("doc_id is not null"), "doc_id"
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        key, tie = _unused(docs, "row"), _unused(docs, "tie")
        order = ["doc_id", F.xxhash64("text"), tie]
        rows = named.withColumn(tie, F.monotonically_increasing_id())
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
        named = written(rows.withColumn(key, F.monotonically_increasing_id()), f"{folder}/rows")
    found = lsh_forest.near_duplicates(named, f"{folder}/groups", key=key, words=SHINGLE_WORDS)
    kept_key = _unused(named, "kept")
    kept = found.where("kept").select(F.col("doc_id").alias(kept_key))
    one_each = named.join(kept, F.col(key) == F.col(kept_key), "left_semi").select(*docs.columns)
    return one_each.unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stage-packing")
    cut = written(residual_packing.pieces(docs, TOKENIZER), f"{folder}/pieces")
    return residual_packing.pack(cut, folder)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near copies", drop_near_copies),
    ("packing", pack),
]

#: SQL has neither the classifiers nor the hashes nor the tokenizer; the tests
#: compare the result with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
