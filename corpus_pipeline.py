"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import delete, scratch, shared_dir, table
from sieveline.llm.exact_dedup import distinct_documents
from sieveline.llm.minhash import one_of_each
from sieveline.llm.packing import pack
from sieveline.llm.substring_dedup import remove_repeats
from sieveline.llm.toxicity import scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows with a null id stay, unless rejected."""
    # names of their own, as any column of docs may be called like one of the result
    own = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", own["doc_id"])
    told = scores(docs.toDF(*own.values()), labels, id_col=own["doc_id"], text_col=own["text"], lang_col=own["lang"], carry=list(own.values()))
    return told.where(F.col("predicted") == 0).select(*[F.col(x).alias(c) for c, x in own.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 13 words and more of earlier documents are cut out.  A text
    without repeats stays as it is; a text of repeats alone goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, carry=["text", *others], stable=True)
    kept = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = kept.withColumn("text", text)
    if "n_chars" in others:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py
#: compares each stage and the run with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder.  What a stage
    settled, and the result that it read, are deleted once its own is written."""
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            delete(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
