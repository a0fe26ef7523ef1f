"""From raw documents to packed training sequences.

Stages: a quality classifier, line dedup, MinHash near-dedup, benchmark
decontamination and packing.  Each takes ``(spark, docs, sf_dir)``; all but the last
return the columns of ``documents``.  ``run`` writes what a stage returns as Parquet in
the shared folder and reads it again for the next one, so that no stage depends on the
work of another once that has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, line_dedup, minhash_dedup, packing, quality_model
from loomline.llm.common import read_table, work_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject.

    Null texts and texts without words go; null ids, repeated rows and long texts are
    scored like any; without enough labels all texts with words stay; no documents give
    none.  Columns of any name are kept.
    """
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents of which nothing is left go, as the first that had those lines keeps them.

    Null and empty texts stay; rows with a null id keep no recurring line; repeated rows
    are copies, which make no line recurrent; long texts are read whole; no documents
    give none; n_chars is that of the new text.
    """
    cleaned = line_dedup.drop_recurring(docs).where(F.col("text").rlike(r"\S") | (F.col("n_dropped") == 0))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more of five-word shingles.

    The smallest id stays; texts without words all stay; rows with null or repeated ids
    are judged each by its own text; long texts are read whole; no documents give none.
    """
    return minhash_dedup.keep_one(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of ``benchmark``, and not contaminated by shorter items.

    Null and empty texts stay, null item ids count, rows are judged each by its own
    text, long texts are read whole; no documents, or no items, are no fault.
    """
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 ids.

    A null or empty text is the closing id alone; repeated rows are packed each for
    itself, null ids are kept, long texts are cut whole; no documents give no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: The classifier, the templates and the tokenizer can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
