"""From documents to a training mix: five stages, each of which works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of documents.

Null and empty texts pass as empty ones: they are not toxic, are copies of each
other, hold no repeat and no benchmark item.  Rows that repeat an id and its text are
one document from the second stage on; rows without an id are judged but never
dropped as copies.  Without labels nothing is toxic, without documents every stage is
empty.  Further columns are carried, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seclake.llm import decontamination, mixing, simhash, suffix_dedup, toxicity
from seclake.llm.common import remove, shared_folder, shuffles_removed
from seclake.llm.queries import ranked_weights, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, located=False).where("predicted = 0").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked by SimHash fingerprints or by five-word shingles of similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, least=0.8, shingle=5, linked=simhash.near_duplicates(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document with a smaller id has, too."""
    return suffix_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold four fifths of a benchmark item's five-word shingles."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every copy that the mix takes of a document, with its source's target."""
    return mixing.repeat(mixing.mix(docs, ranked_weights(docs), max_epochs=3.0))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what is between them lies in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
