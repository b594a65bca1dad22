"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

toxicity (texts that score 0.5 or more go), near duplicates (one document of each component
stays), benchmark decontamination (documents that hold a benchmark window go), personal data
(every span becomes its kind in angle brackets), packing (pieces of sequences).

Defined results: a null or empty text has no words, is scored like any text, is nobody's near
duplicate, holds no passage and no span, stays null or empty, and packs as its end id alone; a null
doc_id is a value like any other; of equal rows near duplicates keep one; equal ids with
different texts are documents of their own; extra columns of any name travel through all stages
but the last; an empty table gives no rows, and without labels of both classes no document is
rejected for toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import decontam, jaccard, packing, pii, toxicity
from riskspark.llm.common import Staging, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, read_table(spark, sf_dir, "labels"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_documents(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    places, _ = packing.pack(spark, docs, packing.word_bpe())
    return places


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Networks, components and packing are beyond SQL; ``tests/llm/test_pipeline_run.py`` holds run(), stage
#: by stage, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = stage.write(apply(spark, docs, sf_dir), f"{k}-{name}")
    return docs
