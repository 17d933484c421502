"""The corpus pipeline: documents through rules, classifier, near-duplicates and mixing to packed sequences.

Null and empty texts fail the rules. Null languages and sources are groups of their own; a null id stays, linked with
nothing. Rows of one id go or stay together. Ties are settled by id. Without rows every stage's result is empty. Stages
hand on all columns of documents, whatever their names, and read only doc_id, text, lang and source, and of labels doc_id and quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import classifier, jaccard, mixing, packing, quality_rules
from tesselith.llm.common import written
from tesselith.llm.queries import tokenizer_path
from tesselith.sources.tables import table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, 5, 80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences follow the order of the mix, which is that of the mixing stage's files and of the rows in them."""
    return packing.packed(in_file_order(docs), tokenizer_path("byte_bpe_50k.json"))


def in_file_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) by name of file and place of row, in contiguous partitions; docs in any order if they come from no file."""
    if not docs.inputFiles():
        return docs
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return d.repartitionByRange(n, "file", "row").sortWithinPartitions("file", "row")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Sketches, the classifier and the packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
