"""From raw documents to a mixed training corpus, in five stages.

Each stage takes all documents that the stage before kept. The first three leave
documents out, the fourth replaces secrets in the texts, and the last deals out
copies by source. All but the last return the documents' own columns.

Defined results. Null texts count as empty; extra columns pass through every stage,
also if they are named like one that an operator adds (the last stage's own columns
replace such ones). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import decontamination, mixing, quality_classifier, secret_scan, simhash
from tenure.llm.columns import table
from tenure.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns beside ``_row``, which holds all of a document's columns."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *used)


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    labels = table(spark, sf_dir, "labels")
    found = quality_classifier.classify(_packed(docs, "doc_id", "text"), labels)
    return _unpacked(found.filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` brought up to date."""
    found = secret_scan.scan_secrets(_packed(docs, "text"))
    changed = F.col("found.redacted")
    new = {"text": F.coalesce(changed, F.col("_row.text"))}
    if "n_chars" in docs.columns:
        length = F.length(changed).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.coalesce(length, F.col("_row.n_chars"))
    return found.select(
        *(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns)
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes, numbered by ``copy``."""
    taken = mixing.mix_sources(docs).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", secrets),
    ("source_mix", mixed),
]

#: SQL has no form for fingerprints, alignments and trained models; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = f"{folder}/{number}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
