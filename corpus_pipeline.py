"""The corpus pipeline: rules, near-dedup, secrets, mixing, packing.

``STAGES`` lists (name, function) pairs. Each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame; every result is written as
Parquet under the shared checkpoint folder and read back as the next stage's
``docs``, so a lost executor costs a re-read of a written table and never a
rerun of earlier stages. All stages but the last return the columns of
``documents``.

Defined cases are those of the operators: a null or empty text has no words, so the
rules drop it; rows that repeat id and text are one document; rows with a null
id or source stay rows of their own; ties (of classes, spans and draws) are
broken by the operators' rules; very long texts are taken whole, and cut into
pieces by packing only; extra columns pass through to the last stage, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from panelcast.llm.common import table
from panelcast.session import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the production policy of the rule ledger rejects."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each class of near duplicates."""
    return near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret that the blob ledger holds for a text; all documents stay."""
    _, ledger = secret_scan.scan(docs, secret_scan.session_ledger(spark))
    return secret_scan.redact(docs, ledger)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample the documents to their sources' targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packing.query(spark, docs)


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Minhash darts, seeded sampling and the tokenizer are beyond SQL.
ORACLE_SQL = None
