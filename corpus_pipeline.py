"""A corpus run over ``documents``: filters, deduplication, redaction and packing.

Every stage takes all rows that the one before it kept and is written as
Parquet into the shared folder before the next one reads it. All columns of
``documents`` go through, whatever others there are; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.llm import queries
from inundata.llm.exact_dedup import exact_duplicates
from inundata.llm.near_dedup import near_duplicates
from inundata.llm.packing import pack
from inundata.llm.secret_scan import redact
from inundata.llm.toxicity import drop_toxic
from inundata.storage import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic. Null text counts as empty; repeated rows stay or go together; without labels of both kinds all stay."""
    return drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of the largest doc_id, even if several rows repeat it."""
    rows = Scratch(spark).keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    kept = exact_duplicates(rows, row_id="_row").where("kept").select("_row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the smallest doc_id. Wordless and null texts and rows without doc_id stay."""
    dropped = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark. Null text stays null."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; null or empty texts are an end id alone, repeated rows are packed each for itself."""
    return pack(docs, queries.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Several stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    with scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
