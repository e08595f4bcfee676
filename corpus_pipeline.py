"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``documents``.

1. quality rules: documents that fail the base rules or whose posterior quality is below 0.5 go.
2. line dedup: lines that occur, equal or within two edits, in an earlier document go; n_chars follows
   the text; a document of which no word is left goes.
3. near duplicates: the document with the smallest id of each class stays.
4. decontamination: documents with 5 % of their words, or more, in benchmark passages go.
5. packing: pieces of documents in sequences of 2048 tokens.

Every stage takes null ids, null, empty and very long texts, repeated rows, empty tables and further columns; its docstring
says what becomes of them. All but the last return the columns they get, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import decontam, line_dedup, minhash, packing, quality
from lakewright.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null, empty and short texts go; repeated rows and rows without an id are judged alike,
    each by its text; a very long text is judged whole. No documents give none."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay. Null and empty texts stay as they are; of texts that share an id each keeps its own
    lines, and rows without an id come last; a document that loses lines and keeps no word goes. No documents give none."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("__n_removed") == 0) | F.col("text").rlike(r"\S")
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else out[c] for c in docs.columns]
    return out.where(left).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id (of equal ids the one with the smallest hash); repeated rows are one.
    Texts without words, null ones included, all stay. No documents give none."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. Texts without words stay; repeated rows share a verdict. Without items all stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents. A null or empty text is its end mark alone; a long one spans sequences; rows without an id, and
    repeated ones, are packed like any other. No documents give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the quality rules' expectation-maximisation or the tokenizer; tests/llm/test_pipeline.py holds each stage
#: against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
