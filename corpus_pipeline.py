"""Documents to packed training sequences in five stages, each an operator of ``newsloom.llm``.

A stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a DataFrame; all but the last
return the columns they got, in that order, whatever further columns there are. Results are written as Parquet and read
again between stages, and what a stage has stored on the way is deleted before the next begins.

* Rows with a null doc_id go through every stage, but are never anyone's near copy nor removed as contaminated.
* Null, empty and blank texts fail the quality rules and go. Very long texts are worked on whole in every stage.
* Repeated rows and ties: of near copies the least doc_id stays, and one row of those that are equal in doc_id and text.
* An empty table gives an empty table. Columns may have any names, those of results and names with dots included.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import quoted, scratch, stored, table
from newsloom.llm.decontam import decontaminate
from newsloom.llm.line_rules import quality_rules
from newsloom.llm.minhash import near_duplicates
from newsloom.llm.packing import pack
from newsloom.llm.suffix import remove_repeated_bytes


def _others(docs: DataFrame) -> Column:
    """All columns of ``docs`` but the text, as the struct ``row``, so that a row holds its text once."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("row")


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, with another text and its length in n_chars."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns]


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that fail the base limits or lost too much. Null and empty texts go."""
    judged = quality_rules(docs.select(_others(docs), "text"), carry_text=False).where("kept")
    return judged.select(*_with_text(docs, F.col("clean_text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; of rows that are equal in id and text, one."""
    classes = near_duplicates(docs.select("doc_id", "text"))
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    if not kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(*map(quoted, docs.columns)).union(docs.where("doc_id IS NULL"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go; a character stays unless all its bytes go. Documents of which no word is left go."""
    cut = remove_repeated_bytes(docs, carry=True).where("n_removed = 0 OR kept_text RLIKE '[^ \\t-\\r]'")
    return cut.select(*_with_text(docs, F.col("kept_text")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", clean_lines),
    ("near_duplicates", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]
#: Near copies (connected groups), spaced seeds and the tokenizer can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            docs = stored(out, keep=True) if k < len(STAGES) else out
    return docs
