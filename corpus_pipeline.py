"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, in the columns
of documents; the last adds what the mix takes. Stages are written as Parquet and read again.

docs has doc_id, text, lang and source, and any other columns, which are carried through packed: their names cannot clash.
Decisions fall on rows by id, text and language, so rows of one id, and rows without an id, are each judged by their own text. A null text
counts as an empty one and stays null where the row is kept; very long texts are taken whole. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm import decontamination, mixing, near_dedup, quality_rules, substring_dedup
from lumenstack.llm.common import Workspace, table
from lumenstack.llm.near_dedup import text_key


KEYS = ("doc_id", "text_key", "lang")


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column, beside those that an operator reads: no name can clash."""
    return docs.select(F.struct("*").alias("packed_row"), "doc_id", "text", "lang", "source")


def _unpacked(rows: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of docs again, and more; one of docs that is named like one of those gets the prefix in_."""
    return rows.select(*(F.col("packed_row")[c].alias(f"in_{c}" if c in more else c) for c in docs.columns), *more)


def _chosen(docs: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """Rows of docs whose id, text key and so on, nulls being equal, are among keys; still packed."""
    rows = docs.select(F.struct("*").alias("packed_row"), *(text_key() if c == "text_key" else F.col(c) for c in by))
    return rows.alias("a").join(keys.alias("b"), reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by)), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Empty and null texts have under 50 words, and go; repeated rows share a verdict."""
    judged = quality_rules.judge(docs.select("doc_id", text_key(), "lang", "text"), keep=KEYS, fold=False)
    return _unpacked(_chosen(docs, judged.where("kept").select(*KEYS).distinct(), *KEYS), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8): the one of the smallest
    id, one text and one row of it, also where ids repeat or are null (which come last). Rows without words are no duplicates, and stay."""
    work = Workspace(spark, "near-stage")
    found = near_dedup.near_duplicates(docs, k=5, percent=80).where("chosen")
    keys = work.cut(found.groupBy("doc_id", "text_key").agg((F.count("*") * F.min("n_shingles").cast("boolean").cast("int") > 1).alias("again")), "keys")
    once = _chosen(docs, keys.where("not again"), "doc_id", "text_key")
    again = keys.where("again")
    if not again.isEmpty():
        once = once.union(_chosen(docs, again, "doc_id", "text_key").dropDuplicates(["doc_id", "text_key"]))
    return _unpacked(once, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated passages of 13 words or more are cut, but in the document of the smallest id that holds them.
    No row goes; a text of which nothing is left is empty. Rows without an id are left alone."""
    return substring_dedup.remove(docs, window=13)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Without items, and where there are no words, none does."""
    found = decontamination.matches(_packed(docs), table(spark, sf_dir, "benchmark"), window=10, keep=("packed_row",))
    return _unpacked(found.where(F.size("hit_words") == 0), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's size and target, and the words taken (repeats counted).
    Documents without words are never taken; a null source is one of its own; rows of one id and text share a decision."""
    return _unpacked(mixing.mix(_packed(docs), ("packed_row",)).where("taken > 0"), docs, *mixing.ADDED)


STAGES = [("quality", quality), ("near", near), ("passages", passages), ("leaks", leaks), ("mixture", mixture)]
#: The stages rest on a trained perplexity model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
        work.drop(*(f"{k - 1}-{before}" for before, _ in STAGES[k - 1 : k]))
    return docs
