"""Corpus pipeline: five stages, each an operator of quarrylight.llm whose decisions take effect on what the stage before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. run() writes each
result as Parquet to the shared folder and reads it again as the next stage's docs.

Each row is a document of its own, also where rows share an id or have none: stages decide by a row key, in the order of ids
(null last, then by text). Null texts pass all stages (no quality to see in them but a zero byte's, no lines, no shingles, no
words) unless the classifier rejects them; empty tables pass as empty tables. Extra columns pass, whatever their names.

A stage's result is to be written before the next stage begins, as run() does: each stage deletes the intermediate tables of
the stages before it, but for those that its docs are read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Bitmap, delete, documents, drop, fresh, made_in, materialize, read_table, settle
from quarrylight.llm.op1_mixing import mix
from quarrylight.llm.op2_quality import keep_good
from quarrylight.llm.op7_ngram_join import ngram_join
from quarrylight.llm.op9_line_dedup import dedup_documents
from quarrylight.llm.op10_decontamination import decontaminate


#: Paths of intermediate tables of earlier stages.
_left: list[str] = []


def stage(f: Callable) -> Callable:
    """Drops what earlier stages have left, and notes what this one makes."""

    @wraps(f)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for path in [x for x in _left if not any(x.rpartition("/")[2] in file for file in read)]:
            delete(spark, path)
            _left.remove(path)
        settle(spark)
        with made_in() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return work


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the column that is the key of a row: the id where every row has its own, otherwise a new one, numbers in the order of ids."""
    given = F.col("doc_id").cast("long")
    if docs.groupBy(given.alias("doc_id")).count().where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    # ranges of ids, texts and places, so that rows of one id, or of one text, need not be in one task
    row, text, place = (fresh(docs, c) for c in ("_row", "_hash", "_place"))
    order = [F.col(row).asc_nulls_last(), F.col(text).asc(), F.col(place).asc()]
    placed = materialize(docs.withColumns({row: given, text: F.xxhash64("text"), place: F.monotonically_increasing_id()}), "pipeline-placed")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    out = materialize(dealt.withColumn(row, F.monotonically_increasing_id()).select(*docs.columns, row), "pipeline-rows")
    drop(placed)
    return out, row


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs but for those whose key is in gone; only those that may be are shuffled with their texts."""
    may = Bitmap(gone, key, bits=64).has(key)
    return docs.where(~may).unionByName(docs.where(may).join(gone, key, "left_anti"))


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go, and documents that had words and have none left; n_chars follows the text."""
    keyed, key = with_row_key(docs)
    lines, removed = fresh(keyed, "_lines"), fresh(keyed, "_removed")
    out = dedup_documents(keyed, id_col=key, n_lines=lines, n_removed=removed)
    left = (F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.where(left).withColumn("n_chars", chars).select(*docs.columns)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.8 of their five-word shingles, the one with the least row key stays."""
    keyed, key = with_row_key(docs)
    gone = materialize(ngram_join(keyed, shingle=5, num=8, den=10, id_col=key).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "pipeline-gone")
    return without(keyed, gone, key).select(*docs.columns)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which benchmark windows cover a twentieth or more."""
    keyed, key = with_row_key(docs)
    gone = decontaminate(keyed, read_table(spark, sf_dir, "benchmark"), id_col=key).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return without(keyed, materialize(gone, "pipeline-gone"), key).select(*docs.columns)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that sources meet their target weights."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, f) in enumerate(STAGES, 1):
        given, docs = docs, materialize(f(spark, docs, sf_dir), f"pipeline-{i}")
        if i > 1:
            drop(given)
    return docs
