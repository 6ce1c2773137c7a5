"""The corpus pipeline: five stages from raw documents to encoded ones.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chosen_path, decontaminate, line_templates, pieces, toxicity
from waymark.llm.queries import PIECES, fold_of, gold_of, notes_of
from waymark.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span model does not predict to be toxic. It learns from the labelled documents of ``docs`` outside fold 0."""
    learn = _table(spark, sf_dir, "labels").filter(fold_of("doc_id") != 0).select(F.col("doc_id").alias("record_id"), F.col("toxic").alias("abusive"))
    scored = toxicity.score_notes(notes_of(docs), learn)
    bad = scored.filter("predicted = 1").select(F.col("record_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == F.col("_bad"), "left_anti")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates beyond each template's first document; ``n_chars`` follows the text."""
    r = line_templates.drop_recurring_lines(docs, "doc_id", "text")
    new = {"n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return r.withColumns(new).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id. Documents with a null id stay; repeated rows become one."""
    linked = chosen_path.linked_notes(notes_of(docs))
    first = linked.filter("record_id is null or record_id = class_id").select(F.col("record_id").alias("_first")).distinct()
    kept = docs.filter("doc_id is not null").join(first, docs["doc_id"] == F.col("_first"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null"))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, gold_of(_table(spark, sf_dir, "benchmark")), "doc_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drawn segmentations of each document: doc_id, n_pieces, log_prob, pieces and the text they decode to, and its other draws with theirs."""
    drawn = pieces.sample_segmentations(docs, PIECES, "doc_id", "text", decoded="text", gathered="others")
    return drawn.select(F.col("record_id").alias("doc_id"), "n_pieces", "log_prob", "pieces", "text", "others")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_leaked),
    ("sentencepiece encoding", encode),
]

# Learned scores and sampled segmentations have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
