"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of docs, whatever others there are and however they are named; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import checkpoint_dir, read_table
from lociweave.llm.decontaminate import mark_contamination
from lociweave.llm.line_dedup import dedup_lines
from lociweave.llm.near_dedup import near_duplicates
from lociweave.llm.packing import pack_documents
from lociweave.llm.quality_classifier import fit, score_quality


def _with(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage over docs whose columns besides doc_id and text stand aside, so that no name clashes with those that the operator adds."""
    own = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = stage(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in own.items()]))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of docs, predicts as label 1.

    Null, empty and wordless texts have the labels' share of 1 as score and so stay if that reaches the threshold; repeated rows get one decision.
    """
    labels = read_table(spark, sf_dir, "labels")
    return _with(docs, lambda d: score_quality(d, fit(d, labels)).filter("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three documents or more share, but in the last document that has them; n_chars follows the text.

    All documents stay, a null text as an empty one; rows with one doc_id count as one document.
    """
    out = _with(docs, dedup_lines)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Null, empty and wordless texts are in no group; rows with the doc_id that stays all stay, as does a null doc_id.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and wordless texts have none and stay."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return _with(docs, lambda d: mark_contamination(d, benchmark).filter(~F.col("contaminated")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences with their token ids; a null text is the end id alone, repeated rows are packed each."""
    return pack_documents(docs, added_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: Learnt scores and token ids can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result but the last is written to the shared folder and read again.

    What a stage has read is deleted when its own result is written, but for the last one's, which the caller still reads.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", ""
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(at := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(at)
            if before:
                _delete(spark, before)
            before = at
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
