"""The queries of this subpackage, registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.line_dedup import dedup_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.quality_classifier import fit, held_out, score_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.decontaminate import mark_contamination

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False, added_tokens=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.html_extract import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.pii import KEY, KEY_SETTING, mask_documents

    # the tables are made up, so the key for tests will do where the session has none
    key = spark.conf.get(KEY_SETTING, None)
    return mask_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode() if key else KEY)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.tandem_runs import find_runs, repeat_ends, summarise

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return summarise(find_runs(repeat_ends(docs)))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociweave.llm.fingerprints import edit_and_compare

    return edit_and_compare(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit() and callable(fn)
    }
