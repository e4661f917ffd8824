"""The jobs as queries over the given tables: each runs twice into one new folder and gives the output as it stands then."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import locus_tables, sequence_features
from jobs.common import from_mapping
from lociweave.plans.loci_queries import TILES, locus_sql
from lociweave.sources.writers import shared_folder


def settings(name: str, kind: type, **values: object):
    """The settings file beside the job, with other paths."""
    return from_mapping(kind, json.loads((Path(__file__).parent / f"{name}.json").read_text()) | values)


def job1_sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    # a file stream reads folders, or patterns, which match a table of a single file as well
    given = settings("sequence_features", sequence_features.Settings, input=f"{sf_dir}/documents.parque[t]", output=f"{folder}/features", checkpoint=f"{folder}/checkpoint")
    for _ in range(2):
        sequence_features.run(spark, given)
    out = sequence_features.output(spark, given)
    return out.select(F.col("key").alias("doc_id"), F.col("group").alias("source"), "split", "length", "gc_fraction", "cpg_per_100bp", "n_fraction", "longest_run", "digest", "first")


def job2_locus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = settings("locus_tables", locus_tables.Settings, calls=f"{sf_dir}/lineitem.parquet", signal=f"{sf_dir}/orders.parquet", output=f"{shared_folder(spark)}/loci")
    for _ in range(2):
        locus_tables.run(spark, given)
    out = spark.read.parquet(given.output)
    return out.withColumns({"chromosome_fold": F.col("chromosome_fold").cast("int"), "signal": F.round("signal", 6)})


_RC = "reverse(translate(seq, 'ACGTN', 'TGCAN'))"
JOB1_SQL = f"""WITH seqs AS (SELECT doc_id, source, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM documents),
 counted AS (SELECT *, length(seq)::DOUBLE AS n, length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE AS gc, length(regexp_replace(seq, '[^ACGT]', '', 'g'))::DOUBLE AS acgt,
   ((length(seq) - length(replace(seq, 'CG', ''))) / 2)::DOUBLE AS cpg, sha256(least(seq, {_RC})) AS digest FROM seqs),
 placed AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place FROM counted)
SELECT doc_id, source, CASE WHEN place IS NULL OR place < 0.8::DOUBLE THEN 'train' WHEN place < 0.8::DOUBLE + 0.1::DOUBLE THEN 'valid' ELSE 'test' END AS split, length(seq)::BIGINT AS length,
 round(gc / greatest(acgt, 1), 9) AS gc_fraction, round(100.0::DOUBLE * cpg / greatest(n - 1, 1), 9) AS cpg_per_100bp, round((n - acgt) / greatest(n, 1), 9) AS n_fraction,
 list_max(list_transform(string_split_regex(seq, '[^ACGT]+'), lambda x: length(x)))::BIGINT AS longest_run, digest, CASE WHEN digest IS NOT NULL THEN doc_id = min(doc_id) OVER (PARTITION BY digest) END AS first
FROM placed"""
JOB2_SQL = f"""WITH {TILES}, calls AS (SELECT chrom, midpoint // 200 AS tile, min({{'s': -(l_quantity::DOUBLE), 'd': l_orderkey || '-' || l_linenumber || '-' || l_partkey}}) AS b FROM pts WHERE l_returnflag = 'R' GROUP BY ALL),
 loci AS (SELECT {locus_sql('assay-union')} FROM member),
 sig AS (SELECT 'chr' || (1 + o_custkey % 22) AS chrom, round_even(o_totalprice, 0)::BIGINT AS s, round_even(o_totalprice, 0)::BIGINT + 300 AS e, o_totalprice::DOUBLE AS v FROM orders),
 means AS (SELECT locus_id, sum(v * (least("end", e) - greatest(start, s))) / sum(least("end", e) - greatest(start, s)) AS signal FROM loci JOIN sig ON loci.chrom = sig.chrom AND start < e AND s < "end" GROUP BY locus_id)
SELECT loci.*, -b.s AS score, b.d AS detail, round(coalesce(signal, 0), 6) AS signal FROM loci LEFT JOIN calls ON loci.chrom = calls.chrom AND loci.tile = calls.tile LEFT JOIN means USING (locus_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_sequence_features": job1_sequence_features, "job2_locus_tables": job2_locus_tables}


def oracle_sql() -> dict[str, str]:
    return {"job1_sequence_features": JOB1_SQL, "job2_locus_tables": JOB2_SQL}
