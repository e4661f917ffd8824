"""The locus table of two assays' calls: the union of their fixed tiles with the best call, the mean signal and the chromosome fold of each.

Calls and signal are Parquet tables, whose columns are named or worked out by SQL expressions in the settings. The output is partitioned by fold and chromosome. A
run replaces the partitions of the chromosomes that it builds, all of them or those listed, and leaves the others; so it can be rerun, or renewed for a part,
with the same result. The tiles of a chromosome that has no calls any more are removed when all are built.

Calls beyond the autosomes or with a null or negative place are left out, and counted in the log; a tile without a call of the scored assay has null scores, one without
signal the value 0. Of equally good calls the one with the least detail (all its columns in order) counts.

    python -m jobs.locus_tables jobs/locus_tables.json --set output=/data/out/loci --set 'chromosomes=["chr1"]'
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, read_columns
from lociweave.operators import intervals, loci
from lociweave.schemas import AUTOSOMES


@dataclass(frozen=True)
class Settings:
    """calls and signal: paths; *_columns: expressions of (assay, chrom, midpoint, score, detail) and of (chrom, start, end, value); assay is chip or ght."""

    calls: str
    calls_columns: dict[str, str]
    signal: str
    signal_columns: dict[str, str]
    output: str
    focal: str
    width: int = 200
    chromosomes: list[str] | None = None


def build(calls: DataFrame, signal: DataFrame, settings: Settings) -> DataFrame:
    """The locus columns of the assay union with score, detail and signal."""
    chip, ght = (calls.filter(F.col("assay") == a) for a in ("chip", "ght"))
    table = loci.assay_union_loci(chip.select("chrom", "midpoint"), ght.select("chrom", "midpoint"), settings.focal, settings.width)
    # the best call of a tile by an aggregate, which sums up before the shuffle however many calls a tile has
    tile = F.expr(f"midpoint div {settings.width}")
    best = ght.groupBy("chrom", tile.alias("tile")).agg(F.min(F.struct((-F.col("score")).alias("s"), "detail")).alias("b")).select("chrom", "tile", (-F.col("b.s")).alias("score"), "b.detail")
    table = table.join(best, ["chrom", "tile"], "left")
    return intervals.interval_mean(table, signal, "signal")


def run(spark: SparkSession, settings: Settings) -> dict:
    """Builds the locus table and replaces its partitions; returns counts."""
    wanted = settings.chromosomes or list(AUTOSOMES)
    if unknown := sorted(set(wanted) - set(AUTOSOMES)):
        raise ValueError(f"no autosomes: {', '.join(unknown)}")
    every = read_columns(spark, settings.calls, settings.calls_columns)
    c = every.agg(F.count("*").alias("read"), F.count_if(F.col("assay") == "chip").alias("chip"), F.count_if(F.col("assay") == "ght").alias("ght"), F.count_if(~F.coalesce(F.col("chrom").isin(AUTOSOMES) & (F.col("midpoint") >= 0), F.lit(False))).alias("left_out")).first()
    log.info("read %d calls of %s: %d chip, %d ght; %d are beyond the autosomes", c["read"], settings.calls, c["chip"], c["ght"], c["left_out"])
    calls = every.filter(F.col("chrom").isin(wanted) & (F.col("midpoint") >= 0))
    signal = read_columns(spark, settings.signal, settings.signal_columns).select("chrom", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "value").filter(F.col("chrom").isin(wanted))
    table = build(calls, signal, settings)
    # all partitions are replaced, or those that the rows have
    mode = "dynamic" if settings.chromosomes else "static"
    table.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("chromosome_fold", "chrom").parquet(settings.output)
    written = spark.read.parquet(settings.output).filter(F.col("chrom").isin(wanted)).agg(F.count("*").alias("loci"), F.count_if(F.col("chip_source") & F.col("ght_source")).alias("both")).first()
    report = c.asDict() | written.asDict() | {"chromosomes": len(wanted)}
    log.info("wrote %d loci of %d chromosomes to %s; both assays have %d", written["loci"], len(wanted), settings.output, written["both"])
    return report


if __name__ == "__main__":
    command(Settings, run, "locus_tables")
