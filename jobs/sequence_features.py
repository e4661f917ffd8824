"""Incremental features of sequence records, with copies kept in one split.

New Parquet files of records are taken as they come: a file stream with a checkpoint reads each file once, and a run ends when all that is there is done. Every
record gets its composition, its longest run of known bases, and a digest that is the same for both strands. The split of a record follows from its digest, so that
copies of a sequence, on either strand and from any run, are never in two splits. The first record of each digest is marked: the one with the least id in the first
batch that has it.

The output has a row for each record, in folders by batch, split and group. A batch that is run again, after a failure, reads the same files and replaces its own
folders, so a rerun gives the same rows. Checkpoint and output belong together: take new folders for both to begin anew.

A record without a sequence has nulls for features, digest and mark, and the first split; an empty sequence has a length of 0. Records with one id are kept each.

    python -m jobs.sequence_features jobs/sequence_features.json --set input=/data/documents --set output=/data/features --set checkpoint=/data/mark
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lociweave.functions import sequence as S
from lociweave.operators.scale import spread

DIGITS = 9


@dataclass(frozen=True)
class Settings:
    """input: a folder of Parquet files, or a pattern of files or folders; key, sequence, group: its columns; shares: split to its share, in order; files: of one batch at most."""

    input: str
    output: str
    checkpoint: str
    key: str = "doc_id"
    sequence: str = "text"
    group: str = "source"
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "valid": 0.1, "test": 0.1})
    files: int = 1000


def split_of(digest: Column, shares: dict[str, float]) -> Column:
    """The split in whose range the digest's first 32 bits fall."""
    if not shares or any(s <= 0 for s in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be positive and add up to 1")
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    names, upto = list(shares), 0.0
    out = F.when(at.isNull(), names[0])
    for n in names[:-1]:
        upto += shares[n]
        out = out.when(at < upto, n)
    return out.otherwise(names[-1])


def features(records: DataFrame, settings: Settings) -> DataFrame:
    """(key, group, length, gc_fraction, cpg_per_100bp, n_fraction, longest_run, digest, split) of records."""
    s = F.col("__seq")
    rows = records.select(F.col(settings.key).alias("key"), F.col(settings.group).alias("group"), S.canonical(F.col(settings.sequence)).alias("__seq"))
    rows = rows.select(
        "key", "group", F.length(s).cast("long").alias("length"), *[F.round(f(s), DIGITS).alias(n) for n, f in (("gc_fraction", S.gc_fraction), ("cpg_per_100bp", S.cpg_per_100bp), ("n_fraction", S.n_fraction))],
        S.longest_canonical_run(s).cast("long").alias("longest_run"), S.digest(S.strand_invariant(s)).alias("digest"),
    )
    return rows.withColumn("split", split_of(F.col("digest"), settings.shares))


def mark_first(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with first: whether a row has the least key of those with its digest, and known has no such digest.

    Only a row for each digest is looked up and joined again by key, so that a digest with very many copies makes no large group.
    """
    firsts = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("key").alias("key"))
    if known is not None:
        firsts = firsts.join(known.filter(F.col("digest").isNotNull() & F.col("first")).select("digest"), "digest", "left_anti")
    joined = rows.join(firsts.withColumn("__f", F.lit(True)), ["key", "digest"], "left")
    return joined.select(*rows.columns, F.when(F.col("digest").isNotNull(), F.coalesce("__f", F.lit(False))).alias("first"))


def output(spark: SparkSession, settings: Settings) -> DataFrame:
    """All rows of the output; groups and splits are strings, whatever they look like."""
    names = spark.read.parquet(settings.output).schema
    schema = ", ".join(f"`{f.name}` {'string' if f.name in ('split', 'group') else 'long' if f.name == 'batch' else f.dataType.simpleString()}" for f in names)
    return spark.read.schema(schema).parquet(settings.output)


def run(spark: SparkSession, settings: Settings) -> dict:
    """Takes the files that are new since the last run and adds their records to the output; returns counts."""
    schema = spark.read.parquet(settings.input).schema
    report = {"batches": 0, "read": 0, "written": 0, "first": 0}

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # batch 0 has nothing before it; a batch that is run again doesn't see its own rows
        known = session.read.schema("digest string, first boolean, batch long").parquet(settings.output).filter(F.col("batch") < number) if number else None
        rows = features(spread(batch.select(settings.key, settings.group, settings.sequence)), settings).persist()
        try:
            done = mark_first(rows, known).withColumn("batch", F.lit(number).cast("long"))
            done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "split", "group").parquet(settings.output)
            read = rows.count()
        finally:
            rows.unpersist()
        c = session.read.schema("first boolean, batch long").parquet(settings.output).filter(F.col("batch") == number).agg(F.count("*").alias("n"), F.count_if("first").alias("first")).first()
        log.info("batch %d: read %d records, wrote %d rows to %s, of which %d are the first of their digest", number, read, c["n"], settings.output, c["first"])
        if c["n"] != read:
            raise RuntimeError(f"batch {number} has {read} records, but {c['n']} rows are written")
        for name, n in (("batches", 1), ("read", read), ("written", c["n"]), ("first", c["first"])):
            report[name] += n

    log.info("reading what is new in %s", settings.input)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files).parquet(settings.input)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", settings.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %s", report)
    return report


if __name__ == "__main__":
    command(Settings, run, "sequence_features")
