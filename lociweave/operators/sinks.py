"""Sinks that keep the exact text forms of reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Observation
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, gzip: bool = False, digits: int = 10) -> dict[str, int]:
    """A folder of tab-separated files with a header; doubles with so many significant digits. Returns counts; no row is an error."""
    def short(c: str):
        s = F.regexp_replace(F.format_string(f"%.{digits}g", F.col(f"`{c}`").cast("double")), r"(\.\d*?)0+(e|$)", "$1$2")
        return F.when(F.col(f"`{c}`").isNotNull(), F.regexp_replace(s, r"\.(e|$)", "$1")).alias(c)

    out = df.select(*[short(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    seen = Observation()
    flags = [F.sum(F.col(c).cast("long")).alias(c) for c, t in df.dtypes if t == "boolean"]
    out.observe(seen, F.count(F.lit(1)).alias("rows"), *flags).write.csv(path, sep="\t", header=True, compression="gzip" if gzip else "none")
    counts = {k: v or 0 for k, v in seen.get.items()}
    if not counts.get("rows"):
        raise ValueError("there is nothing to write")
    return counts


def count_export(df: DataFrame, gene: str, columns: list[str]) -> DataFrame:
    """Counts rounded half-even to longs, the first row of each gene by the rest of its values."""
    rounded = df.select(F.col(gene).alias("gene"), *[F.bround(F.col(c).cast("double")).cast("long").alias(c) for c in columns])
    return rounded.groupBy("gene").agg(F.min(F.struct(*columns)).alias("r")).select("gene", "r.*")
