"""Tile counts over a stream of assay points, for sources that arrive in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.loci import validate_width
from lociweave.schemas import AUTOSOMES


def streaming_tile_counts(points: DataFrame, width: int = 200) -> DataFrame:
    """(chrom, tile, count) of a streaming or batch DataFrame (chrom, midpoint); the state is one count for each tile seen."""
    validate_width(width)
    ok = points.filter(F.col("chrom").isin(AUTOSOMES) & (F.col("midpoint") >= 0))
    return ok.groupBy("chrom", F.expr(f"midpoint div {width}").alias("tile")).agg(F.count("*").alias("count"))
