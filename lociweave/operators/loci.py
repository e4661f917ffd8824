"""Fixed tiles and locus universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.schemas import AUTOSOMES

#: Of each universe the rules, and whether the outcome decides on selection and on centres.
UNIVERSES = {
    "ght-only": ("ght_tile_only", "fixed_tile_center", False, False),
    "assay-union": ("chip_or_ght_tile", "fixed_tile_center", True, False),
    "fixed-genome": ("all_full_autosomal_tiles", "fixed_tile_center", False, False),
    "legacy-assay-union": ("chip_or_ght_tile_chip_priority", "legacy_selected_peak_midpoint", True, True),
}


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")


def validate_width(width: int) -> None:
    if width <= 0 or width % 2:
        raise ValueError("the width must be positive and even")


def chrom_number(chrom: Column) -> Column:
    return F.regexp_extract(chrom, r"^chr(\d+)$", 1).try_cast("int")


def chromosome_fold(chrom: Column, folds: int = 5) -> Column:
    """(n - 1) mod folds for chr1 to chr22, also without chr; an error otherwise."""
    n = F.regexp_extract(chrom.cast("string"), r"^(?:chr)?(\d+)$", 1).try_cast("int")
    return F.when(n.between(1, 22), F.pmod(n - 1, F.lit(folds))).otherwise(F.raise_error(F.concat(F.lit("not an autosome: "), F.coalesce(chrom.cast("string"), F.lit("null")))).cast("int"))


def tile_counts(points: DataFrame, width: int, count: str = "count") -> DataFrame:
    """(chrom, tile, count) of autosomal points; one shuffle after partial counts."""
    validate_width(width)
    ok = points.filter(F.col("chrom").isin(AUTOSOMES) & (F.col("midpoint") >= 0))
    return ok.groupBy("chrom", F.expr(f"midpoint div {width}").alias("tile")).agg(F.count("*").alias(count))


def membership(chip: DataFrame | None, ght: DataFrame | None, width: int) -> DataFrame:
    """(chrom, tile, chip_count, ght_count): the full outer join of both assays' tiles."""
    if chip is None and ght is None:
        raise ValueError("an assay is needed")
    sides = [tile_counts(p, width, f"{n}_count") for n, p in (("chip", chip), ("ght", ght)) if p is not None]
    out = sides[0].join(sides[1], ["chrom", "tile"], "full_outer") if len(sides) == 2 else sides[0]
    return out.select("chrom", "tile", *[
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in out.columns else F.lit(0).cast("long").alias(c) for c in ("chip_count", "ght_count")
    ])


def finalize(tiles: DataFrame, focal_tf: str, width: int, universe: str, folds: int = 5, ordered: bool = False) -> DataFrame:
    """Locus columns of tiles; sorted in natural chromosome order only for a sink that asks for it."""
    selection, center, by_selection, by_center = UNIVERSES[universe]
    out = tiles.withColumns({
        "start": F.col("tile") * width, "end": (F.col("tile") + 1) * width, "midpoint": F.col("tile") * width + width // 2,
    }) if "start" not in tiles.columns else tiles
    out = out.select(
        F.concat_ws(":", F.lit(focal_tf), "chrom", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).alias("locus_id"),
        F.lit(focal_tf).alias("focal_tf"), "chrom", "start", "end", "midpoint", "tile",
        (F.col("chip_count") > 0).alias("chip_source"), (F.col("ght_count") > 0).alias("ght_source"), "chip_count", "ght_count",
        F.lit(universe).alias("locus_universe"), F.lit(selection).alias("selection_rule"), F.lit(center).alias("center_rule"),
        F.lit(by_selection).alias("outcome_used_for_selection"), F.lit(by_center).alias("outcome_used_for_centering"),
        chromosome_fold(F.col("chrom"), folds).alias("chromosome_fold"),
    )
    return out.orderBy(chrom_number(F.col("chrom")), "start", "locus_id") if ordered else out


def ght_only_loci(ght: DataFrame, focal_tf: str, width: int = 200, chip: DataFrame | None = None) -> DataFrame:
    return finalize(membership(chip, ght, width).filter("ght_count > 0"), focal_tf, width, "ght-only")


def assay_union_loci(chip: DataFrame, ght: DataFrame, focal_tf: str, width: int = 200) -> DataFrame:
    return finalize(membership(chip, ght, width), focal_tf, width, "assay-union")


def fixed_genome_tiles(sizes: DataFrame, width: int = 200) -> DataFrame:
    """Every full tile of each chromosome; ranges are dealt out before they are exploded."""
    validate_width(width)
    block = 1 << 16
    blocks = sizes.filter(F.col("size") >= width).select("chrom", F.expr(f"size div {width}").alias("n")).select(
        "chrom", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("b")
    )
    return blocks.select("chrom", F.explode(F.expr(f"sequence(b * {block}, least((b + 1) * {block}, n) - 1)")).alias("tile"))


def fixed_genome_loci(sizes: DataFrame, chip: DataFrame, ght: DataFrame, focal_tf: str, width: int = 200) -> DataFrame:
    tiles = fixed_genome_tiles(sizes, width).join(membership(chip, ght, width), ["chrom", "tile"], "left")
    return finalize(tiles.fillna(0, ["chip_count", "ght_count"]), focal_tf, width, "fixed-genome")


def fixed_loci(points: DataFrame, width: int = 200, source: str = "unknown") -> DataFrame:
    """Windows about midpoints, moved right where they would begin below zero."""
    validate_width(width)
    start = F.greatest(F.col("midpoint") - width // 2, F.lit(0))
    return points.withColumns({"start": start, "end": start + width, "source": F.lit(source)})


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; order must end in a unique key for a defined result."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def legacy_assay_union_loci(chip: DataFrame, ght: DataFrame, focal_tf: str, width: int = 200) -> DataFrame:
    """One locus per tile, centred on its first point, those of the outcome assay before others."""
    validate_width(width)
    both = chip.select("chrom", "midpoint", F.lit("chip").alias("source")).unionByName(ght.select("chrom", "midpoint", F.lit("ght").alias("source")))
    both = both.filter(F.col("chrom").isin(AUTOSOMES) & (F.col("midpoint") >= 0)).withColumn("tile", F.expr(f"midpoint div {width}"))
    first = both.groupBy("chrom", "tile").agg(F.min(F.struct("source", "midpoint")).alias("f")).select("chrom", "tile", "f.midpoint")
    start = F.greatest(F.col("midpoint") - width // 2, F.lit(0))
    tiles = first.join(membership(chip, ght, width), ["chrom", "tile"]).withColumns({"start": start, "end": start + width})
    return finalize(tiles, focal_tf, width, "legacy-assay-union")


def attach_scores(loci: DataFrame, calls: DataFrame, width: int, order: list[Column]) -> DataFrame:
    """loci with the columns of the best call in each tile."""
    best = first_per_group(calls.withColumn("tile", F.expr(f"midpoint div {width}")), ["chrom", "tile"], order)
    return loci.join(best.drop("midpoint"), ["chrom", "tile"], "left")
