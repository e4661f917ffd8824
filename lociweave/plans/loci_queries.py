"""Tiles, universes, and calls, with lineitem rows as assay points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import loci
from lociweave.plans.registry import query, table

WIDTH = 200
#: A unique order of lineitem rows.
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
PTS = "pts AS (SELECT 'chr' || (1 + l_suppkey % 22) AS chrom, floor(l_extendedprice)::BIGINT AS midpoint, * FROM lineitem)"
TILES = PTS + """, chip AS (SELECT chrom, midpoint // 200 AS tile, count(*) AS n FROM pts WHERE l_returnflag = 'A' GROUP BY ALL),
 ght AS (SELECT chrom, midpoint // 200 AS tile, count(*) AS n FROM pts WHERE l_returnflag = 'R' GROUP BY ALL),
 member AS (SELECT coalesce(c.chrom, g.chrom) AS chrom, coalesce(c.tile, g.tile) AS tile, coalesce(c.n, 0)::BIGINT AS chip_count, coalesce(g.n, 0)::BIGINT AS ght_count
   FROM chip c FULL OUTER JOIN ght g ON c.chrom = g.chrom AND c.tile = g.tile)"""
_LOCUS = """'{tf}:' || chrom || ':' || {start} || '-' || {end} AS locus_id, '{tf}' AS focal_tf, chrom, {start} AS start, {end} AS "end", {mid} AS midpoint, tile,
 chip_count > 0 AS chip_source, ght_count > 0 AS ght_source, chip_count, ght_count, '{universe}' AS locus_universe, '{rule}' AS selection_rule, '{center}' AS center_rule,
 {by} AS outcome_used_for_selection, {by2} AS outcome_used_for_centering, ((regexp_extract(chrom, '\\d+')::INTEGER - 1) % 5)::INTEGER AS chromosome_fold"""


def locus_sql(universe: str, tf: str = "TF", start: str = "tile * 200", end: str = "(tile + 1) * 200", mid: str = "tile * 200 + 100") -> str:
    rule, center, by, by2 = loci.UNIVERSES[universe]
    return _LOCUS.format(tf=tf, start=start, end=end, mid=mid, universe=universe, rule=rule, center=center, by=by, by2=by2)


def points(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    if flag:
        rows = rows.filter(F.col("l_returnflag") == flag)
    return rows.withColumns({
        "chrom": F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 22).cast("string")), "midpoint": F.floor("l_extendedprice").cast("long")
    })


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(points(spark, sf_dir, f).select("chrom", "midpoint") for f in ("A", "R"))


@query(f"WITH {TILES} SELECT chrom, tile, n::BIGINT AS ght_count FROM ght")
def q01_tile_count(spark, sf_dir):
    return loci.tile_counts(_both(spark, sf_dir)[1], WIDTH, "ght_count")


@query(f"WITH {TILES} SELECT * FROM member")
def q02_membership(spark, sf_dir):
    return loci.membership(*_both(spark, sf_dir), WIDTH)


@query(f"WITH {TILES} SELECT {locus_sql('ght-only')} FROM member WHERE ght_count > 0")
def q03_ght_only_loci(spark, sf_dir):
    chip, ght = _both(spark, sf_dir)
    return loci.ght_only_loci(ght, "TF", WIDTH, chip)


@query(f"WITH {TILES} SELECT {locus_sql('assay-union')} FROM member")
def q04_assay_union(spark, sf_dir):
    return loci.assay_union_loci(*_both(spark, sf_dir), "TF", WIDTH)


@query("SELECT CASE l_linenumber % 2 WHEN 0 THEN 'chr' ELSE '' END || (1 + l_suppkey % 22) AS chrom, ((l_suppkey % 22) % 5)::INTEGER AS chromosome_fold, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def q05_chrom_fold(spark, sf_dir):
    """Chromosomes with chr before their number and without."""
    rows = points(spark, sf_dir).withColumn("chrom", F.when(F.col("l_linenumber") % 2 == 0, F.col("chrom")).otherwise(F.substr("chrom", F.lit(4))))
    return rows.groupBy("chrom", loci.chromosome_fold(F.col("chrom")).alias("chromosome_fold")).agg(F.count("*").alias("n"))


_LEGACY = f"""WITH {TILES}, firsts AS (
  SELECT chrom, midpoint // 200 AS tile, arg_min(midpoint, (CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END) * 10000000 + midpoint) AS m FROM pts WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT {locus_sql('legacy-assay-union', start='greatest(m - 100, 0)', end='greatest(m - 100, 0) + 200', mid='m')} FROM firsts JOIN member USING (chrom, tile)"""


@query(_LEGACY)
def q06_legacy_first_per_tile(spark, sf_dir):
    return loci.legacy_assay_union_loci(*_both(spark, sf_dir), "TF", WIDTH)


_SIZES = "sizes AS (SELECT 'chr' || (1 + l_suppkey % 22) AS chrom, max(floor(l_extendedprice))::BIGINT + 500 AS size FROM lineitem GROUP BY 1)"


@query(f"""WITH {TILES}, {_SIZES}, grid AS (SELECT chrom, unnest(range(0, size // 200)) AS tile FROM sizes),
 full_ AS (SELECT g.chrom, g.tile, coalesce(chip_count, 0) AS chip_count, coalesce(ght_count, 0) AS ght_count FROM grid g LEFT JOIN member m ON g.chrom = m.chrom AND g.tile = m.tile)
 SELECT {locus_sql('fixed-genome')} FROM full_""")
def q07_fixed_genome(spark, sf_dir):
    sizes = points(spark, sf_dir).groupBy("chrom").agg((F.max("midpoint") + 500).alias("size"))
    return loci.fixed_genome_loci(sizes, *_both(spark, sf_dir), "TF", WIDTH)


@query("""SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS line, floor(l_extendedprice)::BIGINT - 900 AS midpoint,
 greatest(floor(l_extendedprice)::BIGINT - 1000, 0) AS start, greatest(floor(l_extendedprice)::BIGINT - 1000, 0) + 200 AS "end", 'assay' AS source FROM lineitem""")
def q08_fixed_window_clip(spark, sf_dir):
    p = points(spark, sf_dir).select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("line"), (F.col("midpoint") - 900).alias("midpoint"))
    return loci.fixed_loci(p, WIDTH, "assay")


def _calls(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(*KEY, "chrom", "midpoint", (F.col("l_quantity") - 10).alias("score"), F.col("l_discount").alias("fdr"), F.col("l_tax").alias("pvalue"))


@query(f"WITH {PTS} SELECT chrom, midpoint, l_orderkey, l_partkey, l_linenumber::BIGINT AS line, l_quantity - 10 AS score, l_discount AS fdr FROM pts WHERE l_discount <= 0.05 AND l_quantity > 10")
def q09_magix_filter(spark, sf_dir):
    from lociweave.sources.text import magix_calls

    return magix_calls(_calls(spark, sf_dir)).select("chrom", "midpoint", "l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("line"), "score", "fdr")


@query(f"""WITH {PTS} SELECT chrom, midpoint // 200 AS tile, l_orderkey, l_quantity - 10 AS score, l_discount AS fdr FROM pts
 QUALIFY row_number() OVER (PARTITION BY chrom, midpoint // 200 ORDER BY l_quantity - 10 DESC, l_discount, l_tax, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1""")
def q10_top1_per_tile(spark, sf_dir):
    tiles = loci.tile_counts(points(spark, sf_dir).select("chrom", "midpoint"), WIDTH, "n")
    best = loci.attach_scores(tiles, _calls(spark, sf_dir), WIDTH, [F.desc("score"), F.asc("fdr"), F.asc("pvalue"), *KEY])
    return best.select("chrom", "tile", "l_orderkey", "score", "fdr")


@query("""SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber % 3 = 0 THEN (2 * s + 2 * w) // 2 ELSE s + l_linenumber * 7 END AS midpoint
 FROM (SELECT *, floor(l_extendedprice)::BIGINT AS s, l_quantity::BIGINT + 100 AS w FROM lineitem)""")
def q11_narrowpeak_midpoint(spark, sf_dir):
    from lociweave.sources.text import peak_midpoint

    p = points(spark, sf_dir).withColumns({
        "start": F.col("midpoint"), "end": F.col("midpoint") + 2 * (F.col("l_quantity").cast("long") + 100),
        "summit_offset": F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_linenumber") * 7).cast("long"),
    })
    return p.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("line"), peak_midpoint(F.col("start"), F.col("end"), F.col("summit_offset")).alias("midpoint"))
