"""Interval joins, links and assembled features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import intervals, loci
from lociweave.plans.registry import query, table

# parts are loci, orders are loops' anchors and signal
A = "a AS (SELECT p_partkey AS id, 'chr' || (1 + p_partkey % 22) AS chrom, (p_retailprice * 100)::BIGINT AS s, (p_retailprice * 100)::BIGINT + 50 + p_size AS e FROM part)"
B = "b AS (SELECT o_orderkey AS id, 'chr' || (1 + o_custkey % 22) AS chrom, o_totalprice::BIGINT AS s, o_totalprice::BIGINT + 300 AS e, o_totalprice AS v, o_custkey FROM orders)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.round(F.col("p_retailprice") * 100).cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 22).cast("string")).alias("chrom"), at.alias("start"), (at + 50 + F.col("p_size")).alias("end")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.rint("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("oid"), F.concat(F.lit("chr"), (1 + F.col("o_custkey") % 22).cast("string")).alias("chrom"), at.alias("s_start"), (at + 300).alias("s_end"), F.col("o_totalprice").alias("value"), "o_custkey"
    )


@query(f"WITH {A}, {B} SELECT a.id AS part, b.id AS ord, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")
def q18_interval_overlap(spark, sf_dir):
    found = intervals.overlap_join(_parts(spark, sf_dir), _orders(spark, sf_dir), ["chrom"], ("start", "end"), ("s_start", "s_end"))
    return found.select(F.col("id").alias("part"), F.col("oid").alias("ord"), (F.least("end", "s_end") - F.greatest("start", "s_start")).alias("overlap"))


@query(f"""WITH {A}, {B} SELECT a.id AS locus_id, round(coalesce(sum(b.v * (least(a.e, b.e) - greatest(a.s, b.s))) / sum(least(a.e, b.e) - greatest(a.s, b.s)), 0), 6) AS signal
 FROM a LEFT JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e GROUP BY a.id""")
def q19_interval_mean(spark, sf_dir):
    out = intervals.interval_mean(_parts(spark, sf_dir).withColumnRenamed("id", "locus_id"), _orders(spark, sf_dir), "signal")
    return out.select("locus_id", F.round("signal", 6).alias("signal"))


_LINKS = f"""{A}, {B}, p AS (SELECT 'g' || (id % 97) AS gene, chrom, s + 20 AS s, s + 200 AS e FROM a),
 l AS (SELECT id, 'L' || id AS locus_id, chrom, s, e FROM a),
 loops AS (SELECT id, chrom AS c1, s AS s1, e AS e1, 'chr' || (1 + id % 22) AS c2, s + 5000 AS s2, s + 5600 AS e2, (id % 13)::DOUBLE AS score FROM b),
 raw AS (
  SELECT p.gene, l.locus_id, true AS direct, NULL::DOUBLE AS score FROM l JOIN p ON l.chrom = p.chrom AND l.s < p.e AND p.s < l.e
  UNION ALL SELECT p.gene, l.locus_id, false, o.score FROM loops o JOIN l ON l.chrom = c1 AND l.s < e1 AND s1 < l.e JOIN p ON p.chrom = c2 AND p.s < e2 AND s2 < p.e
  UNION ALL SELECT p.gene, l.locus_id, false, o.score FROM loops o JOIN l ON l.chrom = c2 AND l.s < e2 AND s2 < l.e JOIN p ON p.chrom = c1 AND p.s < e1 AND s1 < p.e)"""


def _links(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    promoters = parts.select(F.concat(F.lit("g"), (F.col("id") % 97).cast("string")).alias("gene"), "chrom", (F.col("start") + 20).alias("promoter_start"), (F.col("start") + 200).alias("promoter_end"))
    own = parts.select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("locus_id"), "chrom", "start", "end")
    loops = _orders(spark, sf_dir).select(
        F.col("chrom").alias("chrom1"), F.col("s_start").alias("start1"), F.col("s_end").alias("end1"), F.concat(F.lit("chr"), (1 + F.col("oid") % 22).cast("string")).alias("chrom2"),
        (F.col("s_start") + 5000).alias("start2"), (F.col("s_start") + 5600).alias("end2"), (F.col("oid") % 13).cast("double").alias("loop_score"),
    )
    return intervals.link_loci_to_promoters(own, promoters, loops), own


@query(f"WITH {_LINKS} SELECT gene, locus_id, bool_or(direct) AS direct, count(*)::BIGINT AS loop_count, coalesce(max(score), 0) AS loop_score FROM raw GROUP BY gene, locus_id")
def q20_links_agg(spark, sf_dir):
    return _links(spark, sf_dir)[0]


@query("""WITH x AS (SELECT DISTINCT 'g' || (l_partkey % 211) AS gene, 'L' || l_suppkey AS locus_id FROM lineitem),
 l AS (SELECT 'L' || s_suppkey AS locus_id, round(ln(1 + greatest(s_acctbal, 0)), 9) AS v FROM supplier), n AS (SELECT gene, count(DISTINCT locus_id)::BIGINT AS linked_locus_count FROM x JOIN l USING (locus_id) GROUP BY gene)
 SELECT gene, locus_id, v AS chip_mean_log1p, linked_locus_count FROM x JOIN l USING (locus_id) JOIN n USING (gene) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY v DESC, locus_id) = 1""")
def q21_strongest_linked(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    links = table(spark, sf_dir, "lineitem").select(name("g", F.col("l_partkey") % 211).alias("gene"), name("L", F.col("l_suppkey")).alias("locus_id")).distinct()
    own = table(spark, sf_dir, "supplier").select(name("L", F.col("s_suppkey")).alias("locus_id"), F.round(F.log1p(F.greatest("s_acctbal", F.lit(0))), 9).alias("chip_mean_log1p"))
    return intervals.strongest_linked_locus(links, own)


@query("""SELECT o_orderkey AS locus_id, o_totalprice AS price, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance, coalesce(n_regionkey, 0)::DOUBLE AS region
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3""")
def q22_assemble_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("locus_id"), "o_custkey", F.col("o_totalprice").alias("price"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    nation = table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("double").alias("region"))
    keyed = orders.join(customer, "o_custkey", "left")
    parts = [keyed.select("locus_id", "balance"), keyed.join(nation, "c_nationkey", "left").select("locus_id", "region")]
    return intervals.assemble_features(orders.select("locus_id", "price"), parts)


#: Chains from suppliers: three blocks of one chain each, 10 or 40 bases apart, every third chain to the reverse strand, with equal scores among them.
CHAINS = """blocks AS (SELECT s_suppkey // 3 AS chain, 'chr' || (1 + (s_suppkey // 3) % 22) AS chrom, 80000 + s_suppkey * 1000 AS s, 80000 + s_suppkey * 1000 + CASE s_suppkey % 2 WHEN 0 THEN 990 ELSE 960 END AS e,
   'new' || ((s_suppkey // 3) % 5) AS c2, (s_suppkey // 3) % 3 = 0 AS back, CASE (s_suppkey // 3) % 3 WHEN 0 THEN 50000000 - s_suppkey * 1100 ELSE s_suppkey * 1100 END AS t, ((s_suppkey // 3) % 4)::DOUBLE AS score FROM supplier
  UNION ALL SELECT 1000000 + s_suppkey, 'chr' || (1 + s_suppkey % 22), 85000 + s_suppkey * 700, 85900 + s_suppkey * 700, 'alt', false, s_suppkey * 700, 1.5 FROM supplier)"""
LIFTED = CHAINS + """, hit AS (SELECT a.id, chain, c2, back, score, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS n, min(CASE WHEN back THEN t + b.e - least(a.e, b.e) ELSE t + greatest(a.s, b.s) - b.s END) AS lo,
   max(CASE WHEN back THEN t + b.e - greatest(a.s, b.s) ELSE t + least(a.e, b.e) - b.s END) AS hi FROM a JOIN blocks b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e GROUP BY ALL),
 best AS (SELECT hit.* FROM hit JOIN a USING (id) WHERE n >= 0.95 * (a.e - a.s) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chain::VARCHAR) = 1)
SELECT a.id AS locus_id, best.id IS NOT NULL AS mapped, c2 AS mapped_chrom, lo::BIGINT AS mapped_start, hi::BIGINT AS mapped_end, CASE WHEN back THEN '-' WHEN NOT back THEN '+' END AS mapped_strand, n::BIGINT AS mapped_bases FROM a LEFT JOIN best USING (id)"""


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of CHAINS, with places on the forward strand."""
    k = F.col("s_suppkey").cast("long")
    c = F.expr("s_suppkey div 3")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    supplier = table(spark, sf_dir, "supplier")
    start, width = 80_000 + k * 1000, F.when(k % 2 == 0, 990).otherwise(960)
    threes = supplier.select(
        c.cast("string").alias("chain_id"), name("chr", 1 + c % 22).alias("chrom"), start.alias("b_start"), (start + width).alias("b_end"), name("new", c % 5).alias("to_chrom"),
        F.when(c % 3 == 0, 50_000_000 - k * 1100).otherwise(k * 1100).alias("to_start"), F.when(c % 3 == 0, "-").otherwise("+").alias("strand"), (c % 4).cast("double").alias("score"),
    )
    singles = supplier.select(
        (1_000_000 + k).cast("string").alias("chain_id"), name("chr", 1 + k % 22).alias("chrom"), (85_000 + k * 700).alias("b_start"), (85_900 + k * 700).alias("b_end"),
        F.lit("alt").alias("to_chrom"), (k * 700).alias("to_start"), F.lit("+").alias("strand"), F.lit(1.5).alias("score"),
    )
    return threes.unionByName(singles)


@query(f"WITH {A}, {LIFTED}")
def q23_liftover_left(spark, sf_dir):
    return intervals.liftover(_parts(spark, sf_dir).withColumnRenamed("id", "locus_id"), chain_rows(spark, sf_dir)).drop("chrom", "start", "end")


@query(f"""WITH {A}, {B}, lifted AS (WITH {LIFTED}), sizes AS (SELECT c2 AS chrom, max(t + e - s)::BIGINT - 2000 AS size FROM (WITH {CHAINS} SELECT * FROM blocks) GROUP BY c2),
 m AS (SELECT locus_id, mapped_chrom, mapped_start, mapped_end FROM lifted JOIN sizes ON mapped_chrom = sizes.chrom WHERE mapped_start >= 0 AND mapped_end <= size),
 sig AS (SELECT c2, s, e, v FROM (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'alt' ELSE 'new' || (o_orderkey % 5) END AS c2, o_orderkey * 11 AS s, o_orderkey * 11 + 7 AS e, o_totalprice::DOUBLE AS v FROM orders))
SELECT a.id AS locus_id, m.locus_id IS NOT NULL AS dnase_mapped, mapped_chrom AS dnase_old_chrom, mapped_start AS dnase_old_start, mapped_end AS dnase_old_end, dnase
FROM a LEFT JOIN m ON a.id = m.locus_id LEFT JOIN (SELECT m.locus_id, round(coalesce(sum(sig.v * (least(mapped_end, sig.e) - greatest(mapped_start, sig.s))) / sum(least(mapped_end, sig.e) - greatest(mapped_start, sig.s)), 0), 6) AS dnase
  FROM m LEFT JOIN sig ON sig.c2 = mapped_chrom AND mapped_start < sig.e AND sig.s < mapped_end GROUP BY m.locus_id) d ON d.locus_id = a.id""")
def q131_cross_assembly_signal(spark, sf_dir):
    blocks = chain_rows(spark, sf_dir)
    sizes = blocks.groupBy(F.col("to_chrom").alias("chrom")).agg((F.max(F.col("to_start") + F.col("b_end") - F.col("b_start")) - 2000).alias("size"))
    k = F.col("o_orderkey")
    signal = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "alt").otherwise(F.concat(F.lit("new"), (k % 5).cast("string"))).alias("chrom"), (k * 11).alias("s_start"), (k * 11 + 7).alias("s_end"), F.col("o_totalprice").cast("double").alias("value"))
    out = intervals.cross_assembly_signal(_parts(spark, sf_dir).withColumnRenamed("id", "locus_id"), signal, blocks, sizes, "dnase", "old")
    return out.drop("chrom", "start", "end").withColumn("dnase", F.round("dnase", 6))


@query("""SELECT user_id, count(*)::BIGINT AS records, sum(10 + event_id % 7)::BIGINT AS covered_bases, round(sum((10 + event_id % 7) * value), 4) AS weighted_sum FROM events GROUP BY user_id""")
def q59_bedgraph_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    signal = e.select("user_id", F.col("event_id").alias("s_start"), (F.col("event_id") + 10 + F.col("event_id") % 7).alias("s_end"), "value")
    return intervals.bedgraph_summary(signal, ["user_id"]).withColumn("weighted_sum", F.round("weighted_sum", 4))
