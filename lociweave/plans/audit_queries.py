"""Set audits, expression tables, file audits, pair invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import audit, pairs, synth
from lociweave.plans.loci_queries import PTS
from lociweave.plans.model_queries import PAIRS, nation_pairs
from lociweave.plans.registry import query, table


@query(f"WITH {PAIRS} SELECT bait, prey, cooperative_signal::INTEGER AS value FROM pr")
def q47_unpivot_matrix(spark, sf_dir):
    p = nation_pairs(spark, sf_dir)
    names = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect())  # the columns of the wide matrix
    wide = p.groupBy("bait").pivot("prey", names).agg(F.max("cooperative_signal"))
    return pairs.unpivot_matrix(wide, "bait")


_TOKENS = "CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'N/A' ELSE o_orderpriority || ', 2-FR, 1-' || o_orderstatus END"


@query(f"""WITH x AS (SELECT o_orderkey, lower({_TOKENS}) AS s FROM orders), t AS (SELECT o_orderkey, s, list_transform(string_split(s, ','), lambda x: trim(x)) AS k FROM x)
SELECT o_orderkey, s <> 'n/a' AS tested, s <> 'n/a' AND len(list_filter(k, lambda x: starts_with(x, '1-'))) > 0 AS composite, s <> 'n/a' AND len(list_filter(k, lambda x: starts_with(x, '2-'))) > 0 AS spacing,
 CASE WHEN s IN ('n/a', '0') THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(k, lambda x: substring(x, instr(x, '-') + 1)))), ',') END AS specificity FROM t""")
def q48_token_parse(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "0").when(k == 1, "N/A").otherwise(F.concat("o_orderpriority", F.lit(", 2-FR, 1-"), "o_orderstatus"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", pairs.parse_tokens(raw).alias("p"))
    return out.select("o_orderkey", "p.tested", "p.composite", "p.spacing", F.array_join("p.specificity", ",").alias("specificity"))


@query("""SELECT n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey % 2 = 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey > 0""")
def q49_four_way_overlap(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sets = [
        n.filter("n_nationkey % 2 = 0").select("n_nationkey"), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_nationkey"),
        table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_nationkey"), n.filter("n_regionkey > 0").select("n_nationkey"),
    ]
    return audit.intersect_all([s.toDF("key").select(F.col("key").cast("long").alias("key")) for s in sets])


@query("""WITH c AS (SELECT DISTINCT c_nationkey % 23 AS v FROM customer), s AS (SELECT DISTINCT s_nationkey + 2 AS v FROM supplier)
SELECT v::BIGINT AS value, 'customer' AS side FROM c WHERE v NOT IN (SELECT v FROM s) UNION ALL SELECT v::BIGINT, 'supplier' FROM s WHERE v NOT IN (SELECT v FROM c)""")
def q50_coverage_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 23).cast("long"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 2).cast("long"))
    return audit.coverage_differences(c, s, ("customer", "supplier"))


@query("SELECT p_brand AS gene, round(sum(l_quantity), 4) AS tpm, count(*)::BIGINT AS transcripts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 <> 0 GROUP BY p_brand")
def q51_tpm_rollup(spark, sf_dir):
    quant = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("transcript"), F.col("l_quantity").alias("tpm"))
    names = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("gene"))
    return audit.tpm_rollup(quant, names).select("gene", F.round("tpm", 4).alias("tpm"), "transcripts")


@query("SELECT count(*)::BIGINT AS transcripts, count(p_partkey)::BIGINT AS mapped, round(count(p_partkey) / count(*), 9) AS mapping_rate FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey")
def q51b_mapping_rate(spark, sf_dir):
    quant = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("transcript"), F.col("l_quantity").alias("tpm"))
    names = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("gene"))
    return audit.mapping_rate(quant, names).withColumn("mapping_rate", F.round("mapping_rate", 9))


@query("""WITH e AS (SELECT n_name AS sample, p_brand AS partner, sum(l_quantity) AS tpm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT n_name AS sample, b.p_brand AS partner, round(coalesce(tpm, 0), 4) AS tpm, coalesce(tpm, 0) >= 60 AS supported FROM nation CROSS JOIN (SELECT DISTINCT p_brand FROM part) b LEFT JOIN e ON e.sample = n_name AND e.partner = b.p_brand""")
def q52_partner_grid(spark, sf_dir):
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    e = rows.select(F.col("n_name").alias("sample"), F.col("p_brand").alias("partner"), F.col("l_quantity").alias("tpm"))
    out = audit.partner_grid(nation.select(F.col("n_name").alias("sample")), part.select(F.col("p_brand").alias("partner")), e, 60.0)
    return out.select("sample", "partner", F.round("tpm", 4).alias("tpm"), "supported")


@query("""SELECT n_name AS partner, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) THEN 'first' WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'second' WHEN n_regionkey = 1 THEN 'third' END AS source FROM nation""")
def q53_priority_source(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    named = lambda t, k: t.join(n, F.col(k) == F.col("n_nationkey")).select(F.col("n_name").alias("partner"))
    sources = [
        ("first", named(table(spark, sf_dir, "supplier").filter("s_acctbal > 9000"), "s_nationkey")), ("second", named(table(spark, sf_dir, "customer").filter("c_acctbal > 9900"), "c_nationkey")),
        ("third", n.filter("n_regionkey = 1").select(F.col("n_name").alias("partner"))),
    ]
    return audit.priority_source(n.select(F.col("n_name").alias("partner")), sources)


@query("""SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS replicates, list_sort(list(l_linenumber)) = [1, 2] AS complete FROM lineitem GROUP BY l_orderkey""")
def q54_replicate_guard(spark, sf_dir):
    out = audit.replicate_guard(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", [1, 2])
    return out.select("l_orderkey", F.array_join(F.col("replicates").cast("array<string>"), ",").alias("replicates"), "complete")


@query("""SELECT o_orderpriority AS batch, count(DISTINCT o_custkey)::BIGINT AS experiments, count(DISTINCT o_orderkey)::BIGINT AS runs, count(*)::BIGINT AS files, sum(l_quantity::BIGINT)::BIGINT AS bytes
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '4') GROUP BY 1""")
def q55_batch_scope(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("batch"), F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("run"), F.col("l_quantity").cast("long").alias("bytes")
    )
    return audit.batch_scope(files, o.filter("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("batch")))


@query("""WITH a AS (SELECT l_linestatus || (l_suppkey % 9) AS tf, round(avg(l_tax), 9) AS r, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linestatus || (l_suppkey % 9) AS tf, round(avg(l_tax), 9) AS r, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT tf, a.r AS r_first, b.r AS r_second, a.n::BIGINT AS n_first, b.n::BIGINT AS n_second, round(b.r - a.r, 9) AS r_difference, (b.n - a.n)::BIGINT AS n_difference FROM a JOIN b USING (tf)""")
def q56_pipeline_compare(spark, sf_dir):
    side = lambda f: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == f).groupBy(F.concat("l_linestatus", (F.col("l_suppkey") % 9).cast("string")).alias("tf")).agg(F.round(F.avg("l_tax"), 9).alias("r"), F.count("*").alias("n"))
    return audit.compare_reports(side("A"), side("R"), "tf", ["r", "n"]).withColumn("r_difference", F.round("r_difference", 9))


@query(f"""WITH {PTS}, b AS (SELECT chrom, midpoint AS s, midpoint + 100 + (l_orderkey % 3)::BIGINT AS e, count(*) AS n FROM pts GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, min(e - s)::BIGINT AS width_min, max(e - s)::BIGINT AS width_max, sum(n - 1)::BIGINT AS duplicate_coordinates, bool_and(s >= 0 AND e > s) AS valid, false AS eligible FROM b""")
def q57_file_audit(spark, sf_dir):
    from lociweave.plans.loci_queries import points

    rows = points(spark, sf_dir).select("chrom", F.col("midpoint").alias("start"), (F.col("midpoint") + 100 + F.col("l_orderkey") % 3).alias("end"))
    return audit.file_audit(rows, 100)


@query("""SELECT o_custkey AS pair_id, count(*) = 2 AND sum(o_orderkey % 2) = 1 AND count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT o_orderkey % 3) = 1 AS valid FROM orders GROUP BY o_custkey""")
def q60_pair_invariants(spark, sf_dir):
    same = {c: F.lit("x") for c in ("orientation_a", "orientation_b", "motif_a_instance", "motif_b_instance")}
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id"), (F.col("o_orderkey") % 2).alias("label"), F.col("o_orderstatus").alias("start_a"), (F.col("o_orderkey") % 3).alias("background_sha256"))
    return synth.validate_pairs(rows.withColumns(same))
