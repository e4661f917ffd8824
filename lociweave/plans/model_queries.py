"""Residuals, models, metrics and null tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import metrics, models, pairs, panel
from lociweave.operators.scale import kept
from lociweave.plans.loci_queries import KEY
from lociweave.plans.registry import query, table

ROWS = """x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS line, l_extendedprice AS g, l_quantity AS m, l_discount AS d, l_tax AS t,
 ((l_suppkey % 22) % 5)::BIGINT AS fold, 'chr' || (1 + l_suppkey % 22) AS chrom FROM lineitem)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("g"), F.col("l_quantity").alias("m"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_suppkey") % 22 % 5).cast("long").alias("fold"), F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 22).cast("string")).alias("chrom"),
    )



@query(f"""WITH {ROWS}, q AS (SELECT list_sort(list_distinct(quantile_cont(m, [0, 0.25, 0.5, 0.75, 1]))) AS q FROM x WHERE fold <> 0),
 b AS (SELECT x.*, len(list_filter(q[2:len(q) - 1], lambda e: e <= m)) AS bin FROM x, q), means AS (SELECT bin, avg(g) AS mean FROM b WHERE fold <> 0 GROUP BY bin)
SELECT l_orderkey, l_partkey, line, round(g - coalesce(mean, (SELECT avg(g) FROM x WHERE fold <> 0)), 4) AS residual FROM b LEFT JOIN means USING (bin)""")
def q27_binned_residual(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("train", F.col("fold") != 0)
    return models.binned_residuals(rows, "g", ["m"], "train", 4).select("l_orderkey", "l_partkey", "line", F.round("residual", 4).alias("residual"))


_FOLDS = """folds AS (SELECT DISTINCT fold AS k FROM x),
 q AS (SELECT k, list_sort(list_distinct(quantile_cont(m, [0, 0.25, 0.5, 0.75, 1]))) AS qm, list_sort(list_distinct(quantile_cont(d, [0, 0.25, 0.5, 0.75, 1]))) AS qd, avg(g) AS overall FROM folds, x WHERE fold <> k GROUP BY k),
 b AS (SELECT x.*, k, overall, len(list_filter(qm[2:len(qm) - 1], lambda e: e <= m)) AS b1, len(list_filter(qd[2:len(qd) - 1], lambda e: e <= d)) AS b2 FROM x, q),
 means AS (SELECT k, b1, b2, avg(g) AS mean FROM b WHERE fold <> k GROUP BY ALL)"""


@query(f"WITH {ROWS}, {_FOLDS} SELECT l_orderkey, l_partkey, line, round(g - coalesce(mean, overall), 4) AS residual FROM b LEFT JOIN means USING (k, b1, b2) WHERE fold = k")
def q28_crossfit_residual(spark, sf_dir):
    out = models.cross_fitted_residuals(_rows(spark, sf_dir), "g", ["m", "d"], "fold", 4)
    return out.select("l_orderkey", "l_partkey", "line", F.round("residual", 4).alias("residual"))


@query("""SELECT l_orderkey, round(avg(v), 6) AS pair_mean, max(p) AS partner_max FROM (
 SELECT l_orderkey, l_suppkey % 5 AS pair, avg(l_quantity) AS v, max(l_extendedprice) AS p FROM lineitem WHERE l_suppkey % 5 <> 4 GROUP BY ALL) GROUP BY l_orderkey""")
def q29_pair_balanced_mean(spark, sf_dir):
    """Pairs are partners: those of class 4 lack expression."""
    long = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("partner"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("raw"))
    support = spark.range(5).select(F.col("id").alias("partner"), (F.col("id") != 4).alias("expression_supported"))
    out = panel.supported_aggregates(long, support, "l_orderkey")
    return out.select("l_orderkey", F.round("pair_mean", 6).alias("pair_mean"), "partner_max")


@query("SELECT min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.99), 6) AS p99, max(o_totalprice) AS max FROM orders")
def q30_quantiles(spark, sf_dir):
    return metrics.quantile_summary(table(spark, sf_dir, "orders"), "o_totalprice").select("min", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p99")], "max")



@query("""WITH x AS (SELECT ln(1 + greatest(l_quantity - 5, 0)) AS a, ln(1 + l_discount * 10) AS b, l_quantity - 5 AS q, l_discount AS d FROM lineitem),
 r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ka, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS kb FROM x)
SELECT count(*)::BIGINT AS n, avg((q = 0)::INTEGER) AS zero_first, avg((d = 0)::INTEGER) AS zero_second, round(median(abs(a - b)), 6) AS median_abs_log1p_difference, round(corr(ka, kb), 6) AS spearman FROM r""")
def q31_replicate_qc(spark, sf_dir):
    """Values below 0 count as 0 in the logs."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 5).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return metrics.replicate_qc(x, "a", "b").select("n", "zero_first", "zero_second", *[F.round(c, 6).alias(c) for c in ("median_abs_log1p_difference", "spearman")])


LABELLED = "s AS (SELECT doc_id, quality AS y, round(1.0::DOUBLE / (1.0 + n_chars % 100), 6) AS p FROM documents JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(1.0 / (1.0 + F.col("n_chars") % 100), 6).alias("p"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(f"""WITH {LABELLED}, t AS (SELECT p, sum(y)::DOUBLE AS pos, count(*) - sum(y)::DOUBLE AS neg FROM s GROUP BY p),
 c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (ORDER BY p DESC)), a AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM t)
SELECT (np + nn)::BIGINT AS n, np::BIGINT AS positives, round(any_value(np / (np + nn)), 9) AS prevalence, round(sum(neg * (tp - pos / 2)) / any_value(np * nn), 9) AS auroc,
 round(sum(pos * tp / (tp + fp)) / any_value(np), 9) AS auprc FROM c, a GROUP BY np, nn""")
def q32_auroc_ap(spark, sf_dir):
    return metrics.auroc_ap(_labelled(spark, sf_dir), "y", "p").select("n", "positives", *[F.round(c, 9).alias(c) for c in ("prevalence", "auroc", "auprc")])


@query(f"""WITH {LABELLED}, b AS (SELECT len(list_filter([0.1::DOUBLE, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9], lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1)
SELECT round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM b""")
def q33_ece(spark, sf_dir):
    return metrics.calibration_error(_labelled(spark, sf_dir), "y", "p").select(F.round("ece", 9).alias("ece"))


@query(f"""WITH {LABELLED}, c AS (SELECT DISTINCT p AS t FROM s UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
 a AS (SELECT t, (sum(y) FILTER (p >= t))::DOUBLE / sum(y) AS tpr, 1 - coalesce(sum(1 - y) FILTER (p >= t), 0)::DOUBLE / sum(1 - y) AS tnr FROM c, s GROUP BY t)
SELECT t AS threshold, round((coalesce(tpr, 0) + tnr) / 2, 9) AS balanced_accuracy FROM a ORDER BY round((coalesce(tpr, 0) + tnr) / 2, 9) DESC, abs(t - 0.5), t LIMIT 1""")
def q34_threshold(spark, sf_dir):
    return metrics.select_threshold(_labelled(spark, sf_dir), "y", "p").select("threshold", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query("""WITH x AS (SELECT o_totalprice - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders)
SELECT count(*)::BIGINT AS pairs, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 9) AS pairwise_accuracy, round(avg(d), 4) AS counterfactual_delta, round(stddev_samp(d), 4) AS counterfactual_delta_std FROM x WHERE d IS NOT NULL""")
def q35_paired(spark, sf_dir):
    """Every order of a customer paired with the next, so that all orders of a customer with two or more take part."""
    from pyspark.sql import Window as W

    later = F.lead(F.struct("o_totalprice")).over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_totalprice").alias("own"), later.alias("later")).filter("later is not null")
    sides = F.array(F.struct(F.lit(1).alias("y"), F.col("own").alias("p")), F.struct(F.lit(0).alias("y"), F.col("later.o_totalprice").alias("p")))
    rows = x.select("pair", F.inline(sides))
    return metrics.paired(rows, "y", "p", "pair").select("pairs", F.round("pairwise_accuracy", 9).alias("pairwise_accuracy"), *[F.round(c, 4).alias(c) for c in ("counterfactual_delta", "counterfactual_delta_std")])


@query(f"""WITH {LABELLED}, c AS (SELECT sum(y * (p >= 0.05)::INTEGER)::DOUBLE AS tp, sum((1 - y) * (p >= 0.05)::INTEGER)::DOUBLE AS fp, sum((1 - y) * (p < 0.05)::INTEGER)::DOUBLE AS tn, sum(y * (p < 0.05)::INTEGER)::DOUBLE AS fn, avg((p - y) * (p - y)) AS brier FROM s)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, round(brier, 9) AS brier FROM c""")
def q36_confusion_mcc(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir), "y", "p", 0.05).select("tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("balanced_accuracy", "mcc", "brier")])


@query(f"""WITH {ROWS} SELECT fold, count(*)::BIGINT AS n, round(sum(m), 4) AS s_0, round(sum(d), 4) AS s_1, round(sum(t), 4) AS s_2, round(sum(m * m), 4) AS g_0_0, round(sum(m * d), 4) AS g_0_1, round(sum(m * t), 4) AS g_0_2,
 round(sum(d * d), 4) AS g_1_1, round(sum(d * t), 4) AS g_1_2, round(sum(t * t), 4) AS g_2_2 FROM x GROUP BY fold""")
def q37_fold_moments(spark, sf_dir):
    out = models.fold_moments(_rows(spark, sf_dir), "fold", ["m", "d"], "t")
    return out.select("fold", "n", *[F.round(c, 4).alias(c) for c in out.columns if c[0] in "sg"])


@query()
def q39_nested_logistic(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("a"), (F.length(F.regexp_replace("text", "[^#*$%&|!]", "")) / (1 + F.col("n_chars"))).alias("b"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("fold", F.col("doc_id") % 5)
    rows = kept(rows)  # read once for each step of the fit
    out = models.nested_binary(rows, "fold", ["a"], ["b"], "y")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(metrics.log_loss(F.col("y"), F.col("p0")), 3).alias("log_loss_m0"), F.round(metrics.log_loss(F.col("y"), F.col("p1")), 3).alias("log_loss_m1"))


@query(f"WITH {ROWS} SELECT chrom, round(sum((g - 1000 * m) * (g - 1000 * m)) / 1e6, 4) AS sse0, round(sum((g - 1500 * m) * (g - 1500 * m)) / 1e6, 4) AS sse1 FROM x GROUP BY chrom")
def q40_sse_by_chrom(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumns({"p0": 1000 * F.col("m"), "p1": 1500 * F.col("m")})
    return models.sse_by_block(rows, "chrom", "g").select("chrom", *[F.round(F.col(c) / 1e6, 4).alias(c) for c in ("sse0", "sse1")])


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, (l_suppkey % 22)::BIGINT AS g, l_quantity,
  row_number() OVER (PARTITION BY l_suppkey % 22 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey % 22) AS n FROM lineitem),
 v AS (SELECT g * 100000000 + (i + 1 + length('chr' || (g + 1)) * 17) % n AS k, l_quantity FROM x)
SELECT x.l_orderkey, x.l_partkey, x.l_suppkey, x.l_linenumber::BIGINT AS line, x.l_extendedprice, v.l_quantity FROM x JOIN v ON x.g * 100000000 + x.i = v.k""")
def q41_shift_null(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 22).cast("string")).alias("chrom"), "l_quantity")
    shifts = spark.createDataFrame([(f"chr{i}", 1 + len(f"chr{i}") * 17) for i in range(1, 23)], "chrom string, shift int")
    out = models.shift_within(rows, ["chrom"], KEY, ["l_quantity"], shifts)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice", "l_quantity")


def _lehmer_sql(key: str, draw: str, seed: int) -> str:
    """The uniform numbers of models.uniform."""
    x = f"(({key} % 2147483647) * 48271 + ({draw} + 1) * 69621 + {seed + 1} * 16807) % 2147483647"
    for m in (16807, 39373, 48271):
        x = f"(({x} + 90211) * {m}) % 2147483647"
    return f"({x}) / 2147483647.0::DOUBLE"


@query(f"""WITH d AS (SELECT c_acctbal AS v, {_lehmer_sql('c_custkey', 'b', 7)} AS u, b FROM customer, range(200) r(b)),
 w AS (SELECT b, v, {' + '.join(f'(u >= {float(s)!r}::DOUBLE)::INTEGER' for s in models.POISSON)} AS w FROM d), m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY b)
SELECT round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def q42_bootstrap(spark, sf_dir):
    out = models.bootstrap_mean(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 200, 7)
    return out.select(*[F.round(c, 4).alias(c) for c in ("median", "low", "high")])


PAIRS = """pr AS (SELECT cn.n_name AS bait, sn.n_name AS prey, any_value(cn.n_regionkey) AS bf, any_value(sn.n_regionkey) AS pf, max((l_discount > 0.09 AND l_quantity > 45)::INTEGER) AS cooperative_signal,
 max((l_tax < 0.01 AND l_quantity > 40)::INTEGER) AS composite_motif, max((l_quantity < 2)::INTEGER) AS spacing_or_orientation
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2)"""


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    c = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("bait"), F.col("n_regionkey").alias("bf"))
    s = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("prey"), F.col("n_regionkey").alias("pf"))
    flag = lambda x: F.max(x.cast("int"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    q = F.col("l_quantity")
    # a row for each pair of nations, kept: what follows reads them several times, and the joins are made once
    return kept(rows.groupBy("bait", "prey").agg(
        F.first("bf").alias("bf"), F.first("pf").alias("pf"), flag((F.col("l_discount") > 0.09) & (q > 45)).alias("cooperative_signal"),
        flag((F.col("l_tax") < 0.01) & (q > 40)).alias("composite_motif"), flag(q < 2).alias("spacing_or_orientation"),
    ))


@query(f"""WITH {PAIRS}, tr AS (SELECT * FROM pr WHERE pf <> 2), r AS (SELECT bf, pf, (sum(cooperative_signal) + 1.0::DOUBLE) / (count(*) + 2) AS rate FROM tr GROUP BY ALL)
SELECT bait, prey, round(coalesce(rate, (SELECT (sum(cooperative_signal) + 1.0::DOUBLE) / (count(*) + 2) FROM tr)), 9) AS probability FROM pr LEFT JOIN r USING (bf, pf)""")
def q43_smoothed_rate(spark, sf_dir):
    p = nation_pairs(spark, sf_dir)
    return pairs.apply_rates(p, p.filter("pf <> 2"), ["bf", "pf"], "cooperative_signal").select("bait", "prey", F.round("probability", 9).alias("probability"))


@query(f"""WITH {PAIRS}, known AS (SELECT n_name AS tf FROM nation WHERE n_nationkey % 6 <> 1), dp AS (SELECT bait, prey, 'F' || bf AS bait_family, 'F' || pf AS prey_family, cooperative_signal AS y FROM pr WHERE bait IN (SELECT tf FROM known) AND prey IN (SELECT tf FROM known))
SELECT d.bait, d.prey, d.bait || '->' || d.prey AS directed_pair, least(d.bait_family, d.prey_family) || '|' || greatest(d.bait_family, d.prey_family) AS family_pair, d.y AS cooperative_signal, coalesce(d.y <> o.y, false) AS asymmetric
 FROM dp d LEFT JOIN dp o ON d.bait = o.prey AND d.prey = o.bait""")
def q44_directed_pairs(spark, sf_dir):
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 1").select(F.col("n_name").alias("tf"), F.concat(F.lit("F"), F.col("n_regionkey").cast("string")).alias("family"), F.col("n_name").alias("protein_sequence"))
    d = pairs.directed_pairs(nation_pairs(spark, sf_dir).drop("bf", "pf"), known)
    other = d.select(F.col("bait").alias("prey"), F.col("prey").alias("bait"), F.col("cooperative_signal").alias("o"))
    return d.join(other, ["bait", "prey"], "left").select("bait", "prey", "directed_pair", "family_pair", "cooperative_signal", F.coalesce(F.col("o") != F.col("cooperative_signal"), F.lit(False)).alias("asymmetric"))


@query(f"""WITH {PAIRS}, r AS (SELECT bait AS tf, * FROM pr UNION ALL SELECT prey, * FROM pr WHERE bait <> prey)
SELECT tf, sum(cooperative_signal)::BIGINT AS n_cooperative_signal, sum(composite_motif)::BIGINT AS n_composite_motif, sum(spacing_or_orientation)::BIGINT AS n_spacing_or_orientation FROM r GROUP BY tf
 HAVING sum(cooperative_signal) >= 10 AND sum(composite_motif) >= 5 AND sum(spacing_or_orientation) >= 5""")
def q45_eligible_panel(spark, sf_dir):
    return pairs.eligible_panel(nation_pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT CASE WHEN bait = 'NATION_3' OR prey = 'NATION_3' OR bait = 'CHINA' OR prey = 'CHINA' THEN 'test' ELSE 'train' END AS split, bait, prey FROM pr")
def q46_leave_one_out(spark, sf_dir):
    p = nation_pairs(spark, sf_dir)
    names = [r[0] for r in p.select("bait").distinct().filter(F.col("bait").isin("NATION_3", "CHINA")).collect()]
    train, test = pairs.leave_one_out(p, names[0])
    return train.select(F.lit("train").alias("split"), "bait", "prey").unionByName(test.select(F.lit("test").alias("split"), "bait", "prey"))


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM events GROUP BY event_type")
def q58_summary_mean_std(spark, sf_dir):
    return metrics.summarise(table(spark, sf_dir, "events"), ["event_type"], ["value"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("value_mean", "value_std")])


@query("SELECT round(center, 6) AS center, round(greatest(1.4826::DOUBLE * median(abs(o_totalprice - center)), 1e-6), 4) AS scale FROM orders, (SELECT median(o_totalprice) AS center FROM orders) GROUP BY center")
def q64_robust_scale(spark, sf_dir):
    return metrics.robust_scale(table(spark, sf_dir, "orders"), "o_totalprice").select(F.round("center", 6).alias("center"), F.round("scale", 4).alias("scale"))
