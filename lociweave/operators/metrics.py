"""Evaluation metrics as exact distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.scale import quantiles, running_sums


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def average_rank(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """df with the mean rank of equal values. Ranks come from counts of distinct values, summed over ranges of values."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranks = running_sums(counts, value, {"__upto": "__n"}, keys=keys)
    ranks = ranks.select(*keys, F.col(value).alias("__v"), (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    cond = F.col(value) == F.col("__v")
    for k in keys:
        cond &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(ranks.alias("r"), cond).select("l.*", out)


def spearman(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    ranked = average_rank(average_rank(df, a, "__ra", keys), b, "__rb", keys)
    return ranked.groupBy(*(keys or [])).agg(F.corr("__ra", "__rb").alias("spearman"))


def replicate_qc(df: DataFrame, first: str, second: str) -> DataFrame:
    """n, spearman of log1p, zero shares of both and the median absolute difference of log1p, over finite pairs; values below 0 count as 0 in logs. Fewer than three pairs are an error."""
    ok = df.filter(finite(F.col(first)) & finite(F.col(second))).select(F.col(first).alias("a"), F.col(second).alias("b"))
    logs = ok.select("a", "b", *[F.log1p(F.greatest(F.col(c), F.lit(0))).alias(f"l{c}") for c in "ab"])
    stats = logs.agg(
        F.count("*").alias("n"), F.avg((F.col("a") == 0).cast("double")).alias("zero_first"), F.avg((F.col("b") == 0).cast("double")).alias("zero_second"),
    )
    stats = stats.withColumn("n", F.when(F.col("n") >= 3, F.col("n")).otherwise(F.raise_error(F.lit("three finite pairs are needed at least")).cast("long")))
    median = quantiles(logs, F.abs(F.col("la") - F.col("lb")), [0.5])["all"][0]
    stats = stats.withColumn("median_abs_log1p_difference", F.lit(median).cast("double"))
    return stats.crossJoin(spearman(logs, "la", "lb"))


def _curve(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg, tp, fp) by distinct score, cumulated from the highest."""
    keys = keys or []
    by = df.groupBy(*keys, F.col(score).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    by = by.withColumn("neg", F.col("n") - F.col("pos"))
    return running_sums(by, "p", {"tp": "pos", "fp": "neg"}, descending=True, keys=keys)


def auroc_ap(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """n, positives, prevalence, auroc, auprc (average precision), auprc_minus_prevalence and auprc_ratio, in one row, or a row for each group of keys, all in one job."""
    keys = keys or []
    c = _curve(df, label, score, keys)
    s = c.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    s = s.withColumn("prevalence", F.col("positives") / F.col("n"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    s = s.withColumns({
        "auroc": F.when(both, F.col("area") / (F.col("positives") * (F.col("n") - F.col("positives")))),
        "auprc": F.when(F.col("positives") > 0, F.col("ap") / F.col("positives")),
    })
    return s.select(*keys, "n", "positives", "prevalence", "auroc", "auprc", (F.col("auprc") - F.col("prevalence")).alias("auprc_minus_prevalence"), (F.col("auprc") / F.col("prevalence")).alias("auprc_ratio"))


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """The expected calibration error over equal bins, closed on the left, the last on both sides."""
    edges = F.array(*[F.lit(k * (1 / bins)) for k in range(1, bins)])
    by = df.groupBy(F.size(F.filter(edges, lambda e: e <= F.col(score))).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y")
    )
    return by.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def select_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold among 0, 1 and the scores with the best balanced accuracy; ties go to the nearest to 0.5, then the least."""
    c = _curve(df, label, score).select("p", "tp", "fp")
    y, v = F.col(label).cast("long"), F.col(score)
    total = df.agg(
        F.sum(y).alias("pos"), F.count("*").alias("n"),
        *[f(F.when(v >= t, k).otherwise(0)).alias(f"{name}{int(t)}") for t in (0.0, 1.0) for name, k, f in (("tp", y, F.sum), ("fp", 1 - y, F.sum))],
    )
    ends = total.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"tp{int(t)}").alias("tp"), F.col(f"fp{int(t)}").alias("fp")) for t in (0.0, 1.0)])).alias("e")).select("e.*")
    all_ = c.select(F.col("p").alias("t"), "tp", "fp").unionByName(ends).distinct().crossJoin(F.broadcast(total.select("pos", "n")))
    ba = (F.col("tp") / F.col("pos") + 1 - F.col("fp") / (F.col("n") - F.col("pos"))) / 2
    return all_.select(F.col("t").alias("threshold"), ba.alias("balanced_accuracy")).orderBy(F.desc(F.round("balanced_accuracy", 12)), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, balanced_accuracy, mcc and brier, in one row."""
    y, hit = F.col(label).cast("long"), (F.col(score) >= threshold).cast("long")
    s = df.agg(
        F.sum(y * hit).alias("tp"), F.sum((1 - y) * hit).alias("fp"), F.sum((1 - y) * (1 - hit)).alias("tn"), F.sum(y * (1 - hit)).alias("fn"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return s.select(
        "tp", "fp", "tn", "fn", ((tp / (tp + fn) + tn / (tn + fp)) / 2).alias("balanced_accuracy"),
        F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(0.0).alias("mcc"), "brier",
    )


def log_loss(label: Column, score: Column) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(label * F.log(p) + (1 - label) * F.log(1 - p))


def paired(df: DataFrame, label: str, score: str, pair: str) -> DataFrame:
    """Over pairs of one positive and one negative: accuracy with half for ties, mean and sample deviation of the difference."""
    by = df.groupBy(pair).agg(
        F.max(F.when(F.col(label) == 1, F.col(score))).alias("p"), F.max(F.when(F.col(label) == 0, F.col(score))).alias("q"), F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("y")
    )
    bad = (F.col("n") != 2) | (F.col("y") != 1)
    d = F.when(bad, F.raise_error(F.lit("a pair needs one positive and one negative")).cast("double")).otherwise(F.col("p") - F.col("q"))
    return by.select(d.alias("d")).agg(
        F.count("*").alias("pairs"), F.avg(F.when(F.col("d") > 0, 1.0).when(F.col("d") == 0, 0.5).otherwise(0.0)).alias("pairwise_accuracy"),
        F.avg("d").alias("counterfactual_delta"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("counterfactual_delta_std"),
    )


def quantile_summary(df: DataFrame, column: str) -> DataFrame:
    """min, median, p90, p99 and max, exact and linearly interpolated."""
    q = quantiles(df, column, [0.0, 0.5, 0.9, 0.99, 1.0])["all"]
    return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(n) for n, x in zip(("min", "median", "p90", "p99", "max"), q)])


def continuous(df: DataFrame, y: str, p: str) -> DataFrame:
    """n, mse, rmse, mae, r2 about the rows' own mean, and pearson, in one row."""
    e = F.col(y) - F.col(p)
    s = df.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"), F.corr(y, p).alias("pearson"))
    return s.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.col("v")).alias("r2"), "pearson")


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    """center (median) and scale (1.4826 times the median absolute deviation, 1e-6 at least)."""
    center = quantiles(df, column, [0.5])["all"][0]
    gap = quantiles(df, F.abs(F.col(column) - F.lit(center).cast("double")), [0.5])["all"][0]
    scale = None if gap is None else max(1.4826 * gap, 1e-6)
    return df.sparkSession.range(1).select(F.lit(center).cast("double").alias("center"), F.lit(scale).cast("double").alias("scale"))


def summarise(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
