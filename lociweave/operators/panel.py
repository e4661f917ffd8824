"""Baselines of directed pairs, evaluated with one factor left out at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequence import AMINO_ACIDS
from lociweave.operators import metrics
from lociweave.operators.loci import chromosome_fold, require_columns
from lociweave.operators.models import cross_fitted_residuals, nested_binary, nested_continuous
from lociweave.operators.pairs import apply_rates, eligible_panel, fitted, identity_baseline, leave_one_out, protein_features
from lociweave.operators.scale import kept

#: Columns that are, or begin like, baseline features.
BASELINE_PREFIXES = ("ght_", "focal_monomer", "partner_monomer", "gc_", "cpg_", "n_fraction", "dnase", "atac", "tss_", "expression")


def family_rate(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    return apply_rates(test, train, ["bait_family", "prey_family"], target)


def kmer_baseline(train: DataFrame, test: DataFrame, target: str, k: int = 2, c: float = 1.0) -> DataFrame:
    """test with probability by class-balanced logistic regression on standardised k-mer features of both proteins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mers = [""]
    for _ in range(k):
        mers = [m + a for m in mers for a in AMINO_ACIDS]
    keys = F.array(*[F.lit(f"{p}:{m}") for p in "abdp" for m in mers])
    vector = lambda d: protein_features(d, k).withColumn("__x", array_to_vector(F.transform(keys, lambda n: F.coalesce(F.try_element_at("kmers", n), F.lit(0.0)))))
    s = train.agg(F.count("*").alias("n"), F.sum(target).alias("p")).first()
    rows = vector(train).withColumns({"__y": F.col(target).cast("double"), "__w": F.when(F.col(target) == 1, s.n / (2.0 * s.p)).otherwise(s.n / (2.0 * (s.n - s.p)))})
    steps = [
        StandardScaler(inputCol="__x", outputCol="__z", withMean=True),
        LogisticRegression(featuresCol="__z", labelCol="__y", weightCol="__w", regParam=1 / (c * s.n), standardization=False, maxIter=100, probabilityCol="__p", predictionCol="__q", rawPredictionCol="__r"),
    ]
    return fitted(steps, rows).transform(vector(test)).select(*test.columns, vector_to_array("__p")[1].alias("probability"))


BASELINES: dict[str, Callable[[DataFrame, DataFrame, str], DataFrame]] = {"family_rate": family_rate, "tf_identity": identity_baseline, "protein_kmer": kmer_baseline}


def evaluate_left_out(pairs: DataFrame, tf: str, target: str, models: dict | None = None) -> list[dict]:
    """A row of metrics for each baseline, trained without the factor's pairs and scored on them."""
    train, test = leave_one_out(pairs, tf)
    out = []
    for name, fit in (models or BASELINES).items():
        row = metrics.auroc_ap(fit(train, test, target), target, "probability").first().asDict()
        out.append({"tf": tf, "model": name} | row)
    return out


def evaluate_panel(pairs: DataFrame, target: str, least: tuple[int, int, int] = (10, 5, 5), models: dict | None = None) -> list[dict]:
    """The same for every eligible factor, a short list: each is fitted on its own, the metrics of all come from one job."""
    scored = None
    for r in sorted(eligible_panel(pairs, least).collect()):
        train, test = leave_one_out(pairs, r.tf)
        for name, fit in (models or BASELINES).items():
            own = fit(train, test, target).select(F.lit(r.tf).alias("tf"), F.lit(name).alias("model"), F.col(target).cast("int").alias("__y"), F.col("probability").alias("__p"))
            scored = own if scored is None else scored.unionByName(own)
    if scored is None:
        return []
    order = {n: i for i, n in enumerate(models or BASELINES)}
    rows = metrics.auroc_ap(kept(scored), "__y", "__p", ["tf", "model"]).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: (r.tf, order[r.model]))]


def baseline_features(df: DataFrame) -> list[str]:
    """Numeric columns that are, or begin like, baseline features."""
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c.startswith(BASELINE_PREFIXES)]


def continuous_frame(genes: DataFrame, results: DataFrame, added: str, outcome: str = "gcm1_dependence", folds: int = 5) -> DataFrame:
    """Gene features with a finite expression outcome and the chromosome fold; genes without results go, a missing added column is an error."""
    require_columns(genes, ["gene", "chrom", added], "gene features")
    return genes.join(results.select("gene", outcome), "gene").filter(metrics.finite(F.col(outcome))).withColumn("fold", chromosome_fold(F.col("chrom"), folds))


def grammar_score(df: DataFrame, profiles: list[str], focal: str, partners: list[str], fold: str, bins: int = 20, out: str = "grammar_score") -> DataFrame:
    """df with the mean over profiles of what is left of each when the monomers in its bins of focal and own partner are taken out, cross-fitted over folds."""
    rest = []
    for k, (profile, partner) in enumerate(zip(profiles, partners, strict=True)):
        df = cross_fitted_residuals(df, profile, [focal, partner], fold, bins, f"__r{k}")
        rest.append(F.col(f"__r{k}"))
    return df.withColumn(out, sum(rest[1:], rest[0]) / len(rest)).drop(*(f"__r{k}" for k in range(len(rest))))


def profile_scores(scores: DataFrame, locus: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(locus, pair, mechanism, score): the best model of each pair and mechanism. scores has a column for each model; columns: model to (pair, mechanism)."""
    rows = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(m).alias("mechanism"), F.col(f"`{c}`").alias("score")) for c, (p, m) in columns.items()])
    return scores.select(locus, F.explode(rows).alias("x")).groupBy(locus, "x.pair", "x.mechanism").agg(F.max("x.score").alias("score"))


def pair_balanced(profiles: DataFrame, locus: str) -> DataFrame:
    """(locus, score): the mean over pairs of the mean over a pair's mechanisms."""
    return profiles.groupBy(locus, "pair").agg(F.avg("score").alias("m")).groupBy(locus).agg(F.avg("m").alias("score"))


def continuous_benchmark(genes: DataFrame, results: DataFrame, added: str, outcome: str = "gcm1_dependence", folds: int = 5) -> tuple[DataFrame, dict]:
    """Gene features joined with an expression outcome: nested models over chromosome folds."""
    rows = continuous_frame(genes, results, added, outcome, folds)
    return nested_continuous(rows, "fold", baseline_features(genes), [added], outcome)


def target_benchmark(genes: DataFrame, targets: DataFrame, added: str, folds: int = 5) -> DataFrame:
    """Log loss and areas of both nested models for membership in a gene set."""
    marked = genes.join(F.broadcast(targets.select("gene").distinct().withColumn("__t", F.lit(1))), "gene", "left").withColumns({"y": F.coalesce("__t", F.lit(0)), "fold": chromosome_fold(F.col("chrom"), folds)}).drop("__t")
    scored = nested_binary(marked, "fold", baseline_features(genes), [added], "y")
    return scored.agg(F.count("*").alias("n"), F.sum("y").alias("positives"), metrics.log_loss(F.col("y"), F.col("p0")).alias("log_loss_m0"), metrics.log_loss(F.col("y"), F.col("p1")).alias("log_loss_m1"))


def supported_aggregates(scores: DataFrame, support: DataFrame, locus: str, partner: str = "partner", score: str = "score", raw: str = "raw") -> DataFrame:
    """(locus, pair_mean, partner_max) over the partners with expression: the mean over partners of each one's mean score, and the largest raw score.

    scores: a row for each locus, partner and model. support: (partner, expression_supported), a short list; a partner that isn't in it is not supported.
    """
    own = scores.join(F.broadcast(support.filter("expression_supported").select(partner).distinct()), partner, "left_semi")
    by = own.groupBy(locus, partner).agg(F.avg(score).alias("__m"), F.max(raw).alias("__r"))
    return by.groupBy(locus).agg(F.avg("__m").alias("pair_mean"), F.max("__r").alias("partner_max"))


def count_columns(df: DataFrame, wild: int = 4, knocked_out: int = 2) -> list[str]:
    """The columns of counts of the wild type (WT in the name) and of the knock-out (KO), in this order; any other number of them is an error."""
    named = lambda mark: [c for c in df.columns if re.search(rf"(?:^|[^A-Za-z]){mark}(?:[^A-Za-z]|$)", c, re.I)]
    wt, ko = named("WT"), named("KO")
    if len(wt) != wild or len(ko) != knocked_out or set(wt) & set(ko):
        raise ValueError(f"{wild} WT and {knocked_out} KO columns are needed, there are {len(wt)} and {len(ko)}")
    return wt + ko
