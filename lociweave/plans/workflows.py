"""End-to-end flows: locus tables, feature tables, screening with gates, and the synthetic benchmark."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import pwm
from lociweave.functions import sequence as S
from lociweave.operators import audit, intervals, loci, metrics, models, synth
from lociweave.operators.sinks import write_tsv
from lociweave.sources import binary, random_access, text


@dataclass(frozen=True)
class Contract:
    """The parameters that an analysis fixes before it begins."""

    width: int = 200
    context: int = 400
    folds: int = 5
    fdr: float = 0.05
    bins: int = 20
    permutations: int = 100
    final_permutations: int = 1000
    draws: int = 2000
    least_partial_r2: float = 0.005
    most_p: float = 0.05
    passing_factors: int = 4
    universe: str = "ght-only"
    calls_version: str = "codebook-v2"
    calls_format: str = "magix"
    positive_calls: bool = True
    pipeline: str = "Toronto_GPZN"
    replicates: int = 2
    confirm_direction: bool = True

    def validate(self, primary: bool = False) -> None:
        """The rules of every analysis, and with primary those of the primary one, whose sources are fixed."""
        loci.validate_width(self.width)
        loci.validate_width(self.context)
        rules = [
            (self.universe in loci.UNIVERSES, f"no such universe: {self.universe}"), (self.context >= self.width, "the context must hold the locus"), (self.folds >= 3, "there must be three folds at least"),
            (0 <= self.fdr <= 1, "the false discovery rate lies between 0 and 1"), (self.bins >= 2, "there must be two bins at least"), (self.permutations >= 1, "there must be a permutation at least"),
            (self.final_permutations >= self.permutations, "the final null has no fewer permutations than screening"), (self.draws >= 1, "there must be a draw at least"), (0 < self.most_p < 1, "a p value lies between 0 and 1"),
        ]
        if primary:
            rules += [
                (not loci.UNIVERSES.get(self.universe, ("", "", True, True))[2], "the primary universe is selected without the outcome"), (self.universe == "ght-only", "the primary universe is ght-only"),
                (self.calls_version == "codebook-v2", "the primary calls are of the corrected release"), (self.calls_format == "magix", "the primary calls have the magix format"), (self.positive_calls, "primary calls are positive"),
                (self.pipeline == "Toronto_GPZN", "primary outcomes come from one pipeline"), (self.replicates == 2, "the primary outcome has two replicates"), (self.confirm_direction, "both replicates must confirm the direction"),
            ]
        for ok, message in rules:
            if not ok:
                raise ValueError(message)

    def text(self) -> str:
        """As JSON, if it is valid."""
        self.validate()
        return audit.json_text(asdict(self))


def build_loci(spark: SparkSession, focal_tf: str, ght: str, chip: str | None, out: str, contract: Contract = Contract(), sizes: str | None = None) -> dict:
    """Write a locus table of one universe and its manifest; returns the counts."""
    contract.validate()
    calls = text.magix(spark, ght, contract.fdr)
    peaks = text.narrowpeak(spark, chip) if chip else None
    if contract.universe == "ght-only":
        table = loci.ght_only_loci(calls, focal_tf, contract.width, peaks)
    elif contract.universe == "assay-union":
        table = loci.assay_union_loci(peaks, calls, focal_tf, contract.width)
    elif contract.universe == "legacy-assay-union":
        table = loci.legacy_assay_union_loci(peaks, calls, focal_tf, contract.width)
    else:
        table = loci.fixed_genome_loci(text.chrom_sizes(spark, sizes), peaks, calls, focal_tf, contract.width)
    return write_tsv(table, out, gzip=True)


def feature_table(table: DataFrame, genome: DataFrame | str, focal: np.ndarray, partners: dict[str, np.ndarray], signals: dict[str, DataFrame | str], contract: Contract = Contract()) -> DataFrame:
    """Loci with sequence covariates, motif scores, interval signals and the log mean outcome of the signals named chip_rep*.

    genome: the path of a 2bit file, or its chunks; a signal: the path of a bigWig file, or intervals. Of files only what the loci need is read.
    """
    s = F.col("sequence")
    out = random_access.twobit_contexts(table, genome, contract.context) if isinstance(genome, str) else binary.contexts(table, genome, contract.context)
    scores = pwm.scan_column(s, {"focal": focal, **partners})
    out = out.withColumns({"gc_fraction": S.gc_fraction(s), "cpg_per_100bp": S.cpg_per_100bp(s), "n_fraction": S.n_fraction(s), "__m": scores})
    out = out.withColumns({"focal_monomer_score": F.col("__m")["focal"]} | {f"partner_raw::{p}": F.col("__m")[p] for p in partners}).drop("__m")
    for name, signal in signals.items():
        out = random_access.bigwig_statistic(out, signal, name) if isinstance(signal, str) else intervals.interval_mean(out, signal, name)
    reps = [n for n in signals if n.startswith("chip_rep")]
    if reps:
        logs = [F.log1p(F.col(r)) for r in reps]
        out = out.withColumn("chip_mean_log1p", sum(logs[1:], logs[0]) / len(reps))
    if partners:
        out = out.withColumn("partner_monomer_max", F.greatest(*[F.col(f"`partner_raw::{p}`") for p in partners]) if len(partners) > 1 else F.col(f"`partner_raw::{next(iter(partners))}`"))
    return out


def screening(features: DataFrame, baseline: list[str], added: str, outcome: str, contract: Contract = Contract(), seed: int = 0) -> dict:
    """Partial R2 of an added column over chromosome folds, its bootstrap interval, the shift null, all permutations in one job, and the gate."""
    from lociweave.plans import flows

    out = flows.screen(features, baseline, added, outcome, (), contract, seed)
    return out | {"null": out["permutation"]["null"]}


def presence_benchmark(spark: SparkSession, a: np.ndarray, b: np.ndarray, pairs: int, seed: int = 0) -> dict:
    """Train, validation and test pairs; the motif-presence baseline, its threshold chosen on validation, evaluated on test."""
    sets = {n: synth.matched_pairs(spark, a, b, pairs, seed=synth.derive_seed(seed, n)) for n in ("train", "validation", "test")}
    scored = {n: pwm.presence_scores(d, "sequence", a, b) for n, d in sets.items()}
    scale = metrics.robust_scale(scored["train"], "score").first()
    z = F.least(F.greatest((F.col("score") - scale.center) / scale.scale, F.lit(-30.0)), F.lit(30.0))
    with_p = {n: d.withColumn("p", 1 / (1 + F.exp(-z))) for n, d in scored.items()}
    threshold = metrics.select_threshold(with_p["validation"], "label", "p").first().threshold
    test = with_p["test"]
    parts = (metrics.auroc_ap(test, "label", "p"), metrics.confusion(test, "label", "p", threshold), metrics.calibration_error(test, "label", "p"), metrics.paired(test, "label", "p", "pair_id"))
    return {"threshold": threshold} | {k: v for part in parts for k, v in part.first().asDict().items()}
