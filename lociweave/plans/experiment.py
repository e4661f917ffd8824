"""The experiment: seeds by models, trained on generated pairs, evaluated under several conditions, with summaries, charts and provenance."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import pwm
from lociweave.neural import networks, training
from lociweave.operators import audit, metrics, synth
from lociweave.operators.figures import bar_chart
from lociweave.operators.sinks import write_tsv
from lociweave.records import Condition, ExperimentPlan
from lociweave.sources import writers

#: The baseline that needs no training: the lesser of both motifs' best scores, scaled on the training set.
PRESENCE = "pwm_presence"
METRICS = ("auroc", "auprc", "balanced_accuracy", "mcc", "brier", "ece", "pairwise_accuracy", "mass_mean")


def generated(spark: SparkSession, plan: ExperimentPlan, condition: Condition, a: np.ndarray, b: np.ndarray, pairs: int, seed: int) -> DataFrame:
    """The labelled pairs of one condition."""
    anchors = None if plan.anchor_max is None else (plan.anchor_min, plan.anchor_max)
    return synth.matched_pairs(
        spark, a, b, pairs, plan.sequence_length, (condition.gap_min, condition.gap_max), condition.background_gc, condition.background_persistence, condition.allow_reverse,
        plan.period, tuple(plan.phases), seed, condition.motif_temperature, anchors,
    )


def evaluation(y: np.ndarray, p: np.ndarray, pair: np.ndarray, threshold: float) -> dict[str, float]:
    """The metrics of operators.metrics for a set in memory, which a task evaluates itself."""
    y = y.astype(float)
    order = np.argsort(-p, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    tp = np.cumsum(y[order])[cuts]
    fp = cuts + 1 - tp
    pos, neg = y.sum(), len(y) - y.sum()
    gained, lost = np.diff(tp, prepend=0), np.diff(fp, prepend=0)
    hit = p >= threshold
    a, b, c, d = ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 0)).sum(), (~hit & (y == 1)).sum())
    product = float(a + b) * (a + d) * (c + b) * (c + d)
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs(p[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    by = pd.DataFrame({"pair": pair, "y": y, "p": p}).pivot(index="pair", columns="y", values="p")
    gap = by[1.0] - by[0.0]
    return {
        "auroc": float((lost * (tp - gained / 2)).sum() / (pos * neg)), "auprc": float((gained * tp / (tp + fp)).sum() / pos), "balanced_accuracy": float((a / (a + d) + c / (c + b)) / 2),
        "mcc": float((a * c - b * d) / np.sqrt(product)) if product else 0.0, "brier": float(((p - y) ** 2).mean()), "ece": float(ece),
        "pairwise_accuracy": float(((gap > 0) + 0.5 * (gap == 0)).mean()), "counterfactual_delta": float(gap.mean()),
    }


def best_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """The threshold of the highest balanced accuracy; of equal ones that next to a half."""
    options = np.unique(np.concatenate([p, [0.0, 1.0]]))
    scores = [((p >= t) & (y == 1)).sum() / max(1, (y == 1).sum()) + ((p < t) & (y == 0)).sum() / max(1, (y == 0).sum()) for t in options]
    best = max(np.round(scores, 12))
    return float(min((t for t, s in zip(options, scores) if round(s, 12) == best), key=lambda t: (abs(t - 0.5), t)))


def _mask(frame: pd.DataFrame, length: int) -> np.ndarray:
    at = np.arange(length)
    return sum(((frame[f"start_{m}"].to_numpy()[:, None] <= at) & (at < frame[f"end_{m}"].to_numpy()[:, None])) for m in "ab").astype(float)


def run_experiment(spark: SparkSession, plan: ExperimentPlan, a: np.ndarray, b: np.ndarray, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, summary): a row for each seed, model and evaluation, and their means and deviations over seeds.

    Each seed and model is a task: it trains, chooses its threshold on validation and evaluates all conditions. The sets have a bounded, configured size and travel
    with the function. With out, both tables, the sets' manifests, charts and the provenance are written below it.
    """
    wanted = ["pair_id", "label", "sequence", "start_a", "end_a", "start_b", "end_b"]
    sets: dict[int, dict[str, pd.DataFrame]] = {}
    for seed in plan.seeds:
        parts = {"train": (plan.train, plan.train_pairs), "validation": (plan.train, plan.validation_pairs)} | {k: (c, plan.test_pairs) for k, c in plan.evaluations.items()}
        sets[seed] = {k: generated(spark, plan, c, a, b, n, synth.derive_seed(seed, k)).select(*wanted).toPandas() for k, (c, n) in parts.items()}
    shared = spark.sparkContext.broadcast(sets)
    models, options, length, names = dict(plan.models), dict(plan.training), plan.sequence_length, list(plan.evaluations)
    odds = [np.log(np.clip(m, 1e-8, 1) / 0.25) for m in (a, b)]

    def cell(seed: int, model: str) -> list[dict]:
        own = shared.value[seed]
        if model == PRESENCE:
            raw = {k: pwm.maximum_scores(d["sequence"].tolist(), odds).min(1) for k, d in own.items()}
            center = np.median(raw["train"])
            scale = max(1.4826 * np.median(np.abs(raw["train"] - center)), 1e-6)
            predict, network = (lambda k: 1 / (1 + np.exp(-np.clip((raw[k] - center) / scale, -30, 30)))), None
            losses, epochs = float("nan"), 0
        else:
            arrays = {k: training.encode(d["sequence"].tolist()) for k, d in own.items()}
            data = {k: (arrays[k], own[k]["label"].to_numpy(np.float32)) for k in ("train", "validation")}
            done = training.fit(networks.build(model, length, models[model], seed), data["train"], data["validation"], seed=seed, **options)
            network, losses, epochs = done.network, done.best_validation_loss, done.epochs_completed
            predict = lambda k: training.probabilities(network, arrays[k]).astype(float)
        threshold = best_threshold(own["validation"]["label"].to_numpy(), predict("validation"))
        rows = []
        for k in names:
            d = own[k]
            row = {"seed": seed, "model": model, "evaluation": k, "threshold": threshold, "validation_loss": losses, "epochs": epochs}
            row |= evaluation(d["label"].to_numpy(), predict(k), d["pair_id"].to_numpy(), threshold)
            where = d["label"].to_numpy() == 1
            row |= training.localisation(network, arrays[k][where], _mask(d[where], length)) if network else {"mass_mean": float("nan"), "mass_std": float("nan"), "coverage": float(_mask(d, length).mean())}
            rows.append(row)
        return rows

    columns = ["seed", "model", "evaluation", "threshold", "validation_loss", "epochs", "auroc", "auprc", "balanced_accuracy", "mcc", "brier", "ece", "pairwise_accuracy", "counterfactual_delta", "mass_mean", "mass_std", "coverage"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed, model in zip(frame["seed"], frame["model"]):
                yield pd.DataFrame(cell(int(seed), model))[columns]

    cells = spark.createDataFrame([(int(s), m) for s in plan.seeds for m in models], "seed long, model string").repartition(len(plan.seeds) * len(models))
    kinds = {"seed": "long", "epochs": "long", "model": "string", "evaluation": "string"}
    found = cells.mapInPandas(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns)).toPandas()  # a row for each seed, model and evaluation
    table = spark.createDataFrame(found.sort_values(["seed", "model", "evaluation"]))
    summary = metrics.summarise(table, ["model", "evaluation"], list(METRICS))
    if out:
        write_tsv(table, f"{out}/metrics")
        write_tsv(summary, f"{out}/summary")
        for seed, own in sets.items():
            for k, d in own.items():
                write_tsv(spark.createDataFrame(d.drop(columns="sequence")), f"{out}/manifests/seed={seed}/{k}")
        rows = summary.toPandas()
        for m in ("balanced_accuracy", "pairwise_accuracy"):
            writers.put(spark, f"{out}/figures/{m}.svg", bar_chart(rows, "evaluation", "model", f"{m}_mean", f"{m}_std", m).encode())
        text = json.dumps(plan, default=lambda x: dict(x) if hasattr(x, "keys") else x.__dict__, sort_keys=True)
        writers.put(spark, f"{out}/metadata.json", audit.json_text({"plan": json.loads(text), "plan_sha256": hashlib.sha256(text.encode()).hexdigest(), "python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__, "device": training.resolve_device(), "motifs": [pwm.consensus(m) for m in (a, b)]}).encode())
    return table, summary


def accuracy_ranking(summary: DataFrame, column: str = "balanced_accuracy_mean") -> DataFrame:
    """Models by their mean, the best first."""
    return summary.groupBy("model").agg(F.avg(column).alias("accuracy")).orderBy(F.desc("accuracy"), "model")
