import json

import numpy as np
import pytest

from lociweave import records
from lociweave.functions import pwm
from lociweave.operators import metrics, synth
from lociweave.operators.figures import bar_chart
from lociweave.plans import experiment

A, B = (pwm.probabilities(np.eye(4)[list(m)] * 20 + 1) for m in ((0, 1, 2, 0, 3, 2), (3, 2, 1, 1, 0, 0)))
PLAN = {
    "seeds": (1, 2), "sequence_length": 60, "train_pairs": 30, "validation_pairs": 10, "test_pairs": 12, "anchor_min": 2, "anchor_max": 9, "train": {"gap_max": 20},
    "evaluations": {"iid": {"gap_max": 20}, "warm": {"gap_max": 20, "motif_temperature": 1.8, "allow_reverse": True}},
    "models": {"local_cnn": {"channels": 4, "kernel_size": 7}, experiment.PRESENCE: {}}, "training": {"epochs": 2},
}


def test_run_writes_everything(spark, tmp_path):
    table, summary = experiment.run_experiment(spark, records.ExperimentPlan.of(PLAN), A, B, str(tmp_path))
    rows = table.collect()
    assert {(r.seed, r.model, r.evaluation) for r in rows} == {(s, m, e) for s in (1, 2) for m in PLAN["models"] for e in ("iid", "warm")}
    assert all(0 <= r.auroc <= 1 and 0 <= r.threshold <= 1 for r in rows)
    assert all((r.model == experiment.PRESENCE) == (r.mass_mean != r.mass_mean) for r in rows)
    assert summary.count() == 4 and [r.accuracy for r in experiment.accuracy_ranking(summary).collect()] == sorted((r.accuracy for r in experiment.accuracy_ranking(summary).collect()), reverse=True)
    meta = json.loads((tmp_path / "metadata.json").read_text())
    assert meta["device"] == "cpu" and meta["plan"]["train"]["gap_max"] == 20 and len(meta["plan_sha256"]) == 64
    assert spark.read.csv(f"{tmp_path}/metrics", sep="\t", header=True).count() == 8
    assert spark.read.csv(f"{tmp_path}/manifests/seed=2/warm", sep="\t", header=True).count() == 24
    assert (tmp_path / "figures" / "balanced_accuracy.svg").read_text().count("<rect") >= 2
    again = experiment.run_experiment(spark, records.ExperimentPlan.of(PLAN), A, B)[0].collect()
    assert [r.auroc for r in again] == [r.auroc for r in rows]


def test_evaluation_in_memory_equals_the_tables(spark):
    rng = np.random.default_rng(3)
    y, p = np.tile([0, 1], 60), np.round(rng.random(120), 2)
    pair = np.repeat(np.arange(60), 2)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, p, pair)], "y int, p double, pair long")
    got = experiment.evaluation(y, p, pair, 0.4)
    want = metrics.auroc_ap(df, "y", "p").first().asDict() | metrics.confusion(df, "y", "p", 0.4).first().asDict() | metrics.paired(df, "y", "p", "pair").first().asDict() | metrics.calibration_error(df, "y", "p").first().asDict()
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-9), k
    best = metrics.select_threshold(df, "y", "p").first()
    assert experiment.best_threshold(y, p) == pytest.approx(best.threshold)


def test_conditions_change_what_is_generated(spark):
    make = lambda **k: synth.matched_pairs(spark, A, B, 20, 80, (0, 20), seed=3, reverse=False, **k).toPandas()
    assert make(anchors=(5, 9))["start_a"].between(5, 9).all()
    cold, warm = make(temperature=0.2), make(temperature=5.0)
    assert (cold["motif_a_instance"] == "ACGATG").mean() > 0.9 > (warm["motif_a_instance"] == "ACGATG").mean() + 0.3


def test_records_check_their_values():
    R = records
    bad = [
        lambda: R.Condition(gap_min=5, gap_max=3), lambda: R.Condition(background_gc=1.0), lambda: R.Condition(background_persistence=1.0), lambda: R.Condition(motif_temperature=0), lambda: R.Condition.of({"x": 1}),
        lambda: R.PeriodicRule(1), lambda: R.PeriodicRule(3, (0, 1, 2)), lambda: R.PeriodicRule(3, ()), lambda: R.Matrix("x", np.zeros((2, 4))), lambda: R.Matrix("x", np.ones((2, 3))), lambda: R.Spacing("a", "a", "", "", "", "A", "C", (1,) * 28),
        lambda: R.FileRecord("a", -1, "0" * 64), lambda: R.ExperimentPlan(seeds=()), lambda: R.GrammarProfile("p", A, B, ()), lambda: R.GrammarProfile("p", A, B, (-1,)), lambda: R.GrammarProfile("p", A, B, (1,), ("XX",)),
        lambda: pwm.profile_lookup([R.GrammarProfile("p", A, B, (1,))] * 2),
    ]
    for make in bad:
        with pytest.raises(ValueError):
            make()
    assert R.PeriodicRule(10, (11, 1, 9)).phases == (1, 9) and R.PeriodicRule(10, (1,)).positive(21)
    m = R.Matrix("m", [[2, 0, 0, 2], [0, 4, 0, 0]])
    assert len(m) == 2 and m.consensus == "AC" and m.bits == pytest.approx(3) and set(m.sample(np.random.default_rng(0))) <= set("ATC")
    assert R.MatrixRegistry({"m": m}).get("m") is m
    with pytest.raises(KeyError):
        R.MatrixRegistry({}).get("m")
    model = R.PairModel("A_B", "A_B", "ACN", "b", "s", 1, "3", np.ones((2, 4)))
    assert model.model_id == "A_B|ACN|b|s|1|3" and model.members == ("A", "B") and len(model.matrix()) == 2
    profile = R.PairProfile("A_B", "B", "spacing", (model,), (R.Monomer("x", "B", m),), "jaspar")
    assert profile.feature_id == "A_B::spacing"
    with pytest.raises(ValueError):
        R.Panel("A", R.Monomer("x", "A", m), (profile, profile))
    cell = R.Interaction("a", "b", "B", "A", "1-x", True, True, False)
    assert cell.positive and cell.pair == "A_B" and cell.raw_pair == "a_b"


def test_chart_without_values():
    import pandas as pd

    text = bar_chart(pd.DataFrame({"g": ["a", "b"], "s": ["x<", "x<"], "v": [0.5, float("nan")], "d": [0.1, 0.0]}), "g", "s", "v", "d", "t & u")
    assert "x&lt;" in text and "t &amp; u" in text and text.count("<title>") == 1


def test_monomers_by_id():
    m = records.Matrix("m", np.ones((3, 4)))
    x, y = records.Monomer("x", "A", m), records.Monomer("y", "A", m)
    assert records.monomers_by_id([x, y]) == {"x": x, "y": y}
    assert records.monomers_by_id([]) == {}
    with pytest.raises(ValueError):
        records.monomers_by_id([x, y, records.Monomer("x", "B", m)])
