import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lociweave.operators import panel
from lociweave.sources import supplements


def sheet(spark, rows):
    return spark.createDataFrame([(i + 1, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows)], "row_no long, cells array<string>")


def test_supplements(spark):
    m = supplements.interaction_matrix(sheet(spark, [["title"], ["Prey\\Bait", "FLI1", "RFXDC2"], ["GCM1", "1-FF, 2-FR", "0"], ["OTP", "N/A", "2-RR"], ["Section 2"], ["X", "1-A", "0"]])).collect()
    assert len(m) == 4 and {r.bait for r in m} == {"FLI1", "RFX7"}
    by = {(r.bait, r.prey): (r.tested, r.composite_motif, r.spacing_or_orientation) for r in m}
    assert by[("FLI1", "GCM1")] == (True, True, True) and by[("RFX7", "GCM1")] == (True, False, False) and by[("FLI1", "OTP")] == (False, False, False)
    block = [["Base", "FLI1_GCM1", "LIG", "b", "s", "2", "3", "composite", "YES"], ["A", 1, 0], ["C", 0, 1], ["G", 0, 0], ["T", 0, 0]]
    p = supplements.pwm_models(sheet(spark, [["Base", "TF_pairs", "x", "x", "x", "x", "x"], *block])).collect()
    assert [(r.pair, r.counts, r.representative, r.source_row) for r in p] == [("FLI1_GCM1", [[1, 0, 0, 0], [0, 1, 0, 0]], True, 2)]
    with pytest.raises(Exception, match="incomplete"):
        supplements.pwm_models(sheet(spark, block[:-1])).collect()
    head = ["TF1_TF2", "barcode", "batch", "type", "kmer1.kmer2", *[f"Count Gap {g}" for g in range(29)]]
    s = supplements.spacing_counts(sheet(spark, [head, ["FLI1_GCM1", "bc", "b", "t", "acgtac.TTTTTT", *range(29)]])).collect()
    assert s[0].gap_counts[28] == 28 and s[0].left_kmer == "ACGTAC"
    with pytest.raises(ValueError, match="0 to 28"):
        supplements.spacing_counts(sheet(spark, [head[:-1]]))


def test_rebuild_audit(spark):
    runs = spark.createDataFrame([("A", "r1", "e1"), ("A", "r2", "e1"), ("B", "r3", "e2")], "tf string, run string, experiment string")
    ex = spark.createDataFrame([("e1", "b1", True), ("e2", "b2", True)], "experiment string, batch string, approved boolean")
    files = spark.createDataFrame([("r1", "u", 10), ("r2", "u", 23), ("r3", "u", 27)], "run string, url string, size long")
    got = {r.scope: (r.runs, r["bytes"]) for r in supplements.rebuild_audit(runs, ex, files, ["A"]).collect()}
    assert got == {"all": (3, 60), "focal": (2, 33), "batch b1": (2, 33), "batch b2": (1, 27)}
    with pytest.raises(ValueError):
        supplements.rebuild_audit(runs, ex, files, ["Z"])


def test_left_out_baselines(spark):
    seen = Observation()  # a session that has observed anything can't go to tasks with a model
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 3
    rng = random.Random(4)
    tfs = {f"T{i}": (f"F{i % 3}", "".join(rng.choice("ACDEFGHIKL") for _ in range(30))) for i in range(9)}
    rows = [(a, b, int((i * 7 + j) % 3 == 0), 1, 1, tfs[a][0], tfs[b][0], tfs[a][1], tfs[b][1]) for i, a in enumerate(tfs) for j, b in enumerate(tfs)]
    pairs = spark.createDataFrame(rows, "bait string, prey string, cooperative_signal int, composite_motif int, spacing_or_orientation int, bait_family string, prey_family string, bait_sequence string, prey_sequence string")
    out = panel.evaluate_left_out(pairs, "T1", "cooperative_signal")
    assert [r["model"] for r in out] == ["family_rate", "tf_identity", "protein_kmer"] and all(r["n"] == 17 and 0 <= r["auroc"] <= 1 for r in out)
    two = {"family_rate": panel.family_rate, "half": lambda train, test, target: test.withColumn("probability", F.lit(0.5))}
    all_ = panel.evaluate_panel(pairs, "cooperative_signal", (1, 1, 1), two)
    assert len(all_) == 18 and [r["tf"] for r in all_][:3] == ["T0", "T0", "T1"] and all(r["auroc"] == 0.5 for r in all_ if r["model"] == "half")
    own = panel.evaluate_left_out(pairs, "T1", "cooperative_signal", two)
    assert [{k: r[k] for k in ("n", "positives", "auroc")} for r in all_ if r["tf"] == "T1"] == [{k: r[k] for k in ("n", "positives", "auroc")} for r in own]
