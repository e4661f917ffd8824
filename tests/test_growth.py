"""What grows with the tables: work in as many tasks as there are cores, and memory that doesn't follow the batches."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lociweave.functions import pwm
from lociweave.functions import sequence as S
from lociweave.operators import pairs

SF = "/root/testdata/sf0.001"


def test_features_of_a_table_of_one_split_are_made_by_all_cores(spark):
    rows = spark.createDataFrame([(i, "ACDEFG" * 3, "KLMN") for i in range(64)], "i int, bait_sequence string, prey_sequence string").coalesce(1)
    out = pairs.protein_features(rows, 2)
    tasks = {r.t for r in out.select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    assert {len(r.kmers) for r in out.collect()} == {4 * (6 + 3)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["q115_protein_features", "q26_kmer_vector"])
def test_maps_are_worked_out_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan and "RepartitionByExpression" not in plan and "Repartition" in plan


def test_no_features_without_windows(spark):
    rows = spark.createDataFrame([(1, "A", "C"), (2, "", None), (3, "AC", "")], "i int, bait_sequence string, prey_sequence string")
    assert {r.i: dict(r.kmers or {}) for r in pairs.protein_features(rows, 2).collect()}[3] == {"a:AC": 1.0, "b:AC": 0.0, "d:AC": 1.0, "p:AC": 0.0}
    assert spark.createDataFrame([("A",), ("AC",)], "p string").select(F.explode(pwm.kmer_columns(F.col("p"))).alias("k", "v")).count() == 1


def test_sequence_expressions_against_python(spark):
    rng = random.Random(2)
    letters = [*"ACGTacgtNn \n\0", "é", "İ", "😀"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 80))) for _ in range(400)] + ["CGCGCG", ""]
    s = S.canonical(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", s.alias("s"))
    rows = rows.select("t", "s", *[f(F.col("s")).alias(n) for n, f in (("gc", S.gc_fraction), ("cpg", S.cpg_per_100bp), ("n", S.n_fraction))]).collect()
    for r in rows:
        if r.t is None:
            assert r.s is r.gc is r.cpg is r.n is None
            continue
        want = "".join(c.upper() if c in "ACGTacgt" else "N" for c in r.t)
        known = sum(c in "ACGT" for c in want)
        assert r.s == want
        assert r.gc == (want.count("G") + want.count("C")) / max(known, 1)
        assert r.cpg == 100.0 * want.count("CG") / max(len(want) - 1, 1)
        assert r.n == (len(want) - known) / max(len(want), 1)


def test_scans_take_no_more_memory_for_larger_batches(spark):
    rng = np.random.default_rng(4)
    odds = [pwm.log_odds(pwm.probabilities(rng.integers(0, 9, (n, 4)) + 1.0)) for n in (3, 2)]
    peaks = []
    for n in (4_000, 16_000):
        batch = pa.array(["".join(rng.choice(list("ACGTN"), 1000))] * n)
        tracemalloc.start()
        best, spaced = pwm.maximum_scores(batch, odds), pwm.spaced_scores(batch, *odds, (0, 2))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(np.unique(best, axis=0)) == 1 and len(np.unique(spaced)) == 1
    assert peaks[1] < 64 << 20 and peaks[1] < peaks[0] + 4 * 12_000 * 8 * 4


def test_scans_of_arrow_batches_equal_those_of_lists(monkeypatch):
    rng = random.Random(3)
    odds = [pwm.log_odds(pwm.probabilities(np.random.default_rng(n).integers(0, 9, (n, 4)) + 1.0)) for n in (3, 2, 3)]
    for part in (1 << 20, 40):
        monkeypatch.setattr(pwm, "_PART", part)
        for _ in range(40):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices("ACGTacgtNé😀", k=rng.choice([0, 1, 2, 9, 50]))) for _ in range(rng.randrange(0, 9))]
            batch = pa.array(["ACG", *texts, "TTT"], pa.string())[1 : len(texts) + 1]
            alone = [pwm.maximum_scores([t], odds)[0] for t in texts]
            assert np.array_equal(pwm.maximum_scores(batch, odds), np.array(alone).reshape(len(texts), 3))
            assert np.array_equal(pwm.spaced_scores(batch, *odds[:2], (0, 2, 5)), [pwm.spaced_score(t, *odds[:2], (0, 2, 5)) for t in texts])
