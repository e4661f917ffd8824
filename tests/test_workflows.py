import json

import numpy as np
from pyspark.sql import functions as F

from lociweave import cli
from lociweave.functions.pwm import probabilities
from lociweave.operators.loci import tile_counts
from lociweave.plans import workflows
from lociweave.streaming.tiles import streaming_tile_counts


def test_build_loci_command(spark, tmp_path):
    head = "chr\tstart\tstop\tname\tcoefficient.br\tcoefficient.ar\tfull_LL\treduced_LL\tpvalue\tfdr\n"
    (tmp_path / "ght.tsv").write_text(head + "chr1\t80\t160\ta\t1\t1\t1\t1\t0.01\t0.01\n")
    (tmp_path / "chip.narrowPeak").write_text("chr1\t150\t230\tx\t1\t.\t1\t1\t1\t40\n")
    assert cli.main(["build-loci", "--tf", "GCM1", "--ght", str(tmp_path / "ght.tsv"), "--chip", str(tmp_path / "chip.narrowPeak"), "--out", str(tmp_path / "o"), "--manifest", str(tmp_path / "m.json")]) == 0
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["counts"] == {"rows": 1, "chip_source": 1, "ght_source": 1, "outcome_used_for_selection": 0, "outcome_used_for_centering": 0}
    assert all(len(a["sha256"]) == 64 for a in m["assets"])


def test_screening_finds_an_added_signal(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(440):
        b, g = rng.normal(size=2)
        rows.append((f"L{i}", f"chr{i % 22 + 1}", i * 10, float(b), float(g), float(b + 0.8 * g + 0.2 * rng.normal())))
    f = spark.createDataFrame(rows, "locus_id string, chrom string, start long, b double, g double, y double")
    out = workflows.screening(f, ["b"], "g", "y", workflows.Contract(permutations=3, draws=100))
    assert out["partial_r2"] > 0.5 and out["p"] == 0.25 and not out["passed"]
    assert max(out["null"]) < 0.2


def test_presence_benchmark(spark):
    a, b = (probabilities(np.eye(4)[list(m)] * 20 + 1) for m in ((0, 1, 2, 0, 3, 2), (3, 2, 1, 1, 0, 0)))
    out = workflows.presence_benchmark(spark, a, b, 20)
    assert out["n"] == 40 and 0 <= out["auroc"] <= 1 and out["pairs"] == 20


def test_streaming_counts_equal_batch(spark, tmp_path):
    points = spark.range(500).select(F.concat(F.lit("chr"), (1 + F.col("id") % 3).cast("string")).alias("chrom"), (F.col("id") * 37 % 2000).alias("midpoint"))
    points.repartition(4).write.parquet(str(tmp_path / "p"))
    stream = streaming_tile_counts(spark.readStream.schema(points.schema).parquet(str(tmp_path / "p")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tiles").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("tiles").collect()} == {tuple(r) for r in tile_counts(points, 200).collect()}
