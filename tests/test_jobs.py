"""The jobs over growing input, run again, and from the command line."""

import hashlib
import json
import os
import subprocess
import sys

import pytest

from jobs import locus_tables, sequence_features
from jobs.common import from_mapping

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def both(s):
    s = "".join(c if c in "ACGT" else "N" for c in s.upper())
    return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.fixture
def features(tmp_path):
    return sequence_features.Settings(input=f"{tmp_path}/in/*", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/mark")


def rows_of(spark, settings):
    return sorted(map(tuple, sequence_features.output(spark, settings).select("key", "batch", "split", "group", "digest", "first").collect()), key=str)


def test_only_what_is_new_is_taken(spark, tmp_path, features):
    put(spark, f"{tmp_path}/in", "a", [(1, "ACGTACGG", "007"), (2, "ccgtacgt", "s"), (3, "AAAAC", "s"), (9, None, None)])
    assert sequence_features.run(spark, features) == {"batches": 1, "read": 4, "written": 4, "first": 2}
    before = rows_of(spark, features)
    assert {(r[0], r[5]) for r in before} == {(1, True), (2, False), (3, True), (9, None)}
    assert {r[3] for r in before} == {"007", "s", None}
    assert sequence_features.run(spark, features) == {"batches": 0, "read": 0, "written": 0, "first": 0}
    assert rows_of(spark, features) == before
    put(spark, f"{tmp_path}/in", "b", [(0, "GTTTT", "t"), (4, "ACGTACGG", "t"), (5, "TTTTT", "t"), (5, "TTTTT", "t"), (6, "", "t")])
    assert sequence_features.run(spark, features) == {"batches": 1, "read": 5, "written": 5, "first": 3}
    after = rows_of(spark, features)
    assert [r for r in after if r[1] == 0] == before
    new = [r for r in after if r[1] == 1]
    assert {(r[0], r[5]) for r in new} == {(0, False), (4, False), (5, True), (6, True)}
    texts = {1: "ACGTACGG", 2: "ccgtacgt", 3: "AAAAC", 0: "GTTTT", 4: "ACGTACGG", 5: "TTTTT", 6: ""}
    splits = {}
    for key, _, split, _, digest, _ in after:
        if key != 9:
            assert digest == hashlib.sha256(both(texts[key]).encode()).hexdigest()
            assert splits.setdefault(digest, split) == split
            at = int(digest[:8], 16) / 2**32
            assert split == ("train" if at < 0.8 else "valid" if at < 0.9 else "test")


def test_a_batch_that_failed_is_run_again(spark, tmp_path, features, monkeypatch):
    put(spark, f"{tmp_path}/in", "a", [(i, "ACGT" * i, "s") for i in range(1, 20)])
    sequence_features.run(spark, features)
    put(spark, f"{tmp_path}/in", "b", [(i, "ACGT" * (i % 30), "s") for i in range(20, 60)])

    def broken(*_):
        raise OSError("the log is gone")

    with monkeypatch.context() as m:
        m.setattr(sequence_features.log, "info", lambda text, *a: broken() if text.startswith("batch") else None)
        with pytest.raises(Exception, match="log is gone"):
            sequence_features.run(spark, features)
    assert sequence_features.run(spark, features)["written"] == 40
    got = rows_of(spark, features)
    assert len(got) == 59 and sum(bool(r[5]) for r in got) == len({r[4] for r in got}) == 30


def test_shares(spark):
    with pytest.raises(ValueError, match="add up"):
        sequence_features.split_of(None, {"a": 0.5})
    with pytest.raises(ValueError, match="unknown settings: colour"):
        from_mapping(sequence_features.Settings, {"colour": 1})


CALLS = [("chip", "chr1", 150, 1.0, "a"), ("ght", "chr1", 199, 2.0, "b"), ("ght", "chr1", 10, 2.0, "a"), ("ght", "chr2", 450, 7.0, "c"), ("chip", "chr22", 0, 1.0, "d"), ("ght", "chrX", 5, 9.0, "e"), ("ght", "chr1", -1, 9.0, "f"), (None, "chr3", 5, 9.0, "g"), ("ght", None, 5, 1.0, "h")]


def loci_settings(spark, folder, calls, signal, **more):
    spark.createDataFrame(calls, "assay string, c string, m long, v double, d string").write.mode("overwrite").parquet(f"{folder}/calls")
    spark.createDataFrame(signal, "chrom string, a long, b long, x double").write.mode("overwrite").parquet(f"{folder}/signal")
    columns = {"assay": "assay", "chrom": "c", "midpoint": "m", "score": "v", "detail": "d"}
    return locus_tables.Settings(calls=f"{folder}/calls", calls_columns=columns, signal=f"{folder}/signal", signal_columns={"chrom": "chrom", "start": "a", "end": "b", "value": "x"}, output=f"{folder}/out", focal="F", **more)


def table_of(spark, folder):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("chrom", "tile", "chip_count", "ght_count", "chromosome_fold", "score", "detail", "signal").collect()))


def test_locus_table_is_renewed_in_parts(spark, tmp_path):
    signal = [("chr1", 100, 150, 4.0), ("chr1", 150, 160, 10.0), ("chr2", 0, 10, 1.0)]
    given = loci_settings(spark, tmp_path, CALLS, signal)
    report = locus_tables.run(spark, given)
    assert report == {"read": 9, "chip": 2, "ght": 6, "left_out": 3, "loci": 3, "both": 1, "chromosomes": 22}
    want = [("chr1", 0, 1, 2, 0, 2.0, "a", 5.0), ("chr2", 2, 0, 1, 1, 7.0, "c", 0.0), ("chr22", 0, 1, 0, 1, None, None, 0.0)]
    assert table_of(spark, tmp_path) == want
    locus_tables.run(spark, given)
    assert table_of(spark, tmp_path) == want
    # only the listed chromosomes are renewed; all of them, when none are listed
    grown = [*CALLS, ("chip", "chr1", 250, 1.0, "z"), ("chip", "chr2", 250, 1.0, "z")]
    part = loci_settings(spark, tmp_path, grown, signal, chromosomes=["chr2"])
    assert locus_tables.run(spark, part)["loci"] == 2
    assert table_of(spark, tmp_path) == sorted([*want, ("chr2", 1, 1, 0, 1, None, None, 0.0)])
    few = loci_settings(spark, tmp_path, CALLS[:1], signal)
    locus_tables.run(spark, few)
    assert table_of(spark, tmp_path) == [("chr1", 0, 1, 0, 0, None, None, 5.0)]
    with pytest.raises(ValueError, match="chrX"):
        locus_tables.run(spark, loci_settings(spark, tmp_path, CALLS, signal, chromosomes=["chrX"]))


def test_command_line(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", [(1, "ACGT", "s"), (2, "ACGA", "s")])
    config = tmp_path / "settings.json"
    config.write_text(json.dumps({"input": "nowhere", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark"}))
    run = [sys.executable, "-m", "jobs.sequence_features", str(config), "--set", f"input={tmp_path}/in/*"]
    for n in (2, 0):
        done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert json.loads(done.stdout.strip().splitlines()[-1])["written"] == n
        assert "reading what is new" in done.stderr and ("wrote 2 rows" in done.stderr) == (n == 2)


def test_a_file_of_one_split_is_worked_on_by_all_cores(spark, tmp_path, features, monkeypatch):
    put(spark, f"{tmp_path}/in", "a", [(i, "ACGT" * i, "s") for i in range(1, 40)])
    seen, own = [], sequence_features.features
    monkeypatch.setattr(sequence_features, "features", lambda batch, settings: seen.append(batch.rdd.getNumPartitions()) or own(batch, settings))
    assert sequence_features.run(spark, features)["written"] == 39
    assert seen[0] >= spark.sparkContext.defaultParallelism
