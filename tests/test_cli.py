"""Every command on small files."""

import json
import random

import numpy as np
import pytest

from lociweave import cli
from lociweave.operators import models
from lociweave.plans import flows
from lociweave.plans.workflows import Contract
from lociweave.sources import writers


@pytest.fixture
def run(spark, tmp_path):
    def call(command, *args):
        assert cli.main([command, *map(str, args), "--out", str(tmp_path / "report.json")]) == 0
        return json.loads((tmp_path / "report.json").read_text())

    return call


def _features(path, seed, effect=2.0, n=900):
    rng = np.random.default_rng(seed)
    rows = ["locus_id\tchrom\tstart\tgc\tadded\tother\tchip\trep1\trep2"]
    for i in range(n):
        g, a, o = rng.normal(size=3)
        y = g + effect * a + 0.3 * o + rng.normal()
        rows.append("\t".join(map(str, (f"l{i}", f"chr{1 + i % 22}", i * 200, g, a, o, y, y + rng.normal(), y + rng.normal()))))
    path.write_text("\n".join(rows) + "\n")
    return path


def test_screen_decompose_replicate(run, tmp_path):
    good, flat = _features(tmp_path / "a.tsv", 1), _features(tmp_path / "b.tsv", 2, 0.0)
    model = ["--baseline", "gc", "--added", "added", "--outcome", "chip", "--replicate", "rep1", "--replicate", "rep2", "--permutations", 19, "--draws", 50]
    r = run("screen", "--features", f"A={good}", "--features", f"B={flat}", *model)
    assert r["factors"]["A"]["passed"] and not r["factors"]["B"]["passed"] and not r["passed"]
    assert r["factors"]["A"]["p"] == 0.05 and len(r["factors"]["A"]["permutation"]["null"]) == 19 and r["factors"]["A"]["confirmed"]
    assert r["factors"]["A"]["bootstrap"]["low"] > 0.5
    r = run("replicate", "--features", f"x={good}", "--features", f"y={flat}", *model)
    assert r["replicated"] == ["x"]
    r = run("decompose", "--features", good, "--baseline", "gc", "--profile", "added", "--profile", "other", "--outcome", "chip")
    assert [p["pair"] for p in r["pairs"]] == ["added", "other"] and r["pairs"][0]["without_pair_partial_r2"] < 0.2 < r["pairs"][0]["partial_r2"]


def test_permutations_in_one_job_equal_single_ones(spark, tmp_path):
    rows = cli._table(spark, str(_features(tmp_path / "f.tsv", 3, n=300))).withColumn("fold", __import__("pyspark").sql.functions.expr("cast((cast(substring(chrom, 4) as int) - 1) % 5 as int)"))
    shifts = [(f"chr{c}", k, 1 + (c * 7 + k) % 12) for c in range(1, 23) for k in range(3)]
    by = flows.shifted_moments(rows, "fold", ["gc"], "added", "chip", spark.createDataFrame(shifts, "chrom string, permutation int, shift int"), ["start", "locus_id"])
    for k in range(3):
        own = spark.createDataFrame([(c, s) for c, p, s in shifts if p == k], "chrom string, shift int")
        moved = models.shift_within(rows, ["chrom"], ["start", "locus_id"], ["added"], own)
        want = models.nested_continuous(moved, "fold", ["gc"], ["added"], "chip")[1]
        got = models.nested_from_moments(by[k], 1, 1)
        assert got["partial_r2"] == pytest.approx(want["partial_r2"], abs=1e-9) and got["mse_m0"] == pytest.approx(want["mse_m0"]) and got["alphas_m1"] == want["alphas_m1"]


def test_workbook_audits(run, tmp_path):
    cells = [["Prey\\Bait", "A", "B"], ["A", "0", "1-x"], ["C", "2-y", "N/A"]]
    block = lambda pair: [["Base", pair, "ACN", "b", "s", 1, "3", "composite", "YES"], *([b, 1, 2] for b in "ACGT")]
    gaps = [["TF1_TF2", "bc", "b", "t", "kmer1.kmer2", *(f"Count Gap {g}" for g in range(29))], ["A_C", "x", "y", "z", "AC.GT", *range(29)]]
    paths = []
    for name, rows in (("i", cells), ("m", [["t"], *block("A_B")]), ("s", gaps)):
        paths.append(tmp_path / f"{name}.xlsx")
        paths[-1].write_bytes(writers.workbook_bytes({"S": rows}))
    r = run("audit-supplements", "--interactions", paths[0], "--models", paths[1], "--spacing", paths[2])
    assert (r["cells"], r["tested"], r["positive"], r["models"], r["spacing"]) == (4, 3, 2, 1, 1)
    assert {(x["value"], x["side"]) for x in r["coverage_models"]} == {("A_C", "without_model")}
    (tmp_path / "j.jaspar").write_text(">M1 B\nA [1 2]\nC [1 2]\nG [1 2]\nT [1 2]\n")
    r = run("audit-motifs", "--interactions", paths[0], "--focal", "A", "--source", f"jaspar={tmp_path / 'j.jaspar'}")
    assert r == {"sources": {"B": "jaspar", "C": None}, "complete": ["A_B"], "excluded": ["A_C"]}


def test_signal_audits_features_and_liftover(run, tmp_path):
    for k in (1, 2):
        (tmp_path / f"r{k}.bw").write_bytes(writers.bigwig_bytes({"chr1": (5000, [(i * 100, i * 100 + 100, float(i * k % 7)) for i in range(40)])}))
    (tmp_path / "loci.tsv").write_text("locus_id\tchrom\tstart\tend\tmidpoint\n" + "".join(f"l{i}\tchr1\t{i * 200}\t{i * 200 + 200}\t{i * 200 + 100}\n" for i in range(20)))
    r = run("audit-chip", "--loci", tmp_path / "loci.tsv", "--signal", f"r1={tmp_path / 'r1.bw'}", "--signal", f"r2={tmp_path / 'r2.bw'}")
    assert r["n"] == 20 and -1 <= r["spearman"] <= 1
    r = run("audit-bigwigs", "--folder", tmp_path, "--expected", "r1.bw", "--expected", "r3.bw", "--sentinel", "chr1=5000")
    assert r["missing"] == ["r3.bw"] and r["unexpected"] == ["r2.bw"] and r["status"] == {"r1.bw": "PASS"} and not r["passed"]
    rng = random.Random(1)
    (tmp_path / "g.2bit").write_bytes(writers.twobit_bytes({"chr1": "".join(rng.choice("ACGT") for _ in range(5000))}))
    (tmp_path / "m.jaspar").write_text("".join(f">{n} {n}\nA [9 0 0]\nC [0 9 0]\nG [0 0 9]\nT [0 0 {k}]\n" for k, n in enumerate(("FOC", "PAR"))))
    r = run("build-features", "--loci", tmp_path / "loci.tsv", "--genome", tmp_path / "g.2bit", "--motifs", tmp_path / "m.jaspar", "--focal", "FOC", "--partner", "PAR", "--signal", f"chip_rep1={tmp_path / 'r1.bw'}", "--table", tmp_path / "features")
    assert r["counts"]["rows"] == 20 and {"gc_fraction", "focal_monomer_score", "partner_raw::PAR", "chip_mean_log1p"} <= set(r["columns"])
    (tmp_path / "c.chain").write_text("chain 1 chr1 5000 + 0 2000 chrN 9000 + 1000 3000 1\n2000\n")
    r = run("liftover", "--signal", tmp_path / "r1.bw", "--chain", tmp_path / "c.chain", "--lifted", tmp_path / "lifted")
    assert r["before"]["records"] == 40 and r["after"]["records"] == 20


def test_tables_runs_genes(run, tmp_path):
    head = "chr\tstart\tstop\tname\tcoefficient.br\tcoefficient.ar\tfull_LL\treduced_LL\tpvalue\tfdr\n"
    (tmp_path / "c.tsv").write_text(head + "chr1\t100\t300\ta\t0.2\t1.4\t1\t1\t0.01\t0.01\nchr1\t500\t700\tb\t1\t-1\t1\t1\t0.01\t0.01\n")
    r = run("audit-calls", "--file", f"T={tmp_path / 'c.tsv'}", "--width", 200)
    assert r["T"]["autosomal"] == 2 and r["T"]["selected"] == 1 and r["T"]["eligible"]
    (tmp_path / "runs.csv").write_text("tf,run,experiment\nT,R1,E1\nU,R2,E2\n")
    (tmp_path / "exp.csv").write_text("experiment,batch,approved\nE1,b1,yes\nE2,b2,no\n")
    (tmp_path / "ena.tsv").write_text("run_accession\tfastq_ftp\tfastq_md5\tfastq_bytes\nR1\ta;b\tm;n\t1;2\nR2\tc\to\t5\n")
    r = run("audit-runs", "--runs", tmp_path / "runs.csv", "--experiments", tmp_path / "exp.csv", "--report", tmp_path / "ena.tsv", "--focal", "T")
    assert r["all"]["bytes"] == 8 and r["focal"]["files"] == 2 and r["batch b2"]["runs"] == 1
    (tmp_path / "g.gtf").write_text("".join(f'chr1\tx\ttranscript\t1\t9\t.\t+\t.\ttranscript_id "T{i}.1"; gene_name "G{i}";\n' for i in range(3)))
    for k in (1, 2):
        (tmp_path / f"q{k}.sf").write_text("Name\tTPM\n" + "".join(f"T{i}.2\t{i * k}\n" for i in range(4)))
    r = run("audit-expression", "--quant", f"a={tmp_path / 'q1.sf'}", "--quant", f"b={tmp_path / 'q2.sf'}", "--gtf", tmp_path / "g.gtf", "--partner", "G1", "--partner", "G0", "--threshold", 1)
    assert [(x["gene"], x["mean_tpm"], x["expression_supported"]) for x in r["partners"]] == [("G0", 0.0, False), ("G1", 1.5, True)] and r["mapping"]["mapped"] == 6
    (tmp_path / "p.tsv").write_text("gene_id\tTPM\nX.1\t3\nY\t0\n")
    assert run("audit-gene", "--profile", f"e={tmp_path / 'p.tsv'}", "--gene", "X", "--threshold", 2) == {"gene": "X", "tpm": {"e": 3.0}, "passed": True}
    (tmp_path / "s.soft").write_text("^SAMPLE = S1\n!Sample_supplementary_file = ftp://x/T_rep1.bw\n^SAMPLE = S2\n!Sample_supplementary_file = ftp://x/T_rep2.bw\n")
    r = run("sample-manifest", "--soft", tmp_path / "s.soft", "--pattern", r"/(?P<tf>\w+)_rep(?P<replicate>\d)")
    assert r["T"]["2"]["sample"] == "S2"
    with pytest.raises(ValueError, match="replicates"):
        run("sample-manifest", "--soft", tmp_path / "s.soft", "--pattern", r"/(?P<tf>\w+)_rep(?P<replicate>1)")
    r = run("compare", "--first", tmp_path / "p.tsv", "--second", tmp_path / "p.tsv", "--key", "gene_id", "--column", "TPM")
    assert [x["TPM_difference"] for x in r["rows"]] == [0.0, 0.0]
    r = run("file-manifest", "--files", tmp_path / "p.tsv")
    assert r["files"][0]["name"] == "p.tsv" and len(r["files"][0]["sha256"]) == 64
    (tmp_path / "z.zip").write_bytes(writers.zip_bytes({"a.txt": b"x", "b.bin": b"yy"}))
    assert [m["name"] for m in run("audit-archive", "--archive", tmp_path / "z.zip", "--pattern", r".*\.txt")["members"]] == ["a.txt"]
    assert run("contract")["passing_factors"] == 4


def test_states_and_experiment(run, tmp_path):
    rng = np.random.default_rng(4)
    genes, results = ["gene\tchrom\tgc_fraction\tgrammar"], ["gene\tbaseMean\tlog2FoldChange\tlfcSE\tpvalue\tpadj"]
    for i in range(300):
        g, x = rng.normal(size=2)
        genes.append(f"G{i}\tchr{1 + i % 22}\t{g}\t{x}")
        results.append(f"G{i}\t1\t{-(g + x)}\t1\t0.1\tNA")
    (tmp_path / "g.tsv").write_text("\n".join(genes) + "\n")
    (tmp_path / "r.tsv").write_text("\n".join(results) + "\n")
    r = run("benchmark-states", "--genes", f"EVT={tmp_path / 'g.tsv'}", "--results", f"EVT={tmp_path / 'r.tsv'}", "--added", "grammar", "--predictions", tmp_path / "pred")
    assert r["EVT"]["partial_r2"] > 0.9 and r["written"]["rows"] == 300
    (tmp_path / "m.jaspar").write_text(">MA [x\n" .replace(" [x", " A1") + "A [9 0 0 9]\nC [0 9 0 0]\nG [0 0 9 0]\nT [0 0 0 0]\n>MB B1\nA [0 9]\nC [0 0]\nG [9 0]\nT [0 0]\n")
    (tmp_path / "e.yaml").write_text("# small\nseeds: [3]\nsequence_length: 40\ntrain_pairs: 12\nvalidation_pairs: 6\ntest_pairs: 6\ntrain:\n  gap_max: 15\nevaluations:\n  iid:\n    gap_max: 15\n    allow_reverse: true\nmodels:\n  local_cnn:\n    channels: 3\n    kernel_size: 5\n  pwm_presence: {}\ntraining:\n  epochs: 1\n")
    r = run("experiment", "--config", tmp_path / "e.yaml", "--motifs", tmp_path / "m.jaspar", "--motif-a", "A1", "--motif-b", "MB", "--folder", tmp_path / "exp")
    assert {x["model"] for x in r["ranking"]} == {"local_cnn", "pwm_presence"}


def test_rules():
    for bad in ({"context": 100}, {"folds": 2}, {"fdr": 2}, {"permutations": 0}, {"final_permutations": 10}, {"universe": "x"}, {"width": 3}):
        with pytest.raises(ValueError):
            Contract(**bad).validate()
    for bad in ({"universe": "assay-union"}, {"calls_version": "v1"}, {"calls_format": "bed"}, {"positive_calls": False}, {"pipeline": "x"}, {"replicates": 1}, {"confirm_direction": False}):
        Contract(**bad).validate()
        with pytest.raises(ValueError):
            Contract(**bad).validate(primary=True)
    from lociweave.operators import audit, panel

    assert audit.session_versions("R version 4.3.1 (x)\nother: DESeq2_1.42.0 z", {"R": "4.3.1", "DESeq2": "1.42.0"})["DESeq2"] == "1.42.0"
    for wanted in ({"R": "4.3.2"}, {"Seq2": "1.42.0"}):
        with pytest.raises(ValueError):
            audit.session_versions("R version 4.3.1 (x)\nDESeq2_1.42.0", wanted)
    with pytest.raises(ValueError):
        audit.exact_members(["a", "a"], ["a"])

    class Frame:
        columns = ["gene", "WT_1", "KO_1"]

    with pytest.raises(ValueError):
        panel.count_columns(Frame)


def test_manifest_changes_are_found(spark, tmp_path):
    from lociweave.operators import audit

    (tmp_path / "a.txt").write_text("one")
    found = audit.asset_manifest(spark, f"{tmp_path}/*.txt")
    assert audit.verify_manifest(found, found).count() == 1
    for wanted in ([("a.txt", 3, "0" * 64)], [], [("b.txt", 3, "0" * 64)]):
        with pytest.raises(Exception, match="not the frozen asset"):
            audit.verify_manifest(found, spark.createDataFrame(wanted, "name string, size_bytes long, sha256 string")).collect()
