import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import pwm
from lociweave.functions import sequence as S
from lociweave.operators import audit, intervals, loci, metrics, models, pairs, synth


def points(spark, rows):
    return spark.createDataFrame(rows, "chrom string, midpoint long")


def test_universes(spark):
    chip, ght = points(spark, [("chr1", 190), ("chr1", 210)]), points(spark, [("chr1", 110), ("chr2", 300)])
    union = {r.locus_id: r for r in loci.assay_union_loci(chip, ght, "TF").collect()}
    assert len(union) == 3
    first = union["TF:chr1:0-200"]
    assert (first.midpoint, first.chip_source, first.ght_source, first.outcome_used_for_selection, first.outcome_used_for_centering) == (100, True, True, True, False)
    only = loci.ght_only_loci(points(spark, [("chr1", 110)]), "TF", 200, points(spark, [("chr1", 190), ("chr1", 410)])).collect()
    assert [(r.tile, r.chip_count) for r in only] == [(0, 1)]
    legacy = loci.legacy_assay_union_loci(points(spark, [("chr1", 190)]), points(spark, [("chr1", 110)]), "TF").collect()
    assert [(r.start, r.midpoint, r.end, r.outcome_used_for_centering) for r in legacy] == [(90, 190, 290, True)]
    sizes = spark.createDataFrame([("chr1", 450), ("chr2", 210)], "chrom string, size long")
    grid = loci.fixed_genome_loci(sizes, points(spark, [("chr1", 210)]), points(spark, [("chr2", 100)]), "TF").collect()
    assert {(r.chrom, r.start, r.chip_count, r.ght_count) for r in grid} == {("chr1", 0, 0, 0), ("chr1", 200, 1, 0), ("chr2", 0, 0, 1)}
    assert {r.f for r in spark.createDataFrame([("chr1",), ("chr6",), ("1",), ("21",)], "c string").select(loci.chromosome_fold(F.col("c")).alias("f")).collect()} == {0}
    with pytest.raises(Exception, match="not an autosome"):
        spark.createDataFrame([("chrX",)], "c string").select(loci.chromosome_fold(F.col("c"))).collect()
    with pytest.raises(ValueError):
        loci.validate_width(3)


def test_overlap_join_equals_theta_join(spark):
    rng = np.random.default_rng(0)
    a = [(int(i), f"chr{rng.integers(1, 3)}", int(s), int(s + rng.integers(1, 400))) for i, s in enumerate(rng.integers(0, 3000, 200))]
    b = [(int(i), f"chr{rng.integers(1, 3)}", int(s), int(s + rng.integers(1, 900))) for i, s in enumerate(rng.integers(0, 3000, 150))]
    left, right = spark.createDataFrame(a, "i long, chrom string, s long, e long"), spark.createDataFrame(b, "j long, chrom string, x long, y long")
    got = intervals.overlap_join(left, right, ["chrom"], ("s", "e"), ("x", "y"), bin_size=100).select("i", "j").collect()
    want = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_links(spark):
    own = spark.createDataFrame([("L1", "chr1", 90, 110), ("L2", "chr1", 5000, 5100)], "locus_id string, chrom string, start long, end long")
    promoters = spark.createDataFrame([("G", "chr1", 80, 120)], "gene string, chrom string, promoter_start long, promoter_end long")
    loops = spark.createDataFrame([("chr1", 50, 150, "chr1", 4900, 5200, 4.0)], "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, loop_score double")
    got = {r.locus_id: (r.direct, r.loop_count, r.loop_score) for r in intervals.link_loci_to_promoters(own, promoters, loops).collect()}
    assert got == {"L1": (True, 1, 0.0), "L2": (False, 1, 4.0)}


def test_sequences(spark):
    d = spark.createDataFrame([("ACGTCGNN",), ("ACGTN",)], "s string")
    r = d.select(S.gc_fraction(F.col("s")).alias("g"), S.cpg_per_100bp(F.col("s")).alias("c"), S.n_fraction(F.col("s")).alias("n"), S.reverse_complement(F.col("s")).alias("r")).collect()
    assert r[0].g == pytest.approx(4 / 6) and r[0].c == pytest.approx(200 / 7) and r[0].n == 0.25 and r[1].r == "NACGT"
    names = [(" hs_RFXDC2-DBD ",), ("HUMAN:fli1_ISOFORM2",), ("RXF5",)]
    assert [x[0] for x in spark.createDataFrame([("RFXDC2",), ("x",), ("RXF5",)], "s string").select(S.normalize_symbol(F.col("s"), {"X": "Y", "RXF5": "Z"})).collect()] == ["RFX7", "Y", "Z"]
    assert [x[0] for x in spark.createDataFrame(names, "s string").select(S.normalize_symbol(F.col("s"))).collect()] == ["RFX7", "FLI1", "RFX5"]
    assert pwm.encode("ACGTN").tolist() == pwm.encode("acgt-").tolist() == [0, 1, 2, 3, 4]


def test_pwm_scans_agree(spark):
    m = pwm.probabilities(np.eye(4)[[0, 0, 1]] * 0.96 + 0.01)
    c = pwm.probabilities(np.eye(4)[[1, 1, 1, 1]] * 0.96 + 0.01)
    seqs = [("TTTGTTAAA",), ("NNNAACNNN",), ("CCCCCCCCC",), ("NNNNNNNN",), ("A",), (None,)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(seqs)], "i long, s string")
    rows = df.join(pwm.relational_scores(df, "i", "s", m, "r"), "i").withColumn("u", pwm.scan_column(F.col("s"), {"m": m, "c": c})).orderBy("i").collect()
    assert len(rows) == len(seqs)
    for r in rows:
        assert r.r == pytest.approx(r.u["m"], rel=1e-9)
    assert rows[3].r == -np.inf
    a3, c3 = (pwm.log_odds(pwm.probabilities(np.tile(np.eye(4)[k], (3, 1)) * 0.96 + 0.01)) for k in (0, 1))
    assert pwm.spaced_score("GGGAAATTCCCGGG", a3, c3, [2], ["FF"]) > pwm.spaced_score("GGGAAATTTTCCCG", a3, c3, [2], ["FF"])
    k = spark.createDataFrame([("ACAC",)], "p string").select(pwm.kmer_columns(F.col("p")).alias("k")).first().k
    assert sum(k.values()) == pytest.approx(1) and len(k) == 2
    assert pwm.consensus(np.eye(4)) == "ACGT" and pwm.information_bits(np.eye(4)) > 7.9


def test_residuals(spark):
    rows = [(i, float(i), float(i // 5), i < 15, i % 5) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, g double, m double, train boolean, fold int")
    out = models.binned_residuals(df, "g", ["m"], "train", 4).filter("train").agg(F.avg("residual")).first()[0]
    assert out == pytest.approx(0)
    crossed = models.cross_fitted_residuals(df, "g", ["m"], "fold", 4)
    assert crossed.count() == 20 and crossed.filter("residual is null or isnan(residual)").count() == 0


def test_nested_regression_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n = 500
    b, g = rng.normal(size=n), rng.normal(size=n)
    y = b + 0.8 * g + 0.2 * rng.normal(size=n)
    chrom = rng.integers(1, 23, n)
    rows = [(int(i), float(b[i]), float(g[i]), float(y[i]), int((chrom[i] - 1) % 5), f"chr{chrom[i]}") for i in range(n)]
    df = spark.createDataFrame(rows, "i int, b double, g double, y double, fold int, chrom string")
    predicted, summary = models.nested_continuous(df, "fold", ["b"], ["g"], "y")
    assert summary["partial_r2"] > 0.3 and summary["all_positive"]
    fold, test = (chrom - 1) % 5, ((chrom - 1) % 5) == 0
    train = ~test & (fold != 1)
    x = np.c_[b, g]
    mu, sd = x[train].mean(0), x[train].std(0)
    z = (x - mu) / sd
    beta = np.linalg.solve(z[train].T @ z[train] + summary["alphas_m1"][0] * np.eye(2), z[train].T @ (y[train] - y[train].mean()))
    got = {r.i: r.p1 for r in predicted.filter("fold = 0").collect()}
    for i in np.flatnonzero(test):
        assert got[int(i)] == pytest.approx(float(y[train].mean() + z[i] @ beta), abs=1e-8)
    assert models.block_bootstrap(predicted, "chrom", "y", 200)["low"] > 0.3


def test_shift_keeps_the_multiset(spark):
    df = spark.createDataFrame([("chr1", i, i * 10) for i in range(4)] + [("chr2", i, i * 7) for i in range(4)], "chrom string, i int, v int")
    shifts = spark.createDataFrame([("chr1", 1), ("chr2", 3)], "chrom string, shift int")
    out = models.shift_within(df, ["chrom"], ["i"], ["v"], shifts).orderBy("chrom", "i").collect()
    assert [r.v for r in out] == [30, 0, 10, 20, 7, 14, 21, 0]
    assert models.permutation_p([0.1, 0.2], 0.3) == pytest.approx(1 / 3)
    assert models.draw_shifts({("a",): 1, ("b",): 5}, 3).keys() == {("b",)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    r = metrics.auroc_ap(df, "y", "p").first()
    assert r.auroc == 1 and r.auprc == 1
    c = metrics.confusion(df, "y", "p").first()
    assert c.balanced_accuracy == 1 and c.mcc == 1
    assert metrics.select_threshold(df, "y", "p").first().threshold == 0.8
    pair = spark.createDataFrame([(1, 0.9, "a"), (0, 0.2, "a"), (0, 0.7, "b"), (1, 0.4, "b")], "y int, p double, pair string")
    m = metrics.paired(pair, "y", "p", "pair").first()
    assert m.pairwise_accuracy == 0.5 and m.counterfactual_delta == pytest.approx(0.2)
    with pytest.raises(Exception, match="one positive"):
        metrics.paired(pair.filter("p > 0.3"), "y", "p", "pair").collect()
    q = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "a double, b double")
    assert metrics.replicate_qc(q, "a", "b").first().spearman == pytest.approx(1)
    below = metrics.replicate_qc(spark.createDataFrame([(-3.0, 1.0), (2.0, 2.0), (3.0, 5.0), (4.0, 4.0), (float("nan"), 1.0)], "a double, b double"), "a", "b").first()
    assert below.n == 4 and below.spearman == pytest.approx(0.8) and below.median_abs_log1p_difference == pytest.approx(0.20273, abs=1e-5)
    with pytest.raises(Exception, match="three finite pairs"):
        metrics.replicate_qc(q.limit(2), "a", "b").collect()
    ece = metrics.calibration_error(spark.createDataFrame([(1, 0.3), (1, 1.0)], "y int, p double"), "y", "p").first().ece
    assert ece == pytest.approx(0.35)
    assert metrics.continuous(q, "a", "a").first().r2 == 1


def test_running_sums_are_exact(spark):
    from lociweave.operators.scale import running_sums

    rows = [(float((i * 37) % 1000) / 7, i) for i in range(1000)]
    got = {r.v: r.s for r in running_sums(spark.createDataFrame(rows, "v double, n long"), "v", {"s": "n"}).collect()}
    total = 0
    for v, n in sorted(rows):
        total += n
        assert got[v] == total


def test_pairs(spark):
    inter = spark.createDataFrame([("A", "B", 1, 0, 0), ("B", "A", 0, 1, 0), ("A", "Z", 1, 1, 1)], "bait string, prey string, cooperative_signal int, composite_motif int, spacing_or_orientation int")
    known = spark.createDataFrame([("A", "F1", "ACD"), ("B", "F2", "EFG")], "tf string, family string, protein_sequence string")
    d = pairs.directed_pairs(inter, known)
    assert d.count() == 2
    s = pairs.pair_summary(d).first()
    assert (s.rows, s.positives, s.unique_tfs, s.directed_asymmetries) == (2, 1, 2, 1)
    split = pairs.assign_split(d, "family_pair", 0.5).select("split").distinct().collect()
    assert len(split) == 1  # both directions stay together
    train, test = pairs.leave_one_out(inter, "Z")
    assert (train.count(), test.count()) == (2, 1)
    with pytest.raises(ValueError):
        pairs.leave_one_out(inter, "Q")
    p = spark.createDataFrame([("0",), ("N/A",), ("1-FF, 2-FR",), (None,)], "x string").select(pairs.parse_tokens(F.col("x")).alias("t")).collect()
    assert [(r.t.tested, r.t.composite, r.t.spacing, r.t.specificity) for r in p] == [(True, False, False, []), (False, False, False, []), (True, True, True, ["ff", "fr"]), (False, False, False, [])]
    rates = {r.bait: r.probability for r in pairs.apply_rates(inter, inter.filter("bait = 'A'"), ["bait"], "composite_motif").collect()}
    assert rates == {"A": 0.5, "B": 0.5}
    f = pairs.protein_features(d).first().kmers
    assert f["a:AC"] == 0.5


def test_gates_and_assets(tmp_path):
    assert audit.primary_gate(0.01, 0.01, [1, 1, 1]) and not audit.primary_gate(0.01, 0.01, [1, -1, 1])
    assert audit.panel_gate([True] * 4) and not audit.panel_gate([True] * 3)
    p = tmp_path / "a"
    p.write_text("x")
    audit.verify_asset(str(p), 1, audit.sha256_file(str(p)))
    with pytest.raises(ValueError):
        audit.verify_asset(str(p), 2, "")
    with pytest.raises(ValueError):
        audit.assert_primary_asset_allowed("data/TOPs/example.bed")
    audit.write_json({"b": 1, "a": 2}, str(tmp_path / "j"))
    assert (tmp_path / "j").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'


def test_synthetic_pairs(spark):
    a, b = pwm.probabilities(np.eye(4)[[0, 1, 2]] + 0.01), pwm.probabilities(np.eye(4)[[3, 2, 1]] + 0.01)
    make = lambda n: synth.matched_pairs(spark, a, b, 24, seed=123).repartition(n).orderBy("pair_id", "label").collect()
    rows = make(1)
    assert rows == make(5) and len(rows) == 48
    assert sum(r.label for r in rows) == 24 and all((r.gap % 10 in (0, 1, 9)) == bool(r.label) and len(r.sequence) == 160 for r in rows)
    assert synth.validate_pairs(spark.createDataFrame(rows)).filter("not valid").count() == 0
    assert synth.one_hot("ACGT").tolist() == np.eye(4).tolist()
    with pytest.raises(ValueError):
        synth.one_hot("N")


def test_quantiles_are_exact_in_buckets(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from lociweave.operators.metrics import quantile_summary, robust_scale
    from lociweave.operators.scale import quantiles

    rng = np.random.default_rng(5)
    values = [float(x) for x in np.round(rng.exponential(10, 3000), 1)] + [None] * 7 + [4.0] * 900
    rows = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, k int").repartition(5)
    p = [0.0, 0.05, 0.5, 0.93, 1.0]
    got = quantiles(rows, "v", p, {"all": F.lit(True), "one": F.col("k") == 1, "not two": F.col("k") != 2, "none": F.col("k") == 9})
    for name, keep in (("all", {0, 1, 2}), ("one", {1}), ("not two", {0, 1})):
        own = [v for i, v in enumerate(values) if v is not None and i % 3 in keep]
        assert np.allclose(got[name], np.quantile(own, p), rtol=1e-12)
    assert got["none"] == [None] * 5
    own = np.array([v for v in values if v is not None])
    r = robust_scale(rows, "v").first()
    assert np.isclose(r.center, np.median(own)) and np.isclose(r.scale, 1.4826 * np.median(np.abs(own - np.median(own))))
    assert quantile_summary(rows.filter("v is null"), "v").first() == (None,) * 5
    assert robust_scale(rows.limit(0), "v").first() == (None, None)


def test_exact_quantiles_against_numpy(spark, monkeypatch):
    from lociweave.operators import scale

    rng = np.random.default_rng(5)
    n = 3000
    rows = [(float(a) if rng.random() > 0.05 else None, float(b), int(k)) for a, b, k in zip(rng.normal(size=n), rng.integers(0, 6, n), rng.integers(0, 4, n))]
    df = spark.createDataFrame(rows, "a double, b double, k int").repartition(5)
    ps = [0, 0.01, 0.25, 0.5, 0.77, 0.999, 1]
    parts = {"all": F.lit(True), "k0": F.col("k") == 0, "not1": F.col("k") != 1, "none": F.col("k") == 9}
    for most in (200_000, 40):  # what the driver takes at once; the smaller one takes several rounds
        monkeypatch.setattr(scale, "MOST", most)
        monkeypatch.setattr(scale, "ERROR", 1e-4 if most > 40 else 0.02)
        got = scale.quantiles_of(df, {"a": "a", "b": F.col("b") * 2}, ps, parts)
        for p, keep in (("all", lambda k: True), ("k0", lambda k: k == 0), ("not1", lambda k: k != 1)):
            assert got["a"][p] == pytest.approx(np.quantile([x for x, _, k in rows if x is not None and keep(k)], ps).tolist(), abs=1e-12)
            assert got["b"][p] == pytest.approx(np.quantile([2 * y for _, y, k in rows if keep(k)], ps).tolist(), abs=1e-12)
        assert got["a"]["none"] == [None] * len(ps)
    one = spark.createDataFrame([(3.0,)], "v double")
    assert scale.quantiles(one, "v", [0.0, 0.3, 1.0]) == {"all": [3.0] * 3}


def test_positions_and_keyed_running_sums(spark):
    from lociweave.operators import scale

    rng = np.random.default_rng(6)
    rows = [(int(i), f"c{g}", int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500)))]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(4)
    want = {}
    for g in ("c0", "c1", "c2"):
        own = sorted((v, i) for i, h, v in rows if h == g)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own)}
    for buckets in (2, 7, 400):
        assert {r.i: (r.at, r.n) for r in scale.positions(df, ["g"], ["v", "i"], "at", "n", buckets).collect()} == want
        by = df.groupBy("g", "v").agg(F.count("*").alias("n"))
        got = {(r.g, r.v): r.upto for r in scale.running_sums(by, "v", {"upto": "n"}, True, buckets, ["g"]).collect()}
        assert got == {(g, v): sum(1 for _, h, w in rows if h == g and w >= v) for _, g, v in rows}
    scored = spark.createDataFrame([(g, int(v > 50 and i % 3 > 0), float(v)) for i, g, v in rows], "g string, y int, p double")
    keyed = {r.g: (r.n, r.auroc, r.auprc) for r in metrics.auroc_ap(scored, "y", "p", ["g"]).collect()}
    for g, found in keyed.items():
        one = metrics.auroc_ap(scored.filter(F.col("g") == g), "y", "p").first()
        assert found == pytest.approx((one.n, one.auroc, one.auprc))
    ranked = {r.g: r.spearman for r in metrics.spearman(scored, "y", "p", ["g"]).collect()}
    assert ranked["c1"] == pytest.approx(metrics.spearman(scored.filter("g = 'c1'"), "y", "p").first().spearman)


def test_kmers_and_one_hot(spark):
    from collections import Counter

    from lociweave.operators import pairs

    rows = [("ACDACDAC", "acx*"), ("A", ""), (None, "WWWWW"), ("MKTAYIAKQRQISFVKSHFSRQ" * 20, "ACD")]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, bait_sequence string, prey_sequence string")
    for r in pairs.protein_features(out, 2).collect():
        clean = ["".join(c for c in (x or "").upper() if c in "ACDEFGHIKLMNPQRSTVWY") for x in rows[r.i]]
        sides = [Counter(s[k : k + 2] for k in range(len(s) - 1)) for s in clean]
        share = [{m: v / sum(c.values()) for m, v in c.items()} for c in sides]
        want = {f"{p}:{m}": v for m in {*share[0], *share[1]} for x, y in [(share[0].get(m, 0.0), share[1].get(m, 0.0))] for p, v in (("a", x), ("b", y), ("d", abs(x - y)), ("p", x * y))}
        assert dict(r.kmers) == pytest.approx(want)
    r = spark.createDataFrame([("ACgt",), ("",)], "s string").select(S.one_hot_text(F.col("s")).alias("t"), S.one_hot(F.col("s")).alias("h")).collect()
    assert r[0].t == "1000010000100001" == "".join(str(x) for row in r[0].h for x in row) and r[1].t == ""
    with pytest.raises(Exception, match="can be encoded"):
        spark.createDataFrame([("AN",)], "s string").select(S.one_hot_text(F.col("s"))).collect()


def _newton(x, y, c):
    """A class-balanced logistic model on standardised features, in NumPy."""
    mean, std = x.mean(0), x.std(0)
    z = np.c_[(x - mean) / std, np.ones(len(y))]
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    free, w = np.append(np.ones(x.shape[1]), 0) / c, np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (s * p * (1 - p))) @ z + np.diag(free), z.T @ (s * (p - y)) + free * w)
    return lambda v: 1 / (1 + np.exp(-(np.c_[(v - mean) / std, np.ones(len(v))] @ w)))


def test_nested_logistic_models_match_numpy(spark):
    rng = np.random.default_rng(8)
    n = 600
    a, b = rng.normal(3, 2, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 3 + 2 * b - 1)))).astype(int)
    rows = [(i, float(a[i]), float(b[i]), int(y[i]), i % 4) for i in range(n)]
    out = models.nested_binary(spark.createDataFrame(rows, "i int, b_two double, a_one double, y int, fold int").repartition(3), "fold", ["b_two"], ["a_one"], "y", 0.7)
    got = {r.i: (r.p0, r.p1) for r in out.collect()}
    for k in range(4):
        train, test = np.arange(n) % 4 != k, np.flatnonzero(np.arange(n) % 4 == k)
        for j, x in enumerate((a[:, None], np.c_[b, a])):
            want = _newton(x[train], y[train], 0.7)(x[test])
            assert [got[int(i)][j] for i in test] == pytest.approx(want.tolist(), abs=1e-6)
    apart = spark.createDataFrame([(i, float(i), int(i > 20), i % 3) for i in range(40)], "i int, x double, y int, fold int")
    assert models.nested_binary(apart.withColumn("z", F.lit(1.0)), "fold", ["x"], ["z"], "y", 100.0).filter("(p1 > 0.5) = (y = 1)").count() >= 38  # separable, and a constant column
    with pytest.raises(ValueError, match="one class"):
        models.nested_binary(apart.withColumn("y", F.lit(1)), "fold", ["x"], [], "y")


def test_moments_of_many_outcomes_in_one_job(spark):
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(size=(n, 5))
    fold, p = np.arange(n) % 3, np.arange(n) % 2
    df = spark.createDataFrame([(*map(float, x[i]), int(fold[i]), int(p[i])) for i in range(n)], "a double, b double, c double, `o.1` double, o2 double, fold int, p int").repartition(4)
    for (k, q), m in models.gram(df, ["fold", "p"], ["a", "b", "c", "o.1", "o2"]).items():
        own = x[(fold == k) & (p == q)]
        assert m.n == len(own) and np.allclose(m.s, own.sum(0)) and np.allclose(m.g, own.T @ own)
    predicted, many = models.nested_outcomes(df, "fold", ["a", "b"], ["c"], ["o.1", "o2"])
    assert {"p0::o.1", "p1::o2"} <= set(predicted.columns)
    for o in ("o.1", "o2"):
        one = models.nested_continuous(df, "fold", ["a", "b"], ["c"], o)[1]
        assert many[o]["partial_r2"] == pytest.approx(one["partial_r2"]) and many[o]["alphas_m1"] == one["alphas_m1"]
    with pytest.raises(Exception, match="all rows"):
        models.gram(df.withColumn("a", F.lit(None).cast("double")), ["fold"], ["a"])


def test_equal_intervals_meet_once(spark):
    """20,000 equal intervals on either side make no 400 million rows: links are counted, means are weighted."""
    many = spark.range(20_000)
    promoters = many.select(F.lit("chr1").alias("chrom"), F.lit("g").alias("gene"), F.lit(1000).cast("long").alias("promoter_start"), F.lit(1100).cast("long").alias("promoter_end"))
    loops = many.select(F.lit("chr1").alias("chrom1"), F.lit(0).alias("start1"), F.lit(100).alias("end1"), F.lit("chr1").alias("chrom2"), F.lit(1000).alias("start2"), F.lit(1200).alias("end2"), (F.col("id") % 7).cast("double").alias("loop_score"))
    own = spark.createDataFrame([("a", "chr1", 50, 60), ("b", "chr1", 1050, 1060), ("c", "chr1", 50, 60), ("c", "chr1", 60, 70), ("e", "chr1", 70, 70)], "locus_id string, chrom string, start long, end long")
    got = {r.locus_id: (r.direct, r.loop_count, r.loop_score) for r in intervals.link_loci_to_promoters(own, promoters, loops).collect()}
    n = 20_000**2
    assert got == {"a": (False, n, 6.0), "b": (True, 20_000, 0.0), "c": (False, 2 * n, 6.0), "e": (False, n, 6.0)}
    places = many.select(F.col("id").cast("string").alias("locus_id"), F.lit("chr1").alias("chrom"), F.lit(50).alias("start"), F.lit(60).alias("end"))
    signal = many.select(F.lit("chr1").alias("chrom"), F.lit(0).alias("s_start"), F.lit(100).alias("s_end"), (F.col("id") % 2).cast("double").alias("value"))
    assert intervals.interval_mean(places, signal, "v").agg(F.count("*"), F.min("v"), F.max("v")).first()[:] == (20_000, 0.5, 0.5)


def test_bins_follow_the_intervals(spark):
    """Short intervals get short bins, so that those of one neighbourhood aren't all compared with each other."""
    short = spark.range(100).select(F.col("id").alias("s"), (F.col("id") + 90).alias("e"))
    assert intervals.bin_width((short, "s", "e"), (short, "s", "e")) == 180
    found = intervals.overlap_join(short.withColumn("c", F.lit(1)), short.select(F.lit(1).alias("c"), F.col("s").alias("x"), F.col("e").alias("y")), ["c"], ("s", "e"), ("x", "y"))
    assert found.count() == sum(abs(i - j) < 90 for i in range(100) for j in range(100))


def test_nation_pairs_are_joined_once(spark):
    """What q105 and q120 give stands on the kept pairs, not on the joins of the large tables again."""
    from lociweave.plans import catalogue

    for name in ("q105_assign_split", "q120_family_rate"):
        assert not [f for f in catalogue.queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_quantiles_of_few_values_by_counts(spark):
    """Columns of few values need one job of counts, others brackets; both are exact, in parts and with nulls."""
    from lociweave.operators import scale

    df = spark.range(3000).select(F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("few"), (F.col("id") * 1.5).alias("many"), (F.col("id") % 3).alias("part"))
    columns, parts = {"few": F.col("few")}, {"x": F.col("part") != 0, "y": F.col("part") == 0}
    assert scale.few_valued(df, columns) == ["few"]
    got = scale.quantiles_of(df, {"few": "few", "many": "many"}, [0, 0.3, 0.5, 1], parts)
    frame = df.toPandas()
    for c in ("few", "many"):
        for p, rows in (("x", frame.part != 0), ("y", frame.part == 0)):
            assert np.allclose(got[c][p], frame[c][rows].dropna().quantile([0, 0.3, 0.5, 1]))
