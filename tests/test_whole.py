"""Queries over whole texts and whole tables against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from lociweave.functions import pwm
from lociweave.plans.sequence_queries import MOTIF, PARTNER

_TURN = str.maketrans("ACGTN", "TGCAN")


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng, at = random.Random(5), str(tmp_path_factory.mktemp("whole"))
    texts = ["".join(rng.choice("acgtACGTNx ") for _ in range(n)) for n in (0, 1, 30, 39, 40, 399, 400, 401, 900, 1500)]
    texts += ["x" * 400 + "ACGCG" * 30 + "t" * 50, "a" * 450 + "x" + "AGCTGATCACGG" * 4]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, {i: re.sub("[^ACGTacgt]", "N", t).upper() for i, t in enumerate(texts)}


def _scores(seq, odds):
    """The score of each offset that has no N."""
    windows = {i: seq[i : i + len(odds)] for i in range(len(seq) - len(odds) + 1)}
    return {i: sum(float(row["ACGT".index(c)]) for row, c in zip(odds, w)) for i, w in windows.items() if "N" not in w}


def _both(matrix):
    odds = pwm.log_odds(pwm.probabilities(matrix))
    return odds, odds[::-1, ::-1]


def _best(seq):
    return max((round(x, 6) for o in _both(MOTIF) for x in _scores(seq, o).values()), default=-np.inf)


def _spaced(seq):
    best = -np.inf
    for a, b in itertools.product(_both(MOTIF), _both(PARTNER)):
        x, y = _scores(seq, a), _scores(seq, b)
        best = max([best, *(round(v + y[j], 6) for i, v in x.items() for g in (0, 2, 5) if (j := i + len(MOTIF) + g) in y)])
    return best


def _covariates(s):
    acgt = sum(s.count(c) for c in "ACGT")
    return (s.count("G") + s.count("C")) / max(acgt, 1), 100 * s.count("CG") / max(len(s) - 1, 1), (len(s) - acgt) / max(len(s), 1)


@pytest.mark.parametrize(
    "name, want",
    [
        ("q12_revcomp", lambda s: (s.translate(_TURN)[::-1], min(s, s.translate(_TURN)[::-1]))), ("q13_seq_covariates", _covariates),
        ("q14_longest_run", lambda s: (max(map(len, re.split("[^ACGT]+", s))),)), ("q24_pwm_max_scan", lambda s: (_best(s),)), ("q24b_pwm_panel_scan", lambda s: (_best(s),)),
        ("q25_spaced_pair_scan", lambda s: (_spaced(s),)), ("q63_digest", lambda s: (hashlib.sha256(s.encode()).hexdigest(),)),
    ],
)
def test_whole_texts(spark, texts, name, want):
    at, seqs = texts
    got = {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, at).collect()}
    assert got.keys() == seqs.keys()
    for i, s in seqs.items():
        assert got[i] == (pytest.approx(want(s), abs=2e-6) if isinstance(got[i][0], float) else want(s)), i


def test_whole_implant(spark, texts):
    at, seqs = texts
    got = {r.doc_id: (r.implanted, r.positive) for r in entry.queries()["q62_implant"](spark, at).collect()}
    assert got == {i: (s[:20] + "CCGCGNGG" + s[28:], i % 37 % 10 in (0, 1, 9)) for i, s in seqs.items() if len(s) >= 40}


def test_whole_links(spark, tmp_path):
    rng = random.Random(2)
    parts = [(i, round(rng.uniform(10, 40), 2), rng.randrange(1, 50)) for i in range(1, 90)]
    orders = [(i, rng.randrange(1, 45), float(rng.randrange(900, 4000))) for i in range(1, 700)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    places = [(k, 1 + k % 22, round(p * 100), round(p * 100) + 50 + n) for k, p, n in parts]
    loops = [((1 + c % 22, int(p), int(p) + 300), (1 + k % 22, int(p) + 5000, int(p) + 5600), float(k % 13)) for k, c, p in orders]
    meets = lambda a, b: a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
    want = {}
    for k, chrom, s, e in places:
        for g, c2, s2, _ in places:
            own, promoter = (chrom, s, e), (c2, s2 + 20, s2 + 200)
            rows = [(True, 0.0)] * meets(own, promoter)
            rows += [(False, score) for a, b, score in loops for x, y in ((a, b), (b, a)) if meets(own, x) and meets(promoter, y)]
            if rows:
                want.setdefault((f"g{g % 97}", f"L{k}"), []).extend(rows)
    want = {key: (any(d for d, _ in rows), len(rows), max(x for _, x in rows)) for key, rows in want.items()}
    got = {(r.gene, r.locus_id): (r.direct, r.loop_count, r.loop_score) for r in entry.queries()["q20_links_agg"](spark, str(tmp_path)).collect()}
    assert got == want and len({g for g, _ in got}) > 30


def test_whole_pairs(spark, tmp_path):
    rng = random.Random(3)
    orders = [(i, rng.randrange(1, 9), float(rng.randrange(1, 6))) for i in range(1, 40)] + [(50, 99, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    d = []
    for c in {c for _, c, _ in orders}:
        own = [p for _, x, p in sorted(orders) if x == c]
        d += [a - b for a, b in zip(own, own[1:])]
    r = entry.queries()["q35_paired"](spark, str(tmp_path)).first()
    assert r.pairs == len(d) == len(orders) - len({c for _, c, _ in orders})
    assert r.pairwise_accuracy == pytest.approx(sum(1.0 if x > 0 else 0.5 * (x == 0) for x in d) / len(d), abs=1e-8)
    assert r.counterfactual_delta == pytest.approx(np.mean(d), abs=1e-4) and r.counterfactual_delta_std == pytest.approx(np.std(d, ddof=1), abs=1e-4)


def test_whole_partner_grid(spark, tmp_path):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("nation", [(0, "N0"), (1, "N1"), (2, "N2")], "n_nationkey int, n_name string")
    make("supplier", [(1, 0), (2, 1)], "s_suppkey long, s_nationkey int")
    make("part", [(1, "B1"), (2, "B2")], "p_partkey long, p_brand string")
    make("lineitem", [(1, 1, 40.0, 0.0), (1, 1, 30.0, 0.08), (2, 2, 50.0, 0.04)], "l_partkey long, l_suppkey long, l_quantity double, l_tax double")
    got = {(r["sample"], r.partner): (r.tpm, r.supported) for r in entry.queries()["q52_partner_grid"](spark, str(tmp_path)).collect()}
    want = {(n, b): (0.0, False) for n in ("N0", "N1", "N2") for b in ("B1", "B2")}
    assert got == want | {("N0", "B1"): (70.0, True), ("N1", "B2"): (50.0, False)}
