"""The votes against brute force, the bound on the sample, and labels that were kept back."""

import numpy as np

from lociweave.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(30)}" * int(rng.integers(1, 3)) for _ in range(int(rng.integers(1, 80)))).encode() for _ in range(700)] + [b"", b" ", b"a" * 300]
    found = [qc.terms(t) for t in texts]
    labels = rng.integers(0, 2, 600).astype(float)
    model = qc.Model(found[:600], labels)
    points = np.stack([model.project([f])[0] for f in found])
    got = model.score(found[600:])
    for f, v, s in zip(found[600:], points[600:], got):
        sims = points[:600].astype(float) @ v.astype(float)
        near = np.argsort(-sims, kind="stable")[: qc.NEIGHBOURS]
        w = np.maximum(sims[near], 0) ** qc.POWER
        want = (w * labels[near]).sum() / w.sum() if w.sum() > 1e-9 else labels.mean()
        assert abs(s - want) < 1e-3
    assert abs(got[-3] - labels.mean()) < 1e-9 and abs(got[-2] - labels.mean()) < 1e-9


def test_terms_take_the_whole_text():
    long = b" ".join(b"w%d" % (i % 999) for i in range(400_000))
    i, v = qc.terms(long)
    j, u = qc.terms(long + b" %%% ### %%%")
    assert len(i) and not np.array_equal(i, j) or not np.allclose(v, u)
    a, b = qc.terms(b"the the the the"), qc.terms(b"the of in at")
    assert qc.TERMS in a[0] and qc.TERMS not in b[0]  # recurrences at distance one


def test_sample_is_bounded_and_repeated_ids_count_once(spark):
    rows = [(i % 40, f"text number {i} of many") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, quality int")
    assert len(qc.fit(docs, labels).labels) <= 40
    assert len(qc.fit(docs, labels, most=7).labels) == 7


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.score_quality(docs, qc.fit(docs, labels)).filter(qc.held_out()).join(labels.dropna(subset=["quality"]).select("doc_id", "quality"), "doc_id").collect()
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
