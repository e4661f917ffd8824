"""Operator 12 against sets of paragraphs, and its sketches taken apart."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_columns_and_paths import EXTRA
from tests.llm.test_text_operators import DOCS, WORDS, corpus, empty


def units(text):
    return {x for x in re.split(r"\n|(?<=[.!?]) ", text) if x}


def jaccard(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def story(rng, n):
    return "".join(" ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(6)) + rng.choice([". ", ".\n", "\n", "! "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    base = story(rng, 30)
    out = [r for r in corpus() if r[0] is not None] + [(1000 + i, story(rng, rng.choice([0, 1, 3, 20, 60, 400])) + base * (i % 3 == 0), "en", "s", "x") for i in range(60)]
    return out + [(-5, "first of all. Really.", "en", "s", "x"), (None, "before the first. No number.", "en", "s", "x"), (5000, story(rng, 3000), "en", "s", "x"), (5001, None, None, None, None)]


def test_query_against_sets(spark, rows):
    from lociweave.llm.fingerprints import edit_and_compare

    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = edit_and_compare(docs).collect()
    assert len(out) == len(rows)
    number = lambda r: (r[0] is not None, r[0] or 0)
    ids = [r[0] for r in rows]
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.text), []).append(r)
    order = sorted(rows, key=number)
    prints = {}
    for k, (i, text, *_) in enumerate(order):
        after = order[(k + 1) % len(order)]
        if ids.count(i) > 1 or ids.count(after[0]) > 1:
            continue  # rows with one doc_id follow each other by a hash
        text, following = text or "", after[1] or ""
        r = got[i, text][0]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(text, edited), abs=1e-12) and r.near_next == pytest.approx(jaccard(text, following), abs=1e-12)
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len(prints) > 100
    same = {p: {t for t in prints if p in prints[t]} for x in prints.values() for p in x}
    assert all(len({frozenset(units(t)) for t in texts}) == 1 for texts in same.values())


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_next_document(spark, partitions):
    from lociweave.llm.fingerprints import with_next

    rng = random.Random(partitions)
    ids = sorted(rng.sample(range(-(2**40), 2**40), 300)) + [2**62]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r.after.text for r in with_next(docs, "after").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: str(ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}


def test_sketches_come_apart(spark):
    """Small differences are recovered with their signs, whatever both sides have; large ones leave cells over, and larger tables tell them."""
    from lociweave.llm.fingerprints import difference, peel, sketch, subtract

    rng = random.Random(1)
    rows = []
    for k in range(40):
        both, a, b = ([rng.getrandbits(63) for _ in range(n)] for n in (rng.randrange(300), k // 2, k - k // 2))
        rows.append((k, sorted(both + a), sorted(both + b), sorted(a), sorted(b)))
    rows.append((500, sorted(rng.getrandbits(63) for _ in range(400)), sorted(rng.getrandbits(63) for _ in range(100)), [], []))
    df = spark.createDataFrame(rows, "k int, mine array<long>, other array<long>, a array<long>, b array<long>")
    out = df.select("*", peel(subtract(sketch(F.col("mine")), sketch(F.col("other")))).alias("small"), difference(F.col("mine"), F.col("other")).alias("all")).collect()
    for r in out:
        for found in (r.small, r["all"]):
            if found is not None and r.k < 500:
                assert (sorted(x.key for x in found if x.sign == 1), sorted(x.key for x in found if x.sign == -1)) == (r.a, r.b)
    assert sum(r.small is not None for r in out if r.k <= 10) >= 10 and out[-1].small is None
    assert {x.key for x in out[-1]["all"]} == set(out[-1].mine) | set(out[-1].other) and len(out[-1]["all"]) == 500


def test_a_table_that_never_comes_apart_is_compared(spark, monkeypatch):
    from lociweave.llm import fingerprints as op

    monkeypatch.setattr(op, "peel", lambda *_: F.lit(None).cast("array<struct<key: bigint, sign: int>>"))
    r = spark.createDataFrame([([1, 2, 3, 9], [3, 4])], "a array<long>, b array<long>").select(op.difference(F.col("a"), F.col("b")).alias("d")).first()
    assert sorted((x.key, x.sign) for x in r.d) == [(1, 1), (2, 1), (4, -1), (9, 1)]


def test_no_python_in_the_plan_and_one_shuffle(spark, rows):
    from lociweave.llm.fingerprints import edit_and_compare

    plan = edit_and_compare(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange ") <= 2 and "SinglePartition" not in plan


def test_edges(spark):
    from lociweave.llm.fingerprints import edit_and_compare, fingerprint

    assert edit_and_compare(empty(spark)).count() == 0
    one = edit_and_compare(spark.createDataFrame([(3, "one. two. three. four.")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.n_chars == 22
    long_ = edit_and_compare(spark.createDataFrame([(1, "x" * 500_000), (2, "a. b.\n" * 50_000)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in sorted(long_)] == [(1, 0.0), (2, 0.0)]
    frame = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in EXTRA], "r") for i, t in [(1, None), (2, ""), (2, ""), (None, "a b. c")]], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA) + ", Near_Next string")
    out = edit_and_compare(frame)
    assert [c for c in out.columns if c in EXTRA] == EXTRA and not [c for c in out.columns if c.startswith("__") and c not in EXTRA]
    for r in out.collect():
        assert len({r[c].removeprefix(c) for c in EXTRA}) == 1
        assert r.doc_id != 1 or r.near_next == 1.0
    assert fingerprint(frame).filter("doc_id = 1").first().paragraphs == []
