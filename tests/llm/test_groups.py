"""Near duplicates in a large group whose members are near the first text but not always near each other."""

import random

import pytest

from tests.llm.test_text_operators import words


@pytest.mark.parametrize(("block", "finer", "ids", "links"), [(4000, 1 << 22, 250_000, 4_000_000), (700, 500, 0, 0)])
def test_near_dedup_group_against_brute_force(spark, monkeypatch, block, finer, ids, links):
    """With several blocks; and with finer sketches first, nothing broadcast and components by steps."""
    from lociweave.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FINER", finer)
    monkeypatch.setattr(near_dedup._bounded, "__defaults__", (ids,))
    monkeypatch.setattr(near_dedup.components, "__defaults__", (links,))
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            k = rng.randrange(len(w))
            if rng.random() < 0.4:
                w[k : k + 3] = []
            else:
                w[k] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(45))
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(30)) + " " + passage) for i in range(40)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [words(t)]}
    own = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and own[a] != own[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
                    changed = True
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == own
    assert len({c for i, c in own.items() if i < 100}) > 1  # some stay apart


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_of_chains(spark, most):
    from lociweave.llm.near_dedup import components

    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60) if i % 13 != 12] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(20)] + [(7, 7), (200, 201), (201, 200)]
    own = {x: x for e in links for x in e}
    for _ in own:
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), most).collect()}
    assert got == {x: c for x, c in own.items() if x != c}
    assert components(spark.createDataFrame([], "a long, b long"), most).count() == 0
