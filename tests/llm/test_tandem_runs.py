"""Operator 11 against the definition of a run, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

from tests.llm.test_columns_and_paths import EXTRA
from tests.llm.test_text_operators import DOCS, corpus, empty, words


def runs_of(w, min_length=6, min_exponent=4):
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, unit = j - i + q, w[i : i + q]
            if size >= max(min_length, min_exponent * q, 2 * q) and not any(q % d == 0 and unit == unit[:d] * (q // d) for d in range(1, q)):
                found.append((i, size, q))
            i = max(i, j) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_of(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words_and_of_periodic_ones():
    from lociweave.llm.tandem_runs import batch_runs, collapse

    rng = random.Random(11)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 30, 80]), rng.choice([1, 2, 3, 5])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n > 3 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, n - a)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        for least, exponent in ((2, 2), (6, 4)):
            for w, got in zip(docs, batch_runs(docs, least, exponent), strict=True):
                want = runs_of(w, least, exponent)
                assert [tuple(r) for r in got.tolist()] == want
                assert collapse(w, got).decode() == collapsed_of([x.decode() for x in w], want)


def test_long_periodic_texts():
    from lociweave.llm.tandem_runs import batch_runs

    rng = random.Random(3)
    block = [b"%d" % rng.randrange(10**6) for _ in range(3000)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 20_000:
        a, b = b, b + a
    one, long_, fibonacci = batch_runs([[b"x"] * 50_000, block * 5 + block[:7], b], 6, 4)
    assert one.tolist() == [[0, 50_000, 1]] and long_.tolist() == [[0, 15_007, 3000]] and not len(fibonacci)


def test_query_against_brute_force(spark):
    from lociweave.llm.tandem_runs import find_runs, repeat_ends, summarise

    rng = random.Random(5)
    rows = [r for r in corpus() if r[0] != 903] + [(1000 + i, " ".join(str(rng.randrange(2)) for _ in range(rng.randrange(90))), "en", "s", "x") for i in range(200)]
    rows += [(2000, "no no no no no no no", "en", "s", "x"), (2000, "no no no no no no no", "en", "s", "x"), (2001, "x" * 200_000 + " y", "en", "s", "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(map(str, (tuple(r) for r in summarise(find_runs(repeat_ends(docs))).collect())))
    want = []
    for i, text, *_ in rows:
        w = words(text)
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_of(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed_of(w, runs))))
    assert got == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 20 and sum(r[1] > 1 for r in want) > 3


def test_edges(spark):
    from lociweave.llm.tandem_runs import find_runs

    assert find_runs(empty(spark)).count() == 0
    rows = [(i, t, *[f"{c}{i}" for c in EXTRA], "r") for i, t in [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b c"), (None, "x x x x x x")]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA) + ", Runs string")
    out = find_runs(frame)
    assert [c for c in out.columns if c in EXTRA] == EXTRA
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got == {1: ([], ""), 2: ([], ""), 3: ([], ""), 4: ([(0, 8, 2)], "a b c"), None: ([(0, 6, 1)], "x")}
