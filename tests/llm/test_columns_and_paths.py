"""Extra columns with names that the operators use inside, in any case; and both ways of the steps that broadcast what is small."""

import pytest

from tests.llm.test_text_operators import corpus

EXTRA = ["__id", "__DROPS", "__lost", "__words", "__ITEMS", "__rid", "__whole", "__Starts", "__part", "__h", "__n", "__s", "__flat", "rid", "h", "id"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(r[0], r[1], "s", *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


def _operators():
    from lociweave.llm.decontaminate import mark_contamination
    from lociweave.llm.license_scan import scan_licenses
    from lociweave.llm.line_dedup import dedup_lines
    from lociweave.llm.pii import mask_documents
    from lociweave.llm.quality_rules import strip_frequent_lines
    from lociweave.llm.substring_dedup import dedup_substrings

    bench = lambda d: d.sparkSession.createDataFrame([(1, "the end of this")], "item_id long, text string")
    return {
        "strip": strip_frequent_lines, "lines": dedup_lines, "lines by join": lambda d: dedup_lines(d, most=0), "substrings": dedup_substrings,
        "benchmark": lambda d: mark_contamination(d, bench(d)), "benchmark in pieces": lambda d: mark_contamination(d, bench(d), most_chars=3), "licenses": scan_licenses, "pii": mask_documents,
    }


@pytest.mark.parametrize("name", ["strip", "lines", "lines by join", "substrings", "benchmark", "benchmark in pieces", "licenses", "pii"])
def test_extra_columns_stay(frame, name):
    fn = _operators()[name]
    out = fn(frame)
    assert [c for c in out.columns if c in EXTRA] == EXTRA
    assert not [c for c in out.columns if c.startswith("__") and c not in EXTRA]
    for r in out.collect():
        assert len({r[c].removeprefix(c) for c in EXTRA}) == 1
    narrow = [c for c in out.columns if c not in EXTRA]
    key = lambda r: str(r.asDict())
    assert sorted(map(key, out.select(narrow).collect())) == sorted(map(key, fn(frame.drop(*EXTRA)).select(narrow).collect()))


def test_lines_both_ways(frame):
    from lociweave.llm.line_dedup import dedup_lines

    narrow = ["doc_id", "text", "n_lines", "n_dropped"]
    got = [sorted(map(str, dedup_lines(frame, most=m).select(narrow).collect())) for m in (0, 100_000)]
    assert got[0] == got[1]


def test_strip_frequent_lines_against_brute_force(spark):
    from lociweave.llm.quality_rules import strip_frequent_lines

    shared, own = "The same notice on many pages", "of its own {} and more of it"
    rows = [(i, "\n".join(([shared] if i % 2 else []) + [own.format(chr(97 + i % 26) * (i // 26 + 1))] * (i % 3)), "a" if i < 50 else None) for i in range(100)] + [(200, None, "a"), (201, "", None), (1, shared, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if x != shared] if host != "b" else lines
        n = sum(len(x.split()) for x in lines)
        if n - sum(len(x.split()) for x in left) <= 0.5 * n:
            want.append((i, None if text is None else "\n".join(left), host))
    assert sorted(map(str, (tuple(r) for r in strip_frequent_lines(docs).collect()))) == sorted(map(str, want))


def test_filters_merged_in_two_steps_miss_no_repeat(spark):
    """Every key in two documents is in the merged filter, with the pairs of few tasks and of more than the last step merges; other keys hardly are."""
    import numpy as np
    import xxhash
    from lociweave.llm import line_dedup as op

    rows = [(i, f"a line of its own, number {i:05d}\na line that two documents hold {i // 2:05d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = lambda texts: np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in texts], np.uint64)
    for tasks in (2, 3 * op.FAN):
        bloom = np.frombuffer(op.twice_filter(docs.repartition(tasks), op.LEAST_BITS, op.MIN_CHARS, tasks), np.uint8)
        assert op._test(bloom, keys(f"a line that two documents hold {i:05d}" for i in range(300))).all()
        assert op._test(bloom, keys(f"a line of its own, number {i:05d}" for i in range(600))).sum() < 6
    assert op.filter_tasks(1000, 6) == 12 and op.filter_tasks(100 * op.TASK_DOCUMENTS + 1, 6) == 101
