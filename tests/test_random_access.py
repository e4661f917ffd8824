"""Ranges of bigWig and 2bit files: what is read, what is pushed down, and paths of other stores."""

import io
import random

import pytest
from pyspark.sql import functions as F

from lociweave.operators.intervals import interval_mean
from lociweave.sources import binary, random_access, writers


def signal_of(rng, chroms=3, n=2000):
    out = {}
    for c in range(1, chroms + 1):
        at, rows = 0, []
        for _ in range(n):
            at += rng.randrange(3)
            rows.append((at, at := at + rng.randrange(1, 9), float(rng.randrange(-4, 9))))
        out[f"chr{c}"] = (at + 100, rows)
    return out


@pytest.fixture(scope="module")
def known():
    return signal_of(random.Random(3))


@pytest.mark.parametrize("fan", [2, 7, 256])
def test_the_index_leads_to_the_blocks_that_overlap(known, fan):
    f = binary.BigWigFile(io.BytesIO(writers.bigwig_bytes(known, 10, fan)))
    assert set(f.chroms) == set(known)
    rng = random.Random(fan)
    for _ in range(200):
        name = rng.choice(sorted(known))
        k, size = f.chroms[name]
        a = rng.randrange(size)
        b = a + rng.randrange(1, 300)
        before = f.read_blocks
        blocks = list(f.blocks(k, a, b))
        got = [x for at in blocks for x in zip(*(y.tolist() for y in f.columns(k, *at))) if x[0] < b and x[1] > a]
        want = [x for x in known[name][1] if x[0] < b and x[1] > a]
        assert got == want
        assert f.read_blocks - before <= len(want) // 10 + 2  # two at the ends are read in part
    assert [x for k in sorted(known) for x in f.values(f.chroms[k][0])] == [x for k in sorted(known) for x in known[k][1]]


def _loci(spark, rng, known, n=300):
    rows = [(f"l{i}", c := rng.choice(sorted(known)), a := rng.randrange(known[c][0]), a + rng.randrange(1, 200), "x") for i in range(n)]
    return spark.createDataFrame([*rows, ("far", "chr1", 10**8, 10**8 + 5, "x"), ("none", "chrX", 1, 5, "x"), ("null", "chr1", None, 5, "x"), ("empty", "chr1", 5, 5, "x")], "locus_id string, chrom string, start long, end long, S string")


@pytest.mark.parametrize("statistic", ["mean", "sum", "max"])
def test_statistics_at_loci_equal_the_join(spark, tmp_path, known, statistic):
    (tmp_path / "s.bw").write_bytes(writers.bigwig_bytes(known, 10, 7))
    binary.register(spark)
    loci = _loci(spark, random.Random(4), known).repartition(3)
    got = {r.locus_id: r.s for r in random_access.bigwig_statistic(loci, str(tmp_path / "s.bw"), "s", statistic).collect()}
    signal = spark.read.format("bigwig").load(str(tmp_path / "*.bw"))
    want = {r.locus_id: r.v for r in interval_mean(loci.drop("S"), signal, "v", statistic).collect()}
    assert got == pytest.approx(want) and len(got) == 304 and sum(v != 0 for v in got.values()) > 200
    content = binary.bigwig_content(spark.read.format("binaryFile").load(str(tmp_path / "s.bw")))
    assert sorted(content.collect()) == sorted(signal.collect())


def test_ranges_are_options(spark, tmp_path, known):
    (tmp_path / "s.bw").write_bytes(writers.bigwig_bytes(known, 10, 7))
    binary.register(spark)
    load = lambda **more: spark.read.format("bigwig").options(**more).load(str(tmp_path / "s.bw"))
    every = load()
    whole = sum(len(p.rest) // 2 for p in binary._BigWigReader({"path": str(tmp_path / "s.bw")}).partitions())
    for more, cond, most in (
        ({"chrom": "chr2"}, "chrom = 'chr2'", whole // 3), ({"chrom": "chr1, chr3", "start": 500, "end": 600}, "chrom in ('chr1', 'chr3') and s_start < 600 and s_end > 500", 16),
        ({"end": 40}, "s_start < 40", 9), ({"chrom": "chr7"}, "false", 0), ({}, "true", whole),
    ):
        assert sorted(load(**more).collect()) == sorted(every.filter(cond).collect()), more
        reader = binary._BigWigReader({"path": str(tmp_path / "s.bw")} | {k: str(v) for k, v in more.items()})
        assert sum(len(p.rest) // 2 for p in reader.partitions()) <= most
    # different filters over one table don't get into each other's way
    both = every.filter("chrom = 'chr1'").unionAll(every.filter("chrom = 'chr2' and s_start < 40"))
    assert both.filter("chrom = 'chr1'").count() == 2000 and every.count() == 6000


def test_contexts_read_what_the_loci_need(spark, tmp_path):
    rng = random.Random(6)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    genome = {"chr1": letters(5000, "ACGTacgt") + "N" * 300 + letters(200_000, "ACGTN"), "chr2": letters(30, "ACGT")}
    (tmp_path / "g.2bit").write_bytes(writers.twobit_bytes(genome))
    rows = [(f"a{i}", "chr1", rng.randrange(205_000)) for i in range(200)] + [("b", "chr2", 3), ("c", "chr2", 29), ("d", "chr3", 5), ("e", "chr1", 0), ("f", "chr1", 10**7), ("g", None, 4), ("h", "chr1", None)]
    loci = spark.createDataFrame(rows, "locus_id string, chrom string, midpoint long").repartition(3)
    got = {r.locus_id: r.sequence for r in random_access.twobit_contexts(loci, str(tmp_path / "g.2bit"), 40).collect()}
    padded = {c: "N" * 40 + "".join(x if x in "ACGT" else "N" for x in s.upper()) for c, s in genome.items()}
    want = {i: (padded.get(c, "")[m + 20 : m + 60].ljust(40, "N") if m is not None else "N" * 40) for i, c, m in rows}
    assert got == want
    binary.register(spark)
    chunks = spark.read.format("twobit").load(str(tmp_path / "g.2bit"))
    assert sorted(binary.twobit_content(spark.read.format("binaryFile").load(str(tmp_path / "g.2bit"))).collect()) == sorted(chunks.collect())
    old = {r.locus_id: r.sequence for r in binary.contexts(loci.filter("chrom is not null and midpoint is not null"), chunks, 40).collect()}
    assert all(old[k] == v for k, v in want.items() if k in old)
    f = binary.TwoBitFile(str(tmp_path / "g.2bit"))
    for i in range(10):
        f.sequence("chr1", 1000 * i, 1000 * i + 40)
    assert f.read_bytes <= 10 * 11


def test_paths_of_other_stores(spark, tmp_path, known):
    """viewfs is a store that only Spark's file systems read: the file is copied to the executors once; a file URL is read where it is."""
    (tmp_path / "remote.bw").write_bytes(writers.bigwig_bytes(known, 10, 7))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.signal.link./in", f"file://{tmp_path}")
    loci = _loci(spark, random.Random(8), known, 40)
    get = lambda path: {r.locus_id: r.s for r in random_access.bigwig_statistic(loci, path, "s").collect()}
    want = get(str(tmp_path / "remote.bw"))
    assert get(f"file://{tmp_path}/remote.bw") == want
    assert get("viewfs://signal/in/remote.bw") == want
    assert random_access.reachable(spark, "viewfs://signal/in/remote.bw") == "copied:remote.bw"
    with pytest.raises(FileNotFoundError):
        random_access.expand(str(tmp_path / "*.nothing"))
    assert loci.agg(F.count("*")).first()[0] == 44
