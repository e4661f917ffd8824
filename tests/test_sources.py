import random
import gzip
import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lociweave.sources import binary, text


def put(path, content):
    path.write_text(content)
    return str(path)


def test_narrowpeak_uses_summit_or_middle(spark, tmp_path):
    p = put(tmp_path / "a.narrowPeak", "# c\nchr1\t100\t180\tx\t1\t.\t1\t1\t1\t-1\nchr2\t10\t30\tx\t1\t.\t1\t1\t1\t5\nchrX\t1\t9\nchr3\t4\t9\n")
    got = {(r.chrom, r.midpoint) for r in text.narrowpeak(spark, p).collect()}
    assert got == {("chr1", 140), ("chr2", 15), ("chr3", 6)}
    for bad in ("chrX\t9\t9\n", "chr1\t1\t9\tx\t1\t.\t1\t1\t1\t8\n"):
        with pytest.raises(Exception, match="invalid peak"):
            text.narrowpeak(spark, put(tmp_path / "b.narrowPeak", bad)).collect()


def test_magix_keeps_positive_significant_autosomal(spark, tmp_path):
    head = "chr\tstart\tstop\tname\tcoefficient.br\tcoefficient.ar\tfull_LL\treduced_LL\tpvalue\tfdr\n"
    rows = "chr1\t100\t300\tpositive\t0.2\t1.4\t1\t1\t0.01\t0.01\nchr1\t100\t300\tnegative\t1\t-1\t1\t1\t0.01\t0.01\nchr1\t100\t300\tweak\t1\t1\t1\t1\t0.5\t0.5\nchrX\t100\t300\tx\t1\t1\t1\t1\t0.01\t0.01\n"
    got = text.magix(spark, put(tmp_path / "m.tsv", head + rows)).collect()
    assert [(r.name, r.midpoint, r.ght_score, r.ght_score_before_refinement) for r in got] == [("positive", 200, 1.4, 0.2)]
    with pytest.raises(Exception, match="invalid interval"):
        text.magix(spark, put(tmp_path / "n.tsv", head + rows.replace("100\t300\tpositive", "300\t100\tpositive"))).collect()


def test_chrom_sizes_in_natural_order(spark, tmp_path):
    got = text.chrom_sizes(spark, put(tmp_path / "s", "chr10 5\nchr2\t7\nchrX 9\n")).collect()
    assert [(r.chrom, r.size) for r in got] == [("chr2", 7), ("chr10", 5)]
    with pytest.raises(Exception, match="repeated"):
        text.chrom_sizes(spark, put(tmp_path / "t", "chr1 5\nchr1 6\n")).collect()


def test_gtf_bedpe_rsem_deseq(spark, tmp_path):
    gtf = 'chr1\tx\tgene\t1001\t2000\t.\t+\t.\tgene_id "G1.3"; gene_name "A";\nchr1\tx\tgene\t1001\t2000\t.\t-\t.\tgene_id "G2.1"; gene_name "B";\nchr1\tx\ttranscript\t1\t9\t.\t+\t.\ttranscript_id "T1.2"; gene_name "A";\n'
    g = {r.gene: (r.tss, r.promoter_start, r.promoter_end, r.gene_id) for r in text.gencode_genes(spark, put(tmp_path / "g.gtf", gtf)).collect()}
    assert g == {"A": (1000, 0, 3000, "G1"), "B": (1999, 0, 3999, "G2")}
    assert text.transcript_genes(spark, str(tmp_path / "g.gtf")).collect()[0].asDict() == {"transcript": "T1", "gene": "A"}
    b = text.bedpe(spark, put(tmp_path / "l", "chr1\t50\t150\tchr1\t4900\t5200\t4\nchrX\t1\t2\tchr1\t1\t2\t1\n"), 100, 6).collect()
    assert [(r.start1, r.end1, r.start2, r.end2, r.loop_score) for r in b] == [(50, 150, 5000, 5100, 4.0)]
    r = text.rsem_genes(spark, put(tmp_path / "r", "Gene_ID\tlength\tTPM\nENSG1.4\t10\t2.5\nENSG2.1\tx\ty\n")).collect()
    assert {(x.gene, x.tpm, x.length) for x in r} == {("ENSG1", 2.5, 10.0), ("ENSG2", 0.0, 0.0)}
    d = text.deseq2_results(spark, put(tmp_path / "d", "gene\tbaseMean\tlog2FoldChange\tlfcSE\tpvalue\tpadj\nA\t1\t-2\t1\t0.1\tNA\n")).collect()[0]
    assert d.gcm1_dependence == 2.0 and d.padj is None


def test_reports_and_records(spark, tmp_path):
    ena = "run_accession\tfastq_ftp\tfastq_md5\tfastq_bytes\nR1\ta;b\tm;n\t1;2\n"
    assert [(r.url, r.size) for r in text.ena_report(spark, put(tmp_path / "e", ena)).collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="unequal"):
        text.ena_report(spark, put(tmp_path / "f", ena.replace("m;n", "m"))).collect()
    with gzip.open(tmp_path / "s.soft.gz", "wt") as f:
        f.write("^SERIES = x\n^SAMPLE = GSM1\n!Sample_title = T1\n!Sample_supplementary_file = a\n!Sample_supplementary_file = b\n^SAMPLE = GSM2\n!Sample_title = T2\n")
    got = {(r.sample, r.key): list(r["values"]) for r in text.soft_samples(spark, str(tmp_path / "s.soft.gz")).collect()}
    assert got == {("GSM1", "Sample_title"): ["T1"], ("GSM1", "Sample_supplementary_file"): ["a", "b"], ("GSM2", "Sample_title"): ["T2"]}
    fasta = text.fasta(spark, put(tmp_path / "x.fa", ">a one\nacg\nTT\n>b\nGG\n")).orderBy("position").collect()
    assert [(r.name, r.sequence) for r in fasta] == [("a", "ACGTT"), ("b", "GG")]
    j = text.jaspar(spark, put(tmp_path / "m.jaspar", ">MA0001.1 GCM1\nA [ 9 0 ]\nC [ 0 9 ]\nG [ 0 0 ]\nT [ 0 0 ]\n")).collect()[0]
    assert (j.matrix_id, j.symbol, j.counts) == ("MA0001.1", "GCM1", [[9, 0, 0, 0], [0, 9, 0, 0]])


def test_archives_and_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hello")
        z.writestr("y.bin", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    got = {(r.name, bytes(r.content)) for r in binary.archive_members(spark, str(tmp_path / "*.*z*"), r".*\.txt").collect()}
    assert got == {("x.txt", b"hello"), ("d/x.txt", b"tar")}
    with pytest.raises(Exception, match="lacks"):
        binary.archive_members(spark, str(tmp_path / "a.zip"), names=["z"]).collect()
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>gene</t></si><si><t>A</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>4</v></c></row></sheetData></worksheet>')
    rows = binary.xlsx_rows(spark, str(tmp_path / "w.xlsx"))
    assert {(r.row_no, tuple(r.cells)) for r in rows.collect()} == {(2, ("gene", None, "n")), (3, ("A", None, "4"))}
    assert binary.header_table(rows, 2, ["gene", "n"]).collect()[0].n == "4"


def write_bigwig(path, chrom, size, values):
    """One uncompressed block of one chromosome, 64-byte header, a tree each."""
    data = struct.pack("<IIIIIBBH", 0, values[0][0], values[-1][1], 0, 0, 1, 0, len(values)) + b"".join(struct.pack("<IIf", *v) for v in values)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 8, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + chrom.encode().ljust(8, b"\0") + struct.pack("<II", 0, size)
    at = 64 + len(tree)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, values[0][0], 0, values[-1][1], at + len(data), 1, 0)
    index += struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, values[0][0], 0, values[-1][1], at, len(data))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, at + len(data), 0, 0, 0, 0, 0, 0)
    path.write_bytes(head + tree + data + index)


def write_twobit(path, seqs):
    names, records, at = b"", b"", 16 + sum(5 + len(n) for n in seqs)
    for n, s in seqs.items():
        names += bytes([len(n)]) + n.encode() + struct.pack("<I", at + len(records))
        runs, i = [], 0
        while i < len(s):
            if s[i] == "N":
                j = i
                while j < len(s) and s[j] == "N":
                    j += 1
                runs.append((i, j - i))
                i = j
            else:
                i += 1
        packed = bytes(sum("TCAG".index(c if c != "N" else "T") << (6 - 2 * k) for k, c in enumerate(s[i : i + 4])) for i in range(0, len(s), 4))
        records += struct.pack("<II", len(s), len(runs)) + b"".join(struct.pack("<I", a) for a, _ in runs) + b"".join(struct.pack("<I", b) for _, b in runs) + struct.pack("<II", 0, 0) + packed
    path.write_bytes(struct.pack("<IIII", 0x1A412743, 0, len(seqs), 0) + names + records)


def test_bigwig_means_and_twobit_contexts(spark, tmp_path):
    from lociweave.operators.intervals import interval_mean, liftover

    binary.register(spark)
    write_bigwig(tmp_path / "a.bw", "chr1", 1000, [(100, 200, 3.0), (250, 260, 5.0)])
    signal = spark.read.format("bigwig").load(str(tmp_path / "a.bw"))
    loci = spark.createDataFrame([("a", "chr1", 100, 200), ("b", "chr1", 300, 400), ("c", "chr1", 190, 255), ("d", "chr2", 1, 5)], "locus_id string, chrom string, start long, end long")
    got = {r.locus_id: r.v for r in interval_mean(loci, signal, "v").collect()}
    assert got["a"] == 3.0 and got["b"] == got["d"] == 0.0 and got["c"] == pytest.approx((10 * 3 + 5 * 5) / 15)  # over covered bases only
    seq = "ACGTTGCANNACGT" * 7000
    write_twobit(tmp_path / "g.2bit", {"chr1": seq, "chr2": "acgta".upper()})
    genome = spark.read.format("twobit").load(str(tmp_path / "g.2bit"))
    points = spark.createDataFrame([("a", "chr1", 3), ("b", "chr1", 65536), ("c", "chr1", len(seq) - 2), ("d", "chr2", 2)], "locus_id string, chrom string, midpoint long")
    got = {r.locus_id: r.sequence for r in binary.contexts(points, genome, 20).collect()}
    assert got == {"a": "N" * 7 + seq[:13], "b": seq[65526:65546], "c": seq[-12:] + "N" * 8, "d": "N" * 8 + "ACGTA" + "N" * 7}
    chain = tmp_path / "c.chain"
    chain.write_text("chain 1 chr1 1000 + 100 300 new1 1000 + 600 790 7\n100 10 0\n90\n")
    out = {r.locus_id: (r.mapped, r.mapped_chrom, r.mapped_start) for r in liftover(loci, binary.chain_blocks(spark, str(chain))).collect()}
    assert out == {"a": (True, "new1", 600), "b": (False, None, None), "c": (False, None, None), "d": (False, None, None)}


def test_liftover_over_gaps_strands_and_chains(spark, tmp_path):
    """Places worked out by hand."""
    from lociweave.operators.intervals import cross_assembly_signal, liftover

    chains = [
        "## a comment",
        "chain 900 chr1 1000 + 100 300 new1 1000 - 500 690 1\n100 10 0\n90\n",  # reverse: 100-200 to 400-500, 210-300 to 310-400
        "chain 500 chr1 1000 + 400 600 new2 1000 + 0 205 2\n50 0 5\n150\n",  # 400-450 to 0-50, 450-600 to 55-205
        "chain 700 chr1 1000 + 550 700 new3 1000 + 10 160\n150\n",  # without an id: 550-700 to 10-160
        "chain 700 chr2 1000 + 0 100 new1 1000 + 700 800 9\n100\n",
    ]
    (tmp_path / "c.chain").write_text("\n".join(chains))
    blocks = binary.chain_blocks(spark, str(tmp_path / "c.chain"))
    assert blocks.count() == 6
    want = {
        ("chr1", 110, 120): ("new1", 480, 490, "-", 10), ("chr1", 100, 200): ("new1", 400, 500, "-", 100),
        ("chr1", 150, 250): None,  # 90 of 100 bases
        ("chr1", 90, 300): None, ("chr1", 101, 299): ("new1", 311, 499, "-", 188) if 188 >= 0.95 * 198 else None,
        ("chr1", 440, 460): ("new2", 40, 65, "+", 20), ("chr1", 400, 600): ("new2", 0, 205, "+", 200),
        ("chr1", 560, 590): ("new3", 20, 50, "+", 30),  # both chains hold it, the better one counts
        ("chr1", 548, 588): ("new2", 153, 193, "+", 40),  # 38 of 40 by the better one is enough, see below
        ("chr1", 800, 900): None, ("chr2", 0, 100): ("new1", 700, 800, "+", 100), ("chr3", 0, 100): None,
    }
    want["chr1", 548, 588] = ("new3", 10, 48, "+", 38)
    loci = spark.createDataFrame([(f"{c}:{a}", c, a, b) for c, a, b in want], "locus_id string, chrom string, start long, end long")
    get = lambda df: {(r.chrom, r.start, r.end): (r.mapped_chrom, r.mapped_start, r.mapped_end, r.mapped_strand, r.mapped_bases) if r.mapped else None for r in df.collect()}
    assert get(liftover(loci, blocks)) == want
    assert get(liftover(loci, blocks, least=0.9))["chr1", 150, 250] == ("new1", 360, 450, "-", 90)
    assert {k for k, v in get(liftover(loci, blocks, unique=True)).items() if v is None and want[k]} == {("chr1", 560, 590), ("chr1", 548, 588)}
    signal = spark.createDataFrame([("new1", 480, 485, 4.0), ("new1", 485, 486, 10.0), ("new3", 0, 15, 2.0)], "chrom string, s_start long, s_end long, value double")
    sizes = spark.createDataFrame([("new1", 790), ("new3", 1000)], "chrom string, size long")
    got = {(r.chrom, r.start, r.end): (r.s_mapped, r.s, r.s_old_chrom, r.s_old_start, r.s_old_end) for r in cross_assembly_signal(loci, signal, blocks, sizes, "s", "old").collect()}
    assert got["chr1", 110, 120] == (True, 5.0, "new1", 480, 490) and got["chr1", 548, 588] == (True, 2.0, "new3", 10, 48) and got["chr1", 560, 590] == (True, 0.0, "new3", 20, 50)
    assert got["chr2", 0, 100] == got["chr1", 440, 460] == got["chr3", 0, 100] == (False, None, None, None, None)  # beyond the end, not there, not mapped


def test_sinks(spark, tmp_path):
    from lociweave.operators.sinks import count_export, write_tsv

    df = spark.createDataFrame([("a", 1 / 3, True), ("b", 2.0, False)], "k string, v double, f boolean")
    assert write_tsv(df, str(tmp_path / "o"), gzip=True) == {"rows": 2, "f": 1}
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).collect()} == {("a", "0.3333333333", "true"), ("b", "2", "false")}
    with pytest.raises(ValueError, match="nothing"):
        write_tsv(df.limit(0), str(tmp_path / "p"))
    c = count_export(spark.createDataFrame([("g", 2.5, 3.5), ("g", 9.0, 9.0)], "gene string, a double, b double"), "gene", ["a", "b"]).collect()
    assert [tuple(r) for r in c] == [("g", 2, 4)]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_archives_are_streams(spark, tmp_path):
    """Tar files are read from the front, and no further than the last wanted member; members come whole, or the archive is an error."""
    import io
    import tarfile

    def tar(path, members, mode="w:gz"):
        with tarfile.open(path, mode) as t:
            for name, content in members:
                info = tarfile.TarInfo(name)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))

    rng = random.Random(1)
    big = [(f"m{i}.txt", rng.randbytes(200_000)) for i in range(20)]
    tar(tmp_path / "a.tar.gz", big)
    tar(tmp_path / "b.tar", [("m3.txt", b"x"), ("m0.txt", b""), ("d/other", b"y")], "w")
    whole = (tmp_path / "a.tar.gz").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.tar.gz").write_bytes(whole[: len(whole) // 2])
    get = lambda path, **more: {(r.archive.rsplit("/", 1)[1], r.name): bytes(r.content) for r in binary.archive_members(spark, str(path), **more).collect()}
    assert get(tmp_path / "*.gz") == {("a.tar.gz", n): c for n, c in big}
    assert get(tmp_path, names=["m3.txt", "m0.txt"]) == {("a.tar.gz", "m0.txt"): big[0][1], ("a.tar.gz", "m3.txt"): big[3][1], ("b.tar", "m0.txt"): b"", ("b.tar", "m3.txt"): b"x"}
    assert get(tmp_path / "cut", names=["m2.txt", "m0.txt"]) == {("a.tar.gz", "m0.txt"): big[0][1], ("a.tar.gz", "m2.txt"): big[2][1]}  # the damaged end is not reached
    with pytest.raises(Exception):  # noqa: B017
        get(tmp_path / "cut", names=["m19.txt"])
    with pytest.raises(Exception, match="lacks nowhere"):
        get(tmp_path / "b.tar", names=["m0.txt", "nowhere"])
    content = binary.archive_members(spark, spark.read.format("binaryFile").load(str(tmp_path / "b.tar")), r"m.*")
    assert {r.name for r in content.collect()} == {"m0.txt", "m3.txt"}


def test_seeds_of_rows(spark):
    from lociweave.operators import synth

    got = spark.range(300).select("id", synth.seed_column(9, "pair", F.col("id")).alias("s")).collect()
    assert all(r.s == synth.derive_seed(9, "pair", r.id) for r in got)
