"""Readers and sinks: each query writes a whole table in a file format, reads it back with the library's reader, and returns what it read."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import audit, intervals, metrics, panel, sinks
from lociweave.plans.loci_queries import points
from lociweave.plans.registry import query, table
from lociweave.sources import binary, supplements, text, writers

#: Points, one in 22 of them off the autosomes.
_P = "p AS (SELECT CASE WHEN l_suppkey % 22 = 21 THEN 'chrX' ELSE 'chr' || (1 + l_suppkey % 22) END AS chrom, floor(l_extendedprice)::BIGINT AS s, * FROM lineitem)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("chrom", F.when(F.col("l_suppkey") % 22 == 21, "chrX").otherwise(F.col("chrom")))


def _lines(df: DataFrame, *columns: Column | str, sep: str = "\t") -> str:
    """A folder of files with these columns, joined."""
    return writers.put_lines(df.select(F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])), writers.shared_folder(df.sparkSession))


def _csv(df: DataFrame) -> str:
    df.write.csv(at := writers.shared_folder(df.sparkSession), sep="\t", header=True)
    return at


@query(f"""WITH {_P} SELECT chrom, s AS start, s + 200 + l_quantity::BIGINT AS "end", CASE WHEN l_linenumber % 3 = 0 THEN (2 * s + 200 + l_quantity::BIGINT) // 2 ELSE s + l_linenumber * 7 END AS midpoint FROM p WHERE chrom <> 'chrX'""")
def q70_read_narrowpeak(spark, sf_dir):
    p = _points(spark, sf_dir)
    s = F.col("midpoint")
    summit = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_linenumber") * 7)
    at = _lines(p, "chrom", s, s + 200 + F.col("l_quantity").cast("long"), F.lit("peak"), "l_quantity", F.lit("."), "l_discount", "l_tax", "l_tax", summit)
    return text.narrowpeak(spark, at).select("chrom", "start", "end", "midpoint")


@query(f"""WITH {_P} SELECT chrom, s AS start, s + 150 AS "end", s + 75 AS midpoint, l_quantity - 10 AS ght_score, l_discount AS fdr FROM p WHERE chrom <> 'chrX' AND l_discount <= 0.05 AND l_quantity > 10""")
def q71_read_magix(spark, sf_dir):
    s, one = F.col("midpoint"), F.lit(1.0)
    rows = _points(spark, sf_dir).select(
        F.col("chrom").alias("chr"), s.alias("start"), (s + 150).alias("stop"), F.lit("x").alias("name"), F.col("l_tax").alias("coefficient.br"), (F.col("l_quantity") - 10).alias("coefficient.ar"),
        one.alias("full_LL"), one.alias("reduced_LL"), F.col("l_tax").alias("pvalue"), F.col("l_discount").alias("fdr"),
    )
    return text.magix(spark, _csv(rows)).select("chrom", "start", "end", "midpoint", "ght_score", "fdr")


@query("SELECT 'chr' || (1 + c_nationkey) AS chrom, sum(c_custkey + 1)::BIGINT AS size FROM customer WHERE c_nationkey < 22 GROUP BY 1")
def q72_read_chrom_sizes(spark, sf_dir):
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_custkey") + 1).alias("n"))
    return text.chrom_sizes(spark, _lines(by, F.concat(F.lit("chr"), (F.col("c_nationkey") + 1).cast("string")), "n"))


_GENE = """g AS (SELECT 'chr' || (1 + p_partkey % 24) AS chrom, p_partkey % 24 < 22 AS autosome, 1000 + p_partkey * 37 AS s, 1500 + p_partkey * 37 + p_size AS e, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
 'ENSG' || (p_partkey % 700) AS id, 'GENE' || (p_partkey % 700) AS gene, 'ENST' || p_partkey AS transcript FROM part)"""


def _gtf(spark: SparkSession, sf_dir: str, feature: str) -> str:
    k = F.col("p_partkey")
    attributes = F.format_string('gene_id "ENSG%s.%s"; transcript_id "ENST%s.1"; gene_name "GENE%s";', k % 700, F.col("p_size"), k, k % 700)
    strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    return _lines(table(spark, sf_dir, "part"), F.concat(F.lit("chr"), (1 + k % 24).cast("string")), F.lit("x"), F.lit(feature), 1001 + k * 37, 1500 + k * 37 + F.col("p_size"), F.lit("."), strand, F.lit("."), attributes)


@query(f"""WITH {_GENE} SELECT chrom, CASE strand WHEN '-' THEN e - 1 ELSE s END AS tss, greatest(CASE strand WHEN '-' THEN e - 1 ELSE s END - 2000, 0) AS promoter_start, CASE strand WHEN '-' THEN e - 1 ELSE s END + 2000 AS promoter_end,
 min(id) AS gene_id, gene FROM g WHERE autosome GROUP BY ALL""")
def q73_read_promoters(spark, sf_dir):
    return text.gencode_genes(spark, _gtf(spark, sf_dir, "gene"))


@query(f"WITH {_GENE} SELECT DISTINCT transcript, gene FROM g")
def q74_read_transcript_genes(spark, sf_dir):
    return text.transcript_genes(spark, _gtf(spark, sf_dir, "transcript"))


@query("""WITH l AS (SELECT 'chr' || (1 + o_custkey % 24) AS a, 'chr' || (1 + o_orderkey % 23) AS b, o_totalprice::BIGINT AS s, o_custkey % 24 < 22 AND o_orderkey % 23 < 22 AS autosome, CASE WHEN o_orderkey % 11 = 0 THEN 1.0 ELSE (o_orderkey % 17)::DOUBLE END AS v FROM orders)
SELECT a AS chrom1, greatest((2 * s + 900) // 2 - 500, 0) AS start1, greatest((2 * s + 900) // 2 - 500, 0) + 1000 AS end1, b AS chrom2, greatest((2 * s + 40700) // 2 - 500, 0) AS start2, greatest((2 * s + 40700) // 2 - 500, 0) + 1000 AS end2, v AS loop_score FROM l WHERE autosome""")
def q75_read_loops(spark, sf_dir):
    s, k = F.rint("o_totalprice").cast("long"), F.col("o_orderkey")
    chrom = lambda x: F.concat(F.lit("chr"), (1 + x).cast("string"))
    score = F.when(k % 11 == 0, "na").otherwise((k % 17).cast("string"))
    return text.bedpe(spark, _lines(table(spark, sf_dir, "orders"), chrom(F.col("o_custkey") % 24), s, s + 900, chrom(k % 23), s + 20_000, s + 20_700, score), 1000, 6)


@query("SELECT 'ENSG' || c_custkey AS gene, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS tpm, c_nationkey::DOUBLE AS expected_count, 0.0::DOUBLE AS length FROM customer")
def q76_read_rsem(spark, sf_dir):
    bal = F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(F.format_string("ENSG%s.7", "c_custkey").alias("Gene_ID"), F.when(bal < 0, "none").otherwise(bal.cast("string")).alias("TPM"), F.col("c_nationkey").alias("Expected_Count"))
    return text.rsem_genes(spark, _csv(rows))


@query("""SELECT 'G' || s_suppkey AS gene, s_acctbal AS "baseMean", (s_nationkey - 12)::DOUBLE AS "log2FoldChange", 0.5::DOUBLE AS "lfcSE", 0.01::DOUBLE AS pvalue, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0.05::DOUBLE END AS padj, -(s_nationkey - 12)::DOUBLE AS gcm1_dependence FROM supplier""")
def q77_read_deseq2(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.format_string("G%s", "s_suppkey").alias("gene"), F.col("s_acctbal").alias("baseMean"), (F.col("s_nationkey") - 12).alias("log2FoldChange"), F.lit(0.5).alias("lfcSE"), F.lit(0.01).alias("pvalue"),
        F.when(F.col("s_suppkey") % 3 == 0, "NA").otherwise("0.05").alias("padj"),
    )
    return text.deseq2_results(spark, _csv(rows))


@query(f"WITH {_GENE}, t AS (SELECT 'ENST' || (l_partkey + l_suppkey % 3) AS transcript, l_quantity AS tpm FROM lineitem) SELECT gene, round(sum(tpm), 4) AS tpm, count(*)::BIGINT AS transcripts FROM t JOIN g USING (transcript) GROUP BY gene")
def q78_read_salmon_rollup(spark, sf_dir):
    quant = table(spark, sf_dir, "lineitem").select(F.format_string("ENST%s.2|x|y", F.col("l_partkey") + F.col("l_suppkey") % 3).alias("Name"), F.col("l_quantity").alias("TPM"))
    out = audit.tpm_rollup(text.salmon_quant(spark, _csv(quant)), text.transcript_genes(spark, _gtf(spark, sf_dir, "transcript")))
    return out.select("gene", F.round("tpm", 4).alias("tpm"), "transcripts")


@query("SELECT 'R' || l_orderkey AS run, 'u' || l_partkey || '/' || l_linenumber || '/' || l_suppkey AS url, md5(l_partkey::VARCHAR) AS md5, l_quantity::BIGINT AS size FROM lineitem")
def q79_read_run_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("/", F.format_string("u%s", "l_partkey"), "l_linenumber", "l_suppkey").alias("u"), F.md5(F.col("l_partkey").cast("string")).alias("m"), F.col("l_quantity").cast("long").cast("string").alias("b"))
    by = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("u", "m", "b"))).alias("x"))
    lists = by.select(F.format_string("R%s", "l_orderkey").alias("run_accession"), *[F.array_join(F.col(f"x.{c}"), ";").alias(n) for c, n in (("u", "fastq_ftp"), ("m", "fastq_md5"), ("b", "fastq_bytes"))])
    return text.ena_report(spark, _csv(lists))


@query("""SELECT 'GSM' || conv_id AS sample, 'Sample_' || role AS key, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS "values" FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL GROUP BY ALL""")
def q80_read_soft_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("conv_id is not null and role is not null")
    turn = F.concat(F.lit("!Sample_"), "role", F.lit(" = "), F.col("turn").cast("string"))
    body = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    at = writers.put_lines(body.select(F.concat(F.lit("^SERIES = s\n^SAMPLE = GSM"), F.col("conv_id").cast("string"), F.lit("\n"), "b")), writers.shared_folder(spark))
    return text.soft_samples(spark, at).select("sample", "key", F.array_join("values", ",").alias("values"))


@query("SELECT s_name AS filename, 1000 + s_suppkey AS size FROM supplier")
def q81_read_file_sizes(spark, sf_dir):
    return text.file_sizes(spark, _lines(table(spark, sf_dir, "supplier"), F.lit("File"), "s_name", F.lit("01/01/2020"), 1000 + F.col("s_suppkey"), F.lit("TAR")))


@query("SELECT (rank() OVER (ORDER BY p_partkey))::INTEGER AS position, 'P' || p_partkey AS name, upper(replace(p_name, ' ', '')) || upper(replace(p_type, ' ', '')) AS sequence FROM part")
def q82_read_fasta(spark, sf_dir):
    one = F.concat(F.lit(">P"), F.col("p_partkey").cast("string"), F.lit(" of "), "p_brand", F.lit("\n"), "p_name", F.lit("\n"), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", one.alias("value")).repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey")
    return text.fasta(spark, writers.put_lines(rows.select("value"), writers.shared_folder(spark))).select("position", "name", "sequence")


_COUNTS = "[(s_suppkey % 7)::DOUBLE, (s_nationkey + 1)::DOUBLE, (s_suppkey % 5)::DOUBLE, 2.0::DOUBLE]"


@query(f"""SELECT 'MA' || s_suppkey || '.1' AS matrix_id, s_name AS symbol, array_to_string(list_transform({_COUNTS}, lambda x: x::BIGINT::VARCHAR), ' ') AS first_row, 3::INTEGER AS positions FROM supplier""")
def q83_read_jaspar(spark, sf_dir):
    base = lambda b, x: F.concat(F.lit(f"\n{b} [ "), F.concat_ws(" ", x.cast("string"), (x + 1).cast("string"), (x * 2).cast("string")), F.lit(" ]"))
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(">MA"), s.cast("string"), F.lit(".1 "), "s_name", base("A", s % 7), base("C", n + 1), base("G", s % 5), base("T", F.lit(2))))
    out = text.jaspar(spark, writers.put_lines(rows, writers.shared_folder(spark)))
    return out.select("matrix_id", "symbol", F.array_join(F.transform(F.col("counts")[0], lambda x: x.cast("long").cast("string")), " ").alias("first_row"), F.size("counts").alias("positions"))


@query("SELECT 'MA' || s_suppkey AS motif, 's' || s_nationkey AS symbol, 2::INTEGER AS positions, round((s_suppkey % 9 + 1 + 1e-6::DOUBLE) / (s_suppkey % 9 + 7 + 4e-6::DOUBLE), 9) AS first FROM supplier")
def q84_read_mex(spark, sf_dir):
    s = F.col("s_suppkey")
    lines = F.concat_ws("\n", F.format_string(">MA%s", s), F.format_string("symbol: s%s", "s_nationkey"), F.lit("A\tC\tG\tT"), F.concat_ws("\t", (s % 9 + 1).cast("string"), F.lit("1"), F.lit("2"), F.lit("3")), F.lit("0.25\t0.25\t0.25\t0.25"), F.lit(""))
    out = text.mex_matrices(spark, writers.put_lines(table(spark, sf_dir, "supplier").select(lines), writers.shared_folder(spark)))
    return out.select("motif", "symbol", F.size("probabilities").alias("positions"), F.round(F.col("probabilities")[0][0], 9).alias("first"))


@query("SELECT n_name || '.txt' AS name, n_name || ',' || n_regionkey AS content FROM nation WHERE n_name NOT LIKE '%7'")
def q85_read_archive(spark, sf_dir):
    """A zip file of each region with a member for each nation."""

    def make(frame: pd.DataFrame) -> bytes:
        return writers.zip_bytes({f"{n}.{'bin' if n.endswith('7') else 'txt'}": f"{n},{r}".encode() for n, r in zip(frame["n_name"], frame["n_regionkey"])})

    out = binary.archive_members(spark, writers.made_files(table(spark, sf_dir, "nation"), ["n_regionkey"], make, "{}.zip"), r".*\.txt")
    return out.select("name", F.col("content").cast("string").alias("content"))


@query("SELECT (3 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT AS row_no, n_nationkey::VARCHAR AS \"Key\", CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS \"Name\" FROM nation")
def q86_read_workbook(spark, sf_dir):
    """A workbook of each region."""

    def make(frame: pd.DataFrame) -> bytes:
        own = frame.sort_values("n_nationkey")
        rows = [[int(k), None, None if r == 2 else n] for k, r, n in zip(own["n_nationkey"], own["n_regionkey"], own["n_name"])]
        return writers.workbook_bytes({"notes": [["read <me> & go"]], "S1": [["title"], [None], ["Key", "x", "Name"], *rows]})

    return binary.header_table(binary.xlsx_rows(spark, writers.made_files(table(spark, sf_dir, "nation"), ["n_regionkey"], make, "{}.xlsx"), "S1"), 3, ["Key", "Name"])


def _nations(spark: SparkSession, sf_dir: str, make: Callable[[pd.DataFrame], list[list]], sheet: str) -> DataFrame:
    """The rows of a workbook of all nations, made by a task."""
    book = lambda frame: writers.workbook_bytes({sheet: make(frame.sort_values("n_nationkey"))})
    return binary.xlsx_rows(spark, writers.made_files(table(spark, sf_dir, "nation"), [], book, "{}.xlsx"), sheet)


@query("""SELECT b.n_name AS bait, p.n_name AS prey, (b.n_nationkey + p.n_nationkey) % 4 <> 0 AS tested, (b.n_nationkey + p.n_nationkey) % 4 IN (2, 3) AS composite_motif, (b.n_nationkey + p.n_nationkey) % 4 = 3 AS spacing_or_orientation FROM nation b CROSS JOIN nation p""")
def q87_read_interaction_matrix(spark, sf_dir):
    def make(frame: pd.DataFrame) -> list[list]:
        names, value = list(zip(frame["n_nationkey"], frame["n_name"])), ("N/A", "0", "1-FR", "1-FR, 2-RR")
        return [["Section A"], ["Prey\\Bait", *(n for _, n in names)], *([n, *(value[(b + k) % 4] for b, _ in names)] for k, n in names), ["Section B"], ["x", "y"]]

    out = supplements.interaction_matrix(_nations(spark, sf_dir, make, "T2"))
    return out.select("bait", "prey", "tested", "composite_motif", "spacing_or_orientation")


@query("""SELECT 'N' || n_nationkey || '_M' || n_regionkey AS pair, 'b' || n_regionkey AS batch, CASE WHEN n_regionkey % 2 = 0 THEN 'composite' ELSE 'spacing' END AS interaction_type, n_nationkey % 2 = 0 AS representative, 3::INTEGER AS positions, (4 * n_nationkey + 6)::DOUBLE AS first_total FROM nation""")
def q88_read_pwm_models(spark, sf_dir):
    def make(frame: pd.DataFrame) -> list[list]:
        rows: list[list] = [["Title"], ["Base", "TF_pairs", "ligand"]]
        for k, r in zip(map(int, frame["n_nationkey"]), frame["n_regionkey"]):
            rows.append(["Base", f"N{k}_M{r}", "ACGTN", f"b{r}", "NNN", 1, "3", "composite" if r % 2 == 0 else "spacing", "YES" if k % 2 == 0 else "NO"])
            rows += [[b, k + i, 1, 2] for i, b in enumerate("ACGT")]
        return rows

    out = supplements.pwm_models(_nations(spark, sf_dir, make, "T3"))
    total = F.aggregate(F.col("counts")[0], F.lit(0.0), lambda a, x: a + x)
    return out.select("pair", "batch", "interaction_type", "representative", F.size("counts").alias("positions"), total.alias("first_total"))


@query("SELECT 'N' || n_nationkey || '_M' || n_regionkey AS pair, 'ACGT' AS left_kmer, 'TTT' AS right_kmer, (29 * n_nationkey + 406)::BIGINT AS counts FROM nation")
def q89_read_spacing(spark, sf_dir):
    def make(frame: pd.DataFrame) -> list[list]:
        rows = [[f"N{k}_M{r}", "bc", "b1", "t", "acgt.ttt", *(int(k) + g for g in range(29))] for k, r in zip(frame["n_nationkey"], frame["n_regionkey"])]
        return [["Title"], ["TF1_TF2", "barcode", "batch", "type", "kmer1.kmer2", *(f"Count Gap {g}" for g in range(29))], *rows]

    out = supplements.spacing_counts(_nations(spark, sf_dir, make, "T7"))
    return out.select("pair", "left_kmer", "right_kmer", F.aggregate("gap_counts", F.lit(0), lambda a, x: a + x).cast("long").alias("counts"))


@query("""WITH s AS (SELECT 'chr' || (1 + s_nationkey % 22) AS chrom, s_suppkey * 1000 AS s, s_suppkey * 1000 + 100 + s_nationkey AS e, (s_nationkey + 1)::DOUBLE AS v FROM supplier),
 l AS (SELECT p_partkey AS locus_id, 'chr' || (1 + p_partkey % 22) AS chrom, p_partkey * 53 AS a, p_partkey * 53 + 2000 AS b FROM part)
SELECT locus_id, round(coalesce(sum(v * (least(b, e) - greatest(a, s))) / sum(least(b, e) - greatest(a, s)), 0), 6) AS signal FROM l LEFT JOIN s ON l.chrom = s.chrom AND a < e AND s < b GROUP BY locus_id""")
def q90_read_bigwig(spark, sf_dir):
    """A bigWig file for each chromosome, made and read by tasks."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    rows = s.select(F.concat(F.lit("chr"), (1 + F.col("s_nationkey") % 22).cast("string")).alias("chrom"), (k * 1000).alias("a"), (k * 1000 + 100 + F.col("s_nationkey")).alias("b"), (F.col("s_nationkey") + 1).cast("double").alias("v"))

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("a")
        return pd.DataFrame({"content": [writers.bigwig_bytes({own["chrom"].iloc[0]: (1 << 30, list(zip(own["a"], own["b"], own["v"])))}, 4, 8)]})

    signal = binary.bigwig_content(rows.groupBy("chrom").applyInPandas(make, "content binary"))
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("locus_id"), F.concat(F.lit("chr"), (1 + k % 22).cast("string")).alias("chrom"), (k * 53).alias("start"), (k * 53 + 2000).alias("end"))
    return intervals.interval_mean(own, signal, "signal").select("locus_id", F.round("signal", 6).alias("signal"))


_GENOME = "'ACGTTGCANGGC'"


@query(f"""WITH g AS (SELECT 'chr' || (n_nationkey + 1) AS chrom, repeat({_GENOME}, 20 + n_nationkey) AS seq FROM nation),
 l AS (SELECT p_partkey AS locus_id, 'chr' || (1 + p_partkey % 25) AS chrom, p_partkey * 7 % 520 AS mid FROM part)
SELECT locus_id, substring(repeat('N', 20) || seq || repeat('N', 400), (mid + 1)::BIGINT, 40) AS sequence FROM l JOIN g USING (chrom)""")
def q91_read_genome_contexts(spark, sf_dir):
    """A 2bit file for each chromosome, made and read by tasks."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), (n + 1).cast("string")).alias("chrom"), F.repeat(F.lit(_GENOME.strip("'")), (20 + n).cast("int")).alias("seq"))

    def make(frames):
        for frame in frames:
            yield pd.DataFrame({"content": [writers.twobit_bytes({c: s}) for c, s in zip(frame["chrom"], frame["seq"])]})

    genome = binary.twobit_content(rows.mapInPandas(make, "content binary"))
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("locus_id"), F.concat(F.lit("chr"), (1 + k % 25).cast("string")).alias("chrom"), (k * 7 % 520).alias("midpoint"))
    return binary.contexts(own, genome, 40).select("locus_id", "sequence")


@query("""SELECT s_suppkey::VARCHAR AS s_suppkey, rtrim(rtrim(round(s_acctbal, 2)::DECIMAL(18, 2)::VARCHAR, '0'), '.') AS s_acctbal, (s_suppkey % 2 = 0)::VARCHAR AS flag FROM supplier""")
def q92_write_tsv(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 2 == 0).alias("flag"))
    counts = sinks.write_tsv(rows, at := writers.shared_folder(spark), gzip=True)
    if counts["rows"] != rows.count():
        raise ValueError("rows are missing")
    return spark.read.csv(at, sep="\t", header=True)


@query("""SELECT c_nationkey::VARCHAR AS gene, round_even(min(c_acctbal), 0)::BIGINT AS a FROM customer GROUP BY 1""")
def q93_count_export(spark, sf_dir):
    return sinks.count_export(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("gene"), "c_acctbal").withColumnRenamed("c_acctbal", "a"), "gene", ["a"])


@query("""WITH r AS (SELECT o_orderkey AS run, 'tf' || (o_custkey % 40) AS tf, 'b' || (o_custkey % 7) AS batch FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), f AS (SELECT l_orderkey AS run, count(*) AS files, sum(l_quantity::BIGINT) AS bytes FROM lineitem GROUP BY 1),
 x AS (SELECT r.*, files, bytes FROM r JOIN f USING (run))
SELECT scope, count(*)::BIGINT AS runs, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT 'all' AS scope, files, bytes FROM x UNION ALL SELECT 'focal', files, bytes FROM x WHERE tf IN ('tf1', 'tf3') UNION ALL SELECT 'batch ' || batch, files, bytes FROM x) GROUP BY scope""")
def q94_rebuild_audit(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("long").alias("size"), F.lit("u").alias("url"))
    orders = table(spark, sf_dir, "orders").join(files.select(F.col("run").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    runs = orders.select(F.col("o_orderkey").alias("run"), F.format_string("tf%s", F.col("o_custkey") % 40).alias("tf"), F.col("o_custkey").alias("experiment"))
    experiments = orders.select(F.col("o_custkey").alias("experiment"), F.format_string("b%s", F.col("o_custkey") % 7).alias("batch"), F.lit(True).alias("approved")).distinct()
    return supplements.rebuild_audit(runs, experiments, files, ["tf1", "tf3"]).select("scope", "runs", "files", "bytes")


@query("""SELECT s_suppkey AS pos, s_nationkey AS n FROM supplier WHERE s_acctbal >= 0""")
def q95_resolve_columns(spark, sf_dir):
    """Columns found by their synonyms, in a file whose delimiter is found out."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" Supplier_ID"), F.col("s_nationkey").alias("NATION"), F.col("s_acctbal").alias("balance"))
    rows.write.csv(at := writers.shared_folder(spark), sep=";", header=True, ignoreLeadingWhiteSpace=False)
    found = text.delimited(spark, at)
    pick = lambda *names: F.col(f"`{text.resolve_column(found, list(names))}`")
    return found.filter(pick("balance").cast("double") >= 0).select(pick("supplier", "supplier_id").cast("long").alias("pos"), pick("country", "nation").cast("int").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 1 THEN 1 ELSE 0 END::INTEGER AS flag FROM orders""")
def q96_truth_tokens(spark, sf_dir):
    from lociweave.functions.sequence import is_true

    k = F.col("o_orderkey")
    token = F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, (k % 3).cast("string")).when(k % 4 == 2, "no")
    return table(spark, sf_dir, "orders").select(k.alias("id"), is_true(token).alias("flag"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, sqrt(l_quantity - 20) AS v FROM lineitem WHERE l_quantity >= 20 AND l_discount > 0""")
def q97_finite(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    v = F.when(d == 0, F.lit(float("inf"))).when(q < 20, F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(q - 20, F.lit(0.0))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", v.alias("v")).filter(metrics.finite(F.col("v")))


@query("SELECT c.c_custkey AS row, string_agg(x, ',' ORDER BY x) AS columns FROM customer c, (VALUES ('WT_1'), ('WT_2'), ('WT_3'), ('WT_4'), ('KO_1'), ('KO_2')) t(x) GROUP BY c.c_custkey")
def q98_count_columns(spark, sf_dir):
    names = ["gene", "KO_1", "KO_2", "WT_1", "WT_2", "WT_3", "WT_4", "length"]
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gene"), *[F.col("c_nationkey").alias(n) for n in names[1:]])
    found = panel.count_columns(frame)
    return frame.select(F.col("gene").alias("row"), F.lit(",".join(sorted(found))).alias("columns"))


def _block() -> Column:
    """The workbook of a supplier: a thousand go to each."""
    return F.expr("s_suppkey div 1000").alias("block")


def _books(rows: DataFrame, by: list[str], head: list[str], order: str, above: int = 1, header: bool = True) -> DataFrame:
    """The rows of workbooks, one for each group and made by its task: some lines above, a header, and the columns named in it, as text."""

    def make(frame: pd.DataFrame) -> bytes:
        own = frame.sort_values(order)
        values = [[None if v is None else str(v) for v in r] for r in own[head].itertuples(index=False, name=None)]
        return writers.workbook_bytes({"S": [*([f"note {k}"] for k in range(above)), *([head] if header else []), *values]})

    text_ = rows.select(*by, order, *[F.col(f"`{c}`").cast("string").alias(c) for c in head if c not in by and c != order])
    return binary.xlsx_rows(rows.sparkSession, writers.made_files(text_, by, make, "-".join(["book", *["{}"] * len(by)])), "S")


def _book(rows: DataFrame, by: list[str], head: list[str], order: str) -> DataFrame:
    return binary.header_table(_books(rows, by, head, order), 2, head)


@query("""SELECT 'E' || s_nationkey AS experiment, string_agg(s_suppkey || ':R' || s_suppkey, ',' ORDER BY s_suppkey) AS runs FROM supplier GROUP BY s_nationkey""")
def q123_run_inventory(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(_block(), k, F.format_string("E%s", "s_nationkey").alias("experiment"), k.alias("cycle"), F.format_string("R%s", k).alias("run"))
    out = supplements.run_inventory(_book(rows.unionByName(rows), ["block"], ["experiment", "cycle", "run"], "s_suppkey"))
    return out.select("experiment", F.array_join(F.transform("runs", lambda x: F.concat(x["cycle"].cast("string"), F.lit(":"), x["run"])), ",").alias("runs"))


_EXPERIMENTS = "SELECT 'X' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '_b' WHEN 1 THEN '_12' ELSE '' END AS experiment, 'TF' || n_regionkey AS tf, 'B' || n_regionkey || CASE WHEN n_nationkey % 3 = 0 THEN 'B' ELSE '' END AS batch, n_nationkey % 4 = 1 AS approved FROM nation WHERE n_nationkey % 2 = 1"


def _experiments(spark, sf_dir):
    k = F.col("n_nationkey")
    pick = lambda *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k % len(values))
    rows = table(spark, sf_dir, "nation").select(
        "n_regionkey", "n_nationkey", F.concat(F.format_string("X%s", k), pick("_b", "_12", "")).alias("experiment"), F.format_string("tf%s-dbd", "n_regionkey").alias("tf"),
        F.format_string("B%s", "n_regionkey").alias("batch"), pick("ChIP", "GHT").alias("assay"), pick("NO", "yes", None, "").alias("approved"),
    )
    return supplements.experiments(_book(rows, ["n_regionkey"], ["experiment", "tf", "batch", "assay", "approved"], "n_nationkey"), "ght")


@query(_EXPERIMENTS)
def q124_experiments(spark, sf_dir):
    return _experiments(spark, sf_dir)


@query(f"""WITH e AS ({_EXPERIMENTS}) SELECT tf, 'R' || experiment AS run, experiment, 2::INTEGER AS cycle, tf || '_MAGIX.bed' AS peak_file FROM e WHERE tf IN ('TF1', 'TF3') AND approved""")
def q125_selected_runs(spark, sf_dir):
    e = _experiments(spark, sf_dir)
    records = e.filter("approved").select(F.lower("tf").alias("tf"), F.concat(F.lit("R"), "experiment").alias("run"), "experiment", F.lit("2").alias("cycle"), F.concat("tf", F.lit("_MAGIX.bed")).alias("peak_file"))
    return supplements.agree(supplements.selected_runs(records.unionByName(records.withColumn("peak_file", F.lit("other.bed"))), ["TF1", "TF3"]), e)


@query("SELECT s_name AS filename, md5(s_suppkey::VARCHAR) AS md5 FROM supplier WHERE s_suppkey % 5 <> 0")
def q126_expected_hashes(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(_block(), k, "s_name", F.when(k % 5 != 0, F.upper(F.md5(k.cast("string")))).alias("md5"))
    return supplements.expected_hashes(_books(rows, ["block"], ["s_name", "md5"], "s_suppkey", 8, False), 8)


@query("""WITH r AS (SELECT 'TF' || (s_suppkey % 40) AS tf, 'F' || s_nationkey AS family, upper(replace(s_name, '#', '')) AS protein_sequence, s_suppkey FROM supplier) SELECT tf, family, protein_sequence FROM r QUALIFY row_number() OVER (PARTITION BY tf ORDER BY s_suppkey) = 1""")
def q127_constructs(spark, sf_dir):
    """A workbook of each factor, of which the first row counts."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.format_string("tf%s", k % 40).alias("TF_name"), F.format_string("F%s", "s_nationkey").alias("DBD"), F.replace("s_name", F.lit("#"), F.lit("")).alias("Sequence"))
    return supplements.constructs(_book(rows, ["TF_name"], ["TF_name", "DBD", "Sequence"], "s_suppkey"))


@query("""SELECT 'TF' || (s_suppkey % 10) AS bait, 'TF' || s_nationkey AS prey, arg_max(s_suppkey, s_suppkey)::VARCHAR AS value FROM supplier GROUP BY 1, 2""")
def q128_interaction_table(spark, sf_dir):
    """A workbook of each pair, of which the last row counts."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.format_string("tf%s", k % 10).alias("TF1"), F.format_string("tf%s", "s_nationkey").alias("TF2"), k.alias("signal"))
    return supplements.interaction_table(_book(rows, ["TF1", "TF2"], ["TF1", "TF2", "signal"], "s_suppkey"), "row_no")


@query("""SELECT DISTINCT s_name AS gene FROM supplier WHERE s_suppkey % 3 = 1""")
def q129_target_genes(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(_block(), k, F.get(F.array(F.lit("ST"), F.lit("EVT"), F.lit("x")), (k % 3).cast("int")).alias("Cell_state"), F.format_string(" %s ", "s_name").alias("Target"))
    return supplements.target_genes(_book(rows.unionByName(rows), ["block"], ["Cell_state", "Target"], "s_suppkey"), "evt")


@query("""SELECT s_name AS gene, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey::DOUBLE END AS "WT_1", s_nationkey::DOUBLE AS "KO_1" FROM supplier""")
def q130_count_table(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(_block(), k, F.col("s_name").alias("GeneID"), F.when(k % 4 == 0, "na").otherwise(k.cast("string")).alias("WT_1"), F.col("s_nationkey").alias("KO_1"))
    return supplements.count_table(_book(rows, ["block"], ["GeneID", "WT_1", "KO_1"], "s_suppkey"))
