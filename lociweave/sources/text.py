"""Readers of delimited and line-structured text. Paths may be folders or globs in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave import schemas
from lociweave.functions.sequence import attributes
from lociweave.operators.loci import chrom_number
from lociweave.schemas import AUTOSOMES


def _checked(df: DataFrame, ok: Column, message: str, keep: Column) -> DataFrame:
    """The rows to keep; any row that isn't ok is an error, kept or not."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), keep).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _guard(ok: Column, message: str, value: Column) -> Column:
    """value, or an error where ok is false or null."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def peak_midpoint(start: Column, end: Column, summit_offset: Column) -> Column:
    """start + offset, or the middle where the offset is missing or -1."""
    return F.when(summit_offset >= 0, start + summit_offset).otherwise(F.floor((start + end) / 2).cast("long"))


def narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of 3 to 10 columns without a header; '#' begins a comment. Bad intervals and summits are errors, before other chromosomes go."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    cols = [F.get("c", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.NARROWPEAK)]
    p = raw.select(*cols)
    s, e, o = F.col("start"), F.col("end"), F.col("summit_offset")
    ok = (s >= 0) & (s < e) & (o.isNull() | (o < e - s))
    p = _checked(p, ok, "invalid peak interval or summit", F.col("chrom").isin(AUTOSOMES))
    return p.withColumn("midpoint", peak_midpoint(s, e, o))


def magix_calls(rows: DataFrame, fdr_max: float = 0.05, require_positive: bool = True) -> DataFrame:
    """Rows of fdr at most fdr_max and, if asked for, a score above zero; a missing fdr is no call."""
    out = rows.filter(F.col("fdr") <= fdr_max)
    return out.filter(F.col("score") > 0) if require_positive else out


def magix(spark: SparkSession, path: str, fdr_max: float = 0.05, require_positive: bool = True) -> DataFrame:
    """Called intervals with ght_score and midpoint; an interval that doesn't begin before its end is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schemas.MAGIX, mode="FAILFAST")
    p = raw.select(
        F.col("chr").alias("chrom"), "start", F.col("stop").alias("end"), "name", F.col("`coefficient.br`").alias("ght_score_before_refinement"),
        F.col("`coefficient.ar`").alias("score"), "full_LL", "reduced_LL", "pvalue", "fdr",
    )
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("fdr").isNull() | F.col("fdr").between(0, 1) | F.isnan("fdr"))
    p = _checked(p, ok, "invalid interval or fdr", F.col("chrom").isin(AUTOSOMES) & ~F.isnan("fdr"))
    p = magix_calls(p.withColumn("midpoint", F.expr("(start + end) div 2")), fdr_max, require_positive)
    return p.withColumnRenamed("score", "ght_score").withColumns({"ght_fdr_threshold": F.lit(fdr_max), "ght_positive_required": F.lit(require_positive)})


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) of autosomes in natural order; repeats and sizes below one are errors."""
    p = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
    p = p.select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("size")).filter(F.col("chrom").isin(AUTOSOMES))
    by = p.groupBy("chrom").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("size").alias("least"))
    size = _guard((F.col("n") == 1) & (F.col("least") > 0), "repeated chromosome or size below one", F.col("size"))
    return by.select("chrom", size.alias("size")).orderBy(chrom_number(F.col("chrom")))


def _gtf(spark: SparkSession, path: str, feature: str) -> DataFrame:
    p = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string", quote="")
    return p.filter(F.col("feature") == feature).withColumn("a", attributes(F.col("attributes")))


def gencode_genes(spark: SparkSession, path: str, half_width: int = 2000) -> DataFrame:
    """Promoters of autosomal genes: distinct (gene, chrom, tss); one-based GTF coordinates become zero-based."""
    p = _gtf(spark, path, "gene").filter(F.col("chrom").isin(AUTOSOMES))
    tss = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start") - 1)
    p = p.select("chrom", tss.alias("tss"), F.regexp_replace(F.try_element_at("a", F.lit("gene_id")), r"\..*$", "").alias("gene_id"), F.try_element_at("a", F.lit("gene_name")).alias("gene"))
    p = p.groupBy("gene", "chrom", "tss").agg(F.min("gene_id").alias("gene_id"))
    return p.select("chrom", "tss", F.greatest(F.col("tss") - half_width, F.lit(0)).alias("promoter_start"), (F.col("tss") + half_width).alias("promoter_end"), "gene_id", "gene")


def transcript_genes(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, gene); a transcript of two genes is an error."""
    a = lambda k: F.regexp_replace(F.try_element_at("a", F.lit(k)), r"\..*$", "")
    by = _gtf(spark, path, "transcript").select(a("transcript_id").alias("transcript"), F.try_element_at("a", F.lit("gene_name")).alias("gene")).groupBy("transcript")
    p = by.agg(F.min("gene").alias("gene"), F.max("gene").alias("other"))
    return p.select("transcript", F.when(F.col("gene") == F.col("other"), F.col("gene")).otherwise(F.raise_error(F.lit("a transcript has two genes"))).alias("gene"))


def bedpe(spark: SparkSession, path: str, anchor_width: int = 5000, score: int | None = 6) -> DataFrame:
    """Loops with anchors of one width about their middles; the score column, by place, may be absent."""
    from lociweave.operators.intervals import bedpe_anchors

    c = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    c = c.filter(F.get("c", F.lit(1)).try_cast("long").isNotNull())  # a header has no numbers
    value = F.lit(1.0) if score is None else F.coalesce(F.get("c", F.lit(score)).try_cast("double"), F.lit(1.0))
    names = ("chrom1", "start1", "end1", "chrom2", "start2", "end2")
    p = c.select(*[F.get("c", F.lit(i)).cast("string" if n[0] == "c" else "long").alias(n) for i, n in enumerate(names)], value.alias("loop_score"))
    return bedpe_anchors(p, anchor_width).select(*names, "loop_score")


def rsem_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, tpm, expected_count, length); column names in any case, gene versions cut off, bad numbers 0."""
    p = spark.read.csv(path, sep="\t", header=True)
    by = {c.lower(): c for c in p.columns}
    gene = F.split_part(F.col(f"`{by.get('gene_id', by.get('gene', p.columns[0]))}`"), F.lit("."), F.lit(1))
    return p.select(gene.alias("gene"), *[(F.coalesce(F.col(f"`{by[n]}`").try_cast("double"), F.lit(0.0)) if n in by else F.lit(0.0)).alias(n) for n in ("tpm", "expected_count", "length")])


def deseq2_results(spark: SparkSession, path: str) -> DataFrame:
    """Results with gcm1_dependence, the fold change with its sign turned; what isn't a number is null."""
    p = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in ("gene", "baseMean", "log2FoldChange", "lfcSE", "pvalue", "padj") if c not in p.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return p.select("gene", *[F.col(c).try_cast("double").alias(c) for c in ("baseMean", "log2FoldChange", "lfcSE", "pvalue", "padj")], (-F.col("log2FoldChange").try_cast("double")).alias("gcm1_dependence"))


def salmon_quant(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.csv(path, sep="\t", header=True)
    return p.select(F.regexp_replace("Name", r"[.|].*$", "").alias("transcript"), F.col("TPM").try_cast("double").alias("tpm"))


def zip_lists(df: DataFrame, lists: list[str], names: list[str], sep: str = ";") -> DataFrame:
    """A row for each place of parallel separated lists; lists of unequal lengths are an error."""
    parts = [F.split(c, sep) for c in lists]
    same = F.lit(True)
    for p in parts[1:]:
        same &= F.size(p) == F.size(parts[0])
    zipped = F.when(same, F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)])).otherwise(F.raise_error(F.lit("parallel lists have unequal lengths")).cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"))
    return df.withColumn("__z", F.explode(zipped)).select(*[c for c in df.columns if c not in names], *[F.col("__z")[n].alias(n) for n in names])


def ena_report(spark: SparkSession, path: str) -> DataFrame:
    """(run, url, md5, size) of a run report with parallel lists."""
    p = spark.read.csv(path, sep="\t", header=True).select(F.col("run_accession").alias("run"), "fastq_ftp", "fastq_md5", "fastq_bytes")
    z = zip_lists(p, ["fastq_ftp", "fastq_md5", "fastq_bytes"], ["url", "md5", "size"])
    return z.select("run", "url", "md5", F.col("size").cast("long").alias("size"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value); order is kept in each file, read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample, key, values) of sample records in a SOFT file, gzip or plain."""
    lines = _numbered_lines(spark, path)
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    p = lines.withColumn("n", F.sum(F.when(F.col("value").startswith("^SAMPLE"), 1).otherwise(0)).over(w)).filter("n > 0")
    part = F.split("value", " = ", 2)
    p = p.filter(F.col("value").rlike(r"^[!^]Sample|^\^SAMPLE")).select("file", "n", "line_no", F.trim(part[0]).alias("key"), F.trim(F.get(part, F.lit(1))).alias("v"))
    names = p.filter(F.col("key") == "^SAMPLE").select("file", "n", F.col("v").alias("sample"))
    rows = p.filter(F.col("key") != "^SAMPLE").groupBy("file", "n", F.regexp_replace("key", "^!", "").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "v"))), lambda x: x["v"]).alias("values"))
    return rows.join(names, ["file", "n"]).select("sample", "key", "values")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size) of a file list of five fields."""
    p = spark.read.csv(path, sep="\t").filter("_c0 = 'File'")
    return p.select(F.col("_c1").alias("filename"), F.col("_c3").cast("long").alias("size"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, header, sequence) in file order; sequences upper-cased."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^>")).alias("position", "r")).filter(F.trim("r") != "")
    lines = F.split("r", r"\r?\n", 2)
    header = F.trim(lines[0])
    return text.select("position", F.split(header, r"\s+")[0].alias("name"), header.alias("header"), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))


def jaspar(spark: SparkSession, path: str) -> DataFrame:
    """(matrix_id, symbol, counts) with counts by position and base; a record without all four bases is an error."""
    r = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^>")).alias("r")).filter(F.trim("r") != "")
    row = lambda b: F.transform(F.regexp_extract_all(F.regexp_extract("r", rf"(?m)^{b}\s*\[?([^\]\r\n]*)", 1), F.lit(r"([0-9.eE+-]+)"), 1), lambda x: x.cast("double"))
    head = F.split(F.trim(F.split("r", r"\r?\n", 2)[0]), r"\s+")
    p = r.select(head[0].alias("matrix_id"), F.coalesce(F.get(head, F.lit(1)), head[0]).alias("symbol"), *[row(b).alias(b) for b in "ACGT"])
    ok = (F.size("A") > 0) & (F.size("A") == F.size("C")) & (F.size("A") == F.size("G")) & (F.size("A") == F.size("T"))
    counts = F.transform(F.arrays_zip("A", "C", "G", "T"), lambda x: F.array(x["A"], x["C"], x["G"], x["T"]))
    return p.select("matrix_id", "symbol", F.when(ok, counts).otherwise(F.raise_error(F.lit("incomplete matrix")).cast("array<array<double>>")).alias("counts"))


def normalized_inventory(df: DataFrame, column: str) -> DataFrame:
    """df with the normalised symbol tf; empty ones go."""
    from lociweave.functions.sequence import normalize_symbol

    return df.withColumn("tf", normalize_symbol(F.col(column))).filter("tf is not null and tf not in ('', 'NAN')")


def resolve_column(df: DataFrame, synonyms: list[str]) -> str:
    """The first column whose name, in any case, is one of the synonyms."""
    names = {s.lower() for s in synonyms}
    for c in df.columns:
        if c.strip().lower() in names:
            return c
    raise ValueError(f"no column is named like {', '.join(synonyms)}")


def delimited(spark: SparkSession, path: str, candidates: str = "\t,;|") -> DataFrame:
    """A table with a header whose delimiter is the one of the candidates that the header line has most of; an error if it has none."""
    head = next((r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()), "")
    best = max(candidates, key=head.count)
    if not head.count(best):
        raise ValueError(f"the header has none of the delimiters {candidates!r}")
    return spark.read.csv(path, sep=best, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def mex_matrices(spark: SparkSession, path: str, pseudocount: float = 1e-6) -> DataFrame:
    """(motif, symbol, probabilities) of text records: '>' and a name, lines 'key: value', a header of bases, and a row for each position.

    Columns may stand in any order of A, C, G and T. Rows become shares with the pseudocount; a record without rows, or with a row that isn't four numbers at or above 0, is an error.
    """
    r = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^>")).alias("r")).filter(F.trim("r") != "")
    lines = F.filter(F.transform(F.split("r", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    r = r.select(lines.alias("l")).select(F.col("l")[0].alias("motif"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("l"))
    is_head = lambda x: F.upper(x).rlike(r"^([ACGT]\s+){3}[ACGT]$")
    symbol = F.regexp_extract(F.coalesce(F.get(F.filter("l", lambda x: x.rlike(r"(?i)^symbol:")), F.lit(0)), F.lit("")), r"(?i)^symbol:\s*(.*)$", 1)
    head = F.split(F.upper(F.get(F.filter("l", is_head), F.lit(0))), r"\s+")
    rows = F.transform(F.filter("l", lambda x: x.rlike(r"^[-+0-9.eE\s]+$")), lambda x: F.transform(F.split(x, r"\s+"), lambda v: v.try_cast("double")))
    p = r.select("motif", symbol.alias("symbol"), head.alias("h"), rows.alias("rows"))
    ok = p.select("motif", "symbol", "h", "rows", (F.col("h").isNotNull() & (F.size("rows") > 0) & F.forall("rows", lambda x: (F.size(x) == 4) & F.forall(x, lambda v: v.isNotNull() & (v >= 0)))).alias("ok"))
    share = lambda x: F.transform(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: (F.get(x, (F.array_position(F.col("h"), b) - 1).cast("int")) + pseudocount) / (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) + 4 * pseudocount))
    kind = "array<array<double>>"
    return ok.select("motif", F.when(F.col("symbol") != "", F.col("symbol")).alias("symbol"), F.when(F.coalesce("ok", F.lit(False)), F.transform("rows", share)).otherwise(F.raise_error(F.lit("incomplete matrix")).cast(kind)).alias("probabilities"))
