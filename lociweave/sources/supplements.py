"""Supplementary workbooks, from the rows that sources.binary.xlsx_rows gives: (row_no, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequence import normalize_symbol, pair_members
from lociweave.operators.pairs import parse_tokens

GAPS = 29


def _cell(i: int | Column) -> Column:
    return F.trim(F.get("cells", F.lit(i) if isinstance(i, int) else i))


def _header(rows: DataFrame, condition: Column, what: str):
    head = rows.filter(condition).orderBy("row_no").first()
    if head is None:
        raise ValueError(f"the header of {what} was not found")
    return head


def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message} at row "), F.col("row_no").cast("string"))).cast(kind)


def interaction_matrix(rows: DataFrame) -> DataFrame:
    """A record for each cell of a prey by bait matrix, from its header to the next section."""
    head = _header(rows, _cell(0) == "Prey\\Bait", "the interaction matrix")
    baits = [str(c).strip() for c in head.cells[1:] if c is not None]
    if not baits or len(set(baits)) != len(baits):
        raise ValueError("baits must be present and unique")
    body = rows.filter(F.col("row_no") > head.row_no)
    end = body.filter(_cell(0).startswith("Section ")).agg(F.min("row_no").alias("n")).first().n
    body = body.filter(F.col("row_no") < end) if end else body
    values = F.posexplode(F.slice("cells", 2, len(baits)))
    cells = body.filter(F.get("cells", F.lit(0)).isNotNull()).select(_cell(0).alias("raw_prey"), values.alias("i", "raw_value")).filter("raw_value is not null")
    p = parse_tokens(F.col("raw_value"))
    raw_bait = F.get(F.array(*[F.lit(b) for b in baits]), F.col("i"))
    return cells.select(
        raw_bait.alias("raw_bait"), "raw_prey", normalize_symbol(raw_bait).alias("bait"), normalize_symbol(F.col("raw_prey")).alias("prey"), F.trim("raw_value").alias("raw_value"),
        p["tested"].alias("tested"), p["composite"].alias("composite_motif"), p["spacing"].alias("spacing_or_orientation"), p["specificity"].alias("specificity"),
    )


def _pair(raw: Column) -> Column:
    return F.coalesce(F.array_join(pair_members(raw), "_"), normalize_symbol(raw))


def pwm_models(rows: DataFrame) -> DataFrame:
    """A count matrix (positions by A, C, G, T) with its metadata for each block: a header row, then a row for each base."""
    is_head = (_cell(0) == "Base") & _cell(1).isNotNull() & (_cell(1) != "TF_pairs") & (F.size("cells") >= 7) & _cell(2).isNotNull()
    kind = F.lower(_cell(7))
    flag = F.upper(_cell(8))
    heads = rows.filter(is_head).select(
        "row_no", _cell(1).alias("raw_pair"), _pair(_cell(1)).alias("pair"), _cell(2).alias("ligand_sequence"), _cell(3).alias("batch"), _cell(4).alias("seed"),
        _cell(5).cast("double").cast("int").alias("multinomial"), _cell(6).alias("cycle"),
        F.when(kind.isNull() | kind.isin("composite", "spacing"), kind).otherwise(_fail("unknown interaction type", "string")).alias("interaction_type"),
        F.when(flag.isNull() | flag.isin("YES", "NO"), flag == "YES").otherwise(_fail("not YES or NO", "boolean")).alias("representative"),
    )
    numbers = F.transform(F.filter(F.slice("cells", 2, 10_000), lambda c: c.isNotNull()), lambda c: c.cast("double"))
    bases = rows.filter(_cell(0).isin("A", "C", "G", "T")).select(F.col("row_no").alias("at"), _cell(0).alias("base"), numbers.alias("v"))
    want = heads.select("row_no", F.posexplode(F.array(*[F.lit(b) for b in "ACGT"])).alias("k", "expected")).withColumn("at", F.col("row_no") + 1 + F.col("k"))
    got = want.join(bases, "at", "left")
    by = got.groupBy("row_no").agg(*[F.max(F.when((F.col("expected") == b) & (F.col("base") == b), F.col("v"))).alias(b) for b in "ACGT"])
    n = F.size("A")
    ok = F.coalesce((n > 0) & (F.size("C") == n) & (F.size("G") == n) & (F.size("T") == n), F.lit(False))
    counts = F.transform(F.arrays_zip("A", "C", "G", "T"), lambda x: F.array(x["A"], x["C"], x["G"], x["T"]))
    valid = F.forall(counts, lambda r: F.forall(r, lambda c: (c >= 0) & (c < float("inf"))))
    matrix = F.when(ok & valid, counts).otherwise(_fail("incomplete or invalid matrix", "array<array<double>>"))
    return heads.join(by.select("row_no", matrix.alias("counts")), "row_no").withColumn(
        "model_id", F.concat_ws("|", "pair", "ligand_sequence", "batch", "seed", F.col("multinomial").cast("string"), "cycle")
    ).withColumnRenamed("row_no", "source_row")


def spacing_counts(rows: DataFrame) -> DataFrame:
    """Oriented k-mer pairs with their counts at gaps 0 to 28."""
    head = _header(rows, (_cell(0) == "TF1_TF2") & (_cell(4) == "kmer1.kmer2"), "the spacing table")
    if [str(c) for c in head.cells[5:] if c is not None] != [f"Count Gap {g}" for g in range(GAPS)]:
        raise ValueError("the table must have the counts of gaps 0 to 28")
    body = rows.filter((F.col("row_no") > head.row_no) & _cell(0).isNotNull())
    kmers = F.split(F.upper(_cell(4)), r"\.", 2)
    counts = F.transform(F.slice("cells", 6, GAPS), lambda c: c.cast("double").cast("int"))
    members = pair_members(_cell(0))
    ok = members.isNotNull() & (F.size(kmers) == 2) & F.forall(kmers, lambda k: k.rlike("^[ACGT]+$")) & (F.size(counts) == GAPS) & F.forall(counts, lambda c: c >= 0)
    return body.select(
        _cell(0).alias("raw_pair"), F.array_join(members, "_").alias("pair"), _cell(1).alias("barcode"), _cell(2).alias("batch"), _cell(3).alias("analysis_type"), kmers[0].alias("left_kmer"),
        kmers[1].alias("right_kmer"), F.when(F.coalesce(ok, F.lit(False)), counts).otherwise(_fail("invalid spacing record", "array<int>")).alias("gap_counts"), F.col("row_no").alias("source_row"),
    )


def coverage(interactions: DataFrame, models: DataFrame, spacing: DataFrame) -> dict[str, DataFrame]:
    """Which positive pairs lack models or spacing records, which of these have no positive cell, and cells by value."""
    from lociweave.operators.audit import coverage_differences

    positive = interactions.filter("composite_motif or spacing_or_orientation").select(F.array_join(F.array_sort(F.array("bait", "prey")), "_"))
    ordered = lambda d: d.filter(F.col("pair").contains("_")).select(F.array_join(F.array_sort(F.split("pair", "_")), "_"))
    return {
        "models": coverage_differences(positive, ordered(models), ("without_model", "without_cell")),
        "spacing": coverage_differences(positive, ordered(spacing), ("without_spacing", "without_cell")),
        "values": interactions.groupBy("raw_value").agg(F.count("*").alias("n")),
    }


def rebuild_audit(runs: DataFrame, experiments: DataFrame, files: DataFrame, focal: list[str]) -> DataFrame:
    """(scope, runs, files, bytes, gib): the selected runs of the focal factors, of all factors, and of each batch.

    runs: tf, run, experiment; experiments: experiment, batch, approved; files: run, url, size. A run without files is an error.
    """
    own = runs.join(experiments.select("experiment", "batch"), "experiment", "left").join(files.groupBy("run").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")), "run", "left")
    own = own.withColumn("bytes", F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no files of run "), F.col("run"))).cast("long")).otherwise(F.col("bytes")))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("tf").isin(*focal), F.lit("focal")), F.concat(F.lit("batch "), F.col("batch"))))
    rows = own.select(F.explode(scopes).alias("scope"), "run", "files", "bytes").distinct()
    missing = sorted(set(focal) - {r.tf for r in runs.select("tf").filter(F.col("tf").isin(*focal)).distinct().collect()})
    if missing:
        raise ValueError(f"no runs of {', '.join(missing)}")
    return rows.groupBy("scope").agg(F.count("*").alias("runs"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).withColumn("gib", F.round(F.col("bytes") / (1 << 30), 3))


# --- run inventories, experiments and tables of constructs, interactions, counts and targets


def _only(rows: DataFrame, keys: list[str], values: list[str], message: str) -> DataFrame:
    """The distinct rows, an error where equal keys have different values."""
    found = rows.select(*keys, *values).distinct()
    clash = found.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.min(v).alias(v) for v in values])
    first = values[0]
    kind = clash.schema[first].dataType.simpleString()
    wrong = F.raise_error(F.concat(F.lit(f"{message}: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))).cast(kind)
    return clash.withColumn(first, F.when(F.col("__n") == 1, F.col(first)).otherwise(wrong)).select(*keys, *values)


def repeated_header(rows: DataFrame, header_row: int) -> dict[str, list[int]]:
    """The places of each column name in a header row, as names may be repeated."""
    out: dict[str, list[int]] = {}
    for i, c in enumerate(rows.filter(F.col("row_no") == header_row).first().cells):
        if c is not None and str(c).strip():
            out.setdefault(str(c).strip(), []).append(i)
    return out


def expected_hashes(rows: DataFrame, skip: int, name: int = 0, digest: int = 1) -> DataFrame:
    """(filename, md5) of the rows behind so many; rows without either are left out, a file of two hashes is an error."""
    found = rows.filter(F.col("row_no") > skip).select(_cell(name).alias("filename"), F.lower(_cell(digest)).alias("md5")).dropna()
    return _only(found, ["filename"], ["md5"], "a file has two hashes")


def run_inventory(records: DataFrame) -> DataFrame:
    """(experiment, runs): the runs of each experiment in the order of cycles, of rows (experiment, cycle, run); a cycle of two runs is an error."""
    own = _only(records, ["experiment", "cycle"], ["run"], "a cycle has two runs")
    return own.groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct(F.col("cycle").cast("int").alias("cycle"), "run"))).alias("runs"))


def batch_key(batch: Column, experiment: Column) -> Column:
    """The batch, and behind it the letter that ends an experiment's last part of one letter."""
    last = F.substring_index(experiment, "_", -1)
    return F.concat(F.trim(batch.cast("string")), F.when(last.rlike("^[A-Za-z]$") & (F.instr(experiment, "_") > 0), F.upper(last)).otherwise(""))


def optional_flag(x: Column) -> Column:
    """YES or NO in any case as a boolean, nothing as null; anything else is an error."""
    v = F.upper(F.trim(x))
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("boolean")).when(v.isin("YES", "NO"), v == "YES").otherwise(F.raise_error(F.concat(F.lit("not YES or NO: "), v)).cast("boolean"))


def experiments(records: DataFrame, assay: str) -> DataFrame:
    """(experiment, tf, batch, approved) of one assay, of rows (experiment, tf, batch, assay, approved); an experiment with two entries is an error."""
    own = records.filter(F.lower(F.trim("assay")) == assay.lower())
    own = own.select("experiment", normalize_symbol(F.col("tf")).alias("tf"), batch_key(F.col("batch"), F.col("experiment")).alias("batch"), F.coalesce(optional_flag(F.col("approved")), F.lit(False)).alias("approved"))
    n = own.groupBy("experiment").agg(F.count("*").alias("__n"))
    checked = F.when(F.col("__n") == 1, F.col("approved")).otherwise(F.raise_error(F.concat(F.lit("two entries of experiment "), "experiment")).cast("boolean"))
    return own.join(n, "experiment").withColumn("approved", checked).drop("__n")


def selected_runs(records: DataFrame, focal: list[str], pattern: str = r"(?i)magix") -> DataFrame:
    """(tf, run, experiment, cycle, peak_file) of the focal factors whose file name a pattern matches, in order; a factor without any is an error."""
    own = records.filter(F.col("peak_file").rlike(pattern)).withColumn("tf", normalize_symbol(F.col("tf"))).filter(F.col("tf").isin(*focal))
    missing = sorted(set(focal) - {r.tf for r in own.select("tf").distinct().collect()})
    if missing:
        raise ValueError(f"no selected runs of {', '.join(missing)}")
    return own.select("tf", "run", "experiment", F.col("cycle").cast("int").alias("cycle"), "peak_file").orderBy("tf", "experiment", "cycle", "run")


def agree(runs: DataFrame, experiments_: DataFrame) -> DataFrame:
    """The runs; one whose experiment is unknown, of another factor or not approved is an error."""
    both = runs.join(experiments_.select("experiment", F.col("tf").alias("__tf"), "approved"), "experiment", "left")
    ok = F.coalesce((F.col("__tf") == F.col("tf")) & F.col("approved"), F.lit(False))
    return both.withColumn("run", F.when(ok, F.col("run")).otherwise(F.raise_error(F.concat(F.lit("a run disagrees with its experiment: "), "run")).cast("string"))).drop("__tf", "approved").select(*runs.columns)


def constructs(table: DataFrame) -> DataFrame:
    """(tf, family, protein_sequence), the first row of each factor; columns are found by their synonyms, family and sequence may be absent."""
    from lociweave.operators.loci import first_per_group
    from lociweave.sources.text import resolve_column

    def pick(names: list[str], default: str | None) -> Column:
        try:
            return F.col(f"`{resolve_column(table, names)}`")
        except ValueError:
            if default is None:
                raise
            return F.lit(default)

    order = "row_no" if "row_no" in table.columns else None
    rows = table.select(
        normalize_symbol(pick(["tf", "symbol", "gene", "protein", "tf_name", "hgnc symbol"], None)).alias("tf"), F.coalesce(F.trim(pick(["family", "tf_family", "dbd", "class"], "unknown")), F.lit("unknown")).alias("family"),
        F.coalesce(F.upper(F.trim(pick(["protein_sequence", "sequence", "aa_sequence", "construct_sequence"], ""))), F.lit("")).alias("protein_sequence"), *([F.col(order)] if order else []),
    )
    keys = [F.asc(order)] if order else [F.asc("family"), F.asc("protein_sequence")]
    return first_per_group(rows.filter("tf is not null and tf <> ''"), ["tf"], keys).select("tf", "family", "protein_sequence")


def interaction_table(table: DataFrame, order: str) -> DataFrame:
    """(bait, prey, value) of a long table with columns found by their synonyms, of repeated pairs the last by the order column; or of a wide matrix, its first column the bait."""
    from lociweave.operators.loci import first_per_group
    from lociweave.operators.pairs import unpivot_matrix
    from lociweave.sources.text import resolve_column

    try:
        bait, prey, value = (resolve_column(table, names) for names in (["bait", "tf1", "source", "tf_1"], ["prey", "tf2", "target", "tf_2"], ["value", "cooperative_signal", "signal", "interaction", "positive"]))
    except ValueError:
        first = next(c for c in table.columns if c != order)
        wide = table.drop(order).withColumnRenamed(first, "bait")
        long = unpivot_matrix(wide.select("bait", *[F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns if c != "bait"]), "bait")
        return long.select(normalize_symbol(F.col("bait")).alias("bait"), normalize_symbol(F.col("prey")).alias("prey"), "value")
    rows = table.select(normalize_symbol(F.col(f"`{bait}`")).alias("bait"), normalize_symbol(F.col(f"`{prey}`")).alias("prey"), F.col(f"`{value}`").cast("string").alias("value"), order)
    return first_per_group(rows, ["bait", "prey"], [F.desc(order)]).select("bait", "prey", "value")


def target_genes(table: DataFrame, state: str) -> DataFrame:
    """The distinct genes of one state."""
    from lociweave.sources.text import resolve_column

    own = table.filter(F.lower(F.trim(F.col(f"`{resolve_column(table, ['state', 'cell_state', 'cell type'])}`"))) == state.lower())
    return own.select(F.trim(F.col(f"`{resolve_column(table, ['gene', 'target', 'symbol', 'gene_name'])}`")).alias("gene")).filter("gene is not null and gene <> ''").distinct()


def count_table(table: DataFrame) -> DataFrame:
    """Counts with the gene's column, found by its synonyms, named gene; other columns as numbers where they are."""
    from lociweave.sources.text import resolve_column

    name = resolve_column(table, ["gene", "gene_id", "symbol", "gene_name", "geneid"])
    rest = [c for c in table.columns if c not in (name, "row_no")]
    return table.select(F.trim(F.col(f"`{name}`")).alias("gene"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rest])
