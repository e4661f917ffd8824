"""Command line: python -m lociweave.cli <command> ...

Every command reads files, runs one flow of plans.workflows, plans.flows or plans.experiment, and writes its tables and a JSON report. Options that name several files
take name=path.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators.audit import audit_asset, json_text
from lociweave.sources import binary, text, writers

_COMMANDS: dict[str, tuple[Callable, list[tuple[tuple, dict]], str]] = {}


def _option(name: str, **rest) -> tuple[tuple, dict]:
    return (f"--{name}",), rest


def _path(name: str, required: bool = True) -> tuple[tuple, dict]:
    return _option(name, required=required)


def _named(name: str, required: bool = True) -> tuple[tuple, dict]:
    """An option that may be repeated, name=path each."""
    return _option(name, required=required, action="append", default=None if required else [], metavar="NAME=PATH", type=lambda x: tuple(x.split("=", 1)))


def _command(name: str, *options: tuple[tuple, dict]):
    def add(fn: Callable):
        _COMMANDS[name] = (fn, [*options, _path("out")], fn.__doc__ or "")
        return fn

    return add


def _table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or a table with a header whose delimiter is found out and whose numbers are read as such."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    found = text.delimited(spark, path)
    numbers = found.select(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull(), 1)).alias(c) for c in found.columns]).first()
    return found.select(*[(F.col(f"`{c}`").cast("double") if numbers[c] == 0 else F.col(f"`{c}`")).alias(c) for c in found.columns])


_BIGWIG = (".bw", ".bigWig", ".bigwig")


def _signal(spark: SparkSession, path: str) -> DataFrame:
    """A bigWig file, or bedGraph text."""
    if path.endswith(_BIGWIG):
        binary.register(spark)
        return spark.read.format("bigwig").load(path)
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, s_start long, s_end long, value double")


def _motif(spark: SparkSession, path: str, name: str):
    import numpy as np

    from lociweave.functions.pwm import probabilities

    found = text.jaspar(spark, path).filter((F.col("matrix_id") == name) | (F.col("symbol") == name)).orderBy("matrix_id").first()
    if not found:
        raise ValueError(f"{path} has no motif {name}")
    return probabilities(np.array(found.counts))


@_command("audit-supplements", _path("interactions"), _path("models"), _path("spacing"), _option("sheet", nargs=3, default=(None, None, None)))
def _audit_supplements(spark, args, flows):
    """what the supplementary workbooks hold and lack"""
    return flows.audit_supplements(spark, args.interactions, args.models, args.spacing, tuple(args.sheet))


@_command("audit-calls", _named("file"), _option("fdr", type=float, default=0.05), _option("width", type=int))
def _audit_calls(spark, args, flows):
    """rows and intervals of call files"""
    return flows.audit_calls(spark, dict(args.file), args.fdr, args.width)


@_command("audit-archive", _path("archive"), _option("pattern", default=".*"), _option("member", action="append"))
def _audit_archive(spark, args, flows):
    """size and hash of the members of an archive"""
    found = binary.archive_members(spark, args.archive, args.pattern, args.member)
    rows = found.select("name", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).collect()
    return {"archive": audit_asset(args.archive), "members": [r.asDict() for r in sorted(rows)]}


@_command("audit-chip", _path("loci"), _named("signal"))
def _audit_chip(spark, args, flows):
    """quality of two replicates over loci"""
    table = _table(spark, args.loci)
    return flows.audit_chip(table.select("locus_id", "chrom", *[F.col(c).cast("long").alias(c) for c in ("start", "end")]), {n: _signal(spark, p) for n, p in args.signal})


@_command("audit-runs", _path("runs"), _path("experiments"), _path("report"), _option("focal", action="append", required=True))
def _audit_runs(spark, args, flows):
    """runs, files and bytes of the focal factors, of all and of each batch"""
    return flows.audit_runs(text.delimited(spark, args.runs), text.delimited(spark, args.experiments), text.ena_report(spark, args.report), args.focal)


@_command("audit-bigwigs", _path("folder"), _option("expected", action="append", required=True), _option("sentinel", action="append", required=True, type=lambda x: (x.split("=")[0], int(x.split("=")[1]))))
def _audit_bigwigs(spark, args, flows):
    """whether exactly the expected files are there, with the assembly's chromosome lengths"""
    names = sorted(n for n in os.listdir(args.folder) if n.lower().endswith((".bw", ".bigwig")))
    headers = {n: {c: s for c, (_, s) in binary.BigWigFile(f"{args.folder}/{n}").chroms.items()} for n in names}
    return flows.audit_bigwigs(names, args.expected, headers, dict(args.sentinel))


@_command("audit-expression", _named("quant"), _path("gtf"), _option("partner", action="append", required=True), _option("threshold", type=float, default=1.0))
def _audit_expression(spark, args, flows):
    """support of partners over replicates"""
    quant = None
    for name, path in args.quant:
        own = text.salmon_quant(spark, path).withColumn("sample", F.lit(name))
        quant = own if quant is None else quant.unionByName(own)
    partners = spark.createDataFrame([(p,) for p in args.partner], "partner string")
    return flows.audit_expression(quant, text.transcript_genes(spark, args.gtf), partners, args.threshold)


@_command("audit-motifs", _path("interactions"), _option("sheet"), _option("focal", required=True), _named("source"))
def _audit_motifs(spark, args, flows):
    """which motif collection has each partner, and which pairs are complete"""
    from lociweave.operators.pairs import is_positive
    from lociweave.sources.supplements import interaction_matrix

    cells = interaction_matrix(binary.xlsx_rows(spark, args.interactions, args.sheet)).filter(is_positive(F.col("composite_motif"), F.col("spacing_or_orientation")))
    sources = [(n, (text.mex_matrices if p.endswith(".mex") else text.jaspar)(spark, p).select(F.upper("symbol").alias("partner"))) for n, p in args.source]
    return flows.audit_motifs(cells, args.focal, sources)


@_command("audit-gene", _named("profile"), _option("gene", required=True), _option("threshold", type=float, default=1.0))
def _audit_gene(spark, args, flows):
    """a gene's TPM in every profile"""
    return flows.audit_gene({n: text.rsem_genes(spark, p).select("gene", "tpm") for n, p in args.profile}, args.gene, args.threshold)


@_command("sample-manifest", _path("soft"), _option("pattern", required=True))
def _sample_manifest(spark, args, flows):
    """supplementary files by factor and replicate"""
    return flows.sample_manifest(spark, args.soft, args.pattern)


@_command("file-manifest", _path("files"))
def _file_manifest(spark, args, flows):
    """name, size and hash of files"""
    from lociweave.operators.audit import asset_manifest

    return {"files": [r.asDict() for r in sorted(asset_manifest(spark, args.files).collect())]}


@_command("compare", _path("first"), _path("second"), _option("key", required=True), _option("column", action="append", required=True))
def _compare(spark, args, flows):
    """rows of two reports side by side, with differences"""
    from lociweave.operators.audit import compare_reports

    out = compare_reports(_table(spark, args.first), _table(spark, args.second), args.key, args.column)
    return {"rows": [r.asDict() for r in sorted(out.collect(), key=str)]}


@_command("build-features", _path("loci"), _path("genome"), _path("motifs"), _option("focal", required=True), _option("partner", action="append", default=[]), _named("signal", False), _path("table"))
def _build_features(spark, args, flows):
    """loci with sequence covariates, motif scores and signals"""
    from lociweave.operators.sinks import write_tsv
    from lociweave.plans.workflows import feature_table

    own = _table(spark, args.loci)
    own = own.select(*[F.col(c).cast("long").alias(c) if c in ("start", "end", "midpoint") else F.col(c) for c in own.columns])
    partners = {p: _motif(spark, args.motifs, p) for p in args.partner}
    out = feature_table(own, args.genome, _motif(spark, args.motifs, args.focal), partners, {n: p if p.endswith(_BIGWIG) else _signal(spark, p) for n, p in args.signal})
    return {"counts": write_tsv(out.drop("sequence"), args.table, gzip=True), "columns": out.columns}


_MODEL = (_option("baseline", action="append", required=True), _option("added", required=True), _option("outcome", required=True), _option("replicate", action="append", default=[]), _option("permutations", type=int, default=100), _option("draws", type=int, default=2000), _option("seed", type=int, default=0))


def _contract(args):
    from lociweave.plans.workflows import Contract

    return Contract(permutations=args.permutations, final_permutations=max(1000, args.permutations), draws=args.draws)


@_command("screen", _named("features"), *_MODEL)
def _screen(spark, args, flows):
    """partial R2 of an added column for every factor, its null and gates"""
    tables = {n: _table(spark, p) for n, p in args.features}
    return flows.screen_panel(tables, args.baseline, args.added, args.outcome, args.replicate, _contract(args), args.seed)


@_command("replicate", _named("features"), *_MODEL)
def _replicate(spark, args, flows):
    """the screening in every state of another assay"""
    tables = {n: _table(spark, p) for n, p in args.features}
    return flows.replicate_states(tables, args.baseline, args.added, args.outcome, args.replicate, _contract(args), args.seed)


@_command("decompose", _path("features"), _option("baseline", action="append", required=True), _option("profile", action="append", required=True), _option("outcome", required=True))
def _decompose(spark, args, flows):
    """each pair's contribution alone and what is left without it"""
    return flows.decompose(_table(spark, args.features), args.baseline, args.profile, args.outcome)


@_command("benchmark-states", _named("genes"), _named("results"), _option("added", required=True), _path("predictions"))
def _benchmark_states(spark, args, flows):
    """gene features against expression in every state"""
    genes = {n: _table(spark, p) for n, p in args.genes}
    return flows.benchmark_states(genes, {n: text.deseq2_results(spark, p) for n, p in args.results}, args.added, args.predictions)


@_command("liftover", _path("signal"), _path("chain"), _path("lifted"))
def _liftover(spark, args, flows):
    """a signal moved to another assembly"""
    out, report = flows.lift_signal(_signal(spark, args.signal), binary.chain_blocks(spark, args.chain))
    out.write.csv(args.lifted, sep="\t")
    return report


@_command("experiment", _path("config"), _path("motifs"), _option("motif-a", required=True), _option("motif-b", required=True), _path("folder"))
def _experiment(spark, args, flows):
    """seeds by models, trained and evaluated under several conditions"""
    from lociweave.plans.experiment import accuracy_ranking, run_experiment
    from lociweave.records import ExperimentPlan

    plan = ExperimentPlan.of(read_config(args.config))
    _, summary = run_experiment(spark, plan, _motif(spark, args.motifs, args.motif_a), _motif(spark, args.motifs, args.motif_b), args.folder)
    return {"ranking": [r.asDict() for r in accuracy_ranking(summary).collect()]}


@_command("contract")
def _write_contract(spark, args, flows):
    """the fixed parameters of a primary analysis"""
    from lociweave.plans.workflows import Contract

    Contract().validate(primary=True)
    return json.loads(Contract().text())


def read_config(path: str) -> dict:
    """JSON, or YAML with nested maps by indentation, lists in brackets and plain scalars."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    if path.endswith(".json"):
        return json.loads(content)

    def scalar(x: str):
        x = x.strip()
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if x in ("", "~", "null"):
            return None
        if x in ("true", "false"):
            return x == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x.strip("'\"")

    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for line in content.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        name, mark, rest = line.strip().partition(":")
        if not mark:
            raise ValueError(f"not understood in {path}: {line.strip()}")
        while stack[-1][0] >= depth:
            stack.pop()
        if rest.strip():
            stack[-1][1][name.strip()] = {} if rest.strip() == "{}" else scalar(rest)
        else:
            stack[-1][1][name.strip()] = own = {}
            stack.append((depth, own))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociweave")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-loci", help="write a locus table and its manifest")
    b.add_argument("--tf", required=True)
    b.add_argument("--ght", required=True)
    b.add_argument("--chip")
    b.add_argument("--sizes")
    b.add_argument("--universe", default="ght-only")
    b.add_argument("--width", type=int, default=200)
    b.add_argument("--out", required=True)
    b.add_argument("--manifest", required=True)
    s = sub.add_parser("benchmark", help="evaluate the motif-presence baseline on synthetic pairs")
    s.add_argument("--pairs", type=int, default=200)
    s.add_argument("--seed", type=int, default=0)
    for name, (_, options, about) in _COMMANDS.items():
        c = sub.add_parser(name, help=about)
        for names, rest in options:
            c.add_argument(*names, **rest)
    return p


def main(argv: list[str] | None = None) -> int:
    from lociweave.plans import flows, workflows

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lociweave").getOrCreate()
    if args.command == "build-loci":
        contract = workflows.Contract(width=args.width, universe=args.universe)
        counts = workflows.build_loci(spark, args.tf, args.ght, args.chip, args.out, contract, args.sizes)
        assets = [audit_asset(p) for p in (args.ght, args.chip) if p]
        writers.put(spark, args.manifest, json_text({"counts": counts, "assets": assets, "universe": args.universe, "width": args.width, "tf": args.tf}).encode())
    elif args.command == "benchmark":
        import numpy as np

        from lociweave.functions.pwm import probabilities

        a, b = (probabilities(np.eye(4)[list(m)] * 20 + 1) for m in ((0, 1, 2, 0, 3, 2), (3, 2, 1, 1, 0, 0)))
        print(json.dumps(workflows.presence_benchmark(spark, a, b, args.pairs, args.seed), sort_keys=True))
    else:
        report = _COMMANDS[args.command][0](spark, args, flows)
        writers.put(spark, args.out, json_text(report).encode())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
