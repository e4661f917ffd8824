"""The flows behind the commands: audits, feature tables, screening, decomposition, replication and benchmarks. Each returns a report that can be written as JSON."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import audit, intervals, loci, metrics, models, pairs, panel
from lociweave.operators.scale import positions
from lociweave.operators.sinks import write_tsv
from lociweave.plans.workflows import Contract
from lociweave.sources import binary, supplements, text


def _rows(df: DataFrame) -> list[dict]:
    """The rows of a short table, in order."""
    return [r.asDict(True) for r in sorted(df.collect(), key=str)]


# --- audits


def audit_supplements(spark: SparkSession, interactions: str, models_: str, spacing: str, sheets: tuple[str | None, ...] = (None, None, None)) -> dict:
    """Records by kind, positive pairs without models or spacing records and the other way round, and cells by value."""
    cells, own, gaps = (binary.xlsx_rows(spark, p, s) for p, s in zip((interactions, models_, spacing), sheets))
    cells, own, gaps = supplements.interaction_matrix(cells), supplements.pwm_models(own), supplements.spacing_counts(gaps)
    found = supplements.coverage(cells, own.select("pair"), gaps.select("pair"))
    counts = cells.agg(F.count("*").alias("cells"), F.count_if("tested").alias("tested"), F.count_if(pairs.is_positive(F.col("composite_motif"), F.col("spacing_or_orientation"))).alias("positive")).first()
    return counts.asDict() | {"models": own.count(), "spacing": gaps.count()} | {f"coverage_{k}": _rows(v) for k, v in found.items()}


def audit_chip(table: DataFrame, signals: dict[str, DataFrame]) -> dict:
    """Quality of two replicates' signals over loci: counts, rank correlation, zero shares and the median difference."""
    names = sorted(signals)
    if len(names) != 2:
        raise ValueError("there must be two replicates")
    for n in names:
        table = intervals.interval_mean(table, signals[n], n)
    return {"replicates": names} | metrics.replicate_qc(table, *names).first().asDict()


def audit_runs(runs: DataFrame, experiments: DataFrame, files: DataFrame, focal: list[str]) -> dict:
    return {r["scope"]: {k: v for k, v in r.items() if k != "scope"} for r in _rows(supplements.rebuild_audit(runs, experiments, files, focal))}


def audit_calls(spark: SparkSession, paths: dict[str, str], fdr: float = 0.05, width: int | None = None) -> dict:
    """For each named call file: all rows, autosomal and selected ones, and the audit of the selected intervals."""
    out = {}
    for name, path in sorted(paths.items()):
        every, chosen = text.magix(spark, path, 1.0, False), text.magix(spark, path, fdr)
        out[name] = {"autosomal": every.count(), "selected": chosen.count()} | audit.file_audit(chosen, width).first().asDict()
    return out


def audit_bigwigs(folder_names: list[str], wanted: list[str], headers: dict[str, dict[str, int]], sentinel: dict[str, int]) -> dict:
    """Missing and unexpected files, and for each file whether its chromosomes have the sentinel's lengths."""
    status = {n: "PASS" if all(headers.get(n, {}).get(c) == s for c, s in sentinel.items()) else "FAIL" for n in sorted(set(wanted) & set(folder_names))}
    missing, extra = sorted(set(wanted) - set(folder_names)), sorted(set(folder_names) - set(wanted))
    return {"missing": missing, "unexpected": extra, "status": status, "passed": not missing and not extra and set(status.values()) <= {"PASS"}}


def audit_expression(quant: DataFrame, names: DataFrame, partners: DataFrame, threshold: float = 1.0) -> dict:
    """Support of each partner over replicates (sample, transcript, tpm), and the correlation of the replicates' log1p."""
    genes = quant.join(names, "transcript").groupBy("sample", "gene").agg(F.sum("tpm").alias("tpm"))
    grid = audit.partner_grid(quant.select("sample").distinct(), partners, genes.select("sample", F.col("gene").alias("partner"), "tpm"), threshold)
    support = audit.expression_support(grid.select(F.col("partner").alias("gene"), F.col("sample").alias("replicate"), "tpm"), threshold)
    samples = sorted(r[0] for r in quant.select("sample").distinct().collect())
    wide = genes.groupBy("gene").pivot("sample", samples).agg(F.first("tpm")).fillna(0.0)
    r = wide.agg(F.corr(F.log1p(f"`{samples[0]}`"), F.log1p(f"`{samples[1]}`")).alias("r")).first().r if len(samples) == 2 else None
    return {"samples": samples, "partners": _rows(support), "pearson_log1p": r, "mapping": audit.mapping_rate(quant, names).first().asDict()}


def audit_motifs(pairs_: DataFrame, focal: str, sources: list[tuple[str, DataFrame]]) -> dict:
    """The first source that has each partner of a factor's positive pairs; pairs whose partner has one are complete, the others excluded."""
    own = pairs.with_factor(pairs_, focal).select(F.array_join(F.array_sort(F.array("bait", "prey")), "_").alias("pair"), F.when(F.col("bait") == focal, F.col("prey")).otherwise(F.col("bait")).alias("partner")).distinct()
    found = audit.priority_source(own.select("partner"), sources)
    rows = own.join(found, "partner")
    return {"sources": {r["partner"]: r["source"] for r in _rows(found)}, "complete": sorted(r.pair for r in rows.filter("source is not null").collect()), "excluded": sorted(r.pair for r in rows.filter("source is null").collect())}


def audit_gene(profiles: dict[str, DataFrame], gene: str, threshold: float = 1.0) -> dict:
    """A gene's TPM in each profile (gene, tpm), and whether all reach the threshold."""
    found = {n: float(p.filter(F.col("gene") == gene).agg(F.coalesce(F.sum("tpm"), F.lit(0.0))).first()[0]) for n, p in sorted(profiles.items())}
    return {"gene": gene, "tpm": found, "passed": bool(found) and min(found.values()) >= threshold}


def sample_manifest(spark: SparkSession, soft: str, pattern: str, replicates: tuple[int, ...] = (1, 2)) -> dict:
    """Supplementary files whose names a pattern with the groups tf and replicate matches, by factor; each must have exactly these replicates."""
    files = text.soft_samples(spark, soft).filter(F.col("key").startswith("Sample_supplementary_file")).select("sample", F.explode("values").alias("url"))
    out: dict[str, list] = {}
    for r in sorted(files.collect()):
        if m := re.search(pattern, r.url):
            out.setdefault(m["tf"], []).append({"sample": r.sample, "url": r.url, "replicate": int(m["replicate"])})
    return {tf: {str(k): v for k, v in sorted(audit.replicate_assets(x, replicates).items())} for tf, x in sorted(out.items())}


# --- models


def _fold(features: DataFrame, contract: Contract) -> DataFrame:
    return features.withColumn("fold", loci.chromosome_fold(F.col("chrom"), contract.folds))


def shifted_moments(rows: DataFrame, fold: str, baseline: list[str], added: str, outcome: str, shifts: DataFrame, order: list[str]) -> dict[int, dict[int, models.Moments]]:
    """Moments by permutation and fold, with the added column rolled within chromosomes by each permutation's shift, in one job.

    shifts: (chrom, permutation, shift). Only a row's number and its added value are copied for each permutation; the copies are joined by chromosome and
    number, summed to a row for each permutation and fold before they are shuffled.
    """
    keep = positions(rows, ["chrom"], order, "__i", "__n")
    by = shifts.groupBy("chrom").agg(F.collect_list(F.struct("permutation", "shift")).alias("__s"))  # a row for each chromosome
    moved = keep.select("chrom", "__i", "__n", F.col(added).alias("__v")).join(F.broadcast(by), "chrom").select("chrom", F.explode("__s").alias("s"), "__i", "__n", "__v")
    moved = moved.select("chrom", "s.permutation", F.pmod(F.col("__i") + F.col("s.shift"), F.col("__n")).alias("__i"), "__v")
    joined = keep.select("chrom", "__i", F.col(fold).alias("fold"), *baseline, outcome).join(moved, ["chrom", "__i"])
    out: dict[int, dict[int, models.Moments]] = {}
    for (permutation, i), m in models.gram(joined, ["permutation", "fold"], [*baseline, "__v", outcome]).items():
        out.setdefault(permutation, {})[i] = m
    return out


def permutation_test(rows: DataFrame, fold: str, baseline: list[str], added: str, outcome: str, observed: float, permutations: int, seed: int, order: list[str] = ["start", "locus_id"]) -> dict:  # noqa: B006
    """The share of chromosome-wise shifts whose partial R2 reaches the observed one, and the null's quantiles."""
    sizes = {(r.chrom,): r.n for r in rows.groupBy("chrom").agg(F.count("*").alias("n")).orderBy(loci.chrom_number(F.col("chrom"))).collect()}
    drawn = [(c[0], k, s) for k in range(permutations) for c, s in models.draw_shifts(sizes, models.stable_seed(seed, "shift", k)).items()]
    drawn += [(c[0], k, 0) for k in range(permutations) for c, n in sizes.items() if n < 2]
    shifts = rows.sparkSession.createDataFrame(drawn, "chrom string, permutation int, shift int")
    by = shifted_moments(rows, fold, baseline, added, outcome, shifts, order)
    null = [models.nested_from_moments(by[k], len(baseline), 1)["partial_r2"] for k in sorted(by)]
    q = np.quantile(null, [0, 0.5, 0.95, 1])
    return {"permutations": permutations, "p": models.permutation_p(null, observed), "null": null, "null_quantiles": dict(zip(("min", "median", "p95", "max"), map(float, q)))}


def fit_outcomes(features: DataFrame, baseline: list[str], added: list[str], outcomes: list[str], contract: Contract = Contract(), seed: int = 0) -> dict[str, dict]:
    """Nested models and bootstrap intervals of several outcomes on the same features: three jobs for any number of outcomes."""
    predicted, out = models.nested_outcomes(_fold(features, contract), "fold", baseline, added, outcomes)
    squares = [F.sum((F.col(f"`{o}`") - F.col(f"`{p}::{o}`")) ** 2).alias(f"{p}_{j}") for j, o in enumerate(outcomes) for p in ("p0", "p1")]
    blocks = sorted(predicted.groupBy("chrom").agg(*squares).collect(), key=lambda r: r.chrom)  # a row for each chromosome
    return {o: out[o] | {"bootstrap": models.bootstrap_sse([r[f"p0_{j}"] for r in blocks], [r[f"p1_{j}"] for r in blocks], contract.draws, seed)} for j, o in enumerate(outcomes)}


def screen(features: DataFrame, baseline: list[str], added: str, outcome: str, replicates: list[str] = (), contract: Contract = Contract(), seed: int = 0) -> dict:
    """Partial R2 of an added column with its interval, its null and the gate; the effect's direction must hold in every replicate."""
    contract.validate()
    rows = _fold(features, contract).select("locus_id", "chrom", "start", "fold", *baseline, added, outcome)
    fits = fit_outcomes(features, baseline, [added], [outcome, *replicates], contract, seed)
    own = fits[outcome]
    null = permutation_test(rows, "fold", baseline, added, outcome, own["partial_r2"], contract.permutations, seed)
    confirmed = all(m > 0 for r in replicates for m in fits[r]["median_added_coefficients"])
    passed = confirmed and audit.primary_gate(own["partial_r2"], null["p"], own["median_added_coefficients"], contract.least_partial_r2, contract.most_p)
    return own | {"permutation": null, "p": null["p"], "replicates": {r: {"partial_r2": fits[r]["partial_r2"], "median": fits[r]["median_added_coefficients"]} for r in replicates}, "confirmed": confirmed, "passed": passed}


def screen_panel(tables: dict[str, DataFrame], baseline: list[str], added: str, outcome: str, replicates: list[str] = (), contract: Contract = Contract(), seed: int = 0) -> dict:
    """Every factor's screening and whether enough of them pass."""
    found = {tf: screen(t, baseline, added, outcome, replicates, contract, models.stable_seed(seed, tf)) for tf, t in sorted(tables.items())}
    return {"factors": found, "passed": audit.panel_gate([x["passed"] for x in found.values()], contract.passing_factors)}


def decompose(features: DataFrame, baseline: list[str], profiles: list[str], outcome: str, contract: Contract = Contract()) -> dict:
    """Each pair's score alone, and the mean of the others without it; both from one pass of moments, ranked by the partial R2 of each alone."""
    rows = _fold(features, contract)
    q = lambda c: F.col(f"`{c}`")
    out = []
    for p in profiles:
        rest = [x for x in profiles if x != p]
        frame = rows.withColumn("__one", q(p))
        alone = models.nested_from_moments(models.moments_by_fold(frame, "fold", [*baseline, "__one"], outcome), len(baseline), 1)
        row = {"pair": p, "partial_r2": alone["partial_r2"], "median_coefficient": alone["median_added_coefficients"][0]}
        if rest:
            mean: Column = sum((q(x) for x in rest[1:]), q(rest[0])) / len(rest)
            without = models.nested_from_moments(models.moments_by_fold(rows.withColumn("__rest", mean), "fold", [*baseline, "__rest"], outcome), len(baseline), 1)
            row["without_pair_partial_r2"] = without["partial_r2"]
        out.append(row)
    return {"pairs": sorted(out, key=lambda r: (-r["partial_r2"], r["pair"]))}


def replicate_states(tables: dict[str, DataFrame], baseline: list[str], added: str, outcome: str, replicates: list[str] = (), contract: Contract = Contract(), seed: int = 0) -> dict:
    """The same screening for each state of an external assay; a state replicates if its gate passes."""
    found = {state: screen(t, baseline, added, outcome, replicates, contract, seed) for state, t in sorted(tables.items())}
    return {"states": found, "replicated": sorted(s for s, x in found.items() if x["passed"])}


def benchmark_states(genes: dict[str, DataFrame], results: dict[str, DataFrame], added: str, out: str | None = None) -> dict:
    """For each state gene features against an expression outcome; predictions of all states in one table."""
    report, together = {}, None
    for state in sorted(genes):
        predicted, summary = panel.continuous_benchmark(genes[state], results[state], added)
        own = predicted.select(F.lit(state).alias("state"), "gene", "chrom", "gcm1_dependence", "p0", "p1")
        together = own if together is None else together.unionByName(own)
        report[state] = summary
    if out and together is not None:
        report["written"] = write_tsv(together, out, gzip=True)
    return report


def lift_signal(signal: DataFrame, blocks: DataFrame) -> tuple[DataFrame, dict]:
    """Signal intervals (chrom, s_start, s_end, value) moved to another assembly, sorted, and their summaries before and after. Intervals of which a chain maps less than its least share are left out."""
    named = signal.select(F.concat_ws(":", "chrom", "s_start", "s_end").alias("locus_id"), "chrom", F.col("s_start").alias("start"), F.col("s_end").alias("end"), "value")
    moved = intervals.liftover(named, blocks).filter("mapped").select(F.col("mapped_chrom").alias("chrom"), F.col("mapped_start").alias("s_start"), F.col("mapped_end").alias("s_end"), "value")
    report = {"before": intervals.bedgraph_summary(signal).first().asDict(), "after": intervals.bedgraph_summary(moved).first().asDict()}
    return moved.repartitionByRange("chrom", "s_start").sortWithinPartitions("chrom", "s_start"), report
