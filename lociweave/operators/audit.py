"""Set audits, expression tables, gates and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def intersect_all(sets: Iterable[DataFrame]) -> DataFrame:
    """The values common to several one-column sets."""
    first, *others = list(sets)
    for o in others:
        first = first.intersect(o)
    return first


def coverage_differences(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("only_left", "only_right")) -> DataFrame:
    """(value, side): values of one set that the other lacks."""
    left, right = a.toDF("value").distinct(), b.toDF("value").distinct()
    return left.exceptAll(right).withColumn("side", F.lit(names[0])).unionByName(right.exceptAll(left).withColumn("side", F.lit(names[1])))


def tpm_rollup(quant: DataFrame, names: DataFrame) -> DataFrame:
    """(gene, tpm, transcripts): quant (transcript, tpm) with names (transcript, gene); what has no gene is left out."""
    return quant.join(names, "transcript").groupBy("gene").agg(F.sum("tpm").alias("tpm"), F.count("*").alias("transcripts"))


def mapping_rate(quant: DataFrame, names: DataFrame) -> DataFrame:
    joined = quant.join(names, "transcript", "left")
    return joined.agg(F.count("*").alias("transcripts"), F.count("gene").alias("mapped"), (F.count("gene") / F.count("*")).alias("mapping_rate"))


def partner_grid(samples: DataFrame, partners: DataFrame, expression: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(sample, partner, tpm, supported) for every sample and partner, both short lists; absent expression is 0."""
    total = expression.groupBy("sample", "partner").agg(F.sum("tpm").alias("tpm"))
    grid = samples.select("sample").distinct().crossJoin(F.broadcast(partners.select("partner").distinct())).join(total, ["sample", "partner"], "left")
    tpm = F.coalesce("tpm", F.lit(0.0))
    return grid.select("sample", "partner", tpm.alias("tpm"), (tpm >= threshold).alias("supported"))


def expression_support(replicates: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(gene, mean_tpm, minimum_replicate_tpm, expression_supported) of (gene, replicate, tpm)."""
    by = replicates.groupBy("gene", "replicate").agg(F.sum("tpm").alias("tpm")).groupBy("gene")
    out = by.agg(F.avg("tpm").alias("mean_tpm"), F.min("tpm").alias("minimum_replicate_tpm"))
    return out.withColumn("expression_supported", F.col("minimum_replicate_tpm") >= threshold)


def priority_source(partners: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(partner, source): the first of the named sources that has the partner, null if none."""
    out = partners.select("partner").distinct()
    for k, (name, table) in enumerate(sources):
        out = out.join(table.select("partner").distinct().withColumn(f"__{k}", F.lit(name)), "partner", "left")
    return out.select("partner", F.coalesce(*[F.col(f"__{k}") for k in range(len(sources))]).alias("source"))


def replicate_guard(files: DataFrame, group: str, replicate: str, wanted: list[int]) -> DataFrame:
    """(group, replicates, complete): whether a group has exactly the wanted replicates, each once."""
    by = files.groupBy(group).agg(F.sort_array(F.collect_list(replicate)).alias("replicates"))
    return by.withColumn("complete", F.col("replicates") == F.array(*[F.lit(w).cast("int") for w in wanted]))


def batch_scope(files: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, experiments, runs, files, bytes) of the listed batches."""
    own = files.join(batches.select("batch").distinct(), "batch", "left_semi")
    return own.groupBy("batch").agg(
        F.count_distinct("experiment").alias("experiments"), F.count_distinct("run").alias("runs"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )


def file_audit(rows: DataFrame, width: int | None = None) -> DataFrame:
    """rows, least and largest interval width, duplicate coordinates, and whether the table is eligible."""
    w = F.col("end") - F.col("start")
    by = rows.groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))
    out = by.agg(
        F.sum("n").alias("rows"), F.min(w).alias("width_min"), F.max(w).alias("width_max"), F.sum(F.col("n") - 1).alias("duplicate_coordinates"),
        F.bool_and((F.col("start") >= 0) & (w > 0)).alias("valid"),
    )
    same = (F.col("width_min") == width) & (F.col("width_max") == width) if width else F.lit(True)
    return out.withColumn("eligible", F.col("valid") & same & (F.col("rows") > 0))


def compare_reports(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both reports with the second less the first."""
    r = b.select(key, *[F.col(c).alias(f"{c}_second") for c in columns])
    return a.select(key, *[F.col(c).alias(f"{c}_first") for c in columns]).join(r, key).select(
        key, *[x for c in columns for x in (f"{c}_first", f"{c}_second")], *[(F.col(f"{c}_second") - F.col(f"{c}_first")).alias(f"{c}_difference") for c in columns]
    )


def primary_gate(partial_r2: float, p: float, medians: Iterable[float], least: float = 0.005, most_p: float = 0.05) -> bool:
    return partial_r2 >= least and p <= most_p and all(m > 0 for m in medians)


def panel_gate(passed: Iterable[bool], least: int = 4) -> bool:
    return sum(map(bool, passed)) >= least


def sha256_file(path: str, algorithm: str = "sha256", chunk: int = 1 << 24) -> str:
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while data := f.read(chunk):
            h.update(data)
    return h.hexdigest()


def audit_asset(path: str) -> dict[str, object]:
    return {"path": path, "size_bytes": os.path.getsize(path), "sha256": sha256_file(path)}


def asset_manifest(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(name, size_bytes, sha256) of the files that a path, folder or glob names, in any store that Spark reads, or of a frame of (path, content); a file is one task's."""
    found = spark.read.format("binaryFile").load(source) if isinstance(source, str) else source
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The found assets; a missing, an unexpected or a changed one is an error."""
    both = found.alias("f").join(wanted.alias("w"), F.col("f.name") == F.col("w.name"), "full")
    same = (F.col("f.size_bytes") == F.col("w.size_bytes")) & (F.col("f.sha256") == F.col("w.sha256"))
    name = F.coalesce("f.name", "w.name")
    checked = F.when(F.coalesce(same, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("not the frozen asset: "), name)).cast("string"))
    return both.select(checked.alias("name"), F.col("f.size_bytes").alias("size_bytes"), F.col("f.sha256").alias("sha256"))


def exact_members(found: list[str], wanted: list[str], what: str = "assets") -> None:
    """An error unless both have the same members, each once."""
    if len(set(found)) != len(found) or set(found) != set(wanted):
        raise ValueError(f"{what} differ: missing {sorted(set(wanted) - set(found))}, not expected {sorted(set(found) - set(wanted))}, repeated {sorted({x for x in found if found.count(x) > 1})}")


def replicate_assets(records: list[dict], replicates: tuple[int, ...] = (1, 2)) -> dict[int, dict]:
    """Asset records by replicate; there must be exactly these."""
    exact_members([str(r["replicate"]) for r in records], [str(r) for r in replicates], "replicates")
    return {int(r["replicate"]): r for r in records}


def session_versions(text: str, wanted: dict[str, str]) -> dict[str, str]:
    """The versions of R and of packages in the text of its session information; another version, or none, is an error."""
    found = {}
    for name, version in wanted.items():
        m = re.search(rf"R version (\S+)" if name == "R" else rf"(?<![\w.]){re.escape(name)}_(\S+)", text)
        found[name] = m[1] if m else ""
        if found[name] != version:
            raise ValueError(f"{name} must have version {version}, not {found[name] or 'none'}")
    return found


def verify_asset(path: str, size: int, digest: str) -> None:
    got = audit_asset(path)
    if got["size_bytes"] != size or got["sha256"] != digest:
        raise ValueError(f"{path} isn't the frozen asset")


#: Parts of the names of assets that are selected by the outcome.
FORBIDDEN_ASSETS = ("TOPs", "CTOPs", "MOODS_Triple_Optimized", "Peaks_Triple_Optimized", "Peaks_Triple_Overlap")


def assert_primary_asset_allowed(path: str, blocked: Iterable[str] = FORBIDDEN_ASSETS) -> None:
    if any(b in path.lower() for b in (x.lower() for x in blocked)):
        raise ValueError(f"{path} may not be a primary asset")


def json_text(payload: object) -> str:
    """Keys in order, two spaces, a newline at the end."""
    return json.dumps(payload, sort_keys=True, indent=2) + "\n"


def write_json(payload: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json_text(payload))
