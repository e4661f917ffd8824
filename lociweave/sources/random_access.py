"""Files that tasks read by seeking, in any store, and what is read at the places of loci.

A path of a scheme that Arrow has a file system for is read there in ranges. Any other path but a local one is handed to Spark (SparkContext.addFile), which
copies it once to every executor through its own file systems; so is a local one on a cluster, whose executors may not see it.
"""

from __future__ import annotations

import fnmatch
import glob
import io
import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Marks the path of a file that Spark has copied to the executors.
_COPIED = "copied:"
_LOCAL = ("", "file")


def _scheme(path: str) -> str:
    return m[1].lower() if (m := re.match(r"([a-zA-Z][a-zA-Z0-9+.-]+):", path)) else ""


def _local(path: str) -> str:
    return urlsplit(path).path if _scheme(path) == "file" else path


def open_file(path: str) -> io.IOBase:
    """A local path, one of Arrow's file systems, or a copied file, for reading with seeks."""
    if path.startswith(_COPIED):
        return open(SparkFiles.get(path.removeprefix(_COPIED)), "rb")
    if _scheme(path) in _LOCAL:
        return open(_local(path), "rb")
    store, at = pafs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def expand(path: str) -> list[str]:
    """The files that a path or pattern names, in order; none is an error."""
    if path.startswith(_COPIED):
        return [path]
    if _scheme(path) in _LOCAL:
        found = sorted(glob.glob(_local(path)))
    elif re.search(r"[*?\[]", path):
        folder, pattern = posixpath.split(path)
        store, at = pafs.FileSystem.from_uri(folder)
        found = sorted(f"{folder}/{x.base_name}" for x in store.get_file_info(pafs.FileSelector(at)) if x.is_file and fnmatch.fnmatch(x.base_name, pattern))
    else:
        found = [path]
    if not found:
        raise FileNotFoundError(f"no file is at {path}")
    return found


def can_open(spark: SparkSession, path: str) -> bool:
    """Whether every task can open the path as it is: a local one where all tasks run on one host, or one of Arrow's file systems."""
    master = spark.sparkContext.master
    if _scheme(path) in _LOCAL:
        return master.startswith("local") and not master.startswith("local-cluster")
    try:
        pafs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowException, OSError):
        return False


def reachable(spark: SparkSession, path: str) -> str:
    """A path that open_file() can open in every task: the path itself, or that of a copy that Spark makes on every executor."""
    if can_open(spark, path):
        return path
    spark.sparkContext.addFile(path)
    return _COPIED + posixpath.basename(path)


def at_loci(loci: DataFrame, order: str, columns: dict[str, str], make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """loci with columns that a reader works out from a batch of them, in the order of their places, so that neighbours read the same parts.

    make gives the reader, once for each task; it takes the batch's chrom and the columns that are numbers. An added column replaces one of the same name.
    """
    names = {c.lower() for c in columns}
    keep = [f for f in loci.schema if f.name.lower() not in names]
    schema = T.StructType(keep + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items())).fields)
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or make()
            found = reader({n: batch.column(n).to_pylist() for n in batch.schema.names if n == "chrom" or pa.types.is_integer(batch.schema.field(n).type)})
            arrays = [batch.column(n) for n in kept] + [pa.array(found[n]) for n in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])

    return loci.repartitionByRange("chrom", order).sortWithinPartitions("chrom", order).mapInArrow(run, schema)


def bigwig_statistic(loci: DataFrame, path: str, column: str, statistic: str = "mean") -> DataFrame:
    """loci (chrom, start, end, ...) with a bigWig file's mean over covered bases, sum or max over each; 0 where there is none.

    Every locus goes down the index to the blocks that overlap it; blocks are kept while the loci that follow need them. No signal is shuffled.
    """
    from lociweave.sources.binary import BigWigFile

    if statistic not in ("mean", "sum", "max"):
        raise ValueError("statistic is mean, sum or max")
    path = reachable(loci.sparkSession, path)

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        f = BigWigFile(path)
        held: dict[tuple[int, int], tuple | None] = {}

        def read(batch: dict[str, list]) -> dict[str, list]:
            nonlocal held
            out = []
            for chrom, start, end in zip(batch["chrom"], batch["start"], batch["end"]):
                if chrom not in f.chroms or start is None or end is None or start >= end:
                    out.append(0.0)
                    continue
                number = f.chroms[chrom][0]
                needed = list(f.blocks(number, start, end))
                held = {at: held[at] if at in held else f.columns(number, *at) for at in needed}
                total = covered = 0.0
                most = -np.inf
                for found in held.values():
                    if found is not None:
                        s, t, v = found
                        a, b = np.searchsorted(t, start, "right"), np.searchsorted(s, end, "left")
                        w = np.minimum(t[a:b], end) - np.maximum(s[a:b], start)
                        total, covered = total + float(w @ v[a:b]), covered + float(w.sum())
                        most = max(most, v[a:b].max(initial=-np.inf))
                value = {"mean": total / covered if covered else 0.0, "sum": total, "max": float(most)}[statistic]
                out.append(value if np.isfinite(value) else 0.0)
            return {column: out}

        return read

    return at_loci(loci, "start", {column: "double"}, make)


def twobit_contexts(loci: DataFrame, path: str, width: int = 400) -> DataFrame:
    """loci (chrom, midpoint, ...) with sequence: the width bases of a 2bit file about midpoint, N beyond the chromosome's ends, for unknown bases and unknown chromosomes."""
    from lociweave.sources.binary import TwoBitFile

    path, half = reachable(loci.sparkSession, path), width // 2

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        f = TwoBitFile(path)

        def read(batch: dict[str, list]) -> dict[str, list]:
            out = []
            for chrom, mid in zip(batch["chrom"], batch["midpoint"]):
                if chrom not in f.at or mid is None:
                    out.append("N" * width)
                    continue
                a = mid - half
                out.append(("N" * min(width, max(0, -a)) + f.sequence(chrom, a, a + width)).ljust(width, "N"))
            return {"sequence": out}

        return read

    return at_loci(loci, "midpoint", {"sequence": "string"}, make)
