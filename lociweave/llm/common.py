"""What the operators of this subpackage share: reading, Arrow row mapping, hashing, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole texts travel in Arrow batches of at most so many rows, which Spark also ends at spark.sql.execution.arrow.maxBytesPerBatch (64 MiB unless set); both bound a
#: Python worker's memory.
BATCH_ROWS = 256

#: Bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased stay, others become a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches within the bound; a smaller setting of the session stays. Other plans of the session get the same batches."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def space_words(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ of UTF-8 bytes."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    r"""A-Z lower-cased, then words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of UTF-8 bytes."""
    return text.translate(_ALNUM).split()


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null becomes empty."""
    col = batch.column(column)
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow with a function from one batch to columns."""
    spark_schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, dict):
                arrays = [
                    v.cast(f.type) if isinstance(v := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type)
                    for f in target
                ]
                out = pa.RecordBatch.from_arrays(arrays, schema=target)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, spark_schema)


def add_columns(
    docs: DataFrame, inputs: list[str], fn: Callable[[pa.RecordBatch], dict[str, list]], added: str, drop: tuple = ()
) -> DataFrame:
    """docs with columns computed from its inputs; an added column replaces one of the same name."""
    extra = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in extra}
    gone = {x.lower() for x in drop}
    keep = [f for f in docs.schema if f.name.lower() not in names | gone]
    schema = T.StructType([*keep, *extra])
    kept = [f.name for f in keep]

    def run(batch: pa.RecordBatch) -> dict:
        out = fn(batch)
        return {n: batch.column(n) for n in kept} | out

    return map_batches(docs, run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


def actual_name(df: DataFrame, name: str) -> str:
    """The column's name as df spells it."""
    return next(c for c in df.columns if c.lower() == name.lower())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and all tasks run in the driver's process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        at = context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lociweave-checkpoint-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        context.setCheckpointDir(at)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on uint64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each k consecutive word hashes, mixed."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b, acc = np.uint64(base), x[:n].copy()
    for j in range(1, k):
        acc *= b
        acc += x[j : j + n]
    return mix(acc)


def seq_hash(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def sha256_of(col: str) -> F.Column:
    return F.sha2(F.col(col), 256)
