"""Files from outside: downloads that resume, and members of archives that stream."""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import tarfile
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_CHUNK = 1 << 20


def _digest(path: str, algorithm: str) -> str:
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while data := f.read(_CHUNK):
            h.update(data)
    return h.hexdigest()


def verified(path: str, record: dict) -> bool:
    """Whether a file has the size and the hashes of its record, as far as it names them."""
    if not os.path.exists(path) or record.get("size_bytes") not in (None, os.path.getsize(path)):
        return False
    return all(record.get(k) in (None, "") or _digest(path, k) == str(record[k]).lower() for k in ("md5", "sha256"))


def download(record: dict, folder: str, timeout: float = 60) -> dict:
    """Fetches a record's url into the folder, going on where a part of it is there; what doesn't verify is an error and leaves no file of that name."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, record.get("filename") or record["url"].rstrip("/").rsplit("/", 1)[-1])
    if not verified(target, record) or not any(record.get(k) for k in ("size_bytes", "md5", "sha256")):
        part = f"{target}.part"
        have = os.path.getsize(part) if os.path.exists(part) else 0
        request = urllib.request.Request(record["url"], headers={"Range": f"bytes={have}-"} if have else {})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            with open(part, "ab" if have and answer.status == 206 else "wb") as f:
                shutil.copyfileobj(answer, f, _CHUNK)
        if not verified(part, record):
            os.remove(part)
            raise ValueError(f"{record['url']} doesn't have the size and hashes of its record")
        os.replace(part, target)
    return record | {"path": target, "size_bytes": os.path.getsize(target), "sha256": _digest(target, "sha256")}


def download_all(records: list[dict], folder: str, threads: int = 4) -> list[dict]:
    """All records in order, several at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda r: download(r, folder), records))


def extract(spark: SparkSession, archives: list[str], names: list[str], folder: str) -> DataFrame:
    """(archive, name, path, size_bytes) of members that are written below a shared folder in one pass of each archive; a missing name is an error.

    An archive is one task's and streams, so its members may be of any size. A member takes its name only when it is whole. The archives and the folder must be
    readable as files by all executors.
    """
    wanted = set(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["archive"]:
                rows = []
                with tarfile.open(archive, "r|*") as t:
                    for m in t:
                        name = os.path.basename(m.name)
                        if not m.isfile() or name not in wanted:
                            continue
                        path = os.path.join(folder, name)
                        with open(f"{path}.{os.getpid()}.part", "wb") as f:
                            shutil.copyfileobj(t.extractfile(m), f, _CHUNK)
                        os.replace(f"{path}.{os.getpid()}.part", path)
                        rows.append((archive, name, path, m.size))
                if gone := wanted - {r[1] for r in rows}:
                    raise ValueError(f"{archive} lacks {', '.join(sorted(gone))}")
                yield pd.DataFrame(rows, columns=["archive", "name", "path", "size_bytes"])

    os.makedirs(folder, exist_ok=True)
    return spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives))).mapInPandas(run, "archive string, name string, path string, size_bytes long")


def gene_of_member(content: bytes, gene: str, column: str = "gene_id") -> dict[str, float]:
    """The numbers of one gene in a tab-separated table, gzip or plain; none or two rows of it are an error."""
    lines = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode().splitlines()
    head = lines[0].split("\t")
    found = [x for x in (line.split("\t") for line in lines[1:]) if x[head.index(column)].split(".")[0] == gene]
    if len(found) != 1:
        raise ValueError(f"{gene} has {len(found)} rows")
    out = {}
    for k, v in zip(head, found[0]):
        try:
            out[k] = float(v)
        except ValueError:
            continue
    return out
