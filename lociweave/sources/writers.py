"""Bytes of small files in the formats that sources.binary reads, and a shared folder to put files in."""

from __future__ import annotations

import atexit
import io
import shutil
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a local one only where none is set and all tasks run in the driver's process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lociweave-files-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"{at}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes one file through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def put_lines(df: DataFrame, path: str, one: bool = False) -> str:
    """Writes a table of one string column as text; as one file if the reader needs the order of lines."""
    (df.coalesce(1) if one else df).write.text(path)
    return path


def made_files(rows: DataFrame, by: list[str], make: Callable[[pd.DataFrame], bytes], name: str = "file-{}") -> DataFrame:
    """(path, content): a file of each group of rows, made by the group's task, as Spark's binaryFile source would give them; name takes the group's values."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [name.format(*(frame[c].iloc[0] for c in by))], "content": [make(frame)]})

    if not by:
        name = name.replace("{}", "0")
    return rows.groupBy(*by).applyInPandas(one, "path string, content binary")


def zip_bytes(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """An XLSX file; strings are inline, numbers are numbers, None leaves a cell out."""

    def cell(k: int, i: int, v: object) -> str:
        at = f'r="{_letters(i)}{k}"'
        return f"<c {at}><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    files = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k, _ in enumerate(sheets, 1)) + "</Relationships>",
    }
    for k, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{n}">' + "".join(cell(n, i, v) for i, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    return zip_bytes({n: c.encode() for n, c in files.items()})


def bigwig_bytes(signal: dict[str, tuple[int, list[tuple[int, int, float]]]], items: int = 512, fan: int = 256) -> bytes:
    """A bigWig file of {chromosome: (size, sorted disjoint intervals)}: uncompressed blocks of so many intervals, one tree of chromosomes, and a tree of blocks of that fan."""
    names, width = sorted(signal), max((len(n) for n in signal), default=1)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, len(names), width, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(width, b"\0") + struct.pack("<II", k, signal[n][0]) for k, n in enumerate(names))
    at, data = 64 + len(tree), b""
    level: list[tuple] = []  # of each block or node: its range, and its offset and size, or its bytes
    for k, n in enumerate(names):
        values = signal[n][1]
        for i in range(0, len(values), items):
            part = values[i : i + items]
            block = struct.pack("<IIIIIBBH", k, part[0][0], part[-1][1], 0, 0, 1, 0, len(part)) + b"".join(struct.pack("<IIf", *v) for v in part)
            level.append(((k, part[0][0], k, part[-1][1]), at + len(data), len(block)))
            data += block
    count, leaf, nodes, begin = len(level), 1, b"", at + len(data) + 48
    head = struct.pack("<IIQIIIIQII", 0x2468ACE0, max(1, count), count, 0, 0, len(names), 0, at + len(data), items, 0)
    # nodes are laid out from the leaves up, but the root stands first: places are known once all are counted
    tiers = [[level[i : i + fan] for i in range(0, count, fan)] or [[]]]
    while len(tiers[-1]) > 1:
        below = tiers[-1]
        tiers.append([[((*x[0][0][:2], *x[-1][0][2:]), j + i) for j, x in enumerate(below[i : i + fan])] for i in range(0, len(below), fan)])
    places, to = {}, begin
    for t in range(len(tiers) - 1, -1, -1):
        for j, x in enumerate(tiers[t]):
            places[t, j] = to
            to += 4 + len(x) * (24 if t else 32)
    for t in range(len(tiers) - 1, -1, -1):
        leaf = int(not t)
        for x in tiers[t]:
            nodes += struct.pack("<BBH", leaf, 0, len(x))
            nodes += b"".join(struct.pack("<IIIIQQ", *own[0], own[1], own[2]) if leaf else struct.pack("<IIIIQ", *own[0], places[t - 1, own[1]]) for own in x)
    return struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, at + len(data), 0, 0, 0, 0, 0, 0) + tree + data + head + nodes


_TWO = np.zeros(256, np.uint8)
for _i, _b in enumerate("TCAG"):
    _TWO[ord(_b)] = _i


def twobit_bytes(sequences: dict[str, str]) -> bytes:
    """A 2bit file; letters besides A, C, G and T are unknown."""
    index, records = b"", b""
    at = 16 + sum(5 + len(n.encode()) for n in sequences)
    for n, s in sequences.items():
        index += bytes([len(n.encode())]) + n.encode() + struct.pack("<I", at + len(records))
        code = np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (~np.isin(code, np.frombuffer(b"ACGT", np.uint8))).astype(np.int8), [0]])))
        starts, sizes = edges[::2].astype("<u4"), (edges[1::2] - edges[::2]).astype("<u4")
        two = np.concatenate([_TWO[code], np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
        packed = (two << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
        records += struct.pack("<II", len(s), len(starts)) + starts.tobytes() + sizes.tobytes() + struct.pack("<II", 0, 0) + packed.tobytes()
    return struct.pack("<IIII", 0x1A412743, 0, len(sequences), 0) + index + records
