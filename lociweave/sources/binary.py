"""Readers of binary formats: archives, workbooks, bigWig signal, 2bit genomes, and chain files.

Archives and workbooks come through Spark's binaryFile source, so any store works; one file is one task. bigWig and 2bit files are
read in parts, by seeking (sources.random_access): as tables through the Python Data Source API, of ranges that are options, or at the places of loci, whose
number decides how much is read.
"""

from __future__ import annotations

import bisect
import io
import itertools
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociweave.sources.random_access import can_open, expand, open_file

_CHUNK = 1 << 16
#: Data blocks of a bigWig file that one task reads.
_BLOCKS = 256


def _content(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(path, content) of the files at a path, or of a frame that has them."""
    return (spark.read.format("binaryFile").load(source) if isinstance(source, str) else source).select("path", "content")


def _members(file: io.IOBase, name: str, wanted: set[str] | None, pattern: str) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's members, one at a time. A tar file is read once from the front, and no further than the last wanted member."""
    keep = lambda n: re.fullmatch(pattern, n) and (wanted is None or n in wanted)
    left = set(wanted) if wanted is not None else None
    head = file.read(4)
    file.seek(0)
    if head[:2] == b"PK":
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                if not i.is_dir() and keep(i.filename):
                    left = left and left - {i.filename}
                    yield i.filename, z.read(i)
    else:
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for m in t:
                if m.isfile() and keep(m.name):
                    yield m.name, t.extractfile(m).read()
                    left = left and left - {m.name}
                    if wanted is not None and not left:
                        break
                t.members.clear()  # what was read is not kept
    if left:
        raise ValueError(f"{name} lacks {', '.join(sorted(left))}")


def archive_members(spark: SparkSession, source: str | DataFrame, pattern: str = ".*", names: list[str] | None = None) -> DataFrame:
    """(archive, name, content) of the members of zip and tar files, of the wanted names only; a missing name is an error.

    source: a path, or a frame of (path, content). At a path that tasks can open by seeking an archive is read as a stream, so a task holds one member at a time,
    however large the archive is; in any other store, and in a frame, archives come whole, 2 GiB at most. A member is given whole or not at all.
    """
    wanted = set(names) if names else None
    streamed = isinstance(source, str) and can_open(spark, source)

    def expand_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, path in enumerate(frame["path"]):
                with open_file(path) if streamed else io.BytesIO(frame["content"].iloc[k]) as file:
                    for name, content in _members(file, path, wanted, pattern):
                        yield pd.DataFrame([(path, name, content)], columns=["archive", "name", "content"])

    if streamed:
        paths = spark.read.format("binaryFile").load(source).select("path")
        files = paths.repartition(max(1, min(paths.count(), 10_000)), "path")
    else:
        files = _content(spark, source)
    return files.mapInPandas(expand_, "archive string, name string, content binary")


def xlsx_rows(spark: SparkSession, source: str | DataFrame, sheet: str | None = None) -> DataFrame:
    """(file, sheet, row_no, cells) of workbooks at a path or in a frame of (path, content); row_no counts from 1 as in the file, cells are strings or null."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                for name, rows in workbook(content):
                    if sheet is None or name == sheet:
                        for k in range(0, len(rows), 4096):
                            part = rows[k : k + 4096]
                            yield pd.DataFrame({"file": file, "sheet": name, "row_no": [n for n, _ in part], "cells": [c for _, c in part]})

    return _content(spark, source).mapInPandas(read, "file string, sheet string, row_no long, cells array<string>")


def workbook(content: bytes) -> list[tuple[str, list[tuple[int, list]]]]:
    """[(sheet, [(row number, cells)])] of an XLSX file."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"):
            target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if tag(e) == "row"):
                cells: list = []
                for c in (e for e in row if tag(e) == "c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (max(at, len(cells) + 1) - len(cells))
                    v = next((e for e in c if tag(e) == "v"), None)
                    kind = c.get("t")
                    value = text(c) if kind == "inlineStr" else v.text if v is not None else None
                    value = shared[int(value)] if kind == "s" and value is not None else value
                    cells[at - 1 if at else len(cells) - 1] = value
                rows.append((int(row.get("r", len(rows) + 1)), cells))
            out.append((s.get("name"), rows))
    return out


def header_table(rows: DataFrame, header_row: int, columns: list[str]) -> DataFrame:
    """Rows below a header row as the named columns, all strings; repeated names take the first."""
    head = rows.filter(F.col("row_no") == header_row).first().cells
    gone = [c for c in columns if c not in head]
    if gone:
        raise ValueError(f"columns are missing: {', '.join(gone)}")
    return rows.filter(F.col("row_no") > header_row).select("row_no", *[F.get("cells", F.lit(head.index(c))).alias(c) for c in columns])


# --- bigWig


class BigWigFile:
    """Random access to a bigWig file's chromosomes and data blocks; file: a path or an open file."""

    def __init__(self, file: str | io.IOBase) -> None:
        self.f = open_file(file) if isinstance(file, str) else file
        head = self.f.read(64)
        self.e = "<" if len(head) == 64 and struct.unpack("<I", head[:4])[0] == 0x888FFC26 else ">"
        if len(head) < 64 or struct.unpack(self.e + "I", head[:4])[0] != 0x888FFC26:
            raise ValueError(f"{file} isn't a bigWig file")
        _, _, tree, _, self.index, _, _, _, _, self.packed = struct.unpack(self.e + "HHQQQHHQQI", head[4:56])
        self.chroms: dict[str, tuple[int, int]] = {}
        self.read_blocks = 0
        self.f.seek(tree)
        _, _, key, _, _, _ = struct.unpack(self.e + "IIIIQQ", self.f.read(32))
        self._chroms(tree + 32, key)

    def _chroms(self, at: int, key: int) -> None:
        self.f.seek(at)
        leaf, _, n = struct.unpack(self.e + "BBH", self.f.read(4))
        data = self.f.read(n * (key + 8))
        for k in range(n):
            item = data[k * (key + 8) : (k + 1) * (key + 8)]
            if leaf:
                self.chroms[item[:key].rstrip(b"\0").decode()] = struct.unpack(self.e + "II", item[key:])
            else:
                self._chroms(struct.unpack(self.e + "Q", item[key:])[0], key)

    def blocks(self, chrom: int, start: int = 0, end: int = 1 << 32, at: int | None = None) -> Iterator[tuple[int, int]]:
        """(offset, size) of the data blocks that may hold values of a chromosome's range, down the branches of the index that overlap it."""
        at = self.index + 48 if at is None else at
        self.f.seek(at)
        leaf, _, n = struct.unpack(self.e + "BBH", self.f.read(4))
        width = 32 if leaf else 24
        data = self.f.read(n * width)
        for k in range(n):
            lo, first, hi, last, offset = struct.unpack(self.e + "IIIIQ", data[k * width : k * width + 24])
            if (lo, first) < (chrom, end) and (hi, last) > (chrom, start):
                if leaf:
                    yield offset, struct.unpack(self.e + "Q", data[k * width + 24 : (k + 1) * width])[0]
                else:
                    yield from self.blocks(chrom, start, end, offset)

    def columns(self, chrom: int, offset: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(starts, ends, values) of a data block, or None if it is another chromosome's."""
        self.f.seek(offset)
        data = self.f.read(size)
        self.read_blocks += 1
        data = zlib.decompress(data) if self.packed else data
        own, start, _, step, span, kind, _, n = struct.unpack(self.e + "IIIIIBBH", data[:24])
        if own != chrom:
            return None
        integer, real = f"{self.e}u4", f"{self.e}f4"
        fields = {1: [("s", integer), ("t", integer), ("v", real)], 2: [("s", integer), ("v", real)]}.get(kind, [("v", real)])
        rows = np.frombuffer(data, np.dtype(fields), n, 24)
        starts = rows["s"].astype(np.int64) if kind in (1, 2) else start + step * np.arange(n, dtype=np.int64)
        return starts, rows["t"].astype(np.int64) if kind == 1 else starts + span, rows["v"].astype(np.float64)

    def values(self, chrom: int) -> Iterator[tuple[int, int, float]]:
        for at in list(self.blocks(chrom)):
            if found := self.columns(chrom, *at):
                yield from zip(*(x.tolist() for x in found))


class _Part(InputPartition):
    def __init__(self, path: str, name: str, *rest: int) -> None:
        self.path, self.name, self.rest = path, name, rest


class BigWigSource(DataSource):
    """spark.read.format('bigwig').load(path): chrom, s_start, s_end, value; a partition for _BLOCKS data blocks of a file's chromosome.

    Options chrom (names with commas between), start and end keep the intervals that overlap these ranges; only blocks whose range in the index overlaps are read.
    They are options, as Spark 4.1 keeps what it has pushed down to a source in Python with the table: another use of the same DataFrame, without filters or
    with others, then gets the rows of the first one's.
    """

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, s_start long, s_end long, value double"

    def reader(self, schema):
        return _BigWigReader(self.options)


class _BigWigReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.chroms = {c.strip() for c in options["chrom"].split(",")} if options.get("chrom") else None
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 32))

    def partitions(self):
        parts = []
        for p in expand(self.path):
            f = BigWigFile(p)
            for c, (k, _) in f.chroms.items():
                if self.chroms is None or c in self.chroms:
                    blocks = list(f.blocks(k, self.start, self.end))
                    parts += [_Part(p, c, k, *(x for b in blocks[i : i + _BLOCKS] for x in b)) for i in range(0, len(blocks), _BLOCKS)]
        return parts or [_Part("", "", 0)]

    def read(self, part):
        if not part.rest[1:]:
            return
        f, (chrom, *at) = BigWigFile(part.path), part.rest
        for offset, size in zip(at[::2], at[1::2]):
            if found := f.columns(chrom, offset, size):
                keep = (found[0] < self.end) & (found[1] > self.start)
                yield _signal_batch(part.name, *(x[keep] for x in found))


def _signal_batch(chrom: str, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chrom] * len(starts), pa.string()), pa.array(starts), pa.array(ends), pa.array(values)], names=["chrom", "s_start", "s_end", "value"])


def bigwig_content(files: DataFrame) -> DataFrame:
    """(chrom, s_start, s_end, value) of bigWig files in a column content, as Spark's binaryFile source gives them from any store; one file is one task, and at most 2 GiB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = BigWigFile(io.BytesIO(content.as_py()))
                for c, (k, _) in f.chroms.items():
                    for at in list(f.blocks(k)):
                        if found := f.columns(k, *at):
                            yield _signal_batch(c, *found)

    return files.select("content").mapInArrow(run, "chrom string, s_start long, s_end long, value double")


# --- 2bit


class TwoBitFile:
    """Random access to the sequences of a 2bit file; file: a path or an open file."""

    def __init__(self, path: str | io.IOBase) -> None:
        self.f = open_file(path) if isinstance(path, str) else path
        self.read_bytes = 0
        self._heads: dict[str, tuple[int, list, int]] = {}
        head = self.f.read(16)
        self.e = "<" if struct.unpack("<I", head[:4])[0] == 0x1A412743 else ">"
        mark, _, n, _ = struct.unpack(self.e + "IIII", head)
        if mark != 0x1A412743:
            raise ValueError(f"{path} isn't a 2bit file")
        self.at: dict[str, int] = {}
        for _ in range(n):
            name = self.f.read(self.f.read(1)[0]).decode()
            self.at[name] = struct.unpack(self.e + "I", self.f.read(4))[0]

    def _ranges(self) -> list[tuple[int, int]]:
        n = struct.unpack(self.e + "I", self.f.read(4))[0]
        starts, sizes = (struct.unpack(f"{self.e}{n}I", self.f.read(4 * n)) for _ in range(2))
        return list(zip(starts, sizes))

    def size(self, name: str) -> int:
        self.f.seek(self.at[name])
        return struct.unpack(self.e + "I", self.f.read(4))[0]

    def sequence(self, name: str, start: int, end: int) -> str:
        """The bases of a range, as far as it is inside; N where they are unknown. Only the range's bytes are read, and a sequence's unknown ranges once."""
        if name not in self._heads:
            size = self.size(name)
            unknown, _ = self._ranges(), self._ranges()
            self.f.read(4)
            self._heads[name] = size, unknown, self.f.tell()
        size, unknown, base = self._heads[name]
        start, end = max(0, start), min(end, size)
        if start >= end:
            return ""
        self.f.seek(base + start // 4)
        data = self.f.read((end + 3) // 4 - start // 4)
        self.read_bytes += len(data)
        text = "".join([_FOUR[b] for b in data])[start % 4 :][: end - start]
        first = max(0, bisect.bisect_right(unknown, (start, 1 << 32)) - 1)
        if first < len(unknown) and unknown[first][0] < end:
            out = list(text)
            for s, n in itertools.takewhile(lambda x: x[0] < end, itertools.islice(unknown, first, None)):
                a, b = max(s, start), min(s + n, end)
                if a < b:
                    out[a - start : b - start] = "N" * (b - a)
            text = "".join(out)
        return text


_FOUR = ["".join("TCAG"[b >> s & 3] for s in (6, 4, 2, 0)) for b in range(256)]


class TwoBitSource(DataSource):
    """spark.read.format('twobit').load(path): chrom, chunk, start, sequence, in chunks of 65,536 bases; a partition for 256 of them."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chrom string, chunk long, start long, sequence string"

    def reader(self, schema):
        return _TwoBitReader(self.options)


class _TwoBitReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self):
        parts = []
        for p in expand(self.path):
            f = TwoBitFile(p)
            for name in f.at:
                n = -(-f.size(name) // _CHUNK)
                parts += [_Part(p, name, k, min(n, k + 256)) for k in range(0, n, 256)]
        return parts

    def read(self, part):
        f = TwoBitFile(part.path)
        for k in range(*part.rest):
            yield part.name, k, k * _CHUNK, f.sequence(part.name, k * _CHUNK, (k + 1) * _CHUNK)


def twobit_content(files: DataFrame) -> DataFrame:
    """(chrom, chunk, start, sequence) of 2bit files in a column content; one file is one task, and at most 2 GiB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = TwoBitFile(io.BytesIO(content.as_py()))
                for name in f.at:
                    for k in range(-(-f.size(name) // _CHUNK)):
                        yield pa.RecordBatch.from_pydict({"chrom": [name], "chunk": [k], "start": [k * _CHUNK], "sequence": [f.sequence(name, k * _CHUNK, (k + 1) * _CHUNK)]})

    return files.select("content").mapInArrow(run, "chrom string, chunk long, start long, sequence string")


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    spark.dataSource.register(BigWigSource)
    spark.dataSource.register(TwoBitSource)


def contexts(loci: DataFrame, genome: DataFrame, width: int = 400) -> DataFrame:
    """loci with sequence: the width bases about midpoint, N beyond the chromosome's ends and for other letters. genome: chunks."""
    half = width // 2
    want = loci.select("locus_id", "chrom", (F.col("midpoint") - half).alias("a"), (F.col("midpoint") + width - half).alias("b"))
    want = want.withColumn("chunk", F.explode(F.expr(f"sequence(greatest(a, 0L) div {_CHUNK}, greatest(b - 1, 0L) div {_CHUNK})")))
    found = want.join(genome.select("chrom", "chunk", "start", "sequence"), ["chrom", "chunk"])
    piece = F.expr("substring(sequence, cast(greatest(a - start, 0L) + 1 AS int), cast(least(b - start, length(sequence)) - greatest(a - start, 0L) AS int))")
    parts = found.select("locus_id", "a", "b", "chunk", piece.alias("s")).groupBy("locus_id", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"]), "").alias("s"))
    left = F.greatest(-F.col("a"), F.lit(0)).cast("int")
    text = F.rpad(F.concat(F.repeat(F.lit("N"), left), F.regexp_replace(F.upper("s"), "[^ACGT]", "N")), width, "N")
    return loci.join(parts.select("locus_id", text.alias("sequence")), "locus_id", "left").withColumn("sequence", F.coalesce("sequence", F.lit("N" * width)))


def chain_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, b_start, b_end, to_chrom, to_start, strand, score, chain_id) of the ungapped blocks of chain files; both places are on the forward strand.

    Chains end with a blank line, so a row is a chain and an unpacked file is read in splits. A chain without an id has its header as one.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                rows, head = [], None
                for line in text.splitlines():
                    x = line.split()
                    if not x or x[0].startswith("#"):
                        continue
                    if x[0] == "chain":
                        head, name = x, x[12] if len(x) > 12 else line
                        t, q = int(x[5]), int(x[10])
                        continue
                    if head is None:
                        raise ValueError(f"a block before its chain: {line}")
                    n = int(x[0])
                    start = q if head[9] == "+" else int(head[8]) - q - n
                    rows.append((head[2], t, t + n, head[7], start, head[9], float(head[1]), name))
                    if len(x) == 3:
                        t, q = t + n + int(x[1]), q + n + int(x[2])
                for k in range(0, len(rows), 65_536):
                    yield pd.DataFrame(rows[k : k + 65_536], columns=["chrom", "b_start", "b_end", "to_chrom", "to_start", "strand", "score", "chain_id"])

    chains = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    return chains.mapInPandas(parse, "chrom string, b_start long, b_end long, to_chrom string, to_start long, strand string, score double, chain_id string")
