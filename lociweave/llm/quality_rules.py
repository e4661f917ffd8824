r"""Operator 1, quality rules: base counts of each text, and cross-document line frequency.

Every line is normalised (split at white space, lower-cased in A-Z, digits to 0, joined by one space), hashed to 64 bits,
and counted once for each document and host (here the column source). A line found in at least MIN_DOCS documents of a
host and in more than SHARE of the host's documents is removed there; a document that loses more than DEPLETED of its
words so is rejected. Limits are shares, so they are alike at every size.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own; rows with
the same doc_id are separate documents; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import add_columns, bounded_batches, map_batches, materialise, space_words, text_bytes, unused

MIN_WORDS = 50
MIN_DOCS = 10
SHARE = 0.005
DEPLETED = 0.5
_SYMBOLS = b"#*$%&|<>"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def line_hash(line: bytes) -> int | None:
    words = line.translate(_NORMAL).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def _measure(batch: pa.RecordBatch) -> dict:
    cols: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "h", "w")}
    for text in text_bytes(batch, "text"):
        words = space_words(text)
        joined = b"".join(words)
        seen, dups, lines = set(), 0, {}
        for line in text.split(b"\n"):
            own = line.translate(_NORMAL).split()
            if not own:
                continue
            dups += line in seen
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(own)
        cols["n_words"].append(len(words))
        cols["word_chars"].append(len(joined) if joined.isascii() else len(joined.decode()))
        cols["n_symbols"].append(len(text) - len(text.translate(None, _SYMBOLS)))
        cols["n_dup_lines"].append(dups)
        cols["n_repeat_words"].append(repeat_words(words))
        cols["h"].append(list(lines))
        cols["w"].append(list(lines.values()))
    return cols | {"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "host": batch.column("host")}


def _measured(docs: DataFrame, host: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(host).cast("string").alias("host"), "text"
    )
    return map_batches(rows, _measure, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {_STATS}, h array<long>, w array<long>")


def _removed(measured: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(rid, h, w): lines above the limits of their host."""
    lines = measured.select("rid", "host", F.explode(F.arrays_zip("h", "w")).alias("x")).select("rid", "host", "x.h", "x.w")
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_host"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    above = (
        counts.alias("c").join(F.broadcast(hosts).alias("o") if hosts.count() <= 100_000 else hosts.alias("o"), F.col("c.host").eqNullSafe(F.col("o.host")))
        .filter(F.col("n") > share * F.col("n_host")).select(F.col("c.host").alias("above_host"), F.col("h").alias("above_h"))
    )
    above = materialise(above)
    # a bounded list is broadcast, a longer one is joined by key, where adaptive execution splits a hot line's rows
    joined = F.broadcast(above) if above.count() <= 200_000 else above
    return lines.join(joined, (F.col("h") == F.col("above_h")) & F.col("host").eqNullSafe(F.col("above_host"))).select("rid", "h", "w")


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Per row of docs: doc_id, the base counts, n_lines_removed, n_words_left, base_failed, depleted, kept."""
    measured = materialise(_measured(docs, host))
    lost = _removed(measured, min_docs, share).groupBy("rid").agg(F.count("*").alias("n_lines_removed"), F.sum("w").alias("lost"))
    out = measured.drop("h", "w").join(lost, "rid", "left").withColumns({"n_lines_removed": F.coalesce("n_lines_removed", F.lit(0)), "lost": F.coalesce("lost", F.lit(0))})
    out = out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "n_words_left": F.col("n_words") - F.col("lost"),
        "depleted": F.col("lost") > depleted * F.col("n_words"),
    })
    out = out.withColumn("kept", ~(F.col("base_failed") | F.col("depleted")))
    return out.select("doc_id", *(x.split()[0] for x in _STATS.split(", ")), "n_lines_removed", "n_words_left", "base_failed", "depleted", "kept")


def strip_frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """docs without the lines above their host's limits and without depleted documents; failed base rules are not judged."""
    bounded_batches(docs.sparkSession)
    rid, gone_, lost_, words_ = unused(docs, "rid", "h", "lost", "n")
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()))
    measured = materialise(map_batches(
        rows.select(F.col(rid).alias("rid"), "doc_id", F.col(host).cast("string").alias("host"), "text"), _measure,
        f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {_STATS}, h array<long>, w array<long>"))
    lost = _removed(measured, min_docs, share).groupBy(F.col("rid").alias(rid)).agg(F.collect_list("h").alias(gone_), F.sum("w").alias(lost_))
    sizes = measured.select(F.col("rid").alias(rid), F.col("n_words").alias(words_))
    joined = rows.join(lost, rid, "left").join(sizes, rid).filter(F.coalesce(lost_, F.lit(0)) <= depleted * F.col(words_))

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for is_null, text, gone in zip(batch.column("text").is_null().to_pylist(), text_bytes(batch, "text"), batch.column(gone_).to_pylist()):
            gone = set(gone or ())
            out.append(None if is_null else b"\n".join(x for x in text.split(b"\n") if not gone or line_hash(x) not in gone).decode())
        return {"text": out}

    return add_columns(joined, ["text"], cut, "text string", drop=(rid, gone_, lost_, words_)).select(*docs.columns)
