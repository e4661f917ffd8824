"""Operator 2, line dedup.

Two Bloom filters hold the hashes of lines seen once and seen twice. Every task fills its own pair from a bounded number of documents; the pairs
are merged by position in two steps, first those of tasks alike modulo FAN (a bit set in the once filters of two tasks counts as seen twice), so the merged twice
filter has no false negatives and no task holds more than a part of the pairs. Only lines that it suspects are shuffled; a 128-bit hash group then confirms the number of documents
and chooses the keeper. A full filter only means that more lines are shuffled: results never depend on its size. Confirmed keys with their keepers are broadcast
while they are few, so that no text is shuffled; beyond that each document gets its own by a join.

Defined results: a null or empty text is one empty line; documents are told apart by doc_id, rows with the same doc_id
count as one document and each of them is filtered; a null doc_id counts as one document, smaller than all others; an
empty table gives an empty table; extra columns are kept, whatever their names, but for those named as an output, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import add_columns, bounded_batches, map_batches, materialise, seq_hash, text_bytes, unused

MIN_CHARS = 20
MIN_DOCS = 3
#: The filters have 160 bits a document, between these powers of two: 2 MiB and, as a bound on what is broadcast, 64 MiB.
LEAST_BITS, MOST_BITS, BITS_A_DOCUMENT = 1 << 24, 1 << 29, 160
CHUNK = 1 << 17
#: Documents that a task fills a pair of filters from, where there are more than the cluster's tasks at once get through, and pairs that the last step merges.
TASK_DOCUMENTS, FAN = 1 << 21, 64
#: Confirmed keys that are broadcast, some 200 bytes each in a Python worker; beyond that each document's are joined to it.
MOST_FLAGGED = 100_000
NULL_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    r"""Stripped of [\x20\x09-\x0D] and with A-Z lower-cased; None if shorter than min_chars code points."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) & m


def _test(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in _bits(h, len(bloom) * 8):
        out &= (bloom[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return out


def _put(bloom: np.ndarray, h: np.ndarray) -> None:
    for p in _bits(h, len(bloom) * 8):
        np.bitwise_or.at(bloom, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def filter_bits(n_docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n_docs * BITS_A_DOCUMENT).bit_length()))


def filter_tasks(n_docs: int, at_once: int) -> int:
    """Tasks that fill filters: twice those that run at once, or more where that would give one too many documents to fill from or to lose."""
    return max(2 * max(2, at_once), -(-n_docs // TASK_DOCUMENTS))


def twice_filter(docs: DataFrame, bits: int, min_chars: int, tasks: int) -> bytes:
    """The merged filter of keys that occur in two documents at least; bits / 8 bytes."""
    def build(batches):
        group = TaskContext.get().partitionId() % FAN
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = []
            for text in text_bytes(batch, "text"):
                hashes += {xxhash.xxh3_64_intdigest(k) for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k}
            h, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
            _put(twice, h[(n > 1) | _test(once, h)])
            _put(once, h)
        for k in range(0, bits // 8, CHUNK):
            a, b = once[k : k + CHUNK], twice[k : k + CHUNK]
            if a.any():
                yield pa.RecordBatch.from_pydict({"g": pa.array([group], pa.int32()), "k": pa.array([k // CHUNK], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    def merge(table: pa.Table) -> pa.Table:
        once, twice = None, None
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
        own = {c: table.column(c).slice(0, 1) for c in ("g", "k")}
        return pa.table(own | {"a": [once.tobytes()], "b": [twice.tobytes()]})

    schema = "g int, k int, a binary, b binary"
    made = docs.select("text").coalesce(tasks).mapInArrow(build, schema)
    if tasks > FAN:  # up to FAN pairs the second step alone has no more to merge
        made = made.groupBy("g", "k").applyInArrow(merge, schema)
    merged = made.groupBy("k").applyInArrow(merge, schema).select("k", "b")
    bloom = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        bloom[row.k * CHUNK : (row.k + 1) * CHUNK] = np.frombuffer(row.b, np.uint8)
    return bloom.tobytes()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(id, h) of the lines that the filter suspects, and (h, keeper) of the keys in so many documents, as 16-byte hashes."""
    spark = docs.sparkSession
    n = docs.count()
    tasks = filter_tasks(n, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(twice_filter(docs, filter_bits(n), min_chars, tasks))

    def suspects(batch: pa.RecordBatch) -> dict:
        bloom = np.frombuffer(shared.value, np.uint8)
        ids, keys, hashes = [], [], []
        for doc, text in zip(batch.column("id").to_pylist(), text_bytes(batch, "text")):
            own = list({k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k})
            keys += own
            ids += [doc] * len(own)
            hashes += map(xxhash.xxh3_64_intdigest, own)
        hit = np.flatnonzero(_test(bloom, np.array(hashes, np.uint64)))
        return {"id": [ids[i] for i in hit], "h": [seq_hash(keys[i]) for i in hit]}

    found = materialise(map_batches(docs.select(_id(), "text"), suspects, "id long, h binary"))
    # materialised, so that a join with it has two plain shuffles and adaptive execution can split a hot line's rows
    flagged = materialise(
        found.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    )
    return found, flagged


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most: int = MOST_FLAGGED) -> DataFrame:
    """docs with text without its repeated lines, n_lines and n_dropped."""
    bounded_batches(docs.sparkSession)
    found, flagged = repeated_lines(docs, min_chars, min_docs)
    key, lost = unused(docs, "id", "lost")
    rows = docs.withColumn(key, _id())
    if flagged.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast({bytes(r.h): r.keeper for r in flagged.toLocalIterator()})
    else:
        shared = None
        drops = found.join(flagged, "h").filter(F.col("id") < F.col("keeper")).groupBy(F.col("id").alias(key)).agg(F.collect_set("h").alias(lost))
        rows = rows.join(drops, key, "left")

    def cut(batch: pa.RecordBatch) -> dict:
        texts, lines_n, dropped = [], [], []
        gone = [None] * batch.num_rows if shared else batch.column(lost).to_pylist()
        for doc, text, own in zip(batch.column(key).to_pylist(), text_bytes(batch, "text"), gone):
            lines = text.split(b"\n")
            lines_n.append(len(lines))
            if shared:
                keepers = shared.value
                kept = [x for x in lines if not ((k := line_key(x, min_chars)) and keepers.get(seq_hash(k), doc) > doc)] if keepers else lines
            elif own:
                own = set(own)
                kept = [x for x in lines if not ((k := line_key(x, min_chars)) and seq_hash(k) in own)]
            else:
                kept = lines
            dropped.append(len(lines) - len(kept))
            texts.append((b"\n".join(kept) if len(kept) < len(lines) else text).decode())
        return {"text": texts, "n_lines": lines_n, "n_dropped": dropped}

    return add_columns(rows, ["text"], cut, "text string, n_lines long, n_dropped long", drop=(key, lost))
