"""Operator 6, packing by Karmarkar-Karp multiway differencing.

Each text becomes token ids with an end id. Whole windows are cut from long documents; what is left of each waits in a pool. When the pool holds GROUP
windows less a little slack, its last document is cut there and the pool is divided. Every item begins as a partial partition of one filled and k - 1 empty
windows, and the two partial partitions with the largest imbalance are merged, the fullest window of one on the emptiest of the other, until one is left, whose
windows are near-equal. While a window exceeds its capacity, the windows that do and SHARE times as many of the emptiest are differenced anew, and with one window more
if that isn't enough; so the count of windows rises, and nothing but a document longer than a window or at a pool's end is ever cut. The pool at the end of a
partition is divided alike. Pools are local to a task and bounded, so nothing is shuffled, and a lost task repeats the same work. On documents of some 1,300
tokens the padding is about 1 % of the windows of a full pool.

Ids are those of the byte-level BPE in the tokenizers file: its vocabulary is read from there and applied by tiktoken,
which gives the same ids (a test compares them) in a fourth of the time.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id is kept; an empty
table gives no pieces; other columns are not read. The string of an added token in a text becomes that token's id with added_tokens, as the file's
tokenizer does at its default settings, and is ordinary text without; the query and the pipeline set it.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import bounded_batches

WINDOW = 2048
END_ID = 1
#: Windows of one pool, and tokens of each that are left free when a pool is cut off.
GROUP, SLACK = 256, 4
#: Emptiest windows that are differenced anew with each one that is too full.
SHARE = 2
#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None):
    """The file's vocabulary as a tiktoken encoding; built once in a process."""
    if path not in _encoders:
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
        with open(path or tokenizer_path(), encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items 0..n-1 dealt over k bins with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    nodes: list[tuple] = []
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        nodes.append((i, None, None, None))
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        nodes.append((None, a, b, order))
        heapq.heappush(heap, (int(total[-1] - total[0]), len(nodes) - 1, total))
    bins: list[list[int]] = [[] for _ in range(k)]
    stack = [(heap[0][1], np.arange(k))] if heap else []
    while stack:
        node, to = stack.pop()  # to: the final bin of each of the node's bins
        item, a, b, order = nodes[node]
        if item is not None:
            bins[to[0]].append(item)
            continue
        back = np.empty(k, np.int64)
        back[order] = to
        stack.append((a, back))
        stack.append((b, back[::-1]))
    return bins


def divide(sizes: list[int], window: int) -> list[list[int]]:
    """Items 0..n-1, none above the window, over near-equal bins within the window, whose count rises as long as one exceeds it."""
    bins = difference(sizes, max(1, -(-sum(sizes) // window)))
    while True:
        filled = sorted(((sum(sizes[i] for i in b), b) for b in bins if b), key=lambda x: x[0])
        over = [b for n, b in filled if n > window]
        if not over:
            return [b for _, b in filled]
        fits = [b for _, b in filled[: len(filled) - len(over)]]
        few, rest = fits[: SHARE * len(over)], fits[SHARE * len(over) :]
        items = sorted(i for b in over + few for i in b)
        own = [sizes[i] for i in items]
        again = difference(own, len(over) + len(few))
        if any(sum(own[i] for i in b) > window for b in again):
            again = difference(own, len(over) + len(few) + 1)
        bins = rest + [[items[i] for i in b] for b in again]


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        encode = (lambda text: own.encode(text, allowed_special="all")) if added_tokens else own.encode_ordinary
        sequence = TaskContext.get().partitionId() << 32
        pool: list[tuple] = []
        held, rows = 0, {n: [] for n in names}
        target, id_type = GROUP * (window - SLACK), None

        def put(doc, start, ids, n, sequence, offset):
            values = (doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset) + ((ids.astype(np.int32),) if with_ids else ())
            for name, v in zip(names, values):
                rows[name].append(v)

        def flush(pool):
            nonlocal sequence
            for own in divide([len(p[2]) for p in pool], window) if pool else ():
                offset = 0
                for doc, start, ids, n in (pool[i] for i in sorted(own)):
                    put(doc, start, ids, n, sequence, offset)
                    offset += len(ids)
                sequence += 1

        def out():
            arrays = {n: pa.array(rows[n], id_type if n == "doc_id" else pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names}
            for n in names:
                rows[n] = []
            return pa.RecordBatch.from_pydict(arrays)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                n, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    put(doc, start, ids[start : start + window], n, sequence, 0)
                    sequence += 1
                start = whole
                while start < n:
                    take = min(n - start, target - held)
                    pool.append((doc, start, ids[start : start + take].copy(), n))
                    held, start = held + take, start + take
                    if held == target:
                        flush(pool)
                        pool, held = [], 0
            if len(rows["doc_id"]) >= 1024:
                yield out()
        flush(pool)
        if rows["doc_id"]:
            yield out()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
