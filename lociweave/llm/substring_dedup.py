r"""Operator 10, substring dedup: seed and extend.

Seeds are winnowed anchors: of the hashes of each text's 10-word runs, the least in every 41 consecutive ones, so that each
50-word window has exactly one anchor, chosen from its own words alone. Documents are joined on their anchors, and each
seed is extended both ways in two steps. First by as far as any of its windows reaches, 40 words to either side (less at a
text's ends): where a smaller document has the same extended seed, all windows of the seed are repeats at once. Only the
first holders of different extensions of one anchor, which are the edges of maximal repeats, are then extended window by
window: a 128-bit hash decides, and a window whose least doc_id is smaller than the document's own is a repeat. (A later
holder of an extension adds nothing to compare with: its first holder has the same windows and a smaller id.)
Overlapping repeats merge into the maximal spans that are removed. No pairs of documents are made: a passage shared by n
documents costs n rows.

Defined results: words are [^\x20\x09-\x0D]+; a null or empty text has none and stays empty; kept words are joined by one
space; a text without a repeat keeps its words and order; rows with the same doc_id are the same document; a null doc_id is
smaller than all others; an empty table gives an empty table; extra columns are kept, whatever their names, but for those named as an output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import (
    add_columns, bounded_batches, map_batches, materialise, mix, shingle_hashes, space_words, text_bytes, unused, word_hashes,
)

WINDOW = 50
SEED = 10
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_I1, _I2 = pow(_B1, -1, 1 << 64), pow(_B2, -1, 1 << 64)
NULL_ID = -(1 << 63)


def anchors(x: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes of word hashes x, and for each window the place of the least one inside, the first of equal ones.

    The upper 32 bits are compared and the place rides in the lower ones, so that ties fall to the first place in any text.
    """
    s = shingle_hashes(x, seed, _B1)
    place = np.uint64(0xFFFFFFFF)
    best, have, w = (s & ~place) | np.arange(len(s), dtype=np.uint64), 1, window - seed + 1
    while have < w:
        step = min(have, w - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return s, (best & place).astype(np.int64)


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, kept for the longest text so far."""
    have = _powers_of.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 4096), np.uint64)
        have[0], have[1:] = 1, np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _powers_of[base] = have
    return have[:n]


def range_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B1, inverse: int = _I1) -> np.ndarray:
    """A 64-bit hash of the words of each range, from prefix sums."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(base, len(x)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(inverse, len(x) + 1)[starts])


def window_hashes(x: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows at starts."""
    ends = starts + window
    return range_hashes(x, starts, ends), range_hashes(mix(x ^ np.uint64(0xA5A5A5A5)), starts, ends, _B2, _I2)


def extended_seeds(x: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(at, a, e): each window's seed as a place, and at each place that is a seed its hash and its extension's hash.

    Both together, 128 bits, stand for the extension: e is only compared among seeds of equal a.
    """
    s, at = anchors(x, window, seed)
    place = np.flatnonzero(np.bincount(at, minlength=len(s)))
    reach = window - seed
    starts, ends = np.maximum(place - reach, 0), np.minimum(place + window, len(x))
    # with the lengths of both sides, so that equal extensions have the same windows
    sides = ((place - starts) << 32 | (ends - place)).astype(np.uint64)
    return at, place, s[place], mix(range_hashes(x, starts, ends) ^ mix(sides))


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def repeats(docs: DataFrame, key: str, part: str, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """For docs with ids in column key: (id, whole, starts): extended seeds all of whose windows, and starts of other windows, also start in a document with a smaller id."""
    texts = docs.select(F.col(key).alias("id"), "text").filter(F.length("text") >= 2 * window - 1)
    join = lambda parts: np.concatenate(parts) if parts else []

    def seeds(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "a": [], "e": []}
        for doc, text in zip(batch.column("id").to_pylist(), text_bytes(batch, "text")):
            words = space_words(text)
            if len(words) >= window:
                _, place, a, e = extended_seeds(word_hashes(words), window, seed)
                for name, values in (("id", doc), ("a", a.view(np.int64)), ("e", e.view(np.int64))):
                    out[name].append(values)
        return out

    # a row for each document, as a row for each seed takes more than twice the room
    found = materialise(map_batches(texts, seeds, "id long, a array<long>, e array<long>")).select("id", F.inline(F.arrays_zip("a", "e")))
    heads = found.groupBy("a", "e").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # an anchor is open if it has different extensions, first held by different documents
    # (materialised, so that the join has two plain shuffles and adaptive execution can split a hot anchor's rows)
    open_ = materialise(heads.groupBy("a").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).filter("x < y").select("a", F.lit(True).alias("open")))
    marked = materialise(heads.join(open_, "a", "left").filter("lo < hi or open").select("a", "e", "lo", F.coalesce("open", F.lit(False)).alias("open")))
    lists = found.join(marked, ["a", "e"]).filter("id > lo or open").select("id", "e", (F.col("id") > F.col("lo")).alias("whole"))
    lists = materialise(lists.groupBy("id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("e"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("e"))).alias("part")))
    partly = lists.filter(F.size("part") > 0).select(F.col("id").alias(key), F.col("part").alias(part))

    def extend(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "start": [], "h1": [], "h2": []}
        for doc, text, own in zip(batch.column(key).to_pylist(), text_bytes(batch, "text"), batch.column(part).to_pylist()):
            x = word_hashes(space_words(text))
            if len(x) < window:
                continue
            starts = _chosen(x, window, seed, own)
            if len(starts):
                h1, h2 = window_hashes(x, starts, window)
                for name, values in (("id", np.full(len(starts), doc, np.int64)), ("start", starts.astype(np.int32)), ("h1", h1.view(np.int64)), ("h2", h2.view(np.int64))):
                    out[name].append(values)
        return {name: join(parts) for name, parts in out.items()}

    # all columns of docs, as in the last join of the caller: both then read the same shuffled texts
    windows = map_batches(docs.join(partly, key), extend, "id long, start int, h1 long, h2 long")
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    later = windows.join(first, ["h1", "h2"]).filter(F.col("id") > F.col("lo")).groupBy("id").agg(F.collect_set("start").alias("starts"))
    return lists.select("id", "whole").join(later, "id", "left").filter("size(whole) > 0 or starts is not null")


def _chosen(x: np.ndarray, window: int, seed: int, extensions: list[int]) -> np.ndarray:
    """Starts of the windows whose seeds have these extensions."""
    at, place, _, e = extended_seeds(x, window, seed)
    hit = np.zeros(place[-1] + 1, bool)
    hit[place] = np.isin(e.view(np.int64), np.array(extensions, np.int64))
    return np.flatnonzero(hit[at])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with text as its kept words, n_words, n_removed and removed, the merged word ranges [start, end)."""
    bounded_batches(docs.sparkSession)
    key, part, all_, some = unused(docs, "id", "part", "whole", "starts")
    docs = docs.withColumn(key, _id())
    found = repeats(docs, key, part, window, seed).withColumnsRenamed({"id": key, "whole": all_, "starts": some})
    joined = docs.join(found, key, "left")

    def cut(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {"text": [], "n_words": [], "n_removed": [], "removed": []}
        for text, whole, starts in zip(text_bytes(batch, "text"), batch.column(all_).to_pylist(), batch.column(some).to_pylist()):
            words, spans = space_words(text), []
            starts = set(starts or ())
            if whole and len(words) >= window:
                starts.update(_chosen(word_hashes(words), window, seed, whole).tolist())
            for s in sorted(starts):
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = s + window
                else:
                    spans.append({"start": s, "end": s + window})
            n = len(words)
            for x in reversed(spans):
                del words[x["start"] : x["end"]]
            cols["text"].append(b" ".join(words).decode())
            cols["n_words"].append(n)
            cols["n_removed"].append(n - len(words))
            cols["removed"].append(spans)
        return cols

    return add_columns(joined, ["text"], cut, "text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>", drop=(key, all_, some))
