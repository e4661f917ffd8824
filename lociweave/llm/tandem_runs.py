r"""Operator 11, periodic runs of words by the tandem-repeat method of Gusfield and Stoye.

The documents of an Arrow batch are laid one after the other, each with letters of its own and an end mark, and indexed once: names of all stretches of 2^k words
(prefix doubling), the suffix order and the common prefixes of neighbours in it, whose intervals are the nodes of the suffix tree. Then

1. the Lempel-Ziv blocks are read off the longest previous factors, and for each block the squares about its right and its left end are found by
   extending both ways; they cover the leftmost occurrence of every square of the text,
2. from the node of each such square xA suffix links lead to that of Ax for as long as that is a square as well, which completes the vocabulary; a node that is
   marked already ends nothing new,
3. the leaves below each node are the places of its square, and squares of one period at neighbouring places merge into runs.

Only squares with a primitive root are followed, so that a run has its smallest period and there are O(n log n) places for n words. Extensions compare names,
O(log n) steps each. All steps are array operations over the batch; a batch is cut into pieces of some PIECE words, a longer document being a piece of its own,
so memory is bounded by the longest document. No rows are shuffled, and a lost task repeats the same work.

Defined results: a null, empty or wordless text has no runs and an empty collapsed text; repeated rows get the same result each; a null doc_id is kept; an empty
table gives an empty one; other columns stay, but for those that are replaced by the added ones of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import add_columns, bounded_batches, space_words, text_bytes

#: Words of one piece of a batch.
PIECE = 1 << 18
MIN_LENGTH, MIN_EXPONENT = 6, 4
_SPACE = " \t\n\x0b\x0c\r"


class SuffixIndex:
    """Names, suffix order and common prefixes of a sequence whose last letter and every document's end mark occur once each."""

    def __init__(self, letters: np.ndarray) -> None:
        n = len(letters)
        # names[k][i]: the first place in suffix order of the stretch of 2^k letters at i
        first = np.zeros(int(letters.max()) + 2, np.int64)
        np.cumsum(np.bincount(letters), out=first[1:])
        name = first[letters].astype(np.int32)
        self.n, self.names = n, [name]
        open_ = np.flatnonzero((first[1:] - first[:-1])[letters] > 1)
        self.shared = open_
        k = 1
        while len(open_):
            head = name[open_].astype(np.int64)
            key = head * (n + 1) + name[open_ + k]
            order = np.argsort(key)
            at, key, head = open_[order], key[order], head[order]
            at_index = np.arange(len(at), dtype=np.int64)
            new = np.concatenate(([True], key[1:] != key[:-1]))
            old = np.concatenate(([True], head[1:] != head[:-1]))
            begin = np.maximum.accumulate(np.where(new, at_index, 0))
            name = name.copy()
            name[at] = head + begin - np.maximum.accumulate(np.where(old, at_index, 0))
            self.names.append(name)
            alone = new & np.concatenate((new[1:], [True]))
            open_ = at[~alone]
            k *= 2
        self.order = np.empty(n, np.int32)
        self.order[name] = np.arange(n, dtype=np.int32)
        self.rank = name

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from a and b on agree; a and b differ."""
        return self._extend(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters before a and b agree; a and b differ."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        live, top = np.arange(len(a)), []
        for k, name in enumerate(self.names):  # upwards, with those that agree in 2^k letters
            x, y = (a[live], b[live]) if step > 0 else (a[live] - (1 << k), b[live] - (1 << k))
            same = name[np.maximum(x, 0)] == name[np.maximum(y, 0)] if step > 0 else (np.minimum(x, y) >= 0) & (name[np.maximum(x, 0)] == name[np.maximum(y, 0)])
            live = live[same]
            if not len(live):
                break
            top.append(live)
        for k in range(len(top) - 1, -1, -1):  # downwards from the longest that agree
            own, name = top[k], self.names[k]
            x, y = a[own] + step * out[own], b[own] + step * out[own]
            if step < 0:
                x, y = x - (1 << k), y - (1 << k)
                same = (np.minimum(x, y) >= 0) & (name[np.maximum(x, 0)] == name[np.maximum(y, 0)])
            else:
                same = name[x] == name[y]
            out[own[same]] += 1 << k
        return out

    def neighbours(self) -> np.ndarray:
        """lcp[k]: how many letters the suffixes at places k - 1 and k of the order share."""
        lcp = np.zeros(self.n, np.int64)
        places = np.sort(self.rank[self.shared])
        places = places[places > 0]
        a, b = self.order[places - 1], self.order[places]
        same = self.names[0][a] == self.names[0][b]
        lcp[places[same]] = self.forward(a[same], b[same])
        return lcp

    def previous_factors(self, lcp: np.ndarray) -> np.ndarray:
        """longest[i]: the most letters from i on that also begin at a smaller place."""
        longest = np.zeros(self.n, np.int64)
        order = self.order
        for side in (-1, 1):
            # the nearest smaller place in suffix order on this side, by jumping over larger ones; least: the shared letters on the way
            to = np.clip(np.arange(self.n) + side, 0, self.n - 1)
            least = lcp.copy() if side < 0 else np.append(lcp[1:], 0)
            live = np.flatnonzero(least > 0)
            live = live[order[to[live]] > order[live]]
            while len(live):
                at = to[live]
                shorter = np.minimum(least[live], least[at])
                further = to[at]
                least[live], to[live] = shorter, further
                live = live[shorter > 0]
                live = live[order[to[live]] > order[live]]
            longest[order] = np.maximum(longest[order], least)
        return longest

    def interval(self, lcp: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffix order [lo, hi) whose suffixes share length letters with the one at `at`: the node of the suffix tree at or below that stretch."""
        table = [lcp]
        while 2 << (len(table) - 1) <= self.n:
            last, w = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[: len(last) - w], last[w:]))  # table[k][i]: least of lcp[i : i + 2^k]
        lo, hi = self.rank[at].astype(np.int64), self.rank[at].astype(np.int64) + 1
        for k in range(len(table) - 1, -1, -1):
            w, row = 1 << k, table[k]
            begin = lo - w + 1
            lo = np.where((begin >= 1) & (row[np.clip(begin, 0, len(row) - 1)] >= length), lo - w, lo)
            hi = np.where((hi + w <= self.n) & (row[np.clip(hi, 0, len(row) - 1)] >= length), hi + w, hi)
        return lo, hi


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the values begin..begin+size-1 of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]


def lz_blocks(longest: np.ndarray) -> np.ndarray:
    """The first places of the Lempel-Ziv blocks."""
    steps, out, i = np.maximum(longest, 1).tolist(), [], 0
    while i < len(steps):
        out.append(i)
        i += steps[i]
    return np.array(out, np.int64)


def covering_squares(index: SuffixIndex, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the leftmost occurrence of each; about the right end of every block, then about its left end."""
    n, name = index.n, index.names[0]
    ends = np.append(blocks[1:], n)
    after = np.append(ends[1:], n)
    starts, periods = [], []
    for border, most in ((ends, ends - blocks), (blocks, after - blocks)):
        owner, k = spread(np.ones(len(border), np.int64), most)
        at = border[owner]
        other = at - k if border is ends else at + k
        fits = (at < n) & (other >= 0) & (other < n)
        at, other, k = at[fits], other[fits], k[fits]
        same = name[at] == name[other]
        at, other, k = at[same], other[same], k[same]
        ahead, back = index.forward(at, other), index.backward(at, other)
        square = ahead + back >= k
        at, other, k, back = at[square], other[square], k[square], back[square]
        first = np.minimum(at, other)
        starts.append(np.maximum(first - back, first - k + 1))
        periods.append(k)
    return np.concatenate(starts), np.concatenate(periods)


def primitive(index: SuffixIndex, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the first half of each square is no repetition of something shorter: no quotient of the period by a prime is a period."""
    yes, rest = np.ones(len(start), bool), period.copy()
    prime = 2
    top = int(period.max(initial=1))
    while prime * prime <= top:
        own = np.flatnonzero(rest % prime == 0)
        if len(own):
            yes[own] &= ~_repeats(index, start[own], period[own], period[own] // prime)
            while len(own):
                rest[own] //= prime
                own = own[rest[own] % prime == 0]
            top = int(rest.max(initial=1))
        prime += 1
    own = np.flatnonzero(rest > 1)
    yes[own] &= ~_repeats(index, start[own], period[own], period[own] // rest[own])
    return yes


def _repeats(index: SuffixIndex, start: np.ndarray, period: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    return index.forward(start, start + shorter) >= period - shorter


def all_runs(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least two periods, by start and period. letters: the first and last occur once, as does each document's end mark."""
    index = SuffixIndex(letters)
    none = np.empty(0, np.int64)
    if not len(index.shared):
        return none, none, none
    lcp = index.neighbours()
    start, period = covering_squares(index, lz_blocks(index.previous_factors(lcp)))
    if not len(start):
        return none, none, none
    start, period = np.unique(np.stack((start, period)), axis=1)
    keep = primitive(index, start, period)
    start, period = start[keep], period[keep]
    # squares of one run share its walk: it begins at the leftmost
    end = start + period + index.forward(start, start + period)
    run, first = np.unique(np.stack((end, period)), axis=1, return_index=True)
    start, (end, period) = start[first], run
    # suffix links: from the square at i to that at i + 1, of which a period's number differ
    owner, at = spread(start, np.minimum(period, end - start - 2 * period + 1))
    period = period[owner]
    lo, hi = index.interval(lcp, at, 2 * period)
    _, first = np.unique(period * (index.n + 1) + lo, return_index=True)
    lo, hi, period = lo[first], hi[first], period[first]
    # the leaves below each node
    owner, place = spread(lo, hi - lo)
    key = np.sort(period[owner] * (index.n + 1) + index.order[place])
    new = np.flatnonzero(np.concatenate(([True], np.diff(key) != 1)))
    number = np.diff(np.append(new, len(key)))
    period, start = np.divmod(key[new], index.n + 1)
    length = number - 1 + 2 * period
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def batch_runs(docs: list[list[bytes]], min_length: int, min_exponent: int) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each document, by start, then period."""
    sizes = np.array([len(d) + 1 for d in docs])
    begins = 1 + np.cumsum(sizes) - sizes
    letters, used = [0], 1
    for words in docs:
        name = defaultdict(count(used).__next__)
        letters += map(name.__getitem__, words)
        used += len(name)
        letters.append(used)
        used += 1
    start, length, period = all_runs(np.array(letters, np.int64))
    long_ = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = start[long_], length[long_], period[long_]
    cuts = np.searchsorted(start, np.append(begins, begins[-1] + sizes[-1]))
    return [np.stack((start[a:b] - at, length[a:b], period[a:b]), axis=1) for a, b, at in zip(cuts, cuts[1:], begins)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with runs (start and length in words, smallest period), by start, then period, and collapsed, the text with one period of each run."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        words = [space_words(t) for t in text_bytes(batch, "text")]
        found, a = [], 0
        while a < len(words):
            b, held = a + 1, len(words[a])
            while b < len(words) and held + len(words[b]) <= PIECE:
                held, b = held + len(words[b]), b + 1
            found += batch_runs(words[a:b], min_length, min_exponent)
            a = b
        rows = np.concatenate([*found, np.empty((0, 3), np.int64)])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
        return {"runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), "collapsed": pa.array([collapse(w, r) for w, r in zip(words, found)], pa.string())}

    return add_columns(docs, ["text"], run, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeat_ends(docs: DataFrame) -> DataFrame:
    """docs with the end of the text of one document in ten, chosen by its doc_id, made periodic; a null doc_id or text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.split(F.btrim("text", F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    # the words are bound by a lambda's variable, so that they are split once
    g, n = F.floor(h / 10), lambda w: F.size(w).cast("long")
    a = lambda w: g % n(w)
    p = lambda w: 1 + F.floor((n(w) - a(w)) / (3 + g % 8))
    block = lambda w: F.slice(w, (a(w) + 1).cast("int"), p(w).cast("int"))
    end = lambda w: F.slice(F.flatten(F.array_repeat(block(w), (3 + g % 8).cast("int"))), F.lit(1), (n(w) - a(w)).cast("int"))
    changed = F.transform(F.array(words), lambda w: F.array_join(F.concat(F.slice(w, F.lit(1), a(w).cast("int")), end(w)), " "))[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.btrim("text", F.lit(_SPACE)) != ""), changed).otherwise(F.col("text")))


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (ties: the first), digests of all runs and of the collapsed text."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
