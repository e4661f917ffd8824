"""Operator 4, benchmark decontamination.

The windows of all benchmark items form one Aho-Corasick automaton over normalised text: the words joined by single
spaces, with a space at either end. Each document's normalised text is scanned once; matches are mapped back to character
offsets of the original. A benchmark whose windows exceed MOST_CHARS is dealt over several automata that are used one
after the other, so that no more than one of bounded size is broadcast at a time.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; items with
equal windows are each counted; repeated rows are each scanned; empty tables give no hits; extra columns are kept, but
for those named as an output, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import add_columns, alnum_words, bounded_batches, materialise, text_bytes, unused

WINDOW = 10
#: Characters of windows in one automaton.
MOST_CHARS = 8_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_built: dict = {}


def item_windows(text: str | None, window: int = WINDOW) -> set[str]:
    words = [w.decode() for w in alnum_words((text or "").encode())]
    if not words:
        return set()
    return {" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _automaton(shared, key: str):
    """A worker keeps the automaton that it built last."""
    if key not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for window, items in shared.value:
            automaton.add_word(f" {window} ", (window.count(" ") + 1, items))
        if len(automaton):
            automaton.make_automaton()
        _built[key] = automaton
    return _built[key]


def _spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges, merged, as character ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _pieces(benchmark: DataFrame, window: int, most_chars: int) -> Iterator[list[tuple[str, tuple[str, ...]]]]:
    """The windows with their items, each piece of bounded size, one piece on the driver at a time."""
    size = benchmark.select(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size * window // most_chars))
    for k in range(n):
        own: dict[str, set[str]] = {}
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
        for row in part.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
            for w in item_windows(row.text, window):
                own.setdefault(w, set()).add(row.i if row.i is not None else "")
        yield [(w, tuple(sorted(i))) for w, i in own.items()]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_chars: int = MOST_CHARS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans, character ranges [start, end)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own_words, own_items = unused(docs, "words", "items")
    added = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,end:long>>, {own_words} array<struct<start:long,end:long>>, {own_items} array<string>"
    out, pieces = docs, _pieces(benchmark, window, most_chars)
    first = next(pieces)
    more = next(pieces, None)
    k = 0
    while first is not None:
        shared, key = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def scan(batch: pa.RecordBatch, shared=shared, key=key, again=k > 0) -> dict:
            automaton = _automaton(shared, key)
            cols = {x: [] for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", own_words, own_items)}
            before = zip(batch.column(own_words).to_pylist(), batch.column(own_items).to_pylist()) if again else ((None, None) for _ in range(batch.num_rows))
            for raw, (ranges, items) in zip(text_bytes(batch, "text"), before):
                words = alnum_words(raw)
                ranges = [(x["start"], x["end"]) for x in ranges or ()]
                items = set(items or ())
                if words and len(automaton):
                    flat = " " + b" ".join(words).decode() + " "
                    last, seen = 0, 0
                    for end, (n, own) in automaton.iter(flat):
                        seen += flat.count(" ", last, end + 1)
                        last = end + 1
                        ranges.append((seen - 1 - n, seen - 1))
                        items.update(own)
                ranges = _merge(ranges)
                names = sorted(items)
                for name, value in (
                    ("n_words", len(words)), ("n_hit", sum(b - a for a, b in ranges)), ("n_items", len(names)),
                    ("items_sha256", hashlib.sha256(",".join(names).encode()).hexdigest()), ("contaminated", bool(ranges)),
                    ("hit_spans", [{"start": a, "end": b} for a, b in _spans(raw.decode(), ranges)] if ranges else []),
                    (own_words, [{"start": a, "end": b} for a, b in ranges]), (own_items, names),
                ):
                    cols[name].append(value)
            return cols

        out = add_columns(out, ["text"], scan, added)
        if more is not None:
            out = materialise(out)
        first, more, k = more, next(pieces, None) if more is not None else None, k + 1
    return out.drop(own_words, own_items)
