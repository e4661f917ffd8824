"""Position weight matrices: algebra on the driver, scans as expressions or as Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
PSEUDOCOUNT = 1e-6
#: The strands of a focal motif and of its partner.
ORIENTATIONS = ("FF", "FR", "RF", "RR")
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def probabilities(counts: Sequence[Sequence[float]], pseudocount: float = PSEUDOCOUNT) -> np.ndarray:
    """Rows that sum to one; raises for a wrong shape, or negative or empty rows."""
    m = np.asarray(counts, np.float64)
    if m.ndim != 2 or m.shape[1] != 4 or not len(m):
        raise ValueError("a matrix has rows of four counts")
    if not np.isfinite(m).all() or (m < 0).any() or (m.sum(1) + 4 * pseudocount <= 0).any():
        raise ValueError("counts must be finite, not negative, and not all zero in a row")
    m = m + pseudocount
    return m / m.sum(1, keepdims=True)


def log_odds(p: np.ndarray, background: float = 0.25) -> np.ndarray:
    return np.log2(p / background)


def information_bits(p: np.ndarray) -> float:
    return float((2 + (p * np.log2(np.clip(p, 1e-300, None))).sum(1)).sum())


def consensus(p: np.ndarray) -> str:
    return "".join(BASES[i] for i in np.argmax(p, axis=1))


def reverse_complement(p: np.ndarray) -> np.ndarray:
    return p[::-1, ::-1]


def tempered(p: np.ndarray, temperature: float) -> np.ndarray:
    q = np.clip(p, 1e-8, 1) ** (1 / temperature)
    return q / q.sum(1, keepdims=True)


def encode(sequence: str) -> np.ndarray:
    """A, C, G, T as 0 to 3, anything else 4."""
    return _CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def score_offsets(sequence: str, odds: np.ndarray) -> np.ndarray:
    """The score at each offset; -inf where the window has another letter."""
    return panel_offsets(encode(sequence), np.asarray(odds)[None])[0]


def maximum_score(sequence: str | None, odds: np.ndarray) -> float:
    """The best offset of both strands, -inf if there is none."""
    return float(maximum_scores([sequence], [odds])[0, 0])


def spaced_score(sequence: str | None, focal: np.ndarray, partner: np.ndarray, gaps: Sequence[int], orientations: Sequence[str] = ORIENTATIONS) -> float:
    return float(spaced_scores([sequence], focal, partner, gaps, orientations)[0])


def joined_letters(sequences: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all sequences as bytes in one array, and where each begins and how long it is; of an Arrow array of ASCII without a copy."""
    if isinstance(sequences, pa.Array):
        sequences = sequences.fill_null("") if sequences.null_count else sequences
        _, offsets, data = sequences.buffers()
        kind = np.int64 if pa.types.is_large_string(sequences.type) else np.int32
        ends = np.frombuffer(offsets, kind, len(sequences) + 1, sequences.offset * kind().itemsize).astype(np.int64) if offsets else np.zeros(1, np.int64)
        letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        starts, lengths = ends[:-1] - ends[0], np.diff(ends)
        if len(letters) and letters.max() > 127:
            # one byte for each letter: the first of those that UTF-8 has for it
            first = (letters & 0xC0) != 0x80
            some = np.flatnonzero(lengths)
            lengths[some] = np.add.reduceat(first, starts[some], dtype=np.int64)
            letters, starts = letters[first], np.cumsum(lengths) - lengths
        return letters, starts, lengths
    parts = [(x or "").encode("ascii", "replace") for x in sequences]
    lengths = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def panel_offsets(codes: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Scores (motif, offset) of motifs (motif, place, base) of one length at every offset; -inf where the window has another letter."""
    m, n, _ = odds.shape
    if len(codes) < n:
        return np.empty((m, 0))
    table = np.concatenate([odds, np.full((m, n, 1), -np.inf)], axis=2)
    out = table[:, 0, codes[: len(codes) - n + 1]]
    for j in range(1, n):
        out = out + table[:, j, codes[j : len(codes) - n + 1 + j]]
    return out


def _best_by_sequence(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(motif, sequence): the best offset of each sequence, whose windows begin in [start, end)."""
    best = np.full((len(scores), len(starts)), -np.inf)
    some = np.flatnonzero(ends > starts)
    if len(some) and scores.shape[1]:
        padded = np.concatenate([scores, np.full((len(scores), 1), -np.inf)], axis=1)
        last = scores.shape[1]
        at = np.minimum(np.stack([starts[some], ends[some]], axis=1), last).ravel()
        best[:, some] = np.where(at[::2] < at[1::2], np.maximum.reduceat(padded, at, axis=1)[:, ::2], -np.inf)
    return best


#: Scores worked out at a time, some 8 MB; no more letters than that are coded at once, however large a batch is.
_PART = 1 << 20


def _pieces(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, motifs: int, reach: int):
    """Pieces of the joined letters with the reach of a window behind each: (from where, up to how many letters, codes, slice of the sequences that have letters there)."""
    step = max(reach, _PART // motifs)
    for at in range(0, len(letters), step):
        own = slice(int(np.searchsorted(starts + lengths, at, "right")), int(np.searchsorted(starts, at + step)))
        yield at, step, _CODE[letters[at : at + step + reach - 1]], own


def maximum_scores(sequences: Sequence[str | None] | pa.Array, matrices: Sequence[np.ndarray]) -> np.ndarray:
    """(sequence, motif): the best offset of both strands, -inf if there is none. Motifs of equal length are scored together, all sequences in one pass."""
    letters, starts, lengths = joined_letters(sequences)
    out = np.full((len(sequences), len(matrices)), -np.inf)
    for n in sorted({len(m) for m in matrices}):
        group = [k for k, m in enumerate(matrices) if len(m) == n]
        odds = np.stack([o for k in group for o in (matrices[k], matrices[k][::-1, ::-1])])
        for at, step, codes, own in _pieces(letters, starts, lengths, len(odds), n):
            # a window within one sequence: it ends before the sequence does
            lo = np.clip(starts[own] - at, 0, step)
            hi = np.clip(starts[own] + np.maximum(lengths[own] - n + 1, 0) - at, 0, step)
            best = _best_by_sequence(panel_offsets(codes, odds), lo, hi)
            out[own, group] = np.maximum(out[own, group], np.maximum(best[::2], best[1::2]).T)
    return out


def _rows(scores: np.ndarray) -> pa.Array:
    """A list of scores for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))


def scan_column(sequence: Column, matrices: dict[str, np.ndarray]) -> Column:
    """map<name, best score> by an Arrow UDF, for panels of any number of motifs: each batch is scored as arrays."""
    names, odds = list(matrices), [log_odds(p) for p in matrices.values()]

    @F.arrow_udf("array<double>")
    def scan(s: pa.Array) -> pa.Array:
        return _rows(maximum_scores(s, odds))

    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), scan(sequence))


def best_column(sequence: Column, matrix: np.ndarray) -> Column:
    """The best score of one motif."""
    odds = [log_odds(matrix)]

    @F.arrow_udf("double")
    def scan(s: pa.Array) -> pa.Array:
        return pa.array(maximum_scores(s, odds)[:, 0])

    return scan(sequence)


def spaced_scores(sequences: Sequence[str | None] | pa.Array, focal: np.ndarray, partner: np.ndarray, gaps: Sequence[int], orientations: Sequence[str] = ORIENTATIONS) -> np.ndarray:
    """The best focal score plus the partner's behind it, over orientations and gaps, for each sequence."""
    letters, starts, lengths = joined_letters(sequences)
    turn = {"F": lambda m: m, "R": lambda m: m[::-1, ::-1]}
    out = np.full(len(sequences), -np.inf)
    reach = len(focal) + max(gaps, default=0) + len(partner)
    for at, step, part, own in _pieces(letters, starts, lengths, 4, reach):
        scores = {(k, x): panel_offsets(part, turn[x](m)[None])[0] for k, m in enumerate((focal, partner)) for x in "FR"}
        for o in orientations:
            a, b = scores[0, o[0]], scores[1, o[1]]
            for g in gaps:
                n = min(len(a), len(b) - len(focal) - g)
                if n > 0:
                    # a pair within one sequence: its windows end before the sequence does
                    last = starts[own] + np.maximum(lengths[own] - len(focal) - g - len(partner) + 1, 0)
                    lo, hi = np.clip(starts[own] - at, 0, step), np.clip(last - at, 0, step)
                    out[own] = np.maximum(out[own], _best_by_sequence((a[:n] + b[len(focal) + g : len(focal) + g + n])[None], lo, hi)[0])
    return out


class GrammarProfile:
    """A pair of motifs with the gaps at which they act, not negative and each once, and the orientations."""

    def __init__(self, name: str, focal: np.ndarray, partner: np.ndarray, gaps: Sequence[int], orientations: Sequence[str] = ORIENTATIONS) -> None:
        if not name or not len(gaps) or any(int(g) != g or g < 0 for g in gaps) or len(set(gaps)) != len(gaps):
            raise ValueError("a profile needs a name and gaps that aren't negative, each once")
        if not orientations or set(orientations) - set(ORIENTATIONS):
            raise ValueError("orientations are FF, FR, RF and RR")
        self.name, self.focal, self.partner, self.gaps, self.orientations = name, np.asarray(focal), np.asarray(partner), tuple(gaps), tuple(orientations)


def profile_lookup(profiles: Sequence[GrammarProfile]) -> dict[str, GrammarProfile]:
    """Profiles by name; a repeated name is an error."""
    out = {p.name: p for p in profiles}
    if len(out) != len(profiles):
        raise ValueError("profiles need names of their own")
    return out


def grammar_matrix(sequence: Column, profiles: Sequence[GrammarProfile]) -> Column:
    """map<profile, score> for all profiles in one Arrow UDF."""
    own = [(log_odds(p.focal), log_odds(p.partner), p.gaps, p.orientations) for p in profile_lookup(profiles).values()]
    names = [p.name for p in profiles]

    @F.arrow_udf("array<double>")
    def scan(s: pa.Array) -> pa.Array:
        return _rows(np.stack([spaced_scores(s, *p) for p in own], axis=1))

    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), scan(sequence))


def spaced_column(sequence: Column, focal: np.ndarray, partner: np.ndarray, gaps: Sequence[int], orientations: Sequence[str] = ORIENTATIONS) -> Column:
    a, b, gaps = log_odds(focal), log_odds(partner), list(gaps)

    @F.arrow_udf("double")
    def scan(s: pa.Array) -> pa.Array:
        return pa.array(spaced_scores(s, a, b, gaps, orientations))

    return scan(sequence)


def relational_scores(df: DataFrame, key: str, sequence: str, p: np.ndarray, out: str = "score") -> DataFrame:
    """(key, score): the best offset of both strands without Python, for single short motifs; key must be unique.

    Offsets are exploded and scored in generated code; rows of a sequence are reduced before they are shuffled.
    """
    odds = log_odds(p)
    n, up = len(odds), F.upper(F.col(sequence))
    spread = df.select(key, up.alias("__s"), F.explode_outer(F.when(F.length(up) >= n, F.sequence(F.lit(1), F.length(up) - n + 1))).alias("__i"))

    def strand(m: np.ndarray) -> Column:
        total = F.lit(0.0)
        for j, row in enumerate(m):
            letter = F.instr(F.lit(BASES), F.substr("__s", F.col("__i") + j, F.lit(1)))
            total = total + F.element_at(F.array(*[F.lit(float(v)) for v in (-np.inf, *row)]), letter + 1)
        return total

    best = F.max(F.when(F.col("__i").isNotNull(), F.greatest(strand(odds), strand(odds[::-1, ::-1]))))
    return spread.groupBy(key).agg(F.coalesce(best, F.lit(float("-inf"))).alias(out))


def presence_scores(docs: DataFrame, sequence: str, a: np.ndarray, b: np.ndarray, gc: float = 0.5) -> DataFrame:
    """docs with score: the lesser of two motifs' best natural log odds against the background of a GC share."""
    background = np.array([(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2])
    odds = [np.log(np.clip(m, 1e-8, 1) / background) for m in (a, b)]

    @F.arrow_udf("double")
    def scan(s: pa.Array) -> pa.Array:
        return pa.array(maximum_scores(s, odds).min(1))

    return docs.withColumn("score", scan(sequence))


def kmer_columns(protein: Column, k: int = 2, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """map<k-mer, share>; letters outside the alphabet go before windows are formed."""
    def shares(mers: Column) -> Column:
        names = F.array_distinct(mers)
        first = F.transform(names, lambda m: F.array_position(mers, m))
        return F.transform(F.array(F.struct(names.alias("names"), first.alias("first"))), lambda x: F.map_from_entries(
            F.transform(x.names, lambda m, i: F.struct(m, (F.coalesce(F.get(x["first"], i + 1), F.size(mers) + F.lit(1)) - F.get(x["first"], i)) / F.size(mers)))
        ))[0]

    def windows(s: Column) -> Column:
        n = F.length(s) - (k - 1)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    # the letters, and the windows in order, are bound to lambdas' variables, so that each is worked out once; equal windows stand together
    clean = F.regexp_replace(F.upper(protein), f"[^{alphabet}]", "")
    sorted_ = F.transform(F.array(clean), lambda s: F.sort_array(windows(s)))
    return F.transform(sorted_, shares)[0]
