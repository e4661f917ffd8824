"""Seeded counterfactual sequence pairs that differ in one gap only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.pwm import tempered

SCHEMA = "pair_id long, label int, gap int, phase int, start_a int, end_a int, start_b int, end_b int, orientation_a string, orientation_b string, motif_a_instance string, motif_b_instance string, background_sha256 string, sequence string"
_TURN = str.maketrans("ACGT", "TGCA")


def derive_seed(*parts: object) -> int:
    h = hashlib.sha256("::".join(map(str, parts)).encode()).digest()
    return int.from_bytes(h[:8], "little") % (1 << 32)


def seed_column(base: int, label: str, key: Column) -> Column:
    """derive_seed() of every row's key, in the JVM: the first four bytes of the digest, the first one lowest."""
    h = F.sha2(F.concat_ws("::", F.lit(str(base)), F.lit(label), key.cast("string")), 256)
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")


def background(rng: np.random.Generator, length: int, gc: float = 0.5, persistence: float = 0.0) -> str:
    """A base from the GC share, then the last one again with probability persistence, or a new draw."""
    p = [(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]
    draws = rng.choice(4, length, p=p)
    again = rng.random(length) < persistence
    for i in range(1, length):
        if again[i]:
            draws[i] = draws[i - 1]
    return "".join("ACGT"[d] for d in draws)


def sample_motif(rng: np.random.Generator, p: np.ndarray) -> str:
    return "".join("ACGT"[rng.choice(4, p=row)] for row in p)


def matched_pairs(spark: SparkSession, a: np.ndarray, b: np.ndarray, pairs: int, length: int = 160, gaps: tuple[int, int] = (0, 60), gc: float = 0.5, persistence: float = 0.0, reverse: bool = True, period: int = 10, phases: tuple[int, ...] = (0, 1, 9), seed: int = 0, temperature: float = 1.0, anchors: tuple[int, int] | None = None) -> DataFrame:
    """Two rows for each pair: equal background, motif instances, orientations and start, one gap of an allowed phase, one not.

    Every pair has a generator of its own, seeded by its number, so that any partitioning gives the same rows. Motifs are drawn from their matrices at a
    temperature; the first one begins within the anchors if they are given.
    """
    allowed = sorted({x % period for x in phases})
    if period < 2 or not allowed or len(allowed) == period:
        raise ValueError("the rule must allow some phases and forbid some")
    lo, hi = gaps
    good = [g for g in range(lo, hi + 1) if g % period in allowed]
    bad = [g for g in range(lo, hi + 1) if g % period not in allowed]
    if not good or not bad or len(a) + len(b) + hi > length:
        raise ValueError("the gap range has no pair of gaps, or the motifs don't fit")

    a, b = (m if temperature == 1 else tempered(np.asarray(m), temperature) for m in (a, b))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k in frame["id"]:
                rng = np.random.default_rng(derive_seed(seed, "pair", k))
                base = background(rng, length, gc, persistence)
                ma, mb = sample_motif(rng, a), sample_motif(rng, b)
                oa, ob = (("+", "-")[int(rng.integers(2))] if reverse else "+" for _ in range(2))
                ia, ib = (m if o == "+" else m[::-1].translate(_TURN) for m, o in ((ma, oa), (mb, ob)))
                pick = {1: int(rng.choice(good)), 0: int(rng.choice(bad))}
                last = length - len(ia) - len(ib) - max(pick.values())
                least, most = (0, last) if anchors is None else (min(anchors[0], last), min(anchors[1], last))
                start = int(rng.integers(least, most + 1))
                for label, gap in pick.items():
                    at = start + len(ia) + gap
                    seq = base[:start] + ia + base[start + len(ia) : at] + ib + base[at + len(ib) :]
                    rows.append((k, label, gap, gap % period, start, start + len(ia), at, at + len(ib), oa, ob, ia, ib, hashlib.sha256(base.encode()).hexdigest(), seq))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(pairs).mapInPandas(make, SCHEMA)


def validate_pairs(df: DataFrame) -> DataFrame:
    """(pair_id, valid): two rows, one of each label, and equal controlled fields."""
    fields = ("start_a", "orientation_a", "orientation_b", "motif_a_instance", "motif_b_instance", "background_sha256")
    ok = (F.count("*") == 2) & (F.sum("label") == 1)
    for f in fields:
        ok &= F.count_distinct(f) == 1
    return df.groupBy("pair_id").agg(ok.alias("valid"))


def one_hot(sequence: str) -> np.ndarray:
    """L x 4 in A, C, G, T order; another letter is an error."""
    at = np.array(["ACGT".find(c) for c in sequence])
    if (at < 0).any():
        raise ValueError("only A, C, G and T can be encoded")
    return np.eye(4, dtype=np.float32)[at]
