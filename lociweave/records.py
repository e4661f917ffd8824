"""Checked records of what tables have a row of, and of parameters that stay fixed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields

import numpy as np

from lociweave.functions.pwm import GrammarProfile, consensus, information_bits, log_odds, tempered

__all__ = ["GrammarProfile"]


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class FromMapping:
    """A record that can be made of a mapping with its field names; others are an error."""

    @classmethod
    def of(cls, mapping: Mapping):
        known = {f.name for f in fields(cls)}
        _need(set(mapping) <= known, f"{cls.__name__} has no {', '.join(sorted(set(mapping) - known))}")
        return cls(**mapping)


@dataclass(frozen=True)
class FileRecord(FromMapping):
    path: str
    size_bytes: int
    sha256: str

    def __post_init__(self) -> None:
        _need(self.size_bytes >= 0 and len(self.sha256) == 64, "a file has a size and a SHA-256")


@dataclass(frozen=True)
class PairCounts(FromMapping):
    rows: int
    positives: int
    unique_tfs: int
    directed_asymmetries: int


@dataclass(frozen=True)
class Run(FromMapping):
    tf: str
    run: str
    experiment: str
    cycle: str | None = None
    peak_file: str | None = None


@dataclass(frozen=True)
class RunFile(FromMapping):
    url: str
    md5: str
    size: int


@dataclass(frozen=True)
class Experiment(FromMapping):
    experiment: str
    tf: str
    batch: str
    approved: bool


@dataclass(frozen=True)
class NestedFit:
    """Out-of-fold predictions, a DataFrame, and the summary of the fits."""

    predictions: object
    summary: dict


@dataclass(frozen=True)
class LoopCounts(FromMapping):
    loops: int
    promoters: int
    direct_links: int
    distal_links: int


@dataclass(frozen=True)
class Matrix:
    """A named matrix of positions by A, C, G and T; rows are normalised without a pseudocount."""

    name: str
    probabilities: np.ndarray
    accession: str = ""
    source: str = ""
    url: str = ""

    def __post_init__(self) -> None:
        m = np.asarray(self.probabilities, float)
        _need(m.ndim == 2 and m.shape[1:] == (4,) and len(m) > 0, "a matrix has rows of four numbers")
        _need(bool(np.isfinite(m).all() and (m >= 0).all() and (m.sum(1) > 0).all()), "numbers must be finite, not negative, and not all zero in a row")
        object.__setattr__(self, "probabilities", m / m.sum(1, keepdims=True))

    def __len__(self) -> int:
        return len(self.probabilities)

    @property
    def consensus(self) -> str:
        return consensus(self.probabilities)

    @property
    def bits(self) -> float:
        return information_bits(self.probabilities)

    def log_odds(self, background: float = 0.25) -> np.ndarray:
        return log_odds(np.clip(self.probabilities, 1e-8, 1), background)

    def sample(self, rng: np.random.Generator, temperature: float = 1.0) -> str:
        return "".join("ACGT"[rng.choice(4, p=row)] for row in tempered(self.probabilities, temperature))


class MatrixRegistry:
    """Matrices by key."""

    def __init__(self, matrices: Mapping[str, Matrix]) -> None:
        self.matrices = dict(matrices)

    def get(self, key: str) -> Matrix:
        if key not in self.matrices:
            raise KeyError(f"there is no motif {key}; there are {', '.join(sorted(self.matrices))}")
        return self.matrices[key]


@dataclass(frozen=True)
class Monomer:
    source_id: str
    symbol: str
    matrix: Matrix


def monomers_by_id(monomers: Iterable[Monomer]) -> dict[str, Monomer]:
    """Monomers by their source's id, of which each may have one."""
    monomers = tuple(monomers)
    found = {m.source_id: m for m in monomers}
    _need(len(found) == len(monomers), "ids of monomers must be unique")
    return found


@dataclass(frozen=True)
class Interaction(FromMapping):
    raw_bait: str
    raw_prey: str
    bait: str
    prey: str
    raw_value: str
    tested: bool
    composite_motif: bool
    spacing_or_orientation: bool
    specificity: tuple[str, ...] = ()

    @property
    def positive(self) -> bool:
        return self.composite_motif or self.spacing_or_orientation

    @property
    def raw_pair(self) -> str:
        return f"{self.raw_bait}_{self.raw_prey}"

    @property
    def pair(self) -> str:
        return "_".join(sorted((self.bait, self.prey)))


@dataclass(frozen=True)
class PairModel:
    """A pair's count matrix with its selection's particulars; model_id joins them."""

    raw_pair: str
    pair: str
    ligand_sequence: str
    batch: str
    seed: str
    multinomial: int
    cycle: str
    counts: np.ndarray
    interaction_type: str | None = None
    representative: bool | None = None
    source_row: int = 0

    @property
    def members(self) -> tuple[str, ...]:
        return tuple(self.pair.split("_"))

    @property
    def model_id(self) -> str:
        return "|".join(map(str, (self.pair, self.ligand_sequence, self.batch, self.seed, self.multinomial, self.cycle)))

    def matrix(self) -> Matrix:
        return Matrix(self.model_id, np.asarray(self.counts, float) + 1e-6)


@dataclass(frozen=True)
class Spacing:
    raw_pair: str
    pair: str
    barcode: str
    batch: str
    analysis_type: str
    left_kmer: str
    right_kmer: str
    gap_counts: tuple[int, ...]
    source_row: int = 0

    def __post_init__(self) -> None:
        _need(len(self.gap_counts) == 29 and min(self.gap_counts) >= 0, "there are counts of 29 gaps, not negative")

    @property
    def members(self) -> tuple[str, ...]:
        return tuple(self.pair.split("_"))


@dataclass(frozen=True)
class PairProfile:
    """One mechanism of a pair: its models, its partner's monomers and where these come from."""

    pair: str
    partner: str
    mechanism: str
    models: tuple[PairModel, ...]
    monomers: tuple[Monomer, ...]
    source: str

    @property
    def feature_id(self) -> str:
        return f"{self.pair}::{self.mechanism}"


@dataclass(frozen=True)
class Panel:
    focal_tf: str
    focal: Monomer
    profiles: tuple[PairProfile, ...]
    excluded_pairs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = [p.feature_id for p in self.profiles]
        _need(len(set(names)) == len(names), "profiles must be unique")
        _need(not {p.pair for p in self.profiles} & set(self.excluded_pairs), "an excluded pair has no profile")


@dataclass(frozen=True)
class PeriodicRule:
    """Gaps are positive by their phase; phases are taken modulo the period, and there must be some that are and some that aren't."""

    period: int = 10
    phases: tuple[int, ...] = (0, 1, 9)

    def __post_init__(self) -> None:
        _need(self.period >= 2, "a period has two phases at least")
        object.__setattr__(self, "phases", tuple(sorted({int(p) % self.period for p in self.phases})))
        _need(0 < len(self.phases) < self.period, "the rule must allow some phases and forbid some")

    def positive(self, gap: int) -> bool:
        return gap % self.period in self.phases


@dataclass(frozen=True)
class Condition(FromMapping):
    """How pairs are generated: the range of gaps, the background's GC share and persistence, turned motifs, and the temperature of motifs."""

    gap_min: int = 0
    gap_max: int = 60
    background_gc: float = 0.5
    background_persistence: float = 0.15
    allow_reverse: bool = False
    motif_temperature: float = 1.0

    def __post_init__(self) -> None:
        for ok, message in (
            (0 <= self.gap_min <= self.gap_max, "gaps aren't negative and in order"), (0 < self.background_gc < 1, "the GC share lies between 0 and 1"),
            (0 <= self.background_persistence < 1, "persistence lies from 0 to below 1"), (self.motif_temperature > 0, "the temperature is above 0"),
        ):
            _need(ok, message)


@dataclass(frozen=True)
class ExperimentPlan(FromMapping):
    """What an experiment runs: seeds by models, trained in one condition and evaluated in several."""

    seeds: tuple[int, ...] = (17,)
    sequence_length: int = 256
    train_pairs: int = 200
    validation_pairs: int = 100
    test_pairs: int = 100
    anchor_min: int = 0
    anchor_max: int | None = None
    period: int = 10
    phases: tuple[int, ...] = (0, 1, 9)
    train: Condition = field(default_factory=Condition)
    evaluations: Mapping[str, Condition] = field(default_factory=lambda: {"iid": Condition()})
    models: Mapping[str, dict] = field(default_factory=lambda: {"local_cnn": {}})
    training: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.train, Mapping):
            object.__setattr__(self, "train", Condition.of(self.train))
        object.__setattr__(self, "evaluations", {k: v if isinstance(v, Condition) else Condition.of(v) for k, v in self.evaluations.items()})
        PeriodicRule(self.period, tuple(self.phases))
        _need(bool(self.seeds) and bool(self.models) and bool(self.evaluations), "an experiment needs seeds, models and evaluations")
        _need(min(self.train_pairs, self.validation_pairs, self.test_pairs) > 0, "every set needs pairs")

