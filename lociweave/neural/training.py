"""Training with early stopping, prediction and attribution, and their use on DataFrames.

A network trains in one task; what runs in parallel is the grid of networks, conditions and seeds, a row each, and prediction over any number of sequences.
"""

from __future__ import annotations

import io
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.neural.autograd import Value, logistic_loss, sigmoid
from lociweave.neural.networks import Network, build
from lociweave.operators.synth import one_hot


@dataclass
class TrainingResult:
    network: Network
    best_validation_loss: float
    epochs_completed: int


def seed_everything(seed: int) -> np.random.Generator:
    """Seeds Python's and NumPy's own generators, and gives one for what takes a generator."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)


def resolve_device(requested: str = "auto") -> str:
    """Networks run on the CPU; auto and cpu are known."""
    if requested not in ("auto", "cpu"):
        raise ValueError(f"there is no device {requested}")
    return "cpu"


def batches(x: np.ndarray, y: np.ndarray, size: int, shuffle: bool, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = rng.permutation(len(x)) if shuffle else np.arange(len(x))
    for k in range(0, len(x), size):
        yield x[at[k : k + size]], y[at[k : k + size]]


def mean_loss(network: Network, x: np.ndarray, y: np.ndarray, size: int) -> float:
    """The mean of the batches' losses, whatever their sizes."""
    network.training = False
    losses = [float(logistic_loss(network(a), b).data) for a, b in batches(x, y, size, False, np.random.default_rng(0))]
    return float(np.mean(losses)) if losses else float("nan")


class Adam:
    """Steps by moments of the gradients, with weights that decay apart from them."""

    def __init__(self, network: Network, rate: float, decay: float, betas: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8) -> None:
        self.network, self.rate, self.decay, self.betas, self.epsilon, self.steps = network, rate, decay, betas, epsilon, 0
        self.first, self.second = ({k: np.zeros_like(v.data) for k, v in network.parameters.items()} for _ in range(2))

    def step(self) -> None:
        self.steps += 1
        (a, b), n = self.betas, self.steps
        for k, v in self.network.parameters.items():
            if v.grad is None:
                continue
            v.data = v.data * v.data.dtype.type(1 - self.rate * self.decay)
            self.first[k] = a * self.first[k] + (1 - a) * v.grad
            self.second[k] = b * self.second[k] + (1 - b) * v.grad * v.grad
            v.data = (v.data - self.rate * (self.first[k] / (1 - a**n)) / (np.sqrt(self.second[k] / (1 - b**n)) + self.epsilon)).astype(v.data.dtype)
            v.grad = None


def fit(network: Network, train: tuple[np.ndarray, np.ndarray], validation: tuple[np.ndarray, np.ndarray], epochs: int = 30, patience: int = 5, learning_rate: float = 1e-3, weight_decay: float = 1e-4, batch_size: int = 64, seed: int = 0) -> TrainingResult:
    """Trains until the validation loss hasn't fallen by 1e-7 for so many epochs; the network has its best parameters then."""
    rng, optimiser = np.random.default_rng(seed), Adam(network, learning_rate, weight_decay)
    best, kept, waited, done = float("inf"), network.state(), 0, 0
    for done in range(1, epochs + 1):
        network.training = True
        for x, y in batches(*train, batch_size, True, rng):
            logistic_loss(network(x), y).backward()
            optimiser.step()
        loss = mean_loss(network, *validation, batch_size)
        if loss < best - 1e-7:
            best, kept, waited = loss, network.state(), 0
        else:
            waited += 1
            if waited >= patience:
                break
    network.restore(kept)
    network.training = False
    return TrainingResult(network, best, done)


def probabilities(network: Network, x: np.ndarray, batch_size: int = 256) -> np.ndarray:
    network.training = False
    parts = [sigmoid(network(x[k : k + batch_size]).data) for k in range(0, len(x), batch_size)]
    return np.concatenate(parts) if parts else np.empty(0)


def attribution(network: Network, x: np.ndarray) -> np.ndarray:
    """(n, length): the absolute gradient times input at each place."""
    network.training = False
    given = Value(np.asarray(x, network.dtype), keep=True)
    network(given).mean().scale(len(x)).backward()
    for v in network.parameters.values():
        v.grad = None
    return np.abs(given.grad * given.data).sum(2)


def localisation(network: Network, x: np.ndarray, mask: np.ndarray, most: int = 256, batch_size: int = 64) -> dict[str, float]:
    """The share of attribution that lies inside the motifs: its mean and sample deviation over examples, and the share of places that the motifs cover."""
    x, mask = x[:most], mask[:most]
    inside = []
    for k in range(0, len(x), batch_size):
        a = attribution(network, x[k : k + batch_size])
        inside.append((a * mask[k : k + batch_size]).sum(1) / np.maximum(a.sum(1), 1e-12))
    shares = np.concatenate(inside) if inside else np.empty(0)
    if not len(shares):
        raise ValueError("there are no examples")
    return {"mass_mean": float(shares.mean()), "mass_std": float(shares.std(ddof=1)) if len(shares) > 1 else 0.0, "coverage": float(mask.mean())}


def saliency(network: Network, x: np.ndarray) -> np.ndarray:
    """(n, length): the largest absolute gradient at each place, as a share of the sequence's largest."""
    network.training = False
    given = Value(np.asarray(x, network.dtype), keep=True)
    network(given).mean().scale(len(x)).backward()
    for v in network.parameters.values():
        v.grad = None
    top = np.abs(given.grad).max(2)
    return top / np.maximum(top.max(1, keepdims=True), 1e-12)


def encode(sequences: list[str]) -> np.ndarray:
    return np.stack([one_hot(s) for s in sequences])


def dumps(network: Network) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **network.state())
    return out.getvalue()


def loads(content: bytes, name: str, length: int, settings: dict | None = None) -> Network:
    network = build(name, length, settings)
    with np.load(io.BytesIO(content)) as state:
        network.restore(dict(state))
    return network


def predicted(sequence: Column, network: Network) -> Column:
    """The probability of each sequence, in Arrow batches; sequences of a batch have one length."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(probabilities(network, encode(s.tolist())).astype(float), index=s.index)

    return score(sequence)


def train_grid(cells: DataFrame, data: dict[tuple[str, int], dict[str, pd.DataFrame]], settings: dict[str, dict], **options) -> DataFrame:
    """(condition, model, seed, best_validation_loss, epochs_completed, weights) for cells (condition, model, seed), each trained in a task of its own.

    data: for each condition and seed the train and validation sets (sequence, label), of a bounded size, which travel with the function.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for condition, model, seed in zip(frame["condition"], frame["model"], frame["seed"]):
                sets = data[condition, int(seed)]
                arrays = {k: (encode(d["sequence"].tolist()), d["label"].to_numpy(np.float32)) for k, d in sets.items()}
                network = build(model, arrays["train"][0].shape[1], settings.get(model), int(seed))
                out = fit(network, arrays["train"], arrays["validation"], seed=int(seed), **options)
                rows.append((condition, model, int(seed), out.best_validation_loss, out.epochs_completed, dumps(out.network)))
            yield pd.DataFrame(rows, columns=["condition", "model", "seed", "best_validation_loss", "epochs_completed", "weights"])

    n = max(1, cells.count())
    return cells.repartition(n).mapInPandas(run, "condition string, model string, seed long, best_validation_loss double, epochs_completed long, weights binary")
