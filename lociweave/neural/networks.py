"""Classifiers of one-hot sequences (n, length, 4): a local and a dilated convolutional network, a transformer, and recurrent ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from lociweave.neural.autograd import Value, convolve, join


class Network:
    """Named parameters and running moments; a subclass builds the parameters and maps inputs to logits."""

    def __init__(self, seed: int = 0, dtype: type = np.float32) -> None:
        self.random, self.dtype = np.random.default_rng(seed), dtype
        self.parameters: dict[str, Value] = {}
        self.moments: dict[str, np.ndarray] = {}
        self.training = False

    def logits(self, x: Value) -> Value:
        raise NotImplementedError

    def __call__(self, x: np.ndarray | Value) -> Value:
        return self.logits(x if isinstance(x, Value) else Value(np.asarray(x, self.dtype)))

    # parameters

    def uniform(self, name: str, shape: Sequence[int], inputs: int) -> None:
        limit = 1 / np.sqrt(inputs)
        self.parameters[name] = Value(self.random.uniform(-limit, limit, shape).astype(self.dtype), keep=True)

    def constant(self, name: str, shape: Sequence[int], value: float) -> None:
        self.parameters[name] = Value(np.full(shape, value, self.dtype), keep=True)

    def small(self, name: str, shape: Sequence[int]) -> None:
        """Normal with deviation 0.02, cut at two deviations."""
        self.parameters[name] = Value((0.02 * np.clip(self.random.standard_normal(shape), -2, 2)).astype(self.dtype), keep=True)

    def state(self) -> dict[str, np.ndarray]:
        return {f"p:{k}": v.data.copy() for k, v in self.parameters.items()} | {f"m:{k}": v.copy() for k, v in self.moments.items()}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        for k in self.parameters:
            self.parameters[k].data = state[f"p:{k}"].copy()
        for k in self.moments:
            self.moments[k] = state[f"m:{k}"].copy()

    # layers

    def linear_of(self, name: str, inputs: int, outputs: int) -> None:
        self.uniform(f"{name}.w", (inputs, outputs), inputs)
        self.uniform(f"{name}.b", (outputs,), inputs)

    def linear(self, name: str, x: Value) -> Value:
        return x @ self.parameters[f"{name}.w"] + self.parameters[f"{name}.b"]

    def convolution_of(self, name: str, inputs: int, outputs: int, width: int) -> None:
        self.uniform(f"{name}.w", (outputs, inputs, width), inputs * width)
        self.uniform(f"{name}.b", (outputs, 1), inputs * width)

    def convolution(self, name: str, x: Value, dilation: int = 1) -> Value:
        return convolve(x, self.parameters[f"{name}.w"], dilation) + self.parameters[f"{name}.b"]

    def batch_norm_of(self, name: str, channels: int) -> None:
        self.constant(f"{name}.scale", (channels, 1), 1)
        self.constant(f"{name}.shift", (channels, 1), 0)
        self.moments |= {f"{name}.mean": np.zeros((channels, 1)), f"{name}.var": np.ones((channels, 1))}

    def batch_norm(self, name: str, x: Value, momentum: float = 0.1) -> Value:
        """Over a batch in training, by running moments else; x is (n, channels, length)."""
        mean, var = f"{name}.mean", f"{name}.var"
        if self.training:
            n = x.data.shape[0] * x.data.shape[2]
            self.moments[mean] = (1 - momentum) * self.moments[mean] + momentum * x.data.mean((0, 2), keepdims=True)[0]
            self.moments[var] = (1 - momentum) * self.moments[var] + momentum * x.data.var((0, 2), keepdims=True)[0] * n / max(1, n - 1)
            y = x.normalise((0, 2))
        else:
            inverse = 1 / np.sqrt(self.moments[var] + 1e-5)
            y = x * Value(inverse.astype(self.dtype)) + Value((-self.moments[mean] * inverse).astype(self.dtype))
        return y * self.parameters[f"{name}.scale"] + self.parameters[f"{name}.shift"]

    def layer_norm_of(self, name: str, n: int) -> None:
        self.constant(f"{name}.scale", (n,), 1)
        self.constant(f"{name}.shift", (n,), 0)

    def layer_norm(self, name: str, x: Value) -> Value:
        return x.normalise((x.data.ndim - 1,)) * self.parameters[f"{name}.scale"] + self.parameters[f"{name}.shift"]

    def dropout(self, x: Value, share: float) -> Value:
        if not self.training or not share:
            return x
        return x * Value((self.random.random(x.data.shape) >= share).astype(self.dtype) / self.dtype(1 - share))


def _odd(width: int) -> None:
    if width % 2 == 0:
        raise ValueError("the width of a convolution must be odd")


class LocalNetwork(Network):
    """One convolution, whose width bounds what it sees, and the largest answer of each channel."""

    def __init__(self, channels: int = 64, kernel_size: int = 19, **rest) -> None:
        super().__init__(**rest)
        _odd(kernel_size)
        self.convolution_of("stem", 4, channels, kernel_size)
        self.batch_norm_of("norm", channels)
        self.linear_of("out", channels, 1)

    def logits(self, x: Value) -> Value:
        hidden = self.batch_norm("norm", self.convolution("stem", x.transpose(0, 2, 1))).gelu()
        return self.linear("out", hidden.largest(2)).take((slice(None), 0))


class DilatedNetwork(Network):
    """A stem, residual blocks of growing dilation that together see the whole sequence, and the largest answer of each channel."""

    def __init__(self, channels: int = 64, kernel_size: int = 19, dilations: Sequence[int] = (1, 2, 4, 8, 16, 32), dropout: float = 0.1, **rest) -> None:
        super().__init__(**rest)
        _odd(kernel_size)
        self.dilations, self.share = tuple(int(d) for d in dilations), dropout
        self.convolution_of("stem", 4, channels, kernel_size)
        self.batch_norm_of("norm", channels)
        for k, _ in enumerate(self.dilations):
            self.convolution_of(f"wide{k}", channels, channels, 3)
            self.batch_norm_of(f"norm{k}", channels)
            self.convolution_of(f"point{k}", channels, channels, 1)
        self.linear_of("out", channels, 1)

    def block(self, k: int, x: Value) -> Value:
        inner = self.batch_norm(f"norm{k}", self.convolution(f"wide{k}", x, self.dilations[k])).gelu()
        return (x + self.convolution(f"point{k}", self.dropout(inner, self.share))).gelu()

    def logits(self, x: Value) -> Value:
        hidden = self.batch_norm("norm", self.convolution("stem", x.transpose(0, 2, 1))).gelu()
        for k in range(len(self.dilations)):
            hidden = self.block(k, hidden)
        return self.linear("out", self.dropout(hidden.largest(2), self.share)).take((slice(None), 0))


class TransformerNetwork(Network):
    """Attention over positions of one fixed length; the answer is read at a token of its own in front."""

    def __init__(self, sequence_length: int, embedding_dim: int = 64, attention_heads: int = 4, layers: int = 3, feedforward_dim: int = 128, dropout: float = 0.1, **rest) -> None:
        super().__init__(**rest)
        if embedding_dim % attention_heads:
            raise ValueError("the heads must divide the embedding")
        self.length, self.heads, self.layers, self.share = sequence_length, attention_heads, layers, dropout
        self.linear_of("embed", 4, embedding_dim)
        self.small("token", (1, 1, embedding_dim))
        self.small("position", (1, sequence_length + 1, embedding_dim))
        for k in range(layers):
            for name in ("before", "between"):
                self.layer_norm_of(f"{name}{k}", embedding_dim)
            for name, a, b in (("query", embedding_dim, embedding_dim), ("key", embedding_dim, embedding_dim), ("value", embedding_dim, embedding_dim), ("mix", embedding_dim, embedding_dim), ("up", embedding_dim, feedforward_dim), ("down", feedforward_dim, embedding_dim)):
                self.linear_of(f"{name}{k}", a, b)
        self.layer_norm_of("last", embedding_dim)
        self.linear_of("out", embedding_dim, 1)

    def attention(self, k: int, x: Value) -> Value:
        n, length, size = x.data.shape
        split = lambda name: self.linear(f"{name}{k}", x).reshape(n, length, self.heads, size // self.heads).transpose(0, 2, 1, 3)
        weights = (split("query") @ split("key").transpose(0, 1, 3, 2)).scale((size // self.heads) ** -0.5).softmax()
        mixed = (self.dropout(weights, self.share) @ split("value")).transpose(0, 2, 1, 3).reshape(n, length, size)
        return self.linear(f"mix{k}", mixed)

    def logits(self, x: Value) -> Value:
        n, length, _ = x.data.shape
        if length != self.length:
            raise ValueError(f"sequences must have {self.length} places, not {length}")
        embedded = self.linear("embed", x)
        token = self.parameters["token"] + Value(np.zeros((n, 1, embedded.data.shape[2]), self.dtype))
        hidden = join([token, embedded], 1) + self.parameters["position"]
        for k in range(self.layers):
            hidden = hidden + self.dropout(self.attention(k, self.layer_norm(f"before{k}", hidden)), self.share)
            wide = self.dropout(self.linear(f"up{k}", self.layer_norm(f"between{k}", hidden)).gelu(), self.share)
            hidden = hidden + self.dropout(self.linear(f"down{k}", wide), self.share)
        return self.linear("out", self.layer_norm("last", hidden.take((slice(None), 0)))).take((slice(None), 0))


class RecurrentNetwork(Network):
    """A plain recurrent layer, or one with gates, read at its last state."""

    def __init__(self, hidden: int = 32, gated: bool = False, **rest) -> None:
        super().__init__(**rest)
        self.hidden, self.gated = hidden, gated
        self.linear_of("input", 4, hidden * (4 if gated else 1))
        self.linear_of("again", hidden, hidden * (4 if gated else 1))
        self.linear_of("out", hidden, 1)

    def logits(self, x: Value) -> Value:
        n, length, _ = x.data.shape
        state = memory = Value(np.zeros((n, self.hidden), self.dtype))
        given = self.linear("input", x)
        part = lambda v, i: v.take((slice(None), slice(i * self.hidden, (i + 1) * self.hidden)))
        for t in range(length):
            step = given.take((slice(None), t)) + self.linear("again", state)
            if not self.gated:
                state = step.tanh()
                continue
            memory = part(step, 1).sigmoid() * memory + part(step, 0).sigmoid() * part(step, 2).tanh()
            state = part(step, 3).sigmoid() * memory.tanh()
        return self.linear("out", state).take((slice(None), 0))


def build(name: str, sequence_length: int, settings: dict | None = None, seed: int = 0) -> Network:
    """A network by name: local_cnn, dilated_cnn, transformer, rnn or lstm."""
    own = dict(settings or {}) | {"seed": seed}
    kinds = {
        "local_cnn": lambda: LocalNetwork(**own), "dilated_cnn": lambda: DilatedNetwork(**own), "transformer": lambda: TransformerNetwork(sequence_length, **own),
        "rnn": lambda: RecurrentNetwork(**own), "lstm": lambda: RecurrentNetwork(gated=True, **own),
    }
    if name not in kinds:
        raise KeyError(f"there is no network {name}")
    return kinds[name]()


def parameter_count(network: Network) -> int:
    return sum(v.data.size for v in network.parameters.values())
