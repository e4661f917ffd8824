"""Reverse-mode differentiation of NumPy arrays, with the operations that the networks need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Value:
    """An array, its gradient, and how the gradient flows back to what it was made of."""

    def __init__(self, data: np.ndarray, parents: Sequence[Value] = (), back: Callable[[np.ndarray], Sequence[np.ndarray | None]] | None = None, keep: bool = False) -> None:
        self.data, self.parents, self.back, self.grad = data, tuple(parents), back, None
        self.needs = keep or any(p.needs for p in self.parents)

    def backward(self) -> None:
        """Adds the gradient of this number to every value that it depends on and that needs one."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen and v.needs:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is None or v.grad is None:
                continue
            for p, g in zip(v.parents, v.back(v.grad)):
                if p.needs and g is not None:
                    p.grad = g if p.grad is None else p.grad + g

    def __add__(self, other: Value) -> Value:
        return Value(self.data + other.data, (self, other), lambda g: (_like(g, self.data), _like(g, other.data)))

    def __mul__(self, other: Value) -> Value:
        return Value(self.data * other.data, (self, other), lambda g: (_like(g * other.data, self.data), _like(g * self.data, other.data)))

    def __matmul__(self, other: Value) -> Value:
        a, b = self.data, other.data
        return Value(a @ b, (self, other), lambda g: (_like(g @ np.swapaxes(b, -1, -2), a), _like(np.swapaxes(a, -1, -2) @ g, b)))

    def scale(self, by: float) -> Value:
        return Value(self.data * np.asarray(by, self.data.dtype), (self,), lambda g: (g * np.asarray(by, g.dtype),))

    def transpose(self, *axes: int) -> Value:
        return Value(self.data.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))

    def reshape(self, *shape: int) -> Value:
        return Value(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def take(self, at: tuple | slice | int) -> Value:
        def back(g):
            out = np.zeros_like(self.data)
            out[at] = g
            return (out,)

        return Value(self.data[at], (self,), back)

    def largest(self, axis: int) -> Value:
        """The largest along an axis; the first of equal ones takes the gradient."""
        where = np.expand_dims(self.data.argmax(axis), axis)

        def back(g):
            out = np.zeros_like(self.data)
            np.put_along_axis(out, where, np.expand_dims(g, axis), axis)
            return (out,)

        return Value(np.take_along_axis(self.data, where, axis).squeeze(axis), (self,), back)

    def mean(self) -> Value:
        return Value(np.asarray(self.data.mean()), (self,), lambda g: (np.full_like(self.data, g / self.data.size),))

    def relu(self) -> Value:
        return Value(np.maximum(self.data, 0), (self,), lambda g: (g * (self.data > 0),))

    def tanh(self) -> Value:
        y = np.tanh(self.data)
        return Value(y, (self,), lambda g: (g * (1 - y * y),))

    def sigmoid(self) -> Value:
        y = sigmoid(self.data)
        return Value(y, (self,), lambda g: (g * y * (1 - y),))

    def gelu(self) -> Value:
        x = self.data
        p = 0.5 * (1 + erf(x / np.sqrt(2).astype(x.dtype)))
        return Value(x * p, (self,), lambda g: (g * (p + x * np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi).astype(x.dtype)),))

    def softmax(self) -> Value:
        e = np.exp(self.data - self.data.max(-1, keepdims=True))
        y = e / e.sum(-1, keepdims=True)
        return Value(y, (self,), lambda g: (y * (g - (g * y).sum(-1, keepdims=True)),))

    def normalise(self, axes: tuple[int, ...], epsilon: float = 1e-5) -> Value:
        """Less the mean, by the deviation, over axes."""
        x = self.data
        centred = x - x.mean(axes, keepdims=True)
        inverse = 1 / np.sqrt((centred * centred).mean(axes, keepdims=True) + epsilon)
        y = (centred * inverse).astype(x.dtype)
        return Value(y, (self,), lambda g: ((inverse * (g - g.mean(axes, keepdims=True) - y * (g * y).mean(axes, keepdims=True))).astype(x.dtype),))


def _like(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A gradient summed over the axes along which x was broadcast."""
    if g.shape == x.shape:
        return g
    g = g.sum(tuple(range(g.ndim - x.ndim)))
    return g.sum(tuple(i for i, n in enumerate(x.shape) if n == 1 and g.shape[i] != 1), keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7, by a rational approximation whose constants are fixed values."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (np.sign(x) * (1 - poly * np.exp(-x * x))).astype(x.dtype)


def join(values: Sequence[Value], axis: int) -> Value:
    ends = np.cumsum([v.data.shape[axis] for v in values])[:-1]
    return Value(np.concatenate([v.data for v in values], axis), values, lambda g: np.split(g, ends, axis))


def convolve(x: Value, w: Value, dilation: int = 1) -> Value:
    """(n, out, length) of x (n, in, length) and w (out, in, width), padded with zeros to the same length."""
    width, length = w.data.shape[2], x.data.shape[2]
    left = dilation * (width - 1) // 2
    padded = np.pad(x.data, ((0, 0), (0, 0), (left, dilation * (width - 1) - left)))
    views = [padded[:, :, j * dilation : j * dilation + length] for j in range(width)]
    out = sum(np.matmul(w.data[:, :, j], v) for j, v in enumerate(views))

    def back(g):
        gw = np.stack([np.tensordot(g, v, ([0, 2], [0, 2])) for v in views], axis=2)
        gx = np.zeros_like(padded)
        for j in range(width):
            gx[:, :, j * dilation : j * dilation + length] += np.matmul(w.data[:, :, j].T, g)
        return gx[:, :, left : left + length], gw

    return Value(out, (x, w), back)


def logistic_loss(logits: Value, labels: np.ndarray) -> Value:
    """The mean cross entropy of labels 0 and 1 with logits."""
    x = logits.data
    losses = np.maximum(x, 0) - x * labels + np.log1p(np.exp(-np.abs(x)))
    return Value(losses, (logits,), lambda g: (g * (sigmoid(x) - labels),)).mean()
