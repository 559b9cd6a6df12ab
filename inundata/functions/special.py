"""Special functions that neither Spark nor numpy has, from their published series."""

from __future__ import annotations

import math

import numpy as np

_SHIFT = 15.0


def digamma(x: float) -> float:
    out = 0.0
    while x < _SHIFT:
        out -= 1 / x
        x += 1
    q = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < _SHIFT:
        out += 1 / (x * x)
        x += 1
    q = 1 / (x * x)
    return out + 1 / x + q / 2 + q / x * (1 / 6 - q * (1 / 30 - q / 42))


def inverse_digamma(y: float, steps: int = 5) -> float:
    """x with digamma(x) = y, by Newton's method from Minka's start."""
    x = 1 / (y - digamma(1.0)) if y < -2.22 else math.exp(y) + 0.5
    for _ in range(steps):
        x -= (digamma(x) - y) / trigamma(x)
    return x


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)
