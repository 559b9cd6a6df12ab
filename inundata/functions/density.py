"""Kernel densities of small samples, and the water levels read off them."""

from __future__ import annotations

import numpy as np

#: Fewest values that have a density, and the points at which it is taken.
LEAST, PEAK_POINTS, LEVEL_POINTS = 5, 500, 300
#: Density over which a maximum is a peak.
PEAK = 0.05


def density(values: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, f) of a Gaussian kernel with Scott's width from least to greatest value; none without spread."""
    width = values.std(ddof=1) * len(values) ** -0.2
    if not width > 0:
        return None
    x = np.linspace(values.min(), values.max(), points)
    f = np.zeros(points)
    for part in np.array_split(values, max(1, len(values) // 4096)):
        f += np.exp(-0.5 * ((x[:, None] - part) / width) ** 2).sum(axis=1)
    return x, f / (len(values) * width * np.sqrt(2 * np.pi))


def peak(values: np.ndarray) -> float:
    """Most frequent value by density; the mean of few or equal values."""
    values = values[~np.isnan(values)]
    if not len(values):
        return float("nan")
    found = density(values, PEAK_POINTS) if len(values) >= LEAST else None
    return float(values.mean()) if found is None else float(found[0][found[1].argmax()])


def upper_level(values: np.ndarray) -> float:
    """The highest peak of the density, raised by the spread of the values over the valley before it."""
    values = values[~np.isnan(values)]
    if len(values) < LEAST:
        return float(values.mean()) if len(values) else float("nan")
    found = density(values, LEVEL_POINTS)
    if found is None:
        return float(values.mean())
    x, f = found
    inner = np.arange(1, len(f) - 1)
    tops = inner[(f[inner] > f[inner - 1]) & (f[inner] > f[inner + 1]) & (f[inner] > PEAK)]
    if not len(tops):
        return float(x[f.argmax()] + values.std())
    top = tops[-1]
    dips = inner[(f[inner] < f[inner - 1]) & (f[inner] < f[inner + 1]) & (inner < top)]
    above = values[values > x[dips[-1]]] if len(dips) else values
    return float(x[top] + (above.std() if len(above) else 0.0))
