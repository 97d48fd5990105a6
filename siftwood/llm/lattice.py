"""The E8 lattice: nearest points and their neighbouring cells, vectorised."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, from their definition."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even coordinate sum: where it is odd, the worst coordinate rounds the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1) % 2)
    if len(odd):
        r = x[odd] - f[odd]
        k = np.abs(r).argmax(1)
        at = np.arange(len(odd))
        f[odd, k] += np.where(r[at, k] >= 0, 1.0, -1.0)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by one half."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    take = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(take[:, None], a, b)


def with_neighbours(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8): the nearest point and the `probes` next best among its neighbours."""
    c = nearest(x)
    if not probes:
        return c[:, None]
    gain = (x - c) @ MINIMAL.T
    best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
    return np.concatenate([c[:, None], c[:, None] + MINIMAL[best]], axis=1)
