"""Where a smooth periodic field takes very many particles: maps of the flow over some steps, kept for tiles of the sea.

Particles that set out in one phase of the field go the same way whatever detection they belong to. A tile's map is made from the steps
themselves, taken by SIDE x SIDE Chebyshev nodes, and is a polynomial of the way they make. Terms that come to less than FINE degrees
(a micrometre is 9e-12) are left out; tiles whose last ones come to more are cut in four, LEVELS times; what lies in the last ones, about a place where the
field jumps, takes the steps itself. So do the first particles of any tile: its map is made when they outnumber its nodes RENT times.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
from numpy.polynomial import chebyshev

SIDE, WIDTH, LEVELS, RENT, FINE = 16, 0.16, 5, 4, 1e-12
HELD = 1 << 15  # tiles with a map that a process keeps, of 4 KB each at most
_angles = np.pi * (np.arange(SIDE) + 0.5) / SIDE
NODES = np.cos(_angles)
#: Values at the nodes to Chebyshev coefficients, and these to coefficients of powers.
TERMS = np.where(np.arange(SIDE)[:, None] > 0, 2.0, 1.0) / SIDE * np.cos(np.arange(SIDE)[:, None] * _angles)
POWERS = np.array([np.pad(c := chebyshev.cheb2poly([0.0] * k + [1.0]), (0, SIDE - len(c))) for k in range(SIDE)])

Steps = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def powers(x: np.ndarray, many: int) -> np.ndarray:
    """So many rows: x to the power of 0, 1, 2, ..."""
    out, n = np.empty((many, len(x))), 1
    out[0] = 1
    while n < many:
        np.multiply(out[: min(n, many - n)], x, out=out[n : 2 * n])
        x, n = x * x, 2 * n
    return out


class Map:
    """The flow of ``steps`` (places to places). ``tiles``: by level, row and column how many particles came, or the map, or None where it isn't fine."""

    def __init__(self, steps: Steps):
        self.steps, self.tiles, self.fitted = steps, {}, 0

    def __call__(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_lat, to_lon, left, own = np.empty_like(lat), np.empty_like(lon), np.arange(len(lat)), []
        for level in range(LEVELS):
            width = WIDTH / 2**level
            i, j = np.floor(lat[left] / width), np.floor(lon[left] / width)
            order = np.lexsort((j, i))
            left, i, j = left[order], i[order], j[order]
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            groups = {(level, int(i[a]), int(j[a])): left[a:b] for a, b in zip([0, *cuts], [*cuts, len(left)], strict=True)}
            due = []
            for key, at in groups.items():
                if isinstance(self.tiles.get(key, 0), int):
                    self.tiles[key] = self.tiles.get(key, 0) + len(at)
                    due += [key] * (self.tiles[key] > RENT * SIDE**2)
            for first in range(0, len(due), 32):
                self.fit(due[first : first + 32], width)
            deeper = []
            for key, at in groups.items():
                known = self.tiles[key]
                if known is None:
                    deeper.append(at)
                elif isinstance(known, int):
                    own.append(at)
                else:
                    p, q = lat[at], lon[at]
                    way = (known @ powers(2 * (q / width - key[2]) - 1, known.shape[1])).reshape(2, known.shape[1], -1)
                    way *= powers(2 * (p / width - key[1]) - 1, known.shape[1])
                    to_lat[at], to_lon[at] = p + way[0].sum(axis=0), q + way[1].sum(axis=0)
            if not deeper:
                break
            left = np.concatenate(deeper)
        else:
            own.append(left)
        if own:
            at = np.concatenate(own)
            to_lat[at], to_lon[at] = self.steps(lat[at], lon[at])
        return to_lat, to_lon

    def fit(self, keys: list[tuple[int, int, int]], width: float) -> None:
        at = np.array([k[1:] for k in keys], float)
        lat = np.broadcast_to(((at[:, 0, None] + (NODES + 1) / 2) * width)[:, :, None], (len(keys), SIDE, SIDE)).ravel()
        lon = np.broadcast_to(((at[:, 1, None] + (NODES + 1) / 2) * width)[:, None, :], (len(keys), SIDE, SIDE)).ravel()
        p, q = self.steps(lat, lon)
        terms = TERMS @ np.stack([p - lat, q - lon]).reshape(2, len(keys), SIDE, SIDE) @ TERMS.T
        rest = np.abs(terms).sum(axis=0)
        rest = np.stack([rest[:, k:].sum(axis=(1, 2)) + rest[:, :k, k:].sum(axis=(1, 2)) for k in range(1, SIDE - 1)])  # what terms from the k-th on come to
        for n, key in enumerate(keys):
            enough = np.flatnonzero(rest[:, n] < FINE)
            k = enough[0] + 1 if len(enough) else 0
            self.tiles[key] = (POWERS[:k, :k].T @ terms[:, n, :k, :k] @ POWERS[:k, :k]).reshape(2 * k, k) if k else None
            self.fitted += int(k > 0)


_maps: OrderedDict[tuple, Map] = OrderedDict()


def kept(key: tuple, steps: Steps) -> Map:
    """The map of this process for ``key``, which says all that ``steps`` depends on; those longest unused go when HELD tiles are kept."""
    found = _maps.pop(key, None) or Map(steps)
    while _maps and sum(m.fitted for m in _maps.values()) > HELD:
        _maps.popitem(last=False)
    _maps[key] = found
    return found
