"""Two blocks of unit vectors compared tile by tile inside a task.

A tile's products are taken in single precision first, whose error is bounded; only what
lies within that error of the wanted distance is worked out in double precision, so the
results are those of double precision throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rows and columns of a tile, and pairs of a row of a tile from which on the whole tile is worked out in double precision.
TILE, CROWDED = 2048, 64
#: Vectors of a block at least, blocks of a corpus (a row is sent to each), and bytes of a block at most; beyond them there are more blocks.
LEAST, BLOCKS, MOST_BYTES = 2048, 16, 32 << 20
#: Digits of a distance that count for the order.
DIGITS = 9


def blocks(n: int, width: int, least: int = LEAST) -> int:
    """How many blocks ``n`` vectors of ``width`` numbers take."""
    return max(1, min(-(-n // least), max(BLOCKS, -(-n * width * 8 // MOST_BYTES))))


def units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and which of them have a direction (others are left out)."""
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.linalg.norm(v, axis=1)
    good = (size > 0) & np.isfinite(size)
    return v[good] / size[good, None], good


def _slack(width: int) -> float:
    """Twice the most by which a product of two unit vectors is wrong in single precision, and what rounding to DIGITS adds."""
    return (width + 8) * 1.2e-7 + 2 * 10.0**-DIGITS


def _few(r: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - np.einsum("ij,ij->i", x[r], y[c])


def nearest(x: np.ndarray, y: np.ndarray, k: int, ids_x: np.ndarray | None = None, ids_y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``x`` and ``y`` and distances: of each row of ``x`` the ``k`` nearest of ``y``, ties of the rounded distance to the earlier row.

    With ids, rows of equal id aren't neighbours.
    """
    slack, out = _slack(x.shape[1]), []
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), TILE):
        q, own = x[lo : lo + TILE], None if ids_x is None else ids_x[lo : lo + TILE]
        floor = np.full(len(q), -np.inf, np.float32)
        r, c, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(y), TILE):
            part = y[at : at + TILE]
            cos = x4[lo : lo + TILE] @ y4[at : at + TILE].T
            if not at and len(part) > k + 1:
                floor = np.partition(cos, len(part) - k - 1, axis=1)[:, len(part) - k - 1] - np.float32(slack)  # one more than k, for the row itself
            nr, nc = np.nonzero(cos >= floor[:, None])
            if len(nr) > CROWDED * len(q):
                exact = 1 - q @ part.T
                if own is not None:
                    exact[own[:, None] == ids_y[None, at : at + TILE]] = np.inf
                nc = np.argsort(np.round(exact, DIGITS), axis=1, kind="stable")[:, :k]
                nr, nd = np.repeat(np.arange(len(q)), nc.shape[1]), np.take_along_axis(exact, nc, 1).ravel()
                nc = nc.ravel()
                nr, nc, nd = nr[np.isfinite(nd)], nc[np.isfinite(nd)], nd[np.isfinite(nd)]
            else:
                if own is not None:
                    other = own[nr] != ids_y[at + nc]
                    nr, nc = nr[other], nc[other]
                nd = _few(nr, nc, q, part)
            r, c, d = np.concatenate([r, nr]), np.concatenate([c, nc + at]), np.concatenate([d, nd])
            order = np.lexsort((c, np.round(d, DIGITS), r))
            r, c, d = r[order], c[order], d[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, d, nth = r[nth < k], c[nth < k], d[nth < k], nth[nth < k]
            last = nth == k - 1
            floor[r[last]] = np.maximum(floor[r[last]], 1 - d[last] - slack)
        out.append((r + lo, c, d))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def near(x: np.ndarray, y: np.ndarray, threshold: float, same: bool = False, skip=lambda a, b: False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile its place and the positions in it and distances of the pairs nearer than ``threshold``; of a block with itself (``same``) only one half.

    ``skip`` leaves out tiles, by the slices of rows of both.
    """
    slack = _slack(x.shape[1])
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), TILE):
        for at in range(lo if same else 0, len(y), TILE):
            if skip(slice(lo, lo + TILE), slice(at, at + TILE)):
                continue
            q, part = x[lo : lo + TILE], y[at : at + TILE]
            r, c = np.nonzero(x4[lo : lo + TILE] @ y4[at : at + TILE].T >= np.float32(1 - threshold - slack))
            if len(r) > CROWDED * len(q):
                exact = 1 - q @ part.T
                r, c = np.nonzero(exact < threshold)
                d = exact[r, c]
            else:
                d = _few(r, c, q, part)
                r, c, d = r[d < threshold], c[d < threshold], d[d < threshold]
            if same and lo == at:
                r, c, d = r[r < c], c[r < c], d[r < c]
            yield lo, at, r, c, d


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links ``a[n], b[n]`` those that join what no earlier one has joined."""
    _, named = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = list(range(int(named.max()) + 1 if len(named) else 0))
    kept = []
    for n, (s, t) in enumerate(zip(named[: len(a)].tolist(), named[len(a) :].tolist())):
        while top[s] != s:
            top[s] = s = top[top[s]]
        while top[t] != t:
            top[t] = t = top[top[t]]
        if s != t:
            top[max(s, t)] = min(s, t)
            kept.append(n)
    return a[kept], b[kept]
