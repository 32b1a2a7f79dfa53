"""Cross-polytope hashing of sparse vectors.

A sparse vector (64-bit term hashes and weights) is folded into a dense one of a power-of-two
length by feature hashing, turned by pseudo-random rotations (random signs, then a fast Hadamard
transform, three times over) and cut into blocks.  Each block is assigned to the signed axis that
it lies nearest to; the axes of all blocks of one rotation form the bucket of one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply, shift, xor)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0xD1342543DE82EF95 + 1) & (2**64 - 1)) * _MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fold(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, dim: int, salt: int = 0) -> np.ndarray:
    """Feature hashing: the n x dim unit vectors of the entries (rows[i], terms[i]) = weights[i]."""
    h = mix64(terms.view(np.uint64), salt)
    col = (h & np.uint64(dim - 1)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    out = np.bincount(rows * dim + col, weights=weights * sign, minlength=n * dim).reshape(n, dim)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(size > 0, size, 1.0)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        a, b = y[:, :, 0, :], y[:, :, 1, :]
        x = np.stack((a + b, a - b), axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def turned(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudo-random rotation of each row."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * (rng.integers(0, 2, x.shape[1]).astype(np.float32) * 2 - 1))
    return x


@cache
def _rotation(dim: int, seed: tuple[int, ...]) -> np.ndarray:
    """The matrix of turned(): one product is faster than three transforms."""
    return turned(np.eye(dim, dtype=np.float32), seed)


@dataclass(frozen=True)
class Tables:
    """How vectors are hashed: `tables` rotations of `dim` numbers, each cut into `blocks` blocks of
    `width` numbers (blocks * width <= dim); probes: further buckets a vector is looked up in."""

    tables: int = 10
    dim: int = 512
    blocks: int = 4
    width: int = 128
    probes: int = 4
    seed: int = 7

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ _rotation(x.shape[1], (self.seed, table))[:, : self.blocks * self.width]).reshape(len(x), self.blocks, self.width)

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own bucket, and its own and probed buckets (n x (1 + probes))."""
        y = self.rotated(x, table)
        size = np.abs(y)
        n, k, w = y.shape
        first = size.argmax(axis=2)
        i, j = np.ogrid[:n, :k]
        top = size[i, j, first]
        code = first * 2 + (y[i, j, first] > 0)
        scale = (2 * w) ** np.arange(k, dtype=np.int64)
        own = (code * scale).sum(axis=1) + (np.int64(table) << np.int64(48))
        if not self.probes:
            return own, own[:, None]
        size[i, j, first] = -1
        moves, costs = [], []
        for _ in range(max(1, -(-self.probes // k))):
            other = size.argmax(axis=2)
            value = size[i, j, other]
            costs.append(top - value)
            moves.append((other * 2 + (y[i, j, other] > 0) - code) * scale)
            size[i, j, other] = -1
        move, cost = np.concatenate(moves, axis=1), np.concatenate(costs, axis=1)
        near = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return own, np.concatenate((own[:, None], own[:, None] + np.take_along_axis(move, near, axis=1)), axis=1)
