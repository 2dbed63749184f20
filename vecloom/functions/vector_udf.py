"""Vector functions whose steps depend on one another: Arrow batches and numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-8


def _rows(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n > TINY, x / np.maximum(n, TINY), 0.0)


def vectorised(f: Callable[..., np.ndarray]):
    """A Pandas UDF of whole batches: arrays in, one array column out."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(f(_rows(a), _rows(b))), dtype=object)

    return run


def gram_schmidt_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    share = (a * b).sum(axis=1, keepdims=True) / np.maximum((b * b).sum(axis=1, keepdims=True), TINY)
    return unit(a - share * b)


def gram_schmidt():
    return vectorised(gram_schmidt_rows)


def pull(q: np.ndarray, target: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """The part of the target tangent to the sphere at q."""
    return strength * (target - (target * q).sum(axis=1, keepdims=True) * q)


def rk4_rows(q: np.ndarray, target: np.ndarray, h: float = 0.1, steps: int = 1) -> np.ndarray:
    """Runge-Kutta steps along the sphere towards the target, at unit length in every stage."""
    q = unit(q)
    for _ in range(steps):
        k1 = pull(q, target)
        k2 = pull(unit(q + h / 2 * k1), target)
        k3 = pull(unit(q + h / 2 * k2), target)
        k4 = pull(unit(q + h * k3), target)
        q = unit(q + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4))
    return q


def rk4(h: float = 0.1, steps: int = 1):
    return vectorised(lambda a, b: rk4_rows(a, b, h, steps))


def reconcile_rows(a: np.ndarray, reference: np.ndarray, steps: int) -> np.ndarray:
    """Blends towards the reference with a share that falls from 0.30 by 0.017 to 0.10 at least."""
    q = unit(a)
    for i in range(steps):
        w = max(0.30 - 0.017 * i, 0.10)
        q = unit((1 - w) * q + w * reference)
    return q


def reconcile(steps: int):
    return vectorised(lambda a, b: reconcile_rows(a, b, steps))


def srht_rows(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows with seeded signs, through the Walsh-Hadamard transform, at their length."""
    n = x.shape[1]
    x = x * signs(n, seed)
    h = 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(n)


def srht(width: int, seed: int = 7):
    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    return vectorised(lambda a, b: srht_rows(a, seed))


# The generator of the noise, and the hash that weighs components, with its seed.
STEP, SHIFT = 6_364_136_223_846_793_005, 1
SEED = 0x454E4752
FINAL = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))


def phases(width: int, seed: int, spread: float) -> np.ndarray:
    """Seeded numbers in ``spread`` times [-1, 1] from the high halves of a 64-bit linear congruence."""
    out, x = [], seed
    for _ in range(width):
        x = (x * STEP + SHIFT) % (1 << 64)
        out.append(((x >> 32) / 0xFFFFFFFF * 2 - 1) * spread)
    return np.array(out)


def signs(width: int, seed: int) -> np.ndarray:
    """Seeded signs from the highest bits of the same congruence."""
    out, x = [], seed
    for _ in range(width):
        x = (x * STEP + SHIFT) % (1 << 64)
        out.append(-1.0 if x >> 63 else 1.0)
    return np.array(out)


def bind_noisy(width: int, seed: int = 7, spread: float = 0.05):
    """Elementwise product turned by a seeded phase, at unit length: real parts, then imaginary ones."""
    turn = phases(width, seed, spread)
    return vectorised(lambda a, b: unit(np.concatenate((a * b * np.cos(turn), a * b * np.sin(turn)), axis=1)))


def hash_weights(n: int) -> np.ndarray:
    """The finalised 32-bit hash of each number below ``n``, in [-1, 1]."""
    h = np.arange(n, dtype=np.uint64) ^ np.uint64(SEED)
    for by, times in FINAL:
        h ^= h >> np.uint64(by)
        h = h * np.uint64(times) & np.uint64(0xFFFFFFFF)
    h ^= h >> np.uint64(16)
    return h.astype(np.float64) / 0xFFFFFFFF * 2 - 1


def project_3d(width: int):
    """Sums of |q_i| with hashed weights for each of three axes."""
    weights = hash_weights(3 * width).reshape(width, 3)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(_rows(v)) @ weights), dtype=object)

    return run
