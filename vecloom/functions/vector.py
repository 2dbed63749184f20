"""Vector algebra as column expressions: real vectors are arrays, complex ones pairs of arrays.

Reductions start at 0.0 and run in index order. ``normalise`` gives null for a vector of (nearly)
zero length: there is no direction to keep.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


class Z(NamedTuple):
    """A complex vector."""

    re: Column
    im: Column


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` needs it for every component."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a norm is tiny."""
    return let(norm(a) * norm(b), lambda n: F.when(n <= TINY, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def normalise(v: Column) -> Column:
    return let(v, lambda u: let(norm(u), lambda n: F.when(n > TINY, F.transform(u, lambda x: x / n))))


def blend(a: Column, b: Column, share: float) -> Column:
    """``(1 - share) a + share b``, at unit length."""
    return normalise(F.zip_with(a, b, lambda x, y: x * (1 - share) + y * share))


# ---- complex ------------------------------------------------------------------------------


def znorm(z: Z) -> Column:
    return F.sqrt(dot(z.re, z.re) + dot(z.im, z.im))


def zunit(z: Z) -> Z:
    over = lambda v: let(znorm(z), lambda n: F.when(n > TINY, F.transform(v, lambda x: x / n)))
    return Z(over(z.re), over(z.im))


def conjugate(z: Z) -> Z:
    return Z(z.re, F.transform(z.im, lambda x: -x))


def product(a: Z, b: Z) -> Z:
    return Z(subtract(multiply(a.re, b.re), multiply(a.im, b.im)), add(multiply(a.re, b.im), multiply(a.im, b.re)))


def bind(a: Z, b: Z) -> Z:
    return zunit(product(a, b))


def unbind(a: Z, b: Z) -> Z:
    return zunit(product(a, conjugate(b)))


def superpose(a: Z, b: Z) -> Z:
    return zunit(Z(add(a.re, b.re), add(a.im, b.im)))


def invert(z: Z) -> Z:
    return zunit(Z(F.transform(z.re, lambda x: -x), F.transform(z.im, lambda x: -x)))


def shift(z: Z, by: int, width: int) -> Z:
    """Rotate right by ``by`` places."""
    k = by % width
    turn = lambda v: F.concat(F.slice(v, width - k + 1, k), F.slice(v, 1, width - k)) if k else v
    return Z(turn(z.re), turn(z.im))


def deduce(a: Z, b: Z) -> Z:
    return zunit(product(b, conjugate(a)))


def attend(z: Z, mask: Column) -> Z:
    return zunit(Z(multiply(z.re, mask), multiply(z.im, mask)))


def rotate(z: Z, angle: float | Column) -> Z:
    """Every component turned by the same angle."""
    c, s = (F.lit(math.cos(angle)), F.lit(math.sin(angle))) if isinstance(angle, float) else (F.cos(angle), F.sin(angle))
    return Z(F.zip_with(z.re, z.im, lambda x, y: x * c - y * s), F.zip_with(z.re, z.im, lambda x, y: x * s + y * c))


def aged(z: Z, days: Column) -> Z:
    return rotate(z, -days * (math.pi / 432))


def inner(a: Z, b: Z) -> tuple[Column, Column]:
    """The Hermitian product, real and imaginary part."""
    return dot(a.re, b.re) + dot(a.im, b.im), dot(a.im, b.re) - dot(a.re, b.im)


def zcosine(a: Z, b: Z) -> Column:
    n = znorm(a) * znorm(b)
    return F.when(n <= TINY, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner(a, b)[0] / n)))


def hermitian(a: Z, b: Z) -> Column:
    """Magnitude of the Hermitian product over the norms, 0 to 1."""
    re, im = inner(a, b)
    n = znorm(a) * znorm(b)
    return F.when(n <= TINY, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(re * re + im * im) / n))


def project(a: Z, b: Z) -> Z:
    """The part of ``a`` along ``b``."""
    re, im = inner(a, b)
    n = dot(b.re, b.re) + dot(b.im, b.im)
    mixed = lambda f: let(F.array(re / n, im / n), lambda k: F.zip_with(b.re, b.im, lambda x, y: f(F.get(k, F.lit(0)), F.get(k, F.lit(1)), x, y)))
    return Z(mixed(lambda p, q, x, y: p * x - q * y), mixed(lambda p, q, x, y: p * y + q * x))


def flatten(z: Z) -> Column:
    """Real and imaginary parts interleaved."""
    return F.flatten(F.zip_with(z.re, z.im, lambda x, y: F.array(x, y)))


def residual(a: Column, predicted: Column) -> tuple[Column, Column]:
    """Length of the difference, and its first 16 components."""
    d = subtract(a, predicted)
    return norm(d), F.slice(d, 1, 16)


def curvature(evolved: Column, origin: Column, before: Column) -> Column:
    now = cosine(evolved, origin)
    return 0.7 * (1 - now) + 0.3 * F.abs(now - cosine(before, origin))


def well_formed(v: Column, low: float = 0.95, high: float = 1.05) -> Column:
    """No NaN or infinity, and a norm near one."""
    broken = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return ~broken & norm(v).between(low, high)


def quasi_orthogonal(a: Column, b: Column, below: float = 0.1) -> Column:
    return F.abs(cosine(a, b)) < below


# ---- narrow codes -------------------------------------------------------------------------


def int8_codes(v: Column, dims: int = 384) -> Column:
    return F.transform(F.slice(v, 1, dims), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127))).cast("int"))


def pack_int8(codes: Column, width: int) -> Column:
    """Four codes to an unsigned 32-bit number, little-endian."""
    word = lambda i: sum((F.shiftleft(F.get(codes, i * 4 + k).bitwiseAND(255).cast("bigint"), 8 * k) for k in range(1, 4)), F.get(codes, i * 4).bitwiseAND(255).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(width // 4 - 1)), word)


def hyperbolic_score(a: Column, b: Column) -> Column:
    """``1 / (1 + acosh(1 + 2 d^2 / ((1 - |a|^2)(1 - |b|^2))))`` with norms kept inside the ball."""
    na, nb = F.least(dot(a, a), F.lit(0.9999)), F.least(dot(b, b), F.lit(0.9999))
    d = subtract(a, b)
    x = 1 + 2 * dot(d, d) / F.greatest((1 - na) * (1 - nb), F.lit(1e-4))
    return 1 / (1 + F.acosh(F.greatest(x, F.lit(1.0))))
