"""Kernel functions: a column expression plus a vectorised block form.

A new kernel is a subclass with ``expr`` (Column form), ``block`` (all rows of X against all
rows of Y) and ``rows`` (aligned rows). ``radius`` may return the largest distance at which the
kernel can still exceed a threshold; the pair builder then prunes with it.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginwise.functions.columns import dot, euclidean_distance, squared_distance


HUGE = 1e150


class _SquaredDistances:
    """Squared distances of blocks of rows to all rows of Y, which is prepared once."""

    def __init__(self, Y: np.ndarray):
        # Distances do not change under a shift; centring keeps the cancellation error small. The centre
        # is a median, which one far row does not move.
        self.Y, self.odd = Y, ~(np.abs(Y) < HUGE).all(axis=1)
        B = np.where(self.odd[:, None], 0.0, Y)
        self.centre = np.median(B[~self.odd], axis=0) if not self.odd.all() else np.zeros(Y.shape[1])
        self.B = B - self.centre
        self.size = (self.B * self.B).sum(axis=1)

    def __call__(self, X: np.ndarray) -> np.ndarray:
        x_odd = ~(np.abs(X) < HUGE).all(axis=1)
        A = np.where(x_odd[:, None], 0.0, X) - self.centre
        d2 = (-2.0 * A) @ self.B.T
        d2 += (A * A).sum(axis=1)[:, None]
        d2 += self.size[None, :]
        np.maximum(d2, 0.0, out=d2)
        # A row with NaN, infinity or numbers whose squares overflow takes the direct formula, so it only spoils its own pairs.
        with np.errstate(invalid="ignore", over="ignore"):
            for i in np.flatnonzero(x_odd):
                d2[i] = _row_squared_distance(X[i], self.Y)
            for j in np.flatnonzero(self.odd):
                d2[:, j] = _row_squared_distance(X, self.Y[j])
        return d2


def _block_squared_distance(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return _SquaredDistances(Y)(X)


def _row_squared_distance(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return ((X - Y) ** 2).sum(axis=1)


class Kernel:
    def expr(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def block(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def rows(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def against(self, Y: np.ndarray, epsilon: float) -> Callable[[np.ndarray], np.ndarray]:
        """``block`` for many blocks against one Y. Values clearly below ``epsilon`` may be any that are below it."""
        return lambda X: self.block(X, Y)

    def radius(self, epsilon: float) -> float | None:
        return None


@dataclass(frozen=True)
class GaussianKernel(Kernel):
    gamma: float = 1.0

    def __post_init__(self):
        if not self.gamma > 0.0:
            raise ValueError("gamma must be positive")

    def expr(self, x, y):
        return F.exp(F.lit(-self.gamma) * squared_distance(x, y))

    def block(self, X, Y):
        d2 = _block_squared_distance(X, Y)
        d2 *= -self.gamma
        return np.exp(d2, out=d2)

    def against(self, Y, epsilon):
        distances = _SquaredDistances(Y)
        # Beyond the band around the threshold, whose values are looked at again.
        far = (1e-6 - math.log(epsilon)) / self.gamma if epsilon > 0.0 else math.inf

        def values(X):
            d2 = distances(X)
            near = np.flatnonzero(d2 <= far)
            if 4 * len(near) > d2.size:
                d2 *= -self.gamma
                return np.exp(d2, out=d2)
            kept = np.exp(-self.gamma * d2.ravel()[near])
            d2.fill(0.0)
            d2.ravel()[near] = kept
            return d2

        return values

    def rows(self, X, Y):
        return np.exp(-self.gamma * _row_squared_distance(X, Y))

    def radius(self, epsilon):
        if epsilon <= 0.0:
            return None
        return math.sqrt(max(0.0, -math.log(epsilon) / self.gamma))


@dataclass(frozen=True)
class PolynomialKernel(Kernel):
    scale: float = 1.0
    offset: float = 0.0
    degree: float = 1.0

    def expr(self, x, y):
        return F.pow(F.lit(self.offset) + F.lit(self.scale) * dot(x, y), F.lit(self.degree))

    def _power(self, base):
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            return np.power(base, self.degree)

    def block(self, X, Y):
        with np.errstate(invalid="ignore", over="ignore"):
            return self._power(self.offset + self.scale * (X @ Y.T))

    def rows(self, X, Y):
        return self._power(self.offset + self.scale * (X * Y).sum(axis=1))


@dataclass(frozen=True)
class LinearKernel(Kernel):
    def expr(self, x, y):
        return dot(x, y)

    def block(self, X, Y):
        return X @ Y.T

    def rows(self, X, Y):
        return (X * Y).sum(axis=1)


@dataclass(frozen=True)
class DistanceForm(Kernel):
    """The Euclidean distance, or its square root, in kernel form (used by the scale probe)."""

    root: bool = True

    def expr(self, x, y):
        d = euclidean_distance(x, y)
        return F.sqrt(d) if self.root else d

    def distance(self, value):
        """The distance that has this value."""
        return value * value if self.root else value

    def value(self, distance: float) -> float:
        """The value of a distance."""
        return math.sqrt(distance) if self.root else distance

    def _finish(self, d2):
        d = np.sqrt(d2)
        return np.sqrt(d) if self.root else d

    def block(self, X, Y):
        return self._finish(_block_squared_distance(X, Y))

    def against(self, Y, epsilon):
        distances = _SquaredDistances(Y)
        return lambda X: self._finish(distances(X))

    def rows(self, X, Y):
        return self._finish(_row_squared_distance(X, Y))
