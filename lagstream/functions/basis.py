"""Observables: maps of frames (rows) to features; and their expressions on array columns."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Observable:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.evaluate(np.asarray(x, float))

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Identity(Observable):
    def evaluate(self, x):
        return x


class Concatenation(Observable):
    """outer(inner(x))."""

    def __init__(self, outer, inner):
        self.outer, self.inner = outer, inner

    def evaluate(self, x):
        return self.outer(self.inner(x))


class Monomials(Observable):
    """All monomials up to a degree, by degree, those of low dimensions first."""

    def __init__(self, p: int, d: int):
        self.p, self.d = p, d
        self.powers = np.array([np.bincount(c, minlength=d) if c else np.zeros(d, int) for k in range(p + 1) for c in map(list, combinations_with_replacement(range(d), k))])

    def evaluate(self, x):
        return np.stack([np.prod(x**e, axis=1) for e in self.powers], 1)

    def names(self, features=None) -> list[str]:
        features = features or [f"x{i}" for i in range(self.d)]
        return [" ".join(f if e == 1 else f"{f}^{e}" for f, e in zip(features, row) if e) for row in self.powers]

    def column(self, x: str = "x") -> Column:
        out = []
        for row in self.powers:
            term = F.lit(1.0)
            for i, e in enumerate(row):
                for _ in range(e):
                    term = term * F.col(x)[i]
            out.append(term)
        return F.array(*out)


def one_hot(n: int, state: str = "state") -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(state)).cast("double"))


# --- kernels


class Kernel:
    def apply(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Matrix of k(x_i, y_j)."""
        raise NotImplementedError

    def gram(self, x: np.ndarray) -> np.ndarray:
        return self.apply(x, x)

    def __call__(self, a, b) -> float:
        return float(self.apply(np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float)))[0, 0])

    def __mul__(self, other: Kernel) -> Kernel:
        return ProductKernel(self, other)


class ProductKernel(Kernel):
    def __init__(self, a: Kernel, b: Kernel):
        self.a, self.b = a, b

    def apply(self, x, y):
        return self.a.apply(x, y) * self.b.apply(x, y)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


class GaussianKernel(Kernel):
    def __init__(self, sigma: float):
        self.sigma = sigma

    def apply(self, x, y):
        return np.exp(-squared_distances(x, y) / (2 * self.sigma**2))


class GeneralizedGaussianKernel(Kernel):
    def __init__(self, sigmas):
        self.sigmas = np.asarray(sigmas, float)

    def apply(self, x, y):
        return np.exp(-squared_distances(x / self.sigmas, y / self.sigmas) / 2)


class LaplacianKernel(Kernel):
    def __init__(self, sigma: float):
        self.sigma = sigma

    def apply(self, x, y):
        return np.exp(-np.sqrt(squared_distances(x, y)) / self.sigma)


class PolynomialKernel(Kernel):
    def __init__(self, degree: int, inhomogeneity: float = 1.0):
        self.degree, self.inhomogeneity = degree, inhomogeneity

    def apply(self, x, y):
        return (self.inhomogeneity + x @ y.T) ** self.degree


# --- derivatives


def finite_difference_coefficients(at: float, points, k: int = 1) -> np.ndarray:
    """Weights of the k-th derivative at a point from values at points: exact on polynomials below their number."""
    shift = np.asarray(points, float) - at
    n = len(shift)
    if k >= n:
        raise ValueError("too few points")
    scale = max(np.abs(shift).max(), 1e-300)
    rhs = np.zeros(n)
    rhs[k] = np.prod(np.arange(1, k + 1)) / scale**k
    return np.linalg.solve(np.vander(shift / scale, n, increasing=True).T, rhs)


def finite_difference_operator_midpoints(points, k: int = 1, window_radius: int = 2) -> np.ndarray:
    """Matrix from values at points to k-th derivatives at their midpoints."""
    points = np.asarray(points, float)
    mid, n = (points[1:] + points[:-1]) / 2, len(points)
    out = np.zeros((n - 1, n))
    for i, m in enumerate(mid):
        lo, hi = max(0, i + 1 - window_radius), min(n, i + 1 + window_radius)
        out[i, lo:hi] = finite_difference_coefficients(m, points[lo:hi], k)
    return out


def tv_derivative(xs, ys, u0=None, alpha: float = 10.0, tol: float = 1e-6, maxit: int = 100, epsilon: float = 1e-6) -> np.ndarray:
    """Derivative u of noisy values by 1/2 |A u - (y - y0)|^2 + alpha TV(u), A the trapezoidal integral; lagged diffusivity."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    n, dx = len(xs), np.diff(xs)
    a = np.zeros((n, n))
    for i in range(1, n):
        a[i] = a[i - 1]
        a[i, i - 1] += dx[i - 1] / 2
        a[i, i] += dx[i - 1] / 2
    d = (np.eye(n)[1:] - np.eye(n)[:-1]) / dx[:, None]
    u = np.gradient(ys, xs) if u0 is None else np.asarray(u0, float)
    for _ in range(maxit):
        weight = dx / np.sqrt((d @ u) ** 2 + epsilon)
        system = a.T @ a + alpha * (d.T * weight) @ d
        new = np.linalg.solve(system + 1e-12 * np.eye(n), a.T @ (ys - ys[0]))
        change = np.linalg.norm(new - u) / max(np.linalg.norm(u), 1e-300)
        u = new
        if change < tol:
            break
    return u
