"""Dense algebra on small matrices that came from distributed aggregates."""

from __future__ import annotations

import numpy as np


class ZeroRankError(np.linalg.LinAlgError):
    """No eigenvalue is above the cut."""


def sort_eigs(values: np.ndarray, vectors: np.ndarray, order: str = "magnitude") -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs by descending magnitude, or by descending (real, imaginary) parts."""
    if order == "magnitude":
        at = np.argsort(-np.abs(values), kind="stable")
    elif order == "lexicographic":
        at = np.lexsort((values.imag, values.real))[::-1]
    else:
        raise ValueError(f"unknown order {order}")
    return values[at], vectors[:, at]


def canonical_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns whose entry of largest magnitude is positive."""
    peak = np.abs(vectors).argmax(0)
    sign = np.sign(vectors[peak, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def spd_eig(w: np.ndarray, epsilon: float = 1e-10, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a symmetric matrix above an absolute cut, descending. A negative eigenvalue raises the cut to its size."""
    w = np.asarray(w, float)
    if not np.allclose(w, w.T):
        raise ValueError("matrix is not symmetric")
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    low = values.min(initial=0.0)
    if low < 0:
        epsilon = max(epsilon, -low + 1e-16)
    keep = values > epsilon
    if not keep.any():
        raise ZeroRankError("all eigenvalues are below the cut")
    values, vectors = values[keep], vectors[:, keep]
    return values, canonical_signs(vectors) if signs else vectors


def spd_inv(w: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    s, v = spd_eig(w, epsilon)
    return (v / s) @ v.T


def spd_inv_sqrt(w: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    s, v = spd_eig(w, epsilon)
    return (v / np.sqrt(s)) @ v.T


def spd_inv_split(w: np.ndarray, epsilon: float = 1e-10, signs: bool = False) -> np.ndarray:
    """L with W^-1 = L L^T on the retained subspace; one column a rank."""
    s, v = spd_eig(w, epsilon, signs)
    return v / np.sqrt(s)


def spd_truncated_svd(m: np.ndarray, dim: int | None = None, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors of a symmetric positive matrix, at most dim, above epsilon."""
    s, v = np.linalg.eigh((m + m.T) / 2)
    s, v = s[::-1], v[:, ::-1]
    keep = np.flatnonzero(s > epsilon)[:dim]
    return s[keep], v[:, keep]


def eigs(m: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eig(m)
    values, vectors = sort_eigs(values, vectors)
    return values[:n], vectors[:, :n]


def eig_corr(c0: np.ndarray, ct: np.ndarray, epsilon: float = 1e-10, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Generalised problem C_t v = C_0 v l by whitening with C_0."""
    split = spd_inv_split(c0, epsilon, signs)
    inner = split.T @ ct @ split
    if np.allclose(inner, inner.T):
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    else:
        values, vectors = np.linalg.eig(inner)
    values, vectors = sort_eigs(values, vectors)
    return values, split @ vectors


def schatten_norm(m: np.ndarray, order: float = 1, hermitian: bool = False) -> float:
    s = np.abs(np.linalg.eigvalsh(m)) if hermitian else np.linalg.svd(m, compute_uv=False)
    return float((s**order).sum() ** (1 / order)) if np.isfinite(order) else float(s.max())


def symeig_reg(m: np.ndarray, epsilon: float = 1e-6, mode: str = "regularize") -> tuple[np.ndarray, np.ndarray]:
    """Symmetric eigenpairs: small ones dropped (trunc), the diagonal raised (regularize) or values raised (clamp)."""
    m = np.asarray(m, float)
    if mode == "regularize":
        values, vectors = np.linalg.eigh(m + epsilon * np.eye(len(m)))
        return np.abs(values), vectors
    values, vectors = np.linalg.eigh(m)
    if mode == "trunc":
        return values[values > epsilon], vectors[:, values > epsilon]
    if mode == "clamp":
        return np.maximum(values, epsilon), vectors
    raise ValueError(f"unknown mode {mode}")


def sym_inverse(m: np.ndarray, epsilon: float = 1e-6, root: bool = False, mode: str = "regularize") -> np.ndarray:
    values, vectors = symeig_reg(m, epsilon, mode)
    return (vectors / (np.sqrt(values) if root else values)) @ vectors.T


def matrix_log(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(m)
    return (vectors * np.log(values.astype(complex))) @ np.linalg.inv(vectors)


def matrix_power(m: np.ndarray, p: float) -> np.ndarray:
    """m to an integer or fractional power (complex where it must be)."""
    if float(p).is_integer() and p >= 0:
        return np.linalg.matrix_power(m, int(p))
    values, vectors = np.linalg.eig(m)
    out = (vectors * values.astype(complex) ** p) @ np.linalg.inv(vectors)
    return out.real if np.allclose(out.imag, 0) else out


def matrix_exp(m: np.ndarray) -> np.ndarray:
    """exp by scaling and squaring of a Taylor series."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(1).max(initial=0), 1e-300)))) + 6)
    a, out, term = m / 2**k, np.eye(len(m)), np.eye(len(m))
    for i in range(1, 19):
        term = term @ a / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else np.squeeze(out, axis)


def logsumexp_pair(a: float, b: float) -> float:
    return float(np.logaddexp(a, b))


def ksum(x: np.ndarray) -> float:
    """Compensated sum."""
    total = lost = 0.0
    for v in np.ravel(x):
        y = v - lost
        t = total + y
        lost = (t - total) - y
        total = t
    return total


def kdot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product with compensated sums."""
    return np.array([[ksum(r * c) for c in np.asarray(b).T] for r in np.asarray(a)])


def is_sorted(x: np.ndarray, order: str = "asc") -> bool:
    d = np.diff(np.asarray(x))
    return bool((d >= 0).all() if order == "asc" else (d <= 0).all())


def is_diagonal_matrix(m: np.ndarray) -> bool:
    return bool(np.all(m == np.diag(np.diagonal(m))))


def is_square_matrix(m: np.ndarray) -> bool:
    return m.ndim == 2 and m.shape[0] == m.shape[1]


def allclose_sparse(a: np.ndarray, b: np.ndarray, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    return a.shape == b.shape and bool(np.allclose(a, b, rtol=rtol, atol=atol))


def submatrix(m: np.ndarray, chosen) -> np.ndarray:
    return m[np.ix_(chosen, chosen)]


def remove_negative_entries(m: np.ndarray) -> np.ndarray:
    return np.where(m > 0, m, 0)


def drop_nan_rows(a: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    keep = ~np.isnan(np.asarray(a, float).reshape(len(a), -1)).any(1)
    for o in others:
        keep &= ~np.isnan(np.asarray(o, float).reshape(len(o), -1)).any(1)
    return tuple(x[keep] for x in (a, *others))
