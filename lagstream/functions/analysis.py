"""Analysis of transition matrices: spectra, passage times, committors, correlations, sensitivities, metastable sets."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

from lagstream.functions import graph


class SpectralWarning(UserWarning):
    pass


class ImaginaryEigenValueWarning(SpectralWarning):
    pass


class PrecisionWarning(UserWarning):
    pass


class NotConvergedWarning(UserWarning):
    pass


class NotConvergedError(RuntimeError):
    pass


# --- predicates


def is_transition_matrix(t: np.ndarray, tol: float = 1e-12) -> bool:
    t = np.asarray(t)
    return t.ndim == 2 and t.shape[0] == t.shape[1] and bool((t >= -tol).all()) and bool(np.allclose(t.sum(1), 1, rtol=tol))


def is_rate_matrix(k: np.ndarray, tol: float = 1e-12) -> bool:
    off = k - np.diag(np.diagonal(k))
    return bool((off >= -tol).all()) and bool(np.allclose(k.sum(1), 0, atol=max(tol, 1e-12)))


def is_reversible(t: np.ndarray, mu: np.ndarray | None = None, tol: float = 1e-12) -> bool:
    if mu is None:
        mu = stationary_distribution(t)
    flow = mu[:, None] * t
    return bool(np.allclose(flow, flow.T, rtol=tol))


def is_connected(t: np.ndarray, directed: bool = True) -> bool:
    return graph.is_connected(t, directed)


def is_ergodic(t: np.ndarray, tol: float = 1e-12) -> bool:
    return is_transition_matrix(t, tol) and is_connected(t)


# --- stationary distribution


def backward_iteration(a: np.ndarray, mu: float, x0: np.ndarray, tol: float = 1e-14, maxiter: int = 100) -> np.ndarray:
    """Inverse iteration to the eigenvector of a nearest to mu."""
    shifted = a - mu * np.eye(len(a))
    y = x0 / np.linalg.norm(x0)
    for _ in range(maxiter):
        x = np.linalg.solve(shifted, y)
        size = np.linalg.norm(x)
        if 1 / size <= tol:
            return x / size
        y = x / size
    warnings.warn("inverse iteration did not converge", NotConvergedWarning, stacklevel=2)
    return y


def stationary_distribution_from_backward_iteration(t: np.ndarray, eps: float = 1e-15) -> np.ndarray:
    x = backward_iteration(t.T, 1 - eps, np.ones(len(t)))
    return x / x.sum()


def stationary_distribution_from_eigenvector(t: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(t.T)
    x = vectors[:, np.argmin(np.abs(values - 1))].real
    return x / x.sum()


def stationary_distribution(t: np.ndarray, mode: str = "fallback", check_inputs: bool = True, tol: float = 1e-12) -> np.ndarray:
    """pi with pi T = pi of a connected transition matrix, clipped at zero and normalised."""
    t = np.asarray(t, float)
    if check_inputs:
        if not np.allclose(t.sum(1), 1, rtol=max(tol, 1e-8)):
            raise ValueError("not a transition matrix")
        if len(graph.closed_sets(t)) > 1:
            raise ValueError("stationary distribution is not unique")
    if mode not in ("fallback", "backward", "eigenvector"):
        raise ValueError(f"unknown mode {mode}")
    pi = None
    if mode in ("fallback", "backward"):
        try:
            pi = stationary_distribution_from_backward_iteration(t)
        except np.linalg.LinAlgError:
            pi = None
        if pi is not None and (not np.isfinite(pi).all() or np.abs(pi @ t - pi).max() > 1e-8):
            pi = None
        if pi is None and mode == "backward":
            raise np.linalg.LinAlgError("backward iteration failed")
    if pi is None:
        pi = stationary_distribution_from_eigenvector(t)
    pi = np.clip(pi, 0, None)
    return pi / pi.sum()


# --- spectrum


def _symmetric(t: np.ndarray, mu: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    mu = stationary_distribution(t) if mu is None else mu
    root = np.sqrt(mu)
    s = root[:, None] * t / root[None, :]
    return (s + s.T) / 2, root


def eigenvalues_rev(t: np.ndarray, k: int | None = None, mu: np.ndarray | None = None) -> np.ndarray:
    values = np.linalg.eigvalsh(_symmetric(t, mu)[0])
    return values[np.argsort(-np.abs(values), kind="stable")][:k]


def eigenvalues(t: np.ndarray, k: int | None = None, reversible: bool = False, mu: np.ndarray | None = None) -> np.ndarray:
    if reversible:
        return eigenvalues_rev(t, k, mu)
    values = np.linalg.eigvals(t)
    values = values[np.argsort(-np.abs(values), kind="stable")][:k]
    return values.real if np.allclose(values.imag, 0) else values


def rdl_decomposition_rev(t: np.ndarray, norm: str = "reversible", mu: np.ndarray | None = None, k: int | None = None):
    """T = R D L of a reversible matrix; L L^T in pi is one for norm reversible."""
    s, root = _symmetric(t, mu)
    values, v = np.linalg.eigh(s)
    order = np.argsort(-np.abs(values), kind="stable")
    values, v = values[order], v[:, order]
    r, left = v / root[:, None], (v * root[:, None]).T
    sign = np.sign(r[0] if norm == "standard" else r.sum(0))
    sign = np.where(sign == 0, 1, sign)
    sign[0] = np.sign(left[0].sum()) or 1
    r, left = r * sign, left * sign[:, None]
    if norm == "standard":
        scale = left[0].sum()
        left[0], r[:, 0] = left[0] / scale, r[:, 0] * scale
    return r[:, :k], np.diag(values[:k]), left[:k]


def rdl_decomposition_nrev(t: np.ndarray, norm: str = "standard", k: int | None = None):
    values, r = np.linalg.eig(t)
    order = np.argsort(-np.abs(values), kind="stable")
    values, r = values[order], r[:, order]
    left = np.linalg.inv(r)
    scale = left[0].sum()
    left[0], r[:, 0] = left[0] / scale, r[:, 0] * scale
    if np.allclose(values.imag, 0) and np.allclose(r.imag, 0):
        values, r, left = values.real, r.real, left.real
    return r[:, :k], np.diag(values[:k]), left[:k]


def rdl_decomposition(t: np.ndarray, k: int | None = None, norm: str = "auto", reversible: bool | None = None, mu: np.ndarray | None = None):
    """Right vectors, eigenvalues and left vectors; norm auto is reversible where the matrix is."""
    if norm not in ("auto", "standard", "reversible"):
        raise ValueError(f"unknown norm {norm}")
    if norm == "reversible" or reversible or (norm == "auto" and reversible is None and is_ergodic(t, 1e-8) and is_reversible(t, mu, 1e-8)):
        return rdl_decomposition_rev(t, "standard" if norm == "standard" else "reversible", mu, k)
    return rdl_decomposition_nrev(t, "standard", k)


def eigenvectors(t: np.ndarray, k: int | None = None, right: bool = True, reversible: bool = False, mu: np.ndarray | None = None) -> np.ndarray:
    r, _, left = rdl_decomposition(t, k, "reversible" if reversible else "standard", reversible, mu)
    return r if right else left


def timescales_from_eigenvalues(values: np.ndarray, tau: float = 1) -> np.ndarray:
    values = np.asarray(values)
    if np.iscomplexobj(values) and not np.allclose(values.imag, 0):
        warnings.warn("timescales of complex eigenvalues use their magnitude", ImaginaryEigenValueWarning, stacklevel=2)
    size = np.abs(values)
    if (np.abs(size - 1) < 1e-14).sum() > 1:
        warnings.warn("several eigenvalues have magnitude one", SpectralWarning, stacklevel=2)
    out = np.full(len(size), np.inf)
    some = (np.abs(size - 1) >= 1e-14) & (size > 0)
    out[some] = -tau / np.log(size[some])
    out[size == 0] = 0
    return out


def timescales(t: np.ndarray, tau: float = 1, k: int | None = None, reversible: bool = False, mu: np.ndarray | None = None) -> np.ndarray:
    return timescales_from_eigenvalues(eigenvalues(t, k, reversible, mu), tau)


# --- hitting, passage, committors


def _index(x, n: int) -> np.ndarray:
    out = np.unique(np.atleast_1d(np.asarray(x, int)))
    if len(out) == 0 or out[0] < 0 or out[-1] >= n:
        raise ValueError("states out of range")
    return out


def mfpt(t: np.ndarray, target, origin=None, tau: float = 1, mu: np.ndarray | None = None):
    """Mean first passage times to target, or from origin weighted by mu (stationary where none is given)."""
    n = len(t)
    target = _index(target, n)
    a = np.eye(n) - t
    a[target] = 0
    a[target, target] = 1
    b = np.ones(n)
    b[target] = 0
    m = np.linalg.solve(a, b) * tau
    if origin is None:
        return m
    origin = _index(origin, n)
    mu = stationary_distribution(t) if mu is None else mu
    return float(mu[origin] @ m[origin] / mu[origin].sum())


def mfpt_between_sets(t, target, origin, mu=None) -> float:
    return mfpt(t, target, origin, 1, mu)


def hitting_probability(t: np.ndarray, target) -> np.ndarray:
    """Least non-negative solution of q = T q with q = 1 on target: states that cannot reach target have 0."""
    n = len(t)
    target = _index(target, n)
    q = np.zeros(n)
    q[target] = 1
    rest = [i for i in range(n) if i not in set(target.tolist()) and graph.has_connection(t, [i], target)]
    if rest:
        q[rest] = np.linalg.solve(np.eye(len(rest)) - t[np.ix_(rest, rest)], t[np.ix_(rest, target)].sum(1))
    return q


def forward_committor(t: np.ndarray, a, b) -> np.ndarray:
    n = len(t)
    a, b = _index(a, n), _index(b, n)
    if np.intersect1d(a, b).size:
        raise ValueError("source and target overlap")
    m = t - np.eye(n)
    rhs = np.zeros(n)
    for s, v in ((a, 0.0), (b, 1.0)):
        m[s] = 0
        m[s, s] = 1
        rhs[s] = v
    return np.linalg.solve(m, rhs)


def backward_committor(t: np.ndarray, a, b, mu: np.ndarray | None = None) -> np.ndarray:
    """Probability to have come from a rather than b: the forward committor of the time-reversed chain to a."""
    mu = stationary_distribution(t) if mu is None else mu
    return forward_committor(mu[None, :] * t.T / mu[:, None], b, a)


def committor(t: np.ndarray, a, b, forward: bool = True, mu: np.ndarray | None = None) -> np.ndarray:
    if forward:
        return forward_committor(t, a, b)
    mu = stationary_distribution(t) if mu is None else mu
    return 1 - forward_committor(t, a, b) if is_reversible(t, mu, 1e-8) else backward_committor(t, a, b, mu)


# --- propagation, expected counts


def propagate(a: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        x = a @ x
    return x


def geometric_series(q, n: int):
    """Sum of q^0 .. q^(n-1), of numbers or arrays."""
    q = np.asarray(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (1 - q**n) / (1 - q)
    return np.where(q == 1, n, out)


def ec_matrix_vector(p0: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    p, total = np.asarray(p0, float), np.zeros(len(p0))
    for _ in range(n):
        total += p
        p = p @ t
    return total[:, None] * t


def ec_geometric_series(p0: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    r, d, left = rdl_decomposition_nrev(t)
    total = ((p0 @ r) * geometric_series(np.diagonal(d), n)) @ left
    return total.real[:, None] * t


def expected_counts(p0: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    if n <= 0:
        return np.zeros_like(t)
    return ec_matrix_vector(p0, t, n) if n <= len(t) else ec_geometric_series(p0, t, n)


def expected_counts_stationary(t: np.ndarray, n: int, mu: np.ndarray | None = None) -> np.ndarray:
    if n <= 0:
        return np.zeros_like(t)
    return n * (stationary_distribution(t) if mu is None else mu)[:, None] * t


# --- expectations, correlations, relaxation


def expectation(t: np.ndarray, a: np.ndarray, mu: np.ndarray | None = None) -> float:
    return float((stationary_distribution(t) if mu is None else mu) @ np.asarray(a))


def correlation(t, obs1, obs2=None, times=(1,), mu=None) -> np.ndarray:
    """E[obs1(0) obs2(time)] for each time, in the order of times."""
    mu = stationary_distribution(t) if mu is None else mu
    return _moments(t, mu * np.asarray(obs1), obs1 if obs2 is None else obs2, times)


def relaxation(t, p0, obs, times=(1,)) -> np.ndarray:
    return _moments(t, np.asarray(p0), obs, times)


def _moments(t, weight, obs, times) -> np.ndarray:
    times, obs = np.asarray(times), np.asarray(obs, float)
    if len(times) and times.max() > len(t):
        r, d, left = rdl_decomposition_nrev(np.asarray(t))
        amplitude = (weight @ r) * (left @ obs)
        return np.array([(amplitude * np.diagonal(d) ** s).sum() for s in times]).real
    out, now, at = np.zeros(len(times)), obs, 0
    for i in np.argsort(times, kind="stable"):
        now = propagate(np.asarray(t), now, int(times[i]) - at)
        at = int(times[i])
        out[i] = weight @ now
    return out


def fingerprint(t, obs1, obs2=None, p0=None, tau: float = 1, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Timescales and amplitudes of a correlation (p0 None) or relaxation from p0."""
    obs1 = np.asarray(obs1, float)
    obs2 = obs1 if obs2 is None else np.asarray(obs2, float)
    r, d, left = rdl_decomposition(t, k)
    weight = stationary_distribution(t) * obs1 if p0 is None else np.asarray(p0)
    return timescales_from_eigenvalues(np.diagonal(d), tau), (weight @ r) * (left @ obs2)


def fingerprint_correlation(t, obs1, obs2=None, tau=1, k=None):
    return fingerprint(t, obs1, obs2, None, tau, k)


def fingerprint_relaxation(t, p0, obs, tau=1, k=None):
    return fingerprint(t, np.ones(len(t)), obs, p0, tau, k)


# --- sensitivities


def eigenvalue_sensitivity(t, k) -> np.ndarray:
    r, _, left = rdl_decomposition_nrev(t)
    return np.outer(left[k], r[:, k])


def timescale_sensitivity(t, k) -> np.ndarray:
    value = np.abs(eigenvalues(t)[k])
    if value >= 1 or value == 0:
        return np.zeros_like(t)
    return eigenvalue_sensitivity(t, k) / (value * np.log(value) ** 2)


def eigenvector_sensitivity(t, k, j, right: bool = True) -> np.ndarray:
    r, d, left = rdl_decomposition_nrev(t)
    values = np.diagonal(d)
    out = np.zeros_like(t, dtype=r.dtype)
    for i in range(len(t)):
        if i != k:
            out += (np.outer(left[i], r[:, k]) * r[j, i] if right else np.outer(left[k], r[:, i]) * left[i, j]) / (values[k] - values[i])
    return out.real if np.allclose(out.imag, 0) else out


def stationary_distribution_sensitivity(t, j) -> np.ndarray:
    """d pi_j / d T_ab by the fundamental matrix."""
    n, pi = len(t), stationary_distribution(t)
    z = np.linalg.inv(np.eye(n) - t + np.outer(np.ones(n), pi))
    return np.outer(pi, z[:, j] - pi @ z[:, j])


def expectation_sensitivity(t, a) -> np.ndarray:
    return sum(a[j] * stationary_distribution_sensitivity(t, j) for j in range(len(t)))


def mfpt_sensitivity(t, target, i) -> np.ndarray:
    n = len(t)
    target = _index(target, n)
    m = mfpt(t, target)
    a = np.eye(n) - t
    a[target] = 0
    a[target, target] = 1
    row = np.linalg.solve(a.T, np.eye(n)[i])
    row[target] = 0
    return np.outer(row, m)


def forward_committor_sensitivity(t, a, b, index) -> np.ndarray:
    n = len(t)
    a, b = _index(a, n), _index(b, n)
    q = forward_committor(t, a, b)
    m = np.eye(n) - t
    ends = np.union1d(a, b)
    m[ends] = 0
    m[ends, ends] = 1
    row = np.linalg.solve(m.T, np.eye(n)[index])
    row[ends] = 0
    return np.outer(row, q)


def backward_committor_sensitivity(t, a, b, index) -> np.ndarray:
    """For reversible matrices, where the backward committor is one minus the forward one."""
    return -forward_committor_sensitivity(t, a, b, index)


def committor_sensitivity(t, a, b, i, forward: bool = True) -> np.ndarray:
    return forward_committor_sensitivity(t, a, b, i) if forward else backward_committor_sensitivity(t, a, b, i)


# --- metastable sets


@dataclass
class PCCAModel:
    """Fuzzy memberships of states in metastable sets, with the coarse chain."""

    transition_matrix_coarse: np.ndarray
    pi_coarse: np.ndarray
    memberships: np.ndarray
    metastable_distributions: np.ndarray

    @property
    def n_metastable(self) -> int:
        return self.memberships.shape[1]

    @property
    def assignments(self) -> np.ndarray:
        return self.memberships.argmax(1)

    @property
    def sets(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.assignments == i) for i in range(self.n_metastable)]

    coarse_grained_transition_matrix = property(lambda self: self.transition_matrix_coarse)


def _inner_simplex(v: np.ndarray) -> np.ndarray:
    """Indices of the rows that span the simplex of v best, by repeated projection."""
    m = v.shape[1]
    x, chosen = v.copy(), []
    first = int(np.argmax((x**2).sum(1)))
    chosen.append(first)
    x = x - x[first]
    for _ in range(1, m):
        size = np.sqrt((x**2).sum(1))
        i = int(np.argmax(size))
        chosen.append(i)
        d = x[i] / max(size[i], 1e-300)
        x = x - np.outer(x @ d, d)
    return np.array(chosen)


def _feasible(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scales a transformation so that memberships are non-negative and sum to one."""
    a = a.copy()
    a[1:, 0] = -a[1:, 1:].sum(1)
    a[0] = -(v[:, 1:] @ a[1:]).min(0)
    return a / a[0].sum()


def _nelder_mead(f, x0: np.ndarray, rounds: int = 600, tol: float = 1e-8) -> np.ndarray:
    n = len(x0)
    points = np.vstack([x0, x0 + np.diag(np.where(x0 != 0, 0.05 * x0, 0.00025))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max(initial=0) < tol and np.abs(values[1:] - values[0]).max(initial=0) < tol:
            break
        centre = points[:-1].mean(0)
        reflected = centre + (centre - points[-1])
        fr = f(reflected)
        if fr < values[0]:
            far = centre + 2 * (centre - points[-1])
            fe = f(far)
            points[-1], values[-1] = (far, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            near = centre + 0.5 * ((reflected if fr < values[-1] else points[-1]) - centre)
            fc = f(near)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = near, fc
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[values.argmin()] if n else x0


def pcca_memberships(t: np.ndarray, m: int, pi: np.ndarray | None = None) -> np.ndarray:
    """Robust Perron cluster analysis (Roeblitz and Weber 2013) of a reversible matrix; of a disconnected one,
    each closed set is a cluster, and further clusters go to the sets in proportion to their slow processes."""
    n = len(t)
    if m < 1 or m > n:
        raise ValueError("number of sets out of range")
    closed = graph.closed_sets(t)
    if len(closed) > m:
        raise ValueError("more closed sets than metastable sets")
    if len(closed) == 1 and len(closed[0]) == n:
        return _pcca_connected(t, m, pi)
    share = [1] * len(closed)
    inner = [np.sort(np.abs(np.linalg.eigvals(t[np.ix_(s, s)])))[::-1] for s in closed]
    for _ in range(m - len(closed)):
        best = max((i for i in range(len(closed)) if share[i] < len(closed[i])), key=lambda i: inner[i][share[i]], default=None)
        if best is None:
            raise ValueError("more metastable sets than states in closed sets")
        share[best] += 1
    out = np.zeros((n, m))
    column = 0
    for s, k in zip(closed, share):
        out[np.ix_(s, range(column, column + k))] = _pcca_connected(t[np.ix_(s, s)], k, None)
        column += k
    rest = np.setdiff1d(np.arange(n), np.concatenate(closed))
    if len(rest):  # transition states belong to sets by where they end
        ends = np.concatenate(closed)
        out[rest] = np.linalg.solve(np.eye(len(rest)) - t[np.ix_(rest, rest)], t[np.ix_(rest, ends)] @ out[ends])
    return out


def _pcca_connected(t: np.ndarray, m: int, pi: np.ndarray | None) -> np.ndarray:
    n = len(t)
    if m == 1:
        return np.ones((n, 1))
    pi = stationary_distribution(t) if pi is None else pi
    if not is_reversible(t, pi, 1e-6):
        raise ValueError("metastable sets need a reversible matrix")
    v = rdl_decomposition_rev(t, "reversible", pi, m)[0]
    v[:, 0] = 1
    if m == n:
        return np.eye(n)
    a = np.linalg.inv(v[_inner_simplex(v)])

    def crispness(x: np.ndarray) -> float:
        b = a.copy()
        b[1:, 1:] = x.reshape(m - 1, m - 1)
        b = _feasible(b, v)
        return -float((b**2 / np.maximum(b[0], 1e-300)).sum()) if np.isfinite(b).all() else np.inf

    a[1:, 1:] = _nelder_mead(crispness, a[1:, 1:].ravel()).reshape(m - 1, m - 1)
    chi = np.clip(v @ _feasible(a, v), 0, 1)
    return chi / chi.sum(1, keepdims=True)


def pcca(t: np.ndarray, m: int, pi: np.ndarray | None = None) -> PCCAModel:
    pi = stationary_distribution(t, check_inputs=False) if pi is None else pi
    chi = pcca_memberships(t, m, pi)
    pi_coarse = chi.T @ pi
    inner = np.linalg.inv((chi.T * pi) @ chi)
    coarse = inner @ ((chi.T * pi) @ t @ chi)
    return PCCAModel(coarse, pi_coarse, chi, (chi * pi[:, None] / pi_coarse[None, :]).T)


def coarsegrain(t: np.ndarray, m: int) -> np.ndarray:
    coarse = np.clip(pcca(t, m).transition_matrix_coarse, 0, None)
    return coarse / coarse.sum(1, keepdims=True)


def pcca_sets(t, m) -> list[set[int]]:
    return [set(s.tolist()) for s in pcca(t, m).sets]


def pcca_assignments(t, m) -> np.ndarray:
    return pcca(t, m).assignments


def pcca_distributions(t, m) -> np.ndarray:
    return pcca(t, m).metastable_distributions
