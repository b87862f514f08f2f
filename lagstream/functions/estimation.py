"""Transition and rate matrices from small count matrices: likelihood maxima, priors, errors, posterior samples."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np

from lagstream.functions import analysis, graph, linalg
from lagstream.functions.analysis import NotConvergedWarning


class NotConnectedWarning(UserWarning):
    """Counts are not connected."""


# --- priors


def prior_neighbor(c, alpha: float = 0.001) -> np.ndarray:
    return alpha * ((c + c.T) > 0)


def prior_const(c, alpha: float = 0.001) -> np.ndarray:
    return np.full(np.shape(c), alpha, float)


def prior_rev(c, alpha: float = -1.0) -> np.ndarray:
    return np.triu(np.full(np.shape(c), alpha, float))


# --- likelihood maxima


def transition_matrix_non_reversible(c) -> np.ndarray:
    c = np.asarray(c, float)
    rows = c.sum(1)
    if (rows == 0).any():
        raise ValueError("a state has no outgoing counts")
    return c / rows[:, None]


def transition_matrix_reversible_pisym(c, return_statdist: bool = False):
    """Row-normalised symmetrisation of pi T of the non-reversible estimate."""
    t = transition_matrix_non_reversible(c)
    x = analysis.stationary_distribution(t)[:, None] * t
    x = x + x.T
    out = x / x.sum(1, keepdims=True)
    return (out, x.sum(1) / x.sum()) if return_statdist else out


def mle_trev(c, maxerr: float = 1e-12, maxiter: int = 1_000_000, return_statdist: bool = False, eps_mu: float = 1e-15):
    """Reversible maximum likelihood by the fixed point x_i = sum_j (c_ij + c_ji) / (c_i / x_i + c_j / x_j)."""
    c = np.asarray(c, float)
    both, rows = c + c.T, c.sum(1)
    if (both.sum(1) == 0).any():
        raise ValueError("a state has no counts")
    if not graph.is_connected(c):
        raise ValueError("counts are not strongly connected")
    x = both.sum(1) / both.sum()
    for _ in range(maxiter):
        q = rows / x
        new = (both / (q[:, None] + q[None, :])).sum(1)
        new /= new.sum()
        if (new <= eps_mu).any():
            raise ValueError("a stationary probability vanishes")
        change = np.abs(new - x).max() if len(x) == 1 else np.max(np.abs(new - x) / (0.5 * (new + x)))
        x = new
        if change <= maxerr:
            break
    else:
        warnings.warn("reversible estimation did not converge", NotConvergedWarning, stacklevel=2)
    q = rows / x
    flow = both / (q[:, None] + q[None, :])
    t = flow / flow.sum(1, keepdims=True)
    return (t, flow.sum(1) / flow.sum()) if return_statdist else t


def mle_trev_given_pi(c, mu, maxerr: float = 1e-12, maxiter: int = 1_000_000) -> np.ndarray:
    """Reversible maximum likelihood with a given stationary vector, by its Lagrange multipliers."""
    c, mu = np.asarray(c, float), np.asarray(mu, float)
    if (mu <= 0).any():
        raise ValueError("stationary probabilities must be positive")
    both = c + c.T
    lam = both.sum(1) / 2
    if (lam == 0).any():
        raise ValueError("a state has no counts")
    for _ in range(maxiter):
        share = both * mu[None, :] / (lam[:, None] * mu[None, :] + lam[None, :] * mu[:, None])
        new = (lam[:, None] * share).sum(1)
        gone = ((new - lam) ** 2).sum()
        lam = new
        if gone < maxerr**2 * max(1.0, (lam**2).sum()):
            break
    else:
        warnings.warn("estimation with given stationary vector did not converge", NotConvergedWarning, stacklevel=2)
    t = both * mu[None, :] / (lam[:, None] * mu[None, :] + lam[None, :] * mu[:, None])
    np.fill_diagonal(t, 0)
    np.fill_diagonal(t, np.clip(1 - t.sum(1), 0, None))
    return t / t.sum(1, keepdims=True)


def transition_matrix(c, reversible: bool = False, mu=None, maxiter: int = 1_000_000, maxerr: float = 1e-8, rev_pisym: bool = False, return_statdist: bool = False):
    if not reversible:
        if mu is not None:
            raise NotImplementedError("a given stationary vector needs a reversible estimate")
        t = transition_matrix_non_reversible(c)
        return (t, analysis.stationary_distribution(t)) if return_statdist else t
    if mu is not None:
        t = mle_trev_given_pi(c, mu, maxerr, maxiter)
        return (t, np.asarray(mu) / np.sum(mu)) if return_statdist else t
    return transition_matrix_reversible_pisym(c, return_statdist) if rev_pisym else mle_trev(c, maxerr, maxiter, return_statdist)


def correct_transition_matrix(t) -> np.ndarray:
    """Rows that fall short are filled on the diagonal up to the largest row sum, then all are scaled by it."""
    rows = t.sum(1)
    return (t + np.diag(rows.max() - rows)) / rows.max()


def estimate_p(c, reversible: bool = True, fixed_statdist=None, maxerr: float = 1e-8, mincount: float = 0) -> np.ndarray:
    """An estimate on each connected set; states without counts stay where they are."""
    c, out = np.asarray(c, float), np.eye(len(c))
    for s in graph.compute_connected_sets(c, mincount, directed=reversible):
        inner = c[np.ix_(s, s)]
        if len(s) > 1 and inner.sum() > 0:
            mu = None if fixed_statdist is None else fixed_statdist[s] / fixed_statdist[s].sum()
            rows = inner.sum(1) > 0
            part = np.eye(len(s))
            part[rows] = transition_matrix(inner, reversible, mu, maxerr=maxerr)[rows] if reversible or mu is not None else inner[rows] / inner[rows].sum(1, keepdims=True)
            out[np.ix_(s, s)] = part
    return out


def transition_matrix_partial_rev(c, p, s, maxerr: float = 1e-8) -> np.ndarray:
    """p with the rows of the sets in s reversible inside and as counted outwards."""
    out = np.array(p, float)
    for chosen in s:
        rest = np.setdiff1d(np.arange(len(c)), chosen)
        inner, rows = c[np.ix_(chosen, chosen)], c[chosen].sum(1)
        stay = inner.sum(1) / np.where(rows > 0, rows, 1)
        out[np.ix_(chosen, chosen)] = mle_trev(inner, maxerr) * stay[:, None] if len(chosen) > 1 else stay[:, None]
        out[np.ix_(chosen, rest)] = c[np.ix_(chosen, rest)] / np.where(rows > 0, rows, 1)[:, None]
    return out


def enforce_reversible_on_closed(p) -> np.ndarray:
    out = np.array(p, float)
    for s in graph.closed_sets(p):
        inner = p[np.ix_(s, s)]
        x = analysis.stationary_distribution(inner)[:, None] * inner
        x = x + x.T
        out[np.ix_(s, s)] = x / x.sum(1, keepdims=True)
    return out


def stationary_distribution(p, c=None, mincount: float = 0) -> np.ndarray:
    """Stationary vectors of the weakly connected sets, weighted by their share of counts (of states without counts)."""
    out = np.zeros(len(p))
    for s in graph.compute_connected_sets(p if c is None else c, mincount, directed=False):
        weight = len(s) / len(p) if c is None else c[s].sum() / c.sum()
        for closed in graph.closed_sets(p[np.ix_(s, s)])[:1]:
            out[s[closed]] = weight * analysis.stationary_distribution(p[np.ix_(s[closed], s[closed])])
    return out / out.sum()


def log_likelihood(c, t) -> float:
    c, t = np.asarray(c, float), np.asarray(t, float)
    some = (t > 0) & (c != 0)
    return float((c[some] * np.log(t[some])).sum())


# --- errors


def dirichlet_covariance(alpha) -> np.ndarray:
    alpha = np.asarray(alpha, float)
    whole = alpha.sum()
    return (whole * np.diag(alpha) - np.outer(alpha, alpha)) / (whole**2 * (whole + 1))


def tmatrix_cov(c, k: int | None = None) -> np.ndarray:
    """Covariances of the rows of the posterior of c + 1; all rows, or row k."""
    return dirichlet_covariance(c[k] + 1) if k is not None else np.stack([dirichlet_covariance(r + 1) for r in np.asarray(c, float)])


def error_perturbation_single(c, s, r=None) -> float:
    r = s if r is None else r
    return float(np.einsum("ij,ijk,ik->", s, tmatrix_cov(c), r))


def error_perturbation_cov(c, s) -> np.ndarray:
    return np.array([[error_perturbation_single(c, a, b) for b in s] for a in s])


def error_perturbation(c, s):
    return error_perturbation_single(c, s) if np.ndim(s) == 2 else error_perturbation_cov(c, s)


# --- posterior samples


class SamplerNonRev:
    """Independent Dirichlet rows of counts + 1."""

    def __init__(self, c, seed: int = 0):
        self.c, self.rng = np.asarray(c, float), np.random.default_rng(seed)

    def sample(self, n: int = 1) -> np.ndarray:
        x = self.rng.gamma(self.c + 1)
        return x / x.sum(1, keepdims=True)


class SamplerRev:
    """Metropolis steps over a symmetric flow x with T = x / row sums; density prod x^(c-1) (row sums)^(-c_i) on the pattern of counts."""

    def __init__(self, c, p0=None, seed: int = 0):
        self.c, self.rng = np.asarray(c, float), np.random.default_rng(seed)
        p0 = mle_trev(c) if p0 is None else np.asarray(p0)
        x = analysis.stationary_distribution(p0)[:, None] * p0
        self.x = (x + x.T) / 2
        self.pairs = [(i, j) for i in range(len(self.c)) for j in range(i, len(self.c)) if self.c[i, j] + self.c[j, i] > 0]

    def _log(self, i, j, value, rows) -> float:
        c = self.c
        weight = c[i, j] + c[j, i] if i != j else c[i, i]
        out = weight * np.log(value) - c[i].sum() * np.log(rows[i])
        return out - (c[j].sum() * np.log(rows[j]) if i != j else 0)

    def sample(self, n: int = 1) -> np.ndarray:
        rows = self.x.sum(1)
        for _ in range(n):
            for i, j in self.pairs:
                old = self.x[i, j]
                new = old * np.exp(self.rng.normal(0, 0.5))
                after = rows.copy()
                after[i] += new - old
                if i != j:
                    after[j] += new - old
                # the sparse prior 1/x cancels the Jacobian of the logarithmic step
                if np.log(self.rng.random()) < self._log(i, j, new, after) - self._log(i, j, old, rows):
                    self.x[i, j] = self.x[j, i] = new
                    rows = after
            self.x /= rows.sum()
            rows = self.x.sum(1)
        return self.x / rows[:, None]


class SamplerRevPi:
    """Metropolis steps that move weight between an off-diagonal pair and its diagonals, so pi stays."""

    def __init__(self, c, pi, p0=None, seed: int = 0):
        self.c, self.pi, self.rng = np.asarray(c, float), np.asarray(pi, float), np.random.default_rng(seed)
        self.t = mle_trev_given_pi(c, pi) if p0 is None else np.array(p0, float)
        both = self.c + self.c.T
        self.pairs = [(i, j) for i in range(len(self.c)) for j in range(i) if both[i, j] > 0]

    def sample(self, n: int = 1) -> np.ndarray:
        t, c, pi = self.t, self.c, self.pi
        for _ in range(n):
            for i, j in self.pairs:
                room = min(t[i, i] + t[i, j], (t[j, j] + t[j, i]) * pi[j] / pi[i])
                new = self.rng.random() * room
                back = pi[i] / pi[j] * new
                di, dj = t[i, i] + t[i, j] - new, t[j, j] + t[j, i] - back
                if min(new, di, dj) <= 0:
                    continue

                def log(a, b, x, y):
                    return (c[i, j] * np.log(a) + c[j, i] * np.log(b) + (c[i, i] * np.log(x) if c[i, i] else 0) + (c[j, j] * np.log(y) if c[j, j] else 0))

                tiny = 1e-300
                now = log(max(t[i, j], tiny), max(t[j, i], tiny), max(t[i, i], tiny), max(t[j, j], tiny))
                if np.log(self.rng.random()) < log(new, back, di, dj) - now:
                    t[i, j], t[j, i], t[i, i], t[j, j] = new, back, di, dj
        return t.copy()


def tmatrix_sampler(c, reversible: bool = False, mu=None, t0=None, seed: int = 0):
    if mu is not None and not reversible:
        raise ValueError("a given stationary vector needs reversible samples")
    return SamplerRevPi(c, mu, t0, seed) if mu is not None else SamplerRev(c, t0, seed) if reversible else SamplerNonRev(c, seed)


def sample_tmatrix(c, nsample: int = 1, nsteps: int | None = None, reversible: bool = False, mu=None, t0=None, seed: int = 0) -> list[np.ndarray]:
    sampler = tmatrix_sampler(c, reversible, mu, t0, seed)
    steps = nsteps or max(1, int(np.sqrt(len(c))))
    return [sampler.sample(steps) for _ in range(nsample)]


def bootstrapping_count_matrix(c, nbs: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the singular values under multinomial resampling of all counts."""
    c, rng = np.asarray(c, float), np.random.default_rng(seed)
    n = int(c.sum())
    values = np.array([np.linalg.svd(rng.multinomial(n, (c / c.sum()).ravel()).reshape(c.shape), compute_uv=False) for _ in range(nbs)])
    return values.mean(0), values.std(0)


# --- rate matrices


def _generator(k) -> np.ndarray:
    k = np.clip(k - np.diag(np.diagonal(k)), 0, None)
    return k - np.diag(k.sum(1))


def pseudo_generator(c, dt: float = 1.0) -> np.ndarray:
    t = mle_trev(c)
    return (t - np.eye(len(t))) / dt


def truncated_log_generator(c, dt: float = 1.0) -> np.ndarray:
    """Real part of log(T) / dt of the reversible estimate, negatives cut."""
    return _generator(linalg.matrix_log(mle_trev(c)).real / dt)


def _reversible_rates(x, pi, pairs) -> np.ndarray:
    k = np.zeros((len(pi), len(pi)))
    for v, (i, j) in zip(x, pairs):
        k[i, j], k[j, i] = v / pi[i], v / pi[j]
    return k - np.diag(k.sum(1))


def _projected(f, x, rounds: int, tol: float) -> np.ndarray:
    """Projected gradient with backtracking for non-negative x; gradients by differences."""
    step, value = 0.1, f(x)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(x), 1e-3)
        g = np.array([(f(x + e) - f(np.maximum(x - e, 0))) / (h[i] + min(h[i], x[i])) for i, e in enumerate(np.diag(h))])
        while step > 1e-14:
            new = np.maximum(x - step * g, 0)
            after = f(new)
            if after < value - 1e-12 * abs(value):
                break
            step /= 2
        else:
            break
        done = abs(value - after) <= tol * max(1, abs(value))
        x, value, step = new, after, step * 3
        if done:
            break
    return x


def rate_matrix(c, dt: float = 1.0, method: str = "KL", sparsity=None, pi=None, tol: float = 1e-9, k0=None, maxiter: int = 500) -> np.ndarray:
    """Reversible generator: pseudo, truncated_log, CVE (least squares to the transition matrix) or KL (maximum likelihood)."""
    c = np.asarray(c, float)
    if not graph.is_connected(c):
        warnings.warn("counts are not connected", NotConnectedWarning, stacklevel=2)
    if method == "pseudo":
        return pseudo_generator(c, dt)
    if method == "truncated_log":
        return truncated_log_generator(c, dt)
    if method not in ("CVE", "KL"):
        raise ValueError(f"unknown method {method}")
    t, own = mle_trev(c, return_statdist=True)
    pi = own if pi is None else np.asarray(pi, float)
    pattern = (c + c.T > 0) if sparsity is None else (np.asarray(sparsity) + np.asarray(sparsity).T > 0)
    pairs = [(i, j) for i in range(len(c)) for j in range(i) if pattern[i, j]]
    start = truncated_log_generator(c, dt) if k0 is None else k0
    x = np.maximum(np.array([(pi[i] * start[i, j] + pi[j] * start[j, i]) / 2 for i, j in pairs]), 1e-6)

    def cve(x):
        return float((pi[:, None] * (linalg.matrix_exp(_reversible_rates(x, pi, pairs) * dt) - t) ** 2).sum())

    def kl(x):
        p = linalg.matrix_exp(_reversible_rates(x, pi, pairs) * dt)
        return -float((c[c > 0] * np.log(np.maximum(p[c > 0], 1e-300))).sum()) / c.sum()

    return _reversible_rates(_projected(cve if method == "CVE" else kl, x, maxiter, tol), pi, pairs)
