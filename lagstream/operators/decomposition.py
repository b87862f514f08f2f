"""Transfer operators from features: VAMP, TICA, DMD, EDMD, kernel methods, scores, sparse dynamics.

Data enter by distributed moments; only d x d matrices reach the driver. Methods on n x n Gram matrices refuse more
than MAX_GRAM rows; KVAD aggregates its Gram products by blocks of landmarks instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.functions import linalg
from lagstream.functions.basis import Identity, Monomials
from lagstream.operators import lag as _lag
from lagstream.operators.moments import Covariance, CovarianceModel, moments, project

MAX_GRAM = 5000


def transformed(df: DataFrame, basis: Callable | None, columns: Sequence[str] = ("x",)) -> DataFrame:
    if basis is None or isinstance(basis, Identity):
        return df
    for c in columns:
        df = _apply(df, basis, c)
    return df


def _apply(df: DataFrame, basis: Callable, column: str) -> DataFrame:
    import pandas as pd

    def f(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(basis(np.stack(x.to_numpy()).astype(float)), float))) if len(x) else x

    f.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn(column, F.pandas_udf(f, "array<double>")(column))


@dataclass
class TransferOperatorModel:
    koopman_matrix: np.ndarray
    instantaneous_obs: Callable = field(default_factory=Identity)
    timelagged_obs: Callable = field(default_factory=Identity)

    operator = property(lambda self: self.koopman_matrix)
    operator_inverse = property(lambda self: np.linalg.pinv(self.koopman_matrix))

    def forward(self, x: np.ndarray, propagate: bool = True) -> np.ndarray:
        f = np.asarray(self.instantaneous_obs(x))
        return f @ self.koopman_matrix if propagate else f

    def backward(self, y: np.ndarray, propagate: bool = True) -> np.ndarray:
        g = np.asarray(self.timelagged_obs(y))
        return g @ self.operator_inverse if propagate else g

    def transform(self, df: DataFrame) -> DataFrame:
        return transformed(df, self.instantaneous_obs)


@dataclass
class CovarianceKoopmanModel:
    """K in the whitened bases U of x and V of y, with its singular values."""

    instantaneous_coefficients: np.ndarray
    singular_values: np.ndarray
    timelagged_coefficients: np.ndarray
    cov: CovarianceModel
    rank_0: int
    rank_t: int
    dim: int | None = None
    var_cutoff: float | None = None
    scaling: str | None = None
    epsilon: float = 1e-10
    lagtime: int = 1
    observable: Callable | None = None

    @staticmethod
    def effective_output_dimension(rank0: int, rankt: int, dim: int | None, var_cutoff: float | None, s: np.ndarray) -> int:
        if dim is None and var_cutoff is not None and var_cutoff < 1:
            share = np.cumsum(s**2) / (s**2).sum()
            return int(min(len(s), np.searchsorted(share, var_cutoff) + 1))
        return min(x for x in (rank0, rankt, dim) if x is not None)

    @property
    def output_dimension(self) -> int:
        return self.effective_output_dimension(self.rank_0, self.rank_t, self.dim, self.var_cutoff, self.singular_values)

    @property
    def cumulative_kinetic_variance(self) -> np.ndarray:
        s = self.singular_values**2
        return np.cumsum(s) / s.sum()

    @property
    def koopman_matrix(self) -> np.ndarray:
        return np.diag(self.singular_values[:self.output_dimension])

    @property
    def feature_component_correlation(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cov.cov_00))
        return self.cov.cov_00 @ self.instantaneous_coefficients[:, :self.output_dimension] / d[:, None]

    def _scale(self) -> np.ndarray:
        s = self.singular_values[:self.output_dimension]
        if self.scaling in ("km", "kinetic_map"):
            return s
        if self.scaling in ("cm", "commute_map"):
            return np.sqrt(np.maximum(-self.lagtime / np.log(np.clip(np.abs(s), 1e-300, 1 - 1e-15)), 0) / 2)
        return np.ones(len(s))

    def instantaneous(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x if self.observable is None else self.observable(x))
        return (x - self.cov.mean_0) @ self.instantaneous_coefficients[:, :self.output_dimension] * self._scale()

    def timelagged(self, y: np.ndarray) -> np.ndarray:
        y = np.asarray(y if self.observable is None else self.observable(y))
        return (y - self.cov.mean_t) @ self.timelagged_coefficients[:, :self.output_dimension] * self._scale()

    def transform(self, df: DataFrame, propagate: bool = False) -> DataFrame:
        """Frames projected on the leading components."""
        m = self.instantaneous_coefficients[:, :self.output_dimension] * self._scale()
        return project(df, m * self.singular_values[:self.output_dimension] if propagate else m, self.cov.mean_0, basis=self.observable)

    def forward(self, x: np.ndarray, propagate: bool = True) -> np.ndarray:
        f = self.instantaneous(x)
        return f @ self.koopman_matrix if propagate else f

    def backward(self, y: np.ndarray, propagate: bool = True) -> np.ndarray:
        g = self.timelagged(y)
        return g @ np.linalg.pinv(self.koopman_matrix) if propagate else g

    def propagate(self, x: np.ndarray, components=None) -> np.ndarray:
        """x through the operator and back to features, by the chosen components."""
        k = self.output_dimension
        s = self.singular_values[:k].copy()
        if components is not None:
            s[np.setdiff1d(np.arange(k), np.atleast_1d(components))] = 0
        f = (x - self.cov.mean_0) @ self.instantaneous_coefficients[:, :k] * s
        return f @ np.linalg.pinv(self.timelagged_coefficients[:, :k]) + self.cov.mean_t

    def timescales(self, k: int | None = None, lagtime: float | None = None) -> np.ndarray:
        s = np.abs(self.singular_values[:k])
        with np.errstate(divide="ignore"):
            return -(self.lagtime if lagtime is None else lagtime) / np.log(s)

    def score(self, r, test_model: CovarianceKoopmanModel | None = None, epsilon: float = 1e-6, dim: int | None = None) -> float:
        return vamp_score(self, r, None if test_model is None else test_model.cov, dim, epsilon)

    def expectation(self, observables: np.ndarray, statistics: np.ndarray | None = None, lag_multiple: float = 1, observables_mean_free: bool = False, statistics_mean_free: bool = False):
        """Expectation, or covariance with statistics, of linear observables a multiple of the lag later."""
        k = self.output_dimension
        s = self.singular_values[:k] ** lag_multiple
        u, v = self.instantaneous_coefficients[:, :k], self.timelagged_coefficients[:, :k]
        mean_obs = 0 if observables_mean_free else self.cov.mean_t @ observables
        if statistics is None:
            return mean_obs
        covariance = (statistics.T @ self.cov.cov_00 @ u * s) @ (v.T @ self.cov.cov_tt @ observables)
        mean_stat = 0 if statistics_mean_free else self.cov.mean_0 @ statistics
        return covariance + np.outer(np.atleast_1d(mean_stat), np.atleast_1d(mean_obs)) if not (observables_mean_free or statistics_mean_free) else covariance

    def ck_test(self, models, n_observables: int | None = None, include_lag0: bool = True):
        from lagstream.operators.validation import ck_test

        return ck_test(models, KoopmanObservable(self.instantaneous_coefficients[:, :n_observables], self.timelagged_coefficients[:, :n_observables]), self, include_lag0)


@dataclass
class KoopmanObservable:
    """Observable for Chapman-Kolmogorov tests of covariance models."""

    observables: np.ndarray
    statistics: np.ndarray | None = None
    observables_mean_free: bool = False
    statistics_mean_free: bool = False

    def __call__(self, model, power: float = 1):
        return model.expectation(self.observables, self.statistics, power, self.observables_mean_free, self.statistics_mean_free)


class VAMP:
    """Singular components of the whitened lagged covariance."""

    def __init__(self, lagtime: int | None = None, dim: int | None = None, var_cutoff: float | None = None, scaling: str | None = None, epsilon: float = 1e-6, observable_transform: Callable | None = None, weights: str | None = None):
        self.lagtime, self.dim, self.var_cutoff, self.scaling, self.epsilon = lagtime, dim, var_cutoff, scaling, epsilon
        self.observable, self.weights = observable_transform, weights
        self.covariances = self.covariance_estimator(lagtime)

    def covariance_estimator(self, lagtime: int | None) -> Covariance:
        return Covariance(lagtime or 0, True, True, True, remove_data_mean=True, bessels_correction=False, weights=self.weights)

    def partial_fit(self, df: DataFrame) -> VAMP:
        pairs = self.covariances.pairs(df)
        self.covariances.partial_fit(transformed(pairs, self.observable, ("x", "y")))
        return self

    def fetch_model(self) -> CovarianceKoopmanModel:
        return self.fit_from_covariances(self.covariances.fetch_model())

    def fit(self, data) -> CovarianceKoopmanModel:
        if isinstance(data, CovarianceModel):
            return self.fit_from_covariances(data)
        self.covariances = self.covariance_estimator(self.lagtime)
        return self.partial_fit(data).fetch_model()

    fit_fetch = fit_from_timeseries = fit

    def fit_from_covariances(self, c: CovarianceModel) -> CovarianceKoopmanModel:
        l0, lt = linalg.spd_inv_split(c.cov_00, self.epsilon, True), linalg.spd_inv_split(c.cov_tt, self.epsilon, True)
        u, s, vt = np.linalg.svd(l0.T @ c.cov_0t @ lt, full_matrices=False)
        sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        return CovarianceKoopmanModel(l0 @ (u * sign), s, lt @ (vt.T * sign), c, l0.shape[1], lt.shape[1], self.dim, self.var_cutoff, self.scaling, self.epsilon, c.lagtime or 1, self.observable)


class TICA(VAMP):
    """Reversible variant: one symmetrised covariance for both ends."""

    def __init__(self, lagtime: int | None = None, epsilon: float = 1e-6, dim: int | None = None, var_cutoff: float | None = None, scaling: str | None = "kinetic_map", observable_transform: Callable | None = None, weights: str | None = None):
        super().__init__(lagtime, dim, var_cutoff, scaling, epsilon, observable_transform, weights)

    def covariance_estimator(self, lagtime: int | None) -> Covariance:
        return Covariance(lagtime or 0, True, True, remove_data_mean=True, reversible=bool(lagtime), bessels_correction=False, weights=self.weights)

    def fit_from_covariances(self, c: CovarianceModel) -> CovarianceKoopmanModel:
        if not c.symmetrized or c.cov_0t is None:
            raise ValueError("needs symmetrised lagged covariances")
        values, vectors = linalg.eig_corr(c.cov_00, c.cov_0t, self.epsilon, True)
        vectors = linalg.canonical_signs(vectors.real)
        rank = vectors.shape[1]
        return CovarianceKoopmanModel(vectors, values.real, vectors, c, rank, rank, self.dim, self.var_cutoff, self.scaling, self.epsilon, c.lagtime or 1, self.observable)


# --- scores


def vamp_score(model: CovarianceKoopmanModel, r, test: CovarianceModel | None = None, dim: int | None = None, epsilon: float = 1e-10) -> float:
    """VAMP-r (Schatten norm to the r) or VAMP-E of a model, on its own or other covariances; one more if means were removed."""
    k = model.output_dimension if dim is None else min(dim, model.output_dimension)
    u, v = model.instantaneous_coefficients[:, :k], model.timelagged_coefficients[:, :k]
    c = model.cov if test is None else test
    if r == "E":
        s = np.diag(model.singular_values[:k])
        score = np.trace(2 * s @ u.T @ c.cov_0t @ v - s @ u.T @ c.cov_00 @ u @ s @ v.T @ c.cov_tt @ v)
    else:
        a = linalg.spd_inv_sqrt(u.T @ c.cov_00 @ u, epsilon)
        b = linalg.spd_inv_sqrt(v.T @ c.cov_tt @ v, epsilon)
        score = linalg.schatten_norm(a @ (u.T @ c.cov_0t @ v) @ b, float(r)) ** float(r)
    return float(score + (1 if c.data_mean_removed else 0))


def vamp_score_data(pairs: DataFrame, r=2, epsilon: float = 1e-6, dim: int | None = None, transformation: Callable | None = None) -> float:
    return VAMP(dim=dim, epsilon=epsilon, observable_transform=transformation).fit(pairs).score(r)


def vamp_score_cv(fit: Callable[[DataFrame], CovarianceKoopmanModel], df: DataFrame, lagtime: int, blocksize: int | None = None, n: int = 10, r=2, dim: int | None = None, sliding: bool = True, seed: int = 0) -> np.ndarray:
    """n scores of models fitted on a random half of the (block-split) trajectories, tested on the other."""
    scores = []
    for fold in range(n):
        parts = _lag.blocksplit(df, blocksize, sliding, 0 if sliding else fold % blocksize) if blocksize else df
        parts = _lag.cvsplit(parts, seed, fold)
        model, test = fit(parts.where("not test")), fit(parts.where("test"))
        scores.append(model.score(r, test, dim=dim))
    return np.array(scores)


# --- dynamic mode decomposition


@dataclass
class DMDModel:
    eigenvalues: np.ndarray
    modes: np.ndarray
    mode: str = "exact"

    def transform(self, x: np.ndarray) -> np.ndarray:
        """One step ahead for each row."""
        out = (self.modes.T * self.eigenvalues) @ (np.linalg.pinv(self.modes.T) @ np.asarray(x).T)
        return out.T.real if np.allclose(out.imag, 0) else out.T


class DMD:
    """Modes of the best linear map y = A x by the truncated factorisation of X, from distributed second moments."""

    def __init__(self, mode: str = "exact", rank: int | None = None):
        self.mode, self.rank = mode, rank

    def fit(self, pairs: DataFrame) -> DMDModel:
        m = moments(pairs)
        xx, xy = m.raw("mxx"), m.raw("mxy")
        values, u = np.linalg.eigh(xx)
        keep = np.argsort(values)[::-1][:self.rank]
        keep = keep[values[keep] > values.max() * 1e-13]
        u, s2 = u[:, keep], values[keep]
        small = u.T @ xy.T @ u / s2[None, :]
        lam, w = np.linalg.eig(small)
        order = np.argsort(-np.abs(lam), kind="stable")
        lam, w = lam[order], w[:, order]
        modes = (xy.T @ (u / s2)) @ w / np.where(lam == 0, 1, lam) if self.mode == "exact" else u @ w
        return DMDModel(lam, modes.T, self.mode)

    fit_fetch = fit


@dataclass
class EDMDModel:
    operator: np.ndarray
    basis: Callable
    eigenvalues: np.ndarray
    modes: np.ndarray

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.basis(x)) @ self.modes.T


class EDMD:
    """Koopman (or Perron-Frobenius) operator pinv(C00) C0t in a basis."""

    def __init__(self, basis: Callable, n_eigs: int | None = None, operator: str = "koopman"):
        self.basis, self.n_eigs, self.operator = basis, n_eigs, operator

    def fit(self, pairs: DataFrame) -> EDMDModel:
        m = moments(transformed(pairs, self.basis, ("x", "y")))
        c00, c0t = m.raw("mxx") / m.w, m.raw("mxy") / m.w
        k = np.linalg.pinv(c00) @ (c0t if self.operator == "koopman" else c0t.T)
        values, vectors = linalg.eigs(k, self.n_eigs)
        return EDMDModel(k, self.basis, values, vectors.T)

    fit_fetch = fit


def _local(pairs: DataFrame, what: str) -> tuple[np.ndarray, np.ndarray]:
    rows = pairs.select("x", "y").limit(MAX_GRAM + 1).collect()
    if len(rows) > MAX_GRAM:
        raise ValueError(f"{what} needs a Gram matrix; at most {MAX_GRAM} pairs")
    return np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)


@dataclass
class KernelModel:
    data: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    kernel: object

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.apply(np.asarray(x, float), self.data) @ self.eigenvectors


class KernelEDMD:
    def __init__(self, kernel, epsilon: float = 0.0, n_eigs: int | None = None):
        self.kernel, self.epsilon, self.n_eigs = kernel, epsilon, n_eigs

    def fit(self, pairs: DataFrame) -> KernelModel:
        x, y = _local(pairs, "kernel EDMD")
        g = self.kernel.gram(x) + self.epsilon * np.eye(len(x))
        a = np.linalg.lstsq(g, self.kernel.apply(x, y).T, rcond=None)[0]
        values, vectors = linalg.eigs(a, self.n_eigs)
        return KernelModel(x, values, vectors, self.kernel)

    fit_fetch = fit


class KernelCCA:
    def __init__(self, kernel, n_eigs: int, epsilon: float = 1e-6):
        self.kernel, self.n_eigs, self.epsilon = kernel, n_eigs, epsilon

    def fit(self, pairs: DataFrame) -> KernelModel:
        x, y = _local(pairs, "kernel CCA")
        n = len(x)
        centre = np.eye(n) - 1 / n
        gx, gy = centre @ self.kernel.gram(x) @ centre, centre @ self.kernel.gram(y) @ centre
        ridge = self.epsilon * n * np.eye(n)
        a = np.linalg.solve(gx + ridge, gx) @ np.linalg.solve(gy + ridge, gy)
        values, vectors = linalg.eigs(a, self.n_eigs)
        return KernelModel(x, values.real, np.linalg.solve(gx + ridge, gx @ vectors).real, self.kernel)

    fit_fetch = fit


@dataclass
class KVADModel:
    kernel: object
    koopman_matrix: np.ndarray
    observable_transform: Callable
    singular_values: np.ndarray
    singular_vectors: np.ndarray
    score: float


class KVAD:
    """Kernel embedding variant: chi(x) whitened, chi^T G_yy chi / n^2 summed over blocks of pairs of rows."""

    def __init__(self, kernel, lagtime: int | None = None, dim: int | None = None, epsilon: float = 1e-6, observable_transform: Callable | None = None):
        self.kernel, self.lagtime, self.dim, self.epsilon = kernel, lagtime, dim, epsilon
        self.observable = observable_transform or Identity()

    def fit(self, df: DataFrame) -> KVADModel:
        pairs = df if "y" in df.columns else _lag.lag_pairs(df, self.lagtime)
        x, y = _local(pairs, "KVAD")
        chi = np.asarray(self.observable(x))
        mean = chi.mean(0)
        whitening = linalg.spd_inv_split(np.cov(chi.T, bias=True).reshape(chi.shape[1], -1), self.epsilon, True)
        white = (chi - mean) @ whitening
        g = self.kernel.gram(y)
        m = white.T @ g @ white / len(x) ** 2
        s, v = linalg.spd_truncated_svd(m, self.dim)
        later = (np.asarray(self.observable(y)) - mean) @ whitening
        full = np.column_stack([white @ v, np.ones(len(x))])
        koopman = np.linalg.pinv(full) @ np.column_stack([later @ v, np.ones(len(x))])
        return KVADModel(self.kernel, koopman, self.observable, s, whitening @ v, float(s.sum() + g.mean()))

    fit_fetch = fit


# --- sparse identification of dynamics


def stlsq(theta_theta: np.ndarray, theta_dx: np.ndarray, threshold: float = 0.1, alpha: float = 0.05, max_iter: int = 20) -> np.ndarray:
    """Sequentially thresholded ridge regression from normal equations; a row a target."""
    n, out = len(theta_theta), []
    for b in theta_dx.T:
        active, w = np.ones(n, bool), np.linalg.lstsq(theta_theta, b, rcond=None)[0]
        for _ in range(max_iter):
            new = np.abs(w) >= threshold
            if (new == active).all() and _ > 0:
                break
            active, w = new, np.zeros(n)
            if active.any():
                at = np.flatnonzero(active)
                w[at] = np.linalg.solve(theta_theta[np.ix_(at, at)] + alpha * np.eye(len(at)), b[at])
        out.append(np.where(np.abs(w) >= threshold, w, 0))
    return np.array(out)


@dataclass
class SINDyModel:
    library: Callable
    coefficients: np.ndarray
    input_features: list[str]
    intercept: np.ndarray | float = 0.0

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.library(x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.transform(x) @ self.coefficients.T + self.intercept

    def score(self, x: np.ndarray, y: np.ndarray | None = None, t=None) -> float:
        """Coefficient of determination, the mean over targets."""
        y = np.gradient(x, t if t is not None else 1, axis=0) if y is None else y
        rest, whole = ((y - self.predict(x)) ** 2).sum(0), ((y - y.mean(0)) ** 2).sum(0)
        return float((1 - rest / whole).mean())

    def simulate(self, x0, t, substeps: int = 20) -> np.ndarray:
        out = [np.asarray(x0, float)]
        f = lambda x: self.predict(x[None])[0]
        for a, b in zip(t, t[1:]):
            x, h = out[-1], (b - a) / substeps
            for _ in range(substeps):
                k1 = f(x)
                k2 = f(x + h / 2 * k1)
                k3 = f(x + h / 2 * k2)
                k4 = f(x + h * k3)
                x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
            out.append(x)
        return np.array(out)

    def equations(self, precision: int = 3) -> list[str]:
        names = self.library.names(self.input_features) if hasattr(self.library, "names") else [f"f{i}" for i in range(self.coefficients.shape[1])]
        return [" + ".join(f"{c:.{precision}f} {n}".strip() for c, n in zip(row, names) if c) or "0" for row in self.coefficients]

    def print(self, lhs: list[str] | None = None, precision: int = 3) -> None:
        for name, text in zip(lhs or [f"{f}'" for f in self.input_features], self.equations(precision)):
            print(f"{name} = {text}")


class SINDy:
    """Sparse regression of derivatives on a library. Frames have x and dx (derivatives; from centred differences of t where absent)."""

    def __init__(self, library: Callable | None = None, threshold: float = 0.1, alpha: float = 0.05, max_iter: int = 20, input_features: list[str] | None = None, fit_intercept: bool = False):
        self.library, self.threshold, self.alpha, self.max_iter = library, threshold, alpha, max_iter
        self.input_features, self.fit_intercept = input_features, fit_intercept

    def fit(self, df: DataFrame) -> SINDyModel:
        if "dx" not in df.columns:
            df = derivatives(df)
        d = len(df.select("x").first()["x"])
        library = self.library or Monomials(2, d)
        pairs = drop_bad(df.select("x", F.col("dx").alias("y")))
        both = _apply(pairs, library, "x")
        width = len(np.asarray(library(np.zeros((1, d))))[0])
        padded = both.withColumn("y", F.concat("y", F.array_repeat(F.lit(0.0), max(0, width - d)))) if width >= d else both
        m = moments(padded)
        xx, xy = (m.mxx, m.mxy) if self.fit_intercept else (m.raw("mxx"), m.raw("mxy"))
        w = stlsq(xx, xy[:, :d], self.threshold, self.alpha, self.max_iter)
        intercept = (m.sy[:d] - w @ m.sx) / m.w if self.fit_intercept else 0.0
        return SINDyModel(library, w, self.input_features or [f"x{i}" for i in range(d)], intercept)

    fit_fetch = fit


def drop_bad(df: DataFrame) -> DataFrame:
    bad = lambda c: F.exists(c, lambda v: F.isnan(v) | v.isNull())
    return df.where(~F.coalesce(bad("x") | bad("y"), F.lit(True)))


def derivatives(df: DataFrame, time: str = "t") -> DataFrame:
    """dx by second-order differences of the values and times around a frame; one-sided at the ends."""
    from pyspark.sql import Window

    at = Window.partitionBy("traj_id").orderBy("t")
    before, after = F.lag(F.struct("x", F.col(time).alias("s"))).over(at), F.lead(F.struct("x", F.col(time).alias("s"))).over(at)
    df = df.withColumn("_b", before).withColumn("_a", after)
    hb, ha = F.col(time) - F.col("_b.s"), F.col("_a.s") - F.col(time)
    two = F.transform(F.arrays_zip(F.col("_b.x").alias("p"), F.col("x").alias("q"), F.col("_a.x").alias("r")),
                      lambda z: (hb * hb * z["r"] + (ha * ha - hb * hb) * z["q"] - ha * ha * z["p"]) / (hb * ha * (ha + hb)))
    one = lambda a, b, h: F.zip_with(a, b, lambda p, q: (q - p) / h)
    dx = (F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), two).when(F.col("_a").isNotNull(), one(F.col("x"), F.col("_a.x"), ha))
          .when(F.col("_b").isNotNull(), one(F.col("_b.x"), F.col("x"), hb)))
    return df.withColumn("dx", dx).drop("_a", "_b")
