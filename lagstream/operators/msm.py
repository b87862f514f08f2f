"""Markov state models: estimators over distributed counts, and the analysis of what they fit."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.functions import analysis, estimation, flux, graph, linalg
from lagstream.operators import counts as _counts
from lagstream.operators import states as _states
from lagstream.operators import validation
from lagstream.operators.counts import TransitionCountEstimator, TransitionCountModel


class MarkovStateModel:
    """A transition matrix with its stationary vector and, where known, the counts it came from."""

    def __init__(self, transition_matrix, stationary_distribution=None, reversible: bool | None = None, count_model: TransitionCountModel | None = None, lagtime: int | None = None, tol: float = 1e-8):
        self.count_model = count_model
        self.lagtime = lagtime or (count_model.lagtime if count_model else 1)
        self.tol, self._pi, self._reversible = tol, stationary_distribution, reversible
        self.update_transition_matrix(transition_matrix)

    def update_transition_matrix(self, value) -> None:
        value = np.asarray(value, float)
        if not analysis.is_transition_matrix(value, self.tol):
            raise ValueError("not a transition matrix")
        self.transition_matrix = value

    def update_stationary_distribution(self, value) -> None:
        if value is not None and (len(value) != self.n_states or not np.isclose(np.sum(value), 1)):
            raise ValueError("not a distribution over the states")
        self._pi = value

    n_states = property(lambda self: len(self.transition_matrix))

    @property
    def stationary_distribution(self) -> np.ndarray:
        if self._pi is None:
            self._pi = analysis.stationary_distribution(self.transition_matrix)
        return self._pi

    @property
    def reversible(self) -> bool:
        if self._reversible is None:
            self._reversible = analysis.is_reversible(self.transition_matrix, self.stationary_distribution, 1e-8)
        return self._reversible

    def copy(self) -> MarkovStateModel:
        return copy.deepcopy(self)

    def submodel(self, states) -> MarkovStateModel:
        states = np.atleast_1d(states)
        t = self.transition_matrix[np.ix_(states, states)]
        return MarkovStateModel(t / t.sum(1, keepdims=True), count_model=self.count_model.submodel(states) if self.count_model else None, lagtime=self.lagtime)

    def eigenvalues(self, k: int | None = None) -> np.ndarray:
        return analysis.eigenvalues(self.transition_matrix, k, self.reversible, self.stationary_distribution if self.reversible else None)

    def eigenvectors_left(self, k: int | None = None) -> np.ndarray:
        return analysis.rdl_decomposition(self.transition_matrix, k)[2]

    def eigenvectors_right(self, k: int | None = None) -> np.ndarray:
        return analysis.rdl_decomposition(self.transition_matrix, k)[0]

    def timescales(self, k: int | None = None) -> np.ndarray:
        return analysis.timescales_from_eigenvalues(self.eigenvalues(None if k is None else k + 1), self.lagtime)[1:]

    def propagate(self, p0, k: int) -> np.ndarray:
        p = np.asarray(p0, float) @ np.linalg.matrix_power(self.transition_matrix, k)
        return p / p.sum()

    def mfpt(self, a, b) -> float:
        return analysis.mfpt(self.transition_matrix, b, a, self.lagtime, self.stationary_distribution)

    def committor_forward(self, a, b) -> np.ndarray:
        return analysis.committor(self.transition_matrix, a, b)

    def committor_backward(self, a, b) -> np.ndarray:
        return analysis.committor(self.transition_matrix, a, b, False, self.stationary_distribution)

    def hitting_probability(self, target) -> np.ndarray:
        return analysis.hitting_probability(self.transition_matrix, target)

    def expectation(self, a) -> float:
        return float(self.stationary_distribution @ np.asarray(a))

    def _times(self, maxtime) -> np.ndarray:
        its = self.timescales(1)
        maxtime = 5 * its[0] if maxtime is None else maxtime
        return np.arange(int(np.ceil(maxtime / self.lagtime)) + 1)

    def correlation(self, a, b=None, maxtime=None) -> tuple[np.ndarray, np.ndarray]:
        steps = self._times(maxtime)
        return steps * self.lagtime, analysis.correlation(self.transition_matrix, a, b, steps, self.stationary_distribution)

    def relaxation(self, p0, a, maxtime=None) -> tuple[np.ndarray, np.ndarray]:
        steps = self._times(maxtime)
        return steps * self.lagtime, analysis.relaxation(self.transition_matrix, p0, a, steps)

    def fingerprint_correlation(self, a, b=None, k=None):
        return analysis.fingerprint_correlation(self.transition_matrix, a, b, self.lagtime, k)

    def fingerprint_relaxation(self, p0, a, k=None):
        return analysis.fingerprint_relaxation(self.transition_matrix, p0, a, self.lagtime, k)

    def pcca(self, n: int) -> analysis.PCCAModel:
        if not self.reversible:
            raise ValueError("metastable sets need a reversible model")
        return analysis.pcca(self.transition_matrix, n, self.stationary_distribution)

    def reactive_flux(self, source, target) -> flux.ReactiveFlux:
        return flux.reactive_flux(self.transition_matrix, source, target, self.stationary_distribution)

    def simulate(self, n_steps: int, start: int | None = None, stop=None, dt: int = 1, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        t = np.linalg.matrix_power(self.transition_matrix, dt)
        cumulative, stop = t.cumsum(1), set() if stop is None else set(np.atleast_1d(stop).tolist())
        now = rng.choice(self.n_states, p=self.stationary_distribution) if start is None else start
        out = [int(now)]
        while len(out) < n_steps and out[-1] not in stop:
            out.append(int(min(np.searchsorted(cumulative[out[-1]], rng.random(), side="right"), self.n_states - 1)))
        return np.array(out)

    def ck_test(self, models, n_metastable_sets: int, include_lag0: bool = True):
        return validation.ck_test(models, MembershipsObservable(self, self.pcca(n_metastable_sets).memberships), self, include_lag0)

    def compute_trajectory_weights(self, dtraj: DataFrame) -> DataFrame:
        """w of each frame: pi[s] / hist[s], normalised over all frames of active states."""
        symbols = self.count_model.state_symbols if self.count_model else np.arange(self.n_states)
        hist = _counts.count_states(dtraj)
        pi = dtraj.sparkSession.createDataFrame([(int(s), float(p)) for s, p in zip(symbols, self.stationary_distribution)], "symbol int, pi double")
        weights = hist.join(pi, F.col("state") == F.col("symbol")).select("symbol", (F.col("pi") / F.col("n")).alias("w0"), "pi")
        whole = weights.agg(F.sum("pi")).first()[0]
        out = dtraj.join(weights, F.col("state") == F.col("symbol"), "left")
        return out.withColumn("w", F.coalesce(F.col("w0") / F.lit(whole), F.lit(0.0))).drop("symbol", "w0", "pi")

    def compute_state_indices(self, dtraj: DataFrame) -> DataFrame:
        return _states.index_states(self.count_model.transform_discrete_trajectories_to_submodel(dtraj) if self.count_model else dtraj)

    @property
    def koopman_model(self):
        return self._svd_model(self.stationary_distribution)

    @property
    def empirical_koopman_model(self):
        c = self.count_model.count_matrix
        return self._svd_model(c.sum(1) / c.sum(), c.sum(0) / c.sum())

    def _svd_model(self, p0, pt=None):
        from lagstream.operators.decomposition import CovarianceKoopmanModel
        from lagstream.operators.moments import CovarianceModel

        pt = p0 @ self.transition_matrix if pt is None else pt
        c0, c0t, ctt = np.diag(p0), p0[:, None] * self.transition_matrix, np.diag(pt)
        a, b = 1 / np.sqrt(np.maximum(p0, 1e-300)), 1 / np.sqrt(np.maximum(pt, 1e-300))
        u, s, vt = np.linalg.svd(a[:, None] * c0t * b[None, :])
        cov = CovarianceModel(c0, c0t, ctt, np.zeros(len(p0)), np.zeros(len(p0)), False, False, self.lagtime, False)
        return CovarianceKoopmanModel(a[:, None] * u, s, b[:, None] * vt.T, cov, len(s), len(s), lagtime=self.lagtime)

    def score(self, dtraj: DataFrame | None = None, r=2, dim: int | None = None) -> float:
        """VAMP score, on the model's or a test table's counts of its states."""
        model = self.empirical_koopman_model
        if dtraj is None:
            return model.score(r, dim=dim)
        from lagstream.operators.moments import CovarianceModel

        full = TransitionCountEstimator(self.lagtime, n_states=self.count_model.n_states_full).fit(dtraj).count_matrix
        c = full[np.ix_(self.count_model.state_symbols, self.count_model.state_symbols)]
        c = c / c.sum()
        test = CovarianceModel(np.diag(c.sum(1)), c, np.diag(c.sum(0)), np.zeros(len(c)), np.zeros(len(c)), False, False, self.lagtime, False)
        return model.score(r, type(model)(model.instantaneous_coefficients, model.singular_values, model.timelagged_coefficients, test, len(c), len(c)), dim=dim)

    def hmm(self, dtraj: DataFrame, n_hidden: int):
        """Coarse-grained to a hidden model, started from metastable sets."""
        from lagstream.operators import hmm

        its = self.timescales()
        if n_hidden - 1 < len(its) and its[n_hidden - 2] / its[n_hidden - 1] < 1.5:
            warnings.warn("no gap between the timescales kept and left out", stacklevel=2)
        return hmm.MaximumLikelihoodHMM(hmm.metastable_from_msm(self, n_hidden), self.lagtime).fit(dtraj)


@dataclass
class MembershipsObservable:
    """Probability to go between fuzzy sets."""

    test_model: MarkovStateModel
    memberships: np.ndarray
    initial_distribution: np.ndarray | None = None

    def __call__(self, model: MarkovStateModel, power: float = 1) -> np.ndarray:
        chi, pi = self.memberships, self.test_model.stationary_distribution if self.initial_distribution is None else self.initial_distribution
        start = (chi * pi[:, None] / (chi.T @ pi)[None, :]).T
        if model.n_states != self.test_model.n_states and model.count_model and self.test_model.count_model:
            common = np.intersect1d(model.count_model.state_symbols, self.test_model.count_model.state_symbols)
            own, ref = model.count_model.symbols_to_states(common), self.test_model.count_model.symbols_to_states(common)
            begin, end = np.zeros((chi.shape[1], model.n_states)), np.zeros((model.n_states, chi.shape[1]))
            begin[:, own] = start[:, ref] / start[:, ref].sum(1, keepdims=True)
            end[own] = chi[ref]
            start, chi = begin, end
        return np.real(start @ linalg.matrix_power(model.transition_matrix, power) @ chi)


class MarkovStateModelCollection(MarkovStateModel):
    """A model for each connected set; one is current."""

    def __init__(self, models: Sequence[MarkovStateModel]):
        self.models = list(models)
        self.select(0)

    def select(self, i: int) -> MarkovStateModelCollection:
        self.__dict__.update({k: v for k, v in vars(self.models[i]).items()})
        self.current_model = i
        return self

    n_connected_msms = property(lambda self: len(self.models))

    def state_symbols(self, i: int | None = None) -> np.ndarray:
        return self.models[self.current_model if i is None else i].count_model.state_symbols

    @property
    def state_fractions(self) -> list[float]:
        return [m.count_model.selected_state_fraction for m in self.models]

    @property
    def count_fractions(self) -> list[float]:
        return [m.count_model.selected_count_fraction for m in self.models]


class MaximumLikelihoodMSM:
    def __init__(self, reversible: bool = True, stationary_distribution_constraint=None, allow_disconnected: bool = False, maxiter: int = 1_000_000, maxerr: float = 1e-8, lagtime: int | None = None,
                 connectivity_threshold: float = 0.0, use_lcc: bool = False):
        self.reversible, self.constraint, self.allow_disconnected = reversible, stationary_distribution_constraint, allow_disconnected
        self.maxiter, self.maxerr, self.lagtime, self.threshold, self.use_lcc = maxiter, maxerr, lagtime, connectivity_threshold, use_lcc

    def fit(self, data, lagtime: int | None = None, count_mode: str = "sliding") -> MarkovStateModelCollection:
        if isinstance(data, DataFrame):
            return self.fit_from_discrete_timeseries(data, lagtime or self.lagtime, count_mode)
        return self.fit_from_counts(data)

    fit_fetch = fit

    def fit_from_discrete_timeseries(self, dtraj: DataFrame, lagtime: int, count_mode: str = "sliding") -> MarkovStateModelCollection:
        if lagtime is None:
            raise ValueError("a lag time is needed")
        return self.fit_from_counts(TransitionCountEstimator(lagtime, count_mode).fit(dtraj))

    def _one(self, c: TransitionCountModel) -> MarkovStateModel:
        mu = None
        if self.constraint is not None:
            mu = np.asarray(self.constraint)[c.state_symbols]
            mu = mu / mu.sum()
        t, pi = estimation.transition_matrix(c.count_matrix, self.reversible, mu, self.maxiter, self.maxerr, return_statdist=True) if self.reversible else (estimation.transition_matrix_non_reversible(c.count_matrix), None)
        return MarkovStateModel(t, pi, self.reversible or None, c)

    def fit_from_counts(self, c) -> MarkovStateModelCollection:
        c = c if isinstance(c, TransitionCountModel) else TransitionCountModel(c)
        if self.allow_disconnected and not self.reversible:
            return MarkovStateModelCollection([self._one(c)])
        strong = self.reversible and self.constraint is None
        sets = c.connected_sets(self.threshold, directed=strong, probability_constraint=self.constraint)
        models = []
        for s in sets[:1] if self.use_lcc else sets:
            try:
                models.append(self._one(c.submodel(s)))
            except ValueError:
                continue
        if not models:
            raise ValueError("no connected set could be estimated")
        return MarkovStateModelCollection(models)


@dataclass
class BayesianMSMPosterior(validation.BayesianModel):
    prior: MarkovStateModel = None
    samples: list[MarkovStateModel] = field(default_factory=list)

    def submodel(self, states) -> BayesianMSMPosterior:
        return BayesianMSMPosterior(self.prior.submodel(states), [s.submodel(states) for s in self.samples])

    def timescales(self, k=None):
        return self.prior.timescales(k), np.array([s.timescales(k) for s in self.samples])

    def ck_test(self, models, n_metastable_sets: int, include_lag0: bool = True, err_est: bool = False):
        return validation.ck_test(models, MembershipsObservable(self.prior, self.prior.pcca(n_metastable_sets).memberships), self, include_lag0, err_est)


class BayesianMSM:
    """Posterior samples around the likelihood maximum."""

    def __init__(self, n_samples: int = 100, n_steps: int | None = None, reversible: bool = True, stationary_distribution_constraint=None, lagtime: int | None = None, seed: int = 0):
        self.n_samples, self.n_steps, self.reversible, self.constraint, self.lagtime, self.seed = n_samples, n_steps, reversible, stationary_distribution_constraint, lagtime, seed

    def sample(self, prior: MarkovStateModel, n: int, callback: Callable | None = None) -> list[MarkovStateModel]:
        c = prior.count_model
        mu = prior.stationary_distribution if self.constraint is not None else None
        sampler = estimation.tmatrix_sampler(c.count_matrix, self.reversible, mu, prior.transition_matrix if self.reversible else None, self.seed)
        out = []
        for _ in range(n):
            out.append(MarkovStateModel(sampler.sample(self.n_steps or max(1, int(np.sqrt(prior.n_states)))), mu, self.reversible, c, prior.lagtime))
            if callback:
                callback()
        return out

    def fit_from_msm(self, msm: MarkovStateModel, callback=None) -> BayesianMSMPosterior:
        return BayesianMSMPosterior(prior=msm, samples=self.sample(msm, self.n_samples, callback))

    def fit_from_counts(self, c, callback=None) -> BayesianMSMPosterior:
        return self.fit_from_msm(MaximumLikelihoodMSM(self.reversible, self.constraint).fit_from_counts(c).models[0], callback)

    def fit_from_discrete_timeseries(self, dtraj: DataFrame, lagtime: int | None = None, count_mode: str = "effective", callback=None) -> BayesianMSMPosterior:
        return self.fit_from_counts(TransitionCountEstimator(lagtime or self.lagtime, count_mode).fit(dtraj).submodel_largest(), callback)

    def fit(self, data, callback=None, **kw) -> BayesianMSMPosterior:
        return self.fit_from_discrete_timeseries(data, callback=callback, **kw) if isinstance(data, DataFrame) else self.fit_from_counts(data, callback)

    fit_fetch = fit


class AugmentedMSMEstimator:
    """A reversible model whose stationary averages of features meet measurements within their errors.

    The stationary vector is tilted, pi ~ pi_0 exp(sum of multipliers times features); multipliers maximise the
    likelihood of counts and of Gaussian measurements by damped Newton steps. Measurements outside the features' range stay out."""

    def __init__(self, expectations_by_state, experimental_measurements, experimental_measurement_weights, eps: float = 0.05, maxiter: int = 500, maxerr: float = 1e-8):
        self.e, self.m, self.w = np.asarray(expectations_by_state, float), np.asarray(experimental_measurements, float), np.asarray(experimental_measurement_weights, float)
        self.eps, self.maxiter, self.maxerr = eps, maxiter, maxerr

    @staticmethod
    def from_trajectories(dtraj: DataFrame, features: DataFrame, n_states: int, measurements, sigmas, **kw) -> AugmentedMSMEstimator:
        rows = _states.state_means(dtraj, features).toPandas()
        e = np.zeros((n_states, len(measurements)))
        e[rows["state"].to_numpy(int), rows["p"].to_numpy(int)] = rows["mean"]
        return AugmentedMSMEstimator(e, measurements, 1 / (2 * np.asarray(sigmas, float) ** 2), **kw)

    def fit(self, c) -> AugmentedMSM:
        c = c if isinstance(c, TransitionCountModel) else TransitionCountModel(c)
        sub = c.submodel_largest()
        e = self.e[sub.state_symbols]
        inside = (self.m > e.min(0)) & (self.m < e.max(0))
        _, pi0 = estimation.mle_trev(sub.count_matrix, return_statdist=True)
        lam, log = np.zeros(e.shape[1]), np.log(pi0)
        for _ in range(self.maxiter):
            x = log + e[:, inside] @ lam[inside]
            pi = np.exp(x - x.max())
            pi /= pi.sum()
            mean = pi @ e
            gap = (self.m - mean - lam / (2 * self.w))[inside]
            cov = (e[:, inside] - mean[inside]).T @ ((e[:, inside] - mean[inside]) * pi[:, None]) + np.diag(1 / (2 * self.w[inside]))
            step = np.linalg.lstsq(cov, gap, rcond=None)[0] if inside.any() else gap
            lam[inside] += np.clip(step, -1 / self.eps, 1 / self.eps)
            if not len(gap) or np.abs(gap).max() < self.maxerr * max(1, np.abs(self.m).max()):
                break
        return AugmentedMSM(estimation.mle_trev_given_pi(sub.count_matrix, pi, 1e-10), pi, sub, lam, mean, pi0)

    fit_fetch = fit


class AugmentedMSM(MarkovStateModel):
    def __init__(self, t, pi, count_model, lagrange, estimates, pi_unbiased):
        super().__init__(t, pi, True, count_model)
        self.lagrange, self.estimates, self.pi_unbiased = lagrange, estimates, pi_unbiased


# --- observable operator models


def rank_decision(mean, deviation, tol: float = 10.0) -> np.ndarray:
    """Singular values whose mean is at least tol deviations."""
    with np.errstate(divide="ignore"):
        return np.asarray(mean) / np.asarray(deviation) >= tol


def oom_components(ct, c2t, chosen=None, tol_one: float = 0.01):
    """Observable operators Xi (rank, state, rank), omega, sigma and eigenvalues in [0, 1 + tol] from one- and two-step counts."""
    u, s, vt = np.linalg.svd(ct)
    chosen = s > 1e-12 * s[0] if chosen is None else chosen
    u, s, v = u[:, chosen], s[chosen], vt.T[:, chosen]
    f1, f2 = u / np.sqrt(s), v / np.sqrt(s)
    xi = np.stack([f1.T @ c2t[:, k, :] @ f2 for k in range(ct.shape[0])], 1)
    values, vectors = np.linalg.eig(xi.sum(1))
    good = np.flatnonzero((values.real >= 0) & (values.real <= 1 + tol_one) & (np.abs(values.imag) < 1e-8))
    values, vectors = values[good].real, vectors[:, good].real
    order = np.argsort(-values)
    values = values[order]
    w, left = np.linalg.eig(xi.sum(1).T)
    omega = left[:, np.argmin(np.abs(w - 1))].real
    sigma = f1.T @ ct.sum(1)
    return xi, omega / (omega @ sigma), sigma, values


def equilibrium_transition_matrix(xi, omega, sigma, reversible: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix on its largest connected set, and the set."""
    w, vectors = np.linalg.eig(xi.sum(1))
    sigma = vectors[:, np.argmin(np.abs(w - 1))].real
    c = np.einsum("i,ijk,klm,m->jl", omega, xi, xi, sigma)
    c = c * np.sign(c.sum())
    c = np.clip(c, 0, None)
    c = (c + c.T) / 2 if reversible else c
    s = graph.largest_connected_set(c)
    c = c[np.ix_(s, s)]
    return c / c.sum(1, keepdims=True), s


class OOMReweightedMSM:
    """Corrects for starts out of equilibrium with two-step counts; the rank by bootstrapped singular values."""

    def __init__(self, lagtime: int, reversible: bool = True, nbs: int = 200, tol_rank: float = 10.0, seed: int = 0):
        self.lagtime, self.reversible, self.nbs, self.tol_rank, self.seed = lagtime, reversible, nbs, tol_rank, seed

    def fit(self, dtraj: DataFrame) -> KoopmanReweightedMSM:
        model = TransitionCountEstimator(self.lagtime).fit(dtraj)
        s = model.connected_sets()[0]
        at = {int(x): i for i, x in enumerate(s)}
        c2 = np.zeros((len(s),) * 3)
        for r in _counts.twostep_counts(dtraj, self.lagtime).where(F.col("i").isin(list(at)) & F.col("k").isin(list(at)) & F.col("j").isin(list(at))).collect():  # at most n^3 rows of active states
            c2[at[r["i"]], at[r["k"]], at[r["j"]]] = r["v"]
        c = c2.sum(2) if c2.sum() else model.count_matrix[np.ix_(s, s)]
        mean, dev = estimation.bootstrapping_count_matrix(c, self.nbs, self.seed)
        chosen = rank_decision(mean, dev, self.tol_rank)
        chosen[0] = True
        xi, omega, sigma, values = oom_components(c, c2, chosen)
        t, lcc = equilibrium_transition_matrix(xi, omega, sigma, self.reversible)
        return KoopmanReweightedMSM(t, model.submodel(s[lcc]), values, chosen.sum(), c2)

    fit_fetch = fit


class KoopmanReweightedMSM(MarkovStateModel):
    def __init__(self, t, count_model, oom_eigenvalues, rank, twostep):
        super().__init__(t, count_model=count_model)
        self.oom_eigenvalues, self.oom_rank, self.twostep_count_matrices = oom_eigenvalues, int(rank), twostep

    @property
    def oom_timescales(self) -> np.ndarray:
        return analysis.timescales_from_eigenvalues(self.oom_eigenvalues, self.lagtime)[1:]


# fits on a table of counts as rows: a model for each group


def fit_by_group(counts: DataFrame, key: str, n_states: int) -> DataFrame:
    """Stationary vector of a reversible model for each group of counts (key, i, j, v): (key, state, pi). One small matrix a task."""
    import pandas as pd

    kind = counts.schema[key].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((n_states, n_states))
        np.add.at(c, (part["i"], part["j"]), part["v"])
        m = MaximumLikelihoodMSM().fit_from_counts(c).models[0]
        return pd.DataFrame({key: part[key].iloc[0], "state": m.count_model.state_symbols, "pi": m.stationary_distribution})

    return counts.groupBy(key).applyInPandas(one, f"{key} {kind}, state int, pi double")
