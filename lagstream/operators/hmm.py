"""Hidden Markov models: recursions in grouped tasks, updates on the driver from grouped sums.

Likelihoods, posteriors, Baum-Welch and most likely paths run by blocks of time, tied by the products of their steps;
sampled paths run a whole trajectory in one task.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.functions import estimation, graph
from lagstream.operators import counts as _counts
from lagstream.operators import lag as _lag
from lagstream.operators import states as _states
from lagstream.operators import validation
from lagstream.operators.msm import MarkovStateModel, MaximumLikelihoodMSM

#: Time steps of one trajectory that one task runs a recursion over.
BLOCK = 100_000

# --- recursions on one trajectory


def forward(a: np.ndarray, b: np.ndarray, p0: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and scaled forward variables; b are the emission probabilities (T x n)."""
    alpha, total = np.empty_like(b), 0.0
    now = p0 * b[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(len(b)):
            if t:
                now = (alpha[t - 1] @ a) * b[t]
            s = now.sum()
            total += np.log(s)
            alpha[t] = now / s if s > 0 else 0
    return float(total), alpha


def backward(a: np.ndarray, b: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Scaled backward variables; last are those of the last frame, even ones if nothing follows."""
    beta = np.empty_like(b)
    beta[-1] = 1 / b.shape[1] if last is None else last
    for t in range(len(b) - 2, -1, -1):
        x = a @ (b[t + 1] * beta[t + 1])
        s = x.sum()
        beta[t] = x / s if s > 0 else 0
    return beta


def block_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of a block's steps, from the state of its first frame to that of its last, scaled to a sum of one."""
    m = np.diag(b[0])
    for t in range(len(b)):
        m = (m @ a) * b[t] if t else m
        s = m.sum()
        m = m / s if s > 0 else m
    return m


def link_blocks(a: np.ndarray, p0: np.ndarray, products: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a trajectory: the distribution it starts from, the forward variables before it (empty for
    the first) and the backward variables of its last frame."""
    scaled = lambda x: x / x.sum() if x.sum() > 0 else x
    enter, before, leave = [p0], [np.empty(0)], [np.full(len(a), 1 / len(a))]
    for m in products[:-1]:
        before.append(scaled(enter[-1] @ m))
        enter.append(before[-1] @ a)
    for m in products[:0:-1]:
        leave.append(scaled(a @ (m @ leave[-1])))
    return list(zip(enter, before, leave[::-1]))


def state_probabilities(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = alpha * beta
    s = g.sum(1, keepdims=True)
    return g / np.where(s > 0, s, 1)


def transition_counts(a, b, alpha, beta) -> np.ndarray:
    out = np.zeros_like(a)
    for t in range(len(b) - 1):
        x = alpha[t][:, None] * a * (b[t + 1] * beta[t + 1])[None, :]
        s = x.sum()
        if s > 0:
            out += x / s
    return out


def best_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The likeliest path's weight from each state of a block's first frame to each of its last, scaled to a maximum of one."""
    m = np.diag(b[0])
    for t in range(len(b)):
        m = (m[:, :, None] * a).max(1) * b[t] if t else m
        s = m.max()
        m = m / s if s > 0 else m
    return m


def link_paths(a: np.ndarray, p0: np.ndarray, products: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a trajectory: the most likely path's states of its first and last frame, one-hot (before is empty)."""
    one, starts, ends = np.eye(len(a)), [p0], []
    for m in products:
        v = (starts[-1][:, None] * m).max(0)
        ends.append(v / v.max() if v.max() > 0 else v)
        starts.append((ends[-1][:, None] * a).max(0))
    out, last = [], int(ends[-1].argmax())
    for c in range(len(products) - 1, -1, -1):
        first = int((starts[c] * products[c][:, last]).argmax())
        out.append((one[first], np.empty(0), one[last]))
        if c:
            last = int((ends[c - 1] * a[:, first]).argmax())
    return out[::-1]


def viterbi(a: np.ndarray, b: np.ndarray, p0: np.ndarray, last: int | None = None) -> np.ndarray:
    """Most likely hidden path, to the state last if given; probabilities are normalised at each step, ties take the first."""
    n = len(b)
    back = np.zeros((n, len(a)), int)
    v = p0 * b[0]
    v = v / max(v.sum(), 1e-300)
    for t in range(1, n):
        x = v[:, None] * a
        back[t] = x.argmax(0)
        v = x.max(0) * b[t]
        v = v / max(v.sum(), 1e-300)
    path = np.zeros(n, int)
    path[-1] = int(v.argmax()) if last is None else last
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def sample_path(a, alpha, rng) -> np.ndarray:
    n = len(alpha)
    path = np.zeros(n, int)
    p = alpha[-1] / alpha[-1].sum()
    path[-1] = rng.choice(len(p), p=p)
    for t in range(n - 2, -1, -1):
        p = alpha[t] * a[:, path[t + 1]]
        path[t] = rng.choice(len(p), p=p / p.sum())
    return path


# --- emission models


def handle_outliers(p: np.ndarray) -> np.ndarray:
    """Frames that no hidden state explains say nothing: their rows become ones."""
    out = p.copy()
    out[p.sum(1) == 0] = 1
    return out


@dataclass
class DiscreteOutputModel:
    output_probabilities: np.ndarray
    prior: np.ndarray | None = None
    ignore_outliers: bool = False

    def __post_init__(self):
        self.output_probabilities = np.asarray(self.output_probabilities, float)
        if not np.allclose(self.output_probabilities.sum(1), 1):
            raise ValueError("rows must sum to one")

    n_hidden_states = property(lambda self: self.output_probabilities.shape[0])
    n_observable_states = property(lambda self: self.output_probabilities.shape[1])
    column = "state"

    def probabilities(self, obs: np.ndarray) -> np.ndarray:
        known = (obs >= 0) & (obs < self.n_observable_states)
        p = np.where(known[:, None], self.output_probabilities.T[np.where(known, obs, 0)], 0)
        return handle_outliers(p) if self.ignore_outliers else p

    def statistics(self, obs: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.output_probabilities)
        known = (obs >= 0) & (obs < self.n_observable_states)
        np.add.at(out.T, obs[known], gamma[known])
        return out

    def updated(self, stats: np.ndarray) -> DiscreteOutputModel:
        s = stats + (0 if self.prior is None else self.prior)
        rows = s.sum(1, keepdims=True)
        return DiscreteOutputModel(np.where(rows > 0, s / np.where(rows > 0, rows, 1), self.output_probabilities), self.prior, self.ignore_outliers)

    def sampled(self, stats: np.ndarray, rng) -> DiscreteOutputModel:
        g = rng.gamma(np.maximum(stats + (0 if self.prior is None else self.prior), 1e-3))
        return DiscreteOutputModel(g / g.sum(1, keepdims=True), self.prior, self.ignore_outliers)

    def generate(self, hidden: np.ndarray, rng) -> np.ndarray:
        return np.array([rng.choice(self.n_observable_states, p=self.output_probabilities[s]) for s in hidden])

    def submodel(self, states, obs=None) -> DiscreteOutputModel:
        p = self.output_probabilities[states]
        p = p if obs is None else p[:, obs]
        return DiscreteOutputModel(p / p.sum(1, keepdims=True), None, self.ignore_outliers)


@dataclass
class GaussianOutputModel:
    means: np.ndarray
    sigmas: np.ndarray
    ignore_outliers: bool = True
    column = "value"

    n_hidden_states = property(lambda self: len(self.means))

    def probabilities(self, obs: np.ndarray) -> np.ndarray:
        z = (obs[:, None] - self.means) / self.sigmas
        p = np.exp(-z * z / 2) / (np.sqrt(2 * np.pi) * self.sigmas)
        return handle_outliers(p) if self.ignore_outliers else p

    def statistics(self, obs, gamma) -> np.ndarray:
        return np.stack([gamma.sum(0), gamma.T @ obs, gamma.T @ obs**2], 1)

    def updated(self, stats: np.ndarray) -> GaussianOutputModel:
        w = np.maximum(stats[:, 0], 1e-300)
        mean = stats[:, 1] / w
        sigma = np.sqrt(np.maximum(stats[:, 2] / w - mean**2, 0))
        if (sigma < np.finfo(float).eps).any():
            raise RuntimeError("a hidden state's deviation vanishes")
        return GaussianOutputModel(mean, sigma, self.ignore_outliers)

    def sampled(self, stats, rng) -> GaussianOutputModel:
        m = self.updated(stats)
        n = np.maximum(stats[:, 0], 2)
        sigma = np.sqrt(n * m.sigmas**2 / rng.chisquare(n - 1))
        return GaussianOutputModel(rng.normal(m.means, sigma / np.sqrt(n)), sigma, self.ignore_outliers)

    def generate(self, hidden, rng) -> np.ndarray:
        return rng.normal(self.means[hidden], self.sigmas[hidden])

    def submodel(self, states, obs=None) -> GaussianOutputModel:
        return GaussianOutputModel(self.means[states], self.sigmas[states], self.ignore_outliers)


# --- model


def _block():
    return F.floor(F.col("t") / BLOCK).cast("long")


def spans_blocks(df: DataFrame) -> bool:
    """Whether any trajectory has frames in more than one block of time."""
    return not df.groupBy("traj_id").agg(F.min(_block()).alias("lo"), F.max(_block()).alias("hi")).where("lo < hi").isEmpty()


@dataclass
class HiddenMarkovModel:
    transition_model: MarkovStateModel
    output_model: DiscreteOutputModel | GaussianOutputModel
    initial_distribution: np.ndarray | None = None
    likelihoods: list[float] = field(default_factory=list)
    hidden_counts: np.ndarray | None = None
    initial_count: np.ndarray | None = None

    def __post_init__(self):
        if self.initial_distribution is None:
            self.initial_distribution = self.transition_model.stationary_distribution

    n_hidden_states = property(lambda self: self.output_model.n_hidden_states)
    n_observation_states = property(lambda self: self.output_model.n_observable_states)
    likelihood = property(lambda self: self.likelihoods[-1] if self.likelihoods else None)
    lagtime = property(lambda self: self.transition_model.lagtime)
    transition_matrix = property(lambda self: self.transition_model.transition_matrix)
    output_probabilities = property(lambda self: self.output_model.output_probabilities)

    def timescales(self, k=None):
        return self.transition_model.timescales(k)

    @property
    def lifetimes(self) -> np.ndarray:
        return -self.lagtime / np.log(np.diag(self.transition_matrix))

    # distributed recursions

    def _by_trajectory(self, df: DataFrame, run: Callable, schema: str) -> DataFrame:
        a, p0, output = self.transition_matrix, self.initial_distribution, self.output_model

        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("t")
            return run(part, a, output.probabilities(part[output.column].to_numpy()), p0)

        return df.select("traj_id", "t", output.column).groupBy("traj_id").applyInPandas(one, schema)

    def viterbi_paths(self, df: DataFrame) -> DataFrame:
        """(traj_id, t, state): most likely hidden states of each trajectory. Of paths that are equally likely, one that
        is cut into blocks may take another than one that is not."""
        def table(part, path):
            return pd.DataFrame({"traj_id": part["traj_id"].to_numpy(), "t": part["t"].to_numpy(), "state": path})

        schema = "traj_id long, t long, state int"
        if not spans_blocks(df):
            return self._by_trajectory(df, lambda part, a, b, p0: table(part, viterbi(a, b, p0)), schema)
        run = lambda part, a, b, first, _, last: table(part, viterbi(a, b, first, int(last.argmax())))
        return self._by_block(df, run, schema, True, best_product, link_paths)

    compute_viterbi_paths = viterbi_paths

    def _by_block(self, df: DataFrame, run: Callable, schema: str, split: bool | None = None, multiply: Callable = block_product, tie: Callable = link_blocks) -> DataFrame:
        """run(part, a, b, enter, before, leave) on each block of a trajectory, with what tie() says of it."""
        a, p0, output = self.transition_matrix, self.initial_distribution, self.output_model
        n = len(a)

        if not (spans_blocks(df) if split is None else split):
            ((enter, before, leave),) = tie(a, p0, [np.eye(n)])
            return self._by_trajectory(df, lambda part, a, b, p0: run(part, a, b, enter, before, leave), schema)

        def emitted(part: pd.DataFrame) -> np.ndarray:
            return output.probabilities(part[output.column].to_numpy())

        def product(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("t")
            return pd.DataFrame({"traj_id": part["traj_id"].iloc[:1], "block": part["block"].iloc[:1], "m": [multiply(a, emitted(part)).ravel()]})

        def link(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("block")
            ends = pd.DataFrame(tie(a, p0, [np.reshape(m, (n, n)) for m in part["m"]]), columns=["enter", "before", "leave"])
            return part[["traj_id", "block"]].reset_index(drop=True).join(ends)

        def one(part: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("t")
            return run(part, a, emitted(part), *(np.asarray(ends[c].iloc[0], float) for c in ("enter", "before", "leave")))

        key = ["traj_id", "block"]
        frames = df.select("traj_id", _block().alias("block"), "t", output.column)
        products = frames.groupBy(key).applyInPandas(product, "traj_id long, block long, m array<double>")
        ends = products.groupBy("traj_id").applyInPandas(link, "traj_id long, block long, enter array<double>, before array<double>, leave array<double>")
        return frames.groupBy(key).cogroup(ends.groupBy(key)).applyInPandas(one, schema)

    def state_probability_table(self, df: DataFrame) -> DataFrame:
        """(traj_id, t, gamma): probabilities of the hidden states given the whole trajectory."""
        def run(part, a, b, enter, before, leave):
            gamma = state_probabilities(forward(a, b, enter)[1], backward(a, b, leave))
            return pd.DataFrame({"traj_id": part["traj_id"].to_numpy(), "t": part["t"].to_numpy(), "gamma": list(gamma)})

        return self._by_block(df, run, "traj_id long, t long, gamma array<double>")

    def compute_observation_likelihood(self, df: DataFrame) -> float:
        def run(part, a, b, enter, before, leave):
            return pd.DataFrame({"ll": [forward(a, b, enter)[0]]})

        return float(self._by_block(df, run, "ll double").agg(F.sum("ll")).first()[0])

    def collect_observations_in_state(self, df: DataFrame, state: int) -> DataFrame:
        return _states.observations_in_state(self.viterbi_paths(df), df, state)

    # observation space

    def transition_matrix_obs(self, k: int = 1) -> np.ndarray:
        b, pi = self.output_probabilities, self.transition_model.stationary_distribution
        c = b.T @ (pi[:, None] * np.linalg.matrix_power(self.transition_matrix, k)) @ b
        return c / c.sum(1, keepdims=True)

    stationary_distribution_obs = property(lambda self: self.transition_model.stationary_distribution @ self.output_probabilities)
    eigenvectors_left_obs = property(lambda self: self.transition_model.eigenvectors_left() @ self.output_probabilities)

    @property
    def metastable_memberships(self) -> np.ndarray:
        joint = self.output_probabilities * self.transition_model.stationary_distribution[:, None]
        return (joint / joint.sum(0)).T

    eigenvectors_right_obs = property(lambda self: self.metastable_memberships @ self.transition_model.eigenvectors_right())
    metastable_distributions = property(lambda self: self.output_probabilities)
    metastable_assignments = property(lambda self: self.metastable_memberships.argmax(1))
    metastable_sets = property(lambda self: [np.flatnonzero(self.metastable_assignments == i) for i in range(self.n_hidden_states)])

    def _lift(self, a):
        return self.output_probabilities @ np.asarray(a)

    def expectation_obs(self, a) -> float:
        return self.transition_model.expectation(self._lift(a))

    def correlation_obs(self, a, b=None, maxtime=None):
        return self.transition_model.correlation(self._lift(a), None if b is None else self._lift(b), maxtime)

    def fingerprint_correlation_obs(self, a, b=None, k=None):
        return self.transition_model.fingerprint_correlation(self._lift(a), None if b is None else self._lift(b), k)

    def relaxation_obs(self, p0, a, maxtime=None):
        return self.transition_model.relaxation(self._project(p0), self._lift(a), maxtime)

    def fingerprint_relaxation_obs(self, p0, a, k=None):
        return self.transition_model.fingerprint_relaxation(self._project(p0), self._lift(a), k)

    def _project(self, p0):
        return np.asarray(p0) @ self.metastable_memberships

    def propagate(self, p0, k: int) -> np.ndarray:
        return self.transition_model.propagate(self._project(p0), k) @ self.output_probabilities

    def simulate(self, n_steps: int, start=None, stop=None, dt: int = 1, seed: int = 0):
        hidden = self.transition_model.simulate(n_steps, start, stop, dt, seed)
        return hidden, self.output_model.generate(hidden, np.random.default_rng(seed + 1))

    def sample_by_observation_probabilities(self, dtraj: DataFrame, n: int, seed: int = 0) -> DataFrame:
        return _states.sample_by_distribution(dtraj, self.output_probabilities, n, seed)

    # submodels

    def submodel(self, states=None, obs=None) -> HiddenMarkovModel:
        states = np.arange(self.n_hidden_states) if states is None else np.asarray(states)
        p0 = self.initial_distribution[states]
        return HiddenMarkovModel(self.transition_model.submodel(states), self.output_model.submodel(states, obs), p0 / p0.sum(), self.likelihoods,
                                 None if self.hidden_counts is None else self.hidden_counts[np.ix_(states, states)])

    def _sets(self, threshold, directed=True):
        threshold = 1 / self.n_hidden_states if threshold == "1/n" else float(threshold)
        return graph.compute_connected_sets(self.hidden_counts, threshold, directed)

    def states_largest(self, directed: bool = True, connectivity_threshold="1/n") -> np.ndarray:
        return self._sets(connectivity_threshold, directed)[0]

    def states_populous(self, strong: bool = True, connectivity_threshold="1/n") -> np.ndarray:
        return max(self._sets(connectivity_threshold, strong), key=lambda s: self.hidden_counts[np.ix_(s, s)].sum())

    def nonempty_obs(self, dtraj: DataFrame) -> np.ndarray:
        pairs = _counts.transition_pairs(dtraj, self.lagtime)
        seen = pairs.select(F.explode(F.array("i", "j")).alias("s")).distinct().orderBy("s").collect()  # one row a symbol
        return np.array([r["s"] for r in seen])

    def submodel_largest(self, directed=True, connectivity_threshold="1/n", dtraj: DataFrame | None = None):
        return self.submodel(self.states_largest(directed, connectivity_threshold), None if dtraj is None else self.nonempty_obs(dtraj))

    def submodel_populous(self, directed=True, connectivity_threshold="1/n", dtraj: DataFrame | None = None):
        return self.submodel(self.states_populous(directed, connectivity_threshold), None if dtraj is None else self.nonempty_obs(dtraj))

    def submodel_disconnect(self, connectivity_threshold="1/n"):
        return self.submodel(self._sets(connectivity_threshold)[0])

    def ck_test(self, models, include_lag0: bool = True):
        from lagstream.operators.msm import MembershipsObservable

        chi = MembershipsObservable(self.transition_model, np.eye(self.n_hidden_states))
        return validation.ck_test([m.transition_model for m in models], chi, self.transition_model, include_lag0)


class MaximumLikelihoodHMM:
    """Baum-Welch: each round is a grouped pass over the trajectories, or their blocks, and a sum of its statistics."""

    def __init__(self, initial_model: HiddenMarkovModel, lagtime: int, stride: int | str = 1, reversible: bool = True, stationary: bool = False, p0=None, accuracy: float = 1e-3, maxit: int = 1000):
        self.initial_model, self.lagtime, self.stride = initial_model, lagtime, stride
        self.reversible, self.stationary, self.p0, self.accuracy, self.maxit = reversible, stationary, p0, accuracy, maxit

    def expectation(self, model: HiddenMarkovModel, df: DataFrame, split: bool | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood, first-frame probabilities, hidden counts and emission statistics."""
        output = model.output_model

        def run(part, a, b, enter, before, leave):
            ll, alpha = forward(a, b, enter)
            beta = backward(a, b, leave)
            gamma = state_probabilities(alpha, beta)
            c, first = transition_counts(a, b, alpha, beta), gamma[0]
            if len(before):  # the step into this block, which is not the trajectory's first
                x, first = before[:, None] * a * (b[0] * beta[0])[None, :], np.zeros(len(a))
                c += x / x.sum() if x.sum() > 0 else 0
            flat = np.concatenate([[ll], first, c.ravel(), output.statistics(part[output.column].to_numpy(), gamma).ravel()])
            return pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

        # sums by position: (states + symbols) * states rows come to the driver
        rows = model._by_block(df, run, "k int, v double", split).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        v, n = np.array([r["v"] for r in rows]), model.n_hidden_states
        return v[0], v[1:1 + n], v[1 + n:1 + n + n * n].reshape(n, n), v[1 + n + n * n:].reshape(n, -1)

    def fit(self, dtraj: DataFrame) -> HiddenMarkovModel:
        model = copy.deepcopy(self.initial_model)
        df = dtraj
        if self.lagtime > 1 or self.stride != 1:
            stride = _counts.compute_effective_stride(dtraj, self.lagtime, model.n_hidden_states) if self.stride == "effective" else self.stride
            df = _lag.lag_observations(dtraj, self.lagtime, stride)
        df = df.persist()
        history: list[float] = []
        try:
            split = spans_blocks(df)
            for _ in range(self.maxit):
                ll, first, c, stats = self.expectation(model, df, split)
                history.append(ll)
                pattern = model.transition_matrix > 0
                t = estimation.estimate_p(c, self.reversible)
                out = model.output_model.updated(stats)
                p0 = self.p0 if self.p0 is not None else first / first.sum()
                msm = MarkovStateModel(t / t.sum(1, keepdims=True), estimation.stationary_distribution(t, c) if not graph.is_connected(t) else None, lagtime=self.lagtime)
                model = HiddenMarkovModel(msm, out, msm.stationary_distribution if self.stationary else p0, history, c, first)
                if len(history) > 1 and history[-1] - history[-2] < self.accuracy and ((t > 0) == pattern).all():
                    break
        finally:
            df.unpersist()
        return model

    fit_fetch = fit


# --- initial models


def random_guess(n_observation_states: int, n_hidden_states: int, seed: int = 0) -> HiddenMarkovModel:
    b = np.random.default_rng(seed).random((n_hidden_states, n_observation_states))
    return HiddenMarkovModel(MarkovStateModel(np.full((n_hidden_states,) * 2, 1 / n_hidden_states)), DiscreteOutputModel(b / b.sum(1, keepdims=True)))


def _regularized(p0, t, b, eps: float) -> tuple:
    p0 = np.maximum(p0, eps)
    t = np.maximum(t, eps)
    b = np.maximum(b, eps)
    return p0 / p0.sum(), t / t.sum(1, keepdims=True), b / b.sum(1, keepdims=True)


def metastable_from_msm(msm: MarkovStateModel, n_hidden: int, separate_symbols=None, regularize: bool = True) -> HiddenMarkovModel:
    """Hidden states from the metastable sets of a model; separate symbols get a hidden state of their own."""
    n, keep = msm.n_states, np.arange(msm.n_states)
    extra = [] if separate_symbols is None else list(separate_symbols)
    inner = msm
    if extra:
        keep = np.setdiff1d(keep, extra)
        inner = msm.submodel(keep)
    model = inner.pcca(n_hidden - bool(extra))
    b = np.zeros((n_hidden, n))
    b[:model.n_metastable, keep] = np.clip(model.metastable_distributions, 0, None)
    chi = np.zeros((n, n_hidden))
    chi[np.ix_(keep, range(model.n_metastable))] = model.memberships
    if extra:
        b[-1, extra] = 1 / len(extra)
        chi[extra, -1] = 1
    pi = msm.stationary_distribution
    flow = np.clip(chi.T @ (pi[:, None] * msm.transition_matrix) @ chi, 0, None)
    p0, t, b = chi.T @ pi, flow / flow.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
    if regularize:
        p0, t, b = _regularized(p0, t, b, 0.01 / n)
    if msm.count_model is not None and msm.count_model.n_states_full != n:
        full = np.zeros((n_hidden, msm.count_model.n_states_full))
        full[:, msm.count_model.state_symbols] = b
        b = full
    return HiddenMarkovModel(MarkovStateModel(t, lagtime=msm.lagtime), DiscreteOutputModel(b, ignore_outliers=True), p0)


def metastable_from_data(dtraj: DataFrame, n_hidden: int, lagtime: int, mode: str = "largest-regularized", separate_symbols=None) -> HiddenMarkovModel:
    counts = _counts.TransitionCountEstimator(lagtime).fit(dtraj)
    if mode.startswith("largest"):
        counts = counts.submodel_largest()
    elif mode.startswith("populous"):
        counts = counts.submodel_largest(sort_by_population=True)
    elif not mode.startswith("all"):
        raise ValueError(f"unknown mode {mode}")
    else:
        counts = counts.submodel_largest(directed=False)
        counts.count_matrix = counts.count_matrix + estimation.prior_neighbor(counts.count_matrix)
    return metastable_from_msm(MaximumLikelihoodMSM().fit_from_counts(counts).models[0], n_hidden, separate_symbols, mode.endswith("regularized"))


def gaussian_from_data(df: DataFrame, n_hidden: int, lagtime: int = 1, value: str = "value", rounds: int = 50) -> HiddenMarkovModel:
    """Mixture of Gaussians by distributed EM from quantiles, with fractional transition counts."""
    qs = df.approxQuantile(value, [(i + 0.5) / n_hidden for i in range(n_hidden)], 0.001)
    sd = df.agg(F.stddev_pop(value)).first()[0]
    mean, sigma, w = np.array(qs), np.full(n_hidden, sd / n_hidden + 1e-12), np.full(n_hidden, 1 / n_hidden)
    x = F.col(value)

    def posterior(mean, sigma, w):
        p = F.array(*(F.lit(float(a / s)) * F.exp(-((x - float(m)) / float(s)) ** 2 / 2) for m, s, a in zip(mean, sigma, w)))
        total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
        return F.transform(p, lambda v: F.when(total > 0, v / total).otherwise(1.0 / n_hidden))

    for _ in range(rounds):
        g = df.withColumn("g", posterior(mean, sigma, w))
        r = g.agg(*(F.sum(F.col("g")[i] * x**k).alias(f"s{i}{k}") for i in range(n_hidden) for k in range(3))).first()
        n = np.array([r[f"s{i}0"] for i in range(n_hidden)])
        new = np.array([r[f"s{i}1"] for i in range(n_hidden)]) / n
        sigma = np.sqrt(np.maximum(np.array([r[f"s{i}2"] for i in range(n_hidden)]) / n - new**2, 1e-12))
        w, moved, mean = n / n.sum(), np.abs(new - mean).max(), new
        if moved < 1e-6 * max(sd, 1e-12):
            break
    pairs = _lag.lag_pairs(df.withColumn("g", posterior(mean, sigma, w)).select("traj_id", "t", "g"), lagtime, "g")
    r = pairs.agg(*(F.sum(F.col("g")[i] * F.col("y")[j]).alias(f"c{i}_{j}") for i in range(n_hidden) for j in range(n_hidden))).first()
    c = np.array([[r[f"c{i}_{j}"] for j in range(n_hidden)] for i in range(n_hidden)])
    return HiddenMarkovModel(MarkovStateModel(estimation.mle_trev(c, 1e-8), lagtime=lagtime), GaussianOutputModel(mean, sigma))


# --- posterior samples


@dataclass
class BayesianHMMPosterior(validation.BayesianModel):
    prior: HiddenMarkovModel = None
    samples: list[HiddenMarkovModel] = field(default_factory=list)

    def submodel(self, states=None, obs=None) -> BayesianHMMPosterior:
        return BayesianHMMPosterior(self.prior.submodel(states, obs), [s.submodel(states, obs) for s in self.samples])

    def submodel_largest(self, directed=True, connectivity_threshold="1/n", dtraj=None):
        return self.submodel(self.prior.states_largest(directed, connectivity_threshold), None if dtraj is None else self.prior.nonempty_obs(dtraj))

    def submodel_populous(self, directed=True, connectivity_threshold="1/n", dtraj=None):
        return self.submodel(self.prior.states_populous(directed, connectivity_threshold), None if dtraj is None else self.prior.nonempty_obs(dtraj))


class BayesianHMM:
    """Gibbs sampling: hidden paths by trajectory (seeded by trajectory id and round), then emissions and transitions."""

    def __init__(self, initial_hmm: HiddenMarkovModel, n_samples: int = 100, n_transition_matrix_sampling_steps: int = 100, reversible: bool = True, seed: int = 0):
        self.initial, self.n_samples, self.steps, self.reversible, self.seed = initial_hmm, n_samples, n_transition_matrix_sampling_steps, reversible, seed

    def fit(self, dtraj: DataFrame, n_burn_in: int = 0, n_thin: int = 1) -> BayesianHMMPosterior:
        model, samples = copy.deepcopy(self.initial), []
        df = (_lag.lag_observations(dtraj, model.lagtime, model.lagtime) if model.lagtime > 1 else dtraj).persist()
        for step in range(n_burn_in + self.n_samples * n_thin):
            model = self._sweep(model, df, step)
            if step >= n_burn_in and (step - n_burn_in) % n_thin == 0:
                samples.append(model)
        df.unpersist()
        return BayesianHMMPosterior(prior=self.initial, samples=samples)

    fit_fetch = fit

    def _sweep(self, model: HiddenMarkovModel, df: DataFrame, step: int) -> HiddenMarkovModel:
        output, seed, n = model.output_model, self.seed, model.n_hidden_states

        def run(part, a, b, p0):
            rng = np.random.default_rng([seed, step, abs(int(part["traj_id"].iloc[0]))])
            path = sample_path(a, forward(a, b, p0)[1], rng)
            gamma, c, first = np.eye(n)[path], np.zeros((n, n)), np.zeros(n)
            np.add.at(c, (path[:-1], path[1:]), 1)
            first[path[0]] = 1
            flat = np.concatenate([first, c.ravel(), output.statistics(part[output.column].to_numpy(), gamma).ravel()])
            return pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

        rows = model._by_trajectory(df, run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        v = np.array([r["v"] for r in rows])
        first, c, stats = v[:n], v[n:n + n * n].reshape(n, n), v[n + n * n:].reshape(n, -1)
        rng = np.random.default_rng([self.seed, step])
        c_prior = c + estimation.prior_neighbor(c + np.eye(n), 1e-3) if graph.is_connected(c) else c + 1e-3
        t = estimation.tmatrix_sampler(c_prior, self.reversible, seed=int(rng.integers(1 << 31))).sample(self.steps if self.reversible else 1)
        p0 = rng.dirichlet(first + 1 / n)
        return HiddenMarkovModel(MarkovStateModel(t, lagtime=model.lagtime), output.sampled(stats, rng), p0, hidden_counts=c, initial_count=first)

    @staticmethod
    def default(dtraj: DataFrame, n_hidden_states: int, lagtime: int, n_samples: int = 100, seed: int = 0) -> BayesianHMM:
        start = metastable_from_data(dtraj, n_hidden_states, lagtime)
        return BayesianHMM(MaximumLikelihoodHMM(start, lagtime, lagtime).fit(dtraj), n_samples, seed=seed)
