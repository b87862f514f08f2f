"""Multi-ensemble reweighting: MBAR and TRAM over tables (traj_id, t, therm, state, bias ARRAY<DOUBLE>).

Each iteration is one pass over the samples that returns log-sum-exps by thermodynamic and Markov state; all
self-consistent updates act on those small tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.functions import graph, linalg
from lagstream.operators import lag as _lag
from lagstream.operators.counts import TransitionCountModel
from lagstream.operators.msm import MarkovStateModel


class TRAMDataset:
    """Samples with counts for each thermodynamic state. Trajectories are split at replica swaps and negative states."""

    def __init__(self, samples: DataFrame, lagtime: int = 1, count_mode: str = "sliding", n_therm: int | None = None, n_markov: int | None = None):
        if count_mode not in ("sliding", "sample"):
            raise ValueError("count mode is sliding or sample")
        self.samples, self.lagtime, self.count_mode = samples, lagtime, count_mode
        top = samples.agg(F.max("therm"), F.max("state"), F.max(F.size("bias")), F.min(F.size("bias"))).first()
        if top[2] != top[3]:
            raise ValueError("bias arrays of different length")
        self.n_therm = n_therm or top[2]
        if top[0] >= self.n_therm:
            raise ValueError("thermodynamic state without bias")
        self.n_markov = n_markov or int(top[1]) + 1
        self._counts = self._states = None

    @property
    def transition_counts(self) -> np.ndarray:
        """Counts (therm, i, j)."""
        if self._counts is None:
            pieces = _lag.fragments(self.samples, "therm")
            pairs = _lag.lag_pairs(pieces.select("traj_id", "t", "state", "therm"), self.lagtime, "state")
            if self.count_mode == "sample":
                pairs = pairs.where(F.col("t") % self.lagtime == 0)
            out = np.zeros((self.n_therm, self.n_markov, self.n_markov))
            for r in pairs.groupBy("therm", "state", "y").count().collect():  # at most therm * n^2 rows
                out[r["therm"], r["state"], r["y"]] = r["count"]
            self._counts = out
        return self._counts

    @property
    def state_counts(self) -> np.ndarray:
        if self._states is None:
            out = np.zeros((self.n_therm, self.n_markov))
            for r in self.samples.where("state >= 0").groupBy("therm", "state").count().collect():
                out[r["therm"], r["state"]] = r["count"]
            self._states = out
        return self._states

    def check_against_model(self, model: TRAMModel) -> None:
        if self.n_therm > model.n_therm or self.n_markov > model.n_markov:
            raise ValueError("dataset has states that the model lacks")

    def restrict_to_submodel(self, states) -> TRAMDataset:
        """Samples mapped to the sub-states; others become -1."""
        mapped = self.samples
        keyed = mapped.sparkSession.createDataFrame([(int(s), i) for i, s in enumerate(states)], "symbol int, idx int")
        out = mapped.join(keyed, mapped["state"] == keyed["symbol"], "left").withColumn("state", F.coalesce("idx", F.lit(-1))).drop("symbol", "idx")
        return TRAMDataset(out, self.lagtime, self.count_mode, self.n_therm, len(states))

    def restrict_to_largest_connected_set(self, connectivity: str | None = "post_hoc_RE", connectivity_factor: float = 1.0) -> TRAMDataset:
        """Markov states connected within thermodynamic states or, between them, by overlap of their samples."""
        if connectivity is None:
            return self
        c = self.transition_counts
        if connectivity == "summed_count_matrix":
            return self.restrict_to_submodel(graph.largest_connected_set(c.sum(0)))
        if connectivity not in ("post_hoc_RE", "BAR_variance"):
            raise ValueError(f"unknown connectivity {connectivity}")
        n, k = self.n_markov, self.n_therm
        big = np.zeros((k * n, k * n))
        for t in range(k):
            big[t * n:(t + 1) * n, t * n:(t + 1) * n] = c[t] > 0
        for i, a, b in overlaps(self.samples, connectivity, connectivity_factor):
            big[a * n + i, b * n + i] = big[b * n + i, a * n + i] = 1
        occupied = np.flatnonzero(self.state_counts.ravel() > 0)
        best = occupied[graph.connected_sets(big[np.ix_(occupied, occupied)])[0]]
        return self.restrict_to_submodel(np.unique(best % n))


def overlaps(samples: DataFrame, kind: str = "post_hoc_RE", factor: float = 1.0) -> list[tuple[int, int, int]]:
    """(Markov state, therm a, therm b) whose samples overlap: expected replica exchanges of at least one, or the variance of
    the free energy difference by Bennett's ratio at most one. A task handles one Markov state's pair; sums over sorted energy
    differences replace the loop over pairs of samples."""
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out, groups = [], dict(list(part.groupby("therm")))
        for a in sorted(groups):
            for b in sorted(groups):
                if a < b:
                    xa, xb = np.stack(groups[a]["bias"].to_numpy()), np.stack(groups[b]["bias"].to_numpy())
                    da, db = xa[:, a] - xa[:, b], xb[:, b] - xb[:, a]  # exchange energy is da + db
                    n, m = len(da), len(db)
                    if kind == "post_hoc_RE":
                        sb = np.sort(db)
                        grow = np.concatenate([[0], np.cumsum(np.exp(np.minimum(sb, 700)))])
                        at = np.searchsorted(sb, -da)
                        mean = float((np.exp(np.minimum(da, 700)) * grow[at] + (m - at)).sum()) / (n * m)
                        ok = (n + m) * mean * factor >= 1
                    else:
                        df = 0.0
                        for _ in range(200):
                            fa, fb = 1 / (1 + n / m * np.exp(np.clip(-da - df, -700, 700))), 1 / (1 + m / n * np.exp(np.clip(-db + df, -700, 700)))
                            step = np.log(max(fb.sum(), 1e-300) / max(fa.sum(), 1e-300))
                            df += step
                            if abs(step) < 1e-10:
                                break
                        v = (fa**2).mean() / fa.mean() ** 2 / n + (fb**2).mean() / fb.mean() ** 2 / m - 1 / n - 1 / m
                        ok = v <= factor
                    if ok:
                        out.append((int(key[0]), int(a), int(b)))
        return pd.DataFrame(out, columns=["i", "a", "b"])

    found = samples.where("state >= 0").select("state", "therm", "bias").groupBy("state").applyInPandas(one, "i int, a int, b int").collect()  # a row for each overlap
    return [(r["i"], r["a"], r["b"]) for r in found]


@dataclass
class TRAMModel:
    biased_conf_energies: np.ndarray
    lagrangian_mult_log: np.ndarray
    modified_state_counts_log: np.ndarray
    transition_matrices: np.ndarray
    count_models: list[TransitionCountModel] = field(default_factory=list)
    log_likelihoods: list[float] = field(default_factory=list)

    n_therm = property(lambda self: self.biased_conf_energies.shape[0])
    n_markov = property(lambda self: self.biased_conf_energies.shape[1])

    @property
    def therm_state_energies(self) -> np.ndarray:
        return -linalg.logsumexp(-self.biased_conf_energies, 1)

    @property
    def msms(self) -> list[MarkovStateModel]:
        out = []
        for t, c in zip(self.transition_matrices, self.count_models):
            s = graph.connected_sets(c.count_matrix)[0]
            p = t[np.ix_(s, s)]
            out.append(MarkovStateModel(p / p.sum(1, keepdims=True), count_model=c.submodel(s)))
        return out

    def sample_weights_log(self, samples: DataFrame, therm: int = -1) -> DataFrame:
        """log_w of each sample for a thermodynamic state (-1: unbiased), normalised over all samples."""
        table = self.modified_state_counts_log

        def f(state: pd.Series, bias: pd.Series) -> pd.Series:
            if not len(state):
                return pd.Series([], dtype=float)
            i, b = state.to_numpy(), np.stack(bias.to_numpy())
            own = 0 if therm < 0 else -b[:, therm]
            out = own - linalg.logsumexp(table[:, np.maximum(i, 0)].T - b, 1)
            return pd.Series(np.where(i >= 0, out, -np.inf))

        f.__annotations__ = {"state": pd.Series, "bias": pd.Series, "return": pd.Series}
        out = samples.withColumn("log_w", F.pandas_udf(f, "double")("state", "bias"))
        top = out.agg(F.max("log_w")).first()[0]
        whole = top + float(np.log(out.agg(F.sum(F.exp(F.col("log_w") - top))).first()[0]))
        return out.withColumn("log_w", F.col("log_w") - whole)

    def compute_observable(self, samples: DataFrame, value: str, therm: int = -1) -> float:
        return float(self.sample_weights_log(samples, therm).agg(F.sum(F.exp("log_w") * F.col(value))).first()[0])

    def compute_pmf(self, samples: DataFrame, bin_col: str, n_bins: int | None = None, therm: int = -1) -> np.ndarray:
        """-log of each bin's weight, the least zero; empty bins are infinite."""
        rows = self.sample_weights_log(samples, therm).groupBy(bin_col).agg(F.sum(F.exp("log_w")).alias("w")).collect()  # a row a bin
        out = np.full(n_bins or max(r[bin_col] for r in rows) + 1, np.inf)
        for r in rows:
            out[r[bin_col]] = -np.log(r["w"]) if r["w"] > 0 else np.inf
        return out - out.min()

    def compute_log_likelihood(self, dataset: TRAMDataset) -> float:
        """Discrete part of the transitions and local equilibrium part of the samples."""
        c, p = dataset.transition_counts, self.transition_matrices
        some = (c > 0) & (p > 0)
        discrete = float((c[some] * np.log(p[some])).sum() + (dataset.state_counts * np.where(np.isfinite(self.biased_conf_energies), self.biased_conf_energies, 0)).sum())
        table = self.modified_state_counts_log

        def f(state: pd.Series, bias: pd.Series) -> pd.Series:
            return pd.Series(-linalg.logsumexp(table[:, state.to_numpy()].T - np.stack(bias.to_numpy()), 1) if len(state) else [], dtype=float)

        f.__annotations__ = {"state": pd.Series, "bias": pd.Series, "return": pd.Series}
        own = dataset.samples.where("state >= 0").select((F.pandas_udf(f, "double")("state", "bias") - F.element_at("bias", F.col("therm") + 1)).alias("v")).agg(F.sum("v")).first()[0]
        return discrete + float(own)


def bias_sums(samples: DataFrame, log_counts: np.ndarray) -> np.ndarray:
    """For each thermodynamic state l and Markov state i: log sum over samples x in i of exp(-b_l(x)) / sum_k exp(log_counts_ki - b_k(x))."""
    kept = samples.sparkSession.sparkContext.broadcast(log_counts)
    k, n = log_counts.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.full((n, k), -np.inf)
        for batch in batches:
            if batch.num_rows:
                i, b = batch.column(0).to_numpy(), np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                w = -b - linalg.logsumexp(kept.value[:, i].T - b, 1)[:, None]
                for s in np.unique(i):
                    total[s] = np.logaddexp(total[s], linalg.logsumexp(w[i == s], 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), k), pa.int32()), pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(total.ravel())], names=["i", "l", "v"])

    parts = samples.where("state >= 0").select("state", "bias").mapInArrow(scan, "i int, l int, v double").where("v > -1e300")
    top = parts.groupBy("i", "l").agg(F.max("v").alias("m"), F.collect_list("v").alias("vs"))  # a value for each input partition
    rows = top.select("i", "l", (F.col("m") + F.log(F.aggregate("vs", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))))).alias("v")).collect()
    out = np.full((k, n), -np.inf)
    for r in rows:
        out[r["l"], r["i"]] = r["v"]
    return out


def mbar(samples: DataFrame, state_counts: np.ndarray, maxiter: int = 1000, maxerr: float = 1e-8, f0: np.ndarray | None = None) -> np.ndarray:
    """Free energies of the thermodynamic states by self-consistent MBAR, the first zero."""
    n = state_counts.sum(1)
    f = np.zeros(len(n)) if f0 is None else f0
    flat = samples.withColumn("state", F.lit(0))
    with np.errstate(divide="ignore"):
        log_n = np.log(n)
    for _ in range(maxiter):
        new = -bias_sums(flat, (log_n + f)[:, None])[:, 0]
        new -= new[0]
        done = np.abs(new - f).max() < maxerr
        f = new
        if done:
            break
    return f


class TRAM:
    """Transition-based reweighting (Wu et al. 2016).

    Every callback_interval rounds the callback is called, and the largest change of an energy and the log-likelihood
    are kept; the latter, one more pass over the samples, only where it is tracked, else as minus infinity."""

    def __init__(self, lagtime: int = 1, count_mode: str = "sliding", maxiter: int = 200, maxerr: float = 1e-8, init_strategy: str | None = "MBAR", init_maxiter: int = 200, init_maxerr: float = 1e-8, track_log_likelihoods: bool = False, callback_interval: int = 1):
        self.callback_interval, self.log_likelihoods, self.energy_increments = callback_interval, [], []
        self.lagtime, self.count_mode, self.maxiter, self.maxerr = lagtime, count_mode, maxiter, maxerr
        self.init_strategy, self.init_maxiter, self.init_maxerr, self.track = init_strategy, init_maxiter, init_maxerr, track_log_likelihoods

    def fit(self, data, model: TRAMModel | None = None, callback=None) -> TRAMModel:
        data = data if isinstance(data, TRAMDataset) else TRAMDataset(data, self.lagtime, self.count_mode)
        c, n = data.transition_counts, data.state_counts
        samples = data.samples.where("state >= 0").persist()
        both = c + c.transpose(0, 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if model is not None:
                f, v = model.biased_conf_energies.copy(), np.exp(model.lagrangian_mult_log)
            else:
                v = both.sum(2) / 2
                f = np.zeros(n.shape)
                if self.init_strategy == "MBAR":
                    f += mbar(samples, n, self.init_maxiter, self.init_maxerr)[:, None]
            self.log_likelihoods, self.energy_increments = [], []
            for step in range(1, self.maxiter + 1):
                # Lagrange multipliers, then effective state counts, then energies
                w = np.exp(-f - (-f).max(1, keepdims=True))
                for _inner in range(5):
                    d = w[:, :, None] * v[:, None, :] + w[:, None, :] * v[:, :, None]
                    v = np.where(both > 0, both * v[:, :, None] * w[:, None, :] / np.where(d > 0, d, 1), 0).sum(2)
                d = w[:, :, None] * v[:, None, :] + w[:, None, :] * v[:, :, None]
                incoming = np.where(both > 0, both * v[:, None, :] / np.where(d > 0, d, 1) * w[:, :, None], 0)
                r = n - c.sum(1) + incoming.sum(2)
                r = np.where(n > 0, np.maximum(r, 1e-12), 0)
                log_r = np.log(r) + f
                new = -bias_sums(samples, log_r)
                new -= new[np.isfinite(new)].min()
                some = np.isfinite(new) & np.isfinite(f) & (n > 0)
                change = np.abs((new - f)[some] - np.median((new - f)[some])).max()
                f = new
                if self.callback_interval and step % self.callback_interval == 0:
                    self.energy_increments.append(float(change))
                    self.log_likelihoods.append(self._model(data, f, v, r).compute_log_likelihood(data) if self.track else -math.inf)
                    if callback:
                        callback(self.callback_interval, change)
                if change < self.maxerr:
                    break
        samples.unpersist()
        return self._model(data, f, v, r)

    def _model(self, data: TRAMDataset, f: np.ndarray, v: np.ndarray, r: np.ndarray) -> TRAMModel:
        """The model of energies, multipliers and effective counts: p_ij is proportional to
        (c_ij + c_ji) w_j / (w_i v_j + w_j v_i), with what a row lacks on its diagonal."""
        c, n = data.transition_counts, data.state_counts
        both = c + c.transpose(0, 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.exp(-f - np.where(np.isfinite(f), -f, -np.inf).max(1, keepdims=True))
            d = w[:, :, None] * v[:, None, :] + w[:, None, :] * v[:, :, None]
            p = np.where(both > 0, both * w[:, None, :] / np.where(d > 0, d, 1), 0)
            rows = p.sum(2, keepdims=True)
            p = p / np.maximum(rows.max(1, keepdims=True), 1e-300)
            idx = np.arange(p.shape[1])
            p[:, idx, idx] += np.clip(1 - p.sum(2), 0, None)
            log_r = np.where(n > 0, np.log(np.maximum(r, 1e-300)) + f, -np.inf)
        models = [TransitionCountModel(c[k], self.count_mode, self.lagtime, n[k].astype(int)) for k in range(len(c))]
        return TRAMModel(f, np.log(np.maximum(v, 1e-300)), log_r, p, models, list(self.log_likelihoods))

    fit_fetch = fit


def harmonic_samples(spark, centres: Sequence[float], k: float, n: int, edges: np.ndarray, seed: int = 0) -> DataFrame:
    """Independent samples of harmonic biases on a flat line, for tests."""
    rng, rows = np.random.default_rng(seed), []
    for therm, c in enumerate(centres):
        x = rng.normal(c, 1 / np.sqrt(k), n)
        state = np.clip(np.searchsorted(edges, x) - 1, 0, len(edges) - 2)
        bias = [[float(k / 2 * (v - m) ** 2) for m in centres] for v in x]
        rows += [(therm, t, therm, int(s), b, float(v)) for t, (s, b, v) in enumerate(zip(state, bias, x))]
    return spark.createDataFrame(rows, "traj_id long, t long, therm int, state int, bias array<double>, value double")

