"""The library's names in one place, and dataset classes and factories on top of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstream.functions import analysis, basis, estimation, flux, graph, linalg, simulate
from lagstream.operators import clustering, counts, decomposition, hmm, lag, moments, msm, states, tram, validation
from lagstream.plans import plots
from lagstream.sources import trajectories as tr

# --- datasets


class TimeLaggedDataset:
    """Aligned pairs: a table with x and y."""

    def __init__(self, pairs: DataFrame):
        if not tr.is_timelagged(pairs):
            raise tr.InputFormatError("pairs need x and y")
        self.pairs = pairs

    data = property(lambda self: self.pairs.drop("y"))
    data_lagged = property(lambda self: self.pairs.drop("x").withColumnRenamed("y", "x"))

    def __len__(self) -> int:
        return self.pairs.count()


class TrajectoriesDataset(TimeLaggedDataset):
    """Pairs of trajectories at one lag; those too short are left out, none long enough is an error."""

    def __init__(self, lagtime: int, df: DataFrame):
        self.lagtime, self.trajectories = lagtime, tr.ensure_traj(df)
        super().__init__(lag.lag_pairs(lag.require_pairs(self.trajectories, lagtime), lagtime))

    @staticmethod
    def from_numpy(spark: SparkSession, lagtime: int, data) -> TrajectoriesDataset:
        return TrajectoriesDataset(lagtime, tr.from_numpy(spark, data))

    def too_short(self) -> DataFrame:
        return lag.too_short(self.trajectories, self.lagtime)


class TrajectoryDataset(TrajectoriesDataset):
    """One trajectory."""

    def __init__(self, lagtime: int, df: DataFrame):
        super().__init__(lagtime, df if "traj_id" in df.columns else df.withColumn("traj_id", F.lit(0).cast("long")))

    from_trajectories = TrajectoriesDataset


class ConcatDataset:
    def __init__(self, datasets):
        self.table = tr.concat([d.pairs if isinstance(d, TimeLaggedDataset) else d for d in datasets])


class TimeLaggedConcatDataset(TimeLaggedDataset):
    def __init__(self, datasets):
        super().__init__(tr.concat([d.pairs for d in datasets]))

    def stride(self, k: int) -> DataFrame:
        """Every k-th pair, counted through from one dataset to the next."""
        from pyspark.sql import Window

        own = ["dataset_id", "traj_id"]
        # only one row for each trajectory is numbered through
        sizes = self.pairs.groupBy(*own).agg(F.count("*").alias("_size"))
        before = F.coalesce(F.sum("_size").over(Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = self.pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("t")) - 1)
        return numbered.join(sizes.select(*own, before.alias("_before")), own).where((F.col("_n") + F.col("_before")) % k == 0).select(*self.pairs.columns)


def to_dataset(spark: SparkSession, data, lagtime: int | None = None):
    """DataFrames, arrays, lists or pairs of arrays as a lagged dataset."""
    if isinstance(data, TimeLaggedDataset):
        return data
    if isinstance(data, DataFrame):
        return TimeLaggedDataset(data) if tr.is_timelagged(data) else TrajectoriesDataset(lagtime, data)
    if isinstance(data, tuple) and len(data) == 2:
        x, y = (np.asarray(a, float).reshape(len(a), -1) for a in data)
        if len(x) != len(y):
            raise tr.InputFormatError("arrays of different length")
        return TimeLaggedDataset(spark.createDataFrame([(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "traj_id long, t long, x array<double>, y array<double>"))
    return TrajectoriesDataset.from_numpy(spark, lagtime, data)


# --- moments


class RunningCovar:
    """Moments that grow by tables."""

    def __init__(self, remove_mean: bool = False, symmetrize: bool = False):
        self.remove_mean, self.symmetrize, self.state = remove_mean, symmetrize, None

    def add(self, pairs: DataFrame, weight: str | None = None) -> None:
        m = moments.moments(pairs, weight)
        m = m.symmetrized() if self.symmetrize else m
        self.state = m if self.state is None else self.state.combine(m)

    def _cov(self, name: str, bessels_correction: bool) -> np.ndarray:
        m = getattr(self.state, name) if self.remove_mean else self.state.raw(name)
        return m / (self.state.w - bessels_correction)

    def cov_xx(self, bessels_correction: bool = True) -> np.ndarray:
        return self._cov("mxx", bessels_correction)

    def cov_xy(self, bessels_correction: bool = True) -> np.ndarray:
        return self._cov("mxy", bessels_correction)

    def cov_yy(self, bessels_correction: bool = True) -> np.ndarray:
        return self._cov("myy", bessels_correction)


running_covar = RunningCovar


def moments_xx(df: DataFrame, remove_mean: bool = False, weight: str | None = None):
    """Weight, sum and second moments."""
    m = moments.moments(df, weight)
    return m.w, m.sx, m.mxx if remove_mean else m.raw("mxx")


def moments_xxxy(pairs: DataFrame, remove_mean: bool = False, symmetrize: bool = False, weight: str | None = None):
    m = moments.moments(pairs, weight)
    m = m.symmetrized() if symmetrize else m
    get = (lambda n: getattr(m, n)) if remove_mean else m.raw
    return m.w, m.sx, m.sy, get("mxx"), get("mxy")


def moments_block(pairs: DataFrame, remove_mean: bool = False, weight: str | None = None):
    m = moments.moments(pairs, weight)
    get = (lambda n: getattr(m, n)) if remove_mean else m.raw
    return m.w, (m.sx, m.sy), ((get("mxx"), get("mxy")), (get("mxy").T, get("myy")))


class WhiteningTransform:
    def __init__(self, sqrt_inv_cov, mean=None, dim: int | None = None):
        self.matrix, self.mean = np.asarray(sqrt_inv_cov)[:, :dim], mean

    def __call__(self, x):
        return moments.project(x, self.matrix, self.mean) if isinstance(x, DataFrame) else (x - (0 if self.mean is None else self.mean)) @ self.matrix


# --- counts, estimation, sampling


def bootstrapping_dtrajs(dtraj: DataFrame, lagtime: int, n_states: int, n_replicates: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the singular values of counts when whole trajectories are redrawn."""
    rows = counts.bootstrap_dtraj_counts(dtraj, lagtime, n_replicates, seed).toPandas()  # at most n^2 rows a replicate
    values = []
    for _, g in rows.groupby("rep"):
        c = np.zeros((n_states, n_states))
        c[g["i"], g["j"]] = g["v"]
        values.append(np.linalg.svd(c, compute_uv=False))
    return np.mean(values, 0), np.std(values, 0)


def estimate_rate_matrix(c, dt: float = 1.0, method: str = "KL", **kw) -> np.ndarray:
    return estimation.rate_matrix(c, dt, method, **kw)


def sample_hidden_state_trajectory(model: hmm.HiddenMarkovModel, observations, seed: int = 0) -> np.ndarray:
    """One draw of the hidden path of one trajectory."""
    b = model.output_model.probabilities(np.asarray(observations))
    return hmm.sample_path(model.transition_matrix, hmm.forward(model.transition_matrix, b, model.initial_distribution)[1], np.random.default_rng(seed))


def transition_counts_from_count_models(n_therm: int, n_markov: int, models) -> np.ndarray:
    out = np.zeros((n_therm, n_markov, n_markov))
    for k, m in enumerate(models):
        out[np.ix_([k], m.state_symbols, m.state_symbols)] = m.count_matrix
    return out


def state_counts_from_count_models(n_therm: int, n_markov: int, models) -> np.ndarray:
    out = np.zeros((n_therm, n_markov))
    for k, m in enumerate(models):
        out[k, m.state_symbols] = m.state_histogram
    return out


def time_correlations(t, pi, obs1, obs2=None, times=(1,)) -> np.ndarray:
    return analysis.correlation(t, obs1, obs2, times, pi)


def time_relaxations(t, p0, obs, times=(1,)) -> np.ndarray:
    return analysis.relaxation(t, p0, obs, times)


# --- generators


def double_well_discrete() -> simulate.DoubleWellDiscrete:
    return simulate.DoubleWellDiscrete()


def birth_death_chain(q, p) -> simulate.BirthDeathChain:
    return simulate.BirthDeathChain(q, p)


def drunkards_walk(grid_size=(10, 10), bar_location=(9, 9), home_location=(0, 0)) -> simulate.DrunkardsWalk:
    return simulate.DrunkardsWalk(grid_size, bar_location, home_location)


def position_based_fluids(n_burn_in: int = 100, initial_positions=None, n: int = 100) -> simulate.PositionBasedFluids:
    start = np.random.default_rng(0).uniform(-4, 4, (n, 2)) if initial_positions is None else initial_positions
    fluid = simulate.PositionBasedFluids([12, 20], start, 1.5)
    fluid.run(n_burn_in)
    return fluid


plot_implied_timescales, plot_ck_test = plots.implied_timescales_table, plots.ck_test_table
plot_energy2d, plot_density, plot_contour2d_from_xyz = plots.energy_table, plots.density_table, plots.contour_table
plot_markov_model, plot_flux, plot_adjacency = plots.markov_model_tables, plots.flux_tables, plots.network_tables

__all__ = ["analysis", "basis", "clustering", "counts", "decomposition", "estimation", "flux", "graph", "hmm", "lag", "linalg", "moments", "msm", "plots", "simulate", "states", "tram", "validation",
           *[n for n, v in list(globals().items()) if getattr(v, "__module__", None) == __name__]]
