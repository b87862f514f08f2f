"""Transition counts: the lag self-join and its aggregations, count models, resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagstream.functions import graph
from lagstream.operators import lag as _lag
from lagstream.operators.states import DiscreteStatesManager

MODES = ("sliding", "sliding-effective", "sample", "effective")


def count_states(dtraj: DataFrame, ignore_negative: bool = True) -> DataFrame:
    """Histogram (state, n)."""
    return (dtraj.where("state >= 0") if ignore_negative else dtraj).groupBy("state").agg(F.count("*").alias("n"))


def visited_set(dtraj: DataFrame) -> DataFrame:
    return dtraj.where("state >= 0").select("state").distinct()


def number_of_states(dtraj: DataFrame, only_used: bool = False) -> int:
    seen = dtraj.where("state >= 0").agg(F.max("state").alias("top"), F.count_distinct("state").alias("n")).first()
    return int(seen["n"]) if only_used else (0 if seen["top"] is None else int(seen["top"]) + 1)


def transition_pairs(dtraj: DataFrame, lag: int, mode: str = "sliding", by_join: bool = False) -> DataFrame:
    """(traj_id, t, i, j) of counted transitions; a pair with a negative end is none, and gaps are never bridged."""
    pairs = _lag.lag_pairs(dtraj, lag, "state", by_join).where("state >= 0 and y >= 0")
    if mode == "sample":
        pairs = pairs.where(F.col("t") % lag == 0)
    return pairs.withColumnRenamed("state", "i").withColumnRenamed("y", "j")


def count_matrix(dtraj: DataFrame, lag: int, mode: str = "sliding", by_join: bool = False) -> DataFrame:
    """Counts (i, j, v) at a lag: sliding, sample (every lag-th frame) or sliding-effective (sliding / lag)."""
    v = F.count("*").cast("double")
    return transition_pairs(dtraj, lag, mode, by_join).groupBy("i", "j").agg((v / lag if mode == "sliding-effective" else v).alias("v"))


def count_matrices(dtraj: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Sliding counts (lag, i, j, v) of several lags in one pass: one window, one grouped sum."""
    leads = F.array(*(F.struct(F.lit(k).alias("lag"), _lag.later(F.col("state"), k).alias("j")) for k in lags))
    pairs = dtraj.withColumn("p", leads).select(F.col("state").alias("i"), F.inline("p")).where("i >= 0 and j >= 0")
    return pairs.groupBy("lag", "i", "j").agg(F.count("*").cast("double").alias("v"))


def twostep_counts(dtraj: DataFrame, lag: int) -> DataFrame:
    """Triples (i, k, j, v): states at t, t + lag and t + 2 lag."""
    triples = dtraj.select(F.col("state").alias("i"), _lag.later(F.col("state"), lag).alias("k"), _lag.later(F.col("state"), 2 * lag).alias("j"))
    return triples.where("i >= 0 and k >= 0 and j >= 0").groupBy("i", "k", "j").agg(F.count("*").cast("double").alias("v"))


def reweighted_count_matrix(dtraj: DataFrame, lag: int) -> DataFrame:
    """Path-reweighted sliding counts of a table with columns g and m: weight g_t exp(-(m_{t+1} + .. + m_{t+lag})). A
    pair counts only where every frame between its ends is there."""
    path = Window.partitionBy("traj_id").orderBy("t").rangeBetween(1, lag)
    weight = F.when(F.count("m").over(path) == lag, F.col("g") * F.exp(-F.sum("m").over(path)))
    pairs = dtraj.select(F.col("state").alias("i"), _lag.later(F.col("state"), lag).alias("j"), weight.alias("w"))
    return pairs.where("i >= 0 and j >= 0 and w is not null").groupBy("i", "j").agg(F.sum("w").alias("v"))


def statistical_inefficiency(sequences: Sequence[np.ndarray], truncate_acf: bool = True, mact: float = 1.0) -> float:
    """1 / (2 (1/2 + mact * damped integrated autocorrelation)) of scalar sequences, centred at their pooled mean and
    divided by the raw second moment; truncated at the first non-positive autocorrelation."""
    sequences = [np.asarray(s, float) for s in sequences]
    every = np.concatenate(sequences)
    mean, second, longest = every.mean(), (every**2).mean(), max(map(len, sequences))
    if second == 0:
        return 1.0
    centred, total = [s - mean for s in sequences], 0.0
    for k in range(1, longest):
        parts = [(s[:-k] * s[k:]).sum() for s in centred if len(s) > k]
        n = sum(len(s) - k for s in centred if len(s) > k)
        acf = sum(parts) / n
        if truncate_acf and acf <= 0:
            break
        total += acf * (1 - k / longest)
    return float(1 / (2 * (0.5 + mact * total / second)))


def statistical_inefficiencies(dtraj: DataFrame, lag: int, truncate_acf: bool = True, mact: float = 1.0, chunk: int = 16) -> DataFrame:
    """(i, j, si) of each counted transition. The indicator of j after i is taken in the order of frames, trajectory by
    trajectory. Its autocorrelations come as grouped sums of `chunk` lags at a time, until each is truncated or the
    longest run of i is exhausted; only a row for each transition reaches the driver."""
    pairs = transition_pairs(dtraj, lag)
    run = Window.partitionBy("traj_id", "i")
    runs = pairs.select("traj_id", "i", "j", F.row_number().over(run.orderBy("t")).alias("p"), F.count("*").over(run).alias("n")).persist()
    sizes = runs.where("p = 1").groupBy("i", "n").agg(F.count("*").alias("c")).toPandas()  # a row for each length of a run
    table = runs.groupBy("i", "j").agg(F.count("*").alias("hits")).orderBy("i", "j").toPandas()
    lengths = {i: (g["n"].to_numpy(), g["c"].to_numpy()) for i, g in sizes.groupby("i")}
    whole = {i: float((n * c).sum()) for i, (n, c) in lengths.items()}
    longest = {i: int(n.max()) for i, (n, _) in lengths.items()}
    mean = {(r.i, r.j): r.hits / whole[r.i] for r in table.itertuples()}
    total, open_ = dict.fromkeys(mean, 0.0), {k for k in mean if longest[k[0]] > 1}
    first = 1
    while open_:
        wanted = [k for k in range(first, first + chunk)]
        at = run.orderBy("p")
        sums = runs.where(F.col("i").isin(sorted({i for i, _ in open_}))).select("i", "j", *(
            F.struct((F.col("p") + k <= F.col("n")).cast("int").alias("head"), (F.col("p") > k).cast("int").alias("tail"), F.coalesce(F.lead("j", k).over(at) == F.col("j"), F.lit(False)).cast("int").alias("both")).alias(f"k{k}") for k in wanted))
        rows = sums.groupBy("i", "j").agg(*(F.array(*(F.sum(f"k{k}.{c}") for c in ("head", "tail", "both"))).alias(f"k{k}") for k in wanted)).collect()
        for r in rows:
            key, (lens, times) = (r["i"], r["j"]), lengths[r["i"]]
            for k in wanted if key in open_ else ():
                if k >= longest[r["i"]]:
                    open_.discard(key)
                    break
                head, tail, both = r[f"k{k}"]
                n = float((np.maximum(lens - k, 0) * times).sum())
                acf = (both - mean[key] * (head + tail)) / n + mean[key] ** 2
                if truncate_acf and acf <= 1e-12 * mean[key]:  # zero but for rounding
                    open_.discard(key)
                    break
                total[key] += acf * (1 - k / longest[r["i"]])
        first += chunk
    runs.unpersist()
    rows = [(int(i), int(j), float(1 / (2 * (0.5 + mact * total[i, j] / m)))) for (i, j), m in mean.items()]
    return dtraj.sparkSession.createDataFrame(rows, "i int, j int, si double")


def effective_count_matrix(dtraj: DataFrame, lag: int, average: str = "row", truncate_acf: bool = True, mact: float = 1.0) -> DataFrame:
    """Counts times statistical inefficiency: by row (the row's mean factor), all (one factor) or none (element-wise)."""
    c = count_matrix(dtraj, lag).join(statistical_inefficiencies(dtraj, lag, truncate_acf, mact), ["i", "j"])
    if average == "none":
        return c.select("i", "j", (F.col("v") * F.col("si")).alias("v"))
    over = Window.partitionBy("i") if average == "row" else Window.partitionBy()
    whole = F.sum("v").over(over)
    factor = F.sum(F.col("v") * F.col("si")).over(over) / (F.greatest(F.lit(1.0), whole) if average == "row" else whole)
    return c.select("i", "j", (F.col("v") * factor).alias("v"))


def to_matrix(counts: DataFrame, n: int) -> np.ndarray:
    """A long table (i, j, v) as an array on the driver; at most n * n rows."""
    rows = counts.select("i", "j", "v").toPandas()
    out = np.zeros((n, n))
    np.add.at(out, (rows["i"].to_numpy(int), rows["j"].to_numpy(int)), rows["v"].to_numpy(float))
    return out


def transition_matrix_sql(counts: DataFrame) -> DataFrame:
    """Row-normalised counts (i, j, p)."""
    return counts.select("i", "j", (F.col("v") / F.sum("v").over(Window.partitionBy("i"))).alias("p"))


class TransitionCountModel:
    """Counts and histogram of an active set of states, within those of the full space."""

    def __init__(self, count_matrix, counting_mode: str | None = None, lagtime: int = 1, state_histogram=None, state_symbols=None, count_matrix_full=None, state_histogram_full=None):
        self.count_matrix = np.asarray(count_matrix, float)
        self.counting_mode, self.lagtime = counting_mode, lagtime
        self.state_histogram = None if state_histogram is None else np.asarray(state_histogram)
        self.state_symbols = np.arange(len(self.count_matrix)) if state_symbols is None else np.asarray(state_symbols)
        self.count_matrix_full = self.count_matrix if count_matrix_full is None else count_matrix_full
        self.state_histogram_full = self.state_histogram if state_histogram_full is None else state_histogram_full
        self.states = DiscreteStatesManager(self.state_symbols, len(self.count_matrix_full))

    n_states = property(lambda self: len(self.count_matrix))
    n_states_full = property(lambda self: len(self.count_matrix_full))
    selected_state_fraction = property(lambda self: self.n_states / self.n_states_full)
    is_full_model = property(lambda self: self.n_states == self.n_states_full)

    def _histogram(self) -> np.ndarray:
        if self.state_histogram is None:
            raise RuntimeError("this model has no state histogram")
        return self.state_histogram

    @property
    def total_count(self) -> int:
        return int(self._histogram().sum())

    @property
    def selected_count_fraction(self) -> float:
        return float(self._histogram().sum() / self.state_histogram_full.sum())

    @property
    def visited_set(self) -> np.ndarray:
        return np.flatnonzero(self._histogram())

    def count_matrix_histogram(self) -> np.ndarray:
        return self.count_matrix.sum(1)

    def states_to_symbols(self, states):
        return self.states.states_to_symbols(states)

    def symbols_to_states(self, symbols):
        return self.states.symbols_to_states(symbols)

    def transform_discrete_trajectories_to_submodel(self, dtraj: DataFrame) -> DataFrame:
        return self.states.project(dtraj)

    def connected_sets(self, connectivity_threshold: float = 0.0, directed: bool = True, probability_constraint=None, sort_by_population: bool = False) -> list[np.ndarray]:
        """Components, largest first; the threshold '1/n' is that of the full space; a probability constraint drops states of zero weight."""
        threshold = 1 / self.n_states_full if connectivity_threshold == "1/n" else float(connectivity_threshold)
        if probability_constraint is not None:
            keep = np.flatnonzero(np.asarray(probability_constraint)[self.state_symbols] > 0)
            sets = [keep[s] for s in graph.compute_connected_sets(self.count_matrix[np.ix_(keep, keep)], threshold, directed)]
        else:
            sets = graph.compute_connected_sets(self.count_matrix, threshold, directed)
        return sorted(sets, key=lambda s: (-self.count_matrix[np.ix_(s, s)].sum(), s[0])) if sort_by_population else sets

    def is_connected(self, directed: bool = True) -> bool:
        return graph.is_connected(self.count_matrix, directed)

    def submodel(self, states) -> TransitionCountModel:
        states = np.atleast_1d(states)
        return TransitionCountModel(self.count_matrix[np.ix_(states, states)], self.counting_mode, self.lagtime, None if self.state_histogram is None else self.state_histogram[states],
                                    self.state_symbols[states], self.count_matrix_full, self.state_histogram_full)

    def submodel_largest(self, connectivity_threshold: float = 0.0, directed: bool | None = None, probability_constraint=None, sort_by_population: bool = False) -> TransitionCountModel:
        directed = probability_constraint is None if directed is None else directed
        return self.submodel(self.connected_sets(connectivity_threshold, directed, probability_constraint, sort_by_population)[0])


class TransitionCountEstimator:
    """Counts a discrete table at a lag; n_states pads the matrix."""

    def __init__(self, lagtime: int, count_mode: str = "sliding", n_states: int | None = None):
        if count_mode not in MODES:
            raise ValueError(f"count mode must be one of {MODES}")
        self.lagtime, self.count_mode, self.n_states = lagtime, count_mode, n_states

    def count(self, dtraj: DataFrame) -> DataFrame:
        return effective_count_matrix(dtraj, self.lagtime) if self.count_mode == "effective" else count_matrix(dtraj, self.lagtime, self.count_mode)

    def fit(self, dtraj: DataFrame) -> TransitionCountModel:
        _lag.require_pairs(dtraj, self.lagtime)
        histogram = count_states(dtraj).toPandas()
        n = max(int(histogram["state"].max()) + 1, self.n_states or 0)
        full = np.zeros(n, int)
        full[histogram["state"]] = histogram["n"]
        return TransitionCountModel(to_matrix(self.count(dtraj), n), self.count_mode, self.lagtime, full)

    fit_fetch = fit


class PathReweightingEstimator(TransitionCountEstimator):
    """Sliding counts weighted by path factors; the table has columns g and m."""

    def __init__(self, lagtime: int, count_mode: str = "sliding", n_states: int | None = None):
        if count_mode != "sliding":
            raise ValueError("path reweighting counts by sliding")
        super().__init__(lagtime, count_mode, n_states)

    def count(self, dtraj: DataFrame) -> DataFrame:
        return reweighted_count_matrix(dtraj, self.lagtime)


# --- resampling


def _poisson(u: Column, rate: Column, most: int = 24) -> Column:
    """Poisson number of a rate below about 4, by its inverse distribution function at u."""
    first = F.exp(-rate)

    def more(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"), (state["times"] + (u > state["total"]).cast("int")).alias("times"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(first.alias("term"), first.alias("total"), F.lit(0).alias("times")), more, lambda state: state["times"])


def bootstrap_trajectories(dtraj: DataFrame, correlation_length: int, seed: int = 0) -> DataFrame:
    """Segments of a correlation length, as many frames as there are on average: each has its own traj_id.

    Every frame that can start a segment does so a Poisson number of times from its digest, at a rate by which a
    trajectory's segments follow its length. A trajectory shorter than the correlation length is one segment."""
    size = F.greatest(F.col("n") - correlation_length + 1, F.lit(1))
    frames = dtraj.withColumn("n", F.count("*").over(Window.partitionBy("traj_id"))).withColumn("first", F.min("t").over(Window.partitionBy("traj_id")))
    u = (F.xxhash64(F.lit(seed), "traj_id", "t") / 2.0**64) + 0.5
    starts = frames.where(F.col("t") - F.col("first") < size).withColumn("times", _poisson(u, F.col("n") / (correlation_length * size)))
    plan = starts.where("times > 0").select(F.col("traj_id").alias("source"), F.col("t").alias("start"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    plan = plan.withColumn("at", F.explode(F.sequence("start", F.col("start") + correlation_length - 1)))
    joined = dtraj.join(plan, (dtraj["traj_id"] == plan["source"]) & (dtraj["t"] == plan["at"]))
    return joined.select(F.xxhash64("source", "start", "copy").alias("traj_id"), (F.col("t") - F.col("start")).alias("t"), "state")


def bootstrap_counts(dtraj: DataFrame, lag: int, corrlength: int | None = None, seed: int = 0) -> DataFrame:
    """Counts (i, j, v) of frames / corrlength pairs drawn with replacement: each pair's number of draws is Poisson from its digest."""
    pairs = transition_pairs(dtraj, lag)
    share = 1.0 / (corrlength or lag)
    u = (F.xxhash64(F.lit(seed), "traj_id", "t") / 2.0**64) + 0.5
    # inverse distribution function of a Poisson variable, up to 8
    term, total, times = np.exp(-share), 0.0, F.lit(0)
    for k in range(8):
        total += term
        times = times + (u > total).cast("int")
        term *= share / (k + 1)
    return pairs.withColumn("n", times).where("n > 0").groupBy("i", "j").agg(F.sum("n").cast("double").alias("v"))


def bootstrap_dtraj_counts(dtraj: DataFrame, lag: int, n_replicates: int, seed: int = 0) -> DataFrame:
    """Counts (rep, i, j, v) when whole trajectories are drawn with replacement (Poisson weights from digests)."""
    own = transition_pairs(dtraj, lag).groupBy("traj_id", "i", "j").agg(F.count("*").alias("c"))
    u = (F.xxhash64(F.lit(seed), "rep", "traj_id") / 2.0**64) + 0.5
    term, total, times = np.exp(-1.0), 0.0, F.lit(0)
    for k in range(8):
        total += term
        times = times + (u > total).cast("int")
        term /= k + 1
    reps = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1)))).withColumn("n", times)
    return reps.where("n > 0").groupBy("rep", "i", "j").agg(F.sum(F.col("n") * F.col("c")).cast("double").alias("v"))


def compute_effective_stride(dtraj: DataFrame, lag: int, n_states: int) -> int:
    """min(lag, 2 * the first timescale that n_states leave out) of the non-reversible model."""
    from lagstream.functions import analysis, estimation

    model = TransitionCountEstimator(lag).fit(dtraj).submodel_largest()
    stride = lag
    if model.n_states > n_states:
        its = analysis.timescales(estimation.transition_matrix_non_reversible(model.count_matrix), lag)
        stride = max(1, min(lag, int(2 * its[n_states])))
    return stride


def effective_dtraj(dtraj: DataFrame, lag: int, n_states: int, stride="effective") -> DataFrame:
    return _lag.lag_observations(dtraj, lag, compute_effective_stride(dtraj, lag, n_states) if stride == "effective" else stride)


def counts_submatrix(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entries of (i, j, v) whose ends are in chosen (state), by semi joins."""
    return counts.join(chosen.select(F.col("state").alias("i")), "i", "left_semi").join(chosen.select(F.col("state").alias("j")), "j", "left_semi").select("i", "j", "v")


def counts_allclose(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    both = a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), ["i", "j"], "full")
    a_, b_ = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.where(F.abs(a_ - b_) > atol + rtol * F.abs(b_)).isEmpty()
