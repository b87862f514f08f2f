"""Relabelling, selecting and joining states."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.operators import lag as _lag


def state_map(spark, symbols: Sequence[int]) -> DataFrame:
    """(symbol, state): active index of each symbol; one row for each active state."""
    return spark.createDataFrame([(int(s), i) for i, s in enumerate(symbols)], "symbol int, state int")


def map_to_symbols(dtraj: DataFrame, symbols: Sequence[int], empty: int = -1) -> DataFrame:
    """States of the full space to active indices; all others to `empty`. The map is as long as the active set."""
    keyed = state_map(dtraj.sparkSession, symbols).withColumnRenamed("state", "_index")
    return (dtraj.join(keyed, dtraj["state"] == keyed["symbol"], "left").withColumn("state", F.coalesce("_index", F.lit(empty))).drop("symbol", "_index"))


class DiscreteStatesManager:
    """Symbols of the full space against indices of an active set."""

    def __init__(self, symbols: Sequence[int], n_states_full: int, blank: int = -1):
        self.symbols, self.n_states_full, self.blank = np.asarray(symbols, int), n_states_full, blank
        if len(self.symbols) and self.symbols.max() >= n_states_full:
            raise ValueError("symbol out of range")

    n_states = property(lambda self: len(self.symbols))
    symbols_with_blank = property(lambda self: np.append(self.symbols, self.blank))
    selected_all_states = property(lambda self: len(self.symbols) == self.n_states_full)

    def states_to_symbols(self, states) -> np.ndarray:
        return self.symbols[np.asarray(states, int)]

    def symbols_to_states(self, symbols) -> np.ndarray:
        """Indices of known symbols; unknown ones are dropped."""
        at = {s: i for i, s in enumerate(self.symbols.tolist())}
        return np.array([at[s] for s in np.ravel(symbols).tolist() if s in at], int)

    def subselect_states(self, states) -> DiscreteStatesManager:
        return DiscreteStatesManager(self.symbols[np.asarray(states, int)], self.n_states_full, self.blank)

    def project(self, dtraj: DataFrame) -> DataFrame:
        return map_to_symbols(dtraj, self.symbols.tolist(), self.blank)


def variable_columns(df: DataFrame, tol: float = 0.0, min_constant: int = 0) -> np.ndarray:
    """Which dimensions vary by more than tol; with fewer than min_constant constant ones, all count as varying."""
    span = (df.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg((F.max("v") - F.min("v") > tol).alias("varies")).orderBy("p").collect())  # one row a dimension
    out = np.array([bool(r["varies"]) for r in span])
    return np.ones_like(out) if (~out).sum() < min_constant else out


def state_means(dtraj: DataFrame, features: DataFrame) -> DataFrame:
    """Mean feature of each state by the positional join: (state, p, mean)."""
    joined = dtraj.select("traj_id", "t", "state").join(features.select("traj_id", "t", "x"), ["traj_id", "t"])
    return joined.select("state", F.posexplode("x").alias("p", "v")).groupBy("state", "p").agg(F.avg("v").alias("mean"))


def observations_in_state(hidden: DataFrame, observed: DataFrame, state: int) -> DataFrame:
    """Observations of frames whose hidden state is the given one."""
    return observed.join(hidden.where(F.col("state") == state).select("traj_id", "t"), ["traj_id", "t"], "left_semi")


def next_states(dtraj: DataFrame, lag: int) -> DataFrame:
    """For each trajectory and start state, the states lag later in order: (traj_id, state, seq)."""
    pairs = _lag.lag_pairs(dtraj, lag, "state")
    return pairs.groupBy("traj_id", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("seq"))


def indicator(sequences: DataFrame, state: int) -> DataFrame:
    return sequences.withColumn("indicator", F.transform("seq", lambda s: (s == state).cast("int")))


def index_states(dtraj: DataFrame, subset: Sequence[int] | None = None) -> DataFrame:
    """(state, traj_id, t) of every frame in a state of subset, sorted within partitions of the state."""
    found = dtraj if subset is None else dtraj.where(F.col("state").isin([int(s) for s in subset]))
    return found.where("state >= 0").select("state", "traj_id", "t")


def sample_by_state(dtraj: DataFrame, n: int, subset: Sequence[int] | None = None, replace: bool = True, seed: int = 0) -> DataFrame:
    """n frames of each state, (state, draw, traj_id, t): drawn by keys of a digest, so a draw does not depend on partitions.

    Without replacement these are the n frames of least digest, pre-selected by partition. With, a draw repeats an
    earlier one's frame with the probability of meeting one of those k among the state's N frames, k / N, and else
    takes the next of them; only a state's size and n numbers are drawn outside. States without frames give none.
    """
    frames = index_states(dtraj, subset)
    if replace:
        sizes = frames.groupBy("state").count().orderBy("state").collect()  # a row for each state
        rng, plan = np.random.default_rng(seed), []
        for state, whole in sizes:
            seen = 0
            for draw in range(n):
                old = rng.random() * whole < seen
                plan.append((state, draw, int(rng.integers(seen)) if old else seen))
                seen += not old
        plan = dtraj.sparkSession.createDataFrame(plan, "state int, draw int, rank int")
        distinct = sample_by_state(dtraj, n, subset, False, seed).withColumnRenamed("draw", "rank")
        return plan.join(distinct, ["state", "rank"]).select("state", "draw", "traj_id", "t")
    from pyspark.sql import Window

    key = F.xxhash64(F.lit(seed), "traj_id", "t")
    near = frames.withColumn("h", key).withColumn("salt", F.pmod("h", F.lit(64)))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("state", "salt").orderBy("h", "traj_id", "t"))).where(F.col("k") <= n)
    return (first.withColumn("draw", F.row_number().over(Window.partitionBy("state").orderBy("h", "traj_id", "t")) - 1).where(F.col("draw") < n)
            .select("state", "draw", "traj_id", "t"))


def sample_by_sequence(dtraj: DataFrame, sequence: Sequence[int], seed: int = 0) -> DataFrame:
    """One random frame for each state of a sequence: (position, state, traj_id, t)."""
    spark = dtraj.sparkSession
    wanted = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sequence)], "position int, state int")
    found = index_states(dtraj, sorted(set(map(int, sequence)))).join(wanted, "state")
    key = F.struct(F.xxhash64(F.lit(seed), "position", "traj_id", "t").alias("h"), "traj_id", "t")
    return found.groupBy("position", "state").agg(F.min(key).alias("m")).select("position", "state", "m.traj_id", "m.t")


def sample_by_distribution(dtraj: DataFrame, distributions: np.ndarray, n: int, seed: int = 0) -> DataFrame:
    """n frames for each distribution over states: (distribution, position, state, traj_id, t)."""
    rng, out = np.random.default_rng(seed), None
    for i, p in enumerate(np.atleast_2d(distributions)):
        part = sample_by_sequence(dtraj, rng.choice(len(p), n, p=p).tolist(), seed + i).withColumn("distribution", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
