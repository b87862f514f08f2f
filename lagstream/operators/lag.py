"""Lagged pairs and other re-arrangements of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagstream.sources.trajectories import TrajectoryTooShortError


def _by_time() -> Window:
    return Window.partitionBy("traj_id").orderBy("t")


def lag_pairs(df: DataFrame, lag: int, value: str = "x", by_join: bool = False) -> DataFrame:
    """(traj_id, t, value, y): frames and those of time t + lag; pairs never cross a trajectory or a gap in t, shorter
    ones give none.

    by_join pairs by an equi-join on (traj_id, t + lag), which also splits one trajectory that holds most rows; else
    one window over each trajectory needs a single shuffle.
    """
    if lag <= 0:
        raise ValueError("lag must be positive")
    if by_join:
        ends = df.select(F.col("traj_id"), (F.col("t") - lag).alias("t"), F.col(value).alias("y"))
        return df.join(ends, ["traj_id", "t"])
    return df.withColumn("y", later(F.struct(value), lag)).where("y is not null").withColumn("y", F.col(f"y.{value}"))


def later(value: Column, lag: int) -> Column:
    """The value of the same trajectory at time t + lag; null where that frame is absent, whatever row comes next."""
    return F.first(value).over(Window.partitionBy("traj_id").orderBy("t").rangeBetween(lag, lag))


def require_pairs(df: DataFrame, lag: int) -> DataFrame:
    """df, if some trajectory is longer than the lag."""
    if df.groupBy("traj_id").count().where(F.col("count") > lag).isEmpty():
        raise TrajectoryTooShortError(f"no trajectory is longer than {lag}")
    return df


def too_short(df: DataFrame, lag: int) -> DataFrame:
    """Trajectories that give no pair."""
    return df.groupBy("traj_id").agg(F.count("*").alias("length")).where(F.col("length") <= lag)


def timeshifted_split(df: DataFrame, lag: int, chunksize: int = 1000, stride: int = 1, n_splits: int | None = None, seed: int | None = None) -> DataFrame:
    """Pairs with a chunk number: of chunksize frames, or n_splits chunks a trajectory; shuffled within it where a seed is given."""
    bad = df.where(F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    if not bad.isEmpty():
        raise ValueError("frames hold NaN or infinity")
    pairs = lag_pairs(require_pairs(df, lag), lag).where(F.col("t") % stride == 0)
    order = Window.partitionBy("traj_id").orderBy("t" if seed is None else F.xxhash64(F.lit(seed), "traj_id", "t"))
    chunk = F.ntile(n_splits).over(order) - 1 if n_splits else F.floor((F.row_number().over(order) - 1) / chunksize)
    return pairs.withColumn("chunk", chunk.cast("int"))


def sliding_window(df: DataFrame, radius: int = 1, value: str = "x", fixed_width: bool = False) -> DataFrame:
    """window: the values from t - radius to t + radius; at the ends shorter, or with fixed_width the nearest full window."""
    ordered = Window.partitionBy("traj_id").orderBy("t")
    if not fixed_width:
        return df.withColumn("window", F.collect_list(value).over(ordered.rowsBetween(-radius, radius)))
    wide = df.withColumn("window", F.collect_list(value).over(ordered.rowsBetween(-2 * radius, 2 * radius)))
    n = F.count("*").over(Window.partitionBy("traj_id"))
    centre = F.least(F.greatest(F.col("t"), F.lit(radius)), n - 1 - radius)
    first = F.greatest(centre - radius - F.greatest(F.col("t") - 2 * radius, F.lit(0)), F.lit(0))
    return wide.withColumn("window", F.slice("window", (first + 1).cast("int"), F.lit(2 * radius + 1)))


def lag_observations(df: DataFrame, lag: int, stride: int = 1) -> DataFrame:
    """For each shift 0, stride, .. below lag the frames shift, shift + lag, ..; copies of more than one frame, as trajectories of their own."""
    shifted = df.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(lag - 1), F.lit(stride)))).where("t >= shift").where((F.col("t") - F.col("shift")) % lag == 0)
    count = F.count("*").over(Window.partitionBy("traj_id", "shift"))
    return (shifted.withColumn("n", count).where("n > 1").withColumn("source_id", F.col("traj_id")).withColumn("traj_id", F.xxhash64("traj_id", "shift"))
            .withColumn("t", F.floor((F.col("t") - F.col("shift")) / lag)).drop("n", "shift"))


def blocksplit(df: DataFrame, blocksize: int, sliding: bool = True, shift: int = 0) -> DataFrame:
    """Fragments as trajectories: of 2 * blocksize frames every blocksize (sliding), or of blocksize + 1 frames; after a shift."""
    t = F.col("t") - shift
    first = F.floor(t / blocksize)
    starts = F.when(first > 0, F.array(first - 1, first)).otherwise(F.array(first))
    size = 2 * blocksize if sliding else blocksize + 1
    out = df.where(t >= 0).withColumn("block", F.explode(starts)).where((t - F.col("block") * blocksize >= 0) & (t - F.col("block") * blocksize < size))
    return out.withColumn("traj_id", F.xxhash64("traj_id", "block")).withColumn("t", t - F.col("block") * blocksize).drop("block")


def cvsplit(df: DataFrame, seed: int, fold: int = 0) -> DataFrame:
    """df with test: a random half of the trajectories, by a digest of their ids."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.lit(seed), F.lit(fold), "traj_id"), F.lit(2)) == 1)


def fragments(df: DataFrame, key: str = "therm") -> DataFrame:
    """Trajectories split where key changes, where the state is negative or absent, and across gaps in t."""
    order = Window.partitionBy("traj_id").orderBy("t")
    kept = df.where("state >= 0")
    new = (F.lag(key).over(order) != F.col(key)) | (F.lag("t").over(order) != F.col("t") - 1)
    part = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)
    out = kept.withColumn("fragment", part).withColumn("source_id", F.col("traj_id")).withColumn("source_t", F.col("t"))
    out = out.withColumn("t", F.row_number().over(Window.partitionBy("traj_id", "fragment").orderBy("t")) - 1)
    return out.withColumn("traj_id", F.xxhash64("traj_id", "fragment"))
