"""Trajectory tables.

Discrete: (traj_id, t, state INT). Features: (traj_id, t, x ARRAY<DOUBLE>). Pairs: (traj_id, t, x, y). t is dense from
0 in each trajectory. Further columns (weights w, path factors g and m, thermodynamic state therm) ride along.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InputFormatError(ValueError):
    """Columns are missing or of another type."""


class TrajectoryTooShortError(ValueError):
    """No trajectory is longer than the lag."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_time(df: DataFrame, traj: Column, order: Sequence[str]) -> DataFrame:
    """df with traj_id and a dense t; order must be a total order in each trajectory."""
    at = Window.partitionBy("traj_id").orderBy(*order)
    return df.withColumn("traj_id", traj.cast("long")).withColumn("t", (F.row_number().over(at) - 1).cast("long"))


def encode_states(df: DataFrame, symbol: str) -> DataFrame:
    """df with state, the rank of its symbol among the distinct symbols, from 0; null symbols give null."""
    symbols = df.where(F.col(symbol).isNotNull()).select(F.col(symbol).alias("_symbol")).distinct()
    ranks = symbols.withColumn("state", (F.row_number().over(Window.orderBy("_symbol")) - 1).cast("int"))
    return df.join(ranks, F.col(symbol) == F.col("_symbol"), "left").drop("_symbol")


def events_dtraj(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encode_states(table(spark, sf_dir, "events"), "event_type")
    return with_time(df, F.col("user_id"), ["ts", "event_id"]).select("traj_id", "t", "state")


def events_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time(table(spark, sf_dir, "events"), F.col("user_id"), ["ts", "event_id"]).select("traj_id", "t", F.array("value").alias("x"))


def orders_dtraj(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encode_states(table(spark, sf_dir, "orders"), "o_orderpriority")
    return with_time(df, F.col("o_custkey"), ["o_orderdate", "o_orderkey"]).select("traj_id", "t", "state")


def orders_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time(table(spark, sf_dir, "orders"), F.col("o_custkey"), ["o_orderdate", "o_orderkey"]).select("traj_id", "t", F.array("o_totalprice").alias("x"))


def lineitem_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in shipping order, a trajectory for each supplier."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return with_time(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), order).select("traj_id", "t", x.alias("x"))


def embeddings_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in id order, a trajectory for each label."""
    return with_time(table(spark, sf_dir, "embeddings"), F.col("label"), ["vec_id"]).select("traj_id", "t", F.col("embedding").cast("array<double>").alias("x"))


def conversations_dtraj(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encode_states(table(spark, sf_dir, "conversations"), "role")
    return with_time(df, F.col("conv_id"), ["turn"]).select("traj_id", "t", "state")


# --- adapters


def from_numpy(spark: SparkSession, data, dtype: str | None = None) -> DataFrame:
    """Arrays to a table: 1-D integers are states, 2-D are frames, a list or a 3-D array are several trajectories."""
    trajectories = [np.asarray(x) for x in data] if isinstance(data, (list, tuple)) or np.ndim(data) == 3 else [np.asarray(data)]
    kinds = {(x.ndim, np.issubdtype(x.dtype, np.integer)) for x in trajectories}
    if len({k for k, _ in kinds}) > 1:
        raise InputFormatError("trajectories of different dimension")
    discrete = trajectories[0].ndim == 1 and np.issubdtype(trajectories[0].dtype, np.integer) if dtype is None else dtype == "state"
    rows = ((i, t, int(v)) if discrete else (i, t, [float(e) for e in np.atleast_1d(v)]) for i, x in enumerate(trajectories) for t, v in enumerate(x))
    return spark.createDataFrame(list(rows), "traj_id long, t long, state int" if discrete else "traj_id long, t long, x array<double>")


def to_numpy(df: DataFrame, column: str = "state") -> list[np.ndarray]:
    """Trajectories on the driver; for small tables."""
    rows = df.select("traj_id", "t", column).orderBy("traj_id", "t").toPandas()
    return [np.array(g[column].tolist()) for _, g in rows.groupby("traj_id")]


def _require(df: DataFrame, **kinds) -> DataFrame:
    fields = {f.name: f.dataType for f in df.schema}
    for name, kind in kinds.items():
        if name not in fields or not isinstance(fields[name], kind):
            raise InputFormatError(f"column {name} must be {kind}")
    return df


_INTEGER, _FLOAT = (T.IntegerType, T.LongType, T.ShortType), (T.DoubleType, T.FloatType)


def ensure_number_column(df: DataFrame, name: str) -> DataFrame:
    return _require(df, **{name: T.NumericType})


def ensure_integer_column(df: DataFrame, name: str) -> DataFrame:
    return _require(df, **{name: _INTEGER})


def ensure_floating_column(df: DataFrame, name: str) -> DataFrame:
    return _require(df, **{name: _FLOAT})


def ensure_array_column(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    _require(df, **{name: T.ArrayType})
    if size is not None and not df.where(F.size(name) != size).isEmpty():
        raise InputFormatError(f"{name} is not of size {size} throughout")
    return df


def ensure_dtraj(df: DataFrame) -> DataFrame:
    """A discrete table; a single trajectory without traj_id gets 0."""
    df = df if "traj_id" in df.columns else df.withColumn("traj_id", F.lit(0).cast("long"))
    return _require(df, t=_INTEGER, state=_INTEGER).withColumn("state", F.col("state").cast("int"))


def ensure_traj(df: DataFrame) -> DataFrame:
    """A feature table; a scalar x becomes an array of one."""
    df = df if "traj_id" in df.columns else df.withColumn("traj_id", F.lit(0).cast("long"))
    if isinstance(df.schema["x"].dataType, T.NumericType):
        df = df.withColumn("x", F.array(F.col("x").cast("double")))
    return _require(df, t=_INTEGER, x=T.ArrayType).withColumn("x", F.col("x").cast("array<double>"))


def ensure_reweighting(df: DataFrame) -> DataFrame:
    return _require(df, g=_FLOAT, m=_FLOAT)


def is_timelagged(df: DataFrame) -> bool:
    return {"x", "y"} <= set(df.columns)


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables one after another, told apart by dataset_id; trajectories of different tables never join."""
    out = None
    for i, df in enumerate(tables):
        df = df.withColumn("dataset_id", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("traj_id", F.xxhash64("dataset_id", "traj_id"))


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("traj_id").agg(F.count("*").alias("length"))


def drop_nan_rows(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.exists(c, lambda v: F.isnan(v) | v.isNull()) if isinstance(df.schema[c].dataType, T.ArrayType) else F.isnan(c) | F.col(c).isNull())
    return df.where(~F.coalesce(bad, F.lit(True)))
