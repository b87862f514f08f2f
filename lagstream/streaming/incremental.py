"""Counts and moments kept up to date by Structured Streaming: each micro-batch is merged into state on shared storage.

Frames of a trajectory must arrive in the order of t, whole batches at a time. The last `lag` frames of each trajectory
are kept between batches, so pairs that span two batches are counted. State tables are versioned by batch id: a batch
that is run again replaces its own version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagstream.operators import counts as _counts
from lagstream.operators.lag import later
from lagstream.operators.moments import Moments, moments


def _tail(df: DataFrame, lag: int) -> DataFrame:
    """Frames that one to come can still pair with: those of the last lag times of each trajectory."""
    return df.withColumn("_top", F.max("t").over(Window.partitionBy("traj_id"))).where(F.col("t") > F.col("_top") - lag).drop("_top")


class _State:
    """Versioned Parquet tables under a folder; the version before a batch is its starting point."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)) if fs.exists(path) else []

    def before(self, name: str, batch: int) -> DataFrame | None:
        found = [v for v in self._versions(name) if v < batch]
        return self.spark.read.parquet(f"{self.folder}/{name}/v={found[-1]}") if found else None

    def put(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={batch}")

    def latest(self, name: str) -> DataFrame | None:
        found = self._versions(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v={found[-1]}") if found else None


class StreamingCounts:
    """Sliding counts (i, j, v) of a stream of (traj_id, t, state)."""

    def __init__(self, spark: SparkSession, folder: str, lag: int):
        self.state, self.lag = _State(spark, folder), lag

    def update(self, batch: DataFrame, batch_id: int) -> None:
        new = batch.select("traj_id", "t", "state", F.lit(True).alias("new"))
        tail = self.state.before("tail", batch_id)
        every = new if tail is None else new.unionByName(tail.withColumn("new", F.lit(False)))
        pairs = every.withColumn("y", later(F.struct("state", "new"), self.lag)).where("y.new and state >= 0 and y.state >= 0").select(F.col("state").alias("i"), F.col("y.state").alias("j"))
        counts = pairs.groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))
        old = self.state.before("counts", batch_id)
        if old is not None:
            counts = counts.unionByName(old).groupBy("i", "j").agg(F.sum("v").alias("v"))
        self.state.put("counts", batch_id, counts)
        self.state.put("tail", batch_id, _tail(every.drop("new"), self.lag))

    def start(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(options or {"availableNow": True})).start()

    def counts(self) -> DataFrame | None:
        return self.state.latest("counts")

    def model(self, n_states: int) -> _counts.TransitionCountModel:
        return _counts.TransitionCountModel(_counts.to_matrix(self.counts(), n_states), "sliding", self.lag)


class StreamingMoments:
    """Moments of frames, or of lagged pairs, of a stream of (traj_id, t, x)."""

    def __init__(self, spark: SparkSession, folder: str, lag: int = 0):
        self.state, self.lag, self.spark = _State(spark, folder), lag, spark

    def update(self, batch: DataFrame, batch_id: int) -> None:
        pairs = batch
        if self.lag:
            tail = self.state.before("tail", batch_id)
            every = batch.select("traj_id", "t", "x", F.lit(True).alias("new"))
            every = every if tail is None else every.unionByName(tail.withColumn("new", F.lit(False)))
            pairs = every.withColumn("y", later(F.struct("x", "new"), self.lag)).where("y.new").withColumn("y", F.col("y.x"))
            self.state.put("tail", batch_id, _tail(every.drop("new"), self.lag))
        total = None if pairs.isEmpty() else moments(pairs)
        old = self.state.before("moments", batch_id)
        if old is not None:
            import numpy as np

            before = Moments.unpack(np.array(old.first()["m"]))
            total = before if total is None else before.combine(total)
        if total is not None:
            self.state.put("moments", batch_id, self.spark.createDataFrame([(total.pack(),)], "m array<double>"))

    def start(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(options or {"availableNow": True})).start()

    def moments(self) -> Moments | None:
        import numpy as np

        found = self.state.latest("moments")
        return None if found is None else Moments.unpack(np.array(found.first()["m"]))


def partial_fit_stream(stream: DataFrame, estimator, checkpoint: str, after: Callable | None = None, **options) -> StreamingQuery:
    """Any estimator with partial_fit on a stream: each micro-batch is one call. State lives in the driver's estimator."""
    def update(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            estimator.partial_fit(batch)
            if after:
                after(estimator, batch_id)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
