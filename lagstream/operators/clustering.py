"""Discretisation: k-means, mini-batch k-means, regular space, boxes, and assignment to centres."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances (frames, centres) -> matrix by name.
METRICS: dict[str, Callable] = {}

#: Frames, about, that a task of MiniBatchKMeans reads.
TASK_FRAMES = 20_000


def register_metric(name: str, distance: Callable) -> None:
    METRICS[name] = distance


def euclidean(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - centers[None, :, :]) ** 2).sum(2), 0))


register_metric("euclidean", euclidean)


def _frames(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)


def assign(df: DataFrame, centers: np.ndarray, metric: str = "euclidean", out: str = "state") -> DataFrame:
    """df with the index of the nearest centre; ties go to the lowest."""
    distance, kept = METRICS[metric], df.sparkSession.sparkContext.broadcast(np.asarray(centers, float))

    def nearest(x: pd.Series) -> pd.Series:
        a = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, kept.value.shape[1]))
        return pd.Series(np.concatenate([distance(a[i:i + 4096], kept.value).argmin(1) for i in range(0, len(a), 4096)] or [np.zeros(0)]).astype("int32"))

    nearest.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(nearest, "int")("x"))


def assign_sql(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """The same by expressions: state and squared distance d2 to the nearest of a few centres."""
    def d2(c):
        ref = F.array(*(F.lit(float(v)) for v in c))
        return F.aggregate(F.zip_with("x", ref, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    every = F.array(*(F.struct(d2(c).alias("d2"), F.lit(i).alias("state")) for i, c in enumerate(np.atleast_2d(centers))))
    best = F.array_min(every)
    return df.withColumn("_b", best).withColumn("state", F.col("_b.state")).withColumn("d2", F.col("_b.d2")).drop("_b")


@dataclass
class ClusterModel:
    cluster_centers: np.ndarray
    metric: str = "euclidean"
    converged: bool = False

    n_clusters = property(lambda self: len(self.cluster_centers))

    def transform(self, df: DataFrame) -> DataFrame:
        return assign(df, self.cluster_centers, self.metric)


@dataclass
class KMeansModel(ClusterModel):
    inertias: list[float] = field(default_factory=list)
    tolerance: float | None = None
    inertia = property(lambda self: self.inertias[-1] if self.inertias else np.nan)

    def score(self, df: DataFrame) -> float:
        return cost(df, self.cluster_centers, self.metric)


def _partial(x: np.ndarray, centers: np.ndarray, distance: Callable, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, sizes and cost as in _step, of a few frames."""
    d = distance(x, centers)
    a = d.argmin(1)
    sums = np.zeros_like(centers)
    np.add.at(sums, a, x)
    total = (d[np.arange(len(x)), a] ** 2).sum() if new is None else sum((distance(x[a == k], new[k:k + 1]) ** 2).sum() for k in np.unique(a))
    return sums, np.bincount(a, minlength=len(centers)).astype(float), float(total)


def _step(df: DataFrame, centers: np.ndarray, metric: str, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and sizes of the clusters, and the cost of the assignment against `new` centres (where given)."""
    distance, kept = METRICS[metric], df.sparkSession.sparkContext.broadcast((np.asarray(centers, float), new))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, other = kept.value
        sums, sizes, total = np.zeros_like(old), np.zeros(len(old)), 0.0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = _partial(_frames(batch.column(0).slice(lo, 4096)), old, distance, other)
                sums, sizes, total = sums + own[0], sizes + own[1], total + own[2]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(old)), pa.int32()), pa.array(list(sums)), pa.array(sizes), pa.array([total] + [0.0] * (len(old) - 1))], names=["k", "s", "n", "c"])

    part = df.select("x").mapInArrow(scan, "k int, s array<double>, n double, c double")
    d = np.asarray(centers).shape[1]
    rows = part.groupBy("k").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(d))).alias("s"), F.sum("n").alias("n"), F.sum("c").alias("c")).orderBy("k").collect()  # a row a centre
    return np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows]), float(sum(r["c"] for r in rows))


def cost(df: DataFrame, centers: np.ndarray, metric: str = "euclidean") -> float:
    """Sum of squared distances to the nearest centre."""
    return _step(df, centers, metric)[2]


def lloyd_step(df: DataFrame, centers: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    return _means(*_step(df, centers, metric)[:2], centers)


def _means(sums: np.ndarray, sizes: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)


def kmeans_plusplus(df: DataFrame, n_clusters: int, metric: str = "euclidean", seed: int = 0) -> np.ndarray:
    """Greedy k-means++: of 2 + floor(ln k) candidates drawn by squared distance, the one of least cost, k times.

    A candidate is the frame of greatest log(u) / d2 with u from a digest of the frame (Efraimidis and Spirakis), so one
    distributed top-k draws all candidates of a round."""
    spark, tries = df.sparkSession, 2 + int(np.log(n_clusters))
    digest = (F.xxhash64(F.lit(seed), F.lit(-1), "x") / 2.0**64) + 0.5
    centers = np.array([df.select("x").orderBy(digest.desc()).first()["x"]], float)
    distance = METRICS[metric]
    while len(centers) < n_clusters:
        kept = spark.sparkContext.broadcast(centers)

        def d2(x: pd.Series) -> pd.Series:
            return pd.Series((distance(np.stack(x.to_numpy()).astype(float), kept.value).min(1) ** 2) if len(x) else [], dtype=float)

        d2.__annotations__ = {"x": pd.Series, "return": pd.Series}
        u = (F.xxhash64(F.lit(seed), F.lit(len(centers)), "x") / 2.0**64) + 0.5
        drawn = df.select("x", F.pandas_udf(d2, "double")("x").alias("d2")).where("d2 > 0").orderBy((F.log(u) / F.col("d2")).desc()).limit(tries).collect()
        if not drawn:
            raise ValueError("fewer distinct frames than clusters")
        options = np.array([r["x"] for r in drawn], float)
        centers = np.vstack([centers, options[int(np.argmin(_costs_with(df, centers, options, metric)))]])
    return centers


def _costs_with(df: DataFrame, centers: np.ndarray, options: np.ndarray, metric: str) -> np.ndarray:
    """The cost of the centres with each of the options, of all in one scan."""
    distance, kept = METRICS[metric], df.sparkSession.sparkContext.broadcast((centers, options))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = kept.value
        total = np.zeros(len(new))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                x = _frames(batch.column(0).slice(lo, 4096))
                total += np.minimum(distance(x, old).min(1)[:, None] ** 2, distance(x, new) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(new)), pa.int32()), pa.array(total)], names=["k", "c"])

    found = df.select("x").mapInArrow(scan, "k int, c double").groupBy("k").agg(F.sum("c").alias("c")).collect()  # a row for each option
    return np.array([r["c"] for r in sorted(found, key=lambda r: r["k"])])


class KMeans:
    """Lloyd iterations; each is one scan with partial sums. Stops when the cost of the new centres under the old
    assignment changes by at most tolerance, relative."""

    def __init__(self, n_clusters: int, max_iter: int = 500, metric: str = "euclidean", tolerance: float = 1e-5, init_strategy: str = "kmeans++", seed: int = 0):
        self.n_clusters, self.max_iter, self.metric, self.tolerance = n_clusters, max_iter, metric, tolerance
        self.init_strategy, self.seed = init_strategy, seed

    def initial_centers(self, df: DataFrame) -> np.ndarray:
        if self.init_strategy == "kmeans++":
            return kmeans_plusplus(df, self.n_clusters, self.metric, self.seed)
        if self.init_strategy != "uniform":
            raise ValueError("init_strategy is kmeans++ or uniform")
        draws = df.select("x").orderBy(F.xxhash64(F.lit(self.seed), "x")).limit(self.n_clusters).collect()
        return np.array([r["x"] for r in draws], float)

    def fit(self, df: DataFrame, initial_centers: np.ndarray | None = None, callback_loop: Callable | None = None) -> KMeansModel:
        centers = self.initial_centers(df) if initial_centers is None else np.asarray(initial_centers, float)
        inertias, before, converged = [], 0.0, False
        for _ in range(self.max_iter):
            sums, sizes, _ = _step(df, centers, self.metric)
            new = _means(sums, sizes, centers)
            now = _step(df, centers, self.metric, new)[2]
            centers = new
            inertias.append(now)
            if callback_loop:
                callback_loop()
            if now == 0 or abs(now - before) / now <= self.tolerance:
                converged = True
                break
            before = now
        if not converged:
            warnings.warn("k-means did not converge", stacklevel=2)
        return KMeansModel(centers, self.metric, converged, inertias, self.tolerance)

    fit_fetch = fit


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, x) rows to one row for each run of frames of the same b, as bytes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            b, x = batch.column(0).slice(lo, 4096).to_numpy(), _frames(batch.column(1).slice(lo, 4096))
            ends = np.flatnonzero(b[1:] != b[:-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(b[np.r_[0, ends]]), pa.array([v.tobytes() for v in np.split(x, ends)], pa.binary())], names=["b", "x"])


def _total(frames: Iterator[bytes], centers: np.ndarray, distance: Callable) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, sizes and cost of packed frames, a run in memory at a time."""
    sums, sizes, total = np.zeros_like(centers), np.zeros(len(centers)), 0.0
    for v in frames:
        own = _partial(np.frombuffer(v).reshape(-1, centers.shape[1]), centers, distance)
        sums, sizes, total = sums + own[0], sizes + own[1], total + own[2]
    return sums, sizes, total


def _still(before: float, now: float, tolerance: float) -> bool:
    return bool(now == 0 or abs(now - before) / now <= tolerance)


class MiniBatchKMeans(KMeans):
    """Batches by a digest of the frame; each step replaces the centres by the batch means.

    A step needs the centres of the step before, so the batches of an epoch follow one another. Each epoch deals the
    frames out once, in the order of the batches: many small batches to a partition, where one task makes their steps, or a
    large batch over several partitions. A partition is read when its turn comes and never if the epoch has ended by
    then; centres and costs come to the driver."""

    def __init__(self, n_clusters: int, batch_size: int = 100, max_iter: int = 5, metric: str = "euclidean", tolerance: float = 1e-5, init_strategy: str = "kmeans++", seed: int = 0):
        super().__init__(n_clusters, max_iter, metric, tolerance, init_strategy, seed)
        self.batch_size, self.model = batch_size, None

    def partial_fit(self, df: DataFrame) -> KMeansModel:
        old = self.initial_centers(df) if self.model is None else self.model.cluster_centers
        new = lloyd_step(df, old, self.metric)
        now, inertias = cost(df, new, self.metric), [] if self.model is None else self.model.inertias
        before = inertias[-1] if inertias else np.inf
        self.model = KMeansModel(new, self.metric, _still(before, now, self.tolerance), [*inertias, now], self.tolerance)
        return self.model

    def fit(self, df: DataFrame, initial_centers: np.ndarray | None = None) -> KMeansModel:
        self.model = KMeansModel(self.initial_centers(df) if initial_centers is None else np.asarray(initial_centers, float), self.metric, tolerance=self.tolerance)
        n = df.count()
        for epoch in range(self.max_iter):
            self._epoch(df, n, self.seed + epoch)
        return self.model

    def _epoch(self, df: DataFrame, n: int, seed: int) -> None:
        """Steps over the batches of one shuffle, up to the first that converges."""
        batches = max(1, -(-n // self.batch_size))
        size = max(1, -(-n // batches))
        run, shares = max(1, TASK_FRAMES // size), -(-size // TASK_FRAMES)  # batches a partition; partitions a batch
        digest = F.xxhash64(F.lit(seed), "traj_id", "t")
        b = F.pmod(digest, F.lit(batches))
        part = F.floor(F.col("b") / run) * shares + F.pmod(F.xxhash64(F.lit(-1), "traj_id", "t"), F.lit(shares))
        runs = -(-batches // run)
        dealt = df.select(b.cast("long").alias("b"), "traj_id", "t", "x").repartitionById(runs * shares, part.cast("int")).sortWithinPartitions("b", "traj_id", "t")
        packed = dealt.select("b", "x").mapInArrow(_pack, "b long, x binary").rdd
        context, distance, tolerance, d = df.sparkSession.sparkContext, METRICS[self.metric], self.tolerance, self.model.cluster_centers.shape[1]

        def steps(rows, centers, before):
            """The centres after the batches of a partition, the costs, and whether the last converged."""
            costs: list[float] = []
            for _, own in groupby(rows, key=lambda r: r[0]):
                x = np.concatenate([np.frombuffer(r[1]).reshape(-1, d) for r in own])
                pieces = [x[lo:lo + 4096].tobytes() for lo in range(0, len(x), 4096)]
                centers = _means(*_total(pieces, centers, distance)[:2], centers)
                costs.append(_total(pieces, centers, distance)[2])
                if _still(before, costs[-1], tolerance):
                    return centers, costs, True
                before = costs[-1]
            return centers, costs, False

        def share(at: list[int], centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            found = context.runJob(packed, lambda rows: [_total((r[1] for r in rows), centers, distance)], at)
            return sum(f[0] for f in found), sum(f[1] for f in found), float(sum(f[2] for f in found))

        for i in range(runs):
            m = self.model
            before = m.inertias[-1] if m.inertias else np.inf
            if shares == 1:
                centers, costs, done = context.runJob(packed, lambda rows, c=m.cluster_centers, v=before: [steps(rows, c, v)], [i])[0]
            else:
                at = list(range(i * shares, (i + 1) * shares))
                sums, sizes, _ = share(at, m.cluster_centers)
                centers = _means(sums, sizes, m.cluster_centers)
                costs = [share(at, centers)[2]] if sizes.sum() else []
                done = bool(costs) and _still(before, costs[0], tolerance)
            m.inertias.extend(costs)
            self.model = KMeansModel(centers, self.metric, done if costs else m.converged, m.inertias, self.tolerance)
            if done:
                break


class RegularSpace:
    """Sequential leader clustering in the order of (traj_id, t): a frame farther than dmin from all centres becomes one.

    Frames within dmin of a known centre never matter later, so each round filters them out in a distributed scan and
    takes the centres of the first frames left over; the driver sees at most `window` frames a round."""

    def __init__(self, dmin: float, max_centers: int = 1000, metric: str = "euclidean", window: int = 2000):
        self.dmin, self.max_centers, self.metric, self.window = dmin, max_centers, metric, window
        self.centers: np.ndarray | None = None

    def partial_fit(self, df: DataFrame) -> ClusterModel:
        distance = METRICS[self.metric]
        while True:
            rest = df
            if self.centers is not None:
                kept = df.sparkSession.sparkContext.broadcast(self.centers)

                def far(x: pd.Series) -> pd.Series:
                    return pd.Series(distance(np.stack(x.to_numpy()).astype(float), kept.value).min(1) if len(x) else [], dtype=float)

                far.__annotations__ = {"x": pd.Series, "return": pd.Series}
                rest = df.where(F.pandas_udf(far, "double")("x") > self.dmin)
            first = rest.select("traj_id", "t", "x").orderBy("traj_id", "t").limit(self.window).collect()
            for r in first:
                x = np.asarray(r["x"], float)[None]
                if self.centers is None:
                    self.centers = x
                elif distance(x, self.centers).min() > self.dmin:
                    if len(self.centers) >= self.max_centers:
                        warnings.warn("maximum number of centres reached", stacklevel=2)
                        return ClusterModel(self.centers, self.metric)
                    self.centers = np.vstack([self.centers, x])
            if len(first) < self.window:
                return ClusterModel(self.centers, self.metric, True)

    def fit(self, df: DataFrame) -> ClusterModel:
        self.centers = None
        return self.partial_fit(df)

    fit_fetch = fit


@dataclass
class BoxModel(ClusterModel):
    v0: np.ndarray = None
    v1: np.ndarray = None
    n_boxes: np.ndarray = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Nearest grid node by expressions: each dimension on its own, ties to the lower node."""
        state, stride = F.lit(0), 1
        for p in range(len(self.v0)):
            n = int(self.n_boxes[p])
            width = (self.v1[p] - self.v0[p]) / max(n - 1, 1)
            node = F.lit(0) if width == 0 else F.least(F.greatest(F.ceil((F.col("x")[p] - float(self.v0[p])) / float(width) - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
            state, stride = state + node * stride, stride * n
        return df.withColumn("state", state.cast("int"))

    def transform_onehot(self, df: DataFrame) -> DataFrame:
        n = len(self.cluster_centers)
        return self.transform(df).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("state")).cast("double")))


class BoxDiscretization:
    """Grid nodes at linspace(v0, v1, n) in each dimension, both ends included; bounds from the data where not given.
    The first dimension varies fastest."""

    def __init__(self, dim: int, n_boxes, v0=None, v1=None):
        self.dim, self.n_boxes = dim, np.broadcast_to(np.asarray(n_boxes, int), (dim,))
        self.v0, self.v1 = v0, v1

    def fit(self, df: DataFrame) -> BoxModel:
        v0, v1 = self.v0, self.v1
        if v0 is None or v1 is None:
            ends = df.agg(*(f(F.col("x")[p]).alias(f"{n}{p}") for n, f in (("lo", F.min), ("hi", F.max)) for p in range(self.dim))).first()
            v0 = [ends[f"lo{p}"] for p in range(self.dim)] if v0 is None else v0
            v1 = [ends[f"hi{p}"] for p in range(self.dim)] if v1 is None else v1
        v0, v1 = np.asarray(v0, float), np.asarray(v1, float)
        axes = [np.linspace(a, b, n) for a, b, n in zip(v0, v1, self.n_boxes)]
        grid = np.stack([g.ravel(order="F") for g in np.meshgrid(*axes, indexing="ij")], 1)
        return BoxModel(grid, "euclidean", True, v0, v1, self.n_boxes)

    fit_fetch = fit
