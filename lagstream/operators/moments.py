"""First and second moments of features and lagged features: mergeable partial sums by Arrow batch, one final merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.functions import linalg
from lagstream.operators import lag as _lag


@dataclass
class Moments:
    """Weight, sums and centred second moments of (x, y); merge is exact whatever the split."""

    w: float
    sx: np.ndarray
    sy: np.ndarray
    mxx: np.ndarray
    mxy: np.ndarray
    myy: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray | None = None, weights: np.ndarray | None = None) -> Moments:
        y = x if y is None else y
        w = np.ones(len(x)) if weights is None else weights
        total = w.sum()
        sx, sy = w @ x, w @ y
        cx, cy = x - sx / total if total else x, y - sy / total if total else y
        return Moments(float(total), sx, sy, (cx * w[:, None]).T @ cx, (cx * w[:, None]).T @ cy, (cy * w[:, None]).T @ cy)

    def combine(self, other: Moments) -> Moments:
        if not self.w or not other.w:
            return other if not self.w else self
        w = self.w + other.w
        dx, dy = other.sx / other.w - self.sx / self.w, other.sy / other.w - self.sy / self.w
        f = self.w * other.w / w
        return Moments(w, self.sx + other.sx, self.sy + other.sy, self.mxx + other.mxx + f * np.outer(dx, dx), self.mxy + other.mxy + f * np.outer(dx, dy), self.myy + other.myy + f * np.outer(dy, dy))

    def raw(self, name: str) -> np.ndarray:
        """Second moment about zero."""
        left, right = {"mxx": (self.sx, self.sx), "mxy": (self.sx, self.sy), "myy": (self.sy, self.sy)}[name]
        return getattr(self, name) + np.outer(left, right) / self.w

    def symmetrized(self) -> Moments:
        """Moments of the pairs together with the swapped pairs."""
        return self.combine(Moments(self.w, self.sy, self.sx, self.myy, self.mxy.T, self.mxx))

    def pack(self) -> list[float]:
        return np.concatenate([[self.w], self.sx, self.sy, self.mxx.ravel(), self.mxy.ravel(), self.myy.ravel()]).tolist()

    @staticmethod
    def unpack(values: np.ndarray) -> Moments:
        d = int(round((-2 + np.sqrt(4 + 12 * (len(values) - 1))) / 6))
        at = np.cumsum([1, d, d, d * d, d * d, d * d])
        _, sx, sy, xx, xy, yy, _ = np.split(values, at)
        return Moments(float(values[0]), sx, sy, xx.reshape(d, d), xy.reshape(d, d), yy.reshape(d, d))


def partial_moments(pairs: DataFrame, weight: str | None = None, groups: int = 64) -> DataFrame:
    """(part, m): packed moments by Arrow batch, merged to at most `groups` rows by a second stage. pairs has x and, where lagged, y."""
    lagged = "y" in pairs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                columns = [np.stack(batch.column(i).to_numpy(zero_copy_only=False)).astype(float) for i in range(1 + lagged)]
                w = batch.column(1 + lagged).to_numpy(zero_copy_only=False).astype(float) if weight else None
                own = Moments.of(columns[0], columns[1] if lagged else None, w)
                total = own if total is None else total.combine(own)
        if total is not None:
            key = hash(np.float64(total.sx.sum()).tobytes()) % groups
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.pack()])], names=["part", "m"])

    def merge(part):
        import pandas as pd

        total = None
        for m in part["m"]:
            own = Moments.unpack(np.asarray(m, float))
            total = own if total is None else total.combine(own)
        return pd.DataFrame({"part": part["part"].iloc[:1], "m": [total.pack()]})

    chosen = pairs.select("x", *["y"] * lagged, *[weight] * bool(weight))
    return chosen.mapInArrow(scan, "part int, m array<double>").groupBy("part").applyInPandas(merge, "part int, m array<double>")


def moments(pairs: DataFrame, weight: str | None = None) -> Moments:
    """All moments of a pair or feature table; at most 64 packed rows come to the driver."""
    total = None
    for row in partial_moments(pairs, weight).select("m").collect():
        own = Moments.unpack(np.asarray(row["m"]))
        total = own if total is None else total.combine(own)
    if total is None:
        raise ValueError("no frames")
    return total


def moments_sql(pairs: DataFrame, blocks: Sequence[str] | None = None, dim: int | None = None) -> DataFrame:
    """Raw moments as a long table (block, p, q, v): means (q = -1) and second moments, in DataFrame functions.

    blocks names those wanted (mean0, meant, c00, c0t, ctt; all where not given); a pair without x or y counts in none.
    dim is the number of features, of which there should be few: each cell is then an average of its own and no row is
    made for it; else every pair gives a row a cell."""
    lagged = "y" in pairs.columns
    ends = {"0": "x"} | ({"t": "y"} if lagged else {})
    pairs = pairs.dropna(subset=list(ends.values()))
    products = [b for b in ["00", *["0t", "tt"] * lagged] if blocks is None or f"c{b}" in blocks]
    means = [n for n in ends if blocks is None or f"mean{n}" in blocks]

    def cell(block, p, q, v):
        return F.struct(F.lit(block).alias("block"), p.alias("p"), q.alias("q"), v.alias("v"))

    if dim is not None:
        at = range(dim)
        wide = [(f"mean{n}", p, -1, F.get(ends[n], F.lit(p)), (n,)) for n in means for p in at]
        wide += [(f"c{a}{b}", p, q, F.get(ends[a], F.lit(p)) * F.get(ends[b], F.lit(q)), (a, b)) for a, b in products for p in at for q in at]
        sizes = [F.max(F.size(c)).alias(f"n{n}") for n, c in ends.items()]
        one = pairs.agg(*sizes, *(F.avg(v).alias(f"v{i}") for i, (*_, v, _) in enumerate(wide)))
        cells = [(cell(block, F.lit(p), F.lit(q), F.col(f"v{i}")), [F.col(f"n{n}") > k for n, k in zip(of, (p, q))]) for i, (block, p, q, _, of) in enumerate(wide)]
        there = F.filter(F.array(*(F.when(reduce(and_, held), c) for c, held in cells)), lambda c: c.isNotNull())
        return one.select(F.inline(there))

    def first(n):
        return F.transform(ends[n], lambda v, p: cell(f"mean{n}", p, F.lit(-1), v))

    def second(a, b):
        return F.flatten(F.transform(ends[a], lambda v, p: F.transform(ends[b], lambda w, q: cell(f"c{a}{b}", p, q, v * w))))

    items = F.concat(*(first(n) for n in means), *(second(a, b) for a, b in products))
    return pairs.select(F.inline(items)).groupBy("block", "p", "q").agg(F.avg("v").alias("v"))


@dataclass
class CovarianceModel:
    """Covariances C00, C0t, Ctt and means with the options they were made with."""

    cov_00: np.ndarray | None = None
    cov_0t: np.ndarray | None = None
    cov_tt: np.ndarray | None = None
    mean_0: np.ndarray | None = None
    mean_t: np.ndarray | None = None
    bessels_correction: bool = True
    symmetrized: bool = False
    lagtime: int | None = None
    data_mean_removed: bool = False

    def whiten(self, data: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
        return (data - self.mean_0) @ linalg.spd_inv_sqrt(self.cov_00, epsilon)

    def whiten_frames(self, df: DataFrame, epsilon: float = 1e-10) -> DataFrame:
        return project(df, linalg.spd_inv_sqrt(self.cov_00, epsilon), self.mean_0)


def project(df: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, out: str = "x", basis: Callable | None = None) -> DataFrame:
    """x replaced by (basis(x) - mean) @ matrix, vectorised by Arrow batch."""
    import pandas as pd

    def apply(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        a = np.stack(x.to_numpy()).astype(float)
        a = a if basis is None else np.asarray(basis(a))
        return pd.Series(list((a - (0 if mean is None else mean)) @ matrix))

    apply.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(apply, "array<double>")("x"))


class Covariance:
    """Estimator of covariances; options as in CovarianceModel. weights names a column of the table."""

    def __init__(self, lagtime: int = 0, compute_c00: bool = True, compute_c0t: bool = False, compute_ctt: bool = False, remove_data_mean: bool = False, reversible: bool = False,
                 bessels_correction: bool = True, diag_only: bool = False, weights: str | None = None):
        if reversible and lagtime == 0:
            raise ValueError("reversible covariances need a lag")
        self.lagtime, self.remove_data_mean, self.reversible = lagtime, remove_data_mean, reversible
        self.compute = (compute_c00, compute_c0t, compute_ctt)
        self.bessels_correction, self.diag_only, self.weights = bessels_correction, diag_only, weights
        self.state: Moments | None = None

    def pairs(self, df: DataFrame) -> DataFrame:
        return df if "y" in df.columns or not self.lagtime else _lag.lag_pairs(_lag.require_pairs(df, self.lagtime), self.lagtime)

    def fit(self, df: DataFrame) -> CovarianceModel:
        self.state = None
        return self.partial_fit(df).fetch_model()

    fit_fetch = fit

    def partial_fit(self, df: DataFrame) -> Covariance:
        own = moments(self.pairs(df), self.weights)
        self.state = own if self.state is None else self.state.combine(own)
        return self

    def fetch_model(self) -> CovarianceModel:
        m = self.state.symmetrized() if self.reversible else self.state
        norm = m.w - 1 if self.bessels_correction else m.w
        get = (lambda n: getattr(m, n)) if self.remove_data_mean else m.raw
        cut = (lambda c: np.diag(c)) if self.diag_only else (lambda c: c)
        c00, c0t, ctt = (cut(get(n) / norm) if on else None for n, on in zip(("mxx", "mxy", "myy"), self.compute))
        if self.reversible:
            ctt = c00
        lagged = bool(self.lagtime)
        return CovarianceModel(c00, c0t, ctt, m.sx / m.w, m.sy / m.w if lagged else None, self.bessels_correction, self.reversible, self.lagtime, self.remove_data_mean)


@dataclass
class KoopmanWeightingModel:
    """Linear weights u . x + c that reweight pairs to the stationary process."""

    u: np.ndarray
    u_const: float
    koopman_operator: np.ndarray = field(repr=False, default=None)

    def weights(self, df: DataFrame, out: str = "w") -> DataFrame:
        u = F.array(*(F.lit(float(v)) for v in self.u))
        return df.withColumn(out, F.aggregate(F.zip_with("x", u, lambda a, b: a * b), F.lit(float(self.u_const)), lambda s, v: s + v))


class KoopmanWeightingEstimator:
    def __init__(self, lagtime: int, epsilon: float = 1e-6):
        self.lagtime, self.epsilon = lagtime, epsilon

    def fit(self, df: DataFrame) -> KoopmanWeightingModel:
        c = Covariance(self.lagtime, True, True, True, remove_data_mean=True, bessels_correction=False).fit(df)
        r = linalg.spd_inv_split(c.cov_00, self.epsilon, True)
        k = r.T @ c.cov_0t @ r
        # in the basis of principal components and one
        full = np.zeros((len(k) + 1, len(k) + 1))
        full[:-1, :-1] = k
        full[-1, :-1] = (c.mean_t - c.mean_0) @ r
        full[-1, -1] = 1
        values, vectors = np.linalg.eig(full.T @ np.eye(len(full)))
        u = vectors[:, np.argmin(np.abs(values - 1))].real
        u = u / u[-1]
        linear = r @ u[:-1]
        return KoopmanWeightingModel(linear, float(u[-1] - c.mean_0 @ linear), k)


def covar(df: DataFrame, remove_mean: bool = False, weights: str | None = None) -> np.ndarray:
    return Covariance(0, remove_data_mean=remove_mean, weights=weights).fit(df).cov_00


def covars(df: DataFrame, lag: int, remove_mean: bool = False, symmetrize: bool = False, weights: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    c = Covariance(lag, True, True, remove_data_mean=remove_mean, reversible=symmetrize, weights=weights).fit(df)
    return c.cov_00, c.cov_0t
