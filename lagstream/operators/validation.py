"""Statistics of samples, implied timescales, Chapman-Kolmogorov tests, histograms and free energies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confidence_interval(data, conf: float = 0.95, remove_nans: bool = False):
    """Bounds around the mean that hold the share conf of the samples, half on either side of the mean's rank; element-wise on axis 0."""
    if not 0 < conf <= 1:
        raise ValueError("confidence must be in (0, 1]")
    data = np.asarray(data, float)
    if data.ndim > 1:
        pairs = [confidence_interval(c, conf, remove_nans) for c in data.reshape(len(data), -1).T]
        return tuple(np.array(x).reshape(data.shape[1:]) for x in zip(*pairs))
    if remove_nans:
        data = data[~np.isnan(data)]
    if not len(data) or np.isnan(data).any():
        return np.nan, np.nan
    x = np.sort(data)
    if conf == 1 or x[0] == x[-1]:
        return float(x[0]), float(x[-1])
    mean, n = x.mean(), len(x)
    k = int(np.clip(np.searchsorted(x, mean), 1, n - 1))
    rank = k - 1 + (mean - x[k - 1]) / max(x[k] - x[k - 1], 1e-300)
    at = lambda r: float(np.interp(r, np.arange(n), x))
    return at(rank - conf * rank), at(rank + conf * (n - 1 - rank))


def evaluate_samples(samples: Sequence, quantity: str, delimiter: str = "/", *args, **kw) -> list:
    """A path of attributes and methods, evaluated on each sample; arguments go to the last."""
    out = []
    for s in samples:
        steps = quantity.split(delimiter)
        for i, name in enumerate(steps):
            s = getattr(s, name)
            if callable(s):
                s = s(*args, **kw) if i == len(steps) - 1 else s()
        out.append(s)
    return out


class QuantityStatistics:
    def __init__(self, samples, confidence: float = 0.95, store_samples: bool = False):
        values = np.asarray(samples, float)
        self.mean, self.std = values.mean(0), values.std(0)
        self.lower, self.upper = confidence_interval(values, confidence)
        self.L, self.R, self.samples = self.lower, self.upper, values if store_samples else None


class BayesianModel:
    """Has prior and samples."""

    def evaluate_samples(self, quantity: str, delimiter: str = "/", *args, **kw) -> list:
        return evaluate_samples(self.samples, quantity, delimiter, *args, **kw)

    def gather_stats(self, quantity: str, store_samples: bool = False, delimiter: str = "/", confidence: float = 0.95, *args, **kw) -> QuantityStatistics:
        return QuantityStatistics(self.evaluate_samples(quantity, delimiter, *args, **kw), confidence, store_samples)


@dataclass
class ImpliedTimescales:
    lagtimes: np.ndarray
    its: np.ndarray
    its_stats: list = field(default_factory=list)

    n_processes = property(lambda self: self.its.shape[1])
    max_n_samples = property(lambda self: max((len(s) for s in self.its_stats if s is not None), default=0))

    def timescales_for_process(self, i: int) -> np.ndarray:
        return self.its[:, i]

    def samples_for_process(self, i: int) -> list[np.ndarray]:
        return [np.array([]) if s is None else np.array([row[i] for row in s]) for s in self.its_stats]


def implied_timescales(models: Sequence, n_its: int | None = None) -> ImpliedTimescales:
    """Timescales of models by ascending lag; missing processes are NaN."""
    models = sorted(models, key=lambda m: (m.prior if hasattr(m, "prior") else m).lagtime)
    prior = [m.prior if hasattr(m, "prior") else m for m in models]
    rows = [np.asarray(m.timescales())[:n_its] for m in prior]
    width = max(map(len, rows))
    pad = lambda x: np.pad(np.asarray(x, float)[:width], (0, max(0, width - len(x))), constant_values=np.nan)
    stats = [[pad(s.timescales()) for s in m.samples] if hasattr(m, "samples") else None for m in models]
    return ImpliedTimescales(np.array([m.lagtime for m in prior]), np.array([pad(r) for r in rows]), stats)


@dataclass
class ChapmanKolmogorovTest:
    lagtimes: np.ndarray
    predictions: np.ndarray
    estimates: np.ndarray
    predictions_samples: list | None = None
    estimates_samples: list | None = None
    observable: Callable | None = None


def ck_test(models: Sequence, observable: Callable, test_model=None, include_lag0: bool = True, err_est: bool = False) -> ChapmanKolmogorovTest:
    """Predictions of the test model (that of least lag) at the lags of all models, against each model's own estimate."""
    lag = lambda m: (m.prior if hasattr(m, "prior") else m).lagtime
    own = lambda m: m.prior if hasattr(m, "prior") else m
    models = sorted(models, key=lag)
    test = models[0] if test_model is None else test_model
    lags = ([0] if include_lag0 else []) + [lag(m) for m in models]
    predictions = [observable(own(test), t / lag(test)) for t in lags]
    estimates = ([observable(own(test), 0)] if include_lag0 else []) + [observable(own(m), 1) for m in models]
    samples = [[observable(s, t / lag(test)) for s in test.samples] for t in lags] if hasattr(test, "samples") else None
    errors = [[observable(s, 1) for s in m.samples] for m in models] if err_est and all(hasattr(m, "samples") for m in models) else None
    return ChapmanKolmogorovTest(np.array(lags), np.array(predictions), np.array(estimates), samples, errors, observable)


# --- histograms


def histogram2d(df: DataFrame, bins: int, bounds, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """(bx, by, n): two-dimensional histogram; the last bin is closed. bounds are (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = map(float, bounds)
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - a) / ((b - a) / bins)), F.lit(bins - 1)).cast("int")
    inside = (F.col(x) >= x0) & (F.col(x) <= x1) & (F.col(y) >= y0) & (F.col(y) <= y1)
    value = F.sum(weight) if weight else F.count("*").cast("double")
    return df.where(inside).groupBy(cell(x, x0, x1).alias("bx"), cell(y, y0, y1).alias("by")).agg(value.alias("n"))


def bounds2d(df: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float, float, float]:
    r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return tuple(float(v) for v in r)


@dataclass
class EnergyLandscape2d:
    x_edges: np.ndarray
    y_edges: np.ndarray
    energies: np.ndarray
    kbt: float = 1.0


def energy2d(df: DataFrame, bins: int = 100, kbt: float = 1.0, weight: str | None = None, shift: bool = True, x: str = "x", y: str = "y") -> EnergyLandscape2d:
    """-kT ln p over a grid; empty cells are infinite, the least energy is zero where shifted."""
    bounds = bounds2d(df, x, y)
    grid = np.zeros((bins, bins))
    for r in histogram2d(df, bins, bounds, x, y, weight).collect():  # at most bins^2 rows
        grid[r["bx"], r["by"]] = r["n"]
    with np.errstate(divide="ignore"):
        e = -kbt * np.log(grid / grid.sum())
    if shift:
        e -= e[np.isfinite(e)].min()
    return EnergyLandscape2d(np.linspace(*bounds[:2], bins + 1), np.linspace(*bounds[2:], bins + 1), e, kbt)
