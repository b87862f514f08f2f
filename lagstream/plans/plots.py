"""Tables behind plots; drawing is left to the reader's library."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lagstream.operators.validation import ChapmanKolmogorovTest, EnergyLandscape2d, ImpliedTimescales, confidence_interval


def implied_timescales_table(data: ImpliedTimescales, n_its: int | None = None, confidence: float = 0.95) -> pd.DataFrame:
    """lagtime, process, value, and the samples' mean and bounds where there are any."""
    rows = []
    for p in range(min(n_its or data.n_processes, data.n_processes)):
        samples = data.samples_for_process(p)
        for i, (lag, value) in enumerate(zip(data.lagtimes, data.timescales_for_process(p))):
            s = samples[i] if i < len(samples) else np.array([])
            lo, hi = confidence_interval(s, confidence) if len(s) else (np.nan, np.nan)
            rows.append((int(lag), p, float(value), float(s.mean()) if len(s) else np.nan, lo, hi))
    return pd.DataFrame(rows, columns=["lagtime", "process", "value", "mean", "lower", "upper"])


def ck_test_table(data: ChapmanKolmogorovTest, confidence: float = 0.95) -> pd.DataFrame:
    rows = []
    for k, lag in enumerate(data.lagtimes):
        for at in np.ndindex(data.predictions[k].shape):
            s = np.array([p[at] for p in data.predictions_samples[k]]) if data.predictions_samples else np.array([])
            lo, hi = confidence_interval(s, confidence) if len(s) else (np.nan, np.nan)
            rows.append((int(lag), *at, float(data.predictions[k][at]), float(data.estimates[k][at]), lo, hi))
    return pd.DataFrame(rows, columns=["lagtime", *"ij"[:data.predictions[0].ndim], "prediction", "estimate", "lower", "upper"])


def energy_table(e: EnergyLandscape2d) -> pd.DataFrame:
    x, y = (e.x_edges[1:] + e.x_edges[:-1]) / 2, (e.y_edges[1:] + e.y_edges[:-1]) / 2
    return pd.DataFrame({"x": np.repeat(x, len(y)), "y": np.tile(y, len(x)), "energy": e.energies.ravel()})


def density_table(x, y, bins: int = 100, weights=None, avoid_zero_counts: bool = False) -> pd.DataFrame:
    h, xe, ye = np.histogram2d(x, y, bins, weights=weights, density=True)
    if avoid_zero_counts and (h == 0).any():
        h = np.where(h == 0, h[h > 0].min(), h)
    return energy_table(EnergyLandscape2d(xe, ye, h)).rename(columns={"energy": "density"})


def contour_table(x, y, z, n_bins: int = 100) -> pd.DataFrame:
    """z at the nearest sample on a grid."""
    x, y, z = map(np.asarray, (x, y, z))
    gx, gy = np.linspace(x.min(), x.max(), n_bins), np.linspace(y.min(), y.max(), n_bins)
    grid = np.stack([np.repeat(gx, n_bins), np.tile(gy, n_bins)], 1)
    near = np.concatenate([((g[:, None] - np.stack([x, y], 1)[None]) ** 2).sum(2).argmin(1) for g in np.array_split(grid, max(1, len(grid) * len(x) // 5_000_000))])
    return pd.DataFrame({"x": grid[:, 0], "y": grid[:, 1], "z": z[near]})


def layout(adjacency: np.ndarray, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Force-directed positions (Fruchterman and Reingold 1991)."""
    a = np.asarray(adjacency, float)
    a = np.maximum(a, a.T)
    n, rng = len(a), np.random.default_rng(seed)
    x, k, heat = rng.random((n, 2)), 1 / np.sqrt(max(n, 1)), 0.1
    for _ in range(rounds):
        d = x[:, None] - x[None]
        r = np.maximum(np.sqrt((d**2).sum(2)), 0.01)
        move = (d * (k * k / r**2 - (a > 0) * r / k)[..., None]).sum(1)
        size = np.maximum(np.sqrt((move**2).sum(1)), 0.01)
        x = x + move * (np.minimum(size, heat) / size)[:, None]
        heat -= 0.1 / (rounds + 1)
    return x


def network_tables(matrix: np.ndarray, sizes=None, labels=None, positions=None, least: float = 1e-6) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nodes (state, x, y, size, label) and edges (i, j, weight) of a model's or flux's graph."""
    n = len(matrix)
    pos = layout(matrix) if positions is None else np.asarray(positions)
    nodes = pd.DataFrame({"state": range(n), "x": pos[:, 0], "y": pos[:, 1], "size": np.ones(n) if sizes is None else sizes, "label": labels if labels is not None else [str(i) for i in range(n)]})
    i, j = np.nonzero(np.where(np.asarray(matrix) > least, matrix, 0))
    return nodes, pd.DataFrame({"i": i, "j": j, "weight": np.asarray(matrix)[i, j]})


def markov_model_tables(msm, least: float = 1e-6, **kw):
    """Edges are transition probabilities whose flux pi_i T_ij exceeds least; node sizes the stationary vector."""
    t = np.where(msm.stationary_distribution[:, None] * msm.transition_matrix > least, msm.transition_matrix, 0)
    return network_tables(t, msm.stationary_distribution, least=0, **kw)


def flux_tables(f, least: float = 1e-6, **kw):
    """Net fluxes; states lie at their committor."""
    pos = np.stack([f.qplus, layout(f.net_flux)[:, 1]], 1)
    return network_tables(f.net_flux, f.stationary_distribution, positions=kw.pop("positions", pos), least=least, **kw)
