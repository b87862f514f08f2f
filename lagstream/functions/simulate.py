"""Data generators: dynamical systems integrated for many trajectories in parallel, and analytic chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lagstream.functions import analysis


@dataclass
class System:
    """dx = rhs(t, x) dt (+ sigma dW): Runge-Kutta of order 4, or Euler-Maruyama where sigma is given. h is the step, n_steps
    the steps between frames. rhs takes rows of positions."""

    dim: int
    rhs: Callable[[float, np.ndarray], np.ndarray]
    h: float
    n_steps: int
    sigma: np.ndarray | None = None
    potential: Callable[[np.ndarray], np.ndarray] | None = None
    boundary: Callable[[np.ndarray], np.ndarray] | None = None
    props: dict = field(default_factory=dict)

    def step(self, t: float, x: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        h, f = self.h, self.rhs
        if self.sigma is not None:
            x = x + h * f(t, x) + np.sqrt(h) * rng.standard_normal(x.shape) @ np.atleast_2d(self.sigma).T
        else:
            k1 = f(t, x)
            k2 = f(t + h / 2, x + h / 2 * k1)
            k3 = f(t + h / 2, x + h / 2 * k2)
            k4 = f(t + h, x + h * k3)
            x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        return x if self.boundary is None else self.boundary(x)

    def trajectory(self, x0, length: int, seed: int = 0, t0: float = 0.0) -> np.ndarray:
        """Frames of one or (rows of x0) several trajectories: (length, dim) or (rows, length, dim)."""
        x = np.atleast_2d(np.asarray(x0, float))
        rng, out, t = np.random.default_rng(seed), [x], t0
        for _ in range(length - 1):
            for _ in range(self.n_steps):
                x = self.step(t, x, rng)
                t += self.h
            out.append(x)
        out = np.stack(out, 1)
        return out[0] if np.ndim(x0) == 1 else out

    def __call__(self, x, seed: int = 0, t0: float = 0.0) -> np.ndarray:
        """One frame ahead for each row."""
        return self.trajectory(np.atleast_2d(x), 2, seed, t0)[:, 1]

    def table(self, spark: SparkSession, x0: np.ndarray, length: int, seed: int = 0) -> DataFrame:
        """(traj_id, t, x): a trajectory for each row of x0, seeded by its id, whatever the partition."""
        x0 = np.atleast_2d(np.asarray(x0, float))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for i in part["id"]:
                    x = self.trajectory(x0[i], length, seed + int(i))
                    yield pd.DataFrame({"traj_id": int(i), "t": np.arange(length), "x": list(x)})

        return spark.range(len(x0)).mapInPandas(run, "traj_id long, t long, x array<double>")


def custom_ode(dim: int, rhs: Callable, h: float, n_steps: int) -> System:
    return System(dim, lambda t, x: np.apply_along_axis(rhs, 1, x), h, n_steps)


def custom_sde(dim: int, rhs: Callable, sigma, h: float, n_steps: int) -> System:
    return System(dim, lambda t, x: np.apply_along_axis(rhs, 1, x), h, n_steps, np.asarray(sigma, float))


# fixed values: parameters of the standard test systems


def lorenz_system(h: float = 2e-5, n_steps: int = 100) -> System:
    def f(t, x):
        return np.stack([10 * (x[:, 1] - x[:, 0]), x[:, 0] * (28 - x[:, 2]) - x[:, 1], x[:, 0] * x[:, 1] - 8 / 3 * x[:, 2]], 1)

    return System(3, f, h, n_steps)


def thomas_attractor(b: float = 0.15, h: float = 1e-3, n_steps: int = 1000) -> System:
    return System(3, lambda t, x: np.sin(np.roll(x, -1, 1)) - b * x, h, n_steps)


def abc_flow(h: float = 1e-3, n_steps: int = 10000) -> System:
    a, b, c = np.sqrt(3), np.sqrt(2), 1.0

    def f(t, x):
        return np.stack([a * np.sin(x[:, 2]) + c * np.cos(x[:, 1]), b * np.sin(x[:, 0]) + a * np.cos(x[:, 2]), c * np.sin(x[:, 1]) + b * np.cos(x[:, 0])], 1)

    return System(3, f, h, n_steps, boundary=lambda x: np.mod(x, 2 * np.pi))


def ornstein_uhlenbeck(h: float = 1e-3, n_steps: int = 500) -> System:
    return System(1, lambda t, x: -x, h, n_steps, np.array([[0.5]]), lambda x: (x**2).sum(1) / 2)


def _gradient(potential: Callable, eps: float = 1e-6) -> Callable:
    def f(t, x):
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            e = np.zeros(x.shape[1])
            e[i] = eps
            out[:, i] = -(potential(x + e) - potential(x - e)) / (2 * eps)
        return out

    return f


def prinz_potential(h: float = 1e-5, n_steps: int = 500, temperature_factor: float = 1.0, mass: float = 1.0, damping: float = 1.0) -> System:
    def v(x):
        q = x[:, 0]
        return 4 * (q**8 + 0.8 * np.exp(-80 * q**2) + 0.2 * np.exp(-80 * (q - 0.5) ** 2) + 0.5 * np.exp(-40 * (q + 0.5) ** 2))

    g = _gradient(v)
    return System(1, lambda t, x: g(t, x) / (mass * damping), h, n_steps, np.array([[np.sqrt(2 * temperature_factor / (mass * damping))]]), v)


def triple_well_1d(h: float = 1e-3, n_steps: int = 500) -> System:
    # fixed values: coefficients of the force, constant term first
    force = (24.82002100, -82.85029600, 82.6031550, -34.125104, 6.20030, -0.4104)
    return System(1, lambda t, x: np.polynomial.polynomial.polyval(x, force), h, n_steps, np.array([[0.75]]))


def double_well_2d(h: float = 1e-3, n_steps: int = 10000, temperature_factor: float = 1.0, mass: float = 1.0, damping: float = 1.0) -> System:
    def v(x):
        return (x[:, 0] ** 2 - 1) ** 2 + x[:, 1] ** 2

    def f(t, x):
        return np.stack([-4 * x[:, 0] * (x[:, 0] ** 2 - 1), -2 * x[:, 1]], 1) / (mass * damping)

    return System(2, f, h, n_steps, np.sqrt(0.5 * temperature_factor / (mass * damping)) * np.eye(2), v)


def quadruple_well(h: float = 1e-3, n_steps: int = 10000) -> System:
    def f(t, x):
        return -4 * x * (x**2 - 1)

    return System(2, f, h, n_steps, 0.7 * np.eye(2), lambda x: ((x**2 - 1) ** 2).sum(1))


def quadruple_well_asymmetric(h: float = 1e-3, n_steps: int = 10000) -> System:
    def v(x):
        a, b = x[:, 0], x[:, 1]
        return a**4 - a**3 / 16 - 2 * a**2 + 3 * a / 16 + b**4 - b**3 / 8 - 2 * b**2 + 3 * b / 8

    def f(t, x):
        a, b = x[:, 0], x[:, 1]
        return np.stack([-4 * a**3 + 3 * a**2 / 16 + 4 * a - 3 / 16, -4 * b**3 + 3 * b**2 / 8 + 4 * b - 3 / 8], 1)

    return System(2, f, h, n_steps, 0.6 * np.eye(2), v)


def triple_well_2d(h: float = 1e-5, n_steps: int = 10000) -> System:
    def v(x):
        a, b = x[:, 0], x[:, 1]
        return (3 * np.exp(-(a**2) - (b - 1 / 3) ** 2) - 3 * np.exp(-(a**2) - (b - 5 / 3) ** 2) - 5 * np.exp(-((a - 1) ** 2) - b**2) - 5 * np.exp(-((a + 1) ** 2) - b**2) + 0.2 * a**4 + 0.2 * (b - 1 / 3) ** 4)

    return System(2, _gradient(v), h, n_steps, 1.09 * np.eye(2), v)


def time_dependent_quintuple_well(h: float = 1e-3, n_steps: int = 10000, beta: float = 5.0) -> System:
    def v(t, x):
        r, phi = np.hypot(x[:, 0], x[:, 1]), np.arctan2(x[:, 1], x[:, 0])
        return np.cos(5 * phi - np.pi / 2 * t) + 10 * (r - 1.5 - 0.5 * np.sin(2 * np.pi * t)) ** 2

    def f(t, x):
        return _gradient(lambda y: v(t, y))(t, x)

    return System(2, f, h, n_steps, np.sqrt(2 / beta) * np.eye(2))


def bickley_jet(h: float = 1e-2, n_steps: int = 10) -> System:
    """Time-dependent jet in (0, 20) x (-3, 3), periodic in x."""
    u0, length, re = 5.4138, 1.77, 6.371
    c = np.array([0.1446, 0.205, 0.461]) * u0
    eps = np.array([0.075, 0.15, 0.3])
    k = np.array([2, 4, 6]) / re

    def f(t, x):
        px, py = x[:, :1], x[:, 1] / length
        sech2 = 1 / np.cosh(py) ** 2
        wave, turn = np.cos(k * (px - c * t)), np.sin(k * (px - c * t))
        u = u0 * sech2 + 2 * u0 * np.tanh(py) * sech2 * (wave @ eps)
        v = -u0 * length * sech2 * (turn @ (eps * k))
        return np.stack([u, v], 1)

    def wrap(x):
        return np.stack([np.mod(x[:, 0], 20), x[:, 1]], 1)

    return System(2, f, h, n_steps, boundary=wrap)


def bickley_endpoints(spark: SparkSession, n_particles: int, frames: int = 401, seed: int = 0) -> DataFrame:
    """(traj_id, x, y, p, q): first and last positions of particles, and both on a cylinder in 3-D."""
    rng = np.random.default_rng(seed)
    start = np.stack([rng.uniform(0, 20, n_particles), rng.uniform(-3, 3, n_particles)], 1)
    system = bickley_jet()

    def cylinder(x):
        r = 30 / np.pi
        return np.stack([np.cos(x[:, 0] * np.pi / 10) * r, np.sin(x[:, 0] * np.pi / 10) * r, x[:, 1]], 1)

    def run(parts):
        for part in parts:
            at = part["id"].to_numpy()
            end = system.trajectory(start[at], frames)[:, -1]
            yield pd.DataFrame({"traj_id": at, "x": list(start[at]), "y": list(end), "p": list(cylinder(start[at])), "q": list(cylinder(end))})

    return spark.range(n_particles).mapInPandas(run, "traj_id long, x array<double>, y array<double>, p array<double>, q array<double>")


# --- chains


class BirthDeathChain:
    """Nearest-neighbour chain: q to the left, p to the right; closed forms of its properties."""

    def __init__(self, q, p):
        self.q, self.p = np.asarray(q, float), np.asarray(p, float)
        if self.q[0] != 0 or self.p[-1] != 0 or (self.q + self.p > 1).any():
            raise ValueError("not a birth-death chain")

    dim = property(lambda self: len(self.q))
    transition_matrix = property(lambda self: np.diag(1 - self.q - self.p) + np.diag(self.q[1:], -1) + np.diag(self.p[:-1], 1))

    @property
    def stationary_distribution(self) -> np.ndarray:
        x = np.concatenate([[1], np.cumprod(self.p[:-1] / self.q[1:])])
        return x / x.sum()

    def committor_forward(self, a: int, b: int) -> np.ndarray:
        """Probability to reach b before a (all below a, all above b)."""
        g = np.concatenate([[1], np.cumprod(self.q[a + 1:b] / self.p[a + 1:b])])
        out = np.zeros(self.dim)
        out[a:b + 1] = np.concatenate([[0], np.cumsum(g) / g.sum()])
        out[b:] = 1
        return out

    def committor_backward(self, a: int, b: int) -> np.ndarray:
        return 1 - self.committor_forward(a, b)

    def flux(self, a: int, b: int) -> np.ndarray:
        out, pi, qp = np.zeros((self.dim,) * 2), self.stationary_distribution, self.committor_forward(a, b)
        for i in range(self.dim - 1):
            out[i, i + 1] = pi[i] * (1 - qp[i]) * self.p[i] * qp[i + 1]
            out[i + 1, i] = pi[i + 1] * (1 - qp[i + 1]) * self.q[i + 1] * qp[i]
        return out

    def net_flux(self, a: int, b: int) -> np.ndarray:
        f = self.flux(a, b)
        return np.maximum(f - f.T, 0)

    def total_flux(self, a: int, b: int) -> float:
        return float(self.net_flux(a, b)[a, a + 1])

    def rate(self, a: int, b: int) -> float:
        return self.total_flux(a, b) / float(self.stationary_distribution @ self.committor_backward(a, b))


def tmatrix_metropolis1d(energies, d: float = 1.0) -> np.ndarray:
    """Metropolis chain over neighbouring states of given energies (in kT)."""
    e = np.asarray(energies, float)
    t = np.diag(0.5 / d * np.minimum(1, np.exp(-(e[1:] - e[:-1]))), 1) + np.diag(0.5 / d * np.minimum(1, np.exp(-(e[:-1] - e[1:]))), -1)
    return t + np.diag(1 - t.sum(1))


class DrunkardsWalk:
    """Random walk on a grid from a bar to a home, to any of the eight neighbours with equal probability.

    Bar and home keep the walker: staying has a hundred times the weight of a step. Barriers are lines of cells: a
    step onto one has no weight, or 1 / weight where it has one; who stands on an impassable one stays like at home."""

    STAY = 100.0

    def __init__(self, grid_size, bar_location, home_location):
        self.grid_size = self.n, self.m = grid_size
        self.bar_location, self.home_location = np.atleast_2d(bar_location), np.atleast_2d(home_location)
        self.bar_state, self.home_state = ([self.coordinate_to_state(c) for c in cells] for cells in (self.bar_location, self.home_location))
        self.barriers: dict[tuple[int, int], float | None] = {}

    n_states = property(lambda self: self.n * self.m)

    def coordinate_to_state(self, c) -> int:
        return int(c[0] + self.n * c[1])

    def state_to_coordinate(self, s: int) -> tuple[int, int]:
        return s % self.n, s // self.n

    def is_valid_coordinate(self, c) -> bool:
        return 0 <= c[0] < self.n and 0 <= c[1] < self.m

    @staticmethod
    def line(begin, end) -> list[tuple[int, int]]:
        """Cells of a straight line (Bresenham 1965); a diagonal step also takes the cell beside it, so nobody slips through."""
        (x, y), cells = begin, []
        width, height = abs(end[0] - x), abs(end[1] - y)
        right, up = (1 if end[0] > x else -1), (1 if end[1] > y else -1)
        balance = width - height
        while (x, y) != tuple(end):
            cells.append((x, y))
            across, along = 2 * balance >= -height, 2 * balance <= width
            if across:
                x, balance = x + right, balance - height
            if along:
                y, balance = y + up, balance + width
            if across and along:
                cells.append((x, y - up))
        return [*cells, (x, y)]

    def add_barrier(self, begin, end, weight: float | None = None) -> None:
        """A barrier along a line: impassable, or stepped onto with 1 / weight of the probability. A cell keeps its first barrier."""
        for cell in self.line(begin, end):
            self.barriers.setdefault(cell, weight)

    @property
    def transition_matrix(self) -> np.ndarray:
        ends = {*self.bar_state, *self.home_state}
        t = np.zeros((self.n_states,) * 2)
        for s in range(self.n_states):
            here = self.state_to_coordinate(s)
            stuck = here in self.barriers and self.barriers[here] is None
            t[s, s] = self.STAY if s in ends or stuck else 0.0
            for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
                there = here[0] + dx, here[1] + dy
                if self.is_valid_coordinate(there):
                    o = self.coordinate_to_state(there)
                    if there in self.barriers:
                        t[s, o] = 1 / self.barriers[there] if self.barriers[there] is not None else 0.0
                    else:
                        t[s, o] = self.STAY if s in ends and o in ends else 1.0
        return t / t.sum(1, keepdims=True)

    @property
    def msm(self):
        from lagstream.operators.msm import MarkovStateModel

        return MarkovStateModel(self.transition_matrix)

    def walk(self, start, n: int, stop: bool = True, seed: int = 0) -> np.ndarray:
        """Coordinates of a walk, which ends at the bar or at home, or with stop=False after n steps."""
        states = self.msm.simulate(n, self.coordinate_to_state(start), [*self.bar_state, *self.home_state] if stop else None, seed=seed)
        return np.array([self.state_to_coordinate(int(s)) for s in states])


def _chain(t: np.ndarray, n: int, seed: int) -> np.ndarray:
    from lagstream.operators.msm import MarkovStateModel

    return MarkovStateModel(t, analysis.stationary_distribution(t)).simulate(n, seed=seed)


def ellipsoids(n: int, laziness: float = 0.97, seed: int = 0, n_dim: int = 2, noise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states and observations of two thin Gaussians between which a lazy chain jumps, rotated into n_dim."""
    hidden = _chain(np.array([[laziness, 1 - laziness], [1 - laziness, laziness]]), n, seed)
    rng = np.random.default_rng(seed + 1)
    x = np.array([[0.0, 5.0], [0.0, -5.0]])[hidden] + rng.multivariate_normal([0, 0], [[5.7, 5.65], [5.65, 5.7]], n)
    if n_dim > 2:
        rotation = np.linalg.qr(rng.standard_normal((n_dim, n_dim)))[0][:2]
        x = x @ rotation + noise * rng.standard_normal((n, n_dim))
    return hidden, x


def sqrt_model(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two hidden states whose observations are bent by a square root."""
    hidden = _chain(np.array([[0.95, 0.05], [0.05, 0.95]]), n, seed)
    x = np.array([[0.0, 1.0], [0.0, -1.0]])[hidden] + np.random.default_rng(seed + 1).multivariate_normal([0, 0], [[30, 0], [0, 0.015]], n)
    return hidden, np.stack([x[:, 0], x[:, 1] + np.sqrt(np.abs(x[:, 0]))], 1)


def swissroll_model(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Four hidden states on a rolled sheet in three dimensions."""
    t = np.array([[0.95, 0.05, 0, 0], [0.05, 0.9, 0.05, 0], [0, 0.05, 0.9, 0.05], [0, 0, 0.05, 0.95]])
    hidden = _chain(t, n, seed)
    x = np.array([[7.5, 7.5], [7.5, 15.0], [15.0, 15.0], [15.0, 7.5]])[hidden] + np.random.default_rng(seed + 1).standard_normal((n, 2))
    return hidden, np.stack([x[:, 0] * np.cos(x[:, 0]), x[:, 1], x[:, 0] * np.sin(x[:, 0])], 1)


class PositionBasedFluids:
    """Two-dimensional fluid: positions corrected until densities are even, velocities from the corrections."""

    def __init__(self, domain_size, initial_positions, interaction_distance: float, n_solver_iterations: int = 5, gravity: float = 10.0, epsilon: float = 10.0, timestep: float = 0.016, rest_density: float = 1.0):
        self.size, self.x = np.asarray(domain_size, float), np.asarray(initial_positions, float).copy()
        self.v, self.r = np.zeros_like(self.x), interaction_distance
        self.iterations, self.gravity, self.epsilon, self.dt, self.rho0 = n_solver_iterations, gravity, epsilon, timestep, rest_density

    def _neighbours(self, x: np.ndarray):
        d = x[:, None] - x[None]
        r = np.sqrt((d**2).sum(2))
        return d, r, (r < self.r) & (r > 0)

    def step(self, drift: float = 0.0) -> np.ndarray:
        half = self.size / 2
        self.v[:, 1] -= self.gravity * self.dt
        self.v[:, 0] += drift * self.dt
        x = np.clip(self.x + self.dt * self.v, -half, half)
        for _ in range(self.iterations):
            d, r, near = self._neighbours(x)
            w = np.where(near, 4 / (np.pi * self.r**8) * (self.r**2 - r**2) ** 3, 0)
            grad = np.where(near[..., None], -30 / (np.pi * self.r**5) * ((self.r - r) ** 2 / np.maximum(r, 1e-12))[..., None] * d, 0) / self.rho0
            c = w.sum(1) / self.rho0 - 1
            lam = -c / ((grad**2).sum((1, 2)) + (grad.sum(1) ** 2).sum(1) + self.epsilon)
            x = np.clip(x + ((lam[:, None] + lam[None])[..., None] * grad).sum(1), -half, half)
        self.v, self.x = (x - self.x) / self.dt, x
        return x

    def run(self, n: int, drift: float = 0.0) -> np.ndarray:
        return np.stack([self.step(drift).copy() for _ in range(n)])


class DoubleWellDiscrete:
    """A chain over 100 bins of a double well, generated from its energies, with three coarse state definitions."""

    def __init__(self, n: int = 100, barrier: float = 3.0):
        x = np.linspace(-1.5, 1.5, n)
        self.transition_matrix = tmatrix_metropolis1d(barrier * (x**2 - 1) ** 2)
        self.n = n

    @property
    def analytic_msm(self):
        from lagstream.operators.msm import MarkovStateModel

        return MarkovStateModel(self.transition_matrix)

    def simulate(self, n_steps: int, start: int | None = None, seed: int = 0) -> np.ndarray:
        return self.analytic_msm.simulate(n_steps, start, seed=seed)

    def coarse(self, dtraj: np.ndarray, kind: str) -> np.ndarray:
        """n2good: split at the barrier; n2bad: off it; n6good: six bins, finer near the barrier."""
        n = self.n
        edges = {"n2good": [n // 2], "n2bad": [2 * n // 5], "n6good": [2 * n // 5, 9 * n // 20, n // 2, 11 * n // 20, 3 * n // 5]}[kind]
        return np.searchsorted(edges, dtraj, side="right")
