import numpy as np
import pytest

from lagstream.functions import analysis, basis, estimation, flux, graph, linalg, simulate
from lagstream.operators import msm


@pytest.fixture(scope="module")
def chain():
    q, p = np.full(10, 0.5), np.full(10, 0.5)
    q[0], p[-1] = 0, 0
    p[4], q[6] = 0.01, 0.1
    return simulate.BirthDeathChain(q, p)


def test_closed_forms(chain):
    t = chain.transition_matrix
    assert np.allclose(analysis.stationary_distribution(t), chain.stationary_distribution)
    for mode in ("backward", "eigenvector"):
        assert np.allclose(analysis.stationary_distribution(t, mode), chain.stationary_distribution)
    assert np.allclose(analysis.committor(t, [0], [9]), chain.committor_forward(0, 9))
    assert np.allclose(analysis.committor(t, [0], [9], False), chain.committor_backward(0, 9))
    assert np.allclose(analysis.backward_committor(t, [0], [9]), chain.committor_backward(0, 9))
    f = flux.reactive_flux(t, [0], [9])
    assert np.allclose(f.gross_flux, chain.flux(0, 9)) and np.allclose(f.net_flux, chain.net_flux(0, 9))
    assert np.isclose(f.total_flux, chain.total_flux(0, 9)) and np.isclose(f.rate, chain.rate(0, 9))
    paths, widths = f.pathways()
    assert paths == [list(range(10))] and np.isclose(widths[0], f.total_flux)
    sets, coarse = f.coarse_grain([[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]])
    assert np.isclose(coarse.total_flux, f.total_flux) and sum(map(len, sets)) == 10


def test_decompositions(chain):
    t = chain.transition_matrix
    for norm in ("standard", "reversible"):
        r, d, left = analysis.rdl_decomposition(t, norm=norm)
        assert np.allclose(r @ d @ left, t) and np.allclose(left @ r, np.eye(10), atol=1e-8)
    assert np.allclose(analysis.eigenvalues(t), analysis.eigenvalues(t, reversible=True))
    assert np.isinf(analysis.timescales(t)[0])


def test_passage_times_by_first_step(chain):
    t = chain.transition_matrix
    m = analysis.mfpt(t, [9])
    assert np.allclose(m[:9], 1 + (t @ m)[:9]) and m[9] == 0
    walk = np.array([[1, 0, 0], [0.5, 0, 0.5], [0, 0, 1.0]])
    assert np.allclose(analysis.hitting_probability(walk, [2]), [0, 0.5, 1])


def test_expected_counts_and_correlations(chain):
    t, pi = chain.transition_matrix, chain.stationary_distribution
    for n in (3, 40):
        want, p = np.zeros((10, 10)), np.eye(10)[2]
        for _ in range(n):
            want += p[:, None] * t
            p = p @ t
        assert np.allclose(analysis.expected_counts(np.eye(10)[2], t, n), want)
    a = np.arange(10.0)
    got = analysis.correlation(t, a, times=[5, 0, 2])
    want = [a * pi @ np.linalg.matrix_power(t, k) @ a for k in (5, 0, 2)]
    assert np.allclose(got, want) and np.allclose(analysis.correlation(t, a, times=[50]), a * pi @ np.linalg.matrix_power(t, 50) @ a)
    times, amplitudes = analysis.fingerprint_correlation(t, a)
    assert np.isclose(amplitudes.sum(), a * pi @ a)


def test_sensitivities_by_differences(chain):
    t = chain.transition_matrix + 0.01
    t /= t.sum(1, keepdims=True)
    h = 1e-6
    step = np.zeros((10, 10))
    step[3, 4], step[3, 2] = h, -h
    cases = [(analysis.eigenvalue_sensitivity(t, 1), lambda x: analysis.eigenvalues(x)[1]), (analysis.mfpt_sensitivity(t, [9], 2), lambda x: analysis.mfpt(x, [9])[2]),
             (analysis.committor_sensitivity(t, [0], [9], 5), lambda x: analysis.forward_committor(x, [0], [9])[5]),
             (analysis.stationary_distribution_sensitivity(t, 4), lambda x: analysis.stationary_distribution(x)[4]),
             (analysis.timescale_sensitivity(t, 1), lambda x: analysis.timescales(x)[1])]
    for s, f in cases:
        assert np.isclose((s * step).sum() / h, (f(t + step) - f(t - step)) / (2 * h), rtol=1e-3)


def test_metastable_sets():
    t = simulate.tmatrix_metropolis1d([1, 0, 1, 6, 1, 0, 1])
    m = analysis.pcca(t, 2)
    assert np.allclose(m.memberships.sum(1), 1) and (m.memberships >= 0).all()
    assert len(set(m.assignments[:3])) == 1 and len(set(m.assignments[4:])) == 1 and m.assignments[0] != m.assignments[-1]
    assert np.allclose(m.transition_matrix_coarse.sum(1), 1) and np.isclose(m.pi_coarse.sum(), 1)
    blocks = np.kron(np.eye(2), [[0.9, 0.1], [0.1, 0.9]])
    assert [sorted(s) for s in analysis.pcca_sets(blocks, 2)] == [[0, 1], [2, 3]]


def test_reversible_estimates():
    c = np.array([[5, 2, 0], [1, 1, 1], [2, 5, 20.0]])
    t, pi = estimation.mle_trev(c, return_statdist=True)
    assert np.allclose(t.sum(1), 1) and np.allclose(pi[:, None] * t, (pi[:, None] * t).T)
    best = estimation.log_likelihood(c, t)
    rng = np.random.default_rng(0)
    for _ in range(50):  # no reversible neighbour is better
        x = pi[:, None] * t * np.exp(0.05 * (lambda a: a + a.T)(rng.standard_normal((3, 3))))
        assert estimation.log_likelihood(c, x / x.sum(1, keepdims=True)) <= best + 1e-9
    mu = np.array([0.2, 0.3, 0.5])
    t = estimation.mle_trev_given_pi(c, mu)
    assert np.allclose(mu @ t, mu) and analysis.is_reversible(t, mu, 1e-6)
    with pytest.raises(ValueError):
        estimation.transition_matrix_non_reversible(np.zeros((2, 2)))
    assert np.allclose(estimation.transition_matrix_reversible_pisym(c).sum(1), 1)


def test_samplers():
    c = np.array([[90, 10, 1], [9, 80, 11], [1, 12, 70.0]])
    mle = estimation.mle_trev(c)
    for kw in ({"reversible": False}, {"reversible": True}):
        s = np.array(estimation.sample_tmatrix(c, 200, 5, seed=1, **kw))
        assert np.allclose(s.sum(2), 1) and np.abs(s.mean(0) - mle).max() < 0.05
    mu = np.array([0.3, 0.4, 0.3])
    for t in estimation.sample_tmatrix(c, 5, 20, True, mu):
        assert np.allclose(mu @ t, mu)


def test_rate_matrices():
    k = np.array([[-0.3, 0.3, 0], [0.1, -0.3, 0.2], [0, 0.4, -0.4]])
    t = linalg.matrix_exp(k)
    pi = analysis.stationary_distribution(t)
    c = 1e5 * pi[:, None] * t
    for method, tol in (("truncated_log", 0.02), ("CVE", 0.02), ("KL", 0.02)):
        got = estimation.rate_matrix(c, method=method)
        assert analysis.is_rate_matrix(got, 1e-8) and np.abs(got - k).max() < tol
    assert analysis.is_rate_matrix(estimation.rate_matrix(c, method="pseudo"))


def test_linear_algebra():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 5))
    w = a.T @ a
    assert np.allclose(linalg.spd_inv(w) @ w, np.eye(5)) and np.allclose(linalg.spd_inv_sqrt(w) @ linalg.spd_inv_sqrt(w), np.linalg.inv(w))
    split = linalg.spd_inv_split(w)
    assert np.allclose(split @ split.T, np.linalg.inv(w))
    with pytest.raises(linalg.ZeroRankError):
        linalg.spd_eig(np.zeros((3, 3)))
    assert np.isclose(linalg.schatten_norm(a, 2), np.linalg.norm(a)) and np.isclose(linalg.logsumexp(np.array([0.0, 0.0])), np.log(2))
    assert linalg.logsumexp(np.array([-np.inf, -np.inf])) == -np.inf
    assert linalg.ksum([0.1] * 10) == 1.0
    assert np.allclose(linalg.matrix_power(np.diag([4.0, 9.0]), 0.5), np.diag([2, 3]))
    v, x = linalg.eig_corr(w, np.diag(np.arange(5.0) + 1))
    assert np.allclose(np.diag(np.arange(5.0) + 1) @ x, w @ x * v)


def test_basis_and_derivatives():
    m = basis.Monomials(2, 2)
    assert m.names() == ["", "x0", "x1", "x0^2", "x0 x1", "x1^2"]
    assert m(np.array([[2.0, 3.0]])).tolist() == [[1, 2, 3, 4, 6, 9]]
    assert np.allclose(basis.finite_difference_coefficients(0, [-1, 0, 1], 1), [-0.5, 0, 0.5])
    x = np.linspace(0, 1, 30)
    d = basis.finite_difference_operator_midpoints(x, 1, 3)
    assert np.allclose(d @ x**3, 3 * ((x[1:] + x[:-1]) / 2) ** 2)
    u = basis.tv_derivative(x, np.abs(x - 0.5), alpha=1e-4)
    assert np.abs(u[3:12] + 1).max() < 0.1 and np.abs(u[18:27] - 1).max() < 0.1
    k = basis.GaussianKernel(1.5) * basis.LaplacianKernel(2.0)
    a, b = np.array([1.0, 2.0]), np.array([0.0, 1.0])
    assert np.isclose(k(a, b), np.exp(-2 / 4.5) * np.exp(-np.sqrt(2) / 2))
    assert np.isclose(basis.PolynomialKernel(2)(a, b), 9) and np.isclose(basis.GeneralizedGaussianKernel([1, 2])(a, b), np.exp(-(1 + 0.25) / 2))


def test_graph():
    c = np.array([[1, 1, 0], [0, 1, 1], [0, 0, 1]])
    assert [s.tolist() for s in graph.closed_sets(c)] == [[2]] and graph.has_connection(c, [0], [2]) and not graph.has_connection(c, [2], [0])


def test_simulators():
    x = simulate.lorenz_system(1e-3, 10).trajectory([8.0, 27.0, -7.0], 5)
    assert x.shape == (5, 3) and np.isfinite(x).all()
    ou = simulate.ornstein_uhlenbeck(1e-2, 100).trajectory(np.zeros((400, 1)), 4, seed=1)[:, -1]
    assert abs(ou.var() - 0.125) < 0.03
    assert (simulate.double_well_2d(n_steps=10)(np.zeros((3, 2)), seed=1) == simulate.double_well_2d(n_steps=10)(np.zeros((3, 2)), seed=1)).all()
    assert simulate.swissroll_model(50)[1].shape == (50, 3)
    jet = simulate.bickley_jet().trajectory([[1.0, 0.5]], 3)
    assert jet.shape == (1, 3, 2) and (jet[..., 0] < 20).all()
    fluid = simulate.PositionBasedFluids([4, 4], np.random.default_rng(0).uniform(-1, 1, (20, 2)), 1.0).run(3)
    assert np.isfinite(fluid).all() and np.abs(fluid).max() <= 2


def test_oom_and_augmented():
    t = simulate.tmatrix_metropolis1d([0, 1, 0.5])
    m = msm.MarkovStateModel(t)
    c = 1000 * m.stationary_distribution[:, None] * t
    features = np.array([[0.0], [1.0], [2.0]])
    target = float(m.stationary_distribution @ features[:, 0]) + 0.1
    a = msm.AugmentedMSMEstimator(features, [target], [1e4]).fit(c)
    assert abs(a.estimates[0] - target) < 0.01 and np.allclose(a.stationary_distribution @ a.transition_matrix, a.stationary_distribution, atol=1e-6)
    c2 = np.einsum("i,ij,jk->ijk", m.stationary_distribution, t, t)
    xi, omega, sigma, values = msm.oom_components(m.stationary_distribution[:, None] * t, c2)
    assert np.allclose(np.sort(values), np.sort(analysis.eigenvalues(t))[-len(values):], atol=1e-6)
    got, states = msm.equilibrium_transition_matrix(xi, omega, sigma)
    assert np.allclose(got, t, atol=1e-6)


def test_drunkards_walk():
    w = simulate.DrunkardsWalk((7, 8), (0, 0), (6, 7))
    assert w.transition_matrix.shape == (56, 56) and np.allclose(w.transition_matrix.sum(1), 1)
    assert w.bar_state == [0] and w.home_state == [6 + 7 * 7] and w.n_states == 56 and w.grid_size == (7, 8)
    assert all(w.state_to_coordinate(w.coordinate_to_state((i, j))) == (i, j) for i in range(7) for j in range(8))
    assert tuple(w.walk((3, 3), 100_000)[-1]) in ((0, 0), (6, 7)) and len(w.walk((3, 3), 500, stop=False)) == 500
    assert np.isclose(w.transition_matrix[w.coordinate_to_state((3, 3))].max(), 1 / 8) and np.isclose(w.transition_matrix[0, 0], 100 / 103)
    g = simulate.DrunkardsWalk((10, 10), (0, 0), (9, 9))
    g.add_barrier((0, 9), (5, 8))
    g.add_barrier((5, 0), (5, 4))
    g.add_barrier((2, 2), (3, 2), 5.0)
    assert all((5, y) in g.barriers for y in range(5)) and np.allclose(g.transition_matrix.sum(1), 1) and (g.transition_matrix >= 0).all()
    step = g.transition_matrix[g.coordinate_to_state((2, 3))]
    assert np.isclose(step[g.coordinate_to_state((2, 2))] * 5, step[g.coordinate_to_state((1, 3))])  # five times slower
    assert step[g.coordinate_to_state((5, 1))] == 0 and g.transition_matrix[g.coordinate_to_state((6, 1)), g.coordinate_to_state((5, 1))] == 0
    assert simulate.DrunkardsWalk.line((0, 0), (2, 2)) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]


def test_has_path_needs_both_ends():
    assert flux.has_path([0, 1, 4], [0, 2], [4]) and not flux.has_path([0, 1], [0], [4]) and not flux.has_path([], [0], [4])
