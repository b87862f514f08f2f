import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagstream.functions import analysis, basis, estimation, simulate
from lagstream.operators import clustering, counts, decomposition, hmm, lag, moments, msm, tram, validation
from lagstream.plans import series
from lagstream.sources import trajectories as tr


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    data = [np.cumsum(rng.standard_normal((n, 3)), 0) * 0.1 + rng.standard_normal((n, 3)) for n in (200, 100, 1)]
    return tr.from_numpy(spark, data).repartition(5), data


def _pairs(data, k):
    return np.concatenate([x[:-k] for x in data if len(x) > k]), np.concatenate([x[k:] for x in data if len(x) > k])


@pytest.mark.parametrize("remove", [False, True])
@pytest.mark.parametrize("reversible", [False, True])
def test_covariances(frames, remove, reversible):
    df, data = frames
    x, y = _pairs(data, 2)
    if reversible:
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
    if remove:
        x, y = x - x.mean(0), y - y.mean(0)
    c = moments.Covariance(2, True, True, True, remove_data_mean=remove, reversible=reversible, bessels_correction=False).fit(df)
    assert np.allclose(c.cov_00, x.T @ x / len(x)) and np.allclose(c.cov_0t, x.T @ y / len(x)) and np.allclose(c.cov_tt, y.T @ y / len(x))


def test_weights_and_merging(frames):
    df, data = frames
    x = np.concatenate(data)
    w = np.exp(-np.abs(x[:, 0]))
    c = moments.covar(df.withColumn("w", F.exp(-F.abs(F.col("x")[0]))), True, "w")
    m = (w @ x) / w.sum()
    assert np.allclose(c, ((x - m) * w[:, None]).T @ (x - m) / (w.sum() - 1))
    a, b = moments.Moments.of(x[:70]), moments.Moments.of(x[70:])
    assert np.allclose(a.combine(b).mxx, moments.Moments.of(x).mxx)
    assert np.allclose(moments.Moments.unpack(np.array(a.pack())).mxy, a.mxy)


def test_whitening_and_partial_fit(frames):
    df, data = frames
    est = moments.Covariance(0, remove_data_mean=True, bessels_correction=False)
    est.partial_fit(df.where("traj_id = 0")).partial_fit(df.where("traj_id > 0"))
    c = est.fetch_model()
    white = np.array([r["x"] for r in c.whiten_frames(df).collect()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(3), atol=1e-8)


def test_vamp_tica_scores(frames):
    df, data = frames
    x, y = _pairs(data, 1)
    model = decomposition.VAMP(1).fit(df)
    a, b = x - x.mean(0), y - y.mean(0)
    inv = lambda m: (lambda s, v: (v / np.sqrt(s)) @ v.T)(*np.linalg.eigh(m))
    k = inv(a.T @ a) @ a.T @ b @ inv(b.T @ b)
    assert np.allclose(model.singular_values, np.linalg.svd(k, compute_uv=False))
    assert np.isclose(model.score(2), 1 + (model.singular_values**2).sum()) and np.isclose(model.score("E"), model.score(2))
    f, g = model.instantaneous(x), model.timelagged(y)
    assert np.allclose(f.T @ f / len(f), np.eye(3), atol=1e-8) and np.allclose(f.T @ g / len(f), np.diag(model.singular_values), atol=1e-8)
    t = decomposition.TICA(1, dim=1).fit(df)
    assert t.transform(df).select(F.size("x").alias("n")).distinct().collect()[0]["n"] == 1
    assert decomposition.CovarianceKoopmanModel.effective_output_dimension(5, 5, None, 0.9, np.array([3, 1, 0.5, 0.1, 0.0])) == 2
    assert len(decomposition.vamp_score_cv(decomposition.VAMP(1).fit, df, 1, blocksize=20, n=2)) == 2


def test_dmd_edmd_kernels(spark):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x = rng.standard_normal((50, 6))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ q.T)], "x array<double>, y array<double>")
    m = decomposition.DMD().fit(pairs)
    assert np.allclose(np.sort_complex(m.eigenvalues), np.sort_complex(np.linalg.eigvals(q))) and np.allclose(m.transform(x), x @ q.T)
    e = decomposition.EDMD(basis.Identity()).fit(pairs)
    assert np.allclose(np.sort(np.abs(e.eigenvalues)), 1)
    k = decomposition.KernelEDMD(basis.PolynomialKernel(1, 0.0), 1e-8, 6).fit(pairs)
    assert np.allclose(np.abs(k.eigenvalues), 1, atol=1e-3)
    assert decomposition.KernelCCA(basis.GaussianKernel(3.0), 3).fit(pairs).eigenvalues[0] <= 1 + 1e-6
    assert decomposition.KVAD(basis.GaussianKernel(2.0), dim=3).fit(pairs).score > 0


def test_sindy(spark):
    x = simulate.lorenz_system(1e-3, 2).trajectory([8.0, 27.0, -7.0], 500)
    dx = np.stack([10 * (x[:, 1] - x[:, 0]), x[:, 0] * (28 - x[:, 2]) - x[:, 1], x[:, 0] * x[:, 1] - 8 / 3 * x[:, 2]], 1)
    df = spark.createDataFrame([(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, dx))], "traj_id long, t long, x array<double>, dx array<double>")
    m = decomposition.SINDy(input_features=["x", "y", "z"]).fit(df)
    want = {(0, "x"): -10, (0, "y"): 10, (1, "x"): 28, (1, "y"): -1, (1, "x z"): -1, (2, "z"): -8 / 3, (2, "x y"): 1}
    got = {(i, n): c for i, r in enumerate(m.coefficients) for n, c in zip(m.library.names(["x", "y", "z"]), r) if c}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.05 for k in want)
    assert m.score(x, dx) > 0.999 and np.abs(m.simulate(x[0], np.arange(5) * 0.002) - x[:5]).max() < 0.01


def test_kmeans_and_boxes(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (n, 1)) for m, n in ((-2, 200), (0, 300), (2, 400))])
    df = tr.from_numpy(spark, [x]).persist()
    m = clustering.KMeans(3, seed=1).fit(df)
    assert m.converged and np.allclose(np.sort(m.cluster_centers[:, 0]), [-2, 0, 2], atol=0.05)
    near = (x - m.cluster_centers[:, 0]).__abs__().argmin(1)
    got = [r["state"] for r in m.transform(df).orderBy("t").collect()]
    assert got == near.tolist() and np.isclose(m.score(df), ((x - m.cluster_centers[near]) ** 2).sum())
    far = clustering.lloyd_step(df, np.array([[-2.0], [2.0], [99.0]]))
    assert far[2, 0] == 99  # an empty cluster keeps its centre
    mini = clustering.MiniBatchKMeans(3, 300, 2, seed=1).fit(df)
    assert np.allclose(np.sort(mini.cluster_centers[:, 0]), [-2, 0, 2], atol=0.3)
    centers = clustering.RegularSpace(0.5, window=7).fit(df).cluster_centers
    want = []
    for v in x:
        if all(np.linalg.norm(v - c) > 0.5 for c in want):
            want.append(v)
    assert np.allclose(centers, want)
    box = clustering.BoxDiscretization(1, 5).fit(df)
    assert [r["state"] for r in box.transform(df).orderBy("t").collect()] == [int(np.abs(box.cluster_centers[:, 0] - v[0]).argmin()) for v in x]
    one = box.transform_onehot(df).select(F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s")).distinct().collect()
    assert [r["s"] for r in one] == [1.0]
    df.unpersist()


@pytest.fixture(scope="module")
def chain(spark):
    t = simulate.tmatrix_metropolis1d([0, 1, 0, 2])
    m = msm.MarkovStateModel(t)
    return t, tr.from_numpy(spark, [m.simulate(3000, seed=s) for s in range(4)])


def test_msm_estimation(chain):
    t, df = chain
    m = msm.MaximumLikelihoodMSM().fit(df, 1)
    assert np.abs(m.transition_matrix - t).max() < 0.05 and m.reversible
    assert np.isclose(m.mfpt([0], [3]), analysis.mfpt(m.transition_matrix, [3])[0])
    assert len(m.timescales()) == 3 and np.isclose(m.propagate([1, 0, 0, 0], 2).sum(), 1)
    post = msm.BayesianMSM(10, seed=2).fit(df, lagtime=1, count_mode="sliding")
    stats = post.gather_stats("timescales", k=1)
    assert stats.L[0] <= stats.mean[0] <= stats.R[0]
    models = [msm.MaximumLikelihoodMSM().fit(df, k).models[0] for k in (1, 2, 3)]
    test = models[0].ck_test(models, 2)
    assert test.predictions.shape == (4, 2, 2) and np.abs(test.predictions - test.estimates).max() < 0.1
    its = validation.implied_timescales(models, 2)
    assert its.lagtimes.tolist() == [1, 2, 3] and its.its.shape == (3, 2)
    assert np.isclose(m.score(r=2), m.score(df, r=2)) and m.score(r=1) > 1
    w = m.compute_trajectory_weights(df).agg(F.sum("w")).first()[0]
    assert np.isclose(w, 1)
    assert np.isclose(m.correlation(np.arange(4), maxtime=3)[1][0], m.stationary_distribution @ np.arange(4) ** 2)


def test_disconnected_models(spark):
    c = np.kron(np.eye(2), [[5.0, 1], [1, 5]])
    m = msm.MaximumLikelihoodMSM().fit_from_counts(counts.TransitionCountModel(c, state_histogram=[6, 6, 6, 6]))
    assert m.n_connected_msms == 2 and m.state_fractions == [0.5, 0.5] and m.select(1).count_model.state_symbols.tolist() == [2, 3]


def _brute(a, b, p0, obs):
    n, best, total = len(a), (-1, None), 0
    for path in itertools.product(range(n), repeat=len(obs)):
        p = p0[path[0]] * b[path[0], obs[0]]
        for i in range(1, len(obs)):
            p *= a[path[i - 1], path[i]] * b[path[i], obs[i]]
        total += p
        if p > best[0] + 1e-15:
            best = (p, path)
    return total, best[1]


def test_hidden_markov_recursions(spark):
    rng = np.random.default_rng(3)
    a, b, p0 = rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2), np.array([0.3, 0.7])
    obs = [rng.integers(0, 3, n) for n in (6, 1, 4)]
    df = tr.from_numpy(spark, obs)
    m = hmm.HiddenMarkovModel(msm.MarkovStateModel(a), hmm.DiscreteOutputModel(b), p0)
    assert np.isclose(m.compute_observation_likelihood(df), sum(np.log(_brute(a, b, p0, o)[0]) for o in obs))
    paths = m.viterbi_paths(df).orderBy("traj_id", "t").toPandas()
    assert [g["state"].tolist() for _, g in paths.groupby("traj_id")] == [list(_brute(a, b, p0, o)[1]) for o in obs]
    _, alpha = hmm.forward(a, b[:, obs[0]].T, p0)
    gamma = hmm.state_probabilities(alpha, hmm.backward(a, b[:, obs[0]].T))
    joint = np.zeros((6, 2))
    for path in itertools.product(range(2), repeat=6):
        p = p0[path[0]] * b[path[0], obs[0][0]] * np.prod([a[path[i - 1], path[i]] * b[path[i], obs[0][i]] for i in range(1, 6)])
        joint[np.arange(6), path] += p
    assert np.allclose(gamma, joint / joint.sum(1, keepdims=True))


def test_hidden_markov_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3)
    m = hmm.HiddenMarkovModel(msm.MarkovStateModel(a), hmm.DiscreteOutputModel(b), np.array([0.2, 0.5, 0.3]))
    # frames 40 to 59 of the second are missing, so some blocks are empty and others cut
    df = tr.from_numpy(spark, [rng.integers(0, 4, n) for n in (101, 90, 3, 1)]).where("traj_id <> 1 or t < 40 or t >= 60").persist()
    em, results = hmm.MaximumLikelihoodHMM(m, 1), []
    for block in (1000, 7, 1):
        monkeypatch.setattr(hmm, "BLOCK", block)
        assert hmm.spans_blocks(df) == (block < 101)
        table = m.state_probability_table(df).orderBy("traj_id", "t").toPandas()
        paths = m.viterbi_paths(df).orderBy("traj_id", "t").toPandas()
        results.append((table[["traj_id", "t"]].to_numpy(), paths.to_numpy(), np.stack(table["gamma"]), m.compute_observation_likelihood(df), *em.expectation(m, df)))
    for other in results[1:]:
        assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(results[0], other))
    assert np.isclose(results[0][5].sum(), 4) and np.isclose(results[0][6].sum(), 101 + 70 + 3 + 1 - 4)
    df.unpersist()


def test_hidden_markov_fit(spark):
    a, b = np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[0.9, 0.1, 0], [0, 0.2, 0.8]])
    true = hmm.HiddenMarkovModel(msm.MarkovStateModel(a), hmm.DiscreteOutputModel(b))
    df = tr.from_numpy(spark, [true.simulate(1500, seed=s)[1] for s in range(3)])
    start = hmm.metastable_from_data(df, 2, 1)
    m = hmm.MaximumLikelihoodHMM(start, 1, maxit=30, accuracy=0.1).fit(df)
    order = np.argsort(-m.output_probabilities[:, 0])
    assert np.abs(m.transition_matrix[np.ix_(order, order)] - a).max() < 0.05 and np.abs(m.output_probabilities[order] - b).max() < 0.06
    assert all(y >= x - 1e-6 for x, y in zip(m.likelihoods, m.likelihoods[1:]))
    post = hmm.BayesianHMM(m, 3, 10, seed=1).fit(df)
    assert len(post.samples) == 3 and np.abs(post.samples[-1].transition_matrix[np.ix_(order, order)] - a).max() < 0.1
    assert np.allclose(m.metastable_memberships.sum(1), 1) and np.allclose(m.transition_matrix_obs().sum(1), 1)


def test_gaussian_hidden_model(spark):
    rng = np.random.default_rng(0)
    hidden = msm.MarkovStateModel(np.array([[0.9, 0.1], [0.1, 0.9]])).simulate(2000, seed=1)
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(rng.normal(np.array([-2, 2])[hidden], 0.5))], "traj_id long, t long, value double")
    m = hmm.MaximumLikelihoodHMM(hmm.gaussian_from_data(df, 2), 1, maxit=5).fit(df)
    assert np.allclose(np.sort(m.output_model.means), [-2, 2], atol=0.1) and np.allclose(m.output_model.sigmas, 0.5, atol=0.1)


def test_multi_ensemble(spark):
    edges = np.linspace(-2, 3, 6)
    df = tram.harmonic_samples(spark, [-0.5, 0.5, 1.5], 4.0, 300, edges).persist()
    data = tram.TRAMDataset(df)
    f = tram.mbar(df, data.state_counts, 100, 1e-6)
    assert np.abs(f).max() < 0.15  # equal biases on a flat line have equal free energies
    assert data.transition_counts.sum() == 3 * 299
    m = tram.TRAM(maxiter=20, maxerr=1e-4, init_maxiter=20).fit(data)
    assert np.ptp(m.therm_state_energies) < 0.3 and np.allclose(m.transition_matrices[0].sum(1)[data.state_counts[0] > 0], 1)
    assert np.isclose(np.exp([r["log_w"] for r in m.sample_weights_log(df).collect()]).sum(), 1)
    assert np.isfinite(m.compute_log_likelihood(data)) and np.isfinite(m.compute_observable(df, "value"))
    tracked = tram.TRAM(maxiter=6, maxerr=0, init_strategy=None, track_log_likelihoods=True, callback_interval=2)
    calls = []
    last = tracked.fit(data, callback=lambda n, change: calls.append((n, change)))
    assert len(tracked.log_likelihoods) == len(tracked.energy_increments) == len(calls) == 3 and min(tracked.energy_increments) > 0
    assert np.isclose(tracked.log_likelihoods[-1], last.compute_log_likelihood(data)) and tracked.log_likelihoods[-1] > tracked.log_likelihoods[0]
    plain = tram.TRAM(maxiter=4, maxerr=0, init_strategy=None, callback_interval=2)
    plain.fit(data)
    assert plain.log_likelihoods == [-np.inf] * 2
    assert data.restrict_to_largest_connected_set("post_hoc_RE").n_markov >= 4
    assert len(tram.overlaps(df, "BAR_variance")) > 0
    df.unpersist()


def test_statistics(spark):
    x = np.random.default_rng(0).standard_normal(2001)
    lo, hi = validation.confidence_interval(x, 0.95)
    assert abs(lo + 1.96) < 0.15 and abs(hi - 1.96) < 0.15 and validation.confidence_interval(x, 1) == (x.min(), x.max())
    assert np.isnan(validation.confidence_interval([1, np.nan])[0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, x)], "x double, y double")
    e = validation.energy2d(df, 5)
    h, _, _ = np.histogram2d(x, x, 5)
    assert np.isinf(e.energies[0, 4]) and e.energies.min() == 0 and np.allclose(np.isfinite(e.energies), h > 0)


def test_koopman_weights_of_equilibrium_data(frames):
    df, _ = frames
    m = moments.KoopmanWeightingEstimator(1).fit(df)
    w = m.weights(lag.lag_pairs(df, 1)).agg(F.avg("w")).first()[0]
    assert np.isclose(w, 1, atol=1e-6)


def test_partial_reversible():
    c = np.array([[10.0, 3, 1], [2, 8, 0], [0, 0, 5]])
    p = estimation.estimate_p(c)
    assert np.allclose(p.sum(1), 1)
    q = estimation.transition_matrix_partial_rev(c, p, [np.array([0, 1])])
    assert np.allclose(q.sum(1), 1) and q[0, 2] > 0


@pytest.mark.parametrize("size, task, jobs", [(20, 100, 60), (300, 60, 60)])
def test_mini_batches_are_dealt_out_once(spark, monkeypatch, size, task, jobs):
    """Steps as in NumPy, whether a task takes several batches or a part of one; no jobs over the whole table for each batch."""
    monkeypatch.setattr(clustering, "TASK_FRAMES", task, raising=False)
    x = np.random.default_rng(4).normal(size=(1500, 3))
    df = tr.from_numpy(spark, [x[:900], x[900:]])
    start, n, tolerance = x[:4], -(-len(x) // size), 2e-3
    centers, costs, converged = start, [], False
    for epoch in range(3):
        rows = df.select(F.pmod(F.xxhash64(F.lit(5 + epoch), "traj_id", "t"), F.lit(n)).alias("b"), "x").toPandas()
        for _, g in rows.groupby("b"):
            v = np.stack(g["x"].to_numpy())
            a = ((v[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            centers = np.array([v[a == k].mean(0) if (a == k).any() else c for k, c in enumerate(centers)])
            before, now = costs[-1] if costs else np.inf, ((v[:, None] - centers[None]) ** 2).sum(2).min(1).sum()
            costs.append(now)
            converged = abs(now - before) / now <= tolerance
            if converged:
                break
    spark.sparkContext.setJobGroup(f"mini {size} {task}", "")
    m = clustering.MiniBatchKMeans(4, size, 3, tolerance=tolerance, seed=5).fit(df, start)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(m.inertias, costs) and np.allclose(m.cluster_centers, centers) and m.converged == converged
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"mini {size} {task}")) <= jobs


def test_moments_sql_makes_no_row_for_a_cell(spark):
    """Where the number of features is known; the same cells either way, of empty tables, nulls and fewer features too."""
    df = tr.from_numpy(spark, [np.random.default_rng(2).normal(size=(30, 3))])
    holes = df.withColumn("x", F.when(F.col("t") % 4 == 0, F.array(F.col("x")[0], F.lit(None).cast("double"), F.lit(None).cast("double"))).when(F.col("t") % 7 != 0, F.col("x")))
    pairs = lag.lag_pairs(df, 2)
    for table, blocks in ((pairs, None), (lag.lag_pairs(holes, 1), ("c0t", "meant", "c00")), (pairs.where("t < 0"), None), (df, ("mean0",))):
        want = {(r["block"], r["p"], r["q"]): r["v"] for r in moments.moments_sql(table, blocks).collect()}
        got = {(r["block"], r["p"], r["q"]): r["v"] for r in moments.moments_sql(table, blocks, 4).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert "Generate" in moments.moments_sql(pairs)._jdf.queryExecution().toString()
    plan = series.QUERIES["lagged_moments_sql"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1  # of the one row of averages
