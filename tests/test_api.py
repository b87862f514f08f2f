import numpy as np
import pytest

from lagstream import api
from lagstream.sources import trajectories as tr


def test_datasets(spark):
    rng = np.random.default_rng(0)
    data = [rng.standard_normal((9, 2)), rng.standard_normal((2, 2)), rng.standard_normal((5, 2))]
    d = api.TrajectoriesDataset.from_numpy(spark, 3, data)
    assert len(d) == 8 and [r["traj_id"] for r in d.too_short().collect()] == [1]
    both = api.TimeLaggedConcatDataset([d, api.to_dataset(spark, (data[0], data[0]))])
    assert len(both) == 17 and both.stride(4).count() == 5
    assert len(api.TrajectoryDataset(1, tr.from_numpy(spark, data[0]))) == 8
    with pytest.raises(tr.TrajectoryTooShortError):
        api.to_dataset(spark, data, 20)
    run = api.RunningCovar(remove_mean=True, symmetrize=True)
    run.add(d.pairs)
    x = np.concatenate([data[0][:-3], data[2][:-3]])
    y = np.concatenate([data[0][3:], data[2][3:]])
    z = np.concatenate([x, y])
    assert np.allclose(run.cov_xx(), np.cov(z.T))
    w, sx, sy, xx, xy = api.moments_xxxy(d.pairs)
    assert w == 8 and np.allclose(xy, x.T @ y) and np.allclose(sx, x.sum(0)) and np.allclose(api.moments_block(d.pairs)[2][1][1], y.T @ y)
    white = api.WhiteningTransform(np.eye(2) * 2, np.ones(2), 1)
    assert np.allclose(white(x), (x[:, :1] - 1) * 2)


def test_other_names(spark):
    rng = np.random.default_rng(1)
    d = tr.from_numpy(spark, [rng.integers(0, 3, 50) for _ in range(4)])
    mean, dev = api.bootstrapping_dtrajs(d, 1, 3, 10)
    assert len(mean) == 3 and (dev > 0).all()
    chain = api.double_well_discrete()
    x = chain.simulate(200, 10)
    assert set(chain.coarse(x, "n6good")) <= set(range(6)) and np.allclose(chain.analytic_msm.stationary_distribution.sum(), 1)
    assert api.birth_death_chain([0, 0.5], [0.5, 0]).dim == 2 and api.drunkards_walk().n == 10
    assert np.isfinite(api.position_based_fluids(2, n=20).x).all()
    m = api.hmm.random_guess(3, 2, 1)
    assert set(api.sample_hidden_state_trajectory(m, [0, 1, 2, 0])) <= {0, 1}
