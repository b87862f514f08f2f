import numpy as np
import pytest

from lagstream import base
from lagstream.functions import simulate
from lagstream.operators import deep, msm, validation
from lagstream.plans import plots
from lagstream.sources import models


def test_models_come_back(spark, tmp_path):
    m = msm.MaximumLikelihoodMSM().fit_from_counts(np.array([[5.0, 1], [2, 7]])).models[0]
    models.save_model(spark, m, f"{tmp_path}/m")
    back = models.load_model(spark, f"{tmp_path}/m")
    assert np.allclose(back.transition_matrix, m.transition_matrix) and np.allclose(back.timescales(), m.timescales())
    spark.createDataFrame([(99, "{}")], "version int, model string").write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError):
        models.load_model(spark, f"{tmp_path}/old")


def test_plot_tables():
    m = msm.MarkovStateModel(simulate.tmatrix_metropolis1d([0, 1, 0, 1]))
    its = validation.implied_timescales([m], 2)
    assert len(plots.implied_timescales_table(its)) == 2
    assert {"prediction", "estimate"} <= set(plots.ck_test_table(m.ck_test([m], 2)))
    nodes, edges = plots.markov_model_tables(m)
    assert len(nodes) == 4 and np.isfinite(nodes[["x", "y"]]).all().all() and (edges.weight > 0).all()
    nodes, _ = plots.flux_tables(m.reactive_flux([0], [3]))
    assert np.isclose(nodes.x.iloc[0], 0) and np.isclose(nodes.x.iloc[3], 1)
    x = np.random.default_rng(0).random(50)
    assert (plots.density_table(x, x, 4, avoid_zero_counts=True).density > 0).all() and len(plots.contour_table(x, x, x, 5)) == 25


def test_interfaces():
    class Mean(base.EstimatorTransformer):
        def __init__(self, shift=0.0):
            super().__init__()
            self.shift = shift

        def fit(self, data):
            self._model = base.Model()
            self._model.transform = lambda x: x - self.shift
            return self

        @base.cached_property
        def slow(self):
            self.calls = getattr(self, "calls", 0) + 1
            return self.calls

    e = Mean()
    assert not e.has_model and e.set_params(shift=2).fit_transform(np.ones(2)).tolist() == [-1, -1] and e.get_params()["shift"] == 2
    assert (e.slow, e.slow) == (1, 1)
    del e.slow
    assert e.slow == 2
    with pytest.raises(ValueError):
        e.set_params(other=1)
    with base.ProgressCallback() as p:
        p(2, 0.1)
    assert p.steps == 2 and base.call_member(np.ones(3), "sum") == 3 and base.try_import("no_such_module") is None


@pytest.mark.skipif(deep.available(), reason="only where torch is absent")
def test_deep_models_need_torch():
    with pytest.raises(ImportError):
        deep.mlp([2, 2])
