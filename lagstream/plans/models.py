"""Queries that fit models: results of iterations and spectra, which SQL does not express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstream.functions import basis
from lagstream.operators import clustering, counts, decomposition, lag, moments, msm, states
from lagstream.sources import trajectories as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _vector(spark, values, name: str = "v") -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.real(values))], f"k long, {name} double")


def _msm(spark, sf):
    return msm.MaximumLikelihoodMSM().fit(tr.events_dtraj(spark, sf), 1)


@query
def msm_timescales(spark, sf):
    return _vector(spark, _msm(spark, sf).timescales())


@query
def msm_pcca(spark, sf):
    chi = _msm(spark, sf).pcca(2).memberships
    return spark.createDataFrame([(i, k, float(v)) for i, r in enumerate(chi) for k, v in enumerate(r)], "state long, k long, chi double")


@query
def bayesian_msm_timescales(spark, sf):
    p = msm.BayesianMSM(20, seed=1).fit(tr.events_dtraj(spark, sf), lagtime=1, count_mode="sliding")
    s = p.gather_stats("timescales", k=2)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(s.mean, s.L, s.R))], "k long, mean double, lower double, upper double")


@query
def msm_by_group(spark, sf):
    d = tr.events_dtraj(spark, sf)
    c = counts.transition_pairs(d, 1).withColumn("part", F.pmod("traj_id", F.lit(4)).cast("int")).groupBy("part", "i", "j").agg(F.count("*").cast("double").alias("v"))
    return msm.fit_by_group(c, "part", 5)


@query
def tica_projection(spark, sf):
    return decomposition.TICA(1, dim=2).fit(tr.lineitem_x(spark, sf)).transform(tr.lineitem_x(spark, sf))


@query
def vamp_singular_values(spark, sf):
    return _vector(spark, decomposition.VAMP(1).fit(tr.embeddings_x(spark, sf)).singular_values)


@query
def vamp_cross_validation(spark, sf):
    scores = decomposition.vamp_score_cv(decomposition.VAMP(1, dim=2).fit, tr.lineitem_x(spark, sf), 1, n=2)
    return _vector(spark, scores)


@query
def dmd_eigenvalues(spark, sf):
    m = decomposition.DMD().fit(lag.lag_pairs(tr.lineitem_x(spark, sf), 1))
    return spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(m.eigenvalues)], "k long, re double, im double")


@query
def edmd_eigenvalues(spark, sf):
    pairs = lag.lag_pairs(tr.lineitem_x(spark, sf).withColumn("x", F.array(F.col("x")[0] / 50, F.col("x")[2] * 10)), 1)
    return _vector(spark, np.abs(decomposition.EDMD(basis.Monomials(2, 2)).fit(pairs).eigenvalues))


@query
def koopman_weights(spark, sf):
    m = moments.KoopmanWeightingEstimator(1).fit(tr.lineitem_x(spark, sf))
    return m.weights(tr.lineitem_x(spark, sf)).select("traj_id", "t", "w")


@query
def mini_batch_kmeans(spark, sf):
    m = clustering.MiniBatchKMeans(3, batch_size=100, max_iter=2, seed=3).fit(tr.embeddings_x(spark, sf))
    return m.transform(tr.embeddings_x(spark, sf)).select("traj_id", "t", "state")


@query
def regular_space(spark, sf):
    df = tr.lineitem_x(spark, sf).withColumn("x", F.slice("x", 1, 1))
    return _vector(spark, np.sort(clustering.RegularSpace(9.0).fit(df).cluster_centers[:, 0]))


@query
def frames_by_state(spark, sf):
    return states.sample_by_state(tr.events_dtraj(spark, sf), 10, seed=5)


@query
def bootstrap_counts(spark, sf):
    return counts.bootstrap_dtraj_counts(tr.events_dtraj(spark, sf), 1, 5, seed=5)


@query
def sindy_coefficients(spark, sf):
    from lagstream.functions.simulate import lorenz_system

    df = lorenz_system(1e-3, 5).table(spark, np.array([[8.0, 27.0, -7.0]]), 400).withColumn("s", F.col("t") * 0.005)
    m = decomposition.SINDy(input_features=["x", "y", "z"]).fit(decomposition.derivatives(df, "s").where("t > 0 and t < 399"))
    return spark.createDataFrame([(i, k, float(v)) for i, r in enumerate(m.coefficients) for k, v in enumerate(r) if v], "target long, term long, c double")
