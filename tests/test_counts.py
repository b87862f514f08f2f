import numpy as np
import pytest
from pyspark.sql import functions as F

from lagstream.operators import counts, lag, states
from lagstream.sources import trajectories as tr

SHORT = [np.array([0, 0, 1, 0, 1, 1, 0])] * 10


@pytest.fixture(scope="module")
def short(spark):
    return tr.from_numpy(spark, SHORT)


@pytest.mark.parametrize("k, mode, expected", [
    (1, "sliding", [[1, 2], [2, 1]]), (2, "sliding", [[1, 2], [1, 1]]), (3, "sliding", [[2, 1], [0, 1]]),
    (1, "sample", [[1, 2], [2, 1]]), (2, "sample", [[0, 1], [1, 1]]), (3, "sample", [[2, 0], [0, 0]])])
@pytest.mark.parametrize("by_join", [False, True])
def test_short_counts(short, k, mode, expected, by_join):
    assert (counts.to_matrix(counts.count_matrix(short, k, mode, by_join), 2) == 10 * np.array(expected)).all()


def test_counts_against_loop(spark):
    rng = np.random.default_rng(1)
    trajectories = [rng.integers(0, 4, n) for n in (1, 2, 30, 57)]
    df, k = tr.from_numpy(spark, trajectories), 3
    c = np.zeros((4, 4))
    for x in trajectories:
        for a, b in zip(x[:-k] if len(x) > k else [], x[k:]):
            c[a, b] += 1
    assert (counts.to_matrix(counts.count_matrix(df, k), 4) == c).all()
    assert np.allclose(counts.to_matrix(counts.count_matrix(df, k, "sliding-effective"), 4), c / k)
    many = counts.count_matrices(df, [1, 3]).where("lag = 3")
    assert (counts.to_matrix(many, 4) == c).all()


def test_negative_states_are_never_bridged(spark):
    df = tr.from_numpy(spark, [np.array([0, -1, 1, 1])])
    assert counts.to_matrix(counts.count_matrix(df, 1), 2).tolist() == [[0, 0], [0, 1]]
    assert {(r["state"], r["n"]) for r in counts.count_states(df).collect()} == {(0, 1), (1, 2)}


def test_too_short(spark):
    with pytest.raises(tr.TrajectoryTooShortError):
        counts.TransitionCountEstimator(7).fit(tr.from_numpy(spark, SHORT))


def test_path_weights(spark):
    df = tr.from_numpy(spark, [np.array([0, 1, 0, 1])])
    from pyspark.sql import functions as F

    df = df.withColumn("g", F.col("t") + 1.0).withColumn("m", F.col("t") * 0.1)
    got = counts.to_matrix(counts.reweighted_count_matrix(df, 2), 2)
    assert np.allclose(got, [[1 * np.exp(-0.3), 0], [0, 2 * np.exp(-0.5)]])
    neutral = df.withColumn("g", F.lit(1.0)).withColumn("m", F.lit(0.0))
    assert np.allclose(counts.to_matrix(counts.reweighted_count_matrix(neutral, 1), 2), counts.to_matrix(counts.count_matrix(df, 1), 2))


def test_connected_sets_and_submodels():
    c = np.zeros((8, 8))
    for a, b in ((0, 1), (1, 3), (3, 0), (4, 5), (5, 4), (1, 2), (5, 7)):
        c[a, b] = 3
    m = counts.TransitionCountModel(c, state_histogram=np.arange(8) + 1)
    assert [s.tolist() for s in m.connected_sets()] == [[0, 1, 3], [4, 5], [2], [6], [7]]
    assert [s.tolist() for s in m.connected_sets(directed=False)] == [[0, 1, 2, 3], [4, 5, 7], [6]]
    sub = m.submodel_largest()
    assert sub.state_symbols.tolist() == [0, 1, 3] and sub.n_states_full == 8
    assert sub.states_to_symbols([2]).tolist() == [3] and sub.symbols_to_states([3, 5]).tolist() == [2]
    assert sub.selected_state_fraction == 3 / 8 and np.isclose(sub.selected_count_fraction, 7 / 36)
    assert m.connected_sets(4.0)[0].tolist() == [0]


def test_statistical_inefficiency_of_noise_and_constant():
    rng = np.random.default_rng(0)
    assert counts.statistical_inefficiency([rng.standard_normal(5000)]) > 0.7
    assert counts.statistical_inefficiency([np.repeat(rng.standard_normal(200), 20)]) < 0.2


def test_gaps_are_not_bridged(spark):
    rows = [(0, t, s) for t, s in ((0, 0), (1, 1), (5, 0), (6, 1), (7, 1), (9, 0))] + [(1, 4, 1), (1, 6, 0)]
    d = spark.createDataFrame(rows, "traj_id long, t long, state int")
    at = {(i, t): s for i, t, s in rows}
    for k in (1, 2, 4):
        want = np.zeros((2, 2))
        for (i, t), s in at.items():
            if (i, t + k) in at:
                want[s, at[i, t + k]] += 1
        for by_join in (False, True):
            assert (counts.to_matrix(counts.count_matrix(d, k, by_join=by_join), 2) == want).all()
        assert (counts.to_matrix(counts.count_matrices(d, sorted({1, k})).where(f"lag = {k}"), 2) == want).all()
    two = {(r["i"], r["k"], r["j"]): r["v"] for r in counts.twostep_counts(d, 1).collect()}
    assert two == {(0, 1, 1): 1}
    weighted = counts.reweighted_count_matrix(d.withColumn("g", F.lit(1.0)).withColumn("m", F.lit(0.0)), 2)
    assert counts.to_matrix(weighted, 2).tolist() == [[0, 1], [0, 0]]  # 5 to 7; 7 to 9 and 4 to 6 lack a frame between
    assert counts.to_matrix(counts.count_matrix(d.where("t <> 6"), 1), 2).tolist() == [[0, 1], [0, 0]]


def test_inefficiencies_against_whole_sequences(spark):
    rng = np.random.default_rng(4)
    d = tr.from_numpy(spark, [rng.integers(0, 3, n) if n % 2 else np.repeat(rng.integers(0, 3, n // 4 + 1), 4)[:n] for n in (40, 61, 2, 120)])
    rows = counts.transition_pairs(d, 1).toPandas().sort_values(["i", "traj_id", "t"])
    for truncate in (True, False):
        got = {(r["i"], r["j"]): r["si"] for r in counts.statistical_inefficiencies(d, 1, truncate, chunk=5).collect()}
        want = {(i, j): counts.statistical_inefficiency([r["j"].to_numpy() == j for _, r in part.groupby("traj_id")], truncate) for i, part in rows.groupby("i") for j in part["j"].unique()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_effective_counts_are_fewer(short):
    plain, eff = (counts.to_matrix(f(short, 1), 2) for f in (counts.count_matrix, counts.effective_count_matrix))
    assert (eff <= plain + 1e-9).all() and ((eff > 0) == (plain > 0)).all()


def test_sampling(spark, short):
    with_replacement = states.sample_by_state(short, 5).collect()
    assert sorted(r["state"] for r in with_replacement) == [0] * 5 + [1] * 5
    without = states.sample_by_state(short, 6, replace=False).collect()
    assert len({(r["state"], r["traj_id"], r["t"]) for r in without}) == 12
    seq = states.sample_by_sequence(short, [1, 0, 1]).orderBy("position").collect()
    assert [r["state"] for r in seq] == [1, 0, 1]
    assert all(SHORT[0][r["t"]] == r["state"] for r in seq)


def test_bootstrap(short):
    boot = counts.bootstrap_trajectories(short, 3, seed=2)
    assert 35 <= boot.count() <= 110 and boot.groupBy("traj_id").count().agg({"count": "max"}).first()[0] == 3
    assert counts.bootstrap_counts(short, 1, 1, seed=3).agg({"v": "sum"}).first()[0] > 20


def test_lag_observations_and_windows(spark):
    df = tr.from_numpy(spark, [np.arange(7), np.arange(2)])
    pieces = lag.lag_observations(df, 3, 1).orderBy("source_id", "traj_id", "t").collect()
    got = {}
    for r in pieces:
        got.setdefault((r["source_id"], r["traj_id"]), []).append(r["state"])
    assert sorted(got.values()) == [[0, 3, 6], [1, 4], [2, 5]]
    w = lag.sliding_window(df.where("traj_id = 0"), 1, "state", fixed_width=True).orderBy("t").collect()
    assert [r["window"] for r in w] == [[0, 1, 2], [0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 6], [4, 5, 6]]
    assert [len(r["window"]) for r in lag.sliding_window(df.where("traj_id = 0"), 1, "state").orderBy("t").collect()] == [2, 3, 3, 3, 3, 3, 2]


def test_schema_checks(spark):
    df = tr.from_numpy(spark, [np.zeros((3, 2)), np.ones((4, 2))])
    assert tr.ensure_traj(df).count() == 7 and not tr.is_timelagged(df)
    with pytest.raises(tr.InputFormatError):
        tr.ensure_dtraj(df)
    with pytest.raises(tr.InputFormatError):
        tr.from_numpy(spark, [np.zeros(3, int), np.zeros((3, 2))])
