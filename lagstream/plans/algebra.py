"""Queries on models of the event trajectories, each with its SQL: fixed points and recursions as recursive CTEs on
five states, closed forms on two, hidden Markov recursions frame by frame, reweighting sums over samples.

Counts and moments come from the tables by the distributed operators; the functions under test act on these.
Values are rounded to PLACES decimals on both sides.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstream.functions import analysis, basis, estimation, flux, graph, linalg, simulate
from lagstream.operators import clustering, counts, decomposition, hmm, lag, moments, msm, states, tram, validation
from lagstream.plans.series import EVENTS, LINES, ORDERS, _pairs
from lagstream.sources import trajectories as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 7


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def _round(x: str, places: int = PLACES) -> str:
    return f"round({x}, {places}) + 0.0::DOUBLE"


def _table(spark, rows: Iterable[tuple], schema: str, places: int = PLACES) -> DataFrame:
    """Rows with doubles rounded, and no negative zero."""
    df = spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _vector(spark, values) -> DataFrame:
    return _table(spark, [(i, float(v)) for i, v in enumerate(np.real(values))], "i long, v double")


def _matrix(spark, m) -> DataFrame:
    return _table(spark, [(i, j, float(v)) for i, r in enumerate(np.real(m)) for j, v in enumerate(r)], "i long, j long, v double")


def _scalar(spark, **values) -> DataFrame:
    return _table(spark, [tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


# --- inputs, in Spark and in SQL


def _c(spark, sf) -> np.ndarray:
    """Counts of five event types at lag 1."""
    return counts.to_matrix(counts.count_matrix(tr.events_dtraj(spark, sf), 1), 5)


def _t(spark, sf) -> np.ndarray:
    return estimation.transition_matrix_non_reversible(_c(spark, sf))


def _c2(spark, sf) -> np.ndarray:
    """Counts of two classes of event types, made lazy: each row's sum is added to its diagonal."""
    d = tr.events_dtraj(spark, sf).withColumn("state", (F.col("state") >= 2).cast("int"))
    c = counts.to_matrix(counts.count_matrix(d, 1), 2)
    return c + np.diag(c.sum(1))


def _t2(spark, sf) -> np.ndarray:
    return estimation.transition_matrix_non_reversible(_c2(spark, sf))


_C = f"""{EVENTS}, {_pairs(1)},
g AS (SELECT a.range::BIGINT i, b.range::BIGINT j FROM range(5) a, range(5) b),
c AS MATERIALIZED (SELECT g.i, g.j, count(pr.j)::DOUBLE v FROM g LEFT JOIN pr ON pr.i = g.i AND pr.j = g.j GROUP BY g.i, g.j)"""
_T = _C + ", t AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY i) p FROM c)"
_PI = """, u(k, i, x) AS (SELECT 0, i, 0.2::DOUBLE FROM t WHERE j = 0 UNION ALL SELECT any_value(u.k) + 1, t.j, sum(u.x * t.p) FROM u JOIN t ON t.i = u.i WHERE u.k < 80 GROUP BY t.j),
pi AS MATERIALIZED (SELECT i, x FROM u WHERE k = 80)"""
#: The reversible estimate by its fixed point, with its stationary vector.
_REV = _C + """, w AS MATERIALIZED (SELECT a.i, a.j, a.v + b.v b, sum(a.v) OVER (PARTITION BY a.i) ci, sum(b.v) OVER (PARTITION BY a.j) cj FROM c a JOIN c b ON a.i = b.j AND a.j = b.i),
z(k, i, j, x) AS (SELECT 0, i, j, b FROM w UNION ALL
  SELECT s.k + 1, s.i, s.j, w.b / (w.ci / s.xi + w.cj / s.xj) FROM (SELECT *, sum(x) OVER (PARTITION BY i) xi, sum(x) OVER (PARTITION BY j) xj FROM z) s JOIN w ON w.i = s.i AND w.j = s.j WHERE s.k < 400),
t AS MATERIALIZED (SELECT i, j, x / sum(x) OVER (PARTITION BY i) p FROM z WHERE k = 400),
pi AS MATERIALIZED (SELECT i, sum(x) / (SELECT sum(x) FROM z WHERE k = 400) x FROM z WHERE k = 400 GROUP BY i)"""
_FORWARD = """, q(k, i, x) AS (SELECT 0, i, 0.0::DOUBLE FROM t WHERE j = 0 UNION ALL
  SELECT any_value(q.k) + 1, t.i, CASE t.i WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE sum(t.p * q.x) END FROM q JOIN t ON t.j = q.i WHERE q.k < 300 GROUP BY t.i), qp AS MATERIALIZED (SELECT i, x FROM q WHERE k = 300)"""
_BACKWARD = """, tb AS MATERIALIZED (SELECT t.j i, t.i j, t.p * a.x / b.x p FROM t JOIN pi a ON a.i = t.i JOIN pi b ON b.i = t.j),
qb(k, i, x) AS (SELECT 0, i, 0.0::DOUBLE FROM t WHERE j = 0 UNION ALL
  SELECT any_value(qb.k) + 1, tb.i, CASE tb.i WHEN 0 THEN 1 WHEN 4 THEN 0 ELSE sum(tb.p * qb.x) END FROM qb JOIN tb ON tb.j = qb.i WHERE qb.k < 300 GROUP BY tb.i), qm AS MATERIALIZED (SELECT i, x FROM qb WHERE k = 300)"""
_GROSS = ", f AS MATERIALIZED (SELECT t.i, t.j, pi.x * qm.x * t.p * qp.x v FROM t JOIN pi ON pi.i = t.i JOIN qm ON qm.i = t.i JOIN qp ON qp.i = t.j WHERE t.i <> t.j)"
_NET = ", n AS MATERIALIZED (SELECT a.i, a.j, greatest(a.v - b.v, 0) v FROM f a JOIN f b ON a.i = b.j AND a.j = b.i)"
_FLUX = _T + _PI + _FORWARD + _BACKWARD + _GROSS + _NET
#: One row: a and b, the chances to leave either class of the lazy chain, its counts, eigenvalue and stationary vector.
_TWO = f"""{EVENTS}, d2 AS (SELECT traj_id, t, (state >= 2)::INT s, lead((state >= 2)::INT) OVER (PARTITION BY traj_id ORDER BY t) r FROM dt),
n2 AS (SELECT count(*) FILTER (s = 0 AND r = 0)::DOUBLE c00, count(*) FILTER (s = 0 AND r = 1)::DOUBLE c01, count(*) FILTER (s = 1 AND r = 0)::DOUBLE c10, count(*) FILTER (s = 1 AND r = 1)::DOUBLE c11 FROM d2),
m2 AS (SELECT *, c01 / (c00 + c01) / 2 a, c10 / (c10 + c11) / 2 b FROM n2),
x AS (SELECT *, 1 - a - b lam, b / (a + b) p0, a / (a + b) p1 FROM m2)"""


def _cells(*values: str) -> str:
    """A 2 x 2 matrix, row by row, of the one row of x."""
    return " UNION ALL ".join(f"SELECT {k // 2}::BIGINT i, {k % 2}::BIGINT j, {_round(f'({v})::DOUBLE')} v FROM x" for k, v in enumerate(values))


def _with(base: str, rest: str) -> str:
    return f"WITH RECURSIVE {base} {rest}"


_OBS = (1.0, -2.0, 0.5, 3.0, -1.0)
_OBS_SQL = "o AS (SELECT unnest(range(5))::BIGINT i, unnest([1.0, -2.0, 0.5, 3.0, -1.0])::DOUBLE v)"

# --- stationary vectors, estimates


@query("stationary_distribution", _with(_T + _PI, f"SELECT i, {_round('x')} v FROM pi"))
def stationary_distribution(spark, sf):
    return _vector(spark, analysis.stationary_distribution(_t(spark, sf)))


@query("stationary_by_backward_iteration", _with(_T + _PI, f"SELECT i, {_round('x')} v FROM pi"))
def stationary_backward(spark, sf):
    return _vector(spark, analysis.stationary_distribution_from_backward_iteration(_t(spark, sf)))


@query("stationary_by_eigenvector", _with(_T + _PI, f"SELECT i, {_round('x')} v FROM pi"))
def stationary_eigenvector(spark, sf):
    return _vector(spark, analysis.stationary_distribution_from_eigenvector(_t(spark, sf)))


@query("reversible_estimate", _with(_REV, f"SELECT i, j, {_round('p', 5)} v FROM t"))
def reversible_estimate(spark, sf):
    return _matrix(spark, estimation.transition_matrix(_c(spark, sf), True, maxerr=1e-13)).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("reversible_estimate_pisym", _with(_T + _PI + ", s AS (SELECT a.i, a.j, a.p * x.x + b.p * y.x v FROM t a JOIN t b ON a.i = b.j AND a.j = b.i JOIN pi x ON x.i = a.i JOIN pi y ON y.i = a.j)", f"SELECT i, j, {_round('v / sum(v) OVER (PARTITION BY i)')} v FROM s"))
def reversible_pisym(spark, sf):
    return _matrix(spark, estimation.transition_matrix_reversible_pisym(_c(spark, sf)))


@query("reversible_estimate_of_two_classes", _with(_TWO, _cells("1 - a", "a", "b", "1 - b")))
def reversible_two(spark, sf):
    return _matrix(spark, estimation.mle_trev(_c2(spark, sf)))


@query("estimate_by_sets", _with(_T, f"SELECT i, j, {_round('p')} v FROM t"))
def estimate_by_sets(spark, sf):
    return _matrix(spark, estimation.estimate_p(_c(spark, sf), reversible=False))


@query("corrected_transition_matrix", _with(_C + ", r AS (SELECT i, sum(v) s FROM c GROUP BY i), m AS (SELECT max(s) top FROM r)", f"SELECT c.i, c.j, {_round('(c.v + CASE WHEN c.i = c.j THEN top - s ELSE 0 END) / top')} v FROM c JOIN r ON r.i = c.i, m"))
def corrected(spark, sf):
    return _matrix(spark, estimation.correct_transition_matrix(_c(spark, sf)))


@query("prior_counts", _with(_C, f"SELECT a.i, a.j, {_round('CASE WHEN a.v + b.v > 0 THEN 0.001 ELSE 0 END + 0.001 - CASE WHEN a.j >= a.i THEN 1 ELSE 0 END')} v FROM c a JOIN c b ON a.i = b.j AND a.j = b.i"))
def prior_counts(spark, sf):
    c = _c(spark, sf)
    return _matrix(spark, estimation.prior_neighbor(c) + estimation.prior_const(c) + estimation.prior_rev(c))


@query("dense_log_likelihood", _with(_T, f"SELECT {_round('sum(c.v * ln(t.p))', 4)} v FROM c JOIN t ON t.i = c.i AND t.j = c.j WHERE c.v > 0"))
def dense_log_likelihood(spark, sf):
    c = _c(spark, sf)
    return _table(spark, [(estimation.log_likelihood(c, estimation.transition_matrix_non_reversible(c)),)], "v double", 4)


@query("posterior_covariance", _with(_C + ", a AS (SELECT i, j, v + 1 v, sum(v + 1) OVER (PARTITION BY i) w FROM c)", f"SELECT a.i, a.j, b.j AS k, {_round('1e6 * (CASE WHEN a.j = b.j THEN a.w * a.v ELSE 0 END - a.v * b.v) / (a.w * a.w * (a.w + 1))')} v FROM a JOIN a b ON a.i = b.i"))
def posterior_covariance(spark, sf):
    cov = estimation.tmatrix_cov(_c(spark, sf))
    return _table(spark, [(i, j, k, float(1e6 * cov[i, j, k])) for i, j, k in np.ndindex(cov.shape)], "i long, j long, k long, v double")


@query("error_perturbation", _with(_C + ", a AS (SELECT i, j, v + 1 v, sum(v + 1) OVER (PARTITION BY i) w, (i + 2 * j)::DOUBLE s FROM c)", f"SELECT {_round('1e6 * sum(a.s * b.s * (CASE WHEN a.j = b.j THEN a.w * a.v ELSE 0 END - a.v * b.v) / (a.w * a.w * (a.w + 1)))', 4)} v FROM a JOIN a b ON a.i = b.i"))
def error_perturbation(spark, sf):
    s = np.add.outer(np.arange(5.0), 2 * np.arange(5.0))
    return _table(spark, [(1e6 * estimation.error_perturbation(_c(spark, sf), s),)], "v double", 4)


# --- properties


@query("matrix_properties", _with(_T + _PI + ", rv AS (SELECT max(abs(x.x * a.p - y.x * b.p)) < 1e-12 r FROM t a JOIN t b ON a.i = b.j AND a.j = b.i JOIN pi x ON x.i = a.i JOIN pi y ON y.i = a.j), h AS (SELECT i, j FROM c WHERE v > 0), cl(i, j) AS (SELECT * FROM h UNION SELECT cl.i, h.j FROM cl JOIN h ON h.i = cl.j)",
                                  "SELECT (SELECT bool_and(abs(s - 1) < 1e-12) FROM (SELECT sum(p) s FROM t GROUP BY i)) stochastic, (SELECT r FROM rv) reversible, (SELECT count(*) = 25 FROM cl) connected, (SELECT count(*) = 25 FROM cl) ergodic, (SELECT bool_and(abs(s) < 1e-12) FROM (SELECT sum(p - (i = j)::INT) s FROM t GROUP BY i)) rates"))
def matrix_properties(spark, sf):
    t = _t(spark, sf)
    found = (analysis.is_transition_matrix(t), analysis.is_reversible(t), analysis.is_connected(t), analysis.is_ergodic(t), analysis.is_rate_matrix(t - np.eye(5)))
    return spark.createDataFrame([tuple(map(bool, found))], "stochastic boolean, reversible boolean, connected boolean, ergodic boolean, rates boolean")


#: Edges are counts of at least 1.04 times the mean, so the graph falls apart.
_EDGES = _C + ", h AS (SELECT i, j FROM c WHERE v >= (SELECT 1.04::DOUBLE * avg(v) FROM c)), cl(i, j) AS (SELECT * FROM h UNION SELECT cl.i, h.j FROM cl JOIN h ON h.i = cl.j), hu AS (SELECT i, j FROM h UNION SELECT j, i FROM h), cu(i, j) AS (SELECT * FROM hu UNION SELECT cu.i, hu.j FROM cu JOIN hu ON hu.i = cu.j)"
_STRONG = ", sc AS (SELECT a.i, least(a.i, coalesce(min(a.j) FILTER (b.i IS NOT NULL), a.i)) s FROM (SELECT DISTINCT i, j FROM cl UNION SELECT i, i FROM c) a LEFT JOIN cl b ON b.i = a.j AND b.j = a.i GROUP BY a.i)"


def _least_of_sets(spark, sets) -> DataFrame:
    return spark.createDataFrame([(int(i), int(min(s))) for s in sets for i in s], "i long, s long")


@query("strong_components", _with(_EDGES + _STRONG, "SELECT i, s FROM sc"))
def strong_components(spark, sf):
    c = _c(spark, sf)
    return _least_of_sets(spark, graph.compute_connected_sets(c, 1.04 * c.mean()))


@query("weak_components", _with(_EDGES, "SELECT c.i, least(c.i, coalesce(min(cu.j), c.i)) s FROM (SELECT DISTINCT i FROM c) c LEFT JOIN cu ON cu.i = c.i GROUP BY c.i"))
def weak_components(spark, sf):
    c = _c(spark, sf)
    return _least_of_sets(spark, graph.compute_connected_sets(c, 1.04 * c.mean(), directed=False))


@query("largest_component_counts", _with(_EDGES + _STRONG + ", z AS (SELECT s, count(*) n FROM sc GROUP BY s ORDER BY n DESC, s LIMIT 1), k AS (SELECT sc.i, row_number() OVER (ORDER BY sc.i) - 1 r FROM sc JOIN z ON z.s = sc.s)", f"SELECT a.r::BIGINT i, b.r::BIGINT j, {_round('c.v')} v FROM c JOIN k a ON a.i = c.i JOIN k b ON b.i = c.j"))
def largest_component_counts(spark, sf):
    c = _c(spark, sf)
    return _matrix(spark, counts.TransitionCountModel(c).submodel_largest(1.04 * c.mean()).count_matrix)


@query("closed_components", _with(_EDGES + _STRONG + ", op AS (SELECT DISTINCT a.s FROM h JOIN sc a ON a.i = h.i JOIN sc b ON b.i = h.j WHERE a.s <> b.s)", "SELECT i, s FROM sc WHERE s NOT IN (SELECT s FROM op)"))
def closed_components(spark, sf):
    c = _c(spark, sf)
    return _least_of_sets(spark, graph.closed_sets(c, 1.04 * c.mean()))


@query("reachable_pairs", _with(_EDGES, "SELECT g.i, g.j, g.i = g.j OR cl.i IS NOT NULL reached FROM g LEFT JOIN (SELECT DISTINCT i, j FROM cl) cl ON cl.i = g.i AND cl.j = g.j"))
def reachable_pairs(spark, sf):
    c = _c(spark, sf)
    c = np.where(c >= 1.04 * c.mean(), c, 0)
    return spark.createDataFrame([(i, j, bool(i == j or graph.has_connection(c, [i], [j]))) for i in range(5) for j in range(5)], "i long, j long, reached boolean")


@query("count_model_fractions", _with(f"{EVENTS}, {_pairs(1)}", "SELECT 0.6::DOUBLE states, round(avg((state IN (0, 2, 3))::INT)::DOUBLE, 7) + 0.0::DOUBLE share, count(*) FILTER (state IN (0, 2, 3))::DOUBLE total, (SELECT count(*) FROM pr WHERE i IN (0, 2, 3) AND j IN (0, 2, 3))::DOUBLE pairs FROM dt"))
def count_model_fractions(spark, sf):
    m = counts.TransitionCountEstimator(1).fit(tr.events_dtraj(spark, sf)).submodel([0, 2, 3])
    return _scalar(spark, states=m.selected_state_fraction, share=m.selected_count_fraction, total=m.total_count, pairs=m.count_matrix.sum())


@query("counts_of_chosen_states", _with(f"{EVENTS}, {_pairs(1)}", "SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM pr WHERE i IN (1, 4) AND j IN (1, 4) GROUP BY i, j"))
def counts_of_chosen_states(spark, sf):
    chosen = spark.createDataFrame([(1,), (4,)], "state int")
    return counts.counts_submatrix(counts.count_matrix(tr.events_dtraj(spark, sf), 1), chosen).select(F.col("i").cast("long"), F.col("j").cast("long"), "v")


@query("number_of_states", _with(EVENTS, "SELECT (max(state) + 1)::BIGINT n, count(DISTINCT state) FILTER (state <> 1)::BIGINT used FROM dt"))
def number_of_states(spark, sf):
    d = tr.events_dtraj(spark, sf)
    return spark.createDataFrame([(counts.number_of_states(d), counts.number_of_states(d.where("state <> 1"), True))], "n long, used long")


@query("model_states_to_symbols", "SELECT unnest([0, 1, 2])::BIGINT i, unnest([0, 2, 3])::BIGINT symbol, unnest([0, 1, 2])::BIGINT back FROM (SELECT count(*) FROM events)")
def states_to_symbols(spark, sf):
    m = counts.TransitionCountEstimator(1).fit(tr.events_dtraj(spark, sf)).submodel([0, 2, 3])
    symbols, back = m.states_to_symbols([0, 1, 2]), m.symbols_to_states([0, 2, 3])
    return spark.createDataFrame([(i, int(s), int(b)) for i, (s, b) in enumerate(zip(symbols, back))], "i long, symbol long, back long")


# --- gaps

#: Every seventh frame is missing.
_HOLES = f"{ORDERS}, ho AS (SELECT * FROM dt WHERE (t + traj_id) % 7 <> 3)"


def _holes(df: DataFrame) -> DataFrame:
    return df.where((F.col("t") + F.col("traj_id")) % 7 != 3)


@query("transition_counts_with_gaps", _with(_HOLES, "SELECT a.state::BIGINT i, b.state::BIGINT j, count(*)::DOUBLE v FROM ho a JOIN ho b ON b.traj_id = a.traj_id AND b.t = a.t + 2 GROUP BY ALL"))
def counts_with_gaps(spark, sf):
    return counts.count_matrix(_holes(tr.orders_dtraj(spark, sf)), 2).select(F.col("i").cast("long"), F.col("j").cast("long"), "v")


@query("lag_pairs_with_gaps", _with(_HOLES, "SELECT a.traj_id, a.t, a.value x, b.value y FROM ho a JOIN ho b ON b.traj_id = a.traj_id AND b.t = a.t + 1"))
def pairs_with_gaps(spark, sf):
    return lag.lag_pairs(_holes(tr.orders_value(spark, sf)), 1).select("traj_id", "t", F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))


@query("counts_by_many_lags_with_gaps", _with(_HOLES, "SELECT k::BIGINT lag, a.state::BIGINT i, b.state::BIGINT j, count(*)::DOUBLE v FROM (SELECT unnest([1, 3]) k), ho a JOIN ho b ON b.traj_id = a.traj_id AND b.t = a.t + k GROUP BY ALL"))
def many_lags_with_gaps(spark, sf):
    return counts.count_matrices(_holes(tr.orders_dtraj(spark, sf)), [1, 3]).select(*(F.col(c).cast("long") for c in ("lag", "i", "j")), "v")


@query("fragments_of_blocks", _with(ORDERS + ", f AS (SELECT traj_id, t, state, t // 3 k FROM dt), b AS (SELECT traj_id, k, t - 3 * k u, state FROM f UNION ALL SELECT traj_id, k - 1, t - 3 * (k - 1), state FROM f WHERE k > 0)", "SELECT u::BIGINT u, state::BIGINT state, count(*)::BIGINT n FROM b GROUP BY ALL"))
def fragments_of_blocks(spark, sf):
    return lag.blocksplit(tr.orders_dtraj(spark, sf), 3).groupBy(F.col("t").cast("long").alias("u"), F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


# --- inefficiencies

_SI = f"""{EVENTS}, {_pairs(1)}, se AS (SELECT traj_id, i, j, row_number() OVER (PARTITION BY traj_id, i ORDER BY t) p, count(*) OVER (PARTITION BY traj_id, i) n FROM pr WHERE j IS NOT NULL),
ln AS (SELECT DISTINCT traj_id, i, n FROM se), lo AS (SELECT i, max(n) longest, sum(n) whole FROM ln GROUP BY i),
hi AS (SELECT i, j, count(*)::DOUBLE hits FROM se GROUP BY i, j), me AS (SELECT hi.i, j, hits / whole::DOUBLE m, longest FROM hi JOIN lo ON lo.i = hi.i),
ks AS (SELECT i, j, m, longest, unnest(range(1, longest)) k FROM me),
tot AS (SELECT lo.i, k, sum(greatest(n - k, 0))::DOUBLE n FROM ln JOIN lo ON lo.i = ln.i, LATERAL (SELECT unnest(range(1, lo.longest)) k) GROUP BY lo.i, k),
bo AS (SELECT a.i, a.j, b.p - a.p k, count(*)::DOUBLE n FROM se a JOIN se b ON a.traj_id = b.traj_id AND a.i = b.i AND a.j = b.j AND b.p > a.p GROUP BY ALL),
ed AS (SELECT se.i, se.j, k, sum((p + k <= n)::INT + (p > k)::INT)::DOUBLE n FROM se JOIN lo ON lo.i = se.i, LATERAL (SELECT unnest(range(1, lo.longest)) k) GROUP BY ALL),
ac AS (SELECT ks.i, ks.j, ks.k, longest, m, (coalesce(bo.n, 0) - m * ed.n) / tot.n + m * m v FROM ks JOIN tot ON tot.i = ks.i AND tot.k = ks.k JOIN ed ON ed.i = ks.i AND ed.j = ks.j AND ed.k = ks.k LEFT JOIN bo ON bo.i = ks.i AND bo.j = ks.j AND bo.k = ks.k),
cu AS (SELECT *, coalesce(min(k) FILTER (v <= 1e-12 * m) OVER (PARTITION BY i, j), longest) stop FROM ac),
si AS (SELECT me.i, me.j, 1 / (2 * (0.5 + coalesce(sum(v * (1 - k / cu.longest::DOUBLE)) FILTER (k < stop), 0) / any_value(me.m))) v FROM me LEFT JOIN cu ON cu.i = me.i AND cu.j = me.j GROUP BY me.i, me.j)"""


@query("statistical_inefficiencies", _with(_SI, f"SELECT i::BIGINT i, j::BIGINT j, {_round('v')} si FROM si"))
def statistical_inefficiencies(spark, sf):
    return counts.statistical_inefficiencies(tr.events_dtraj(spark, sf), 1).select(F.col("i").cast("long"), F.col("j").cast("long"), (F.round("si", PLACES) + F.lit(0.0)).alias("si"))


@query("effective_counts", _with(_SI, f"SELECT si.i::BIGINT i, si.j::BIGINT j, {_round('hits * sum(hits * v) OVER (PARTITION BY si.i) / sum(hits) OVER (PARTITION BY si.i)', 5)} v FROM si JOIN hi ON hi.i = si.i AND hi.j = si.j"))
def effective_counts(spark, sf):
    return counts.effective_count_matrix(tr.events_dtraj(spark, sf), 1).select(F.col("i").cast("long"), F.col("j").cast("long"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


# --- passage, committors, fluxes


def _msm(spark, sf):
    return msm.MaximumLikelihoodMSM().fit(tr.events_dtraj(spark, sf), 1)


@query("msm_stationary_distribution", _with(_REV, f"SELECT i, {_round('x', 6)} v FROM pi"))
def msm_stationary(spark, sf):
    return _table(spark, list(enumerate(map(float, _msm(spark, sf).stationary_distribution))), "i long, v double", 6)


_MFPT = ", m(k, b, i, x) AS (SELECT 0, j, i, 0.0::DOUBLE FROM g UNION ALL SELECT any_value(m.k) + 1, m.b, t.i, CASE WHEN t.i = m.b THEN 0 ELSE 1 + sum(t.p * m.x) END FROM m JOIN t ON t.j = m.i WHERE m.k < 500 GROUP BY m.b, t.i)"


@query("msm_mfpt", _with(_REV + _MFPT, f"SELECT i a, b, {_round('x', 5)} mfpt FROM m WHERE k = 500 AND i <> b"))
def msm_mfpt(spark, sf):
    m = _msm(spark, sf)
    return _table(spark, [(a, b, m.mfpt([a], [b])) for a in range(5) for b in range(5) if a != b], "a long, b long, mfpt double", 5)


@query("mfpt_to_state", _with(_T + _MFPT, f"SELECT b, i, {_round('x', 6)} v FROM m WHERE k = 500"))
def mfpt_to_state(spark, sf):
    t = _t(spark, sf)
    return _table(spark, [(b, i, float(v)) for b in range(5) for i, v in enumerate(analysis.mfpt(t, b))], "b long, i long, v double", 6)


@query("mfpt_between_sets", _with(_T + _PI + ", m(k, i, x) AS (SELECT 0, i, 0.0::DOUBLE FROM pi UNION ALL SELECT any_value(m.k) + 1, t.i, CASE WHEN t.i IN (3, 4) THEN 0 ELSE 1 + sum(t.p * m.x) END FROM m JOIN t ON t.j = m.i WHERE m.k < 300 GROUP BY t.i)", f"SELECT {_round('sum(pi.x * m.x) / sum(pi.x)', 6)} v FROM m JOIN pi ON pi.i = m.i WHERE m.k = 300 AND m.i IN (0, 1)"))
def mfpt_between_sets(spark, sf):
    return _table(spark, [(analysis.mfpt_between_sets(_t(spark, sf), [3, 4], [0, 1]),)], "v double", 6)


@query("hitting_probability", _with(_T + ", a AS MATERIALIZED (SELECT i, j, CASE WHEN i = 0 THEN (j = 0)::INT::DOUBLE ELSE p END p FROM t), q(k, i, x) AS (SELECT 0, i, 0.0::DOUBLE FROM a WHERE j = 0 UNION ALL SELECT any_value(q.k) + 1, a.i, CASE a.i WHEN 4 THEN 1 ELSE sum(a.p * q.x) END FROM q JOIN a ON a.j = q.i WHERE q.k < 300 GROUP BY a.i)", f"SELECT i, {_round('x')} v FROM q WHERE k = 300"))
def hitting_probability(spark, sf):
    t = _t(spark, sf)
    t[0] = np.eye(5)[0]  # a trap: whoever falls in never arrives
    return _vector(spark, analysis.hitting_probability(t, 4))


@query("msm_committor", _with(_REV + _FORWARD, f"SELECT i, {_round('x', 6)} v FROM qp"))
def msm_committor(spark, sf):
    return _table(spark, list(enumerate(map(float, _msm(spark, sf).committor_forward([0], [4])))), "i long, v double", 6)


@query("forward_committor", _with(_T + _FORWARD, f"SELECT i, {_round('x')} v FROM qp"))
def forward_committor(spark, sf):
    return _vector(spark, analysis.committor(_t(spark, sf), [0], [4]))


@query("backward_committor", _with(_T + _PI + _BACKWARD, f"SELECT i, {_round('x')} v FROM qm"))
def backward_committor(spark, sf):
    return _vector(spark, analysis.committor(_t(spark, sf), [0], [4], forward=False))


def _parts(spark, sf):
    t = _t(spark, sf)
    pi = analysis.stationary_distribution(t)
    return t, pi, analysis.backward_committor(t, [0], [4], pi), analysis.forward_committor(t, [0], [4])


def _gross(spark, sf):
    return flux.flux_matrix(*_parts(spark, sf), netflux=False)


@query("gross_flux", _with(_FLUX, f"SELECT i, j, {_round('v', 9)} v FROM f"))
def gross_flux(spark, sf):
    f = _gross(spark, sf)
    return _table(spark, [(i, j, float(f[i, j])) for i in range(5) for j in range(5) if i != j], "i long, j long, v double", 9)


@query("net_flux", _with(_FLUX, f"SELECT i, j, {_round('v', 9)} v FROM n"))
def net_flux(spark, sf):
    f = flux.to_netflux(_gross(spark, sf))
    return _table(spark, [(i, j, float(f[i, j])) for i in range(5) for j in range(5) if i != j], "i long, j long, v double", 9)


@query("msm_reactive_flux", _with(_REV + _FORWARD + ", qm AS (SELECT i, 1 - x x FROM qp)" + _GROSS + _NET, f"SELECT i, j, {_round('v', 7)} f FROM n WHERE v > 1e-6"))
def msm_reactive_flux(spark, sf):
    f = _msm(spark, sf).reactive_flux([0], [4]).net_flux
    return _table(spark, [(i, j, float(f[i, j])) for i in range(5) for j in range(5) if f[i, j] > 1e-6], "i long, j long, f double", 7)


def _reactive(spark, sf):
    t, pi, qm, qp = _parts(spark, sf)
    return flux.reactive_flux(t, [0], [4], pi, qm, qp)


@query("flux_totals", _with(_FLUX + ", a AS (SELECT sum(v) total FROM n WHERE i = 0), b AS (SELECT sum(pi.x * qm.x) back FROM pi JOIN qm ON qm.i = pi.i)", f"SELECT {_round('total', 8)} total, {_round('total / back', 8)} rate, {_round('round(back / total, 5)', 8)} mfpt FROM a, b"))
def flux_totals(spark, sf):
    r = _reactive(spark, sf)
    return _table(spark, [(float(r.total_flux), float(r.rate), round(float(r.mfpt), 5))], "total double, rate double, mfpt double", 8)


@query("flux_production", _with(_FLUX, f"SELECT g.i, {_round('sum(v * ((n.i = g.i)::INT - (n.j = g.i)::INT))', 9)} v FROM n, (SELECT DISTINCT i FROM c) g GROUP BY g.i"))
def flux_production(spark, sf):
    p = flux.flux_production(flux.to_netflux(_gross(spark, sf)))
    return _table(spark, [(i, float(v)) for i, v in enumerate(p)], "i long, v double", 9)


@query("flux_producers_consumers", _with(_FLUX + ", s AS (SELECT g.i, sum(v) FILTER (n.i = g.i) outgoing, sum(v) FILTER (n.j = g.i) incoming FROM n, (SELECT DISTINCT i FROM c) g GROUP BY g.i)", "SELECT i, outgoing - incoming > 1e-12 AND (outgoing - incoming) / greatest(outgoing, incoming) > 1e-5 producer, incoming - outgoing > 1e-12 AND (incoming - outgoing) / greatest(outgoing, incoming) > 1e-5 consumer FROM s"))
def flux_ends(spark, sf):
    f = flux.to_netflux(_gross(spark, sf))
    a, b = set(flux.flux_producers(f).tolist()), set(flux.flux_consumers(f).tolist())
    return spark.createDataFrame([(i, i in a, i in b) for i in range(5)], "i long, producer boolean, consumer boolean")


@query("flux_of_sets", _with(_FLUX + ", k AS (SELECT i, CASE WHEN i IN (0, 1) THEN 0 WHEN i = 2 THEN 1 ELSE 2 END s FROM (SELECT DISTINCT i FROM c))", f"SELECT a.s::BIGINT i, b.s::BIGINT j, {_round('sum(f.v)', 9)} v FROM f JOIN k a ON a.i = f.i JOIN k b ON b.i = f.j WHERE a.s <> b.s GROUP BY a.s, b.s"))
def flux_of_sets(spark, sf):
    f = flux.coarsegrain(_gross(spark, sf), [{0, 1}, {2}, {3, 4}])
    return _table(spark, [(i, j, float(f[i, j])) for i in range(3) for j in range(3) if i != j], "i long, j long, v double", 9)


_WALKS = ", pa(path, w) AS (SELECT [0::BIGINT], 1e300::DOUBLE UNION ALL SELECT list_append(path, n.j), least(w, n.v) FROM pa JOIN n ON n.i = path[-1] WHERE n.v > 0 AND path[-1] <> 4 AND NOT list_contains(path, n.j))"


@query("widest_pathway", _with(_FLUX + _WALKS, f"SELECT {_round('max(w)', 9)} v FROM pa WHERE path[-1] = 4"))
def widest_pathway(spark, sf):
    return _table(spark, [(flux.pathway(flux.to_netflux(_gross(spark, sf)), [0], [4])[1],)], "v double", 9)


@query("bottleneck_edge", _with(_FLUX + _WALKS + ", b AS (SELECT max(w) w FROM pa WHERE path[-1] = 4)", "SELECT n.i, n.j FROM n, b WHERE n.v = b.w"))
def bottleneck_edge(spark, sf):
    i, j = flux.find_bottleneck(flux.to_netflux(_gross(spark, sf)), [0], [4])
    return spark.createDataFrame([(int(i), int(j))], "i long, j long")


@query("pathways_carry_all_flux", _with(_FLUX, f"SELECT {_round('sum(v)', 8)} v FROM n WHERE i = 0"))
def pathways_carry_all(spark, sf):
    return _table(spark, [(float(sum(_reactive(spark, sf).pathways()[1])),)], "v double", 8)


# --- time evolution


@query("propagated_distribution", _with(_T + ", v(k, i, x) AS (SELECT 0, i, (i = 2)::INT::DOUBLE FROM t WHERE j = 0 UNION ALL SELECT any_value(v.k) + 1, t.j, sum(v.x * t.p) FROM v JOIN t ON t.i = v.i WHERE v.k < 3 GROUP BY t.j)", f"SELECT k::BIGINT k, i, {_round('x')} v FROM v"))
def propagated(spark, sf):
    m = msm.MarkovStateModel(_t(spark, sf))
    return _table(spark, [(k, i, float(x)) for k in range(4) for i, x in enumerate(m.propagate(np.eye(5)[2], k))], "k long, i long, v double")


@query("expected_transition_counts", _with(_T + ", v(k, i, x) AS (SELECT 0, i, 0.2::DOUBLE FROM t WHERE j = 0 UNION ALL SELECT any_value(v.k) + 1, t.j, sum(v.x * t.p) FROM v JOIN t ON t.i = v.i WHERE v.k < 11 GROUP BY t.j), s AS (SELECT i, sum(x) FILTER (k < 3) few, sum(x) many FROM v GROUP BY i)", f"SELECT t.i, t.j, {_round('few * p')} few, {_round('many * p')} many FROM t JOIN s ON s.i = t.i"))
def expected_transition_counts(spark, sf):
    t, p0 = _t(spark, sf), np.full(5, 0.2)
    few, many = analysis.expected_counts(p0, t, 3), analysis.expected_counts(p0, t, 12)
    return _table(spark, [(i, j, float(few[i, j]), float(many[i, j])) for i in range(5) for j in range(5)], "i long, j long, few double, many double")


_EVOLVE = f", {_OBS_SQL}, h(k, i, x) AS (SELECT 0, i, v FROM o UNION ALL SELECT any_value(h.k) + 1, t.i, sum(t.p * h.x) FROM h JOIN t ON t.j = h.i WHERE h.k < 9 GROUP BY t.i)"


@query("state_expectation", _with(_T + _PI + f", {_OBS_SQL}", f"SELECT {_round('sum(pi.x * o.v)')} v FROM pi JOIN o ON o.i = pi.i"))
def state_expectation(spark, sf):
    return _scalar(spark, v=analysis.expectation(_t(spark, sf), np.array(_OBS)))


@query("time_correlation", _with(_T + _PI + _EVOLVE, f"SELECT k::BIGINT k, {_round('sum(pi.x * o.v * h.x)')} v FROM h JOIN pi ON pi.i = h.i JOIN o ON o.i = h.i WHERE k IN (1, 4, 9) GROUP BY k"))
def time_correlation(spark, sf):
    times = (4, 1, 9)
    return _table(spark, list(zip(times, map(float, analysis.correlation(_t(spark, sf), np.array(_OBS), times=times)))), "k long, v double")


@query("time_relaxation", _with(_T + _EVOLVE, f"SELECT k::BIGINT k, {_round('x')} v FROM h WHERE i = 3 AND k IN (0, 2, 9)"))
def time_relaxation(spark, sf):
    times = (0, 2, 9)
    return _table(spark, list(zip(times, map(float, analysis.relaxation(_t(spark, sf), np.eye(5)[3], np.array(_OBS), times)))), "k long, v double")


@query("fingerprint_sums", _with(_T + _PI + _EVOLVE, f"SELECT {_round('sum(pi.x * o.v * h.x) FILTER (k = 0)')} correlation, {_round('sum(h.x) FILTER (k = 0 AND h.i = 3)')} relaxation FROM h JOIN pi ON pi.i = h.i JOIN o ON o.i = h.i"))
def fingerprint_sums(spark, sf):
    t, o = _t(spark, sf), np.array(_OBS)
    return _scalar(spark, correlation=np.real(analysis.fingerprint_correlation(t, o)[1].sum()), relaxation=np.real(analysis.fingerprint_relaxation(t, np.eye(5)[3], o)[1].sum()))


# --- spectra: traces of powers fix eigenvalues, products fix eigenvectors

_POWERS = ", mp(k, i, j, p) AS (SELECT 1, i, j, p FROM t UNION ALL SELECT any_value(mp.k) + 1, mp.i, t.j, sum(mp.p * t.p) FROM mp JOIN t ON t.i = mp.j WHERE mp.k < 5 GROUP BY mp.i, t.j)"


@query("eigenvalue_power_sums", _with(_T + _POWERS, f"SELECT k::BIGINT k, {_round('sum(p)', 9)} v FROM mp WHERE i = j GROUP BY k"))
def eigenvalue_power_sums(spark, sf):
    e = analysis.eigenvalues(_t(spark, sf))
    return _table(spark, [(k, float(np.real((e**k).sum()))) for k in range(1, 6)], "k long, v double", 9)


@query("reversible_eigenvalue_power_sums", _with(_REV + _POWERS, f"SELECT k::BIGINT k, {_round('sum(p)', 6)} v FROM mp WHERE i = j GROUP BY k"))
def reversible_eigenvalue_power_sums(spark, sf):
    m = _msm(spark, sf)
    e = analysis.eigenvalues_rev(m.transition_matrix, mu=m.stationary_distribution)
    return _table(spark, [(k, float((e**k).sum())) for k in range(1, 6)], "k long, v double", 6)


@query("rdl_product", _with(_T, f"SELECT i, j, {_round('p')} v FROM t"))
def rdl_product(spark, sf):
    r, d, left = analysis.rdl_decomposition(_t(spark, sf))
    return _matrix(spark, r @ d @ left)


@query("rdl_product_reversible", _with(_REV, f"SELECT i, j, {_round('p', 5)} v FROM t"))
def rdl_product_reversible(spark, sf):
    r, d, left = analysis.rdl_decomposition_rev(_msm(spark, sf).transition_matrix)
    return _matrix(spark, r @ d @ left).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("left_times_right_eigenvectors", _with(_T, f"SELECT i, j, {_round('(i = j)::INT::DOUBLE')} v FROM t"))
def eigenvector_duality(spark, sf):
    m = msm.MarkovStateModel(_t(spark, sf))
    return _matrix(spark, m.eigenvectors_left() @ m.eigenvectors_right())


@query("two_class_eigenvalues", _with(_TWO, f"SELECT {_round('1::DOUBLE')} lam1, {_round('lam')} lam2, {_round('-1 / ln(lam)')} timescale FROM x"))
def two_class_eigenvalues(spark, sf):
    m = msm.MarkovStateModel(_t2(spark, sf))
    e = np.real(m.eigenvalues())
    return _scalar(spark, lam1=e[0], lam2=e[1], timescale=m.timescales()[0])


@query("eigenvalue_sensitivity", _with(_TWO, _cells("p1", "-p0", "-p1", "p0")))
def eigenvalue_sensitivity(spark, sf):
    return _matrix(spark, analysis.eigenvalue_sensitivity(_t2(spark, sf), 1))


@query("timescale_sensitivity", _with(_TWO, _cells(*(f"{v} / (lam * ln(lam) * ln(lam))" for v in ("p1", "-p0", "-p1", "p0")))))
def timescale_sensitivity(spark, sf):
    return _matrix(spark, analysis.timescale_sensitivity(_t2(spark, sf), 1))


@query("stationary_sensitivity", _with(_TWO, _cells("p0 * (1 - p0) / (a + b)", "-p0 * p0 / (a + b)", "p1 * (1 - p0) / (a + b)", "-p1 * p0 / (a + b)")))
def stationary_sensitivity(spark, sf):
    return _matrix(spark, analysis.stationary_distribution_sensitivity(_t2(spark, sf), 0))


@query("expectation_sensitivity", _with(_TWO, _cells("p0 * p1 * -3 / (a + b)", "p0 * p0 * 3 / (a + b)", "p1 * p1 * -3 / (a + b)", "p1 * p0 * 3 / (a + b)")))
def expectation_sensitivity(spark, sf):
    return _matrix(spark, analysis.expectation_sensitivity(_t2(spark, sf), np.array([1.0, 4.0])))


@query("mfpt_sensitivity", _with(_TWO, _cells("1 / (a * a)", "0", "0", "0")))
def mfpt_sensitivity(spark, sf):
    return _matrix(spark, analysis.mfpt_sensitivity(_t2(spark, sf), 1, 0))


@query("fingerprint_of_two_classes", _with(_TWO + ", e AS (SELECT *, p0 * 1 + p1 * 4 m FROM x)", f"SELECT {_round('m * m')} c0, {_round('p0 + 16 * p1 - m * m')} c1, {_round('m')} r0, {_round('1 - m')} r1, {_round('-1 / ln(lam)')} ts FROM e"))
def fingerprint_of_two(spark, sf):
    t, o = _t2(spark, sf), np.array([1.0, 4.0])
    (ts, c), (_, r) = analysis.fingerprint_correlation(t, o), analysis.fingerprint_relaxation(t, np.array([1.0, 0.0]), o)
    return _scalar(spark, c0=np.real(c[0]), c1=np.real(c[1]), r0=np.real(r[0]), r1=np.real(r[1]), ts=ts[1])


@query("matrix_square_root", _with(_TWO, _cells("p0 + sqrt(lam) * p1", "p1 - sqrt(lam) * p1", "p0 - sqrt(lam) * p0", "p1 + sqrt(lam) * p0")))
def matrix_square_root(spark, sf):
    return _matrix(spark, linalg.matrix_power(_t2(spark, sf), 0.5))


@query("matrix_logarithm", _with(_TWO, _cells("ln(lam) * p1", "-ln(lam) * p1", "-ln(lam) * p0", "ln(lam) * p0")))
def matrix_logarithm(spark, sf):
    return _matrix(spark, linalg.matrix_log(_t2(spark, sf)))


@query("matrix_exponential", _with(_TWO, _cells(*(f"exp(1) * ({v})" for v in ("p0 + exp(lam - 1) * p1", "p1 - exp(lam - 1) * p1", "p0 - exp(lam - 1) * p0", "p1 + exp(lam - 1) * p0")))))
def matrix_exponential(spark, sf):
    return _matrix(spark, linalg.matrix_exp(_t2(spark, sf)))


@query("rate_matrix_pseudo", _with(_TWO, _cells("-a / 2", "a / 2", "b / 2", "-b / 2")))
def rate_matrix_pseudo(spark, sf):
    return _matrix(spark, estimation.rate_matrix(_c2(spark, sf), 2.0, "pseudo"))


@query("rate_matrix_logarithm", _with(_TWO, _cells("ln(lam) * p1 / 2", "-ln(lam) * p1 / 2", "-ln(lam) * p0 / 2", "ln(lam) * p0 / 2")))
def rate_matrix_logarithm(spark, sf):
    return _matrix(spark, estimation.truncated_log_generator(_c2(spark, sf), 2.0))


@query("metropolis_chain", _with(f"{EVENTS}, h AS (SELECT state s, -ln(count(*) / (SELECT count(*)::DOUBLE FROM dt)) e FROM dt GROUP BY state), p AS (SELECT a.s i, b.s j, CASE WHEN abs(a.s - b.s) = 1 THEN 0.5 * least(1, exp(a.e - b.e)) ELSE 0 END v FROM h a, h b)", f"SELECT i::BIGINT i, j::BIGINT j, {_round('CASE WHEN i = j THEN 1 - sum(v) OVER (PARTITION BY i) ELSE v END')} v FROM p"))
def metropolis_chain(spark, sf):
    h = counts.count_states(tr.events_dtraj(spark, sf)).orderBy("state").toPandas()["n"].to_numpy(float)
    return _matrix(spark, simulate.tmatrix_metropolis1d(-np.log(h / h.sum())))


# --- linear algebra on moments of a table

_XY = "m AS (SELECT var_samp(l_quantity) a, covar_samp(l_quantity, l_discount * 100) b, var_samp(l_discount * 100) d FROM lineitem), x AS (SELECT *, a * d - b * b det FROM m)"


def _cov2(spark, sf) -> np.ndarray:
    df = tr.lineitem_x(spark, sf).withColumn("x", F.array(F.col("x")[0], F.col("x")[2] * 100))
    return moments.Covariance(remove_data_mean=True).fit(df).cov_00


@query("covariance_inverse", _with(_XY, _cells("d / det", "-b / det", "-b / det", "a / det")))
def covariance_inverse(spark, sf):
    return _matrix(spark, linalg.spd_inv(_cov2(spark, sf)))


@query("covariance_inverse_by_split", _with(_XY, _cells("d / det", "-b / det", "-b / det", "a / det")))
def covariance_inverse_by_split(spark, sf):
    split = linalg.spd_inv_split(_cov2(spark, sf))
    return _matrix(spark, split @ split.T)


@query("covariance_inverse_by_root", _with(_XY, _cells("d / det", "-b / det", "-b / det", "a / det")))
def covariance_inverse_by_root(spark, sf):
    root = linalg.spd_inv_sqrt(_cov2(spark, sf))
    return _matrix(spark, root @ root)


@query("covariance_spectrum", _with(_XY, f"SELECT {_round('(a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2', 5)} lam1, {_round('(a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2', 5)} lam2, {_round('a + d', 5)} schatten FROM x"))
def covariance_spectrum(spark, sf):
    c = _cov2(spark, sf)
    e = linalg.spd_eig(c)[0]
    return _table(spark, [(float(e[0]), float(e[1]), float(linalg.schatten_norm(c, 1)))], "lam1 double, lam2 double, schatten double", 5)


@query("whitening_matrix", _with(_XY, _cells("d / det", "-b / det", "-b / det", "a / det")))
def whitening_matrix(spark, sf):
    """The inverse that whitening by the model multiplies with: of the unit vectors, whitened and multiplied."""
    df = tr.lineitem_x(spark, sf).withColumn("x", F.array(F.col("x")[0], F.col("x")[2] * 100))
    model = moments.Covariance(remove_data_mean=True).fit(df)
    white = model.whiten(np.eye(2)) - model.whiten(np.zeros((2, 2)))
    return _matrix(spark, white @ white.T)


@query("log_sum_of_exponentials", f"WITH {EVENTS}, h AS (SELECT ln(count(*)) v FROM dt GROUP BY state) SELECT {_round('ln(sum(exp(v)))')} v, {_round('sum(v)')} s FROM h")
def log_sum_of_exponentials(spark, sf):
    v = np.log([r["n"] for r in counts.count_states(tr.events_dtraj(spark, sf)).collect()])  # a row for each state
    return _scalar(spark, v=linalg.logsumexp(v), s=linalg.ksum(v))


@query("merged_moments", _with(LINES, f"SELECT {_round('covar_samp(x0, x1)', 3)} a, {_round('var_samp(x0)', 3)} b FROM fx"))
def merged_moments(spark, sf):
    """Moments of two halves of the table, combined."""
    df = tr.lineitem_x(spark, sf).withColumn("x", F.slice("x", 1, 2))
    odd = F.col("traj_id") % 2 == 1
    c = moments.moments(df.where(odd)).combine(moments.moments(df.where(~odd)))
    c = c.mxx / (c.w - 1)
    return _table(spark, [(float(c[0, 1]), float(c[0, 0]))], "a double, b double", 3)


@query("weighted_covariance", "WITH m AS (SELECT sum(l_tax + 0.01) w, sum((l_tax + 0.01) * l_quantity) / sum(l_tax + 0.01) mx, sum((l_tax + 0.01) * l_discount) / sum(l_tax + 0.01) my FROM lineitem) SELECT round(sum((l_tax + 0.01) * (l_quantity - mx) * (l_discount - my)) / any_value(w), 7) + 0.0::DOUBLE v FROM lineitem, m")
def weighted_covariance(spark, sf):
    df = tr.lineitem_x(spark, sf).withColumn("w", F.col("x")[3] + 0.01).withColumn("x", F.array(F.col("x")[0], F.col("x")[2]))
    m = moments.moments(df, "w")
    return _scalar(spark, v=m.mxx[0, 1] / m.w)


# --- one feature: correlations in closed form

_ONE = LINES + ", p1 AS (SELECT x0 x, lead(x0) OVER (PARTITION BY traj_id ORDER BY t) y FROM fx), k AS (SELECT x, y FROM p1 WHERE y IS NOT NULL)"


def _one(spark, sf) -> DataFrame:
    return tr.lineitem_x(spark, sf).withColumn("x", F.slice("x", 1, 1))


@query("vamp_of_one_feature", _with(_ONE, f"SELECT {_round('abs(covar_pop(x, y)) / sqrt(var_pop(x) * var_pop(y))', 6)} s, {_round('1 + covar_pop(x, y) * covar_pop(x, y) / (var_pop(x) * var_pop(y))', 6)} score FROM k"))
def vamp_of_one(spark, sf):
    m = decomposition.VAMP(1).fit(_one(spark, sf))
    return _table(spark, [(float(m.singular_values[0]), float(m.score(2)))], "s double, score double", 6)


@query("dmd_of_one_feature", _with(_ONE, f"SELECT {_round('sum(x * y) / sum(x * x)', 6)} v FROM k"))
def dmd_of_one(spark, sf):
    m = decomposition.DMD().fit(lag.lag_pairs(_one(spark, sf), 1))
    return _table(spark, [(float(np.real(m.eigenvalues[0])),)], "v double", 6)


@query("edmd_of_one_feature", _with(_ONE, f"SELECT {_round('sum(x * y) / sum(x * x)', 6)} v FROM k"))
def edmd_of_one(spark, sf):
    m = decomposition.EDMD(basis.Identity()).fit(lag.lag_pairs(_one(spark, sf), 1))
    return _table(spark, [(float(np.real(m.eigenvalues[0])),)], "v double", 6)


@query("tica_of_one_feature", _with(_ONE + ", s AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k)", f"SELECT {_round('abs(covar_pop(x, y)) / var_pop(x)', 6)} v FROM s"))
def tica_of_one(spark, sf):
    return _table(spark, [(float(np.abs(decomposition.TICA(1).fit(_one(spark, sf)).singular_values[0])),)], "v double", 6)


# --- clustering

_START = ((5.0, 0.02), (25.0, 0.05), (45.0, 0.08))


def _lloyd_sql(rounds: int) -> str:
    first = "c0 AS (SELECT 0::BIGINT k, 5.0::DOUBLE q, 0.02::DOUBLE d UNION ALL SELECT 1, 25.0, 0.05 UNION ALL SELECT 2, 45.0, 0.08)"
    steps = [f"a{r} AS (SELECT l_quantity q, l_discount d, arg_min(c.k, (l_quantity - c.q) * (l_quantity - c.q) + (l_discount - c.d) * (l_discount - c.d)) k FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem), c{r} c GROUP BY 1, 2), "
             f"c{r + 1} AS MATERIALIZED (SELECT k, avg(l_quantity) q, avg(l_discount) d FROM lineitem JOIN a{r} ON q = l_quantity AND d = l_discount GROUP BY k)" for r in range(rounds)]
    return f"WITH {first}, {', '.join(steps)} SELECT k, round(q, 6) + 0.0::DOUBLE c0, round(d, 6) + 0.0::DOUBLE c1 FROM c{rounds}"


@query("kmeans", _lloyd_sql(4))
def kmeans(spark, sf):
    df = tr.lineitem_x(spark, sf).withColumn("x", F.array(F.col("x")[0], F.col("x")[2]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = clustering.KMeans(3, max_iter=4, tolerance=-1.0).fit(df, initial_centers=np.array(_START))
    return _table(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(m.cluster_centers)], "k long, c0 double, c1 double", 6)


@query("cost_with_candidates", f"WITH c AS (SELECT unnest([0, 1])::BIGINT k, unnest([10.0, 33.0])::DOUBLE q) SELECT k, round(sum(least(least((l_quantity - 5) * (l_quantity - 5), (l_quantity - 45) * (l_quantity - 45)), (l_quantity - q) * (l_quantity - q))), 3) + 0.0::DOUBLE cost FROM lineitem, c GROUP BY k")
def cost_with_candidates(spark, sf):
    found = clustering._costs_with(_one(spark, sf), np.array([[5.0], [45.0]]), np.array([[10.0], [33.0]]), "euclidean")
    return _table(spark, list(enumerate(map(float, found))), "k long, cost double", 3)


@query("one_hot_boxes", "SELECT least(greatest(ceil((l_quantity - 1) / (49.0 / 4) - 0.5), 0), 4)::BIGINT p, count(*)::DOUBLE v FROM lineitem GROUP BY 1")
def one_hot_boxes(spark, sf):
    m = clustering.BoxDiscretization(1, [5], [1.0], [50.0]).fit(_one(spark, sf))
    x = m.transform_onehot(_one(spark, sf))
    hot = [c for c, k in x.dtypes if k.startswith("array")][-1]
    return x.select(F.posexplode(hot).alias("p", "v")).groupBy(F.col("p").cast("long").alias("p")).agg(F.sum(F.col("v").cast("double")).alias("v")).where("v > 0")


# --- kernels and bases

_MARKS = ((1.0, 0.0), (3.0, 2.0), (-1.0, 0.5))


def _gram_sql(cell: str) -> str:
    values = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_MARKS))
    return f"WITH m(i, a, b) AS (VALUES {values}), n AS (SELECT count(*) > 0 ok FROM lineitem) SELECT x.i::BIGINT i, y.i::BIGINT j, {_round(cell)} v FROM m x, m y, n WHERE ok"


_D2 = "((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))"


@query("gaussian_gram", _gram_sql(f"exp(-{_D2} / (2 * 1.5 * 1.5))"))
def gaussian_gram(spark, sf):
    return _matrix(spark, basis.GaussianKernel(1.5).gram(np.array(_MARKS)))


@query("generalised_gaussian_gram", _gram_sql("exp(-(x.a - y.a) * (x.a - y.a) / (2 * 1.5 * 1.5) - (x.b - y.b) * (x.b - y.b) / (2 * 0.5 * 0.5))"))
def generalised_gaussian_gram(spark, sf):
    return _matrix(spark, basis.GeneralizedGaussianKernel(np.array([1.5, 0.5])).gram(np.array(_MARKS)))


@query("laplacian_gram", _gram_sql(f"exp(-sqrt({_D2}) / 1.5)"))
def laplacian_gram(spark, sf):
    return _matrix(spark, basis.LaplacianKernel(1.5).gram(np.array(_MARKS)))


@query("polynomial_gram", _gram_sql("(x.a * y.a + x.b * y.b + 1) ^ 3"))
def polynomial_gram(spark, sf):
    return _matrix(spark, basis.PolynomialKernel(3, 1.0).gram(np.array(_MARKS)))


@query("product_gram", _gram_sql(f"exp(-{_D2} / (2 * 1.5 * 1.5)) * (x.a * y.a + x.b * y.b + 1) ^ 2"))
def product_gram(spark, sf):
    return _matrix(spark, basis.ProductKernel(basis.GaussianKernel(1.5), basis.PolynomialKernel(2, 1.0)).gram(np.array(_MARKS)))


# --- hidden Markov recursions with a given model

_A, _P0 = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.5, 0.5])
_B = np.array([[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])
_EMIT = f"{EVENTS}, em(state, b0, b1) AS (VALUES {', '.join(f'({s}, {_B[0, s]}::DOUBLE, {_B[1, s]}::DOUBLE)' for s in range(5))}), ob AS MATERIALIZED (SELECT traj_id, t, dt.state, b0, b1, max(t) OVER (PARTITION BY traj_id) top FROM dt JOIN em ON em.state = dt.state)"
_ALPHA = """, fw(traj_id, t, a0, a1, s) AS (SELECT traj_id, t, 0.5 * b0 / (0.5 * b0 + 0.5 * b1), 0.5 * b1 / (0.5 * b0 + 0.5 * b1), 0.5 * b0 + 0.5 * b1 FROM ob WHERE t = 0 UNION ALL
  SELECT traj_id, t, u0 / (u0 + u1), u1 / (u0 + u1), u0 + u1 FROM (SELECT ob.traj_id, ob.t, (a0 * 0.9 + a1 * 0.2) * b0 u0, (a0 * 0.1 + a1 * 0.8) * b1 u1 FROM fw JOIN ob ON ob.traj_id = fw.traj_id AND ob.t = fw.t + 1))"""
_BETA = """, bw(traj_id, t, c0, c1) AS (SELECT traj_id, t, 0.5::DOUBLE, 0.5::DOUBLE FROM ob WHERE t = top UNION ALL
  SELECT traj_id, t, u0 / (u0 + u1), u1 / (u0 + u1) FROM (SELECT ob.traj_id, ob.t - 1 t, 0.9 * b0 * c0 + 0.1 * b1 * c1 u0, 0.2 * b0 * c0 + 0.8 * b1 * c1 u1 FROM bw JOIN ob ON ob.traj_id = bw.traj_id AND ob.t = bw.t WHERE ob.t > 0))"""
_GAMMA = ", ga AS MATERIALIZED (SELECT fw.traj_id, fw.t, a0 * c0 / (a0 * c0 + a1 * c1) g0 FROM fw JOIN bw ON bw.traj_id = fw.traj_id AND bw.t = fw.t)"
_XI = """, xi AS (SELECT fw.traj_id, fw.t, a0 * 0.9 * b0 * c0 x00, a0 * 0.1 * b1 * c1 x01, a1 * 0.2 * b0 * c0 x10, a1 * 0.8 * b1 * c1 x11 FROM fw JOIN ob ON ob.traj_id = fw.traj_id AND ob.t = fw.t + 1 JOIN bw ON bw.traj_id = ob.traj_id AND bw.t = ob.t),
hc AS (SELECT sum(x00 / (x00 + x01 + x10 + x11)) n00, sum(x01 / (x00 + x01 + x10 + x11)) n01, sum(x10 / (x00 + x01 + x10 + x11)) n10, sum(x11 / (x00 + x01 + x10 + x11)) n11 FROM xi)"""


def _hidden() -> hmm.HiddenMarkovModel:
    return hmm.HiddenMarkovModel(msm.MarkovStateModel(_A), hmm.DiscreteOutputModel(_B), _P0)


@query("hmm_likelihood", _with(_EMIT + _ALPHA, f"SELECT {_round('sum(ln(s))', 4)} ll FROM fw"))
def hmm_likelihood(spark, sf):
    return _table(spark, [(_hidden().compute_observation_likelihood(tr.events_dtraj(spark, sf)),)], "ll double", 4)


@query("hmm_state_probabilities", _with(_EMIT + _ALPHA + _BETA + _GAMMA, f"SELECT traj_id, t, {_round('g0')} g0 FROM ga"))
def hmm_state_probabilities(spark, sf):
    return _hidden().state_probability_table(tr.events_dtraj(spark, sf)).select("traj_id", "t", (F.round(F.col("gamma")[0], PLACES) + F.lit(0.0)).alias("g0"))


@query("hmm_viterbi", _with(_EMIT + """, vi(traj_id, t, v0, v1, k0, k1) AS (SELECT traj_id, t, b0 / (b0 + b1), b1 / (b0 + b1), -1, -1 FROM ob WHERE t = 0 UNION ALL
  SELECT traj_id, t, u0 / (u0 + u1), u1 / (u0 + u1), k0, k1 FROM (SELECT ob.traj_id, ob.t, greatest(v0 * 0.9, v1 * 0.2) * b0 u0, greatest(v0 * 0.1, v1 * 0.8) * b1 u1, CASE WHEN v0 * 0.9 >= v1 * 0.2 THEN 0 ELSE 1 END k0, CASE WHEN v0 * 0.1 >= v1 * 0.8 THEN 0 ELSE 1 END k1 FROM vi JOIN ob ON ob.traj_id = vi.traj_id AND ob.t = vi.t + 1)),
  ve AS MATERIALIZED (SELECT * FROM vi), tp AS (SELECT traj_id, max(t) t FROM ve GROUP BY traj_id),
  ba(traj_id, t, s) AS (SELECT ve.traj_id, ve.t, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END FROM ve JOIN tp ON tp.traj_id = ve.traj_id AND tp.t = ve.t UNION ALL
  SELECT ba.traj_id, ba.t - 1, CASE WHEN ba.s = 0 THEN k0 ELSE k1 END FROM ba JOIN ve ON ve.traj_id = ba.traj_id AND ve.t = ba.t WHERE ba.t > 0)""", "SELECT traj_id, t, s::BIGINT state FROM ba"))
def hmm_viterbi(spark, sf):
    return _hidden().viterbi_paths(tr.events_dtraj(spark, sf)).select("traj_id", "t", F.col("state").cast("long").alias("state"))


@query("hmm_expected_counts", _with(_EMIT + _ALPHA + _BETA + _GAMMA + _XI, f"SELECT unnest([0, 0, 1, 1])::BIGINT i, unnest([0, 1, 0, 1])::BIGINT j, {_round('unnest([n00, n01, n10, n11])', 5)} v FROM hc"))
def hmm_expected_counts(spark, sf):
    _, _, c, _ = hmm.MaximumLikelihoodHMM(_hidden(), 1).expectation(_hidden(), tr.events_dtraj(spark, sf))
    return _table(spark, [(i, j, float(c[i, j])) for i in range(2) for j in range(2)], "i long, j long, v double", 5)


@query("hmm_transition_update", _with(_EMIT + _ALPHA + _BETA + _GAMMA + _XI, f"SELECT unnest([0, 0, 1, 1])::BIGINT i, unnest([0, 1, 0, 1])::BIGINT j, {_round('unnest([n00 / (n00 + n01), n01 / (n00 + n01), n10 / (n10 + n11), n11 / (n10 + n11)])', 6)} v FROM hc"))
def hmm_transition_update(spark, sf):
    m = hmm.MaximumLikelihoodHMM(_hidden(), 1, reversible=False, maxit=1).fit(tr.events_dtraj(spark, sf))
    return _table(spark, [(i, j, float(m.transition_matrix[i, j])) for i in range(2) for j in range(2)], "i long, j long, v double", 6)


@query("hmm_output_probabilities", _with(_EMIT + _ALPHA + _BETA + _GAMMA + ", gs AS (SELECT state, sum(g0) s0, sum(1 - g0) s1 FROM ga JOIN ob ON ob.traj_id = ga.traj_id AND ob.t = ga.t GROUP BY state)", f"SELECT 0::BIGINT hidden, state::BIGINT symbol, {_round('s0 / sum(s0) OVER ()', 6)} p FROM gs UNION ALL SELECT 1, state, {_round('s1 / sum(s1) OVER ()', 6)} FROM gs"))
def hmm_output_probabilities(spark, sf):
    m = hmm.MaximumLikelihoodHMM(_hidden(), 1, maxit=1).fit(tr.events_dtraj(spark, sf))
    return _table(spark, [(i, k, float(v)) for i, r in enumerate(m.output_probabilities) for k, v in enumerate(r)], "hidden long, symbol long, p double", 6)


@query("hmm_collected_observations", _with(SQL["hmm_viterbi"].removeprefix("WITH RECURSIVE ").rpartition(" SELECT traj_id, t, s::BIGINT state FROM ba")[0], "SELECT ob.state::BIGINT symbol, count(*)::BIGINT n FROM ba JOIN ob ON ob.traj_id = ba.traj_id AND ob.t = ba.t WHERE s = 1 GROUP BY ob.state"))
def hmm_collected(spark, sf):
    return _hidden().collect_observations_in_state(tr.events_dtraj(spark, sf), 1).groupBy(F.col("state").cast("long").alias("symbol")).agg(F.count("*").alias("n"))


@query("hmm_stationary_observations", "SELECT state::BIGINT i, round((0.2 * b0 + 0.1 * b1) / 0.3, 7) + 0.0::DOUBLE v FROM em".replace("FROM em", f"FROM (VALUES {', '.join(f'({s}, {_B[0, s]}::DOUBLE, {_B[1, s]}::DOUBLE)' for s in range(5))}) em(state, b0, b1), (SELECT count(*) FROM events)"))
def hmm_stationary_observations(spark, sf):
    return _vector(spark, _hidden().stationary_distribution_obs)


# --- multi-ensemble reweighting

#: Event frames with two thermodynamic states: of even trajectories without bias, of odd ones with value / 50.
_SAMPLES = f"{EVENTS}, sa AS MATERIALIZED (SELECT traj_id, t, traj_id % 2 therm, state, value / 50 b FROM dt)"


def _samples(spark, sf) -> DataFrame:
    d = tr.events_dtraj(spark, sf).join(tr.events_value(spark, sf), ["traj_id", "t"])
    return d.select("traj_id", "t", (F.col("traj_id") % 2).cast("int").alias("therm"), "state", F.array(F.lit(0.0), F.col("x")[0] / 50).alias("bias"), F.floor(F.least(F.col("x")[0] / 25, F.lit(7.0))).cast("int").alias("bin"))


@query("ensemble_transition_counts", _with(_SAMPLES, "SELECT a.therm::BIGINT k, a.state::BIGINT i, b.state::BIGINT j, count(*)::DOUBLE v FROM sa a JOIN sa b ON b.traj_id = a.traj_id AND b.t = a.t + 1 GROUP BY ALL"))
def ensemble_transition_counts(spark, sf):
    c = tram.TRAMDataset(_samples(spark, sf)).transition_counts
    return _table(spark, [(k, i, j, float(c[k, i, j])) for k, i, j in zip(*np.nonzero(c))], "k long, i long, j long, v double")


@query("ensemble_state_counts", _with(_SAMPLES, "SELECT therm::BIGINT i, state::BIGINT j, count(*)::DOUBLE v FROM sa GROUP BY ALL"))
def ensemble_state_counts(spark, sf):
    return _matrix(spark, tram.TRAMDataset(_samples(spark, sf)).state_counts)


@query("ensemble_bias_sums", _with(_SAMPLES, f"SELECT state::BIGINT i, {_round('ln(sum(1 / (exp(0.5 + 0.1 * state) + exp(1 - 0.2 * state - b))))')} v0, {_round('ln(sum(exp(-b) / (exp(0.5 + 0.1 * state) + exp(1 - 0.2 * state - b))))')} v1 FROM sa GROUP BY state"))
def ensemble_bias_sums(spark, sf):
    logs = np.stack([0.5 + 0.1 * np.arange(5), 1 - 0.2 * np.arange(5)])
    out = tram.bias_sums(_samples(spark, sf), logs)
    return _table(spark, [(i, float(out[0, i]), float(out[1, i])) for i in range(5)], "i long, v0 double, v1 double")


@query("mbar_energies", _with(_SAMPLES + ", nn AS (SELECT count(*) FILTER (therm = 0)::DOUBLE n0, count(*) FILTER (therm = 1)::DOUBLE n1 FROM sa), mb(k, f) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT any_value(mb.k) + 1, -ln(sum(exp(-b) / (n0 + n1 * exp(mb.f - b)))) + ln(sum(1 / (n0 + n1 * exp(mb.f - b)))) FROM mb, nn, sa WHERE mb.k < 60 HAVING count(*) > 0)", f"SELECT 0::BIGINT i, 0.0::DOUBLE v UNION ALL SELECT 1, {_round('f', 5)} FROM mb WHERE k = 60"))
def mbar_energies(spark, sf):
    s = _samples(spark, sf).persist()
    f = tram.mbar(s, tram.TRAMDataset(s).state_counts, 60, 1e-9)
    s.unpersist()
    return _table(spark, list(enumerate(map(float, f))), "i long, v double", 5)


def _ensemble() -> tram.TRAMModel:
    logs = np.stack([0.5 + 0.1 * np.arange(5), 1 - 0.2 * np.arange(5)])
    return tram.TRAMModel(np.zeros((2, 5)), np.zeros((2, 5)), logs, np.stack([np.full((5, 5), 0.2)] * 2))


_WEIGHTS = _SAMPLES + ", we AS (SELECT *, 1 / (exp(0.5 + 0.1 * state) + exp(1 - 0.2 * state - b)) w FROM sa)"


@query("ensemble_sample_weights", _with(_WEIGHTS, f"SELECT state::BIGINT i, {_round('sum(w) / (SELECT sum(w) FROM we)')} v FROM we GROUP BY state"))
def ensemble_sample_weights(spark, sf):
    w = _ensemble().sample_weights_log(_samples(spark, sf))
    return w.groupBy(F.col("state").cast("long").alias("i")).agg((F.round(F.sum(F.exp("log_w")), PLACES) + F.lit(0.0)).alias("v"))


@query("ensemble_observable", _with(_WEIGHTS, f"SELECT {_round('sum(w * state) / sum(w)')} v, {_round('sum(w * exp(-b) * state) / sum(w * exp(-b))')} biased FROM we"))
def ensemble_observable(spark, sf):
    s, m = _samples(spark, sf), _ensemble()
    return _scalar(spark, v=m.compute_observable(s, "state"), biased=m.compute_observable(s, "state", 1))


@query("pmf_bins", _with(_WEIGHTS + ", bi AS (SELECT floor(least(b * 2, 7)) p, -ln(sum(w)) e FROM we GROUP BY 1)", f"SELECT p::BIGINT i, {_round('e - min(e) OVER ()')} v FROM bi"))
def pmf_bins(spark, sf):
    return _vector(spark, _ensemble().compute_pmf(_samples(spark, sf), "bin", 8))


@query("ensemble_log_likelihood", _with(_SAMPLES + ", cn AS (SELECT count(*) n FROM sa a JOIN sa b ON b.traj_id = a.traj_id AND b.t = a.t + 1)", f"SELECT {_round('any_value(n) * ln(0.2) - sum(ln(exp(0.5 + 0.1 * state) + exp(1 - 0.2 * state - b)) + therm * b)', 3)} v FROM sa, cn"))
def ensemble_log_likelihood(spark, sf):
    return _table(spark, [(_ensemble().compute_log_likelihood(tram.TRAMDataset(_samples(spark, sf))),)], "v double", 3)


# --- states, statistics, simulators


@query("observations_in_state", _with(EVENTS, "SELECT traj_id, t, value FROM dt WHERE state = 3"))
def observations_in_state(spark, sf):
    return states.observations_in_state(tr.events_dtraj(spark, sf), tr.events_value(spark, sf), 3).select("traj_id", "t", F.col("x")[0].alias("value"))


@query("next_state_sequences", _with(f"{EVENTS}, {_pairs(2)}", "SELECT traj_id, i::BIGINT state, string_agg(j::VARCHAR, '' ORDER BY t) seq, sum((j = 1)::INT)::BIGINT ones FROM pr WHERE j IS NOT NULL GROUP BY traj_id, i"))
def next_state_sequences(spark, sf):
    s = states.indicator(states.next_states(tr.events_dtraj(spark, sf), 2), 1)
    return s.select("traj_id", F.col("state").cast("long").alias("state"), F.array_join(F.transform("seq", lambda v: v.cast("string")), "").alias("seq"), F.aggregate("indicator", F.lit(0), lambda a, v: a + v).cast("long").alias("ones"))


@query("confidence_interval", "WITH o AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) - 1 r, count(*) OVER () n, avg(o_totalprice) OVER () m FROM orders WHERE o_orderkey <= 500), k AS (SELECT min(r) FILTER (v >= m) k, any_value(n) n, any_value(m) m FROM o), c AS (SELECT k.n, k.k - 1 + (k.m - a.v) / (b.v - a.v) c FROM k JOIN o a ON a.r = k.k - 1 JOIN o b ON b.r = k.k), e AS (SELECT c - 0.9 * c lo, c + 0.9 * (n - 1 - c) hi FROM c) SELECT round((SELECT a.v + (e.lo - a.r) * (b.v - a.v) FROM o a JOIN o b ON b.r = a.r + 1 WHERE a.r = floor(e.lo)), 4) + 0.0::DOUBLE lower, round((SELECT a.v + (e.hi - a.r) * (b.v - a.v) FROM o a JOIN o b ON b.r = a.r + 1 WHERE a.r = floor(e.hi)), 4) + 0.0::DOUBLE upper FROM e")
def confidence_interval(spark, sf):
    v = [r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey <= 500").select("o_totalprice").collect()]  # 500 samples are the feature's input
    return _table(spark, [validation.confidence_interval(v, 0.9)], "lower double, upper double", 4)


@query("energy_landscape", "WITH b AS (SELECT least(floor((l_quantity - 1.0) / (49.0 / 5)), 4) bx, least(floor((l_tax - 0.0) / (0.08 / 5)), 4) y, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2) SELECT bx::BIGINT i, y::BIGINT j, round(2 * (ln(max(n) OVER ()) - ln(n)), 7) + 0.0::DOUBLE v FROM b")
def energy_landscape(spark, sf):
    df = tr.lineitem_x(spark, sf).select(F.col("x")[0].alias("x"), F.col("x")[3].alias("y"))
    return _matrix(spark, validation.energy2d(df, 5, 2.0).energies)


@query("trajectory_lengths", _with(ORDERS, "SELECT traj_id, count(*)::BIGINT length FROM dt GROUP BY traj_id"))
def trajectory_lengths(spark, sf):
    found = tr.lengths(tr.orders_dtraj(spark, sf))
    return found.select("traj_id", F.col(found.columns[-1]).cast("long").alias("length"))


@query("drunkards_walk", """WITH g AS (SELECT x.range::INT x, y.range::INT y, (x.range + 7 * y.range)::BIGINT s, (x.range = 0 AND y.range = 0) OR (x.range = 6 AND y.range = 7) e, x.range = 3 AND y.range BETWEEN 2 AND 4 wall, x.range = 5 AND y.range BETWEEN 5 AND 6 slow FROM range(7) x, range(8) y, (SELECT count(*) FROM events)),
p AS (SELECT a.s i, b.s j, CASE WHEN a.s = b.s THEN CASE WHEN a.e OR a.wall THEN 100 ELSE 0 END WHEN b.wall THEN 0 WHEN b.slow THEN 0.25 WHEN a.e AND b.e THEN 100 ELSE 1 END::DOUBLE w FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 7) + 0.0::DOUBLE v FROM p QUALIFY w > 0""")
def drunkards_walk(spark, sf):
    w = simulate.DrunkardsWalk((7, 8), (0, 0), (6, 7))
    w.add_barrier((3, 2), (3, 4))
    w.add_barrier((5, 5), (5, 6), 4.0)
    t = w.transition_matrix
    return _table(spark, [(i, j, float(t[i, j])) for i, j in zip(*np.nonzero(t))], "i long, j long, v double")


@query("birth_death_chain", _with("bd AS (SELECT unnest(range(5))::BIGINT i, unnest([0.0, 0.2, 0.3, 0.1, 0.4])::DOUBLE q, unnest([0.5, 0.3, 0.2, 0.4, 0.0])::DOUBLE p FROM (SELECT count(*) FROM events)), t AS MATERIALIZED (SELECT a.i, b.i j, CASE b.i - a.i WHEN 0 THEN 1 - a.p - a.q WHEN 1 THEN a.p WHEN -1 THEN a.q ELSE 0 END p FROM bd a, bd b), w AS (SELECT i, exp(sum(ln(x)) OVER (ORDER BY i)) w FROM (SELECT a.i, coalesce(b.p / a.q, 1) x FROM bd a LEFT JOIN bd b ON b.i = a.i - 1))" + _FORWARD, f"SELECT w.i, {_round('w / sum(w) OVER ()')} pi, {_round('qp.x')} committor FROM w JOIN qp ON qp.i = w.i"))
def birth_death_chain(spark, sf):
    c = simulate.BirthDeathChain(np.array([0, 0.2, 0.3, 0.1, 0.4]), np.array([0.5, 0.3, 0.2, 0.4, 0]))
    return _table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(c.stationary_distribution, c.committor_forward(0, 4)))], "i long, pi double, committor double")
