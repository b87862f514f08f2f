"""Queries that SQL can express, each with its SQL: counts, pairs, moments, assignments, reweighting, fluxes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagstream.functions import basis
from lagstream.operators import clustering, counts, lag, moments, states, validation
from lagstream.sources import trajectories as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the trajectories.
EVENTS = """
dt AS (SELECT user_id traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 t, dense_rank() OVER (ORDER BY event_type) - 1 state, value, event_id FROM events)"""
ORDERS = """
dt AS (SELECT o_custkey traj_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 t, dense_rank() OVER (ORDER BY o_orderpriority) - 1 state, o_totalprice value FROM orders)"""
CONVERSATIONS = """
dt AS (SELECT conv_id traj_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 t, dense_rank() OVER (ORDER BY role) - 1 state FROM conversations)"""
LINES = """
fx AS (SELECT l_suppkey traj_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 t, l_quantity x0, l_extendedprice x1, l_discount x2, l_tax x3 FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _pairs(k: int) -> str:
    return f"pr AS (SELECT traj_id, t, state i, lead(state, {k}) OVER (PARTITION BY traj_id ORDER BY t) j FROM dt)"


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long" if c != "v" and c != "p" else "double") for c in df.columns))


@query("count_states", f"WITH {EVENTS} SELECT state::BIGINT state, count(*)::BIGINT n FROM dt GROUP BY state")
def count_states(spark, sf):
    return counts.count_states(tr.events_dtraj(spark, sf)).select(F.col("state").cast("long"), "n")


@query("visited_set", f"WITH {ORDERS} SELECT DISTINCT state::BIGINT state FROM dt")
def visited_set(spark, sf):
    return counts.visited_set(tr.orders_dtraj(spark, sf)).select(F.col("state").cast("long"))


@query("transition_counts_sliding", f"WITH {EVENTS}, {_pairs(3)} SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j")
def counts_sliding(spark, sf):
    return _long(counts.count_matrix(tr.events_dtraj(spark, sf), 3))


@query("transition_counts_by_join", f"WITH {EVENTS}, {_pairs(2)} SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j")
def counts_by_join(spark, sf):
    return _long(counts.count_matrix(tr.events_dtraj(spark, sf), 2, by_join=True))


@query("transition_counts_sample", f"WITH {EVENTS}, {_pairs(3)} SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL AND t % 3 = 0 GROUP BY i, j")
def counts_sample(spark, sf):
    return _long(counts.count_matrix(tr.events_dtraj(spark, sf), 3, "sample"))


@query("transition_counts_sliding_effective", f"WITH {ORDERS}, {_pairs(2)} SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE / 2 v FROM pr WHERE j IS NOT NULL GROUP BY i, j")
def counts_sliding_effective(spark, sf):
    return _long(counts.count_matrix(tr.orders_dtraj(spark, sf), 2, "sliding-effective"))


@query("transition_counts_short_trajectories", f"WITH {CONVERSATIONS}, {_pairs(2)} SELECT i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j")
def counts_short(spark, sf):
    return _long(counts.count_matrix(tr.conversations_dtraj(spark, sf), 2))


@query("transition_counts_many_lags", f"WITH {EVENTS}, " + ", ".join(f"p{k} AS (SELECT {k} lag, state i, lead(state, {k}) OVER (PARTITION BY traj_id ORDER BY t) j FROM dt)" for k in (1, 2, 5))
       + " SELECT lag::BIGINT lag, i::BIGINT i, j::BIGINT j, count(*)::DOUBLE v FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p5) WHERE j IS NOT NULL GROUP BY ALL")
def counts_many(spark, sf):
    return _long(counts.count_matrices(tr.events_dtraj(spark, sf), [1, 2, 5]))


@query("twostep_counts", f"WITH {EVENTS}, p AS (SELECT state i, lead(state, 1) OVER w k, lead(state, 2) OVER w j FROM dt WINDOW w AS (PARTITION BY traj_id ORDER BY t)) SELECT i::BIGINT i, k::BIGINT k, j::BIGINT j, count(*)::DOUBLE v FROM p WHERE j IS NOT NULL GROUP BY i, k, j")
def twostep(spark, sf):
    return _long(counts.twostep_counts(tr.events_dtraj(spark, sf), 1))


@query("path_reweighted_counts", f"WITH {EVENTS}, p AS (SELECT state i, lead(state, 2) OVER w j, (1 + state * 0.5) * exp(-sum(value / 1000) OVER (PARTITION BY traj_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) g FROM dt WINDOW w AS (PARTITION BY traj_id ORDER BY t)) SELECT i::BIGINT i, j::BIGINT j, round(sum(g), 6) v FROM p WHERE j IS NOT NULL GROUP BY i, j")
def reweighted(spark, sf):
    both = tr.events_dtraj(spark, sf).join(tr.events_value(spark, sf), ["traj_id", "t"])
    both = both.select("traj_id", "t", "state", (1 + F.col("state") * 0.5).alias("g"), (F.col("x")[0] / 1000).alias("m"))
    return _long(counts.reweighted_count_matrix(both, 2).withColumn("v", F.round("v", 6)))


@query("transition_matrix_nonreversible", f"WITH {EVENTS}, {_pairs(1)}, c AS (SELECT i, j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j) SELECT i::BIGINT i, j::BIGINT j, round(v / sum(v) OVER (PARTITION BY i), 10) p FROM c")
def transition_matrix(spark, sf):
    return _long(counts.transition_matrix_sql(counts.count_matrix(tr.events_dtraj(spark, sf), 1)).withColumn("p", F.round("p", 10)))


@query("log_likelihood", f"WITH {EVENTS}, {_pairs(1)}, c AS (SELECT i, j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j), m AS (SELECT v, v / sum(v) OVER (PARTITION BY i) p FROM c) SELECT round(sum(v * ln(p)), 4) ll FROM m")
def log_likelihood(spark, sf):
    c = counts.count_matrix(tr.events_dtraj(spark, sf), 1)
    return c.join(counts.transition_matrix_sql(c), ["i", "j"]).agg(F.round(F.sum(F.col("v") * F.log("p")), 4).alias("ll"))


@query("lag_pairs", f"WITH {ORDERS}, p AS (SELECT traj_id, t, value x, lead(value, 2) OVER (PARTITION BY traj_id ORDER BY t) y FROM dt) SELECT traj_id, t, x, y FROM p WHERE y IS NOT NULL")
def lag_pairs(spark, sf):
    return lag.lag_pairs(tr.orders_value(spark, sf), 2).select("traj_id", "t", F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))


@query("too_short_trajectories", f"WITH {CONVERSATIONS} SELECT traj_id, count(*)::BIGINT length FROM dt GROUP BY traj_id HAVING count(*) <= 3")
def too_short(spark, sf):
    return lag.too_short(tr.conversations_dtraj(spark, sf), 3)


@query("lag_observations", f"WITH {ORDERS}, s AS (SELECT traj_id, state, t, sh FROM dt, (SELECT unnest([0, 2]) sh) WHERE t >= sh AND (t - sh) % 4 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY traj_id, sh) n FROM s) SELECT traj_id source_id, ((t - sh) // 4)::BIGINT t, state::BIGINT state FROM n WHERE n > 1")
def lag_observations(spark, sf):
    return lag.lag_observations(tr.orders_dtraj(spark, sf), 4, 2).select("source_id", F.col("t").cast("long"), F.col("state").cast("long"))


@query("sliding_window_mean", f"WITH {ORDERS} SELECT traj_id, t, round(avg(value) OVER (PARTITION BY traj_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) m FROM dt")
def sliding_window(spark, sf):
    df = tr.orders_value(spark, sf).select("traj_id", "t", F.col("x")[0].alias("value"))
    w = lag.sliding_window(df, 1, "value")
    return w.select("traj_id", "t", F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + v) / F.size("window"), 6).alias("m"))


@query("timeshifted_chunks", f"WITH {ORDERS}, p AS (SELECT traj_id, t, lead(value, 1) OVER (PARTITION BY traj_id ORDER BY t) y FROM dt), q AS (SELECT *, (row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1) // 3 chunk FROM p WHERE y IS NOT NULL) SELECT traj_id, chunk::BIGINT chunk, count(*)::BIGINT n, round(sum(y), 4) s FROM q GROUP BY traj_id, chunk")
def chunks(spark, sf):
    c = lag.timeshifted_split(tr.orders_value(spark, sf), 1, 3)
    return c.groupBy("traj_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("y")[0]), 4).alias("s"))


@query("submodel_relabel", f"WITH {EVENTS} SELECT CASE state WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE -1 END::BIGINT state, count(*)::BIGINT n FROM dt GROUP BY 1")
def relabel(spark, sf):
    return states.map_to_symbols(tr.events_dtraj(spark, sf), [1, 3]).groupBy(F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


@query("state_feature_means", f"WITH {EVENTS} SELECT state::BIGINT state, round(avg(value), 8) mean FROM dt GROUP BY state")
def state_means(spark, sf):
    return states.state_means(tr.events_dtraj(spark, sf), tr.events_value(spark, sf)).select(F.col("state").cast("long"), F.round("mean", 8).alias("mean"))


@query("index_states", f"WITH {EVENTS} SELECT state::BIGINT state, traj_id, t FROM dt WHERE state IN (0, 2)")
def index_states(spark, sf):
    return states.index_states(tr.events_dtraj(spark, sf), [0, 2]).select(F.col("state").cast("long"), "traj_id", "t")


@query("variable_columns", "WITH s AS (SELECT unnest([0, 1, 2, 3]) p, unnest([max(l_quantity) - min(l_quantity), max(l_extendedprice) - min(l_extendedprice), max(l_discount) - min(l_discount), max(l_tax) - min(l_tax)]) r FROM lineitem) SELECT p::BIGINT p, r > 0.09 varies FROM s")
def variable_columns(spark, sf):
    mask = states.variable_columns(tr.lineitem_x(spark, sf), 0.09)
    return spark.createDataFrame([(i, bool(v)) for i, v in enumerate(mask)], "p long, varies boolean")


@query("second_moments", f"WITH {LINES} SELECT p::BIGINT p, q::BIGINT q, round(v, 1) v FROM (SELECT unnest({[p for p in range(4) for q in range(4)]}) p, unnest({[q for p in range(4) for q in range(4)]}) q, unnest([{', '.join(f'avg(x{p} * x{q})' for p in range(4) for q in range(4))}]) v FROM fx)")
def second_moments(spark, sf):
    m = moments.moments(tr.lineitem_x(spark, sf))
    c = m.raw("mxx") / m.w
    return spark.createDataFrame([(p, q, float(c[p, q])) for p in range(4) for q in range(4)], "p long, q long, v double").withColumn("v", F.round("v", 1))


@query("lagged_moments_sql", f"WITH {LINES}, pr AS (SELECT x0, x1, lead(x0, 1) OVER w y0, lead(x1, 1) OVER w y1 FROM fx WINDOW w AS (PARTITION BY traj_id ORDER BY t)), k AS (SELECT * FROM pr WHERE y0 IS NOT NULL) SELECT block, p::BIGINT p, q::BIGINT q, round(v, 3) v FROM (SELECT unnest(['c0t', 'c0t', 'c0t', 'c0t', 'mean0', 'mean0', 'meant', 'meant']) block, unnest([0, 0, 1, 1, 0, 1, 0, 1]) p, unnest([0, 1, 0, 1, -1, -1, -1, -1]) q, unnest([avg(x0 * y0), avg(x0 * y1), avg(x1 * y0), avg(x1 * y1), avg(x0), avg(x1), avg(y0), avg(y1)]) v FROM k)")
def lagged_moments(spark, sf):
    pairs = lag.lag_pairs(tr.lineitem_x(spark, sf).withColumn("x", F.slice("x", 1, 2)), 1)
    m = moments.moments_sql(pairs, ("c0t", "mean0", "meant"), dim=2)
    return m.select("block", F.col("p").cast("long"), F.col("q").cast("long"), F.round("v", 3).alias("v"))


@query("covariance_centred", f"WITH {LINES} SELECT 0::BIGINT p, 1::BIGINT q, round(covar_samp(x0, x1), 4) v FROM fx UNION ALL SELECT 0, 0, round(var_samp(x0), 4) FROM fx UNION ALL SELECT 2, 3, round(covar_samp(x2, x3), 4) FROM fx")
def covariance(spark, sf):
    c = moments.Covariance(remove_data_mean=True).fit(tr.lineitem_x(spark, sf)).cov_00
    return spark.createDataFrame([(p, q, float(c[p, q])) for p, q in ((0, 1), (0, 0), (2, 3))], "p long, q long, v double").withColumn("v", F.round("v", 4))


@query("covariance_reversible", f"WITH {LINES}, pr AS (SELECT x0, lead(x0, 1) OVER (PARTITION BY traj_id ORDER BY t) y0 FROM fx), k AS (SELECT * FROM pr WHERE y0 IS NOT NULL), m AS (SELECT (avg(x0) + avg(y0)) / 2 m FROM k) SELECT round((avg(x0 * x0) + avg(y0 * y0)) / 2 - any_value(m.m) ^ 2, 6) c00, round(avg(x0 * y0) - any_value(m.m) ^ 2, 6) c0t FROM k, m")
def covariance_reversible(spark, sf):
    df = tr.lineitem_x(spark, sf).withColumn("x", F.slice("x", 1, 1))
    c = moments.Covariance(1, True, True, remove_data_mean=True, reversible=True, bessels_correction=False).fit(df)
    return spark.createDataFrame([(float(c.cov_00[0, 0]), float(c.cov_0t[0, 0]))], "c00 double, c0t double").select(F.round("c00", 6).alias("c00"), F.round("c0t", 6).alias("c0t"))


_CENTRES = ((5.0, 0.02), (25.0, 0.05), (45.0, 0.08))
_D2 = ", ".join(f"(l_quantity - {a}) * (l_quantity - {a}) + (l_discount - {b}) * (l_discount - {b})" for a, b in _CENTRES)


def _two(spark, sf):
    return tr.lineitem_x(spark, sf).withColumn("x", F.array(F.col("x")[0], F.col("x")[2]))


@query("assign_to_centres", f"SELECT (list_position([{_D2}], least({_D2})) - 1)::BIGINT state, count(*)::BIGINT n FROM lineitem GROUP BY 1")
def assign_centres(spark, sf):
    return clustering.assign(_two(spark, sf), np.array(_CENTRES)).groupBy(F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


@query("kmeans_cost", f"SELECT round(sum(least({_D2})), 2) cost FROM lineitem")
def kmeans_cost(spark, sf):
    return clustering.assign_sql(_two(spark, sf), np.array(_CENTRES)).agg(F.round(F.sum("d2"), 2).alias("cost"))


@query("lloyd_step", f"WITH a AS (SELECT list_position([{_D2}], least({_D2})) - 1 k, l_quantity q, l_discount d FROM lineitem) SELECT k::BIGINT k, round(avg(q), 6) c0, round(avg(d), 6) c1 FROM a GROUP BY k")
def lloyd_step(spark, sf):
    c = clustering.lloyd_step(_two(spark, sf), np.array(_CENTRES))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "k long, c0 double, c1 double").select("k", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


@query("box_discretization", "WITH b AS (SELECT least(greatest(ceil((l_quantity - 1) / (49.0 / 4) - 0.5), 0), 4) + 5 * least(greatest(ceil((l_discount - 0.0) / (0.1 / 2) - 0.5), 0), 2) state FROM lineitem) SELECT state::BIGINT state, count(*)::BIGINT n FROM b GROUP BY 1")
def boxes(spark, sf):
    m = clustering.BoxDiscretization(2, [5, 3], [1.0, 0.0], [50.0, 0.1]).fit(_two(spark, sf))
    return m.transform(_two(spark, sf)).groupBy(F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


@query("one_hot_sums", f"WITH {EVENTS} SELECT state::BIGINT p, count(*)::DOUBLE v FROM dt GROUP BY state")
def one_hot(spark, sf):
    x = tr.events_dtraj(spark, sf).select(F.posexplode(basis.one_hot(5)).alias("p", "v"))
    return x.groupBy(F.col("p").cast("long").alias("p")).agg(F.sum("v").alias("v"))


@query("monomials", f"WITH {LINES} SELECT round(sum(x0 * x0), 3) a, round(sum(x0 * x2), 3) b, round(sum(x2 * x2), 3) c, round(sum(x0), 3) d FROM fx")
def monomials(spark, sf):
    m = basis.Monomials(2, 2)
    at = {n: i for i, n in enumerate(m.names())}
    x = _two(spark, sf).select(m.column().alias("m"))
    return x.agg(*(F.round(F.sum(F.col("m")[at[n]]), 3).alias(a) for n, a in (("x0^2", "a"), ("x0 x1", "b"), ("x1^2", "c"), ("x0", "d"))))


@query("finite_differences", f"WITH {ORDERS}, d AS (SELECT traj_id, t, (lead(value) OVER w - lag(value) OVER w) / 2 dx FROM dt WINDOW w AS (PARTITION BY traj_id ORDER BY t)) SELECT traj_id, t, round(dx, 6) dx FROM d WHERE dx IS NOT NULL")
def finite_differences(spark, sf):
    from lagstream.operators.decomposition import derivatives

    ends = F.max("t").over(Window.partitionBy("traj_id"))
    d = derivatives(tr.orders_value(spark, sf)).withColumn("top", ends).where("t > 0 and t < top")
    return d.select("traj_id", "t", F.round(F.col("dx")[0], 6).alias("dx"))


@query("kernel_landmarks", f"WITH {LINES}, l AS (SELECT x0 a, x2 b FROM fx WHERE traj_id = 1 AND t < 5) SELECT round(sum(exp(-((x0 - a) * (x0 - a) + (x2 - b) * (x2 - b)) / 200)), 4) g FROM fx, l")
def kernel_landmarks(spark, sf):
    """Kernel sums of all frames against five landmarks, a bounded set."""
    df = _two(spark, sf)
    marks = [r["x"] for r in df.where("traj_id = 1 and t < 5").orderBy("t").collect()]
    d2 = lambda c: sum((F.col("x")[i] - float(v)) * (F.col("x")[i] - float(v)) for i, v in enumerate(c))
    total = sum((F.exp(-d2(c) / 200) for c in marks), F.lit(0.0))
    return df.agg(F.round(F.sum(total), 4).alias("g"))


@query("trajectory_weights", f"WITH {EVENTS}, h AS (SELECT state, count(*)::DOUBLE n FROM dt GROUP BY state) SELECT state::BIGINT state, round((0.2 / n) * 1e6, 6) w FROM h")
def trajectory_weights(spark, sf):
    from lagstream.operators.msm import MarkovStateModel

    m = MarkovStateModel(np.full((5, 5), 0.2), np.full(5, 0.2))
    w = m.compute_trajectory_weights(tr.events_dtraj(spark, sf))
    return w.groupBy(F.col("state").cast("long").alias("state")).agg(F.round(F.max("w") * 1e6, 6).alias("w"))


@query("histogram2d", "WITH b AS (SELECT least(floor((l_quantity - 1.0) / (49.0 / 7)), 6) bx, least(floor((l_tax - 0.0) / (0.08 / 7)), 6) by_ FROM lineitem) SELECT bx::BIGINT bx, by_::BIGINT AS by, count(*)::DOUBLE n FROM b GROUP BY 1, 2")
def histogram2d(spark, sf):
    df = tr.lineitem_x(spark, sf).select(F.col("x")[0].alias("x"), F.col("x")[3].alias("y"))
    h = validation.histogram2d(df, 7, (1.0, 50.0, 0.0, 0.08))
    return h.select(F.col("bx").cast("long"), F.col("by").cast("long"), "n")


@query("fragments", f"WITH {EVENTS}, k AS (SELECT * FROM dt WHERE state <> 2), m AS (SELECT traj_id, t, state, CASE WHEN lag(t) OVER w = t - 1 THEN 0 ELSE 1 END nw FROM k WINDOW w AS (PARTITION BY traj_id ORDER BY t)), f AS (SELECT traj_id, sum(nw) OVER (PARTITION BY traj_id ORDER BY t) fr FROM m) SELECT traj_id source_id, count(DISTINCT fr)::BIGINT n FROM f GROUP BY traj_id")
def fragments(spark, sf):
    d = tr.events_dtraj(spark, sf).withColumn("state", F.when(F.col("state") == 2, -1).otherwise(F.col("state"))).withColumn("therm", F.lit(0))
    return lag.fragments(d).groupBy("source_id").agg(F.count_distinct("traj_id").alias("n"))


@query("stationary_expected_counts", f"WITH {EVENTS}, {_pairs(1)}, c AS (SELECT i, j, count(*)::DOUBLE v FROM pr WHERE j IS NOT NULL GROUP BY i, j), s AS (SELECT a.i, a.j, a.v + coalesce(b.v, 0) x FROM c a LEFT JOIN c b ON a.i = b.j AND a.j = b.i) SELECT i::BIGINT i, j::BIGINT j, round(100 * x / sum(x) OVER (), 8) v FROM s")
def expected_counts(spark, sf):
    from lagstream.functions import analysis

    c = counts.to_matrix(counts.count_matrix(tr.events_dtraj(spark, sf), 1), 5)
    x = c + c.T
    t = x / x.sum(1, keepdims=True)
    e = analysis.expected_counts_stationary(t, 100, x.sum(1) / x.sum())
    rows = [(i, j, float(e[i, j])) for i in range(5) for j in range(5) if c[i, j] > 0]
    return spark.createDataFrame(rows, "i long, j long, v double").withColumn("v", F.round("v", 8))
