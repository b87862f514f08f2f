"""Operator 6, near-duplicate embeddings by a forest of random projection trees with spill.

Trees split recursively at the median of a random direction, fitted on a bounded sample; every vector is routed
down every tree, into both children wherever it lies near a split, however often. A node that most of its sample
lies near the split of is not split, so a dense cluster stays whole. Vectors are compared within leaves, blockwise,
in double precision. A pair that several leaves bring together is counted in the first of them only, so links
are counted in place and never listed; what leaves a leaf is a count for each vector and a spanning forest of
its links. Leaves of more than BLOCK vectors are compared as pairs of blocks, by as many tasks.

Equal usable vectors of one label are one class with a multiplicity before anything is compared. Vectors of different
lengths are never compared: the length is part of the label, and where lengths differ, shorter ones are filled up
with zeros, which changes no cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.llm.common import Stages, components, read_table

TREES = 4
#: Vectors that the trees are fitted on at most.
SAMPLE = 20_000
#: Vectors a leaf should have, and the rows of a block.
LEAF, BLOCK = 48, 2048
#: Random directions of each tree and level, from which each node draws its own.
DIRECTIONS = 8
#: A node is a leaf where more than this share of its sample lies near the split: both children together would have
#: more pairs than the node, 2 ((1 + share) / 2)^2 > 1.
CROWDED = math.sqrt(2) - 1


class Forest:
    """A random direction for each node, of the DIRECTIONS of its tree and level, and thresholds for each node (medians
    of the sample; below 8 sample vectors, its mean on that direction at the node above; not a number where the node
    is a leaf). The root is node 1, the children of node i are 2 i and 2 i + 1."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, margin: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.depth, self.margin = depth, margin
        self.directions = rng.standard_normal((trees, d, max(depth, 1) * DIRECTIONS))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.thresholds = []
        for t in range(trees):
            x = sample @ self.directions[t]
            node, cuts, above = np.zeros(len(x), np.int64), [], np.zeros(1)
            for level in range(depth):
                # a leaf stays one; below a node of few samples a split goes through the middle of all of them
                column = self._column(np.arange(1 << level) + (1 << level), level)
                middle = np.median(x, axis=0)[column] if len(x) else np.zeros(1 << level)
                cut = np.where(np.isnan(np.repeat(above, 2)), math.nan, middle) if level else middle
                order = np.argsort(node, kind="stable")
                at = np.searchsorted(node[order], np.arange(len(cut) + 1))
                for i in np.flatnonzero(np.diff(at) >= 8):
                    own = x[order[at[i]:at[i + 1]], column[i]]
                    cut[i] = np.median(own)
                    if (np.abs(own - cut[i]) < margin).mean() > CROWDED:
                        cut[i] = math.nan
                cuts.append(cut)
                above = cut
                split = ~np.isnan(cut[node])
                x, node = x[split], node[split]
                node = node * 2 + (x[np.arange(len(x)), column[node]] > cut[node])
            self.thresholds.append(cuts)

    @staticmethod
    def _column(node: np.ndarray, level: int) -> np.ndarray:
        """The direction that nodes of a level draw."""
        mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return (mixed % np.uint64(DIRECTIONS)).astype(np.int64) + level * DIRECTIONS

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of unit vectors."""
        z = x @ self.directions[tree]
        row, node, ends = np.arange(len(x)), np.ones(len(x), np.int64), []
        for level in range(self.depth):
            gap = z[row, self._column(node, level)] - self.thresholds[tree][level][node - (1 << level)]
            leaf = np.isnan(gap)
            ends.append((row[leaf], node[leaf]))
            row, node, gap = row[~leaf], node[~leaf] * 2 + (gap[~leaf] > 0), gap[~leaf]
            near = np.abs(gap) < self.margin
            row, node = np.append(row, row[near]), np.append(node, node[near] ^ 1)
        ends.append((row, node))
        return np.concatenate([r for r, _ in ends]), np.concatenate([n for _, n in ends])


def _place(tree: int, leaf: np.ndarray | int) -> np.ndarray | int:
    """One number for a leaf of a tree, ascending by tree."""
    return leaf + (tree << 48)


def _unit(batch: pa.Array, d: int) -> np.ndarray:
    """Unit vectors (rows x d) of a list column of usable vectors; shorter ones are filled up with zeros."""
    lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(batch), d))
    x[np.arange(d) < lengths[:, None]] = batch.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(1, keepdims=True, initial=0.0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _meet(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether lists of places (each without repeats) share one: len(a) x len(b)."""
    one, two = np.concatenate(a), np.concatenate(b)
    row, row2 = (np.repeat(np.arange(len(lists)), [len(x) for x in lists]) for lists in (a, b))
    both, met = np.intersect1d(one, two), np.zeros((len(a), len(b)), bool)

    def holds(places: np.ndarray, rows: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(some, places), len(some) - 1)
        has = some[at] == places
        out = np.zeros((n, len(some)), np.float32)
        out[rows[has], at[has]] = 1
        return out

    for lo in range(0, len(both), 1024):
        some = both[lo:lo + 1024]
        met |= holds(one, row, len(a), some) @ holds(two, row2, len(b), some).T > 0
    return met


def compare(left: pd.DataFrame, right: pd.DataFrame | None, tree: int, least: float, leaf: int | None = None) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """Links within left, or between left and right: each vector's multiplicity-weighted count, and spanning edges.

    Rows have id, mult, x (float vectors) and leaves (places in all trees up to this one). A pair counts here
    if it shares no leaf of an earlier tree and this leaf is the first it shares in this one (leaf None: always)."""
    here = None if leaf is None else _place(tree, leaf)

    def arrays(part: pd.DataFrame):
        x = np.array(part["x"].tolist(), np.float64)  # of one length, which the label tells
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1))[:, None]
        early = None if leaf is None else [p[p < here] for p in map(np.asarray, part["leaves"])]
        return part["id"].to_numpy(), part["mult"].to_numpy(), x, early

    ids, mult, x, early = arrays(left)
    ids2, mult2, x2, early2 = (ids, mult, x, early) if right is None else arrays(right)
    n = len(ids)
    count, count2 = np.zeros(n, np.int64), np.zeros(len(ids2), np.int64)
    parent: dict[int, int] = {}
    edges: set[tuple[int, int]] = set()

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    for lo in range(0, n, 256):
        hit = x[lo:lo + 256] @ x2.T >= least
        if right is None:
            hit &= np.arange(lo, min(n, lo + 256))[:, None] < np.arange(n)[None, :]
        i, j = np.nonzero(hit)
        i += lo
        if leaf is not None and len(i):
            rows, at = np.unique(i, return_inverse=True)
            rows2, at2 = np.unique(j, return_inverse=True)
            fresh = ~_meet([early[k] for k in rows], [early2[k] for k in rows2])[at, at2]
            i, j = i[fresh], j[fresh]
        np.add.at(count, i, mult2[j])
        np.add.at(count2, j, mult[i])
        # one edge for each pair of trees that join
        for a, b in zip(ids[i].tolist(), ids2[j].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                edges.add((a, b))
    total: dict[int, int] = {}
    for who, c in ((ids, count), (ids2, count2)):
        for k in np.flatnonzero(c):
            total[int(who[k])] = total.get(int(who[k]), 0) + int(c[k])
    return total, edges


def near_vectors(vectors: DataFrame, least: float = 0.98, trees: int = TREES, id_col: str = "vec_id", x_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine >= least between vectors of one label: id, n_links, component_id, kept for each row.

    Compared in double precision, so no pair below least is linked; a pair at the threshold is missed where all
    trees part it, by the spill margin about one in 10,000 pairs or fewer. Vectors that are null, empty, zero, or hold null
    or non-finite components, null labels and null ids link with nothing; vectors of different lengths neither. n_links counts other
    rows; equal vectors count each other, as do rows of one id, each with its own vector. component_id is the
    smallest id reachable; kept marks rows that have it (and rows of null id, which have none). An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "rpforest")
    single = vectors.schema[x_col].dataType.simpleString() == "array<float>"  # kept as they are; compared in double all the same
    number, arrow = ("float", pa.float32()) if single else ("double", pa.float64())
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(x_col).cast(f"array<{number}>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("x", lambda v: v != 0), F.lit(False))
    source = source.withColumn("some", usable).withColumn("label", F.concat_ws(":", F.size("x"), "label"))
    # equal vectors of a label by their bytes; a class may have most rows, so its smallest id comes by a partial aggregate
    digests = F.xxhash64("label", "x").alias("key"), F.hash("x", "label").alias("key2")
    keyed = stages.put(source.select("id", "label", *digests, "some"), "keys")
    classes = keyed.where("some").groupBy("label", "key", "key2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    # a class is a node with a number of its own: one id may have several vectors
    classes = stages.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    first = source.where("some").select("id", F.col("label").alias("label"), *digests, "x")
    reps = first.join(classes.select(F.col("rep").alias("id"), "key", "key2", "mult", "node"), ["id", "key", "key2"]).dropDuplicates(["node"])
    reps = stages.put(reps.select(F.col("node").alias("id"), "label", "mult", "x"), "reps")
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width = reps.agg(F.max(F.size("x"))).first()[0] or 0
    sample = reps.select("x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("x")
    points = _unit(sample.combine_chunks() if sample.num_chunks else pa.array([], sample.type), width)
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    margin = 0.8 * math.sqrt(2 * max(0.0, 1 - least) / max(1, width))
    forest = spark.sparkContext.broadcast(Forest(points, trees, depth, margin))

    schema = pa.schema([("label", pa.string()), ("leaf", pa.int64()), ("id", pa.int64()), ("mult", pa.int64()), ("x", pa.list_(arrow)), ("leaves", pa.list_(pa.int64()))])

    def in_tree(tree: int) -> DataFrame:
        """(a, b, n) of one tree: counts of a vector a (b = -1), and spanning edges (n = 0)."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    x = _unit(part.column("x"), width)
                    found = [forest.value.leaves(x, t) for t in range(tree + 1)]
                    row, place = np.concatenate([r for r, _ in found]), np.concatenate([_place(t, leaf) for t, (_, leaf) in enumerate(found)])
                    by = np.lexsort((place, row))
                    places, at = place[by], np.searchsorted(row[by], np.arange(len(x) + 1))
                    row, leaf = found[tree]
                    for a in range(0, len(row), 20_000):
                        r = row[a:a + 20_000]
                        take, many = pa.array(r), at[r + 1] - at[r]
                        ends = np.append(0, np.cumsum(many))
                        leaves = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places[np.arange(ends[-1]) + np.repeat(at[r] - ends[:-1], many)]))
                        yield pa.RecordBatch.from_arrays([part.column("label").take(take), pa.array(leaf[a:a + 20_000]), part.column("id").take(take), part.column("mult").take(take), part.column("x").take(take), leaves], schema=schema)

        def compared(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            if key[2] == key[3]:
                count, edges = compare(part, None, tree, least, int(key[1]))
            else:
                one, two = part[part["own"] == key[2]], part[part["own"] == key[3]]
                count, edges = compare(one, two, tree, least, int(key[1])) if len(one) and len(two) else ({}, set())
            rows = [(i, -1, c) for i, c in count.items()] + [(a, b, 0) for a, b in edges]
            return pd.DataFrame(rows, columns=["a", "b", "n"]).astype("int64")

        routed = stages.put(reps.select("label", "id", "mult", "x").mapInArrow(route, f"label string, leaf long, id long, mult long, x array<{number}>, leaves array<long>"), f"tree{tree}")
        # a leaf's blocks, by its size; block pairs of large leaves go to tasks of their own
        sizes = routed.groupBy("label", "leaf").count().where("count > 1").select(F.col("label").alias("l"), F.col("leaf").alias("f"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        dealt = routed.join(sizes, (F.col("label") == F.col("l")) & (F.col("leaf") == F.col("f"))).drop("l", "f")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
        found = stages.put(dealt.groupBy("label", "leaf", "b1", "b2").applyInPandas(compared, "a long, b long, n long"), f"found{tree}")
        stages.drop(routed)
        return found

    # one tree after another, so that one tree's copies of the vectors are on disk at a time
    found = in_tree(0)
    for tree in range(1, trees):
        found = found.unionByName(in_tree(tree))
    parts = components(found.where("n = 0").select("a", "b"), stages)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    nodes = (classes.join(counts.select(F.col("a").alias("node"), "n"), "node", "left").join(parts, "node", "left")
             .select("*", F.coalesce("component", "node").alias("group")))
    least_id = nodes.groupBy(F.col("group").alias("g")).agg(F.min("rep").alias("component_id"))
    facts = nodes.join(least_id, F.xxhash64("group") == F.xxhash64("g")).where("group = g")
    facts = stages.put(facts.select(F.col("label").alias("l"), F.col("key").alias("k"), F.col("key2").alias("k2"),
                                    (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id"), "facts")
    out = keyed.join(facts, F.col("some") & (F.xxhash64("key") == F.xxhash64("k")) & (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")), "left")
    component = F.coalesce("component_id", "id")
    return stages.finish(out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole `embeddings` at cosine 0.98: vec_id, n_links, component_id, kept."""
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda e: CASE WHEN e IS NULL OR NOT isfinite(e) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) > 0),
e AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) b FROM r GROUP BY a),
n AS (SELECT a, count(*) n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT n_links, least(vec_id, coalesce(m.b, vec_id)) component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
