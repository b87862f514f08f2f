"""Helpers shared by the training-data operators: tables, staged tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session that names none gets one of its own (tests), a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="stages-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_MADE: ContextVar[list[Stages] | None] = ContextVar("made", default=None)


@contextmanager
def collected() -> Iterator[list[Stages]]:
    """Lists the Stages made within, which can be cleared once the rows that read them have been written."""
    made: list[Stages] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


class Stages:
    """Tables written once in the shared folder, so that a lost executor costs no lineage.

    put() writes a DataFrame and returns it reread; drop() deletes the tables that no later
    plan reads; finish() deletes all but those that a returned DataFrame, which is lazy, reads;
    clear() deletes the rest.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: set[str] = set()
        made = _MADE.get()
        if made is not None:
            made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.live.discard(where)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._staged)

    def delete(self, paths: set[str]) -> None:
        for path in paths:
            self._delete(path)

    def clear(self) -> None:
        self.delete(set(self.live))

    def finish(self, result: DataFrame) -> DataFrame:
        """result, after the staged tables that it does not read are deleted."""
        plan = result._jdf.queryExecution().optimizedPlan().collectLeaves()
        read = " ".join(str(plan.apply(i).relation().location().rootPaths()) for i in range(plan.size()) if hasattr(plan.apply(i), "relation") and plan.apply(i).getClass().getSimpleName() == "LogicalRelation")
        for path in [p for p in self.live if p.rsplit("/", 2)[1] + "/" + p.rsplit("/", 1)[1] not in read]:
            self._delete(path)
        return result


def min_neighbours(both: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours, by a partial aggregate on each mapper."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def with_min(edges: DataFrame, mins: DataFrame) -> DataFrame:
    """edges (u, v) with m of u. The key is hashed anew, so both sides are dealt out by an exchange of
    the join's own, whose large partitions adaptive execution can split: one u may have most edges."""
    mins = mins.select(F.col("u").alias("mu"), "m")
    return edges.join(mins, F.xxhash64(edges["u"]) == F.xxhash64(mins["mu"])).where(F.col("u") == F.col("mu")).select("u", "v", "m")


def components(edges: DataFrame, stages: Stages, most: int = 60) -> DataFrame:
    """Connected components of edges (a, b) as (node, component), component the smallest id in it.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay as they are;
    each step is grouped minima and joins, and its edges are written to the shared folder. Ids are
    longs; loops, repeats and either direction are fine. Nodes without an edge are left out; no
    edges give no rows.
    """
    now = stages.put(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (with_min(both.where("v > u"), min_neighbours(both))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (with_min(large, mins).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(mins.select("u", F.col("m").alias("v"))).distinct())
        after = stages.put(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stages.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
