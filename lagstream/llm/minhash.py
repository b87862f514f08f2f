"""Operator 8, near-duplicate texts: one-permutation MinHash with optimal densification, banded buckets and
star-shaped candidate edges.

Flow, with what is bounded at each step:

1. One scan gives each text its shingle count, a 128-bit digest of its shingle set and its band keys.
   Texts of one digest form a class (exact copies of any number collapse by a partial aggregate).
2. Only class representatives are bucketed. A bucket's hub is the member whose buckets are the largest; a
   representative is first compared with one hub only, so candidates are linear in the rows whatever the buckets.
3. Links are confirmed on full shingle sets and joined to components. Buckets whose members are by then in
   one component are done. Small open buckets give the pairs of members in different components. In large ones
   members are compared with one reference, and only texts whose differences from it meet are paired
   (far_pairs), which leaves out no link; nothing is capped.

Components are computed by joins on staged tables; no links or ids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagstream.llm import bytetext as bt
from lagstream.llm.common import Stages, components, read_table


#: Buckets of so many members at most are paired directly.
SMALL = 16


class Sketch:
    """One-permutation MinHash of bands x rows bins, densified by probing (Shrivastava 2017).

    An empty bin takes the value of the first non-empty bin in an order of its own that is the same for
    every text: PROBES hashed positions, then all bins by a hashed rank.
    """

    PROBES = 48

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        k = self.bins
        self.edges = np.array([(i << 64) // k for i in range(1, k)], np.uint64)
        j = np.arange(k, dtype=np.uint64)
        self.probes = np.stack([bt.mix(j * np.uint64(0x9E3779B97F4A7C15) + np.uint64((a + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(k) for a in range(self.PROBES)]).astype(np.int64)
        self.weights = bt.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = bt.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def bins_of(self, ascending: np.ndarray) -> np.ndarray:
        """The densified bins of a non-empty ascending set of hashes: equal parts of the hash range, each with its least hash."""
        at = np.empty(self.bins + 1, np.int64)
        at[0], at[-1] = 0, len(ascending)
        at[1:-1] = np.searchsorted(ascending, self.edges)
        full = at[:-1] < at[1:]
        out = np.zeros(self.bins, np.uint64)
        out[full] = ascending[at[:-1][full]]
        empty = np.flatnonzero(~full)
        for probe in self.probes:
            if not len(empty):
                return out
            to = probe[empty]
            hit = full[to]
            out[empty[hit]] = out[to[hit]]
            empty = empty[~hit]
        if len(empty):
            have = np.flatnonzero(full)
            rank = bt.mix(empty.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ bt.mix(have.astype(np.uint64) + np.uint64(7))[None, :])
            out[empty] = out[have[rank.argmin(1)]]
        return out

    def keys(self, ascending: np.ndarray) -> np.ndarray:
        """One key for each band, different between bands."""
        bins = self.bins_of(ascending).reshape(self.bands, self.rows)
        return bt.mix((bt.mix(bins) * self.weights).sum(1, dtype=np.uint64) + self.salts)


def plan_bands(percent: int, rows: int = 6, miss: float = 1e-8) -> int:
    """Bands of so many rows so that a pair at the threshold shares none with a chance below `miss`."""
    return int(np.ceil(np.log(miss) / np.log1p(-(percent / 100) ** rows)))


def signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, d1, d2, keys) of every row; keys is null where there is no word."""
    sketch = Sketch(plan_bands(percent), 6)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys, none = [], [], [], np.zeros(sketch.bands, np.uint64)
            for words in bt.texts_words(batch.column(1), bt.NOT_SPACE):
                found = bt.shingle_hashes(words, k)
                n.append(len(found))
                digests.append((found.sum(dtype=np.uint64), bt.mix(found * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)))
                keys.append(sketch.keys(found) if len(found) else none)
            if not n:
                continue
            counts, d = np.array(n, np.int64), np.array(digests, np.uint64).view(np.int64)
            flat = pa.array(np.concatenate(keys).view(np.int64))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * sketch.bands)
            lists = pa.ListArray.from_arrays(offsets, flat, mask=pa.array(counts == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), lists], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan, "id long, n_shingles long, d1 long, d2 long, keys array<long>")


def compared(pairs: DataFrame, texts: DataFrame, k: int, residual: bool = False) -> DataFrame:
    """Pairs (a, b) with the sizes na, nb of their full shingle sets, both of their intersection and, with residual,
    the shingles rest of a that b lacks.

    The texts of both ends come by joins (a hub's join is split by adaptive execution); the last few sets
    are kept by id, since a hub's rows come one after another.
    """
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, rests = [], []
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
            for i in range(batch.num_rows):
                sets = []
                for c in (0, 1):
                    key = int(ids[c][i])
                    found = kept.get(key)
                    if found is None:
                        if len(kept) >= 4:
                            kept.pop(next(iter(kept)))
                        (words,) = bt.texts_words(batch.column(2 + c).slice(i, 1), bt.NOT_SPACE)
                        found = kept[key] = bt.shingle_hashes(words, k)
                    sets.append(found)
                one, two = sets
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                shared = two[at] == one if len(two) else np.zeros(len(one), bool)
                sizes.append((len(one), len(two), int(shared.sum())))
                if residual:
                    rests.append(one[~shared].view(np.int64))
            columns = [*batch.columns[:2], *(pa.array(x, pa.int64()) for x in zip(*sizes))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rests, pa.list_(pa.int64()))] * residual, names=["a", "b", "na", "nb", "both"] + ["rest"] * residual)

    return two.select("a", "b", "ta", "tb").mapInArrow(count, "a long, b long, na long, nb long, both long" + ", rest array<long>" * residual)


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that reach percent: 100 |A and B| >= percent |A or B|."""
    return compared(pairs, texts, k).where(reaches("both", percent)).select("a", "b")


def reaches(both: str | Column, percent: int, na: str = "na", nb: str = "nb") -> Column:
    both = F.col(both) if isinstance(both, str) else both
    return (both > 0) & (both * (100 + percent) >= (F.col(na) + F.col(nb)) * percent)


def far_pairs(about: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """Pairs (a, b) that may be linked among texts compared with one reference each: about has ref, a, na, nh (the
    reference's size), both (with the reference), rest and part (the component so far).

    Exact: of a pair not joined yet, one text x is not linked to the reference h. The pair shares at most
    min(|x and h|, |y and h|) shingles inside h, and outside h those that both residuals hold. So either the
    residuals meet, found by a join on residual shingles (few texts share one that h lacks), or the bound inside h
    alone must do, which needs |y| < |h|.
    """
    about = stages.put(about, "about")
    side = lambda df, s: df.select(*(F.col(c).alias(c + s) for c in ("ref", "a", "na", "both", "part")))
    loose = about.where(~reaches("both", percent, "na", "nh"))
    bound = lambda extra: reaches(F.least("both1", "both2") + extra, percent, "na1", "na2")
    apart = (F.col("part1") != F.col("part2")) & (F.col("a1") != F.col("a2"))
    # of a pair that can be linked, each residual of x holds percent |x| - |x and h| shingles of the other at least, so
    # in any one order of all shingles the residuals meet before the last so many less one
    least = F.greatest(F.lit(1), F.ceil(F.col("na") * percent / 100 - F.col("both")).cast("int"))
    spread = lambda df, s: (df.where(F.size("rest") >= least).select(*(F.col(c).alias(c + s) for c in ("ref", "a", "na", "both", "part")), F.size("rest").alias("size" + s), (least - 1).alias("off" + s),
                                                                    F.explode(F.slice(F.array_sort("rest"), F.lit(1), F.size("rest") - least + 1)).alias("e" + s)))
    met = spread(loose, "1").join(spread(about, "2"), (F.col("e1") == F.col("e2")) & (F.col("ref1") == F.col("ref2")) & apart & bound(F.least("size1", "size2")))
    met = met.groupBy("a1", "a2", "na1", "na2", "both1", "both2", "ref1", "off1", "off2").agg(F.count("*").alias("c")).where(bound(F.col("c") + F.col("off1") + F.col("off2")))
    small = side(about.where("na < nh"), "2")
    inside = side(loose, "1").join(small, (_rehash(F.col("ref1")) == _rehash(F.col("ref2"))) & (F.col("ref1") == F.col("ref2")) & apart & bound(F.lit(0)))
    return met.select("a1", "a2").unionByName(inside.select("a1", "a2")).select(F.greatest("a1", "a2").alias("a"), F.least("a1", "a2").alias("b"))


def _rehash(x: Column) -> Column:
    return F.xxhash64(x, F.lit(1))


def relabel(nodes: DataFrame, column: str, parts: DataFrame, out: str) -> DataFrame:
    """nodes with the component of `column`, itself where it has none."""
    parts = parts.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return (nodes.join(parts, F.col(column) == F.col("_n"), "left")
            .withColumn(out, F.coalesce("_c", column)).drop("_n", "_c"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of texts: one row (id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of non-space after A-Z are lower-cased; a text's set holds its distinct runs of k words,
    of fewer words all as one; empty and null texts have none and are linked with nothing. Texts with
    100 |A and B| >= percent |A or B| are linked, confirmed on full sets; component_id is the smallest id
    reachable, kept marks the row that has it. Rows of one id count as one node (each row returns); a row of null id is
    linked with nothing and kept. An empty table gives no rows; other columns are ignored.

    The chance that a pair at the threshold shares no bucket is below 1e-8.
    """
    stages = Stages(docs.sparkSession, "minhash")
    sig = stages.put(signatures(docs, k, percent, id_col, text_col), "signatures")
    classes = sig.where("n_shingles > 0 and id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"))
    # digests are hashed anew for the join, so that a class of most rows can be split
    c = classes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n_shingles").alias("en"), "rep")
    members = stages.put(
        sig.join(c, sig["id"].isNotNull() & (_rehash(sig["d1"]) == _rehash(c["e1"])) & (sig["d1"] == c["e1"]) & (sig["d2"] == c["e2"]) & (sig["n_shingles"] == c["en"]), "left")
        .select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"), F.when(F.col("rep") == F.col("id"), F.col("keys")).alias("keys")), "members")
    stages.drop(sig)
    keyed = members.where("keys is not null").select(F.col("rep"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("skey"), "c")
    # members of buckets of more than one text, and the bucket's size
    buckets = stages.put(keyed.join(shared, _rehash(keyed["key"]) == _rehash(F.col("skey"))).where("key = skey").select("key", "c", "rep", "n"), "buckets")
    # a text in large buckets is central to its group; a bucket's hub is its most central member
    central = buckets.groupBy("rep").agg(F.sum("c").alias("score")).select(F.col("rep").alias("srep"), "score")
    scored = stages.put(buckets.join(central, F.col("rep") == F.col("srep")).select("key", "c", "rep", "n", F.struct("score", (-F.col("rep")).alias("low")).alias("rank")), "scored")
    stages.drop(buckets)
    hubs = scored.groupBy("key").agg(F.max("rank").alias("top"))
    hubs = stages.put(hubs.select(F.col("key").alias("hkey"), "top"), "hubs")
    membership = scored.join(hubs, _rehash(scored["key"]) == _rehash(F.col("hkey"))).where("key = hkey")
    own = membership.groupBy("rep").agg(F.max("top").alias("top")).select("rep", (-F.col("top.low")).alias("hub"))
    own = stages.put(own, "own")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = stages.put(text.join(own.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "texts")

    links = stages.put(linked(own.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")), texts, k, percent), "links")
    parts = stages.put(components(links, stages), "components")
    # buckets whose members are not in one component yet
    labelled = stages.put(relabel(scored.select("key", "c", "rep", "n"), "rep", parts, "part"), "labelled")
    open_keys = (labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
                 .select(F.col("key").alias("okey")))
    left = stages.put(labelled.join(open_keys, _rehash(labelled["key"]) == _rehash(F.col("okey"))).where("key = okey").drop("okey"), "left")
    few = left.where(F.col("c") <= SMALL)
    other = few.select(F.col("key").alias("key2"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("part").alias("part2"))
    near = few.join(other, (F.col("key") == F.col("key2")) & (F.col("part") != F.col("part2")) & (F.col("rep") > F.col("rep2"))
                    & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    # large ones by a reference: the hub of the bucket's hub, so that the buckets of a group have one in common
    many = left.where(F.col("c") > SMALL)
    refs = hubs.select("hkey", (-F.col("top.low")).alias("h")).join(own.select(F.col("rep").alias("h2"), F.col("hub").alias("ref")), F.col("h") == F.col("h2")).select("hkey", "ref")
    many = many.join(refs, _rehash(many["key"]) == _rehash(F.col("hkey"))).where("key = hkey").select("rep", "ref", "part").distinct()
    many = stages.put(many, "many")
    against = stages.put(compared(many.select(F.col("rep").alias("a"), F.col("ref").alias("b")), texts, k, residual=True), "against")
    to_ref = against.where(reaches("both", percent) & (F.col("a") != F.col("b"))).select("a", "b")
    about = against.select("a", F.col("b").alias("ref"), "na", F.col("nb").alias("nh"), "both", "rest").join(many.select(F.col("rep").alias("a"), "ref", "part"), ["a", "ref"])
    pairs = stages.put(near.unionByName(far_pairs(about, percent, stages)).distinct(), "pairs")
    found = stages.put(linked(pairs, texts, k, percent).unionByName(to_ref), "links")
    if not found.isEmpty():
        parts = stages.put(components(links.unionByName(found), stages), "components")
    final = relabel(members.select("id", "n_shingles", "rep"), "rep", parts, "component_id")
    return stages.finish(final.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` at 85 %: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), 85, 5).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END sh
  FROM t, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) b FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(t.doc_id, coalesce(m.b, t.doc_id)) component_id,
       t.doc_id = least(t.doc_id, coalesce(m.b, t.doc_id)) kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = t.doc_id
"""
