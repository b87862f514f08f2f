"""Operator 2, mixing sources to target weights: a time-varying curriculum in DataFrame functions only.

Each source has a weight schedule over training progress 0..1, linear between knots. Its integral is the
source's share; its cumulative integral, inverted at a document's place in the source's token stream, is
the document's training position; documents are range-sorted by position.

A source's stream is its documents in the order of a keyed digest, passed over again until the target is
met; the last copy is cut at the word that meets it. The running sums are taken in two steps, over ranges
of the digest and within a range, about the square root of the rows each, so no task gets a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagstream.llm.common import Stages, read_table

Knots = Sequence[tuple[float, float]]
#: Schedules dealt to the sources in turn; they integrate to 3, 1 and 2.
CURRICULUM: tuple[Knots, ...] = (((0.0, 3.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 3.0), (1.0, 1.0)))
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def integral(knots: Knots) -> float:
    """The schedule's whole weight."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _segments(knots: Knots) -> Column:
    """The schedule's pieces (u0, w0, slope, y0, y1), y its cumulative share."""
    whole, y, parts = integral(knots), 0.0, []
    for (u0, w0), (u1, w1) in zip(knots, knots[1:]):
        if u1 <= u0:
            continue
        y1 = y + (u1 - u0) * (w0 + w1) / 2 / whole
        values = (u0, w0 / whole, (w1 - w0) / whole / (u1 - u0), y, y1)
        parts.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("u0", "w0", "slope", "y0", "y1"), values))))
        y = y1
    return F.array(*parts)


def progress(y: Column, schedule: Column, curriculum: Sequence[Knots]) -> Column:
    """The progress u at which the cumulative share of curriculum[schedule] is y (0 to 1)."""
    out = None
    for i, knots in enumerate(curriculum):
        seg = F.element_at(F.filter(_segments(knots), lambda s: s["y1"] >= F.least(y, F.lit(1 - 1e-12))), 1)
        need = y - seg["y0"]
        root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * seg["slope"] * need, F.lit(0.0)))
        u = F.least(seg["u0"] + 2 * need / (seg["w0"] + root), F.lit(1.0))
        u = F.when(need <= 0, seg["u0"]).otherwise(u)
        out = F.when(schedule == i, u) if out is None else out.when(schedule == i, u)
    return out


def targets(sizes: DataFrame, curriculum: Sequence[Knots], share: float, most: int) -> DataFrame:
    """(skey, source_size, schedule, target) from (skey, source, source_size), a row for each source.

    Water-filling: sources in the order of cap to weight are full as long as the level reaches their cap.
    The windows run over one row a source.
    """
    weight = F.element_at(F.array(*(F.lit(integral(k)) for k in curriculum)), F.col("schedule") + 1)
    one = Window.orderBy(F.col("source").isNull(), "source")
    order = Window.orderBy("ratio", "skey")
    whole = Window.partitionBy()
    return (
        sizes.withColumn("schedule", ((F.row_number().over(one) - 1) % len(curriculum)).cast("int"))
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("whole", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("whole") - F.col("before")) / F.col("rest"))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("skey", "source_size", "schedule",
                F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def mix(docs: DataFrame, curriculum: Sequence[Knots] = CURRICULUM, share: float = 1.5, most: int = 2, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """A training mix: a row for each document with size, source_size, target, taken and its copies.

    Sources are ordered by code point, null last, and dealt the curriculum's schedules in turn; the mix has
    share times all words, a source at most `most` times its own. copies is array<struct<copy, words,
    position>>, empty where the mix takes nothing; carry names further columns of docs to keep (names of
    the result are not allowed). Null and empty texts have size 0 and no copies. Repeated rows each count.
    Rows that agree in id, size and source are interchangeable, so reruns agree. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"c_{c}") for c in carry),
                        size.alias("size"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), digest.alias("digest"))
    # kept columns may be whole texts, which are not worth a copy: sizes are counted again where they are placed
    narrow = stages.put(sized.select("id", "size", "skey", "digest"), "sized")
    ranges = max(1, int(narrow.count() ** 0.5))
    at_range = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")
    sums = stages.put(narrow.groupBy("skey", at_range.alias("range")).agg(F.sum("size").alias("range_size")), "ranges")
    sized = (sized if carry else narrow).withColumn("range", at_range)
    by_source = sums.groupBy("skey").agg(F.sum("range_size").alias("source_size")).withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
              .join(targets(by_source, curriculum, share, most), "skey")
              .select(F.col("skey").alias("k"), F.col("range").alias("r"), "start", "source_size", "schedule", "target"))
    starts = stages.put(starts, "starts")
    inside = Window.partitionBy("skey", "range").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, (F.col("skey") == F.col("k")) & (F.col("range") == F.col("r"))))
    goal = F.round("target").cast("long")
    at = F.col("start") + F.col("within")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda p: F.struct(p.alias("copy"),
                           F.greatest(F.lit(0), F.least(F.col("size"), goal - (p * F.col("source_size") + at))).alias("words"),
                           F.round(progress((p * F.col("source_size") + at) / goal, F.col("schedule"), curriculum), 9).alias("position")))
    return stages.finish(
        placed.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
        .select(F.col("id").alias(id_col), *(F.col(f"c_{c}").alias(c) for c in carry), "size", "source_size", "target",
                F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"), "copies"))


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each copy, range-sorted by training position: copy, words and position beside the kept columns."""
    flat = mixed.select("*", F.inline("copies")).drop("copies")
    return flat.orderBy("position", id_col, "copy")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, range-sorted by first training position (documents not taken last): doc_id, size,
    source_size, target, taken, first_position, n_copies."""
    mixed = mix(read_table(spark, sf_dir, "documents"))
    first = F.when(F.size("copies") > 0, F.col("copies")[0]["position"])
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("copies").alias("n_copies"))
            .orderBy(F.col("first_position").asc_nulls_last(), "doc_id"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT schedule FROM s),
c AS (SELECT *, CASE schedule WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END weight, (2 * source_size)::DOUBLE cap FROM w),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest, 1.5::DOUBLE * sum(source_size) OVER () whole FROM c),
l AS (SELECT *, (whole - before) / rest >= cap / weight AS is_full, (whole - before) / rest lev, row_number() OVER (ORDER BY cap / weight, source NULLS FIRST) k FROM o),
v AS (SELECT arg_min(lev, k) FILTER (WHERE NOT is_full) lev FROM l),
t AS (SELECT l.source, source_size, schedule, CASE WHEN is_full OR v.lev IS NULL THEN cap ELSE least(v.lev * weight, cap) END target FROM l, v),
p AS (
  SELECT doc_id, size, source_size, target, schedule, round(target)::BIGINT goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT at0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, goal - at0)) w0, greatest(0, least(size, goal - source_size - at0)) w1, at0 / goal::DOUBLE y FROM p)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT taken, ((w0 > 0)::INT + (w1 > 0)::INT)::INT n_copies,
  CASE WHEN w0 > 0 THEN round(CASE WHEN y <= 0 THEN 0.0 WHEN schedule = 0 THEN least(2 * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE)), 1.0)
    WHEN schedule = 1 THEN least(2 * y / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0 * y)), 1.0)
    ELSE least(2 * y / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0 * y)), 1.0) END, 9) END first_position
FROM q
"""
