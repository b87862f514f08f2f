"""Operator 7, language identification by Bayesian fusion of evidence.

Text likelihoods come from hashed byte-trigram profiles, counted over all texts of known language. Declared
language, address suffix and host are the other evidence: their counts by language are grouped sums of the
text-only posteriors. Host priors are smoothed by the host's domain, those by the whole corpus, and leave the
page's own share out. The evidence is joined to the few distinct (host, declared) pairs first, so a page needs
one join, which adaptive execution splits or broadcasts by its size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagstream.llm import bytetext as bt
from lagstream.llm.common import Stages, read_table

#: Trigram classes of a profile; a power of two.
BUCKETS = 1 << 16
SMOOTH = 0.5
#: Pseudo-counts of a host's and a domain's prior.
HOST_WEIGHT, DOMAIN_WEIGHT, LABEL_WEIGHT = 8.0, 8.0, 2.0
#: Neighbouring trigrams share bytes, so each counts as a third of an observation.
TEMPER = 1 / 3

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams of each text; all but letters are one space, and no trigram is mostly space."""
    low = np.full(len(buf) + 2 * (len(offsets) - 1) + 2, 0x20, np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low[np.arange(len(buf)) + 2 * row + 2] = _LETTER[buf]
    at = offsets + 2 * np.arange(len(offsets))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    place = np.flatnonzero(keep)
    x = low[place].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    own = np.clip(np.searchsorted(at, place, side="right") - 1, 0, len(offsets) - 2)
    real = (x[1:-1] != 0x20) | ((x[:-2] != 0x20) & (x[2:] != 0x20) & (own[:-2] == own[2:]))
    return own[1:-1][real], (bt.mix(code[real]) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Profiles:
    """Of each language, the log probabilities of its seen trigram classes (6 bytes each) and that of any other class."""

    def __init__(self, languages: list[str], counts: Iterable[np.ndarray]):
        self.languages, self.seen = languages, []
        for c in counts:
            at, whole = np.flatnonzero(c), c.sum() + SMOOTH * BUCKETS
            self.seen.append((at.astype(np.uint16), np.log((c[at] + SMOOTH) / whole).astype(np.float32), np.float32(np.log(SMOOTH / whole))))

    def likelihoods(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log likelihoods (texts x languages) and the trigrams of each text."""
        n = len(offsets) - 1
        rows, buckets = _trigrams(buf, offsets)
        out, table = np.zeros((n, len(self.seen))), np.empty(BUCKETS, np.float32)
        for i, (at, logs, other) in enumerate(self.seen):
            table[:] = other
            table[at] = logs
            out[:, i] = np.bincount(rows, table[buckets], n)
        return out, np.bincount(rows, minlength=n)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages named in docs, from all its texts; rows of null language are left out."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = bt.column_bytes(batch.column(0))
            langs = batch.column(1).dictionary_encode()
            names, codes = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi in bt.row_slices(offsets):
                rows, buckets = _trigrams(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                key, n = np.unique(codes[lo:hi][rows].astype(np.int64) * BUCKETS + buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(key // BUCKETS)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    counts = (docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).where(F.col(lang_col).isNotNull())
              .mapInArrow(scan, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    stages = Stages(docs.sparkSession, "profiles")
    counts = stages.put(counts, "counts")
    found = counts.toArrow()  # a row for each language and class seen in it
    codes = found.column("lang").combine_chunks().dictionary_encode()
    names, own = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    by = np.argsort(own, kind="stable")
    at, buckets, n = np.searchsorted(own[by], np.arange(len(names) + 1)), found.column("bucket").to_numpy()[by], found.column("n").to_numpy()[by]
    ranks = sorted(range(len(names)), key=names.__getitem__)
    tables = (np.bincount(buckets[at[i]:at[i + 1]], n[at[i]:at[i + 1]], BUCKETS) for i in ranks)
    stages.drop(counts)
    return Profiles([names[i] for i in ranks], tables)


def evidence(rows: DataFrame, profiles: Profiles, markup: bool) -> DataFrame:
    """(id, host, declared, ll, post, trigrams, fits) of rows (id, text, host, declared).

    ll are tempered log likelihoods less their largest, post the text-only posterior; fits tells whether some
    language explains the text better than evenly drawn trigrams.
    """
    model = rows.sparkSession.sparkContext.broadcast(profiles)
    many = pa.list_(pa.float64())
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("declared", pa.string()), ("ll", many), ("post", many), ("trigrams", pa.int64()), ("fits", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = model.value
        width = len(profiles.languages)
        for batch in batches:
            text = batch.column(1)
            if markup:
                text = pa.array([_MARKUP.sub(b" ", t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.binary())
            buf, offsets = bt.column_bytes(text.fill_null(b"") if markup else text)
            for lo, hi in bt.row_slices(offsets):
                ll, n = profiles.likelihoods(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                best = ll.max(1) if width else np.zeros(hi - lo)
                fits = (n > 0) & (best > -n * math.log(BUCKETS)) if width else np.zeros(hi - lo, bool)
                ll = (ll - best[:, None]) * TEMPER
                post = np.exp(ll)
                post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * width)
                lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (ll, post)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), *lists, pa.array(n.astype(np.int64)), pa.array(fits)], schema=schema)

    return rows.select("id", "text", "host", "declared").mapInArrow(
        scan, "id long, host string, declared string, ll array<double>, post array<double>, trigrams long, fits boolean")


def _sums(column: str, width: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(width))) if width else F.array().cast("array<double>")


def _prior(counts: Column, base: Column, weight: float) -> Column:
    """Shares of counts, with weight pseudo-counts in the proportions of base."""
    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(counts, base, lambda c, b: (c + weight * b) / whole)


def identify(rows: DataFrame, profiles: Profiles, markup: bool = False) -> DataFrame:
    """Language of each row of (id, text, host, declared): id, host, declared, lang, posterior, trigrams, accepted.

    host is a dotted name or any label (its domain is its last two labels, its suffix the last; a label without
    a dot has neither); null host and null declared are no evidence. A text without letters is decided by the
    other evidence alone and not accepted; accepted tells that the text fits some language better than evenly
    drawn trigrams. Ties go to the language that sorts first; without any known language lang is null. Null
    text is empty. Repeated rows each return; an empty table gives no rows.
    """
    names, width = profiles.languages, len(profiles.languages)
    stages = Stages(rows.sparkSession, "langid")
    found = stages.put(evidence(rows, profiles, markup), "evidence")
    host = F.coalesce("host", F.lit(""))
    labels = F.split(host, r"\.")
    pairs = (found.groupBy(host.alias("h"), F.coalesce("declared", F.lit("")).alias("d")).agg(_sums("post", width).alias("s")))
    pairs = stages.put(pairs, "pairs")
    labels = F.split("h", r"\.")
    pairs = (pairs.withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit("")))
             .withColumn("domain", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.lit(""))))
    if not width:
        return found.select("id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), "trigrams", F.lit(False).alias("accepted"))
    whole = pairs.agg(_sums("s", width).alias("s")).first()["s"]  # one row
    n = sum(x or 0.0 for x in whole) or 1.0
    share = F.array(*(F.lit(((x or 0.0) + 1.0 / width) / (n + 1.0)) for x in whole))
    totals = F.array(*(F.lit(float(x or 0.0)) for x in whole))

    def sums(key: str, out: str) -> DataFrame:
        return pairs.groupBy(F.col(key).alias(f"_{key}")).agg(_sums("s", width).alias(out))

    def likelihood(counts: Column) -> Column:
        """P(label | language), smoothed by the label's share of all."""
        part = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
        return F.zip_with(counts, totals, lambda c, t: F.log((c + LABEL_WEIGHT * part + 1e-9) / (t + LABEL_WEIGHT)))

    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    table = (pairs.join(sums("h", "host_s"), F.col("h") == F.col("_h")).join(sums("domain", "domain_s"), F.col("domain") == F.col("_domain"))
             .join(sums("d", "declared_s"), F.col("d") == F.col("_d")).join(sums("suffix", "suffix_s"), F.col("suffix") == F.col("_suffix")))
    table = table.select(
        "h", "d", F.when(F.col("h") != "", F.col("host_s")).alias("host_s"),
        F.when(F.col("domain") != "", _prior(F.col("domain_s"), share, DOMAIN_WEIGHT)).otherwise(share).alias("base"),
        F.zip_with(F.when(F.col("d") != "", likelihood(F.col("declared_s"))).otherwise(zero),
                   F.when(F.col("suffix") != "", likelihood(F.col("suffix_s"))).otherwise(zero), lambda a, b: a + b).alias("labels"))
    table = stages.put(table, "table")
    joined = found.join(table, (F.coalesce(found["host"], F.lit("")) == table["h"]) & (F.coalesce(found["declared"], F.lit("")) == table["d"]))
    others = F.when(F.col("host_s").isNotNull(), F.zip_with("host_s", "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))).otherwise(zero)
    log_prior = F.transform(_prior(others, F.col("base"), HOST_WEIGHT), lambda p: F.log(p))
    post = F.zip_with(F.zip_with("ll", log_prior, lambda a, b: a + b), "labels", lambda a, b: a + b)
    top = F.array_max("fused")
    fused = joined.withColumn("fused", post)
    return stages.finish(
        fused.select("id", "host", "declared", F.element_at(F.array(*map(F.lit, names)), F.array_position("fused", top).cast("int")).alias("lang"),
                    (F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("posterior"), "trigrams", "fits")
        .withColumnRenamed("fits", "accepted"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, host, declared) of pages; a page without an address or lang attribute has null there."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.|\.$", "")
    declared = F.lower(F.regexp_extract(F.col(html_col), _DECLARED, 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("text"), blank(host).alias("host"), blank(declared).alias("declared"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Whole `pages`, with profiles of whole `documents`: page_id, host, declared, lang, posterior, trigrams, accepted."""
    profiles = train(read_table(spark, sf_dir, "documents"))
    return identify(page_rows(read_table(spark, sf_dir, "pages")), profiles, markup=True).withColumnRenamed("id", "page_id")
