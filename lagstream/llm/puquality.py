"""Operator 9, quality classification by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text train a model by the non-negative unbiased risk
(Kiryo et al. 2017) with the logistic loss: pi R_p+ + max(0, R_u- - pi R_p-). The class prior pi is estimated
from the two samples: the least ratio of unlabelled to positive mass above a score (Scott 2015). Labels of 0
are never read. Features are shape statistics of a text, cut at quantiles of the unlabelled sample, and the shares
of its words and of its runs of three bytes by hashed classes.

The fit runs on the driver over SAMPLE ids of each kind at most, a row each, taken by the order of a digest of the
id; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.llm import bytetext as bt
from lagstream.llm.common import read_table

#: Rows of each kind (positive, unlabelled) that the fit sees at most.
SAMPLE = 20_000
CUTS = 12
#: Hashed classes of words, and as many of runs of three bytes.
CLASSES = 128

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = _LOWER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PLAIN = _UPPER | _LOWER | _DIGIT
_PLAIN[[0x20, *range(0x09, 0x0E), *b".,;:'\"?!()-"]] = True
FEATURES = ("log_words", "word_length", "distinct", "top_share", "repeats", "upper", "digit", "symbol", "stop", "words_a_line", "distinct_lines", "bang", "comma")


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each whole text (rows x FEATURES, then 2 CLASSES of square roots of shares); null and empty texts are all zero."""
    buf, offsets = bt.column_bytes(column)
    out = []
    for lo, hi in bt.row_slices(offsets):
        part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        m = hi - lo
        starts, ends, rows = bt.word_spans(part, at, bt.NOT_SPACE)
        words = bt.hash_words(part, starts, ends)
        n = np.diff(rows).astype(float)

        def count(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return (total[at[1:]] - total[at[:-1]]).astype(float)

        doc = np.repeat(np.arange(m), np.diff(rows))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        distinct, top = np.zeros(m), np.zeros(m)
        lines, distinct_lines = np.zeros(m), np.zeros(m)
        line_starts, line_ends, line_rows = bt.word_spans(part, at, _LINE)
        line_hash = bt.hash_words(part, line_starts, line_ends)
        for r in range(m):
            if rows[r + 1] > rows[r]:
                _, c = np.unique(words[rows[r]:rows[r + 1]], return_counts=True)
                distinct[r], top[r] = len(c), c.max()
                own = line_hash[line_rows[r]:line_rows[r + 1]]
                lines[r], distinct_lines[r] = len(own), len(np.unique(own))
        size, some = np.maximum(np.diff(at), 1).astype(float), np.maximum(n, 1)
        upper, lower = count(_UPPER[part]), count(_LOWER[part])
        shape = np.stack([
            np.log1p(n), np.bincount(doc, ends - starts, m) / some, distinct / some, top / some, np.bincount(doc, same, m) / some,
            upper / np.maximum(upper + lower, 1), count(_DIGIT[part]) / size, count(~_PLAIN[part]) / some, count(part == 0x2E) / some,
            np.log1p(n / np.maximum(lines, 1)), distinct_lines / np.maximum(lines, 1), count(part == 0x21) / some, count(part == 0x2C) / some], 1)
        # runs of three bytes inside a text, A-Z as a-z
        low = np.where(_UPPER[part], part | 0x20, part).astype(np.uint32)
        runs = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16) if len(low) > 2 else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(m), np.diff(at))[:len(runs)]
        inside = np.arange(len(runs)) + 2 < at[1:][owner]
        lexical = [np.bincount(own * CLASSES + kind.astype(np.int64) % CLASSES, minlength=m * CLASSES).reshape(m, CLASSES) for own, kind in ((doc, words % np.uint64(1 << 32)), (owner[inside], runs[inside]))]
        out.append(np.concatenate([shape, *(np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)) for c in lexical)], 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)


WIDTH = len(FEATURES) + 2 * CLASSES
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False


class Model:
    """A logistic model over steps at quantiles of each statistic, and the classes' shares as they are."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.weights = np.zeros(1 + sum(len(c) for c in cuts) + 2 * CLASSES, np.float32)

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1), np.float32)] + [(x[:, i:i + 1] > c[None, :]).astype(np.float32) for i, c in enumerate(self.cuts)] + [x[:, len(FEATURES):]], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(w: np.ndarray, gradient, rounds: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam on a gradient function."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of the mass above a score, with a margin for small counts."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.quantile(p, np.linspace(0, 0.8, 81))
    above_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    slack = np.sqrt(np.log(100) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    return float(np.clip(np.min((above_u + 0.25 * slack) / above_p), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 2e-4) -> tuple[Model, float]:
    """The model and its class prior. Without positives or unlabelled rows every text gets one half."""
    base = unlabelled if len(unlabelled) else np.zeros((1, WIDTH))
    model = Model([np.unique(np.quantile(base[:, i], np.linspace(0, 1, CUTS + 2)[1:-1])) for i in range(len(FEATURES))])
    if not len(positive) or not len(unlabelled):
        return model, 0.5
    a, b = model.steps(positive), model.steps(unlabelled)
    # classes are many for few positives, and held back accordingly
    penalty = np.full(len(model.weights), ridge, np.float32)
    penalty[-2 * CLASSES:] += 4 / len(a)

    def told_apart(w):
        return -(1 - _sigmoid(a @ w)) @ a / len(a) + _sigmoid(b @ w) @ b / len(b) + 2 * penalty * w

    w = _descend(np.zeros_like(model.weights), told_apart, 200)
    prior = class_prior(a @ w, b @ w)

    def risk(w):
        p, u = _sigmoid(a @ w), _sigmoid(b @ w)
        up = -prior * (1 - p) @ a / len(a)  # pi R_p+
        down = u @ b / len(b) - prior * (p @ a) / len(a)  # R_u- - pi R_p-
        negative = np.logaddexp(0, b @ w).mean() - prior * np.logaddexp(0, a @ w).mean()
        return (up + down if negative >= 0 else -down) + 2 * penalty * w

    model.weights = _descend(np.zeros_like(model.weights), risk)
    return model, prior


def sampled(docs: DataFrame, ids: DataFrame, text_col: str) -> np.ndarray:
    """Features of the texts of ids (at most SAMPLE), in the order of their ids; of rows of one id the least features."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], schema=schema)

    found = docs.join(F.broadcast(ids), "id", "left_semi").select("id", F.col(text_col).cast("string")).mapInArrow(scan, "id long, x array<float>").groupBy("id").agg(F.min("x").alias("x")).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH) if found.num_rows else np.zeros((0, WIDTH), np.float32)
    return x[np.argsort(found.column("id").to_numpy())]


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted of each text: the probability of label 1, and 1 where it reaches least.

    Trained on rows whose crc32(id as text) mod folds is not 0: trusted positives are those labelled 1, unlabelled
    are any. Null ids and null labels never train; a null id counts as empty text, so is held out. Null and empty
    texts are scored as texts without words. Repeated rows each return; an empty table gives no rows.
    """
    out_of_fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), out_of_fold.alias("held_out"))
    some = lambda df: df.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    train_label = labels.where(~out_of_fold & (F.col(label_col) == 1)).select(F.col(id_col).cast("long").alias("id"))
    positive = sampled(rows, some(train_label), "text")
    unlabelled = sampled(rows, some(rows.where("not held_out")), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(positive, unlabelled)[0])
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.value.probability(features(batch.column(1))), pa.float64())], schema=schema)

    return rows.mapInArrow(scan, "id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, learnt from `labels`: doc_id, held_out, score, predicted."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
