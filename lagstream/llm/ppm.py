"""Operator 4, language-model scoring by prediction by partial matching over bytes.

Training: one scan counts byte n-grams and words of all training texts, pre-aggregated by Arrow batch and by
mapper. Escapes are estimated by method C: a context seen n times with d symbols escapes with d / (n + d). Symbols
of longer contexts are excluded from shorter ones; the denominators after exclusion are worked out once for each
context.

The model keeps every context. N-grams are dealt out by the last two bytes of their contexts, so a task has all
nodes of two and more context bytes that its n-grams pass through; those of shorter contexts, 65,792 at most, go to
every task. A task works out the log probability of each of its n-grams, those of held-out texts included.

Scoring: the log probabilities of the most frequent n-grams and the counts of the most frequent words are
broadcast; rarer ones are joined, so neither model has a bound. Adaptive scoring learns from the text itself while
it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstream.llm import bytetext as bt
from lagstream.llm.common import Stages, read_table

ORDER = 5
#: Words whose counts, and n-grams whose log probabilities are broadcast (16 bytes each); the others are joined.
HEAD_WORDS, HEAD_GRAMS = 200_000, 2_000_000
#: N-grams of a part of the model, on average.
PART = 500_000
PIECE = 1 << 20
#: Distinct words or n-grams that a task holds before it passes their counts on.
HELD = 1 << 18
#: Bytes that UTF-8 never has: before a text, and its end.
PAD, END = 0xFE, 0xFF
END_WORD = np.uint64(0x5DEECE66D1234567)


def _codes(buf: np.ndarray, offsets: np.ndarray, order: int, rows: bool = True) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """(row, code) of every symbol of the texts and their ends: the symbol in the low byte, the order bytes before it above."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1) * (order + 1)
    seq = np.full(int(at[-1] - at[0]) if n else 0, PAD, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    seq[np.arange(len(buf)) + ((row + 1).astype(np.int64) * (order + 1) - 1)] = buf
    seq[at[1:] - 1] = END
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at)) if rows else None
    for a in range(0, len(seq), PIECE):
        z = min(len(seq), a + PIECE)
        head = max(0, a - order)
        # codes of 1, 2, 4, .. bytes, doubled up and cut to order + 1
        code, width = seq[head:z].astype(np.uint64), 1
        while width <= order:
            step = code.copy()
            step[width:] |= code[:-width] << np.uint64(8 * width)
            code, width = step, 2 * width
        if order < 7:
            code &= np.uint64((1 << 8 * (order + 1)) - 1)
        real = np.flatnonzero(seq[a:z] != PAD)
        yield (row[a:z][real] if rows else None), code[a - head:][real]


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = bt.word_spans(buf, offsets, bt.NOT_SPACE)
    return bt.hash_words(buf, starts, ends), rows


def gather(docs: DataFrame, order: int, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(kind, code, n): counts of words (kind 0, the end included) and of n-grams of order + 1 bytes (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush(kind: int) -> pa.RecordBatch:
            codes, n = merged(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(codes.view(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            buf, offsets = bt.column_bytes(batch.column(0))
            for lo, hi in bt.row_slices(offsets, PIECE):
                part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                if 0 in kinds:
                    words, _ = _words(part, at)
                    held[0].append(np.unique(np.append(words, np.full(hi - lo, END_WORD)), return_counts=True))
                held[1] += [np.unique(c, return_counts=True) for _, c in _codes(part, at, order, False)]
                for kind in (0, 1):
                    if sum(len(c) for c, _ in held[kind]) > HELD:
                        yield flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind)

    return docs.mapInArrow(scan, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _least(histogram: list[tuple[int, int]], most: int) -> int:
    """The least class whose rows, with those of all higher classes, are at most `most`."""
    total = 0
    for level, rows in sorted(histogram, reverse=True):
        total += rows
        if total > most:
            return level + 1
    return 0


def _level(x) -> F.Column:
    return F.floor(F.log2(x) * 8).cast("int")


class Trie:
    """Context nodes by order, with the mass that remains below each context after exclusion."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], order: int):
        """tables: by order, codes (context bytes above the symbol's) and counts."""
        self.order, self.orders = order, []
        for k in range(order + 1):
            codes, counts = tables.get(k, (np.zeros(0, np.uint64), np.zeros(0)))
            by = np.argsort(codes)
            codes, counts = codes[by], counts[by].astype(np.float64)
            contexts, inverse = np.unique(codes >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, counts, len(contexts))
            distinct = np.bincount(inverse, minlength=len(contexts)).astype(np.float64)
            below = np.zeros(len(contexts))
            if k and len(contexts):
                low = self.orders[k - 1]
                at, _ = self._find(low["codes"], codes & np.uint64((1 << 8 * k) - 1))
                up, _ = self._find(low["contexts"], contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                below = low["total"][up] - np.bincount(inverse, low["counts"][at], len(contexts)) + low["distinct"][up] - distinct
            if k == order:  # seen symbols of the longest contexts need no escape
                self.direct = np.log10(counts / (total + distinct)[inverse]) if len(codes) else counts
            self.orders.append({"codes": codes, "counts": counts.astype(np.float32) if counts.max(initial=0) < 1 << 24 else counts, "contexts": contexts, "total": total, "distinct": distinct, "below": below})

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, x)
        at[at == len(table)] = 0
        return at, (table[at] == x) if len(table) else np.zeros(len(x), bool)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its context; ascending codes are looked up fastest."""
        out = np.zeros(len(codes))
        at, seen = self._find(self.orders[-1]["codes"], codes)
        out[seen] = self.direct[at[seen]]
        live = np.flatnonzero(~seen)
        mass, seen = np.full(len(codes), np.nan), np.zeros(len(codes))  # what is left at this order; symbols excluded
        for k in range(self.order, -1, -1):
            table = self.orders[k]
            if not len(live) or not len(table["codes"]):
                continue
            mine = codes[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            context, there = self._find(table["contexts"], mine >> np.uint64(8))
            node, hit = self._find(table["codes"], mine)
            now, here = live[there], context[there]
            left = np.where(np.isnan(mass[now]), table["total"][here] + table["distinct"][here], mass[now])
            hit = hit[there]
            out[now[hit]] += np.log10(table["counts"][node[there][hit]] / left[hit])
            miss, at, rest = now[~hit], here[~hit], left[~hit]
            new = table["distinct"][at] - seen[miss]
            some = rest > 0
            out[miss[some]] += np.log10(new[some] / rest[some])
            mass[miss], seen[miss] = table["below"][at], table["distinct"][at]
            gone = np.zeros(len(codes), bool)
            gone[now[hit]] = True
            live = live[~gone[live]]
        out[live] -= np.log10(np.maximum(256 - seen[live], 1))
        return out


def fit(counts: DataFrame, order: int, max_nodes: int) -> Trie:
    """One trie of the n-grams of counts (kind 1), with at most max_nodes nodes of each order, by least-seen contexts;
    scores() does without it."""
    grams = counts.where("kind = 1")
    every = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).alias("code")) for k in range(order + 1)))
    nodes = grams.select(F.explode(every).alias("x"), "n").groupBy("x.k", "x.code").agg(F.sum("n").alias("n"))
    stages = Stages(counts.sparkSession, "ppm-nodes")
    nodes = stages.put(nodes, "nodes")
    contexts = nodes.groupBy("k", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("d"))
    levels = contexts.groupBy("k", _level(F.col("total")).alias("level")).agg(F.sum("d").alias("d")).collect()  # at most 8 * 64 rows an order
    least, low = {}, 0
    for k in range(order + 1):
        low = max(low, _least([(r["level"], r["d"]) for r in levels if r["k"] == k], max_nodes))
        least[k] = low
    if any(least.values()):
        bound = F.element_at(F.array(*(F.lit(least[k]) for k in range(order + 1))), F.col("k") + 1)
        chosen = contexts.where(_level(F.col("total")) >= bound).select(F.col("k").alias("ck"), "context")
        nodes_ = nodes.join(chosen, (F.col("k") == F.col("ck")) & (F.shiftright("code", 8) == F.col("context"))).select("k", "code", "n")
    else:
        nodes_ = nodes
    table = nodes_.toArrow()
    k, code, n = (table.column(c).to_numpy() for c in ("k", "code", "n"))
    stages.drop(nodes)
    return Trie({o: (code[k == o].view(np.uint64), n[k == o]) for o in range(order + 1)}, order)


def _node_counts(codes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    nodes, inverse = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return nodes, np.bincount(inverse, n, len(nodes))


def log_probabilities(trained: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(code, n, p): count and log10 probability of each n-gram of trained and asked (code, n), by the whole model of trained."""
    spark = trained.sparkSession
    short = min(order, 1)
    # nodes of at most one context byte: 256 * 257 rows at most
    low = trained.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (short + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    low_codes, low_n = low.column("code").to_numpy().view(np.uint64), low.column("n").to_numpy()
    model = spark.sparkContext.broadcast({k: _node_counts(low_codes, low_n, k) for k in range(short + 1)})
    every = trained.select("code", "n", F.lit(True).alias("known")).unionByName(asked.select("code", "n", F.lit(False).alias("known")))
    pieces = max(spark.sparkContext.defaultParallelism, every.count() // PART + 1)
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("p", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not table:
            return
        table = pa.Table.from_batches(table)
        code, n, known = (table.column(c).to_numpy() for c in ("code", "n", "known"))
        code = code.view(np.uint64)
        trie = Trie(model.value | {k: _node_counts(code[known], n[known], k) for k in range(short + 1, order + 1)}, order)
        codes, inverse = np.unique(code, return_inverse=True)
        n = np.bincount(inverse, n, len(codes)).astype(np.int64)
        for lo in range(0, len(codes), HELD):
            some = codes[lo:lo + HELD]
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n[lo:lo + HELD]), pa.array(trie.log10(some))], schema=schema)

    suffix = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * min(order, 2)) - 1))
    return every.repartition(pieces, suffix).mapInArrow(part, "code long, n long, p double")


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end by a trie that starts empty and learns as it reads (method C, exclusion)."""
    trie: dict[bytes, dict[int, int]] = {}
    total, past = 0.0, b""
    for symbol in [*text, END]:
        excluded: set[int] = set()
        p = None
        for k in range(min(order, len(past)), -1, -1):
            seen = trie.get(past[len(past) - k:], {})
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            mass = sum(left.values()) + len(left)
            if symbol in left:
                p = left[symbol] / mass
                break
            total += np.log10(len(left) / mass)
            excluded |= set(left)
        total += np.log10(p) if p else -np.log10(256 - len(excluded))
        for k in range(min(order, len(past)) + 1):
            node = trie.setdefault(past[len(past) - k:], {})
            node[symbol] = node.get(symbol, 0) + 1
        past = (past + bytes([symbol]))[-order:] if order else b""
    return float(total)


def adaptive_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) by adaptive_log10; null texts as empty."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = bt.column_bytes(batch.column(1))
            scores = [adaptive_log10(bytes(buf[at[i]:at[i + 1]]), order) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "id long, score double")


def held_out(id_col: str, folds: int) -> F.Column:
    """Whether crc32 of the id's text is divisible by folds; a null id counts as empty text, so is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def scores(docs: DataFrame, order: int = ORDER, folds: int = 10, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the pretrained model's log10 probability of the text's bytes and its end, base_score a smoothed
    unigram model of its lower-cased words and one end: sum of log10((c + 0.1) / (N + 0.1 (V + 1))). Null
    texts are empty, with one token, the end. Repeated rows each return and each count in training. An empty
    table gives no rows; with no training text every c is 0 and all 256 symbols are alike. Words are told
    apart by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "ppm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, folds).alias("held_out"))
    counts = stages.put(gather(rows.where("not held_out").select("text"), order), "counts")
    words = counts.where("kind = 0")
    facts = words.groupBy(_level(F.col("n")).alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    tokens, distinct = sum(r["n"] for r in facts), sum(r["d"] for r in facts)
    least = _least([(r["level"], r["d"]) for r in facts], head_words)
    held = stages.put(gather(rows.where("held_out").select("text"), order, (1,)), "held")
    grams = stages.put(log_probabilities(counts.where("kind = 1").select("code", "n"), held.select("code", "n"), order), "grams")
    levels = grams.groupBy(_level(F.col("n")).alias("level")).count().collect()
    least_gram = _least([(r["level"], r["count"]) for r in levels], head_grams)
    stages.drop(held)

    def head(table: DataFrame, least: int, value: str) -> tuple[np.ndarray, np.ndarray]:
        found = table.where(_level(F.col("n")) >= least).select("code", value).toArrow()
        codes = found.column("code").to_numpy().view(np.uint64)
        by = np.argsort(codes)
        return codes[by], found.column(value).to_numpy()[by]

    model = spark.sparkContext.broadcast((head(grams, least_gram, "p"), head(words, least, "n")))
    whole = tokens + 0.1 * (distinct + 1)
    schema = pa.schema([("rid", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_codes, gram_p), (head_codes, head_n) = model.value
        for batch in batches:
            buf, offsets = bt.column_bytes(batch.column(2))
            for lo, hi in bt.row_slices(offsets, PIECE):
                part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                m = hi - lo
                score, rare_rows, rare_codes = np.zeros(m), [], []
                for row, code in _codes(part, at, order):
                    inverse, unique = pd.factorize(code)
                    by, value = np.argsort(unique), np.zeros(len(unique))
                    spot, hit = Trie._find(gram_codes, unique[by])
                    value[by[hit]] = gram_p[spot[hit]]
                    score += np.bincount(row, value[inverse], m)
                    if not hit.all():
                        gone = np.zeros(len(unique), bool)
                        gone[by[~hit]] = True
                        gone = gone[inverse]
                        rare_rows.append(row[gone])
                        rare_codes.append(code[gone])
                found, ends = _words(part, at)
                row = np.append(np.repeat(np.arange(m), np.diff(ends)), np.arange(m))
                found = np.append(found, np.full(m, END_WORD))
                spot, hit = Trie._find(head_codes, found)
                c = np.where(hit, head_n[spot], 0) if len(head_n) else np.zeros(len(found))
                base = np.bincount(row[hit], np.log10((c[hit] + 0.1) / whole), m)
                known = np.bincount(row[hit], minlength=m)
                rid = batch.column(0).slice(lo, m).to_numpy()
                # rare words and n-grams, once for each row, beside one row of the text's own facts under a kind of its own
                r = np.concatenate([row[~hit], *rare_rows]).astype(np.int64)
                w = np.concatenate([found[~hit], *rare_codes])
                kind = np.repeat(np.array([0, 1], np.int32), [np.count_nonzero(~hit), sum(map(len, rare_rows))])
                order_ = np.lexsort((w, kind, r))
                r, w, kind = r[order_], w[order_], kind[order_]
                first = np.ones(len(r), bool)
                first[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1]) | (kind[1:] != kind[:-1])
                where = np.flatnonzero(first)
                times = np.diff(np.append(where, len(r)))
                t = len(where)
                none = lambda values, kind: pa.array(np.append(values, np.zeros(t, values.dtype)), kind, mask=np.append(np.zeros(m, bool), np.ones(t, bool)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(rid, rid[r[where]])),
                    pa.array(np.append(np.full(m, 2, np.int32), kind[where])),
                    pa.array(np.append(bt.mix(rid.astype(np.uint64) + np.uint64(1)), w[where]).view(np.int64)),
                    pa.array(np.append(np.zeros(m, np.int64), times)),
                    pa.concat_arrays([batch.column(1).slice(lo, m), pa.nulls(t, pa.int64())]),
                    pa.concat_arrays([batch.column(3).slice(lo, m), pa.nulls(t, pa.bool_())]),
                    none(np.diff(ends) + 1, pa.int64()), none(known, pa.int64()), none(base, pa.float64()), none(score, pa.float64()),
                ], schema=schema)

    parts = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "held_out").mapInArrow(
        scan, "rid long, kind int, h long, times long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    rare = (words.where(_level(F.col("n")) < least).select(F.lit(0).alias("rk"), F.col("code").alias("rh"), F.col("n").cast("double").alias("c"))
            .unionByName(grams.where(_level(F.col("n")) < least_gram).select(F.lit(1).alias("rk"), F.col("code").alias("rh"), F.col("p").alias("c"))))
    c, word = F.coalesce(F.col("c"), F.lit(0.0)), F.col("kind") == 0
    return stages.finish(
        parts.join(rare, (F.col("h") == F.col("rh")) & (F.col("kind") == F.col("rk")), "left").groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
             (F.max("known") + F.sum(F.when(word & (c > 0), F.col("times")).otherwise(F.lit(0)))).alias("n_known"),
             (F.max("base") + F.sum(F.when(word, F.col("times") * F.log10((c + 0.1) / F.lit(float(whole)))).otherwise(F.lit(0.0)))).alias("base_score"),
             (F.max("score") + F.sum(F.when(F.col("kind") == 1, F.col("times") * c).otherwise(F.lit(0.0)))).alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"))


def op4_ppm_score(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, learnt from those with crc32(doc_id) mod 10 not 0."""
    return scores(read_table(spark, sf_dir, "documents"))
