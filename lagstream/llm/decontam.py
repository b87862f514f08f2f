"""Operator 3, benchmark decontamination by an FM-index of each shard of the training texts.

A shard is a slice of an Arrow batch. Its words become symbols of the phrases' vocabulary, its suffixes are
sorted by prefix doubling, and the Burrows-Wheeler column goes into a
wavelet matrix. All phrases are searched backwards at once through its ranks; occurrences are located by
stepping from unsampled to sampled suffixes; hits are merged to removal spans of the text.

Words outside the phrases' vocabulary cannot be part of an occurrence, nor can runs of vocabulary words
shorter than the shortest phrase; both become one separator before the index is built.

The benchmark passes through the driver in blocks of items of about BLOCK words, one block in memory at a time. Each
is a broadcast of its own, which is kept on disk; a task with more than one reads them in turn for each batch of
texts, so its memory holds one block. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagstream.llm import bytetext as bt
from lagstream.llm.common import read_table

#: Words of benchmark text in one block of phrases (about 100 bytes each in a worker).
BLOCK = 400_000
#: Symbols of one index; longer texts are indexed in overlapping slices.
SHARD = 1 << 20
SAMPLE = 8


class WaveletMatrix:
    """Ranks over a sequence of small integers: rank(c, i) counts c before i."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.n = max(1, int(top).bit_length()), len(symbols)
        self.ones, self.zeros, now = [], [], symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.last = now

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((c >> level) & 1).astype(bool)
            one_lo, one_hi = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(bit, self.zeros[k] + one_lo, lo - one_lo)
            hi = np.where(bit, self.zeros[k] + one_hi, hi - one_hi)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit = self.ones[k][i + 1] - self.ones[k][i]
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + self.ones[k][i], i - self.ones[k][i])
        return out


class FMIndex:
    """FM-index of a symbol sequence (values 0..top). The suffix sort doubles its depth until no two suffixes
    agree, since stepping from one suffix to the one before needs their full order.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        n = self.n = len(symbols) + 1
        text = np.zeros(n, np.int64)
        text[:-1] = symbols + 1  # 0 ends the text
        rank, h = text, 1
        order = np.argsort(rank, kind="stable")
        while True:
            key = rank[order]
            ranks = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if ranks[-1] == n - 1:
                break
            now = np.zeros(n, np.int64)
            now[order] = ranks
            second = np.zeros(n, np.int64)
            second[:n - h] = now[h:] + 1
            rank = now * (n + 1) + second
            order = np.argsort(rank, kind="stable")
            h *= 2
        self.bwt = WaveletMatrix(text[order - 1], top + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all phrases: rows of symbols, the first `lengths` count."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step] + 1
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their rank."""
        out, steps, live, at = np.full(len(at), -1, np.int64), 0, np.arange(len(at)), at.copy()
        while len(live):
            hit = self.sampled[at]
            out[live[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            if len(live):
                c = self.bwt.at(at)
                at = self.before[c] + self.bwt.rank(c, at)
                steps += 1
        return out % self.n


class Phrases:
    """The distinct windows of benchmark items: k consecutive words, of a shorter item all."""

    def __init__(self, items: list[tuple[str, np.ndarray]], k: int):
        windows: dict[bytes, int] = {}
        rows, owners = [], []
        for item, words in items:
            m = min(k, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                key = words[i:i + m].tobytes()
                at = windows.setdefault(key, len(rows))
                if at == len(rows):
                    rows.append(words[i:i + m])
                    owners.append(set())
                owners[at].add(item)
        self.owners = [sorted(x) for x in owners]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.symbols = np.zeros((len(rows), k), np.int64)
        for i, r in enumerate(rows):
            self.symbols[i, :len(r)] = np.searchsorted(self.vocabulary, r) + 1
        self.shortest = int(self.lengths.min(initial=k))
        self.depth = int(self.lengths.max(initial=0))

    def occurrences(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in concatenated texts; rows: where each text begins, and the end."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words):
            return none
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words
        # runs of known words within a text
        inner = known.copy()
        inner[0] = False
        inner[1:] &= known[:-1]
        heads = rows[(rows > 0) & (rows < len(words))]
        inner[heads] = False
        starts = np.flatnonzero(known & ~inner)
        stop = np.flatnonzero(known & ~np.append(inner[1:], False)) + 1
        long = stop - starts >= self.shortest
        starts, stop = starts[long], stop[long]
        if not len(starts):
            return none
        found_at, found = [], []
        lo = 0
        ends = np.cumsum(stop - starts + 1)
        while lo < len(starts):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + SHARD, side="right")))
            pieces = [(a, z) for a, z in zip(starts[lo:hi].tolist(), stop[lo:hi].tolist())]
            if hi == lo + 1 and pieces[0][1] - pieces[0][0] > SHARD:  # one run in overlapping slices
                a, z = pieces[0]
                cut = range(a, z, SHARD)
                groups = [[(x, min(z, x + SHARD + self.depth - 1))] for x in cut]
            else:
                groups = [pieces]
            for group in groups:
                length = np.array([z - a for a, z in group])
                place = np.cumsum(length + 1) - length - 1
                source = np.repeat(np.array([a for a, _ in group]) - place, length + 1) + np.arange(int((length + 1).sum()))
                symbols = np.zeros(len(source), np.int64)
                inside = np.ones(len(source), bool)
                inside[place + length] = False
                symbols[inside] = at[source[inside]] + 1
                index = FMIndex(symbols, len(self.vocabulary))
                low, high = index.search(self.symbols, self.lengths)
                n = high - low
                if n.sum():
                    phrase = np.repeat(np.arange(len(n)), n)
                    suffix = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    found_at.append(source[index.locate(suffix)])
                    found.append(phrase)
            lo = hi
        if not found:
            return none
        pair = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found)]), axis=1)
        return pair[0], pair[1]

    def hits(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[set]]:
        """Which words are inside an occurrence, and the items that occur in each text."""
        first, phrase = self.occurrences(words, rows)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + self.lengths[phrase], -1)
        items: list[set] = [set() for _ in range(len(rows) - 1)]
        text = np.searchsorted(rows, first, side="right") - 1
        pairs = np.unique(np.stack([text, phrase]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
        for t, p in zip(pairs[0].tolist(), pairs[1].tolist()):
            items[t].update(self.owners[p])
        return np.cumsum(step[:-1]) > 0, items


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _cut(text: bytes, phrases: Phrases) -> bytes:
    """The text without its occurrences, repeated until what closes up holds none; a cut leaves one newline."""
    while True:
        buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts, ends, rows = bt.word_spans(buf, offsets, bt.ALNUM)
        hit, _ = phrases.hits(bt.hash_words(buf, starts, ends), rows)
        spans = [(int(starts[a]), int(ends[z - 1])) for a, z in _runs(hit)]
        if not spans:
            return text
        parts, at = [], 0
        for a, z in spans:
            parts += [text[at:a].rstrip(b" "), b"\n"]
            at = z
        text = b"".join([*parts, text[at:].lstrip(b" ")]).strip(b"\n")


def blocks(benchmark: DataFrame, k: int, id_col: str, text_col: str, most: int = BLOCK) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about `most` words; one item may be more."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        words = next(bt.texts_words(pa.array([text]), bt.ALNUM))
        if item is None or not len(words):
            continue
        block.append((item, words))
        size += len(words)
        if size >= most:
            yield Phrases(block, k)
            block, size = [], 0
    yield Phrases(block, k)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", clean: bool = False, carry: Sequence[str] = (), most: int = BLOCK) -> DataFrame:
    """Benchmark passages in documents: a row (id, n_words, n_hit, items, spans) for each document.

    Words are runs of ASCII letters, digits and all beyond ASCII after A-Z are lower-cased. A window is k
    consecutive words of an item, of a shorter one all its words; items without words or id have none. A
    word inside any occurrence of a window is hit. items are the ids with occurring windows, sorted as
    strings; spans the merged byte ranges [start, end) of hit words. clean adds clean_text, without
    those spans, cut again until no window remains; null texts stay null. carry names further columns to keep. Null and empty texts have no
    words. Repeated rows each return; empty tables give no rows or no hits; other columns are ignored. most is the
    words of a block of phrases, which changes no result.
    """
    names = ["id", "n_words", "n_hit", "items", "spans"] + ["clean_text"] * clean
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names += [f"c_{c}" for c in carry]
    context = docs.sparkSession.sparkContext
    handles = [context.broadcast(b) for b in blocks(benchmark, k, item_col, item_text, most)]  # the driver holds one block at a time

    def each() -> Iterator[Phrases]:
        """The blocks in turn; only a single one stays in memory."""
        for handle in handles:
            yield handle.value
            if len(handles) > 1:
                del handle._value

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            buf, offsets = bt.column_bytes(text)
            n_words, n_hit, items, spans, cleaned = [], [], [], [], []
            for lo, hi in bt.row_slices(offsets, 3 * bt.PIECE):
                part, at = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                starts, ends, rows = bt.word_spans(part, at, bt.ALNUM)
                words = bt.hash_words(part, starts, ends)
                hit, owners = np.zeros(len(words), bool), [set() for _ in range(hi - lo)]
                for phrases in each():
                    more, found = phrases.hits(words, rows)
                    hit |= more
                    for own, new in zip(owners, found):
                        own |= new
                for r in range(hi - lo):
                    a, z = rows[r], rows[r + 1]
                    n_words.append(int(z - a))
                    count = int(hit[a:z].sum())
                    n_hit.append(count)
                    items.append(sorted(owners[r], key=lambda s: s.encode()))
                    spans.append([{"start": int(starts[a + i] - at[r]), "end": int(ends[a + j - 1] - at[r])} for i, j in _runs(hit[a:z])] if count else [])
                    if clean:
                        value = None if not text[lo + r].is_valid else bytes(part[at[r]:at[r + 1]])
                        while count and value is not None:
                            before = value
                            for phrases in each():
                                value = _cut(value, phrases)
                            if value == before:
                                break
                        cleaned.append(None if value is None else value.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
            if n_words:
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cleaned, pa.string())] * clean + batch.columns[2:], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kind = T.StructType.fromDDL("id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>" + ", clean_text string" * clean)
    found = rows.mapInArrow(scan, T.StructType(kind.fields + rows.schema.fields[2:]))
    return found.select(*(x.name for x in kind), *(F.col(f"c_{c}").alias(c) for c in carry))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM low),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
n AS (SELECT item, w, least(len(w), 10) m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') g FROM n, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) i)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g FROM d, lens, LATERAL (SELECT unnest(range(1, greatest(len(w) - m + 2, 1))) i)),
occ AS (SELECT doc_id, item, dw.m, i FROM dw JOIN win ON dw.g = win.g AND dw.m = win.m),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) p FROM (SELECT DISTINCT doc_id, i, m FROM occ)),
h AS (SELECT doc_id, count(*) c FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) c, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(h.c, 0)::BIGINT n_hit, coalesce(it.c, 0)::BIGINT n_items, sha256(coalesce(it.s, '')) items_sha256, coalesce(h.c, 0) > 0 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
