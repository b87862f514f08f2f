"""Each operator against brute force on a small fixture, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagstream.llm import common, decontam, langid, minhash, mixing, pii, ppm, puquality, rpforest, styletree, toolcalls

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, kind string, surrogate string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "k", 1, "x", "y") for i, t, lang, s in rows], EXTRA)


def edge_rows():
    long = " ".join(f"w{i % 997}" for i in range(120_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "one", "en", "a"), (5, long, "en", "b"), (6, long, "en", "b"), (6, long, "en", "b"), (7, "ONE", "fr", "b"),
            (None, "no id here at all today", "fr", None), (8, "x" * 300_000, "de", "c"), (9, "É ü ß   \U0001f600 end", "de", "c")]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- components


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def root(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df, common.Stages(spark, "t")).collect()}
    assert got == {i: root(i) for a, b in edges for i in (a, b) if a != b or root(i) != i or any(i in e and e[0] != e[1] for e in edges)}
    assert common.components(df.limit(0), common.Stages(spark, "t")).count() == 0


# --- 8


def near_brute(rows, percent, k=5):
    sets = {}
    for i, t, *_ in rows:
        w = tokens(t)
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(x for x in sets if x is not None)
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                la, lb = label[a], label[b]
                label = {x: min(la, lb) if v in (la, lb) else v for x, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_minhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for group in range(8):  # near copies around a base, with 0 to 9 changed words, and cuts
        base = list(rng.choice(vocabulary, 90))
        for _ in range(25 if group else 60):
            w = base.copy()
            for at in rng.integers(0, 90, rng.integers(0, 10)):
                w[at] = str(rng.choice(vocabulary))
            rows.append((i, " ".join(w[:int(rng.integers(80, 91))]), "en", "s"))
            i += 1
    rows += [(500, "a b", "en", "s"), (501, "A  b", "en", "s"), (502, "a b c", "en", "s"), (503, None, "en", "s"), (504, "", "en", "s")]
    for percent in (80, 85):
        got = minhash.near_duplicates(table(spark, rows).repartition(3), percent).collect()
        want = near_brute(rows, percent)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_minhash_edges(spark):
    got = minhash.near_duplicates(table(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    by = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (0, 1, True) and by[7] == (1, 4, False) and by[6][1] == 5 and by[None][2] is True and by[None][1] is None
    assert minhash.near_duplicates(table(spark, edge_rows()).limit(0)).count() == 0


def test_open_buckets_lose_no_link(spark):
    """Candidates of the exact remainder hold every link of texts in different components, whatever the reference."""
    rng = np.random.default_rng(1)
    base = set(range(100))
    sets = [frozenset(base)]
    for i in range(60):
        s = set(base)
        for j in rng.choice(100, rng.integers(0, 25), replace=False):
            s.discard(int(j))
            if rng.random() < 0.7:
                s.add(1000 + int(rng.integers(0, 40)))
        sets.append(frozenset(s))
    percent, ref = 85, 3
    h = sets[ref]
    about = [(i, ref, len(s), len(h), len(s & h), [x for x in s if x not in h], i) for i, s in enumerate(sets)]
    df = spark.createDataFrame(about, "a long, ref long, na long, nh long, both long, rest array<long>, part long")
    found = {(r["a"], r["b"]) for r in minhash.far_pairs(df, percent, common.Stages(spark, "t")).collect()}
    close = {i for i, s in enumerate(sets) if 100 * len(s & h) >= percent * len(s | h)}
    for a, s in enumerate(sets):
        for b in range(a):
            if 100 * len(s & sets[b]) >= percent * len(s | sets[b]) and not (a in close and b in close):
                assert (a, b) in found


# --- 2


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", "abcdefg"[int(rng.choice(7, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.03, 0.02]))]) for i in range(400)] + [(400, "x y", "en", None), (401, None, "en", "a")]
    got = mixing.mix(table(spark, rows), carry=("lang",)).toPandas()
    source = {i: s for i, _, _, s in rows}
    size = {i: len(tokens(t)) for i, t, *_ in rows}
    assert dict(zip(got.doc_id, got["size"])) == size and got["lang"].eq("en").all()
    names = sorted({s for s in source.values() if s is not None}) + [None]
    whole = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    goal, left, open_ = {}, 1.5 * sum(whole.values()), list(names)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    while open_:  # shares beyond the cap go to the others
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= 2 * whole[s]]
        for s in full or open_:
            goal[s] = 2 * whole[s] if full else unit * weight[s]
            left -= goal[s]
        open_ = [s for s in open_ if s in full] and [s for s in open_ if s not in full] if full else []
    for r in got.itertuples():
        assert math.isclose(r.target, goal[source[r.doc_id]], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
    for s in names:
        taken = sum(r.taken for r in got.itertuples() if source[r.doc_id] == s)
        assert abs(taken - goal[s]) <= 0.5
    again = mixing.mix(table(spark, rows).repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    order = mixing.training_order(mixing.mix(table(spark, rows))).toPandas()
    assert order.position.is_monotonic_increasing and order.position.between(0, 1).all()


def test_curriculum_inversion(spark):
    knots = ((0.0, 0.5), (0.4, 2.0), (0.4, 1.0), (1.0, 0.0))
    u = np.linspace(0, 1, 50)
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [0, 0.4, 0.4 + 1e-12, 1], [0.5, 2, 1, 0])
    y = np.interp(u, grid, np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)]) / ((w[1:] + w[:-1]) / 2).sum())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, y)], "u double, y double").withColumn("got", mixing.progress(F.col("y"), F.lit(0), (knots,)))
    assert max(abs(r["u"] - r["got"]) for r in df.where("u < 0.98").collect()) < 1e-4


def test_mixing_edges(spark):
    got = mixing.mix(table(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(table(spark, edge_rows()).limit(0)).count() == 0


# --- 3


def words3(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_brute(docs, items, k=10):
    windows = {}
    for item, text in items:
        w = words3(text)
        m = min(k, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, found = words3(text), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j:j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j:j + m])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_decontamination_against_brute_force(spark, shard, monkeypatch):
    rng = np.random.default_rng(2)
    v = [f"t{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(v, n))
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(12)] + [(50, None), (51, "..."), (52, "Only Three Words")]
    docs = [(i, text(200) + ". " + items[i % 12][1].upper().replace(" ", ", ") + " " + text(50)) for i in range(30)] + [(90, None), (91, ""), (92, "only three  WORDS")]
    monkeypatch.setattr(decontam, "SHARD", shard)
    phrases = list(decontam.blocks(spark.createDataFrame(items, "item_id long, text string"), 10, "item_id", "text", 60 if shard == 40 else decontam.BLOCK))
    assert len(phrases) > 1 or shard != 40
    want = contamination_brute(docs, items)
    import pyarrow as pa

    from lagstream.llm import bytetext as bt

    for i, t in docs:  # the kernel itself, also in slices
        buf, at = bt.column_bytes(pa.array([t], pa.string()))
        s, e, rows = bt.word_spans(buf, at, bt.ALNUM)
        words, hit, found = bt.hash_words(buf, s, e), np.zeros(len(s), bool), set()
        for p in phrases:
            h, owners = p.hits(words, rows)
            hit |= h
            found |= owners[0]
        assert (len(words), int(hit.sum()), sorted(found)) == want[i]
    if shard != 40:
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
        got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), clean=True, carry=("items",)).select("id", "n_words", "n_hit", "spans", "clean_text").collect()
        assert {r["id"]: (r["n_words"], r["n_hit"]) for r in got} == {i: x[:2] for i, x in want.items()}
        clean = contamination_brute([(r["id"], r["clean_text"]) for r in got], items)
        assert all(x[1] == 0 for x in clean.values())
        assert next(r for r in got if r["id"] == 90)["clean_text"] is None
        assert [s["end"] - s["start"] for s in next(r for r in got if r["id"] == 92)["spans"]] == [17]


def test_decontamination_digest_and_edges(spark):
    bench = spark.createDataFrame([(10, "one two three four"), (9, "two three four five")], "item_id long, text string")
    got = decontam.contamination(table(spark, edge_rows() + [(20, "one two three four five", "en", "a")]), bench).collect()
    row = next(r for r in got if r["id"] == 20)
    assert row["items"] == ["10", "9"] and row["n_hit"] == 5
    assert decontam.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()
    assert len(got) == len(edge_rows()) + 1 and sum(r["n_hit"] > 0 for r in got) == 1
    assert decontam.contamination(table(spark, edge_rows()), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# --- 4


def ppm_brute(texts, order):
    counts = {}
    for t in texts:
        s = [ppm.PAD] * order + list(t.encode()) + [ppm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                node = counts.setdefault((k, tuple(s[i - k:i])), {})
                node[s[i]] = node.get(s[i], 0) + 1

    def log10(t):
        s, total = [ppm.PAD] * order + list(t.encode()) + [ppm.END], 0.0
        for i in range(order, len(s)):
            seen: set = set()
            for k in range(order, -1, -1):
                node = {a: n for a, n in counts.get((k, tuple(s[i - k:i])), {}).items() if a not in seen}
                if not node:
                    continue
                mass = sum(node.values()) + len(node)
                if s[i] in node:
                    total += math.log10(node[s[i]] / mass)
                    break
                total += math.log10(len(node) / mass)
                seen |= set(node)
            else:
                total -= math.log10(256 - len(seen))
        return total

    return log10


def test_ppm_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = ["the", "cat", "Cat", "sat", "mät", "on", "zzz"]
    docs = [(i, " ".join(rng.choice(v, int(rng.integers(0, 12))))) for i in range(40)] + [(40, None), (41, "\U0001f600 new q")]
    got = ppm.scores(spark.createDataFrame(docs, "doc_id long, text string"), order=3, head_words=4).toPandas().set_index("doc_id")
    train = [t or "" for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    log10 = ppm_brute(train, 3)
    c = {}
    for t in train:
        for w in tokens(t) + [None]:
            c[w] = c.get(w, 0) + 1
    n = sum(c.values())
    for i, t in docs:
        r, own = got.loc[i], tokens(t) + [None]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.n_tokens == len(own) and r.train_tokens == n
        assert r.n_known == sum(w in c for w in own)
        assert math.isclose(r.base_score, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (len(c) + 1))) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, log10(t or ""), rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_ppm_keeps_every_context(spark, monkeypatch, order):
    rng = np.random.default_rng(order)
    docs = [(i, " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(int(rng.integers(0, 9))))) for i in range(60)]
    for name, most in (("MAX_NODES", 30), ("PART", 100)):  # far fewer than the corpus holds
        monkeypatch.setattr(ppm, name, most, raising=False)
    some = {k: 30 for k in ("max_nodes", "head_grams") if k in ppm.scores.__code__.co_varnames}
    got = {r["doc_id"]: r["score"] for r in ppm.scores(spark.createDataFrame(docs, "doc_id long, text string"), order=order, **some).collect()}
    log10 = ppm_brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 10], order)
    assert all(math.isclose(got[i], log10(t), rel_tol=1e-6, abs_tol=1e-6) for i, t in docs)


def test_ppm_is_a_distribution_also_when_pruned(spark):
    docs = [(i, t) for i, t in enumerate(["abab abba", "baab abab", "abracadabra", "banana band"] * 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("text")
    counts = common.Stages(spark, "t").put(ppm.gather(rows, 3), "counts")
    for most in (10_000, 25):
        trie = ppm.fit(counts, 3, most)
        for context in (b"aba", b"zzz", b"ban", b"\xfe\xfe\xfe"):
            code = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
            total = (10 ** trie.log10(code | np.arange(256, dtype=np.uint64))).sum()
            assert total <= 1 + 1e-6 and (total > 0.99 or context in (b"zzz",) or total > 0.9)


def test_adaptive_ppm():
    assert ppm.adaptive_log10(b"") == pytest.approx(-math.log10(256))
    repeated, random = ppm.adaptive_log10(b"abcd" * 50), ppm.adaptive_log10(np.random.default_rng(0).integers(97, 123, 200).astype(np.uint8).tobytes())
    assert repeated > random / 4


def test_ppm_edges(spark):
    got = ppm.scores(table(spark, edge_rows())).toPandas()
    assert len(got) == len(edge_rows()) and np.isfinite(got[["score", "base_score"]]).all().all() and (got[got.doc_id.eq(1)].n_tokens == 1).all()
    assert ppm.scores(table(spark, edge_rows()).limit(0)).count() == 0


# --- 7


def test_language_fusion(spark):
    en = "the and of to in that this with from house green water stone " * 3
    fr = "le la les des une pour dans avec sur maison verte eau pierre été " * 3
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 10)], "doc_id long, text string, lang string")
    profiles = langid.train(docs)
    assert profiles.languages == ["en", "fr"]
    rows = [(1, "the water of the house", "a.example.com", None), (2, "la maison dans une eau", "b.example.fr", "fr"), (3, None, "b.example.fr", "fr"), (4, "", None, None), (5, "12345 ###", "a.example.com", "en"),
            (5, "12345 ###", "a.example.com", "en")] + [(10 + i, "la pierre verte sur une maison", "b.example.fr", "fr") for i in range(30)] + [(60 + i, "the green stone in that house", "a.example.com", "en") for i in range(30)] + [(99, "on", "b.example.fr", None)]
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, host string, declared string"), profiles).collect()}
    assert got[1]["lang"] == "en" and got[2]["lang"] == "fr" and got[1]["accepted"]
    assert got[3]["lang"] == "fr" and not got[3]["accepted"] and not got[4]["accepted"] and not got[5]["accepted"]
    assert got[99]["lang"] == "fr"  # the host decides where the text hardly tells
    assert langid.identify(spark.createDataFrame(rows, "id long, text string, host string, declared string"), langid.Profiles([], np.zeros((0, langid.BUCKETS)))).count() == len(rows)
    pages = spark.createDataFrame([(1, "https://user@WWW.Example.COM:80/x", '<!doctype html><HTML class=a Lang="FR-ca"><p>le</p>'), (2, None, None)], "page_id long, url string, html string")
    r = {x["id"]: (x["host"], x["declared"]) for x in langid.page_rows(pages).collect()}
    assert r == {1: ("example.com", "fr"), 2: (None, None)}


def test_declared_language_after_a_long_comment(spark):
    pages = spark.createDataFrame([(1, None, f"<!--{'x ' * 5000}--><html class=a lang=fr><p>le"), (2, None, f"<html data-a='{'x' * 9000}' lang='de'>")], "page_id long, url string, html string")
    assert {r["id"]: r["declared"] for r in langid.page_rows(pages).collect()} == {1: "fr", 2: "de"}


def test_every_language_has_a_profile(spark):
    rng = np.random.default_rng(0)
    speech = {f"l{i:02d}": " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(100 - i)) for i in range(70)}
    profiles = langid.train(spark.createDataFrame([(t, lang) for lang, t in speech.items()], "text string, lang string"))
    assert profiles.languages == sorted(speech)
    rows = spark.createDataFrame([(i, speech[f"l{i:02d}"], None, None) for i in (0, 63, 64, 69)], "id long, text string, host string, declared string")
    assert {r["id"]: (r["lang"], r["accepted"]) for r in langid.identify(rows, profiles).collect()} == {i: (f"l{i:02d}", True) for i in (0, 63, 64, 69)}


def test_trigrams_of_short_and_long_rows():
    buf = np.frombuffer(b"abab", np.uint8)
    rows, _ = langid._trigrams(buf, np.array([0, 2, 2, 4]))
    assert set(rows.tolist()) == {0, 2}


# --- 9


def test_quality(spark):
    rng = np.random.default_rng(0)
    v = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        docs.append((i, ". ".join(" ".join(rng.choice(v, 9)) for _ in range(8)) if good else " ".join(f"{w}$$$" for w in rng.choice(v, 60))))
        if i % 2:
            labels.append((i, int(good), 0))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(5))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = puquality.quality(d, lab).toPandas().set_index("id")
    assert got.index.is_unique
    good = [i for i, t in docs if "$" not in t]
    assert (got.loc[good].predicted == 1).mean() > 0.97 and (got.loc[[i for i, t in docs if "$" in t]].predicted == 0).mean() > 0.97
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert puquality.quality(d, flipped).toPandas().set_index("id").score.equals(got.score) or np.allclose(puquality.quality(d, flipped).toPandas().set_index("id").score.sort_index(), got.score.sort_index())
    assert len(puquality.quality(table(spark, edge_rows()), lab).toPandas()) == len(edge_rows())
    assert puquality.quality(d, lab.limit(0)).agg(F.max("score")).first()[0] == 0.5
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 20_000), np.concatenate([rng.normal(2, 1, 14_000), rng.normal(-2, 1, 6_000)])
    assert abs(puquality.class_prior(p, u) - 0.7) < 0.05


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = puquality.op9_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert len(good) > 40 and len(bad) > 5 and np.mean(good[:, None] > bad[None, :]) > 0.9


def test_repeated_ids_train_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(2, "other")], "id long, text string")
    x = puquality.sampled(docs, spark.createDataFrame([(1,), (2,)], "id long"), "text")
    assert x.shape == (2, puquality.WIDTH)


# --- 10


HTML = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<nav><a href=x>menu</a></nav><div class="cookie-notice">cookies</div><main><h1>Head&amp;line</h1>
<p>One <b>bold</b> &eacute;&#233;<br>line
 two<p>Second <a href="a>b">link</a></p><ul><li>item<li>other</ul><table><tr><td>c1<td>c2</table><form>search<input></form>
<!-- <p>comment</p> --><div class="comments"><p>reader</p></div><p>last</p></main><aside>side</aside><footer>foot</footer></body></html>"""


def test_page_text(spark):
    want = ["Head&line", "One bold éé line two", "Second link", "item", "other", "c1", "c2", "last"]
    html = spark.createDataFrame([(1, "http://a/1", HTML)], "page_id long, url string, html string")
    assert styletree.extract(html).first()["text"].split("\n") == want  # one page alone: what markup suggests
    text = lambda x: styletree.Page(x).text()
    assert text("plain < text &lt; here") == "plain < text < here"
    assert text("<div>a<p>b</div>c<script>x").split("\n") == ["a", "b", "c"]
    assert text("<nav>n</nav><button>press</button><p hidden>h</p><canvas>c</canvas>").split("\n") == ["press", "h", "c"]
    for broken in ("", "<", "</", "<p", '<p class="', "<!--", "<![CDATA[x]]>", "</div></p>", "<p>" * 3000, '<a b="' * 50):
        text(broken)
    for deep in ("<div>" * 50_000 + "x", "<blockquote>" * 50_000 + "</section>" * 50_000 + "x", "<b>" * 50_000 + "<li>" * 2000 + "x"):
        assert text(deep) == "x"


def test_names_alone_remove_no_article(spark):
    pages = [(1, '<body class="no-footer"><div class="layout has-sidebar"><article><p>the text itself</p></article><div class="sidebar">links</div></div>'),
             (2, '<div id="content" class="no-header"><h1>A title</h1><p>and all of the text</p></div><div class="ads">buy</div>')]
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in pages], "page_id long, url string, html string")
    assert {r["id"]: r["text"] for r in styletree.extract(df).collect()} == {1: "the text itself", 2: "A title\nand all of the text"}


def test_site_style_tree(spark):
    page = lambda i, host, body: (i, f"http://{host}/{i}", f"<html><body><div class=box>Always the same line</div><div class=txt>{body}</div></body></html>")
    pages = [page(i, "a.com", f"text number {i}") for i in range(12)] + [page(100 + i, "b.com", "copy") for i in range(12)] + [(200, None, None), (201, "x", "")]
    # an unnamed slot of changing content, told from the text by its presentations and its share only
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    pages += [(300 + i, f"http://c.com/{i}", f"<div class=x><ul><li>{words(1)}<li>{words(1)}</ul></div><div class=y>{''.join(f'<p>{words(60)}</p>' for _ in range(1 + i % 5))}</div>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("slots", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["id"]: r["text"] for r in styletree.extract(df).collect()}
    assert got[3] == "text number 3"  # the repeated branch is gone
    assert got[105] == "Always the same line\ncopy"  # copies of one page are no evidence
    assert all(got[300 + i].count("\n") == i % 5 and got[300 + i].count(" ") == 59 * (1 + i % 5) for i in range(20))
    assert got[200] == "" and got[201] == "" and len(got) == len(pages)
    assert styletree.extract(df.limit(0)).count() == 0


def test_importance_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pages = []
    for i in range(30):
        paragraphs = "".join(f"<p>{rng.choice(['same', 'other', f'own {i}'])} text</p>" for _ in range(int(rng.integers(1, 4))))
        pages.append((("one", "two")[i % 2], f"<body><div>{paragraphs}</div><section><h2>head</h2></section></body>"))
    pages += pages[:5]
    got = styletree.importance(styletree.site_nodes(spark.createDataFrame(pages, "host string, html string"))).toPandas()
    for host in ("one", "two"):
        seen = {html: styletree.Page(html) for h, html in pages if h == host}
        paths = {x for p in seen.values() for x in p.path}
        for path in paths:
            on = [p for p in seen.values() if path in p.path]
            m, shown, texts = len(on), {}, {}
            for k, p in enumerate(on):
                style = tuple(p.style[n] for n in range(len(p.path)) if p.path[n] == path)
                shown[style] = shown.get(style, 0) + 1
                for text in {t for n, t in p.blocks if p.path[n] == path}:
                    texts[text] = texts.get(text, 0) + 1
            entropy = -sum(c / m * math.log(c / m) for c in shown.values()) / math.log(m)
            row = got[(got.host == host) & (got.path == styletree._signed(path))].iloc[0]
            assert row.pages == m and abs(row["style"] - entropy) < 1e-9
            if texts:
                assert abs(row["content"] - (1 - np.mean([math.log(c) / math.log(m) for c in texts.values()]))) < 1e-9
            else:
                assert math.isnan(row["content"])
            share = sum(p.words[n] for p in on for n in range(len(p.path)) if p.path[n] == path) / sum(p.words[0] for p in on)
            assert abs(row["share"] - share) < 1e-9


# --- 6


def test_forest_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    d, rows = 32, []
    for label in range(2):
        x = rng.standard_normal((700, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for c in range(6):  # clusters of near copies around the threshold
            s = x[c] + rng.standard_normal((40, d)) * rng.choice([0.015, 0.025, 0.03], (40, 1))
            x[100 + 40 * c:140 + 40 * c] = s
        x[690:700] = x[5]
        rows += [(label * 1000 + i, [float(v) for v in r], label) for i, r in enumerate(x)]
    rows += [(3000, None, 0), (3001, [0.0] * d, 0), (3002, [math.nan] * d, 0), (3003, rows[0][1], None), (3004, [None] * d, 1), (3005, [1.0], 1), (3006, [2 * v for v in rows[0][1]], 0), (3007, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    monkeypatch.setattr(rpforest, "LEAF", 64)
    links = {}
    usable = [(i, np.array(x), y) for i, x, y in rows if x and y is not None and len(x) == d and None not in x and np.isfinite(x).all() and any(x)]
    for label in (0, 1):
        ids = [i for i, _, y in usable if y == label]
        m = np.stack([x for _, x, y in usable if y == label])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        s = m @ m.T >= 0.98
        links |= {a: {b for b, hit in zip(ids, r) if hit and a != b} for a, r in zip(ids, s)}
    got = {r["id"]: r for r in rpforest.near_vectors(df).collect()}
    assert len(got) == len(rows)
    want, have = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert 0.98 * want <= have <= want and all(got[i]["n_links"] <= len(links.get(i, ())) for i in got)
    seen = {}
    for a in sorted(links):
        todo = [a]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen[b] = a if a not in seen else seen[a]
                todo += links[b]
    assert np.mean([got[i]["component_id"] == seen.get(i, i) for i in got]) > 0.98
    assert rpforest.near_vectors(df.limit(0)).count() == 0


def test_forest_keeps_links_of_a_dense_cluster(spark, monkeypatch):
    rng = np.random.default_rng(1)
    d, n = 32, 2100
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:700] = x[0] + rng.standard_normal((700, d)) * 0.025  # a third in one cluster, near the median of many splits
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(rpforest, "LEAF", 1)  # 12 levels
    got = rpforest.near_vectors(spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    want = (x @ x.T >= 0.98).sum(1) - 1
    have = {r["id"]: r["n_links"] for r in got.collect()}
    assert want.sum() > 10_000 and all(have[i] <= want[i] for i in range(n))
    assert sum(have.values()) >= 0.995 * want.sum()


def test_vectors_of_any_make(spark):
    rows = [(1, [1.0, None, 0.5], 0), (2, [1.0, 0.5], 0), (3, [1.0, 0.5], 0), (4, [2.0, 1.0], 0), (5, [1.0, 0.5, 0.0], 0), (6, [2.0, 1.0, 0.0], 0), (7, [0.0, 1.0, 0.0], 0), (7, [1.0, 0.5], 0), (None, [1.0, 0.5], 0),
            (8, [math.inf, 1.0], 0), (9, [1e200, 5e199], 0)]
    got = {}
    for r in rpforest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r["id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got == {1: [(0, 1, True)], 2: [(4, 2, True)], 3: [(4, 2, False)], 4: [(4, 2, False)], 9: [(4, 2, False)], 5: [(1, 5, True)], 6: [(1, 5, False)], 7: got[7], None: [(0, None, True)], 8: [(0, 8, True)]}
    assert sorted(got[7]) == [(0, 7, True), (4, 2, False)]  # one id with two vectors


def test_blocks_of_a_large_leaf_count_once():
    rng = np.random.default_rng(0)
    import pandas as pd

    x = rng.standard_normal(16) + rng.standard_normal((50, 16)) * 0.03
    part = pd.DataFrame({"id": range(50), "mult": rng.integers(1, 4, 50), "x": list(x)})
    whole, _ = rpforest.compare(part, None, 0, 0.98)
    total = {}
    for one, two in ((part[:20], None), (part[20:], None), (part[:20], part[20:])):
        for k, v in rpforest.compare(one, two, 0, 0.98)[0].items():
            total[k] = total.get(k, 0) + v
    assert total == whole


# --- 1


def test_surrogates(spark):
    rows = [(1, "Mr. John Smith wrote to Mrs. Anna Smith. Smith and John agreed; a.b@corp.example.org, c@corp.example.org.", "en", "a"), (2, "a.b@corp.example.org +49 (030) 555-1234 10.1.2.3 4111111111111111", "en", "a"),
            (3, "Господин Иванов; DE89370400440532013000; 123-45-6789; token f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "ru", "b"), (4, None, "en", "a"), (5, "nothing to see", "en", "a"), (2, "a.b@corp.example.org +49 (030) 555-1234 10.1.2.3 4111111111111111", "en", "a")]
    df = table(spark, rows)
    got = pii.pseudonymise(df, "key").orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[4]["text"] is None and by[5]["text"] == "nothing to see" and by[5]["pii"] == 0 and by[1]["key"] == "k"
    assert not any(x in (r["text"] or "") for r in got for x in ("Smith", "John", "Anna", "corp", "10.1.2.3", "4111", "Иванов", "532013", "6789", "f3ef4d"))
    first = re.match(r"Mr\. (\w+) (\w+) wrote to Mrs\. (\w+) (\w+)\. (\w+) and (\w+) agreed; (\S+)@(\S+), (\S+)@(\S+)\.$", by[1]["text"])
    given, family, _, family2, alone, given2, mail, domain, _, domain2 = first.groups()
    assert family == family2 == alone and given == given2 and domain == domain2 and domain.endswith(".org")
    assert by[2]["text"].startswith(f"{mail}@{domain} +49 ")  # one address, one surrogate, in all documents
    assert re.fullmatch(r"\S+@\S+ \+49 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ 4\d{15}", by[2]["text"])
    number = by[2]["text"].split()[-1]
    luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number)))
    assert luhn % 10 == 0
    name, iban, ssn, token = re.fullmatch(r"Господин (\S+); (\S+); (\S+); token (\S+)", by[3]["text"]).groups()
    assert re.fullmatch(r"[А-Я][а-я]+", name) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and re.fullmatch(r"[0-9a-f]{40}", token)
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert pii.pseudonymise(df, "other").where("doc_id = 2").first()["text"] != by[2]["text"]


def test_surrogates_stay_distinct(spark):
    values = [f"{a}.{b}.1.1" for a in range(1, 40) for b in range(40)] + [f"1{i:02d}-{i:02d}-{i:04d}" for i in range(100)]
    entities = spark.createDataFrame([("IP" if "." in v else "SSN", v) for v in values], "kind string, value string")
    done = pii.assign(entities, "k", common.Stages(spark, "t")).toPandas()
    assert sorted(done.value) == sorted(values) and done.surrogate.is_unique and not set(done.surrogate) & set(values)
    # forced collisions: one-digit values have only ten surrogates
    tiny = spark.createDataFrame([("SSN", str(i)) for i in range(4)], "kind string, value string")
    done = pii.assign(tiny, "k", common.Stages(spark, "t")).toPandas()
    assert done.surrogate.is_unique and not set(done.surrogate) & set("0123")


def test_names_outgrow_their_syllables(spark, monkeypatch):
    monkeypatch.setattr(pii, "LATIN", ("Al",))
    monkeypatch.setattr(pii, "LATIN_MORE", ("ba", "ca"))  # 30 surnames without more syllables
    values = [f"Name{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(40)] + ["Սարգսյան"]  # the last of a script without an alphabet
    done = pii.assign(spark.createDataFrame([("NAME_S", v) for v in values] + [("EMAIL", "անի@x.org")], "kind string, value string"), "k", common.Stages(spark, "t")).toPandas()
    assert len(done) == 42 and done.surrogate.is_unique and not set(done.surrogate) & set(done.value)


def test_surrogate_edges(spark):
    assert pii.pseudonymise(table(spark, edge_rows()), "key").count() == len(edge_rows())
    assert pii.pseudonymise(table(spark, edge_rows()).limit(0), "key").count() == 0


# --- 5


def test_tool_calls(spark):
    call = lambda i, name, args: {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}
    turns = [
        (1, 0, "user", "weather?"), (1, 1, "assistant", json.dumps({"content": "hm", "tool_calls": [call("c2", "sum", {"b": {"$ref": "c1"}, "a": 1.0}), call("c1", "get", {"city": "Ōsaka"})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "3"})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "2"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", 'x <tool_call>{"id": 5, "name": "get", "arguments": {"city": 7}}</tool_call>'), (2, 1, None, None), (3, 0, "assistant", "<tool_call>not json</tool_call>"),
        (4, 0, "assistant", json.dumps({"tool_calls": [call("a", "sum", {"a": {"$ref": "b"}}), call("b", "sum", {"a": {"$ref": "a"}})]})), (4, 1, "tool", json.dumps({"tool_call_id": "a"})), (4, 2, "tool", json.dumps({"tool_call_id": "b"})),
        (None, None, "tool", json.dumps({"tool_call_id": "a"})), (5, 0, "user", "same"), (5, 0, "user", "same")]
    schemas = {"get": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}, "sum": {"type": "object"}}
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("slot", F.lit(1))
    out = toolcalls.link(df, schemas).orderBy("conv_id", "slot", "level", "turn", "part").collect()
    one = [(r["kind"], r["call_id"], r["turn"], r["linked_turn"], r["status"]) for r in out if r["conv_id"] == 1]
    names = [(k, c) for k, c, *_ in one]
    assert names.index(("call", "c1")) < names.index(("result", "c1")) < names.index(("call", "c2")) < names.index(("result", "c2"))
    assert ("result", "zz", 4, None, "no call") in one and ("call", "c1", 1, 3, "ok") in one and ("result", "c2", 2, 1, "ok") in one
    texts = {(r["conv_id"], r["kind"], r["call_id"]): r for r in out}
    assert json.loads(texts[1, "call", "c2"]["json"])["arguments"] == {"a": 1, "b": {"$ref": "c1"}}
    assert texts[1, "call", "c2"]["json"] == '{"arguments":{"a":1,"b":{"$ref":"c1"}},"id":"c2","name":"sum","role":"assistant","type":"tool_call"}'
    assert texts[2, "call", "5"]["status"] == "$.city: not string" and texts[3, "call", None]["status"] == "no name"
    assert {r["status"] for r in out if r["conv_id"] == 4} == {"cycle"}
    assert sum(r["conv_id"] == 5 for r in out) == 2 and sum(r["conv_id"] is None for r in out) == 1
    assert toolcalls.link(df.limit(0)).count() == 0
    assert toolcalls.canonical({"b": [1.50, 2.0], "a": "é"}) == '{"a":"é","b":[1.5,2]}'
    assert toolcalls.violation({"n": [1, "x"]}, {"properties": {"n": {"items": {"type": "integer"}}}}) == "$.n[1]: not integer"


def test_a_cycle_leaves_other_chains_alone(spark):
    call = lambda i, ref: {"id": i, "function": {"name": "f", "arguments": {"a": {"$ref": ref}} if ref else {}}}
    deep = [call(f"c{i}", f"c{i - 1}" if i else None) for i in range(9)]
    turns = [(1, 0, "assistant", json.dumps({"tool_calls": deep}))] + [(1, 1, "tool", "".join(f'<tool_response>{{"id": "c{i}"}}</tool_response>' for i in range(9)))]
    turns += [(2, 0, "assistant", json.dumps({"tool_calls": [call("a", "b"), call("b", "a"), call("d", "a")]}))] + [(2, i, "tool", json.dumps({"tool_call_id": k})) for i, k in ((1, "a"), (2, "b"), (3, "d"))]
    out = toolcalls.link(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {r["status"] for r in out if r["conv_id"] == 1} == {"ok"} and {r["status"] for r in out if r["conv_id"] == 2} == {"cycle"}
    places = {(r["kind"], r["call_id"]): (r["slot"], r["level"]) for r in out if r["conv_id"] == 1}
    assert places["call", "c0"] == (0, 0) and all(places["result", f"c{i}"] == (1, 2 * i) for i in range(9)) and all(places["call", f"c{i}"] == (1, 2 * i - 1) for i in range(1, 9))


def test_schemas_that_conversations_declare(spark):
    tools = '<tools>[{"name": "f", "parameters": {"required": ["a"]}}, {"function": {"name": "g", "parameters": {"pattern": "("}}}, {"name": "f"}, 3]</tools>'
    call = lambda i, name, args: {"id": i, "function": {"name": name, "arguments": args}}
    many = json.dumps({"tool_calls": [call("1", "f", {"b": 1}), call("2", "f", {"a": 1}), call("3", "h", {})]})
    turns = [(1, 0, "system", f"Use these. {tools}"), (1, 1, "assistant", many), (2, 0, "user", tools), (2, 1, "assistant", many), (None, 0, "system", tools)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    status = lambda schemas: {(r["conv_id"], r["call_id"]): r["status"] for r in toolcalls.link(df, schemas).where("kind = 'call'").collect()}
    assert status(None) == {(1, "1"): "$.a: missing", (1, "2"): "unanswered", (1, "3"): "unknown tool", (2, "1"): "unanswered", (2, "2"): "unanswered", (2, "3"): "unanswered"}
    assert status({"h": {}}) == {(1, "1"): "$.a: missing", (1, "2"): "unanswered", (1, "3"): "unknown tool", (2, "1"): "unknown tool", (2, "2"): "unknown tool", (2, "3"): "unanswered"}


def test_derived_calls_hold_every_case(spark):
    found = toolcalls.tool_calls_derived(spark, "/root/testdata/sf0.01").groupBy("kind", "status").count().collect()
    assert {(r["kind"], r["status"]) for r in found} == {("call", "ok"), ("call", "unanswered"), ("call", "cycle"), ("call", "$.chars: maximum"), ("result", "ok"), ("result", "cycle")}
