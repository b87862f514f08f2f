"""Queries against their SQL at the smallest scale, and the pipeline against its operators' brute force."""

import duckdb
import pandas as pd
import pytest
from test_operators import contamination_brute, near_brute

import corpus_pipeline
from lagstream.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    order = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(registry.queries()[name](spark, DIR).toPandas()), order(duck.sql(registry.oracle_sql()[name]).df()), check_dtype=False, rtol=1e-9)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.Stages(spark, "t").put(stage(spark, docs, DIR), name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS and set(kept[name]) <= set(before)
        if name == "near_duplicates":
            want = near_brute([(i, r["text"]) for i, r in before.items()], 80)
            assert set(kept[name]) == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            old = contamination_brute([(i, r["text"]) for i, r in before.items()], bench)
            new = contamination_brute([(i, r["text"]) for i, r in kept[name].items()], bench)
            assert all(n == 0 for _, n, _ in new.values())
            assert all(kept[name][i]["text"] == before[i]["text"] for i in before if old[i][1] == 0)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert mixed.position.is_monotonic_increasing and set(mixed.doc_id) <= set(kept["personal_data"])


def test_language_stage_acts_on_the_decision(spark):
    en, fr = "the and of to in that this with from house green water stone ", "le la les des une pour dans avec sur maison verte eau pierre "
    rows = [(i, (en, fr)[i % 2] * 3, ("en", "fr")[i % 2], "a") for i in range(40)] + [(100, fr * 4, "en", "a"), (101, en * 2, None, "a"), (102, "12345", "en", "a"), (None, "###", "en", "a"), (103, en, "en", "a"), (103, fr, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.language_id(spark, docs, DIR).collect()))
    want = {**{i: lang for i, _, lang, _ in rows[:40]}, 100: "fr", 101: "en"}
    assert out == sorted([(i, t, want[i]) for i, t, _, _ in rows if i in want] + [(103, en, "en"), (103, fr, "fr")])


def test_stages_take_edge_rows(spark):
    from test_operators import edge_rows, table

    docs = table(spark, edge_rows()).select(*corpus_pipeline.COLUMNS, "key", "id")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
        assert out.count() >= 0
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_run_leaves_its_last_stage_only(spark):
    from pathlib import Path

    from lagstream.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {p for p in folder.rglob("_SUCCESS")}
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and out.columns[:5] == corpus_pipeline.COLUMNS
    left = [p.parent.name for p in folder.rglob("_SUCCESS") if p not in before]
    assert left == [f"00{len(corpus_pipeline.STAGES)}-source_mixing"]
