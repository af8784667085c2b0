"""The pipeline's stages one by one against plain rules, and the SQL of the operators that have it."""

import pytest

import corpus_pipeline
from retrigauge.llm import registry, shared
from retrigauge.llm.shared import table

from ..conftest import DATA
from ..test_oracle import rows


def test_stages(spark):
    docs = table(spark, str(DATA), "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, str(DATA)).cache()
        after = docs.collect()
        assert docs.columns == columns and after
        ids = [r.doc_id for r in after]
        if name == "language_id":
            assert before - set(ids) <= {k for k, x in texts.items() if sum(c.isalpha() for c in x) < 8}
        if name == "line_dedup":
            assert set(ids) == before and all(set((r.text or "").split("\n")) <= {*texts[r.doc_id].split("\n"), ""} and r.n_chars == len(r.text) for r in after)
        if name == "simhash_dedup":
            assert set(ids) <= before and len(ids) == len(set(ids))
        if name == "mixing":
            assert set(ids) <= before and max(ids.count(k) for k in set(ids)) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_null_and_empty_tables(spark):
    empty = table(spark, str(DATA), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0


def test_near_dedup_sends_nothing_through_the_driver_by_file_size(spark, monkeypatch):
    monkeypatch.setattr(shared, "WHOLE_ROWS", 0)  # every table counts as large
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # joins that turn to a broadcast by what a shuffle has held are not meant
    try:
        words = [f"w{i * i % 977}" for i in range(400)]
        rows = [(k, " ".join([*words, *[f"end{k}"] * (k > 0)]), "s", "en", 0) for k in range(6)] + [(9, "another text of its own", "s", "en", 0)]
        docs = shared.written(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), "docs")
        store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty()
        seen = {x.executionId() for x in _listed(store.executionsList())}
        assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, str(DATA)).collect()) == [0, 9]
        bus.waitUntilEmpty()
        plans = [x.physicalPlanDescription() for x in _listed(store.executionsList()) if x.executionId() not in seen]
        assert len(plans) > 8 and not [x for x in plans if "BroadcastExchange" in x]
    finally:
        spark.conf.unset(key)


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
