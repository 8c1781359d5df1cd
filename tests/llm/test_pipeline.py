"""The pipeline's stages against plain checks of their decisions, and the queries that have SQL."""

import collections

import corpus_pipeline
import pytest
from check_oracle import connect, difference

from fluxprint.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    from fluxprint.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in rows} <= before and rows
        if name == "near_duplicates":
            assert max(collections.Counter(r.text for r in rows if r.text).values()) == 1
        if name == "decontamination":
            assert not [r for r in rows for b in bench if b in r.text]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    sizes = collections.Counter(r["shard"] for r in last.collect())
    assert last.count() == docs.count() and last.columns == [*columns, "shard", "slot"]
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None
