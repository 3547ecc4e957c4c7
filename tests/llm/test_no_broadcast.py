"""The searches for copies let Spark broadcast nothing, however small its estimates."""

import pytest
from tessera.llm import graph, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is written on the way."""
    seen = []
    for module in (graph, simhash):

        def keep(frame, write=module.cut_lineage):
            seen.append(frame._jdf.queryExecution().executedPlan().toString())
            return write(frame)

        monkeypatch.setattr(module, "cut_lineage", keep)
    return seen


def texts(spark, folder):
    """In a file, whose size Spark knows."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 40 + k % 20])) for k in range(40)] + [(40, words[0]), (41, None), (42, words[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/docs")
    return spark.read.parquet(f"{folder}/docs")


def test_groups(spark, plans, tmp_path):
    found = simhash.groups(texts(spark, tmp_path))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: r.component_id for r in found.collect()}[42] == 40
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_near_copies(spark, plans, monkeypatch, tmp_path):
    """Beyond ``BROADCAST_ROWS`` ids, which this sets to none."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    kept = simhash.without_copies(texts(spark, tmp_path))
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    ids = {r.doc_id for r in kept.collect()}
    assert 40 in ids and 42 not in ids
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
