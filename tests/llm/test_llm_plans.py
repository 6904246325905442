"""Physical plans of the corpus queries and the pipeline, those of intermediate tables included."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

from lamina.llm import queries

NATIVE = ("op2_quality_rules", "op4_sharding", "op7_url_filters", "op8_source_mixing")
PYTHON = re.compile(r"Python|Pandas|Arrow")


def executed(spark, run) -> list[str]:
    """The plans of every execution that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList()
    last = max((before.apply(i).executionId() for i in range(before.size())), default=-1)
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    after = store.executionsList()
    rows = [after.apply(i) for i in range(after.size())]
    return [row.physicalPlanDescription() for row in rows if row.executionId() > last]


def written(df) -> None:
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_plans(spark, sf_dir, name):
    plans = executed(spark, lambda: written(queries.QUERIES[name](spark, sf_dir)))
    assert plans
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert name not in NATIVE or not PYTHON.search(text)


def test_pipeline_plans(spark, sf_dir):
    plans = executed(spark, lambda: written(corpus_pipeline.run(spark, sf_dir)))
    assert len(plans) > len(corpus_pipeline.STAGES)
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
