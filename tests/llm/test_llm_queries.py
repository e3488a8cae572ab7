"""The registered queries and the pipeline."""

import pytest
from oracle import connect, differences

import corpus_pipeline
from nearfield.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], connect(SF)) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_native_operators_run_no_python(spark):
    for name in ("op2_perspectives", "op8_license_spans", "op10_water_filled_mix", "op13_exact_classes"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan, name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, rows = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert stage(spark, docs.limit(0), SF).collect() == []
            rows = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(out.count())
    assert docs.count() >= seen[0] > seen[1] > seen[2] > 0 and seen[3] == seen[4]
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]
