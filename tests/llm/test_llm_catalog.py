"""Every registered query of the package on the smallest tables, and the pipeline stage by stage against brute force."""

import re

import pytest
from compare import differences, duck
from test_llm_rules_and_join import by_brute_force
from test_llm_text_operators import swap

import __spark_entry__ as entry
import corpus_pipeline
from khata.llm import catalog, pii

NATIVE = ("op1_quality_rules", "op7_pii")


def test_all_are_registered():
    assert set(catalog.QUERIES) <= set(entry.queries()) and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in catalog.QUERIES if k != "pipeline"}
    assert corpus_pipeline.ORACLE_SQL is None or entry.oracle_sql()["pipeline"] == corpus_pipeline.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, folder, name):
    assert differences(catalog.QUERIES[name](spark, folder), duck(folder), catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_pipeline_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            continue
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = catalog.QUERIES["op1_quality_rules"](spark, folder).filter("kept").collect()
    assert set(kept["quality_rules"]) == {r.doc_id for r in first}
    rows = sorted(kept["quality_rules"].items())
    assert set(kept["ngram_jaccard_join"]) == {doc for doc, _, component in by_brute_force(rows, 5, 80) if doc == component}
    dropped = set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"])
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {d for d, t in kept["ngram_jaccard_join"].items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert whole <= dropped
    assert kept["pii"] == {d: re.sub(pii.PATTERN, swap, t) for d, t in kept["benchmark_decontamination"].items()}


def test_documents_that_repeat_survive_the_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() >= packed.select("doc_id").distinct().count() > 0
