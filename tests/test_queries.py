"""Every registered query against its SQL over the smallest stored tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from siftmark.plans import file_queries

SQL = {k: v for k, v in contract.oracle_sql().items() if k not in contract.LLM_SQL}
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}
MODEL_QUERIES = {"mllib_topic_classifier"}


@pytest.fixture(scope="module")
def tables(folder):
    return connect(folder)


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(SQL) == MODEL_QUERIES
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, tables, name):
    assert compare(QUERIES[name](spark, folder), tables, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(MODEL_QUERIES))
def test_model_query_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry_runs_with_a_stable_schema(spark):
    assert contract.entry(spark).columns == ["doc_id", "score", "selection"]


# The two stored-table paths must not read what they do not need.
PLAN_CASES = {"score_documents": "text", "full_iteration": "text", "slice_plain": "props"}


@pytest.mark.parametrize("name", sorted(PLAN_CASES))
def test_scan_reads_only_needed_columns(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for schema in plan.split("ReadSchema: ")[1:]:
        assert f"{PLAN_CASES[name]}:" not in schema.split("\n")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def final_plan(df):
    """The plan that ran, without the one it began with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name,shuffles", [("score_documents", 0), ("score_drop_rules", 0), ("match_influence", 0), ("class_report", 3)])
def test_shuffles_of_the_plan_that_ran(spark, folder, name, shuffles):
    plan = final_plan(QUERIES[name](spark, folder))
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= shuffles


def test_a_line_is_parsed_once(spark, folder):
    from siftmark.operators.scoring import score_records
    from siftmark.plans.queries import ladder
    from siftmark.plans.tables import raw_lines
    from siftmark.sources.corpus import parse_records

    plan = final_plan(score_records(parse_records(raw_lines(spark, folder)), ladder()))
    assert plan.count("from_json(") == 1


def test_class_report_reads_its_table_once(spark, folder):
    assert final_plan(QUERIES["class_report"](spark, folder)).count("FileScan") == 1


def test_tydiqa_file_holds_one_example_a_language(spark, folder, monkeypatch):
    written, write = [], file_queries._one_object

    def spy(rows, *args):
        written.extend(rows.collect())
        write(rows, *args)

    monkeypatch.setattr(file_queries, "_one_object", spy)
    assert contract.queries()["file_tydiqa"](spark, folder).count() == len(written)
    assert all(len(r.examples) == 1 for r in written)
