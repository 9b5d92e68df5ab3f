"""The registered queries over stored tables, and the pipeline stage by stage."""

import re

import corpus_pipeline
import odd_rows
import pytest
from compare import compare, connect

from siftmark.llm import exact_dedup, mixing, quality_rules, queries, simhash
from siftmark.session import materialize

WITHOUT_SQL = {
    "op3_best_fit_packing", "op4_secret_automaton", "op5_certified_rules", "op6_ftrl_toxicity", "op7_co_training",
    "op8_prefix_free_parsing", "op10_simhash_components", "op11_transducer_bpe", "op12_merge_path_alignment",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.SQL[name]) is None


def test_queries_without_sql():
    assert set(queries.QUERIES) - set(queries.SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL - {"op3_best_fit_packing"}))
def test_one_row_per_document(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    assert found.count() == queries.documents(spark, folder).count()
    assert found.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_pairwise_join(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pipeline_stages(spark, folder, tmp_path):
    docs = queries.documents(spark, folder)
    columns = docs.columns
    judged = {r.doc_id: r.kept for r in queries.QUERIES["op5_certified_rules"](spark, folder).collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, folder).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if name == "quality rules":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, k in judged.items() if k)
        if name == "exact dedup":
            kept = exact_dedup.exact_groups(before).where("kept")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in kept.collect())
        if name == "near dedup":
            kept = simhash.near_duplicates(before).where("doc_id = component_id")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in kept.collect())
        if name == "mix sources":
            sized = before.selectExpr("*", "CAST(size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) AS LONG) AS size")
            want = {s: t for s, t in sized.groupBy("source").sum("size").collect()}
            targets = {r.source[1:]: r.target for r in mixing.source_targets(sized.selectExpr("concat('s', source) AS source", "size")).collect()}
            got = docs.selectExpr("source", "CAST(size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) AS LONG) AS size")
            for source, taken in got.groupBy("source").sum("size").collect():
                assert targets[source] - 256 <= taken <= min(targets[source], 2 * want[source])
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert docs.where("piece = 0").count() == before.count()


def test_run_gives_what_the_stages_give(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_odd_rows_whole(spark, folder, number):
    docs = odd_rows.frame(spark)
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, folder)
    assert out.schema == docs.schema
    found = [tuple(r) for r in out.collect()]
    rows = odd_rows.rows()
    if name == "mix sources":
        assert {r[0] for r in found} <= {r[0] for r in rows if (r[1] or "").split()}
    else:
        assert set(found) <= set(rows)
    if name == "quality rules":
        assert (None, "no id, " + rows[15][1][7:]) in {r[:2] for r in found}
    if name in ("exact dedup", "near dedup"):
        assert len(found) == len(set(found))
        assert sum(r[0] == 5 for r in found) == (name == "near dedup")  # 6 has more code points
    empty = stage(spark, odd_rows.empty(spark), folder)
    assert empty.collect() == []


def test_rows_that_differ_by_where_nulls_are_both_stay(spark, folder):
    schema = "doc_id long, text string, lang string, source string"
    text = " ".join(odd_rows.words(8, 300))
    rows = [(None, text, None, "x"), (None, text, "x", None), (None, text, "x", None)]
    keys = corpus_pipeline.whole_rows(spark.createDataFrame(rows, schema)).select("_key").distinct()
    assert keys.count() == 2
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, schema), folder)
    assert {r.source for r in out.collect()} == {"x", None}


def test_pack_stage_places_odd_rows(spark, folder):
    out = corpus_pipeline.pack(spark, odd_rows.frame(spark), folder)
    found = out.collect()
    assert sum(r.piece == 0 for r in found) == len(odd_rows.rows())
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= queries.CAPACITY
    assert corpus_pipeline.pack(spark, odd_rows.empty(spark), folder).collect() == []


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_mix_broadcasts_no_exploded_rows(spark):
    """Pieces and passes grow with the texts and their copies, not with the rows they are made of."""
    rows = [(i, "one two three " * 200, "en", "ab"[i % 2], 2800) for i in range(20)] + [(99, "x y z", "en", "a", 5)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.mix_sources(spark, docs, "")
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", final_plan(found))
    assert not [keys for keys in joins if re.search("_key|rank|_stretch", keys)]
    assert found.where("doc_id = 99").count() > 50


def test_rules_broadcast_no_labels(spark, monkeypatch):
    plans = {}

    def stored(df, label):
        plans[label] = final_plan(df)
        return materialize(df, label)

    monkeypatch.setattr(quality_rules, "materialize", stored)
    quality_rules.judged(odd_rows.frame(spark), odd_rows.labels(spark)).count()
    assert "SortMergeJoin" in plans["rule-counts"] and "Broadcast" not in plans["rule-counts"]
