"""Chains of operators over files: labelling, and gradient matching."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import words
from siftmark.functions.vectors import last_state
from siftmark.operators.annotation import RecordedAnnotator
from siftmark.operators.clusters import sample_fixed
from siftmark.operators.metrics import mean_cross_entropy
from siftmark.operators.providers import TokenShares, apply_and_store
from siftmark.plans import file_queries, gradient_scores, topic_labels
from siftmark.sources.corpus import read_clusters, read_training
from siftmark.sources.evaluation import read_items, read_json_items


def test_labelling_from_folders_to_report(spark, tmp_path):
    themes = {0: "sun moon star sky", 1: "goal ball team kick"}
    for cluster in (0, 1, 120):
        folder = tmp_path / "clusters" / f"clustering-{cluster}"
        folder.mkdir(parents=True)
        # neighbouring fractional ranks share their whole part
        rows = [{"rank": i / 4, "content": f"{themes[cluster % 2]} {i}"} for i in range(40)]
        (folder / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    base, output = str(tmp_path / "clusters"), str(tmp_path / "requests")
    topic_labels.write_requests(spark, base, 0, 199, output)
    requests = spark.read.text(output).select("window", F.col("value").alias("request"))
    assert {r.window: r["count"] for r in requests.groupBy("window").count().collect()} == {0: 20, 100: 10}

    answers = []
    for r in requests.collect():
        ident = json.loads(r.request)["custom_id"]
        topic = fixed.TOPIC_NAMES[6 if "cluster-1-" in ident else 7]
        content = json.dumps({"topic": "t", "selected topic": topic, "explanation": "e"})
        answers.append(
            {"custom_id": ident, "response": {"body": {"choices": [{"message": {"content": content}}]}}}
        )
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    labels = topic_labels.label_documents(requests, RecordedAnnotator(str(tmp_path / "answers.jsonl")))
    sampled = sample_fixed(read_clusters(spark, base, 0, 199), "tie")
    examples = topic_labels.labelled_examples(sampled, labels)
    assert examples.count() == 30 and {r.label for r in examples.collect()} == {0, 1}
    examples = examples.withColumn("doc", F.concat_ws("/", F.col("cluster").cast("string"), "tie"))
    model, report = topic_labels.fit_and_report(examples, "doc", seed=4)
    assert report.where("name = 'accuracy'").first().precision == 1.0


def test_training_slices_and_chunks(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text("\n".join(json.dumps({"content": f"w{i} " * 20}) for i in range(2600)))
    lines = read_training(spark, str(tmp_path))
    sizes = [gradient_scores.training_chunks(lines, slice_no=s).count() for s in range(4)]
    assert sizes == [1249, 1250, 101, 0]
    half = gradient_scores.training_chunks(lines, window=8, slice_no=2, share=0.5, seed=1)
    assert half.select("line_no").distinct().count() == 50
    first = half.where("chunk_no = 1").first()
    assert first.start == 6 and len(first.input_ids) == 8


def test_evaluation_set_is_capped_and_repeatable(spark, tmp_path):
    spark.range(700, numPartitions=2).selectExpr("concat('s', id) AS until_last", "'w' AS last_word").write.parquet(
        f"{tmp_path}/items"
    )
    items = read_items(spark, f"{tmp_path}/items")
    assert sorted(r.item_no for r in items.collect()) == list(range(700))
    got = gradient_scores.evaluation_set(items, "lambada", words, seed=2, ignore=F.lit("-"))
    again = gradient_scores.evaluation_set(items.repartition(5), "lambada", words, seed=2, ignore=F.lit("-"))
    assert got.count() == 500
    assert {r.item_no for r in got.collect()} == {r.item_no for r in again.collect()}
    row = got.first()
    assert row.labels[-1] == "w" and set(row.labels[:-1]) == {"-"}

    lines = [json.dumps({"context": "c", "question": f"q{i}", "answers": {"text": ["a"]}}) for i in range(600)]
    (tmp_path / "squad.jsonl").write_text("\n".join(lines))
    schema = "context string, question string, answers struct<text: array<string>>"
    squad = read_json_items(spark, f"{tmp_path}", schema)
    kept = gradient_scores.evaluation_set(squad, "squad", words, ignore=F.lit("-")).collect()
    assert len(kept) == 500 and max(r.item_no for r in kept) <= 500


def test_stored_vectors_are_matched(spark, tmp_path):
    draw = np.random.default_rng(0)
    train, held = draw.normal(size=(2, 20, 40)), draw.normal(size=(2, 18, 40))

    def store(block, name):
        rows = [(c, i, v.tolist()) for c in (0, 1) for i, v in enumerate(block[c])]
        frame = spark.createDataFrame(rows, f"ckpt int, {name} long, vector array<double>")
        gradient_scores.project_and_normalize(frame, 16, 3).write.parquet(f"{tmp_path}/{name}")
        return {(r.ckpt, r[name]): np.array(r.vector) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    t, v = store(train, "train_id"), store(held, "position")
    assert all(np.linalg.norm(x) == pytest.approx(1) for x in t.values())
    got = gradient_scores.match_stored(
        spark, f"{tmp_path}/train_id", f"{tmp_path}/position", "tydiqa", {0: 1.0, 1: 1.0}, f"{tmp_path}/scores"
    )
    for r in got.collect():
        pair = [sum(0.5 * t[c, r.train_id] @ v[c, j] for c in (0, 1)) for j in range(18)]
        assert r.score == pytest.approx(max(np.mean(pair[2 * s : 2 * s + 2]) for s in range(9)))


def test_interrupted_provider_runs_continue(spark, tmp_path):
    model = TokenShares(3)
    rows = spark.createDataFrame([(i, [i % 3]) for i in range(10)], "id long, tokens array<int>")
    path = f"{tmp_path}/out"
    assert apply_and_store(rows.where("id < 4"), "id", "tokens", model, "g", path).count() == 4
    done = apply_and_store(rows, "id", "tokens", model, "g", path)
    assert sorted(r.id for r in done.collect()) == list(range(10))


def test_interrupted_provider_gives_each_row_its_loss(spark, tmp_path):
    texts = ["a", "b b c", "", None, "a b c d e f g h", "x " * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.influence for r in file_queries.interrupted_provider(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(6))
    for i, text in enumerate(texts):
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in (text or "").split()]
        gradient = 1 / 64 - np.bincount(ids, minlength=64) / max(len(ids), 1)
        gradient = gradient * min(1, 1 / np.linalg.norm(gradient))
        stepped = -0.001 * gradient / (np.abs(gradient) + 1e-8)
        assert got[i] == pytest.approx(np.log(np.exp(stepped).sum()) - stepped.mean(), abs=1e-6)


def test_last_state_and_mean_loss(spark):
    row = spark.sql("SELECT array(array(1D), array(2D), array(3D)) s, array(1, 1, 0) m").select(
        last_state(F.col("s"), F.col("m"))
    ).first()
    assert row[0] == [2.0]
    losses = spark.createDataFrame([(1.0,), (None,), (2.0,)], "loss double")
    assert mean_cross_entropy(losses).first().loss == 1.5
    assert mean_cross_entropy(losses.where("loss IS NULL")).first().loss == 0.0
