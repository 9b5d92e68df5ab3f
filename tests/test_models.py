"""The topic classifier and weights that follow a stream."""

import json
import random

import pytest

from siftmark.operators import classifier
from siftmark.operators.weights import AgentWeights, update_weights
from siftmark.sources.weight_files import load_weights
from siftmark.streaming.weight_rounds import follow_influences


def test_classifier_learns_separable_topics(spark):
    draw = random.Random(1)
    vocabulary = {0: "sun moon star".split(), 1: "goal ball team".split(), 2: "flour salt oven".split()}
    rows = [(i, " ".join(draw.choices(vocabulary[i % 3 if i < 60 else 0], k=6)), i % 3 if i < 60 else 0) for i in range(90)]
    frame = spark.createDataFrame(rows, "id int, content string, label int")
    model = classifier.train_classifier(frame, features=512, weighted=True)
    got = classifier.predict(model, frame).collect()
    assert all(r.pred == r.label and len(r.logits) == 3 for r in got)
    balance = {r.label: r.weight for r in classifier.class_weights(frame).collect()}
    assert balance == pytest.approx({0: 90 / (3 * 50), 1: 90 / (3 * 20), 2: 90 / (3 * 20)})


def test_streamed_rounds_equal_batch_rounds(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    draw = random.Random(6)
    keys = [(f, k) for f in ("quality", "domain", "topic") for k in AgentWeights().family(f)]
    weights_folder, checkpoint = str(tmp_path / "w"), str(tmp_path / "cp")
    expected = AgentWeights()
    for number in (1, 2):
        rows = [
            {"family": f, "key": k, "line_no": i, "influence": [draw.uniform(0, 4)]}
            for f, k in keys for i in range(3)
        ]
        path = source / f"part{number}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        follow_influences(spark, str(source), weights_folder, checkpoint).awaitTermination()
        expected = update_weights(spark.read.json(str(path)), expected)
        got = load_weights(spark, weights_folder, number)
        for family in ("quality", "domain", "topic"):
            assert got.family(family) == pytest.approx(expected.family(family), rel=1e-12)
        assert got.collaboration == pytest.approx(expected.collaboration, rel=1e-12)
