import math
import random

import pytest

from siftmark.operators.annotation import RecordedAnnotator, build_requests, parse_responses
from siftmark.operators.clusters import cluster_window, sample_by_size, sample_fixed
from siftmark import fixed_values as fixed
from pyspark.sql import functions as F
import json


def members(seed):
    draw = random.Random(seed)
    rows = [(0, draw.choice([None, 1.0, 2.0, 3.0]), f"t{i}", i) for i in range(997)]
    rows += [(c, float(draw.randint(0, 9)), None if i % 5 == 0 else f"t{i}", 1000 + 40 * c + i)
             for c in range(1, 8) for i in range(c * 3)]
    return rows


def by_loop(rows, keep):
    chosen = set()
    for cluster in {r[0] for r in rows}:
        group = sorted(
            (r for r in rows if r[0] == cluster), key=lambda r: (r[1] is None, r[1] or 0.0, r[3])
        )
        chosen |= {r[3] for i, r in enumerate(group) if keep(i, len(group)) and r[2] is not None}
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_fixed_and_sized_samples(spark, seed):
    rows = members(seed)
    docs = spark.createDataFrame(rows, "cluster int, rank double, content string, id long").repartition(7)
    ten = {r.id for r in sample_fixed(docs, "id").collect()}
    assert ten == by_loop(rows, lambda i, n: i % math.ceil(n / 10) == 0)

    def sized(i, n):
        k = max(math.ceil(n / 60), 1)
        step = max(n // k, 1)
        return i % step == 0 and i // step < k

    assert {r.id for r in sample_by_size(docs, "id", 60).collect()} == by_loop(rows, sized)


def test_windows_of_a_hundred(spark):
    got = spark.range(3).select(cluster_window(F.col("id") * 99 + 1).alias("w")).collect()
    assert [r.w for r in got] == [0, 100, 100]


def test_requests_are_whole_and_answers_come_back(spark, tmp_path):
    text = 'a "quoted" line\nwith é and \\ backslash'
    docs = spark.createDataFrame([(3, 7, text), (4, None, "x")], "cluster int, rank int, content string")
    requests = build_requests(docs)
    first, second = (json.loads(r.request) for r in requests.orderBy("cluster").collect())
    assert first == {
        "custom_id": "task-cluster-3-rank-7",
        "method": "POST",
        "url": "/v1/chat/completions",
        "body": {
            "model": "gpt-4o-mini",
            "temperature": 0.1,
            "response_format": {"type": "json_object"},
            "messages": [
                {"role": "system", "content": fixed.ANNOTATOR_PROMPT},
                {"role": "user", "content": text},
            ],
        },
    }
    assert second["custom_id"] == "task-cluster-4-rank-None"
    answer = {"topic": "t", "selected topic": "History and events", "explanation": "é"}

    def response(ident, content):
        choices = [] if content is None else [{"message": {"content": content}}]
        return json.dumps({"custom_id": ident, "response": {"body": {"choices": choices}}})

    path = tmp_path / "answers.jsonl"
    path.write_text(
        "\n".join(
            [
                response("task-cluster-3-rank-7", json.dumps(answer)),
                response("task-cluster-4-rank-None", json.dumps({"topic": "u"})),
                response("task-cluster-9-rank-1", None),
            ]
        )
    )
    answers = RecordedAnnotator(str(path)).annotate(requests)
    rows = parse_responses(answers).orderBy("topic").collect()
    assert [tuple(r) for r in rows] == [
        ("3", "7", "t", "History and events", "é"),
        (None, None, "u", None, None),
    ]


@pytest.mark.parametrize("content", [None, "", "not json", "[]"])
def test_odd_answers_give_null_topics(spark, content):
    body = {"choices": [{"message": {"content": content}}]}
    line = json.dumps({"custom_id": "x task-cluster-1-rank-2 y", "response": {"body": body}})
    row = parse_responses(spark.createDataFrame([(line,)], "response string")).first()
    assert tuple(row) == ("1", "2", None, None, None)
