"""Annotation in windows: stopped runs, failed requests, what was sent and when."""

import json

import pytest
from pyspark.sql import functions as F

from siftmark.plans.annotation_jobs import completed_labels, request_states, run_windows


class Scripted:
    """Answers by request and attempt; may stop the run."""

    def __init__(self, spark, good_from, stop_at=None):
        self.spark, self.good_from, self.stop_at, self.sent = spark, good_from, stop_at, []

    def annotate(self, requests):
        rows = [(r.custom_id, r.attempt) for r in requests.collect()]
        self.sent.append(sorted(rows, key=str))
        if len(self.sent) == self.stop_at:
            raise KeyboardInterrupt
        lines = []
        for name, attempt in rows:
            if name is None:
                continue
            good = self.good_from[name] <= attempt
            content = [{"message": {"content": json.dumps({"selected topic": "x"}) if good else "broken"}}]
            lines.append((json.dumps({"custom_id": name, "response": {"body": {"choices": content}}}),))
            lines.append(lines[-1])  # answers come twice
        return self.spark.createDataFrame(lines, "response string")


def requests_of(spark, names):
    rows = [(w, n and json.dumps({"custom_id": n})) for w, n in names]
    return spark.createDataFrame(rows, "window int, request string").coalesce(1)


@pytest.mark.parametrize("stop_at", [1, 2, 3])
def test_stopped_windows_go_on_and_only_failures_are_sent_again(spark, tmp_path, stop_at):
    requests = requests_of(spark, [(0, "a"), (0, "b"), (0, "b"), (1, "c"), (1, None), (3, "z")])
    good_from = {"a": 1, "b": 2, "c": 9}
    whole = [
        [("a", 1), ("b", 1)],
        [("b", 2)],
        sorted([(None, 1), ("c", 1)], key=str),
        sorted([(None, 2), ("c", 2)], key=str),
    ]
    first = Scripted(spark, good_from, stop_at)
    with pytest.raises(KeyboardInterrupt):
        run_windows(requests, first, str(tmp_path), [0, 1], attempts=2)
    assert first.sent == whole[:stop_at]
    states = {r.custom_id: r.state for r in request_states(spark, str(tmp_path)).collect()}
    assert states == [{"a": "submitted", "b": "submitted"}, {"a": "completed", "b": "submitted"}, {"a": "completed", "b": "completed", "c": "submitted", None: "submitted"}][stop_at - 1]
    again = Scripted(spark, good_from)
    run_windows(requests, again, str(tmp_path), [0, 1, 2], attempts=2)
    assert [s for s in again.sent if s] == whole[stop_at - 1 :]
    rows = {r.custom_id: (r.window, r.state, r.attempts) for r in request_states(spark, str(tmp_path)).collect()}
    assert rows == {"a": (0, "completed", 1), "b": (0, "completed", 2), "c": (1, "failed", 2), None: (1, "failed", 2)}
    labels = completed_labels(spark, str(tmp_path)).select("custom_id", "selected_topic").collect()
    assert sorted(labels) == [("a", "x"), ("b", "x")]


def test_nothing_sent_yet(spark, tmp_path):
    assert request_states(spark, str(tmp_path)).collect() == []
    assert completed_labels(spark, str(tmp_path)).where(F.lit(True)).collect() == []
