import math
import random

import pytest
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators import weights as w

ORDER = [("quality", k) for k in fixed.QUALITY_KEYS]
ORDER += [("domain", k) for k in fixed.DOMAIN_KEYS]
ORDER += [("topic", k) for k in fixed.TOPIC_KEYS]


def losses_by_loop(lines):
    found = {key: [] for key in ORDER}
    for family, key, _, values in sorted(lines, key=lambda r: r[2]):
        found.setdefault((family, key), []).extend(values or [])
    return found


def update_by_loop(losses, start, collaboration, eta=0.1):
    weights = dict(start)
    for key in ORDER:
        for loss in losses[key]:
            weights[key] = (1 - eta) * weights[key] + eta * math.exp(0.5 * loss)
    for family in ("quality", "domain", "topic"):
        total = sum(v for (f, _), v in weights.items() if f == family)
        weights = {k: (v / total if k[0] == family else v) for k, v in weights.items()}
    s = [
        weights[k] * (math.exp(0.6 * losses[k][-1]) / 100 - 1) / len(losses[k])
        for k in ORDER
        if losses[k]
    ]
    mean = sum(s) / len(s)
    moved = [c + (s[i] - mean) for i, c in enumerate(collaboration)]
    return weights, [m / sum(moved) for m in moved]


@pytest.fixture(scope="module")
def lines():
    draw = random.Random(11)
    rows = []
    for i in range(600):
        # one category holds a third of all lines
        family, key = ORDER[6] if i % 3 == 0 else ORDER[i % 25]
        values = None if i % 50 == 7 else [draw.uniform(-1, 6) for _ in range(draw.randint(0, 3))]
        rows.append((family, key, i, values))
    rows.append(("topic", "topic_99", 1000, [5.0]))
    return rows


SCHEMA = "family string, key string, line_no long, influence array<double>"


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_folded_weights_equal_the_sequential_update(spark, lines, bits):
    frame = spark.createDataFrame(lines, SCHEMA).repartition(6)
    losses = losses_by_loop(lines)
    got = {(r.family, r.key): r for r in w.fold_losses(frame, w.AgentWeights(), block_bits=bits).collect()}
    assert list(sorted(got)) == sorted(ORDER)
    for key in ORDER:
        weight = 10.0
        for loss in losses[key]:
            weight = 0.9 * weight + 0.1 * math.exp(0.5 * loss)
        assert got[key].weight == pytest.approx(weight, rel=1e-12)
        assert got[key].n == len(losses[key])
        assert got[key].last_loss == losses[key][-1]


def test_two_whole_updates(spark, lines):
    frame = spark.createDataFrame(lines, SCHEMA)
    losses = losses_by_loop(lines)
    first = w.update_weights(frame, w.AgentWeights())
    second = w.update_weights(frame, first)
    expected = {k: 10.0 for k in ORDER}, [1 / 3] * 3
    for got in (first, second):
        expected = update_by_loop(losses, *expected)
        for family, key in ORDER:
            assert got.family(family)[key] == pytest.approx(expected[0][family, key], rel=1e-12)
        assert got.collaboration == pytest.approx(expected[1], rel=1e-12)
        assert sum(got.collaboration) == pytest.approx(1)


def test_a_category_without_losses_keeps_its_weight_and_has_no_s(spark):
    frame = spark.createDataFrame([("domain", "c4", 0, [1.0])], SCHEMA)
    rows = w.s_values(w.normalize_families(w.fold_losses(frame, w.AgentWeights()))).collect()
    got = {r.key: r for r in rows}
    assert got["topic_0"].weight == pytest.approx(1 / 13) and got["topic_0"].s is None
    assert got["c4"].s is not None


def test_collaboration_uses_beta_and_the_first_three_values(spark):
    values = [0.5, -0.2, 0.1, 0.4, -0.3]
    frame = spark.createDataFrame(list(enumerate(values)), "ord int, s double")
    rule = w.UpdateRule(beta=2.0)
    got = [r.weight for r in w.collaborate(frame, [0.2, 0.3, 0.5], rule).orderBy("agent").collect()]
    mean = sum(values) / 5
    moved = [
        c + math.copysign(abs(v - mean) ** 2, v - mean) for c, v in zip([0.2, 0.3, 0.5], values)
    ]
    assert got == pytest.approx([m / sum(moved) for m in moved])


def test_flattened_positions_follow_line_and_list_order(spark, lines):
    frame = spark.createDataFrame(lines, SCHEMA).repartition(4)
    got = w.flatten_influence(frame).where(F.col("key") == "c4").orderBy("position").collect()
    expected = losses_by_loop(lines)["domain", "c4"]
    assert [r.loss for r in got] == expected and [r.position for r in got] == list(range(len(expected)))


def test_json_round_trip():
    weights = w.AgentWeights(collaboration=[0.2, 0.3, 0.5])
    again = w.AgentWeights.from_json(weights.agent_json(), weights.collaboration_json())
    assert again == weights and list(again.topic) == list(fixed.TOPIC_KEYS)
