import random

import pytest
from pyspark.sql import functions as F

from siftmark.operators.ordering import running_total, sorted_positions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("spread", [1, 7919, 2**40 + 1])
def test_running_total_matches_a_loop(spark, spread):
    draw = random.Random(spread)
    ids = [i * spread for i in range(400)]
    # group "a" holds most of the rows
    rows = [(draw.choice("aaaaaab"), i, draw.randint(0, 5)) for i in ids]
    got = running_total(
        frame(spark, rows, "g string, id long, n long"), "id", F.col("n"), ["g"], bits=3, upper=4
    ).collect()
    seen = {"a": 0, "b": 0}
    expected = {}
    for group, ident, n in sorted(rows, key=lambda r: r[1]):
        expected[ident] = seen[group]
        seen[group] += n
    assert {r.id: r.position for r in got} == expected


def test_running_total_without_groups_or_sizes(spark):
    got = running_total(frame(spark, [(i * 3,) for i in range(50)], "id long"), "id", bits=2, upper=2)
    assert sorted((r.id, r.position) for r in got.collect()) == [(i * 3, i) for i in range(50)]


def test_sorted_positions_with_ties_nulls_and_a_hot_group(spark):
    draw = random.Random(3)
    rows = [("hot", draw.choice([None, 1.0, 2.0, 2.0]), i) for i in range(500)]
    rows += [(f"g{i % 7}", float(i % 3), 1000 + i) for i in range(40)]
    got = sorted_positions(
        frame(spark, rows, "g string, rank double, id long"),
        ["g"],
        [F.col("rank").asc_nulls_last(), F.col("id")],
        count="n",
    ).collect()
    groups = {}
    for g, rank, ident in rows:
        groups.setdefault(g, []).append((rank is None, rank or 0.0, ident))
    expected = {
        ident: (i, len(members))
        for members in groups.values()
        for i, (_, _, ident) in enumerate(sorted(members))
    }
    assert {r.id: (r.position, r.n) for r in got} == expected


def test_hot_group_is_cut_into_several_partitions(spark):
    rows = [("hot", float(i), i) for i in range(5000)]
    keys = [F.col("g"), F.col("rank"), F.col("id")]
    cut = frame(spark, rows, "g string, rank double, id long").repartitionByRange(8, *keys)
    sizes = cut.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 2500
