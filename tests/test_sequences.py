import os
import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmark.functions import text
from siftmark.functions.schedule import round_up, step_flops, wsd_lr
from siftmark.operators import sampling, sequences
from siftmark.plans import file_queries, further_queries
from siftmark.sources import packed
from siftmark.sources.packed_source import register_packed


@pytest.mark.parametrize("limit", [None, 1024])
@pytest.mark.parametrize("size", [1024, 512, 300, 100, 7])
def test_overlapping_windows(spark, size, limit):
    draw = random.Random(size)
    lengths = [0, 1, size - 1, size, size + 1, 900, 1500, 2300]
    rows = [(i, list(range(draw.choice(lengths)))) for i in range(30)]
    got = sequences.overlap_chunks(spark.createDataFrame(rows, "id int, t array<int>"), "t", size, limit)
    found = {i: [] for i, _ in rows}
    for r in got.orderBy("id", "chunk_no").collect():
        assert r.chunk_no == len(found[r.id])
        found[r.id].append(r.input_ids)
    for i, tokens in rows:
        chunks = found[i]
        assert bool(chunks) == bool(tokens)
        for before, after in zip(chunks, chunks[1:]):
            assert before[size - size // 4 :] == after[: size // 4][: len(before) - (size - size // 4)]
            assert after[0] - before[0] == size - size // 4
        covered = {t for c in chunks for t in c}
        assert covered >= set(tokens[: limit or len(tokens)])
        assert all(c == tokens[c[0] : c[0] + size] for c in chunks)
        if limit:  # all but the last end before the stop
            assert all(c[0] + size < limit for c in chunks[:-1])
        elif chunks:
            assert chunks[-1][0] + size - size // 4 >= len(tokens)


@pytest.mark.parametrize("lengths", [[], [0, 0], [8], [16, 16], [3, 40, 0, 5, 8, 1], [1] * 100, [200]])
def test_packing(spark, lengths):
    draw = random.Random(2)
    ids = sorted(draw.sample(range(10**12), len(lengths)))
    rows = [(i, [draw.randint(1, 99) for _ in range(n)]) for i, n in zip(ids, lengths)]
    frame = spark.createDataFrame(rows, "id long, t array<int>").repartition(3)
    got = sequences.pack_tokens(frame, "id", "t", 8, F.lit(0)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(max(1, -(-sum(lengths) // 8))))
    packed_tokens = [t for r in got for t in r.tokens]
    real = [t for _, tokens in rows for t in tokens]
    assert packed_tokens == real + [0] * (len(got) * 8 - len(real))


@pytest.mark.parametrize("dtype, code", [("uint16", 8), ("int32", 4), ("int64", 5), ("uint8", 1)])
def test_packed_files(spark, tmp_path, dtype, code):
    rows = [(i, [i, 1, 2, 200]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id long, tokens array<int>")
    assert packed.write_packed(chunks, f"file://{tmp_path}/p", "train", dtype) == 12
    assert packed.write_packed(chunks, f"file://{tmp_path}/p", "train", dtype) == 12
    content = (tmp_path / "p" / "train_0000000003.bin").read_bytes()
    assert content[:24] == b"LITPKDS" + struct.pack("<Q", 1) + struct.pack("<B", code) + struct.pack("<Q", 4)
    assert np.frombuffer(content[24:], dtype).tolist() == [3, 1, 2, 200]
    got = packed.read_packed(spark, f"{tmp_path}/p", "train").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.tokens) for r in got] == rows
    assert (packed.dtype_for(65499), packed.dtype_for(65500)) == ("uint16", "int32")
    with pytest.raises(ValueError):
        packed.decode_chunk(b"x" * 40)
    with pytest.raises(ValueError):
        packed.dtype_code("float16")


@pytest.mark.parametrize("chunks", [7, 6, 1, 2])
def test_blocks_and_their_order(spark, chunks):
    frame = spark.createDataFrame([(i, list(range(10))) for i in range(chunks)], "chunk_id long, tokens array<int>")
    blocks = sequences.blocks_of(frame, 10, 3)
    assert blocks.count() == 3 * chunks
    order = sampling.permute_blocks(blocks, 3, 3, seed=1).orderBy("read_order").collect()
    assert [r.read_order for r in order] == list(range(chunks // 3 * 9))
    if order:
        assert {(r.chunk_id, r.block_id) for r in order[:9]} == {(c, b) for c in range(3) for b in range(3)}
    again = sampling.permute_blocks(blocks.repartition(5), 3, 3, seed=1).orderBy("read_order").collect()
    assert [(r.chunk_id, r.block_id) for r in again] == [(r.chunk_id, r.block_id) for r in order]

    wrapped = sampling.permute_blocks(blocks, 3, 3, seed=1, wrap=True).orderBy("read_order").collect()
    assert [r.read_order for r in wrapped] == list(range(-(-chunks // 3) * 9))
    assert [(r.chunk_id, r.block_id) for r in wrapped[: len(order)]] == [(r.chunk_id, r.block_id) for r in order]
    filled = [i % chunks for i in range(-(-chunks // 3) * 3)]
    assert sorted((r.chunk_id, r.block_id) for r in wrapped) == sorted((c, b) for c in filled for b in range(3))


def test_masking_padding_and_joining(spark):
    rows = [("q ", "a", ["x"] * 5, 2), ("q", "\ta", ["x"] * 2, 4), ("q", "a", [], 0), ("q\n", "\na", ["x"], 1)]
    frame = spark.createDataFrame(rows, "q string, a string, t array<string>, p int")
    got = frame.select(
        text.join_question_answer(F.col("q"), F.col("a"), "|").alias("j"),
        text.mask_prompt(F.col("t"), F.col("p"), 4, F.lit("-")).alias("m"),
        text.pad_or_cut(F.col("t"), 3, F.lit("0")).alias("c"),
    ).collect()
    assert [r.j for r in got] == ["q a|", "q\ta|", "q a|", "q\n\na|"]
    assert [r.m for r in got] == [["-", "-", "x", "x"], ["-", "-"], [], ["-"]]
    assert [r.c for r in got] == [["x"] * 3, ["x", "x", "0"], ["0"] * 3, ["x", "0", "0"]]
    counted = spark.range(1).select(text.counted_labels(F.array(F.lit(-100), F.lit(5), F.lit(0)))).first()
    assert counted[0] == 2


def test_slices_and_shards(spark):
    places = spark.range(13).select(
        "id",
        sampling.counted_slice(F.col("id"), 5).alias("counted"),
        sampling.plain_slice(F.col("id"), 5).alias("plain"),
        sampling.shard_of(F.col("id"), F.lit(13), 2, 3).alias("shard"),
    ).orderBy("id").collect()
    assert [r.counted for r in places] == [0] * 4 + [1] * 5 + [2] * 4
    assert [r.plain for r in places] == [0] * 5 + [1] * 5 + [2] * 3
    files = list(range(13))
    for shard in range(6):
        assert [r.id for r in places if r.shard == shard] == files[shard : 13 // 6 * 6 : 6]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_follows_the_draws(spark, seed):
    rows = [(i, "abc"[i % 3] if i % 4 else "a") for i in range(200)]
    weights = {"a": 3.0, "b": 1.0, "c": 2.0}
    frame = spark.createDataFrame(rows, "id long, src string").repartition(4)
    got = sampling.mix_sources(frame, "id", "src", weights, seed).orderBy("draw").collect()
    from siftmark.functions.chance import uniform

    draws = [r[0] for r in spark.range(200).orderBy("id").select(uniform(seed, F.col("id"))).collect()]
    queues = {s: [i for i, x in rows if x == s] for s in "abc"}
    expected = []
    for u in draws:
        source = "a" if u < 0.5 else "b" if u < 4 / 6 else "c"
        if not queues[source]:
            break
        expected.append((len(expected), source, queues[source].pop(0)))
    assert [(r.draw, r.src, r.id) for r in got] == expected


def test_random_rows_are_exact_in_number(spark):
    frame = spark.range(1000).withColumnRenamed("id", "doc")
    one = {r.doc for r in sampling.random_share(frame, "doc", 0.333, 9).collect()}
    two = {r.doc for r in sampling.random_share(frame.repartition(7), "doc", 0.333, 9).collect()}
    other = {r.doc for r in sampling.random_share(frame, "doc", 0.333, 10).collect()}
    assert len(one) == 333 and one == two and one != other
    assert sampling.random_share(frame, "doc", 1.0, 9).count() == 1000
    assert sampling.random_share(frame, "doc", 0.0001, 9).count() == 0
    assert abs(sum(one) / 333 - 499.5) < 60
    assert sampling.take_random(frame, "doc", 5000, 1).count() == 1000


def test_epochs_and_formulas(spark):
    assert sampling.repeat_epochs(spark.range(3), 2).count() == 6
    step = F.col("id")
    lr = spark.range(1).select(
        *[wsd_lr(F.lit(s)).alias(f"s{i}") for i, s in enumerate([0, 8000, 16000, 399999, 400000, 400400])]
    ).first()
    assert list(lr) == pytest.approx([0, 5e-4, 1e-3, 1e-3, 1e-3, 5e-4])
    row = spark.range(7, 9).select(round_up(step, 4).alias("r"), step_flops(step, 2, 3, 5, 7).alias("f")).collect()
    assert [r.r for r in row] == [8, 8]
    n = 7
    attention = 2 * 4 * 3 * n * n
    assert row[0].f == pytest.approx(3 * (2 * 5 * n + attention) + 2 * (2 * 7 * n + attention))


@pytest.mark.parametrize("name", ["file_packed", "file_packed_source"])
@pytest.mark.parametrize("lengths", [[], [262_144], [900] * 299 + [0, 5], [400_000, 124_289]])
def test_packed_queries_write_few_files(spark, tmp_path, monkeypatch, name, lengths):
    texts = [" ".join("x" * (j * (i + 1) % 9 + 1) for j in range(n)) for i, n in enumerate(lengths)]
    rows = [*enumerate(texts), (len(texts), None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    home = {"file_packed": file_queries, "file_packed_source": further_queries}[name]
    monkeypatch.setattr(home, "fresh", lambda spark, label: f"{tmp_path}/set")
    got = sorted(getattr(home, name)(spark, str(tmp_path)).collect())
    tokens = [len(w) for t in texts for w in t.split()]
    chunks = max(1, -(-len(tokens) // 512))
    tokens += [0] * (chunks * 512 - len(tokens))
    assert [tuple(r) for r in got] == [(c, " ".join(map(str, tokens[c * 512 : (c + 1) * 512]))) for c in range(chunks)]
    assert len(os.listdir(f"{tmp_path}/set")) <= 2 * -(-chunks // 512)  # Hadoop may keep a checksum beside each


@pytest.mark.parametrize("bundle", [1, 2, 5, 100])
def test_bundled_files_keep_odd_chunks(spark, tmp_path, bundle):
    rows = [(0, [1]), (1, []), (4, [3, 4, 5]), (5, [6, 7]), (23, [*range(9)])]
    chunks = spark.createDataFrame(rows, "chunk_id long, tokens array<int>").repartition(4)
    assert packed.write_packed(chunks, f"file://{tmp_path}/p", "train", "uint16", bundle) == 5
    assert packed.write_packed(chunks.limit(0), f"file://{tmp_path}/none", "train", "uint16", bundle) == 0
    assert sorted((r.chunk_id, r.tokens) for r in packed.read_packed(spark, f"{tmp_path}/p", "train").collect()) == rows
    assert len([f for f in os.listdir(f"{tmp_path}/p") if f.startswith("train")]) == len({c // bundle for c, _ in rows})
    register_packed(spark)
    laid = packed.bundled_together(chunks, bundle)
    laid.write.format("packed").option("bundle", bundle).mode("overwrite").save(f"{tmp_path}/s")
    for block in (2, 100):
        read = spark.read.format("packed").option("blockSize", block).load(f"{tmp_path}/s").collect()
        assert sorted((r.chunk_id, r.block_no, r.tokens) for r in read) == [
            (c, b, t[b * block : (b + 1) * block]) for c, t in rows for b in range(max(1, -(-len(t) // block)))
        ]
    if bundle > 2:  # chunks 4 and 0 share a tar, in whose task they are not
        with pytest.raises(PySparkException):
            chunks.repartitionByRange(5, "chunk_id").write.format("packed").option("bundle", bundle).mode("overwrite").save(f"{tmp_path}/t")
        assert not os.path.exists(f"{tmp_path}/t")
