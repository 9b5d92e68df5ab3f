"""Gradient matching: how well each training row points at each subtask."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.functions.arrow_blocks import as_lists, as_matrix
from siftmark.functions.vectors import doubles, l2_normalize

# Up to this many products per row the JVM's array functions keep up with BLAS
# in Arrow batches (measured on 200,000 rows: even at 32, four times slower at 864).
JVM_PRODUCTS = 256
MAX_CENTRE_VALUES = 16_000_000


def renormalize(weights: list[float]) -> list[float]:
    """Checkpoint weights that sum to one."""
    total = sum(weights)
    return list(weights) if total == 1 else [w / total for w in weights]


def normalize_rows(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, l2_normalize(F.col(vector)))


def subtask_of(position: Column, rows: int, subtasks: int) -> Column:
    """Subtask of a zero-based validation position: equal contiguous blocks."""
    if rows % subtasks:
        raise ValueError(f"{rows} validation rows do not split into {subtasks} subtasks")
    return F.floor(position / (rows // subtasks)).cast("int")


def subtask_centres(validation: DataFrame, subtasks: int) -> dict[int, np.ndarray] | None:
    """Mean validation vector of each (ckpt, subtask) as one matrix per checkpoint.

    ``validation`` has (ckpt, val_id, position, vector). The means are
    aggregated on the executors. What returns to the driver depends on the
    checkpoints, subtasks and width only, not on the number of rows; above
    ``MAX_CENTRE_VALUES`` values nothing returns.
    """
    counted = _counted(validation)
    if sum(subtasks * r.width for r in counted) > MAX_CENTRE_VALUES:
        return None
    centres = {r.ckpt: np.zeros((subtasks, r.width)) for r in counted}
    for row in _means(validation, counted, subtasks).collect():
        centres[row.ckpt][row.sub] = row.m
    return centres


def _means(validation: DataFrame, counted: list, subtasks: int) -> DataFrame:
    """(ckpt, sub, m): the mean validation vectors."""
    sizes = {r.n for r in counted}
    if len(sizes) != 1:
        raise ValueError("checkpoints have different numbers of validation rows")
    sub = subtask_of(F.col("position"), sizes.pop(), subtasks)
    means = validation.groupBy("ckpt", sub.alias("sub")).agg(
        Summarizer.mean(array_to_vector(doubles(F.col("vector")))).alias("m")
    )
    return means.select("ckpt", "sub", vector_to_array("m").alias("m"))


def _counted(validation: DataFrame) -> list:
    """(ckpt, n, width), a row per checkpoint, on the driver."""
    counted = validation.groupBy("ckpt").agg(F.count("*").alias("n"), F.first(F.size("vector")).alias("width")).collect()
    if not counted:
        raise ValueError("no validation vectors")
    return counted


def _jvm_dots(vector: Column, centres: dict[int, np.ndarray], weights: dict[int, float]) -> Column:
    chosen = F.lit(None).cast("array<double>")
    for ckpt, matrix in centres.items():
        # one constant, folded when the query is planned
        rows = F.from_json(F.lit(json.dumps((weights[ckpt] * matrix).tolist())), "array<array<double>>")
        dots = F.transform(
            rows,
            lambda centre: F.aggregate(
                F.zip_with(centre, vector, lambda a, b: a * b.cast("double")),
                F.lit(0.0),
                lambda total, x: total + x,
            ),
        )
        chosen = F.when(F.col("ckpt") == ckpt, dots).otherwise(chosen)
    return chosen


def _checked(widths: dict[int, int]) -> Column:
    """``vector``, or an error where it is null, holds a null or is not as wide as its checkpoint."""
    width = F.lit(None).cast("int")
    for ckpt, n in widths.items():
        width = F.when(F.col("ckpt") == ckpt, n).otherwise(width)
    vector = F.col("vector")
    good = vector.isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(good, vector).otherwise(
        F.raise_error(F.lit("a vector is null or has another width")).cast("array<double>")
    )


def _blas_dots(train: DataFrame, centres: dict[int, np.ndarray], weights: dict[int, float]) -> DataFrame:
    shipped = train.sparkSession.sparkContext.broadcast(
        {ckpt: (weights[ckpt] * matrix).T for ckpt, matrix in centres.items()}
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ckpts = batch.column("ckpt").to_numpy(zero_copy_only=False)
            for number, matrix in shipped.value.items():
                part = batch.filter(pa.array(ckpts == number))
                if part.num_rows:
                    products = as_matrix(part.column("vector")) @ matrix
                    yield pa.RecordBatch.from_arrays(
                        [part.column("ckpt"), part.column("train_id"), as_lists(products)],
                        ["ckpt", "train_id", "dots"],
                    )

    schema = T.StructType(
        [train.schema["ckpt"], train.schema["train_id"], T.StructField("dots", T.ArrayType(T.DoubleType()))]
    )
    return train.select("ckpt", "train_id", "vector").mapInArrow(multiply, schema)


def _shares(weights: dict[int, float] | None, ckpts) -> dict[int, float]:
    if weights is None:
        weights = {ckpt: 1.0 for ckpt in ckpts}
    if set(weights) != set(ckpts):
        raise ValueError("checkpoint weights do not match the validation checkpoints")
    return dict(zip(weights, renormalize(list(weights.values()))))


def match_influence(
    train: DataFrame,
    validation: DataFrame,
    subtasks: int,
    weights: dict[int, float] | None = None,
    wide: bool | None = None,
) -> DataFrame:
    """(train_id, score): best subtask's mean dot product, summed over checkpoints.

    ``train`` has (ckpt, train_id, vector). Because a dot product is linear,
    the mean over a subtask's validation rows equals one dot product with
    their mean vector, so no train x validation pairs are formed: each
    training row meets ``subtasks`` centres where it is, and only the small
    arrays of sums are shuffled when there are several checkpoints. A row that
    lacks a checkpoint, or has one twice, is returned with a null score. A
    vector that is null, holds a null or is of another width stops the job.
    Centres too large for every task are matched by ``match_blocked``.
    """
    centres = subtask_centres(validation, subtasks)
    if centres is None:
        return match_blocked(train, validation, subtasks, weights)
    shares = _shares(weights, centres)
    used = train.where(F.col("ckpt").isin(list(shares))).withColumn("vector", _checked({c: m.shape[1] for c, m in centres.items()}))
    products = next(iter(centres.values())).size
    if wide if wide is not None else products > JVM_PRODUCTS:
        dotted = _blas_dots(used, centres, shares)
    else:
        dotted = used.select("ckpt", "train_id", _jvm_dots(F.col("vector"), centres, shares).alias("dots"))
    if len(shares) == 1:
        return dotted.select("train_id", F.array_max("dots").alias("score"))
    met = [F.sum((F.col("ckpt") == c).cast("int")) == 1 for c in shares]
    sums = dotted.groupBy("train_id").agg(
        reduce(Column.__and__, met).alias("whole"),
        *[F.sum(F.get("dots", F.lit(i))).alias(f"d{i}") for i in range(subtasks)],
    )
    best = F.array_max(F.array(*[F.col(f"d{i}") for i in range(subtasks)]))
    return sums.select("train_id", F.when(F.col("whole"), best).alias("score"))


def _blocks(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """``rows`` with a row for each stretch of ``width`` values: its number ``dims`` and ``part``."""
    last = F.floor((F.size(vector) - 1) / width)
    cut = rows.where(F.size(vector) > 0).withColumn("dims", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = F.slice(F.col(vector), (F.col("dims") * width + 1).cast("int"), width)
    return cut.withColumn("part", doubles(part)).drop(vector)


def match_blocked(
    train: DataFrame,
    validation: DataFrame,
    subtasks: int,
    weights: dict[int, float] | None = None,
    rows_each: int = 4096,
    centres_each: int = 256,
    dims_each: int = 2048,
) -> DataFrame:
    """What ``match_influence`` returns, as a product of matrices in blocks, for any
    number of subtasks and any width.

    A block of training rows meets a block of centres stretch by stretch of the
    vectors, so a task holds three bounded blocks whatever the sizes; the partial
    products are summed by row and block of centres. Only a row per checkpoint
    reaches the driver. Training rows are sent once for each block of centres, and
    centres once for each block of training rows. An empty training table gives none.
    """
    counted = _counted(validation)
    shares = _shares(weights, [r.ckpt for r in counted])
    used = train.where(F.col("ckpt").isin(list(shares))).withColumn("vector", _checked({r.ckpt: r.width for r in counted}))
    row_blocks = max(1, -(-used.count() // (rows_each * len(shares))))
    centre_blocks = -(-subtasks // centres_each)
    factor = F.lit(0.0)
    for ckpt, share in shares.items():
        factor = F.when(F.col("ckpt") == ckpt, F.lit(float(share))).otherwise(factor)
    centres = _means(validation, counted, subtasks).withColumn("m", F.transform("m", lambda x: x * factor))
    centres = _blocks(centres.withColumn("of", F.floor(F.col("sub") / centres_each)), "m", dims_each)
    centres = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    rows = _blocks(used.select("ckpt", "train_id", "vector"), "vector", dims_each)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("train_id"), F.lit(row_blocks)).cast("int"))
    rows = rows.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(centre_blocks - 1).cast("long"))))
    id_field = train.schema["train_id"]

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("train_id").combine_chunks()
        of = left.column("of")[0].as_py() if len(left) else 0
        products = np.zeros((len(ids), min(centres_each, subtasks - of * centres_each)))
        if len(left) and len(right):
            place = right.column("sub").to_numpy() - of * centres_each
            products[:, place] = as_matrix(left.column("part").combine_chunks()) @ as_matrix(right.column("part").combine_chunks()).T
        return pa.table([left.column("ckpt"), ids, left.column("of"), left.column("dims"), as_lists(products)], names=names)

    names = ["ckpt", "train_id", "of", "dims", "dots"]
    kinds = [train.schema["ckpt"].dataType, id_field.dataType, T.LongType(), T.LongType(), T.ArrayType(T.DoubleType())]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    keys = ("ckpt", "block", "of", "dims")
    dots = rows.groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInArrow(multiply, schema)
    met = [F.sum(((F.col("ckpt") == c) & (F.col("dims") == 0)).cast("int")) == 1 for c in shares]
    sums = dots.groupBy("train_id", "of").agg(
        reduce(Column.__and__, met).alias("whole"), vector_to_array(Summarizer.sum(array_to_vector("dots"))).alias("dots")
    )
    best = sums.groupBy("train_id").agg(F.min("whole").alias("whole"), F.max(F.array_max("dots")).alias("best"))
    return best.select("train_id", F.when(F.col("whole"), F.col("best")).alias("score"))
