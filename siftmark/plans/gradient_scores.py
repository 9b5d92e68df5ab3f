"""From training text and evaluation items to matched influence scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import words
from siftmark.operators.matching import match_influence, normalize_rows
from siftmark.operators.projection import random_projection
from siftmark.operators.prompts import TULU, build_prompts, tokenize_prompts
from siftmark.operators.sampling import counted_slice, random_share, shuffle_and_take
from siftmark.operators.sequences import overlap_chunks
from siftmark.sources.corpus import read_vectors

WHOLE_TASKS = ("bbh", "tydiqa", "mmlu")
READ_FIRST = {"squad": fixed.VALIDATION_ROWS + 1}

Tokens = Callable[[Column], Column]


def training_chunks(
    lines: DataFrame,
    tokens: Tokens = words,
    window: int = fixed.SEQUENCE_LENGTH,
    slice_no: int | None = None,
    share: float = 1.0,
    seed: int = 0,
    limit: int | None = None,
    file_keys: Sequence[str] = (),
) -> DataFrame:
    """(line_no, chunk_no, start, input_ids) of one file's (line_no, content) rows,
    or of many files', told apart by the columns ``file_keys``.

    ``slice_no`` keeps one slice of lines, counted from one; ``share`` then
    keeps that part of them at random. ``limit`` stops a text's windows at the
    one that reaches it.
    """
    if slice_no is not None:
        lines = lines.where(counted_slice(F.col("line_no")) == slice_no)
    if share != 1.0:
        if file_keys:
            raise ValueError("a random share is drawn from one file")
        lines = random_share(lines, "line_no", share, seed)
    tokenized = lines.select(*file_keys, "line_no", tokens(F.col("content")).alias("tokens"))
    return overlap_chunks(tokenized, "tokens", window, limit).drop("tokens")


def evaluation_set(
    items: DataFrame,
    task: str,
    tokens: Tokens = words,
    style: str = TULU,
    seed: int = 0,
    max_length: int = fixed.SEQUENCE_LENGTH,
    ignore: Column | None = None,
) -> DataFrame:
    """Tokenized prompts of ``task``; most tasks keep 500 shuffled items.

    ``items`` of those tasks are numbered by ``item_no``.
    """
    if task in READ_FIRST:
        items = items.where(F.col("item_no") < READ_FIRST[task])
    if task not in WHOLE_TASKS:
        items = shuffle_and_take(items, "item_no", seed)
    return tokenize_prompts(build_prompts(items, task, style), tokens, max_length, ignore)


def project_and_normalize(gradients: DataFrame, width: int = fixed.PROJECTION_DIM, seed: int = 0) -> DataFrame:
    """Gradients in ``vector`` cut to ``width`` numbers and to length one."""
    return normalize_rows(random_projection(gradients, "vector", width, seed), "vector")


def match_stored(
    spark: SparkSession,
    train_path: str,
    validation_path: str,
    task: str,
    weights: dict[int, float],
    output: str,
) -> DataFrame:
    """Scores of stored (ckpt, train_id, vector) rows against a task's (ckpt, position, vector)."""
    scores = match_influence(
        read_vectors(spark, train_path), read_vectors(spark, validation_path), fixed.SUBTASKS[task], weights
    )
    scores.write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
