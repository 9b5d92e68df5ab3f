"""Seeded sampling, slicing and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.chance import choose, uniform
from siftmark.operators.ordering import running_total
from siftmark.operators.threshold import top_n_place


def take_random(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement: those with the smallest draws.

    Draws that tie on the last place are settled by ``id_col``.
    """
    drawn = df.withColumn("_u", uniform(seed, F.col(id_col)))
    if n <= 0:
        return df.where(F.lit(False))
    negated = drawn.select((-F.col("_u")).alias("_d"))
    found = top_n_place(negated, "_d", n)
    if found is None:
        return df
    limit, missing = found
    last = F.lit(-limit)
    below = drawn.where(F.col("_u") < last)
    at_limit = (
        drawn.where(F.col("_u") == last)  # equal 52-bit draws: a handful of rows at most
        .withColumn("_r", F.row_number().over(Window.orderBy(id_col)))
        .where(F.col("_r") <= missing)
        .drop("_r")
    )
    return below.unionByName(at_limit).drop("_u")


def random_share(df: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """``int(rows * share)`` random rows; everything when that is all rows."""
    rows = df.count()
    n = int(rows * share)
    return df if n == rows else take_random(df, id_col, n, seed)


def shuffle_and_take(df: DataFrame, id_col: str, seed: int, n: int = fixed.VALIDATION_ROWS) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle (a small evaluation set)."""
    return df.orderBy(uniform(seed, F.col(id_col)), id_col).limit(n)


def counted_slice(position: Column, rows: int = fixed.SLICE_ROWS) -> Column:
    """Slice of a zero-based position when rows are counted from one.

    Slice 0 is a row short, since no row has count zero.
    """
    return F.floor((position + 1) / rows)


def plain_slice(position: Column, rows: int = fixed.SLICE_ROWS) -> Column:
    """Slice of a zero-based position."""
    return F.floor(position / rows)


def shard_of(index: Column, total: Column, workers: int, processes: int = 1) -> Column:
    """Shard of the file at ``index``; null in the tail that no shard reads."""
    shards = workers * processes
    whole = F.floor(total / shards) * shards
    return F.when(index < whole, F.pmod(index, F.lit(shards)))


def mix_sources(
    rows: DataFrame,
    id_col: str,
    source_col: str,
    weights: dict[str, float],
    seed: int,
    draws: int | None = None,
) -> DataFrame:
    """Interleave sources: each draw picks one by weight and takes its next row.

    Adds ``draw``. The mix ends with the first draw whose source has run out,
    so at most ``draws`` (by default one per row) rows come back. Only the ids
    are ordered and matched; other columns are joined on at the end.
    """
    names = list(weights)
    kept = rows.where(F.col(source_col).isin(names)).select(id_col, source_col)
    placed = running_total(kept, id_col, groups=(source_col,), out="_turn")
    if draws is None:
        draws = kept.count()
    picks = kept.sparkSession.range(draws).select(
        F.col("id").alias("draw"),
        F.element_at(
            F.array(*[F.lit(n) for n in names]),
            choose(uniform(seed, F.col("id")), [weights[n] for n in names]) + 1,
        ).alias(source_col),
    )
    turns = running_total(picks, "draw", groups=(source_col,), out="_turn")
    matched = turns.join(placed, [source_col, "_turn"], "left")
    first_miss = matched.where(F.col(id_col).isNull()).agg(F.min("draw").alias("end"))
    mixed = matched.where(F.col(id_col).isNotNull()).withColumn("_end", first_miss.scalar())
    mixed = mixed.where(F.col("_end").isNull() | (F.col("draw") < F.col("_end")))
    mixed = mixed.select("draw", id_col, source_col)
    if set(rows.columns) > {id_col, source_col}:
        mixed = mixed.join(rows, [id_col, source_col])
    return mixed.select("draw", *rows.columns)


def permute_blocks(
    blocks: DataFrame, window_chunks: int, blocks_per_chunk: int, seed: int, wrap: bool = False
) -> DataFrame:
    """Shuffle blocks inside each window of chunks.

    ``blocks`` has (chunk_id, block_id, ...), with chunks numbered from 0. A
    window holds a fixed number of blocks, whatever the size of the data. Adds
    ``read_order``. An unfilled last window is filled up with the first chunks
    if ``wrap`` is set, so that some are read twice; else it is not read, as
    with readers that stop there.
    """
    if wrap:
        total = blocks.agg(F.max("chunk_id") + 1).scalar()
        missing = F.pmod(F.lit(window_chunks) - total % window_chunks, F.lit(window_chunks))
        again = blocks.withColumn("_total", total).withColumn("_missing", missing)
        rounds = F.floor((F.col("_missing") - 1 - F.col("chunk_id")) / F.col("_total"))
        again = again.where("chunk_id < _missing").withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), rounds)))
        place = F.col("_total") * (F.col("_round") + 1) + F.col("chunk_id")
        first = blocks.withColumn("_place", F.col("chunk_id"))
        blocks = first.unionByName(again.withColumn("_place", place).select(*blocks.columns, "_place"))
    else:
        blocks = blocks.withColumn("_place", F.col("chunk_id"))
    windowed = blocks.withColumn("window_id", F.floor(F.col("_place") / window_chunks))
    inside = Window.partitionBy("window_id")
    full = windowed.withColumn("_n", F.count("*").over(inside)).where(
        F.col("_n") == window_chunks * blocks_per_chunk
    )
    order = uniform(seed, F.col("_place"), F.col("block_id"))
    place = F.row_number().over(inside.orderBy(order, "_place", "block_id")) - 1
    return full.withColumn(
        "read_order", F.col("window_id") * window_chunks * blocks_per_chunk + place
    ).drop("_n", "_place")


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """The rows once per epoch, with the epoch's number."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def split_by_draw(df: DataFrame, id_col: str, train_share: float, seed: int) -> DataFrame:
    """Add ``part``: ``train`` or ``valid`` by a seeded draw per row."""
    return df.withColumn(
        "part",
        F.when(uniform(seed, F.col(id_col)) < train_share, "train").otherwise("valid"),
    )
