"""Token sequences: overlapping windows and fixed-size packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators.ordering import running_total
from siftmark.session import materialize


def overlap_starts(length: Column, window: int, limit: int | None = None) -> Column:
    """Starts of windows that overlap by a quarter, over the whole length.

    With ``limit`` they stop at the window that reaches it.
    """
    step = window - window // 4
    most = F.floor((length - 1) / step)
    if limit is not None:
        most = F.least(F.lit(max(0, -(-(limit - window) // step))).cast("long"), most)
    return F.when(
        length > 0, F.transform(F.sequence(F.lit(0).cast("long"), most), lambda k: (k * step).cast("int"))
    )


def overlap_chunks(
    df: DataFrame, tokens: str, window: int = fixed.SEQUENCE_LENGTH, limit: int | None = None
) -> DataFrame:
    """One row per window: ``chunk_no``, ``start`` and the window's ``input_ids``.

    All tokens are in some window; only with ``limit`` do the windows of a
    sequence stop, at the one that reaches it. An empty sequence gives no row.
    The labels of a window are its tokens.
    """
    starts = overlap_starts(F.size(tokens), window, limit)
    return df.select("*", F.posexplode(starts).alias("chunk_no", "start")).withColumn(
        "input_ids", F.slice(F.col(tokens), F.col("start") + 1, window)
    )


def pack_tokens(df: DataFrame, id_col: str, tokens: str, chunk_size: int, filler: Column) -> DataFrame:
    """(chunk_id, tokens): all sequences in id order cut into equal chunks.

    A sequence is cut at chunk borders into slices, not into tokens, and a
    chunk gathers at most ``chunk_size`` tokens, so no group is unbounded. The
    last chunk is filled up; with no tokens at all there is one filler chunk.
    """
    # tokens are made once and stored; their lengths are read back without them
    stored = materialize(df.select(id_col, tokens, F.size(tokens).cast("long").alias("_len")), "tokens")
    starts = running_total(stored.select(id_col, "_len"), id_col, F.col("_len"), out="_start")
    placed = stored.select(id_col, tokens).join(starts, id_col).where(F.col("_len") > 0)
    end = F.col("_start") + F.col("_len")
    chunks = F.sequence(F.floor(F.col("_start") / chunk_size), F.floor((end - 1) / chunk_size))

    def piece(chunk: Column) -> Column:
        first = F.greatest(chunk * chunk_size, F.col("_start"))
        stop = F.least((chunk + 1) * chunk_size, end)
        part = F.slice(F.col(tokens), (first - F.col("_start")).cast("int") + 1, (stop - first).cast("int"))
        return F.struct(chunk.alias("chunk_id"), first.alias("at"), part.alias("part"))

    # a row per piece that holds its slice only
    pieces = placed.select(F.inline(F.transform(chunks, piece)))
    # chunk 0 exists even when there is nothing to pack
    opening = pieces.sparkSession.range(1).select(
        F.col("id").alias("chunk_id"),
        F.lit(-1).cast("long").alias("at"),
        F.array().cast(pieces.schema["part"].dataType).alias("part"),
    )
    gathered = pieces.unionByName(opening).groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("ps")
    )
    joined = gathered.select(
        "chunk_id", F.flatten("ps.part").alias("tokens")
    )
    return joined.select(
        "chunk_id",
        F.concat("tokens", F.array_repeat(filler, F.lit(chunk_size) - F.size("tokens"))).alias("tokens"),
    )


def blocks_of(chunks: DataFrame, chunk_size: int, block_size: int) -> DataFrame:
    """(chunk_id, block_id, tokens): the whole blocks of each chunk."""
    per_chunk = chunk_size // block_size
    return chunks.select(
        "chunk_id", "tokens", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))).alias("block_id")
    ).select(
        "chunk_id",
        "block_id",
        F.slice("tokens", F.col("block_id") * block_size + 1, block_size).alias("tokens"),
    )
