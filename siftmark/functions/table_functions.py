"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class OverlapChunks:
    """``overlap_chunks(TABLE(t) [PARTITION BY (...)], 'tokens', window)``.

    A row of the table gives a row for each window of its array column, with the other
    columns, ``chunk_no``, ``start`` and the window's ``input_ids``. Windows begin at three
    quarters of a window from each other. Null and empty arrays give none. A row needs no
    other row, so any partitioning gives the same rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, tokens: AnalyzeArgument, window: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        names = [f.name for f in rows.dataType.fields]
        if not tokens.isConstantExpression or tokens.value not in names:
            raise ValueError(f"the second argument must name a column of {', '.join(names)}")
        if not isinstance(rows.dataType[tokens.value].dataType, T.ArrayType):
            raise ValueError(f"{tokens.value} is not an array")
        if not window.isConstantExpression or not isinstance(window.value, int) or window.value < 4:
            raise ValueError("the window must be a whole number of at least 4")
        clash = {"chunk_no", "start", "input_ids"} & set(names)
        if clash:
            raise ValueError(f"the table has columns {', '.join(sorted(clash))} already")
        kept = [f for f in rows.dataType.fields if f.name != tokens.value]
        made = [
            T.StructField("chunk_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("input_ids", rows.dataType[tokens.value].dataType),
        ]
        return AnalyzeResult(T.StructType([*kept, *made]))

    def eval(self, row: Row, tokens: str, window: int) -> Iterator[tuple]:
        ids = row[tokens] or []
        kept = [row[name] for name in row.__fields__ if name != tokens]
        step = window - window // 4
        for number, start in enumerate(range(0, len(ids), step)):
            yield (*kept, number, start, ids[start : start + window])


def register_chunks(spark: SparkSession, name: str = "overlap_chunks") -> None:
    spark.udtf.register(name, udtf(OverlapChunks))
