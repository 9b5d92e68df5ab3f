"""The first interval that holds a value, of a table of intervals that may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.session import materialize

#: The line between the least and the largest bound is cut into two to the power of so many cells.
LEVELS = 16


def first_interval(points: DataFrame, intervals: DataFrame, id_col: str, value: str, order: str, levels: int = LEVELS) -> DataFrame:
    """(id, order): of the intervals ``low <= value < high`` the one of least ``order``.

    ``points`` has ``id_col``, unique, and ``value``; ``intervals`` has (low, high) and
    ``order``, unique. The order is null where no interval holds the value, and where the
    value is null or NaN. Intervals with a null or NaN bound, or that are empty, hold nothing.

    A value falls into a cell of the line. For intervals that reach over a whole
    cell nothing is compared: the least order of a cell is made once, from the powers of
    two of cells that make up an interval. What is compared are the intervals that begin or end in the
    value's cell. So no value meets all the intervals that hold it, and all joins are by
    equal cells. The table of cells has a row per cell at most.
    """
    known = intervals.select(F.col("low").cast("double"), F.col("high").cast("double"), F.col(order).alias("_order"))
    known = known.where("low < high AND NOT isnan(low) AND NOT isnan(high)")
    known = known.groupBy("low", "high").agg(F.min("_order").alias("_order"))
    known = materialize(known, "intervals")
    least, most = known.where("abs(low) < 1e300 AND abs(high) < 1e300").agg(F.min("low"), F.max("high")).first()
    least, most = (least or 0.0), (most if most is not None and most > (least or 0.0) else (least or 0.0) + 1.0)
    cells = 1 << levels

    def cell(column: str):
        place = F.floor((F.col(column) - least) / (most - least) * cells)
        return F.when(F.col(column) < least, -1).when(F.col(column) >= most, cells).otherwise(F.least(place, F.lit(cells - 1))).cast("long")

    known = known.withColumn("_first", cell("low")).withColumn("_last", cell("high"))
    edges = known.select("*", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_cell"))
    # whole cells: after the one where the interval begins and before the one where it ends
    runs = known.select("_order", (F.col("_first") + 1).alias("_from"), F.col("_last").alias("_to")).where("_from < _to")
    nodes = None
    for level in range(levels + 1):
        # cells of this size at either end of what larger cells do not cover
        width = 1 << level
        begin, end = (F.ceil(F.col("_from") / width)).cast("long"), (F.floor(F.col("_to") / width)).cast("long")
        some = runs.withColumn("_b", begin).withColumn("_e", end).where("_b < _e")
        ends = F.array_compact(
            F.array(
                F.when((F.col("_b") % 2 == 1) | (F.lit(level) == levels), F.col("_b")),
                F.when((F.col("_e") % 2 == 1), F.col("_e") - 1),
            )
        )
        found = some.select("_order", F.lit(level).alias("_level"), F.explode(F.array_distinct(ends)).alias("_node"))
        nodes = found if nodes is None else nodes.unionByName(found)
    nodes = nodes.groupBy("_level", "_node").agg(F.min("_order").alias("_order"))
    line = known.sparkSession.range(cells).select(
        F.col("id").alias("_cell"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.floor(F.col("id") / F.pow(F.lit(2), k)).cast("long"))).alias("_level", "_node")
    )
    covered = line.join(nodes, ["_level", "_node"]).groupBy("_cell").agg(F.min("_order").alias("_whole"))
    own = points.select(F.col(id_col), F.col(value).cast("double").alias("_value"))
    own = own.withColumn("_cell", F.when(F.col("_value").isNotNull() & ~F.isnan("_value"), cell("_value")))
    near = own.join(covered, "_cell", "left").join(edges.drop("_first", "_last"), "_cell", "left")
    inside = F.when((F.col("low") <= F.col("_value")) & (F.col("_value") < F.col("high")), F.col("_order"))
    return near.groupBy(id_col).agg(F.min(F.least("_whole", inside)).alias(order))
