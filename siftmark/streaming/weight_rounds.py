"""Weights that follow influence files as they arrive.

Every micro-batch is one iteration: its losses move the last saved weights
and the result is saved under the batch's number. A replayed batch reads the
same predecessor and writes the same files, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftmark.operators.weights import AgentWeights, UpdateRule, update_weights
from siftmark.sources.weight_files import load_weights, save_weights

INFLUENCE_SCHEMA = "family string, key string, line_no long, influence array<double>"


def follow_influences(
    spark: SparkSession, path: str, weights_folder: str, checkpoint: str, rule: UpdateRule = UpdateRule()
) -> StreamingQuery:
    """Run the rounds for the (family, key, line_no, influence) JSON files now under ``path``."""
    stream = spark.readStream.schema(INFLUENCE_SCHEMA).option("maxFilesPerTrigger", 1).json(path)

    def one_round(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = AgentWeights() if number == 0 else load_weights(session, weights_folder, number)
        save_weights(session, update_weights(batch, before, rule), weights_folder, number + 1)

    return (
        stream.writeStream.foreachBatch(one_round)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
