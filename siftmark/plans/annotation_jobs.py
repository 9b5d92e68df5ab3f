"""Annotation requests as jobs that can be stopped and run again.

Requests are sent by windows and attempts. Each (window, attempt) first writes
what it sends, then what became of it, then a mark. A run that was stopped goes
on with the first attempt without a mark; an attempt sends only the requests of
its window that no earlier attempt has completed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.operators.annotation import Annotator, parse_responses
from siftmark.sources.manifests import read_mark, write_mark

STATES = "custom_id string, state string, response string, window int, attempt int"


def _table(folder: str, kind: str, window: int, attempt: int) -> str:
    return f"{folder}/{kind}/window={window}/attempt={attempt}"


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All stored (window, attempt) tables of a kind."""
    schema = STATES if kind == "answers" else "custom_id string, request string, window int, attempt int"
    stored = spark.createDataFrame([], schema)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        stored = spark.read.schema(schema).parquet(f"{folder}/{kind}")
    return stored


def _outcomes(sent: DataFrame, annotator: Annotator) -> DataFrame:
    """(custom_id, state, response) of sent requests; of several answers one with a topic counts, the least."""
    answers = annotator.annotate(sent).select("response")
    keyed = parse_responses(answers.select("response", F.col("response").alias("_kept")), keep_id=True, keep=["_kept"])
    best = F.min(F.struct(F.col("selected_topic").isNull(), "_kept"))
    found = keyed.groupBy("custom_id").agg(best.alias("_b"), F.max(F.col("selected_topic").isNotNull()).alias("_good"))
    state = F.when(F.col("_good"), "completed").otherwise("failed")
    return sent.select("custom_id").join(found, "custom_id", "left").select(
        "custom_id", state.alias("state"), F.col("_b._kept").alias("response")
    )


def run_windows(
    requests: DataFrame, annotator: Annotator, folder: str, windows: Iterable[int], attempts: int = 3
) -> None:
    """Send the (window, request) rows of ``windows``, each window at most ``attempts`` times.

    A request that gets no answer, or one without a topic, has failed and is
    sent again. Of requests with one custom_id the least is sent; null ids are
    sent as one request and fail. ``annotator`` gets (custom_id, attempt, request)
    and may see an attempt's requests again if a run was stopped within it.
    """
    spark = requests.sparkSession
    named = requests.select("window", F.get_json_object("request", "$.custom_id").alias("custom_id"), "request")
    for window in windows:
        mine = named.where(F.col("window") == window).groupBy("custom_id").agg(F.min("request").alias("request"))
        for attempt in range(1, attempts + 1):
            mark = f"{folder}/marks/{window}-{attempt}"
            before = read_mark(spark, mark)
            if before is None:
                earlier = _read(spark, folder, "answers").where(F.col("window") == window)
                done = earlier.where((F.col("attempt") < attempt) & (F.col("state") == "completed"))
                path = _table(folder, "submitted", window, attempt)
                mine.join(done.select("custom_id"), "custom_id", "left_anti").write.mode("overwrite").parquet(path)
                sent = spark.read.schema("custom_id string, request string").parquet(path)
                sent = sent.withColumn("attempt", F.lit(attempt))
                answers = _table(folder, "answers", window, attempt)
                _outcomes(sent, annotator).write.mode("overwrite").parquet(answers)
                failed = spark.read.schema("state string").parquet(answers).where("state = 'failed'").count()
                before = {"failed": failed}
                write_mark(spark, mark, before)
            if before["failed"] == 0:
                break


def request_states(spark: SparkSession, folder: str) -> DataFrame:
    """(custom_id, window, state, attempts, response): where each request sent so far stands.

    Submitted means sent, and stopped before an outcome was written.
    """
    key = ["custom_id", "window"]
    rank = F.when(F.col("state") == "completed", 2).when(F.col("state") == "failed", 1).otherwise(0)
    rows = _read(spark, folder, "submitted").select(
        *key, "attempt", F.lit("submitted").alias("state"), F.lit(None).cast("string").alias("response")
    )
    rows = rows.unionByName(_read(spark, folder, "answers")).withColumn("rank", rank)
    last = F.max_by(F.struct("state", "response"), F.struct(F.col("rank") == 2, "attempt", "rank"))
    newest = rows.groupBy(*key).agg(last.alias("last"), F.max("attempt").alias("attempts"))
    return newest.select(*key, "last.state", "attempts", "last.response")


def completed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed answers of the completed requests."""
    done = request_states(spark, folder).where("state = 'completed'")
    return parse_responses(done, keep_id=True)
