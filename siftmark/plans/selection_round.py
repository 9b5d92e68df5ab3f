"""One selection iteration over stored data, from influence files to chosen lines.

An iteration is a chain of stages, each with a folder of its own. A finished
stage leaves a mark, so a run that was stopped goes on with the first stage
without one. The last thing written is the iteration's manifest, a small file
that appears whole by a rename; readers and the next iteration look for it, so
to them an iteration is there as a whole or not at all.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import file_name, folder_name
from siftmark.operators.scoring import score_records
from siftmark.operators.selection import LINE_KEY, lines_of, output_name
from siftmark.operators.threshold import flag_from, reaching, top_n_threshold
from siftmark.operators.weights import AgentWeights, UpdateRule, update_weights
from siftmark.sources.corpus import missing_keys, parse_records, read_influences, read_records
from siftmark.sources.lines import JSONL, numbered_lines, scan_lines, with_field, write_lines
from siftmark.session import scratch
from siftmark.sources.manifests import read_mark, remove_mark, write_mark
from siftmark.sources.weight_files import load_weights, save_weights

STAGES = ("weights", "scored", "threshold", "processed", "selected")


@dataclass
class Round:
    """Folders and constants of one iteration. Each output gets a folder of its own."""

    influence: str
    corpus: str
    output: str
    source: str | None = None
    iteration: int = 1
    top_n: int = fixed.TOP_N
    pattern: str = JSONL
    rule: UpdateRule = UpdateRule()

    def folder(self, name: str) -> str:
        return f"{self.output}/iteration_{self.iteration}/{name}"

    def mark(self, stage: str) -> str:
        return self.folder(f"_marks/{stage}")

    def manifest(self, iteration: int | None = None) -> str:
        return f"{self.output}/iteration_{iteration or self.iteration}/_published"

    def constants(self) -> dict:
        """What the outputs depend on; a run with others must not go on with them."""
        return {k: v for k, v in asdict(self).items() if k != "output"}


def published(spark: SparkSession, job: Round) -> dict[str, str]:
    """Folder of each output of a finished iteration; one that is not finished is not there."""
    manifest = read_mark(spark, job.manifest())
    if manifest is None:
        raise FileNotFoundError(f"iteration {job.iteration} is not published")
    return {name: f"{job.output}/iteration_{job.iteration}/{name}" for name in manifest["outputs"]}


def move_weights(spark: SparkSession, job: Round) -> AgentWeights:
    """Weights of this iteration from the last one's and the new influences."""
    if job.iteration == 1:
        before = AgentWeights()
    elif read_mark(spark, job.manifest(job.iteration - 1)) is None:
        raise FileNotFoundError(f"iteration {job.iteration - 1} is not published")
    else:
        before = load_weights(spark, f"{job.output}/weights", job.iteration - 1)
    influences = read_influences(spark, job.influence, job.pattern)
    absent = missing_keys(influences, {f: list(before.family(f)) for f in ("quality", "domain", "topic")})
    if absent:
        raise FileNotFoundError(f"no influences for {', '.join(absent)}")
    after = update_weights(influences, before, job.rule)
    save_weights(spark, after, job.folder("weights"), job.iteration)
    return after


def write_scores(spark: SparkSession, job: Round, weights: AgentWeights) -> None:
    """The scored corpus lines as parquet: later passes read the score column alone.

    Lines are only numbered, which reads the corpus a second time, where the
    numbers are needed to find lines in another folder; else they are null.
    """
    nested = job.pattern != JSONL
    if job.source is not None:
        records = read_records(spark, job.corpus, nested, job.pattern)
    else:
        lines = scan_lines(spark, job.corpus, nested, job.pattern)
        records = parse_records(
            lines.select(
                folder_name(F.col("path")).alias("subfolder"),
                file_name(F.col("path")).alias("file"),
                F.lit(None).cast("long").alias("line_no"),
                "line",
            )
        )
    scored = score_records(records, weights, job.iteration)
    scored.select(*LINE_KEY, F.col(f"score_{job.iteration}").alias("score"), "line").write.mode(
        "overwrite"
    ).parquet(job.folder("scored"))


def run_round(spark: SparkSession, job: Round) -> AgentWeights:
    """Weights, scores, flags and selected lines of one iteration, all written anew.

    When the lines to select are the scored ones, they are read back by score;
    only another ``source`` folder needs the join. The flags by line number are
    then written too, and can be joined to that folder again. Tables stored on the way are
    deleted in the end.
    """
    remove_mark(spark, job.manifest())  # first, so that nothing half new is read
    for stage in STAGES:
        remove_mark(spark, job.mark(stage))
    return resume_round(spark, job)


def resume_round(spark: SparkSession, job: Round) -> AgentWeights:
    """As :func:`run_round`, from the first stage that an earlier run has not finished.

    Nothing is done for a published iteration. Marks of a run with other inputs
    or constants are refused. One run of an iteration at a time.
    """
    steps = {
        "weights": move_weights,
        "scored": lambda *_: write_scores(spark, job, load_weights(spark, job.folder("weights"), job.iteration)),
        "threshold": write_threshold,
        "processed": write_processed,
        "selected": write_selected,
    }
    with scratch(spark):
        for stage in STAGES:
            mark = read_mark(spark, job.mark(stage))
            if mark is None:
                steps[stage](spark, job)
                write_mark(spark, job.mark(stage), job.constants())
            elif mark != job.constants():
                raise ValueError(f"stage {stage} of iteration {job.iteration} was run with {mark}")
        weights = load_weights(spark, job.folder("weights"), job.iteration)
        if read_mark(spark, job.manifest()) is None:
            save_weights(spark, weights, f"{job.output}/weights", job.iteration)
            outputs = [*STAGES, *(["flags"] if job.source is not None else [])]
            write_mark(spark, job.manifest(), {**job.constants(), "outputs": outputs})
    return weights


def _scored_and_limit(spark: SparkSession, job: Round) -> tuple[DataFrame, float | None]:
    return spark.read.parquet(job.folder("scored")), read_mark(spark, job.folder("threshold"))["threshold"]


def write_threshold(spark: SparkSession, job: Round) -> None:
    remove_mark(spark, job.folder("threshold"))
    limit = top_n_threshold(spark.read.parquet(job.folder("scored")), "score", job.top_n)
    write_mark(spark, job.folder("threshold"), {"threshold": limit})


def write_processed(spark: SparkSession, job: Round) -> None:
    """All scored lines with their score and flag."""
    scored, limit = _scored_and_limit(spark, job)
    flagged = scored.withColumn("selection", flag_from(F.col("score"), limit))
    scored_line = with_field(F.col("line"), f"score_{job.iteration}", F.col("score"))
    write_lines(
        flagged.withColumn("line", with_field(scored_line, "selection", F.col("selection"))),
        "line",
        job.folder("processed"),
        ["subfolder", "file"],
        "overwrite",
    )
    if job.source is not None:
        flagged.select(*LINE_KEY, "selection").write.mode("overwrite").parquet(job.folder("flags"))


def write_selected(spark: SparkSession, job: Round) -> None:
    """The lines that reach the threshold."""
    scored, limit = _scored_and_limit(spark, job)
    chosen = reaching(scored, "score", limit)
    if job.source is not None:
        chosen = lines_of(numbered_lines(spark, job.source, pattern=job.pattern), chosen)
    chosen = chosen.withColumn("part", output_name(F.col("subfolder"), F.col("file")))
    write_lines(chosen, "line", job.folder("selected"), ["part"], "overwrite")


def flag_lines(lines: DataFrame, score: str, n: int) -> DataFrame:
    """Flag already scored JSON lines; a line without the score counts as 0."""
    parsed = parse_records(lines, score=score)
    limit = top_n_threshold(parsed, "score", n)
    return parsed.withColumn("selection", flag_from(F.col("score"), limit))
