"""Token and prompt expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed

BLANKS = r"[ \t\n\r\f]+"


def words(text: Column) -> Column:
    """The default tokenizer: pieces between blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def join_question_answer(question: Column, answer: Column, eos: str = "") -> Column:
    """Question and answer, with a space between unless either side has a blank there."""
    blank = question.rlike(r"[ \n\t]\z") | answer.rlike(r"\A[ \n\t]")
    return F.concat(question, F.when(blank, F.lit("")).otherwise(F.lit(" ")), answer, F.lit(eos))


def mask_prompt(tokens: Column, prompt_length: Column, max_length: int, ignore: Column) -> Column:
    """Labels: ``tokens`` cut to ``max_length`` with the prompt's places ignored."""
    kept = F.slice(tokens, 1, max_length)
    masked = F.least(prompt_length, F.size(kept))
    return F.concat(
        F.array_repeat(ignore, masked),
        F.slice(kept, masked + 1, F.greatest(F.size(kept) - masked, F.lit(0))),
    )


def pad_or_cut(tokens: Column, length: int, pad: Column) -> Column:
    """The first ``length`` tokens, filled up with ``pad`` on the right."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(pad, F.lit(length) - F.size(kept)))


def padded_rows(df: DataFrame, length: int, pad: Column, ignored: Column) -> DataFrame:
    """``input_ids`` and ``labels`` cut or filled up to ``length``, with the mask of what was there."""
    there = F.least(F.size("input_ids"), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), there), F.array_repeat(F.lit(0), F.lit(length) - there))
    return df.withColumns(
        {
            "attention_mask": mask,
            "input_ids": pad_or_cut(F.col("input_ids"), length, pad),
            "labels": pad_or_cut(F.col("labels"), length, ignored),
        }
    )


def counted_labels(labels: Column, ignore: int = fixed.IGNORE_INDEX) -> Column:
    """How many labels take part in the loss."""
    return F.size(F.filter(labels, lambda x: x != ignore))


def _part(path: Column, name: str, rest: str) -> Column:
    """The value of a ``name=value`` folder in a path, or null."""
    return F.nullif(F.regexp_extract(path, rf"/{name}=([^/]+)/{rest}[^/]+\z", 1), F.lit(""))


def file_name(path: Column) -> Column:
    """The file's name; for files written as ``file=<name>/part-...`` that name."""
    return F.coalesce(_part(path, "file", ""), F.element_at(F.split(path, "/"), -1))


def folder_name(path: Column) -> Column:
    """The folder's name; for ``subfolder=<name>/file=<name>/part-...`` that of the subfolder."""
    return F.coalesce(_part(path, "subfolder", r"(?:file=[^/]+/)?"), F.element_at(F.split(path, "/"), -2))
