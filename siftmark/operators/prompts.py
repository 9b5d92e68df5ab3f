"""Evaluation items turned into prompts and answers, one column pair per task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.functions.text import join_question_answer, mask_prompt

TULU, INST, RAW = "tulu", "inst", "raw"


def letter(number: Column, base: int) -> Column:
    """The capital ``number`` places after the character ``base``."""
    return F.char(number.cast("int") + base)


def chat(body: Column, style: str = TULU, lead: str = fixed.ANSWER_LEAD) -> Column:
    """Wrap a prompt body for a chat model; the raw style leaves it alone."""
    if style == TULU:
        return F.concat(F.lit(fixed.TULU_USER), body, F.lit(fixed.TULU_ASSISTANT + lead))
    if style == RAW:
        return body
    return F.concat(F.lit(fixed.INST_OPEN), body, F.lit(fixed.INST_CLOSE + lead))


def _passage(context: Column, question: Column) -> Column:
    instruction, passage_tag, question_tag, _ = fixed.LANGUAGE_TEMPLATES["english"]
    return F.concat(
        F.lit(f"{instruction}{passage_tag} "), context, F.lit(f"\n{question_tag} "), question, F.lit("\n")
    )


def _options(labels: Column, texts: Column) -> Column:
    """One ``label: text`` line per option."""
    lines = F.zip_with(labels, texts, lambda mark, text: F.concat(mark, F.lit(": "), text, F.lit("\n")))
    return F.array_join(lines, "")


def _lettered(texts: Column) -> Column:
    return F.array_join(
        F.transform(texts, lambda t, i: F.concat(letter(i, 65), F.lit(": "), t, F.lit("\n"))), ""
    )


def _spaced(value: Column) -> Column:
    return F.concat(F.lit(" "), value)


def _multiple_choice(stem: str):
    def build():
        options = _options(F.col("choices")["label"], F.col("choices")["text"])
        return F.concat(F.col(stem), F.lit("\n"), options), F.col("answerKey")

    return build


def _boolq():
    answer = F.when(F.col("answer"), "True").otherwise("False")
    return _passage(F.col("passage"), F.col("question")), _spaced(answer)


def _squad():
    return _passage(F.col("context"), F.col("question")), _spaced(F.get("answers.text", F.lit(0)))


def _race():
    body = F.concat(_passage(F.col("article"), F.col("question")), _lettered(F.col("options")))
    return body, _spaced(F.col("answer"))


def _social_iqa():
    options = _lettered(F.array("answerA", "answerB", "answerC"))
    body = F.concat(_passage(F.col("context"), F.col("question")), options)
    return body, _spaced(letter(F.col("label"), 64))


def _sciq():
    options = _lettered(F.array("distractor1", "distractor2", "distractor3", "correct_answer"))
    return F.concat(F.col("question"), F.lit("\n"), options), _spaced(F.col("support"))


def _winogrande():
    options = _lettered(F.array("option1", "option2"))
    body = F.concat(F.col("sentence"), F.lit("\nOption:\n"), options)
    return body, _spaced(letter(F.col("answer"), 64))


def _hellaswag():
    body = F.concat(
        F.lit(f"{fixed.SENTENCE_INSTRUCTION}Sentence:\n"),
        F.col("ctx"),
        F.lit("____\nChoices:\n"),
        _lettered(F.col("endings")),
    )
    return body, _spaced(letter(F.col("label"), 65))


def _lambada():
    body = F.concat(
        F.lit(f"{fixed.LAST_WORD_INSTRUCTION}Sentence:\n"), F.col("until_last"), F.lit(" _____\n")
    )
    return body, _spaced(F.col("last_word"))


def _jeopardy():
    body = F.concat(
        F.lit(f"{fixed.DESCRIPTION_INSTRUCTION}\nDescription:\n"), F.col("context"), F.lit("\n")
    )
    return body, _spaced(F.col("continuation"))


def _mmlu():
    """Options are the columns between question and answer; a subject word per underscore."""
    subject = F.concat(F.lit(" "), F.replace(F.col("subject"), F.lit("_"), F.lit(" ")))
    options = F.array_join(
        F.transform("options", lambda t, i: F.concat(F.lit("\n"), letter(i, 65), F.lit(". "), t)), ""
    )
    body = F.concat(
        F.lit(fixed.MMLU_INSTRUCTION), subject, F.lit(".\n\n"), F.col("question"), options, F.lit("\nAnswer:")
    )
    return body, _spaced(F.col("answer"))


CHAT_TASKS: dict[str, Callable[[], tuple[Column, Column]]] = {
    "mmlu": _mmlu,
    "arc_easy": _multiple_choice("question"),
    "arc_challenge": _multiple_choice("question"),
    "boolq": _boolq,
    "commonsense_qa": _multiple_choice("question"),
    "openbookqa": _multiple_choice("question_stem"),
    "race": _race,
    "sciq": _sciq,
    "social_iqa": _social_iqa,
    "winogrande": _winogrande,
    "hellaswag": _hellaswag,
    "lambada": _lambada,
    "jeopardy": _jeopardy,
    "squad": _squad,
}


def _bbh(items: DataFrame, style: str) -> DataFrame:
    """Each of a task's last three worked examples in turn is asked.

    The other two go before it, which only the tulu style shows.
    """
    parts = F.split("text", "\n\n")
    size = F.size("parts")
    cut = items.withColumn("parts", parts).select(
        "*",
        F.regexp_replace(
            F.array_join(F.slice("parts", 1, F.greatest(size - 3, F.lit(0))), "\n\n"), r"\A\s+|\s+\z", ""
        ).alias("intro"),
        F.slice("parts", F.greatest(size - 2, F.lit(1)), 3).alias("examples"),
    )
    asked = cut.select("*", F.posexplode("examples").alias("example_no", "example"))
    halves = F.split("example", "\nA:")
    shown = F.array_join(
        F.transform(
            F.filter("examples", lambda e, i: i != F.col("example_no")),
            lambda e: F.concat(e, F.lit("\n\n")),
        ),
        "",
    )
    question, answer = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    gap = F.lit("\n\n")
    if style == TULU:
        prompt = F.concat(
            F.lit(fixed.TULU_USER), "intro", gap, shown, question, F.lit(fixed.TULU_ASSISTANT + "A:")
        )
    elif style == INST:
        prompt = F.concat(F.lit(fixed.INST_OPEN), "intro", F.lit(" "), question, F.lit(fixed.INST_CLOSE + "A:"))
    else:
        prompt = F.concat("intro", gap, question, F.lit("\nA:"))
    return asked.select(
        *items.columns, "example_no", prompt.alias("prompt"), answer.alias("answer_text")
    ).withColumnRenamed("answer_text", "completion")


def _tydiqa(items: DataFrame, style: str, chinese: bool) -> DataFrame:
    templates = {
        lang: (fixed.CHINESE_TEMPLATE if chinese else text)
        for lang, text in fixed.LANGUAGE_TEMPLATES.items()
    }

    def part(n: int) -> Column:
        chosen = F.lit(None).cast("string")
        for lang, text in templates.items():
            chosen = F.when(F.col("language") == lang, F.lit(text[n])).otherwise(chosen)
        return chosen

    body = F.concat(
        part(0), part(1), F.lit(" "), "context", F.lit("\n"), part(2), F.lit(" "), "question", F.lit("\n")
    )
    if style == TULU:
        prompt = F.concat(F.lit(fixed.TULU_USER), body, F.lit("<|assistant|>\n"), part(3))
    elif style == INST:
        prompt = F.concat(F.lit(fixed.INST_OPEN), body, F.lit(fixed.INST_CLOSE), part(3))
    else:
        prompt = F.concat(body, part(3))
    return items.where(F.col("language").isin(list(templates))).select(
        "*", prompt.alias("prompt"), _spaced(F.col("answer")).alias("completion")
    )


def build_prompts(items: DataFrame, task: str, style: str = TULU, chinese: bool = False) -> DataFrame:
    """Add ``prompt`` and ``completion`` for ``task``; an unknown task is an error."""
    if task == "bbh":
        return _bbh(items, style)
    if task == "tydiqa":
        return _tydiqa(items, style, chinese)
    if task not in CHAT_TASKS:
        raise ValueError(f"unknown task {task!r}")
    body, answer = CHAT_TASKS[task]()
    return items.select("*", chat(body, style).alias("prompt"), answer.alias("completion"))


def encode_pairs(
    pairs: DataFrame,
    tokens: Callable[[Column], Column],
    eos: str,
    max_length: int = fixed.SEQUENCE_LENGTH,
    ignore: Column | None = None,
) -> DataFrame:
    """(question, answer) rows as input_ids, labels and attention_mask.

    The answer follows the question after a blank, if neither side has one, and
    ends with ``eos``; the question's tokens are masked in the labels.
    """
    whole = join_question_answer(F.col("question"), F.col("answer"), eos)
    marked = pairs.withColumn("prompt", F.col("question"))
    after = F.expr("substring(_whole, length(question) + 1)")
    marked = marked.withColumn("_whole", whole).withColumn("completion", after).drop("_whole")
    return tokenize_prompts(marked, tokens, max_length, ignore).drop("prompt", "completion")


def tokenize_prompts(
    prompts: DataFrame,
    tokens: Callable[[Column], Column],
    max_length: int = fixed.SEQUENCE_LENGTH,
    ignore: Column | None = None,
) -> DataFrame:
    """Add input_ids, labels (prompt masked) and attention_mask.

    Prompt and full text are tokenized apart; both are cut to ``max_length``.
    """
    ignore = F.lit(fixed.IGNORE_INDEX) if ignore is None else ignore
    tokenized = prompts.select(
        "*",
        F.slice(tokens(F.concat("prompt", "completion")), 1, max_length).alias("input_ids"),
        F.least(F.size(tokens(F.col("prompt"))), F.lit(max_length)).alias("prompt_length"),
    )
    return tokenized.select(
        *prompts.columns,
        "input_ids",
        mask_prompt(F.col("input_ids"), F.col("prompt_length"), max_length, ignore).alias("labels"),
        F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
    )
