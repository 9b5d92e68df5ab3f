"""Quality rules whose cutoffs are certified on labelled documents.

Every rule compares one statistic of a document with a cutoff. For each stratum
(a language) and rule, cutoffs are tried from the loosest on. A cutoff is
certified if, were its false rejection rate above ``risk``, so few rejections of
good documents as were seen would have a probability of at most ``delta`` over
the number of (stratum, rule) pairs: the exact binomial tail with Bonferroni's
correction, and a fixed order of tests within a pair, so that the first failure
ends it. With probability 1 - delta all chosen cutoffs keep their promise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import growing, join_spread, text_bytes
from siftmark.session import materialize

BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Statistic and its cutoffs, loosest first; a document above the cutoff is rejected.
RULES: dict[str, tuple[Column | str, list[float]]] = {
    "symbols": ("n_symbols / greatest(1, word_chars)", [round(0.5 * 0.8**i, 6) for i in range(20)]),
    "dup_lines": ("n_dup_lines / greatest(1, n_lines)", [round(0.95 - 0.05 * i, 6) for i in range(18)]),
    "repeats": ("n_repeat_words / greatest(1, n_words)", [round(0.95 - 0.05 * i, 6) for i in range(18)]),
    "long_words": ("word_chars / greatest(1, n_words)", [round(30 * 0.9**i, 6) for i in range(16)]),
    "short_words": ("-word_chars / greatest(1, n_words)", [round(-1 - 0.25 * i, 6) for i in range(13)]),
}
#: A rejected good document weighs as much as so many rejected bad ones.
GOOD_WEIGHT = 20


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that occur twice or more, the first included."""
    if len(words) <= width:
        return 0
    names: dict[bytes, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    window = codes[: len(words) - width + 1]
    for k in range(1, width):
        window = window * len(names) + codes[k : k + len(window)]
        if len(names) > 1_000_000 or k < width - 1 and width > 3:  # keep products within 63 bits
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def measures(content: bytes) -> tuple[int, ...]:
    """The numbers in ``COUNTS`` of one text."""
    words = content.split()
    lines = [x for x in content.split(b"\n") if x.strip()]
    return (
        len(words),
        len(content.translate(None, BLANKS).decode()),
        len(content) - len(content.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def text_measures(
    docs: DataFrame, id_col: str = "doc_id", stratum: str = "lang", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, stratum, columns to carry, the ``COUNTS``, base_failed); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [measures(x) for x in text_bytes(batch.column(0))]
            columns = zip(*made) if made else [()] * len(COUNTS)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*names, *COUNTS])

    names = [id_col, stratum, *carry]
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(stratum)
    named = docs.select(F.col(text).alias("_text"), F.col(id_col), group, *carry)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema[1:]]
    schema = ", ".join([*kinds, *(f"{c} long" for c in COUNTS)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return named.mapInArrow(run, schema).withColumn("base_failed", failed)


def tail(k: int, n: int, risk: float) -> float:
    """P(X <= k) of a binomial X with n draws of probability ``risk``.

    Terms are added from k downwards until a geometric series that bounds all the
    others is next to nothing, and that bound is added too: never too small.
    """
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    total = term = 1.0
    for i in range(k, 0, -1):
        ratio = i / (n - i + 1) * (1 - risk) / risk  # falls with i
        if ratio < 1 and term * ratio / (1 - ratio) <= 1e-12 * total:
            total += term * ratio / (1 - ratio)
            break
        term *= ratio
        total += term
        if total > 1e200:
            log, term, total = log + math.log(total), term / total, 1.0
    return math.exp(min(0.0, log + math.log(total)))


def choose(good: list[int], gains: list[int], n_good: int, risk: float, level: float) -> int | None:
    """The place of the certified cutoff with the largest gain, the loosest such; None
    if no cutoff gains anything.

    ``good`` counts good documents above each cutoff, loosest first.
    """
    best, place = 0, None
    for i, (g, gain) in enumerate(zip(good, gains)):
        if g > risk * n_good or tail(g, n_good, risk) > level:
            break
        if gain > best:
            best, place = gain, i
    return place


def certified_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    delta: float = 0.05,
    id_col: str = "doc_id",
    stratum: str = "lang",
) -> DataFrame:
    """(stratum, one column per rule): the chosen cutoff, null where none was certified.

    ``labels`` has (id, quality); of several labels of an id the lowest counts,
    null ones do not. Documents that fail the base rules are left out on both
    sides, for they are rejected anyway. All labelled rows count. ``risk`` is
    shared out among the rules. The rules are fitted in order: what a rule gains
    is the bad documents that no earlier one rejects, less ``GOOD_WEIGHT`` times
    such good ones; so a rule that adds nothing stays off. What is gathered for
    a stratum is a row for each combination of cutoffs passed, and label.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    rows = measured.where("NOT base_failed").join(growing(marks), id_col)
    above = [
        sum((F.expr(value) > c).cast("int") for c in cutoffs).alias(name) for name, (value, cutoffs) in RULES.items()
    ]
    table = rows.select(stratum, (F.col("quality") >= 1).alias("good"), *above)
    table = table.groupBy(stratum, "good", *RULES).count()
    table = materialize(table, "rule-counts")
    strata = table.select(stratum).distinct().count()
    level = delta / max(1, strata * len(RULES))
    each = risk / len(RULES)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = {stratum: key[0]}
        good, count = frame["good"].to_numpy(bool), frame["count"].to_numpy()
        left = np.ones(len(frame), bool)
        n_good = int(count[good].sum())
        for name, (_, cutoffs) in RULES.items():
            # who is above the i-th cutoff is above all stricter ones
            over = [frame[name].to_numpy() >= len(cutoffs) - i for i in range(len(cutoffs))]
            rejected = [int(count[good & x].sum()) for x in over]
            gains = [
                int(count[~good & left & x].sum()) - GOOD_WEIGHT * int(count[good & left & x].sum()) for x in over
            ]
            place = choose(rejected, gains, n_good, each, level) if n_good else None
            out[name] = None if place is None else cutoffs[place]
            if place is not None:
                left &= ~over[place]
        return pd.DataFrame([out], columns=[stratum, *RULES])

    schema = f"`{stratum}` string, " + ", ".join(f"{r} double" for r in RULES)
    return table.groupBy(stratum).applyInPandas(fit, schema)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    delta: float = 0.05,
    id_col: str = "doc_id",
    stratum: str = "lang",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, stratum, columns to carry, the ``COUNTS``, base_failed, kept) of every document.

    ``kept`` is false for documents that fail the base rules or lie above a
    cutoff of their stratum. Null or empty texts fail. A null stratum is the
    stratum ''. A stratum without labelled rows, or too few, has no cutoffs: the
    base rules decide. Rows that repeat an id get a row each; a null id has no
    label and is judged. Other columns are ignored; an empty table gives none.
    """
    measured = materialize(text_measures(docs, id_col, stratum, text, carry), "measures")
    cutoffs = materialize(certified_cutoffs(measured, labels, risk, delta, id_col, stratum), "cutoffs")
    over = [F.coalesce(F.expr(value) > F.col(name), F.lit(False)) for name, (value, _) in RULES.items()]
    rejected = F.col("base_failed")
    for rule in over:
        rejected = rejected | rule
    return (
        join_spread(measured, cutoffs, [stratum], "left")
        .withColumn("kept", ~rejected)
        .select(*measured.columns, "kept")
    )
