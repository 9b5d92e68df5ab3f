"""Spelling variants grouped with their most frequent form, by PartEnum signatures.

A word's letters are a multiset, and a multiset is a binary vector with a place
for each (letter, how many times at least). A replaced letter changes two places,
an inserted or deleted one changes one. So, with the places dealt to three parts,
two words that differ by a replaced letter agree in one part at least, and with
two parts so do words of which one has a letter more. A signature is a part's
letters; words meet in an equi-join on signatures and are verified.

Multisets alone let far too many words meet, for anagrams and their neighbours
are no near words. A word is therefore cut into thirds too: one edit leaves two
of them as they are, which a signature names besides its part's letters.
"""

from __future__ import annotations

from math import ceil, floor, log2, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import join_spread
from siftmark.session import materialize

LETTER = r"[A-Za-zÀ-ÿ]"
_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def occurring_words(
    docs: DataFrame, least: int = 7, typo_every: int = 31, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): words of at least ``least`` letters in all texts, and how often they occur.

    A word is a maximal run of Latin letters, of which only A-Z are lowered. Where
    the CRC-32 of ``<id>:<run>`` is a multiple of ``typo_every``, the run loses the
    letter at that number modulo its length. Null texts have no words; a null id
    is written as nothing.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("_run"),
    ).withColumn("_run", F.translate("_run", _UPPER, _UPPER.lower()))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    length = F.length("_run")
    at = (F.col("_h") % length).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, length))
    words = runs.select(F.when(F.col("_h") % typo_every == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def letter_parts(words: DataFrame, parts: int) -> list[str]:
    """The letters of ``words`` dealt to ``parts``, so that parts hold about equally many
    in all. What is counted on the driver is a number for each letter of the alphabet."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    counts = letters.groupBy("letter").count().collect()  # as many rows as letters
    dealt, load = [""] * parts, [0] * parts
    for letter, n in sorted(counts, key=lambda r: (-r[1], r[0])):
        lightest = load.index(min(load))
        dealt[lightest] += letter
        load[lightest] += n
    return dealt


def _thirds(length: Column) -> list[Column]:
    """What is left of a word beyond each of its thirds, as thirds of a word of ``length``."""
    word, a = F.col("word"), F.floor(length / 3).cast("int")

    def first(n: Column) -> Column:
        return F.substring(word, F.lit(1), n)

    def last(n: Column) -> Column:
        return F.substring(word, F.length(word) - n + 1, n)

    rest = (length - a).cast("int")
    return [last(rest), F.concat(first(a), F.lit("|"), last(a)), first(rest)]


def signatures(words: DataFrame, length: Column, parts: list[str]) -> DataFrame:
    """(signature, word, n): a row for each part of the letters and each third left out.

    Only equal signatures of the same ``parts`` and ``length`` are to meet. They are
    hashed to 64 bits: a clash lets two words meet that verification parts again.
    """
    keys = []
    for part in range(len(parts)):
        others = "".join(p for k, p in enumerate(parts) if k != part)
        own = F.translate("_letters", others, "") if others else F.col("_letters")
        for third, kept in enumerate(_thirds(length)):
            keys.append(F.xxhash64(length.cast("int"), F.lit(part), F.lit(third), kept, own))
    sorted_letters = F.array_join(F.array_sort(F.split("word", "")), "")
    return words.withColumn("_letters", sorted_letters).select(F.explode(F.array(*keys)).alias("signature"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n) that differ by exactly one
    inserted, deleted or replaced letter, once.

    ``words`` is read several times, so pass a written table of distinct words of
    three letters at least. Null words meet nothing.
    """

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = right.select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"))
        return left.join(right, "signature")

    length = F.length("word")
    three, two = letter_parts(words, 3), letter_parts(words, 2)
    same = signatures(words, length, three)
    replaced = meet(same, same).where("a < b")
    inserted = meet(signatures(words, length, two), signatures(words, length - 1, two))
    one_edit = F.levenshtein("a", "b", 1) == 1
    found = replaced.where(one_edit).unionByName(inserted.where(one_edit))
    return found.select("a", "a_n", "b", "b_n").distinct()


def _followed(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends. Each step makes the
    number of occurrences ten times larger, so ``most`` occurrences bound the steps,
    and each round here doubles those taken."""
    steps = floor(log10(most)) + 1 if most > 0 else 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps + 1))):
        roots = materialize(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        further = join_spread(roots, ahead, ["root"], "left")
        roots = further.select("word", F.coalesce("_ahead", "root").alias("root"))
    return materialize(roots, "roots")


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root): each word's form and what that leads to.

    ``words`` has (word, n), distinct words of three letters at least. A word's form is
    its near word of largest n, the smallest of several, if that is at least ``times``
    its own n (ten at least, or chains could be long), else null. The root is where
    forms end, the word itself without a form. An empty table gives none.
    """
    if times < 10:
        raise ValueError("forms must be at least ten times as frequent")
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.unionByName(pairs.selectExpr("b AS a", "b_n AS a_n", "a AS b", "a_n AS b_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("_best")
    )
    own = F.col("_best.less") <= -times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(own, F.col("_best.form")).alias("form"),
        F.when(own, -F.col("_best.less")).alias("form_n"),
    )
    found = materialize(found, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _followed(found.where("form IS NOT NULL"), most)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, least: int = 7, at_least: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``variant_groups`` of the words of ``docs`` that occur ``at_least`` times. Rows that
    repeat count for themselves; other columns are ignored; an empty table gives none."""
    return variant_groups(occurring_words(docs, least, id_col=id_col, text=text).where(F.col("n") >= at_least))
