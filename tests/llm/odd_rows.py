"""Rows that operators must survive: nulls, blanks, ties, repeats, a long text, clashing columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _key long, "
    "_row string, _text string, size string, recipe int, fingerprint string, component_id long, spans string, "
    "score string, n_words string, target string, taken string, `_doc` string, hash int, label string"
)


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows():
    long = " ".join(words(1, 30_000))
    passage = " ".join(words(2, 60))
    some = [
        (0, None, "en", "a"),
        (1, "", "en", "a"),
        (2, " \t\n\x0b\x0c\r", None, None),
        (3, long, "en", "b"),
        (4, long + " end", "de", "b"),
        (5, "Same text, twice. " * 5, "en", "a"),
        (5, "Same text, twice. " * 5, "en", "a"),
        (6, "Same  text, twice.\n" * 5, None, "c"),
        (7, "one two " + passage + " three", "fr", "a"),
        (8, passage + " four five", "fr", "a"),
        (9, "é   ß 你好 😀 token = 'abcdef123' 　", "xx", "ü"),
        (10, "a" * 5000, "en", "z"),
        (11, " ".join(words(3, 400)), "en", "a"),
        (12, " ".join(words(3, 400)), "en", "b"),
        (13, "x\x00y <|endoftext|> z", "en", "a"),
        (None, "no id, " + " ".join(words(4, 80)), "en", None),
        (None, None, None, None),
        (14, " ".join(words(5, 34)), "en", "a"),
        (15, " ".join(words(5, 35)), "en", "a"),
        (15, "another text with the same id " + " ".join(words(6, 90)), "en", "a"),
    ]
    rest = (True, 1, "r", "t", "s", 1, "f", 1, "s", "s", "w", "t", "k", "d", 1, "l")
    return [(*r, None if r[1] is None else len(r[1]), *rest) for r in some]


def frame(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, every=True):
    marks = [(r[0], int(r[0] % 3 != 0), int(r[0] % 4 == 0), "x") for r in rows() if r[0] is not None]
    marks += [(None, 1, 1, "x"), (11, None, None, "x"), (12, 0, 1, "y")]
    return spark.createDataFrame(marks if every else [], "doc_id long, quality int, toxic int, text string")
