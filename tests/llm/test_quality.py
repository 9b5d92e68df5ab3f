"""Quality rules, toxicity and co-training: counts by hand, certified risks, held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import odd_rows
from siftmark.llm import co_training, ftrl, quality_rules, queries, toxicity
from siftmark.llm.quality_rules import choose, measures, repeat_words, tail


def measured_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)
    )


def test_measures():
    rng = random.Random(3)
    parts = ["a", "b", "c", "é#", "**", "\n", "\n\n", " ", "\x0b", "\r", " ", "x y z", "|"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))
        assert measures(text.encode()) == measured_by_hand(text), repr(text)


def test_repeats_among_many_different_words():
    words = [b"%d" % i for i in range(5000)] + [b"7", b"8", b"9", b"x", b"4998", b"4999", b"7"]
    count = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert repeat_words(words) == len(hit)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (20, 400, 0.06), (5, 5, 0.2)])
def test_binomial_tail(k, n, p):
    assert tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("deviations,want", [(1, 0.158655), (2, 0.0227501), (4, 3.16712e-5)])
def test_binomial_tail_of_many_draws(deviations, want):
    n, p = 10**9, 0.02
    k = int(n * p - deviations * math.sqrt(n * p * (1 - p)))
    assert tail(k, n, p) == pytest.approx(want, rel=5e-3)


def test_cutoffs_are_tried_from_the_loosest_until_one_fails():
    assert choose([0, 0, 0, 400], [0, 9, 9, 50], 4000, 0.01, 0.001) == 1
    assert choose([0, 0], [0, 0], 4000, 0.01, 0.001) is None  # gains nothing
    assert choose([0, 0], [5, 9], 30, 0.01, 0.001) is None  # too few to certify
    assert choose([0, 1], [5, 4], 4000, 0.01, 0.001) == 0
    assert choose([400, 400], [900, 900], 4000, 0.01, 0.001) is None


def test_certified_risk_holds_on_new_documents():
    """True rejection rates of chosen cutoffs stay within the risk but for a share of delta."""
    rng = np.random.default_rng(8)
    cutoffs = np.linspace(3, 1, 30)
    worse = 0
    for _ in range(300):
        good, bad = rng.normal(0, 1, 2000), rng.normal(2, 1, 2000)
        place = choose([int((good > c).sum()) for c in cutoffs], [int((bad > c).sum()) * 100 for c in cutoffs], 2000, 0.05, 0.05)
        worse += place is not None and 0.5 * math.erfc(cutoffs[place] / math.sqrt(2)) > 0.05
    assert worse <= 300 * 0.05 + 8


def test_judged_odd_rows(spark):
    docs = odd_rows.frame(spark)
    found = quality_rules.judged(docs, odd_rows.labels(spark)).collect()
    want = [(r[0], r[2] or "", *measured_by_hand(r[1] or "")) for r in odd_rows.rows()]
    assert sorted((tuple(r)[:8] for r in found), key=repr) == sorted(want, key=repr)
    for r in found:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # too few labels to certify any cutoff
    assert len(quality_rules.judged(docs, odd_rows.labels(spark, False)).collect()) == len(want)
    assert quality_rules.judged(odd_rows.empty(spark), odd_rows.labels(spark)).collect() == []


def marked(spark, n=2400):
    """Documents of two languages; bad ones have symbols, toxic ones some of a few words."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 7 == 0, i % 9 == 0
        words = odd_rows.words(i, rng.randint(60, 200), 800)
        if bad:
            words = [w + "%%" if rng.random() < 0.5 else w for w in words]
        if toxic:
            words += rng.sample(["idiot", "scum", "worthless", "moron", "clown"], 3)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 4}", 0))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.fixture(scope="module")
def sample(spark):
    return marked(spark)


def test_rules_reject_bad_and_keep_good(spark, sample):
    docs, labels, marks = sample
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels, risk=0.05).collect()}
    assert sum(kept[i] for i, good, _ in marks if not good) == 0
    assert all(kept[i] for i, good, _ in marks if good)


def test_a_rule_that_adds_nothing_stays_off(spark, sample):
    docs, labels, _ = sample
    measured = quality_rules.text_measures(docs)
    rows = quality_rules.certified_cutoffs(measured, labels, risk=0.05).collect()
    assert {r.lang for r in rows} == {"en", "de"}
    for r in rows:  # symbols tell the bad ones, whose words are longer too
        assert r.symbols is not None and r.long_words is None and r.short_words is None


def test_toxicity_on_held_out_rows(spark, sample):
    docs, labels, marks = sample
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(found[i], t) for i, _, t in marks if found[i].held_out]
    assert len(held) > 300
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r, _ in held)
    assert np.mean([r.predicted == t for r, t in held]) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, sample):
    docs, labels, _ = sample
    outside = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5"
    turned = labels.selectExpr("doc_id", f"IF({outside} = 0, 1 - toxic, toxic) AS toxic")
    small = docs.where("doc_id < 300")
    one = sorted(map(tuple, toxicity.toxicity(small, labels).collect()))
    assert one == sorted(map(tuple, toxicity.toxicity(small, turned).collect()))


def test_toxicity_odd_rows(spark):
    docs = odd_rows.frame(spark)
    for every in (True, False):
        found = toxicity.toxicity(docs, odd_rows.labels(spark, every)).collect()
        assert len(found) == len(odd_rows.rows())
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
        blank = {r.score for r in found if r.doc_id in (0, 1, 2)}
        assert len(blank) == 1
    assert toxicity.toxicity(odd_rows.empty(spark), odd_rows.labels(spark)).collect() == []


def test_ftrl_forgets_what_does_not_help():
    rng = np.random.default_rng(1)
    model = ftrl.Ftrl(1000)
    for _ in range(3000):
        noise = np.unique(rng.integers(10, 1000, 20))
        label = rng.integers(0, 2)
        model.learn(np.concatenate([[0, 5 if label else 6], noise]), label)
    weights = model.weights()
    assert weights[5] > 1 and weights[6] < -1
    assert np.mean(weights[10:] == 0) > 0.8


def test_co_training_on_rows_it_has_not_seen(spark, sample):
    docs, labels, marks = sample
    known = labels.where("doc_id % 4 = 0")
    found = {r.doc_id: r for r in co_training.quality_scores(docs, known).collect()}
    unseen = [(found[i], good) for i, good, _ in marks if i % 4]
    assert np.mean([r.kept == bool(good) for r, good in unseen]) > 0.97
    assert np.mean([r.kept for r, good in unseen if good]) > 0.985


def test_co_training_hands_over_a_share_of_the_whole_table(spark, sample):
    docs, labels, marks = sample
    some = co_training.label_sample(labels, "doc_id", 300)
    stored = co_training.stored_features(docs, some, "doc_id")
    model = co_training.fit(stored, unlabelled=40)
    assert model["pool"] == len(marks) - 300  # labels beyond the sample are in the pool
    most = int(model["pool"] * co_training.SHARE)
    assert len(model["handed"]) == co_training.ROUNDS and most > 40
    assert max(n for turn in model["handed"] for n in turn) == most


def test_co_training_cut_of_the_share():
    assert co_training._cut({9: 10, 7: 20, 3: 70}, 20) == (7, co_training.PARTS // 2, 20)
    assert co_training._cut({9: 10}, 20) == (-1, 0, 10)


def test_co_training_odd_rows(spark):
    docs = odd_rows.frame(spark)
    for every in (True, False):
        found = co_training.quality_scores(docs, odd_rows.labels(spark, every)).collect()
        assert len(found) == len(odd_rows.rows())
        assert all(r.kept is not None for r in found)
        assert every or all(r.kept and r.score is None for r in found)
    assert co_training.quality_scores(odd_rows.empty(spark), odd_rows.labels(spark)).collect() == []


def test_stored_labels_are_learned(spark, folder):
    """On the small stored tables, with their own labels."""
    marks = {r.doc_id: r for r in queries.labels(spark, folder).collect()}
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op7_co_training"](spark, folder).collect()}
    good = [kept[i] for i, r in marks.items() if r.quality]
    assert np.mean(good) > 0.95
