"""Files in, files out: scans with line numbers, scoring rules and whole rounds."""

import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from siftmark.operators.selection import lines_of, select_lines
from siftmark.operators.weights import AgentWeights
from siftmark.plans import selection_round
from siftmark.plans.selection_round import Round, flag_lines, published, resume_round, run_round
from siftmark.sources.corpus import missing_keys, parse_records, read_clusters, read_influences
from siftmark.sources.lines import numbered_lines, scan_lines, with_field
from siftmark.sources.manifests import read_mark, write_mark
from siftmark.sources.weight_files import load_weights
from test_weights import ORDER, update_by_loop


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "10")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("".join(line + "\n" for line in lines))


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    draw = random.Random(1)
    expected = {}
    for sub, name, count in (("a", "big", 900), ("a", "one", 1), ("b", "big", 300)):
        lines = [f"{sub}{name}{i}" + "x" * draw.randint(0, 60) for i in range(count)]
        lines[count // 2] = ""
        write(f"{tmp_path}/{sub}/{name}.jsonl", lines)
        expected.update({(sub, f"{name}.jsonl", i): line for i, line in enumerate(lines)})
    write(f"{tmp_path}/a/other.txt", ["no"])
    got = numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 1
    assert scan_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    rows = got.collect()
    assert len(rows) == len(expected)
    assert {(r.subfolder, r.file, r.line_no): r.line for r in rows} == expected


def test_one_level_scan_ignores_deeper_files(spark, tmp_path):
    write(f"{tmp_path}/a/x.jsonl", ["1"])
    write(f"{tmp_path}/a/b/y.jsonl", ["2"])
    assert [r.line for r in numbered_lines(spark, str(tmp_path), recursive=False).collect()] == ["1"]
    assert scan_lines(spark, str(tmp_path)).count() == 2


def test_selected_lines_by_key(spark, tmp_path):
    write(f"{tmp_path}/src/s/f.jsonl", ["l0", "l1", "l2"])
    write(f"{tmp_path}/src/t/f.jsonl", ["m0", "m1", "m2"])
    flags = {"s": ["1", "0", "true"], "t": ["1.0", '"1"', None]}
    for sub, values in flags.items():
        write(
            f"{tmp_path}/meta/{sub}/f.jsonl",
            ["{}" if v is None else f'{{"selection": {v}}}' for v in values],
        )
    meta = parse_records(numbered_lines(spark, f"{tmp_path}/meta"))
    chosen = select_lines(numbered_lines(spark, f"{tmp_path}/src"), meta).collect()
    assert sorted(r.line for r in chosen) == ["l0", "l2", "m0", "m1"]


@pytest.mark.parametrize("most", [0, 10**9])
def test_packed_and_shuffled_selection_agree(spark, monkeypatch, most):
    monkeypatch.setattr("siftmark.operators.selection.PACKED_BYTES", most)
    source = spark.range(100_000).selectExpr(
        "concat('s', id % 2) subfolder", "concat('f', id % 3) file", "id line_no", "concat('x', id) line"
    )
    chosen = source.where("line_no % 997 = 3 OR line_no > 99990").drop("line").union(source.limit(1).drop("line"))
    got = lines_of(source, chosen)
    assert ("LeftSemi" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
    expected = {i for i in range(100_000) if i % 997 == 3 or i > 99_990 or i == 0}
    rows = got.collect()
    assert {r.line_no for r in rows} == expected and len(rows) == len(expected)


def test_field_is_appended_and_the_last_one_counts(spark):
    rows = [('{"a": 1}',), ("{}",), ('{"s": 1, "b": {"c": 2}} ',)]
    got = spark.createDataFrame(rows, "line string").select(with_field(F.col("line"), "s", F.lit(0.5)))
    assert [json.loads(r[0]) for r in got.collect()] == [
        {"a": 1, "s": 0.5}, {"s": 0.5}, {"s": 0.5, "b": {"c": 2}}
    ]


def test_flagging_scored_lines_counts_a_missing_score_as_zero(spark):
    lines = [f'{{"score_1": {s}}}' for s in (0.3, 0.1, 0.2, -1.0)] + ["{}"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    flags = {r.line: r.selection for r in flag_lines(frame, "score_1", 4).collect()}
    assert flags == {**{x: 1 for x in lines}, lines[3]: 0}


def influence_files(base, seed, drop=None):
    draw = random.Random(seed)
    losses = {}
    for family, key in ORDER:
        if key == drop:
            continue
        folder = "edu" if family == "quality" else family
        name = key.replace("quality_", "edu_bin_")
        lines, kept = [], []
        for i in range(12):
            values = [draw.uniform(0, 5)]
            if i == 3:
                lines.append('{"other": 1}')
            elif i == 5:
                lines.append('{"influence": 3.5}')
            else:
                lines.append(json.dumps({"influence": values, "epoch": 1}))
                kept += values
        losses[family, key] = kept
        write(f"{base}/{folder}/{name}.jsonl", lines)
    return losses


#: Raw lines, and what each is worth by hand: (edu bucket or None, domain, topic, epoch divisor), or None.
FLAWED = {
    "": None, "   ": None, "not json": None, "[1]": None, "{}": None, '{"domain": "c4"}': None,
    '{"domain": "nowhere", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1.0, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": "1", "epoch": 0}': ("1_2", "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": " 2.5 ", "attr-cc_en_topic": 1, "epoch": 0}': ("2_3", "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": "2.5d", "attr-cc_en_topic": 1, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": "1_0", "attr-cc_en_topic": 1, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": true, "attr-cc_en_topic": 1, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": null, "attr-cc_en_topic": 1, "epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": "nan", "attr-cc_en_topic": 1, "epoch": 0}': (None, "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": NaN, "attr-cc_en_topic": 1, "epoch": 0}': (None, "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": 5.0, "attr-cc_en_topic": 1, "epoch": 0}': (None, "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": -0.5, "attr-cc_en_topic": 1, "epoch": 0}': (None, "c4", "1", 1.0),
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": "2"}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": -10}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": -20}': ("1_2", "c4", "1", -1.0),
    '{"domain": "c4", "attr-fineweb-edu": 1e0, "attr-cc_en_topic": 12, "epoch": 2.5, "score_1": 9}': ("1_2", "c4", "12", 1.25),
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": 0} junk': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": 0}]': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": 0}, {"epoch": 0}': None,
    '{"domain": "c4", "attr-fineweb-edu": 1, "attr-cc_en_topic": 1, "epoch": 0} {"epoch": 0}': None,
}


def worth(traits, weights, collaboration):
    """The score of a line's traits, or None."""
    if traits is None:
        return None
    bucket, domain, topic, divisor = traits
    parts = [weights.get(("quality", f"quality_{bucket}"), 0), weights["domain", domain], weights["topic", f"topic_{topic}"]]
    return sum(c * w for c, w in zip(collaboration, parts)) / divisor


def test_two_rounds_over_files(spark, tmp_path, small_splits):
    draw = random.Random(5)
    corpus, known = {}, {}
    for sub in ("alpha", "beta"):
        for name in ("f0", "f1"):
            lines, traits = [], []
            for _ in range(60):
                domain = draw.choice([k for f, k in ORDER if f == "domain"] + ["other"])
                low, topic, epoch = draw.randint(0, 5), draw.randint(0, 13), draw.randint(0, 3)
                record = {
                    "content": "text " * draw.randint(1, 9) + "é",
                    "domain": domain,
                    "attr-fineweb-edu": low + draw.choice([0.0, 0.25, 0.99]),
                    "attr-cc_en_topic": topic,
                    "epoch": epoch,
                }
                lines.append(json.dumps(record, ensure_ascii=False))
                good = domain != "other" and topic < 13
                traits.append((f"{low}_{low + 1}", domain, str(topic), 1 + 0.1 * epoch) if good else None)
            if (sub, name) == ("beta", "f0"):
                lines += FLAWED
                traits += FLAWED.values()
            write(f"{tmp_path}/corpus/{sub}/{name}.jsonl", lines)
            corpus.update({(sub, name, i): line for i, line in enumerate(lines)})
            write(f"{tmp_path}/source/{sub}/{name}.jsonl", [f"source line {(sub, name, i)}" for i in range(len(lines))])
            known.update({(sub, name, i): t for i, t in enumerate(traits)})

    weights = ({k: 10.0 for k in ORDER}, [1 / 3] * 3)
    for iteration in (1, 2):
        losses = influence_files(f"{tmp_path}/inf{iteration}", iteration)
        weights = update_by_loop(losses, *weights)
        job = Round(
            influence=f"{tmp_path}/inf{iteration}",
            corpus=f"{tmp_path}/corpus",
            source=f"{tmp_path}/source" if iteration == 2 else None,
            output=f"{tmp_path}/out",
            iteration=iteration,
            top_n=40,
        )
        got = run_round(spark, job)
        assert got.collaboration == pytest.approx(weights[1], rel=1e-12)
        assert load_weights(spark, f"{tmp_path}/out/weights", iteration) == got

        scores = {k: worth(t, *weights) for k, t in known.items()}
        scored = {k: s for k, s in scores.items() if s is not None}
        rows = spark.read.parquet(job.folder("scored")).collect()
        assert len(rows) == len(scored)
        if iteration == 2:
            assert {(r.subfolder, r.file[:-6], r.line_no) for r in rows} == set(scored)
            for r in rows:
                assert math.isclose(r.score, scored[r.subfolder, r.file[:-6], r.line_no], rel_tol=1e-12)
                assert r.line == corpus[r.subfolder, r.file[:-6], r.line_no]
        else:  # without a separate source no line is numbered
            assert {r.line_no for r in rows} == {None}
            got = sorted((r.subfolder, r.file[:-6], r.line, round(r.score, 9)) for r in rows)
            assert got == sorted((*k[:2], corpus[k], round(s, 9)) for k, s in scored.items())
        limit = sorted(scored.values(), reverse=True)[39]
        lines = {k: f"source line {k}" for k in corpus} if iteration == 2 else corpus
        expected = sorted(lines[k] for k, s in scored.items() if s >= limit * (1 - 1e-12))
        if iteration == 2:
            flags = spark.read.parquet(job.folder("flags"))
            again = select_lines(numbered_lines(spark, job.source), flags)
            assert sorted(r.line for r in again.collect()) == expected
        chosen = spark.read.option("recursiveFileLookup", True).text(job.folder("selected"))
        assert sorted(r.value for r in chosen.collect()) == expected
        processed = spark.read.option("recursiveFileLookup", True).text(job.folder("processed"))
        records = [json.loads(r.value) for r in processed.collect()]
        assert sum(r["selection"] for r in records) == len(expected) and len(records) == len(scored)
        assert sorted(r[f"score_{iteration}"] for r in records) == sorted(r.score for r in rows)
        assert any("part=alpha_f0.jsonl" in p for p in glob.glob(f"{job.folder('selected')}/*"))


def test_lines_come_from_another_source_by_number(spark, tmp_path):
    influence_files(f"{tmp_path}/inf", 1)
    record = '{{"domain": "c4", "attr-fineweb-edu": {}, "attr-cc_en_topic": 1, "epoch": 0}}'
    write(f"{tmp_path}/corpus/a/f.jsonl", [record.format(e) for e in ("9", "1", "null", "1", "9")])
    write(f"{tmp_path}/source/a/f.jsonl", [f"text {i}" for i in range(7)])
    job = Round(f"{tmp_path}/inf", f"{tmp_path}/corpus", f"{tmp_path}/out", f"{tmp_path}/source", top_n=1)
    run_round(spark, job)
    chosen = spark.read.option("recursiveFileLookup", True).text(job.folder("selected")).collect()
    assert sorted(r.value for r in chosen) == ["text 1", "text 3"]


def test_changed_splits_fail_instead_of_misnumbering(spark, tmp_path, small_splits):
    write(f"{tmp_path}/a/x.jsonl", [f"line {i}" for i in range(2000)])
    lines = numbered_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    with pytest.raises(Exception, match="splits changed"):
        lines.collect()


def test_missing_and_bad_influence_files(spark, tmp_path):
    influence_files(f"{tmp_path}/a", 1, drop="c4")
    wanted = {f: list(AgentWeights().family(f)) for f in ("quality", "domain", "topic")}
    assert missing_keys(read_influences(spark, f"{tmp_path}/a"), wanted) == ["c4"]
    for text in ("", "{broken"):
        base = f"{tmp_path}/bad{len(text)}"
        write(f"{base}/domain/c4.jsonl", ['{"influence": [1.0]}', text])
        with pytest.raises(Exception):
            read_influences(spark, base).collect()


def test_cluster_folders(spark, tmp_path):
    write(f"{tmp_path}/clustering-3/a.jsonl", ['{"rank": 2, "content": "x"}', '{"content": "y"}'])
    write(f"{tmp_path}/clustering-12/a.jsonl", ['{"rank": 1, "content": "z"}'])
    write(f"{tmp_path}/unrelated/a.jsonl", ['{"rank": 1, "content": "no"}'])
    rows = read_clusters(spark, str(tmp_path), 0, 9).orderBy("tie").collect()
    assert [(r.cluster, r.rank, r.content) for r in rows] == [(3, 2.0, "x"), (3, None, "y")]
    assert [r.rank_text for r in rows] == ["2", None]
    assert read_clusters(spark, str(tmp_path), 0, 99).count() == 3


STOPS = ["save_weights", "write_scores", "write_threshold", "write_processed", "write_selected", "write_mark"]


@pytest.mark.parametrize("stop", STOPS)
def test_a_round_stopped_anywhere_is_not_there_and_goes_on(spark, tmp_path, monkeypatch, stop):
    influence_files(f"{tmp_path}/inf", 1)
    record = '{{"content": "t{0}", "domain": "c4", "attr-fineweb-edu": 3.0, "attr-cc_en_topic": 1, "epoch": {0}}}'
    write(f"{tmp_path}/corpus/a/f.jsonl", [record.format(i) for i in range(9)])
    write(f"{tmp_path}/source/a/f.jsonl", [f"text {i}" for i in range(9)])
    job = Round(f"{tmp_path}/inf", f"{tmp_path}/corpus", f"{tmp_path}/out", f"{tmp_path}/source", top_n=2)
    following = Round(job.influence, job.corpus, job.output, job.source, iteration=2, top_n=2)
    calls = []

    def count(name):
        whole = getattr(selection_round, name)

        def counted(*args):
            calls.append(name)
            if name == stop and calls.count(stop) == 1 and "resumed" not in calls:
                if name != "write_mark":
                    whole(*args)  # its output is there, but not its mark
                raise KeyboardInterrupt
            return whole(*args)

        monkeypatch.setattr(selection_round, name, counted)

    for name in STOPS:
        count(name)
    with pytest.raises(KeyboardInterrupt):
        run_round(spark, job)
    with pytest.raises(FileNotFoundError, match="not published"):
        published(spark, job)
    with pytest.raises(FileNotFoundError, match="not published"):
        run_round(spark, following)
    calls.append("resumed")
    weights = resume_round(spark, job)
    after = calls[calls.index("resumed") :]
    done = STOPS[1 : STOPS.index(stop)] if stop != "write_mark" else []
    assert not set(done) & set(after)
    folders = published(spark, job)
    assert set(folders) == {"weights", "scored", "threshold", "processed", "selected", "flags"}
    chosen = spark.read.option("recursiveFileLookup", True).text(folders["selected"]).collect()
    assert sorted(r.value for r in chosen) == ["text 0", "text 1"]
    flags = spark.read.parquet(folders["flags"]).where("selection = 1").collect()
    assert sorted(r.line_no for r in flags) == [0, 1]
    assert load_weights(spark, f"{tmp_path}/out/weights", 1) == weights

    calls[:] = ["resumed"]
    assert resume_round(spark, job) == weights and calls == ["resumed"]
    job.top_n = 3
    with pytest.raises(ValueError, match="was run with"):
        resume_round(spark, job)
    run_round(spark, job)
    chosen = spark.read.option("recursiveFileLookup", True).text(job.folder("selected")).collect()
    assert len(chosen) == 3
    run_round(spark, following)


def test_a_mark_is_written_once(spark, tmp_path):
    path = f"{tmp_path}/a/_mark"
    assert read_mark(spark, path) is None
    write_mark(spark, path, {"a": [1, 0.1], "b": "\u00e9"})
    with pytest.raises(FileExistsError):
        write_mark(spark, path, {})
    assert read_mark(spark, path) == {"a": [1, 0.1], "b": "\u00e9"}
    assert [n for n in os.listdir(f"{tmp_path}/a") if not n.startswith(".")] == ["_mark"]
