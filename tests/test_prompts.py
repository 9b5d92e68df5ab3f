import json

import pytest
from pyspark.sql import functions as F

from siftmark.functions import text
from siftmark.operators import prompts
from siftmark.sources import evaluation


def one(spark, task, fields, style=prompts.TULU, **kwargs):
    item = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else None
    row = prompts.build_prompts(item, task, style, **kwargs).first()
    return row.prompt, row.completion


PASSAGE = "Answer the following question based on the information in the given passage.Passage: P\nQuestion: Q\n"
TAIL = "\n<|assistant|>\nThe answer is:"


@pytest.mark.parametrize("task, fields, body, answer", [
    ("boolq", {"passage": "P", "question": "Q", "answer": True}, PASSAGE, " True"),
    ("squad", {"context": "P", "question": "Q", "answers": {"text": ["a", "b"]}}, PASSAGE, " a"),
    ("race", {"article": "P", "question": "Q", "options": ["x", "y"], "answer": "B"}, PASSAGE + "A: x\nB: y\n", " B"),
    ("social_iqa", {"context": "P", "question": "Q", "answerA": "x", "answerB": "y", "answerC": "z", "label": "3"},
     PASSAGE + "A: x\nB: y\nC: z\n", " C"),
    ("sciq", {"question": "Q", "distractor1": "1", "distractor2": "2", "distractor3": "3", "correct_answer": "4",
              "support": "why"}, "Q\nA: 1\nB: 2\nC: 3\nD: 4\n", " why"),
    ("winogrande", {"sentence": "S", "option1": "x", "option2": "y", "answer": "2"}, "S\nOption:\nA: x\nB: y\n", " B"),
    ("hellaswag", {"ctx": "C", "endings": ["w", "x", "y", "z"], "label": "0"},
     "Finish the following sentence based on the information.Sentence:\nC____\nChoices:\nA: w\nB: x\nC: y\nD: z\n", " A"),
    ("lambada", {"until_last": "U", "last_word": "w"},
     "Fill the last word based on the information.Sentence:\nU _____\n", " w"),
    ("jeopardy", {"context": "C", "continuation": "w"},
     "According to the description, give an one word answer.\nDescription:\nC\n", " w"),
    ("mmlu", {"subject": "high_school_maths", "question": "Q", "options": ["w", "x", "y", "z"], "answer": "D"},
     "The following are multiple choice questions (with answers) about  high school maths.\n\n"
     "Q\nA. w\nB. x\nC. y\nD. z\nAnswer:", " D"),
])
def test_task_bodies(spark, task, fields, body, answer):
    assert one(spark, task, fields) == ("<|user|>\n" + body + TAIL, answer)
    assert one(spark, task, fields, prompts.INST)[0] == f"<s> [INST] {body} [/INST] The answer is:"
    assert one(spark, task, fields, prompts.RAW)[0] == body


@pytest.mark.parametrize("task, stem", [
    ("arc_easy", "question"), ("arc_challenge", "question"), ("commonsense_qa", "question"), ("openbookqa", "question_stem")
])
def test_multiple_choice_uses_the_given_labels(spark, task, stem):
    item = spark.sql(
        f"SELECT 'Q' AS {stem}, named_struct('label', array('1', 'b'), 'text', array('x', 'y')) AS choices, 'b' AS answerKey"
    )
    row = prompts.build_prompts(item, task).first()
    assert (row.prompt, row.completion) == ("<|user|>\nQ\n1: x\nb: y\n" + TAIL, "b")


def test_unknown_task(spark):
    with pytest.raises(ValueError, match="unknown"):
        prompts.build_prompts(spark.range(1), "gsm8k")


def test_bbh_leaves_one_out(spark, tmp_path):
    content = "Intro line.\n\nMore. \n\nQ: 1\nA: a1\n\nQ: 2\nA: a2\n\nQ: 3\nA: a3"
    path = tmp_path / "bbh.json"
    path.write_text(json.dumps({"t": content}))
    items = evaluation.read_bbh(spark, str(path))
    tulu = prompts.build_prompts(items, "bbh").orderBy("example_no").collect()
    assert [r.completion for r in tulu] == [" a1", " a2", " a3"]
    assert tulu[1].prompt == (
        "<|user|>\nIntro line.\n\nMore.\n\nQ: 1\nA: a1\n\nQ: 3\nA: a3\n\nQ: 2\n<|assistant|>\nA:"
    )
    inst = prompts.build_prompts(items, "bbh", prompts.INST).orderBy("example_no").first().prompt
    assert inst == "<s> [INST] Intro line.\n\nMore. Q: 1 [/INST] A:"
    raw = prompts.build_prompts(items, "bbh", prompts.RAW).orderBy("example_no").first().prompt
    assert raw == "Intro line.\n\nMore.\n\nQ: 1\nA:"


def test_tydiqa_languages(spark, tmp_path):
    def example(n):
        return [{"context": f"c{n}", "question": f"q{n}", "answers": [{"text": f"a{n}"}, {"text": "no"}]}]

    path = tmp_path / "tydiqa.json"
    path.write_text(json.dumps({"english": example(1), "finnish": example(2) + example(9)}))
    items = evaluation.read_tydiqa(spark, str(path))
    rows = {r.language: r for r in prompts.build_prompts(items, "tydiqa").collect()}
    assert rows["finnish"].prompt == (
        "<|user|>\nVastaa seuraavaan kysymykseen annetun kappaleen tiedon perusteella.Kappale: c2\n"
        "Kysymys: q2\n<|assistant|>\nVastaus:"
    )
    assert rows["english"].completion == " a1"
    chinese = prompts.build_prompts(items, "tydiqa", chinese=True).where("language = 'english'").first()
    assert chinese.prompt == "<|user|>\n根据所给文章中的信息回答以下问题。文章: c1\n问题: q1\n<|assistant|>\n答案:"
    inst = prompts.build_prompts(items, "tydiqa", prompts.INST).where("language = 'english'").first()
    assert inst.prompt == f"<s> [INST] {PASSAGE.replace('P', 'P').replace(': P', ': c1').replace(': Q', ': q1')} [/INST] Answer:"


def test_mmlu_takes_the_first_rows_of_each_file(spark, tmp_path):
    for subject, rows in (("a_b", 14), ("c", 3)):
        lines = [f'"q{i}, ""x""\nline two",w,x,y,z,{"ABCD"[i % 4]}' for i in range(rows)]
        (tmp_path / f"{subject}_test.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "a_b_dev.csv").write_text("d,1,2,3,4,A\n" * 6)
    rows = evaluation.read_mmlu(spark, str(tmp_path)).orderBy("subject", "row_no").collect()
    assert [(r.subject, r.row_no) for r in rows] == [("a_b", i) for i in range(10)] + [("c", i) for i in range(3)]
    assert rows[1].question == 'q1, "x"\nline two' and rows[1].options == ["w", "x", "y", "z"] and rows[1].answer == "B"
    assert evaluation.read_mmlu(spark, str(tmp_path), "dev", 5).count() == 5


def test_tokenized_prompts_mask_the_prompt(spark):
    frame = spark.createDataFrame([("a b", " c d"), ("a b c d e", " f"), ("", " x")], "prompt string, completion string")
    got = prompts.tokenize_prompts(frame, text.words, 4, F.lit("-")).collect()
    assert [r.input_ids for r in got] == [["a", "b", "c", "d"], ["a", "b", "c", "d"], ["x"]]
    assert [r.labels for r in got] == [["-", "-", "c", "d"], ["-"] * 4, ["x"]]
    assert [r.attention_mask for r in got] == [[1] * 4, [1] * 4, [1]]


def test_pairs_keep_their_end_mark_up_to_the_default_length(spark):
    rows = [(n, "q " * 99 + "q", " ".join(["a"] * n)) for n in (300, 923, 924)]
    pairs = spark.createDataFrame(rows, "n int, question string, answer string")
    found = {r.n: r for r in prompts.encode_pairs(pairs, text.words, " </s>", ignore=F.lit("-100")).collect()}
    assert {n: (len(r.input_ids), r.input_ids[-1]) for n, r in found.items()} == {300: (401, "</s>"), 923: (1024, "</s>"), 924: (1024, "a")}
    assert all(r.labels[:100] == ["-100"] * 100 and r.labels[100:] == r.input_ids[100:] for r in found.values())
