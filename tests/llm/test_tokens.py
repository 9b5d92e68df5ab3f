"""Encoding, aligning and spelling next to plain loops and the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import odd_rows
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from siftmark.llm import alignment, byte_bpe, merge_path, queries, spelling, transducer

JSON = queries.tokenizer_json("byte_bpe_50k.json")
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "!", "é", "ß", "Ж", "你", "😀", "\x1c", "\xa0",
         " ", "<|endoftext|>", "▁", "\U00032000", "՘", "ֿ"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def numbers(content):
    return np.frombuffer(content, "<u4").tolist()


def test_texts_are_encoded_and_decoded_as_by_the_library():
    library, coder = Tokenizer.from_str(JSON), byte_bpe.Coder(JSON)
    texts = random_texts(1, 3000) + ["ab" * 400 + "1" * 70, "a" * 5000, "".join(map(chr, range(0xD800)))]
    for text, found in zip(texts, coder.encoded(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert numbers(found) == want
        assert coder.decoded(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_cut_as_by_the_library():
    cutter, library = byte_bpe.Cutter(JSON, set()), Tokenizer.from_str(JSON).pre_tokenizer
    for start in range(0, 0x110000, 512):
        text = "".join(f"a{c}1{c} !{c} {c}{c}" for c in map(chr, range(start, start + 512)) if not 0xD800 <= ord(c) < 0xE000)
        assert cutter.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Merges(queries.tokenizer_json("word_bpe_49k.json"))


def test_transducer_knows_its_words_alone_and_is_minimal():
    rng = random.Random(3)
    words = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(0, 6))) for _ in range(900)}
    entries = {w: [rng.randrange(2**32) for _ in range(rng.randint(1, 3))] for w in words}
    found = transducer.Transducer(transducer.compile_words(entries))
    others = [bytes(rng.choice(b"abc\xffd") for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    asked = [*words, *others]
    for word, out in zip(asked, found.outputs(asked)):
        assert (out if out is None else numbers(out)) == entries.get(word)
    # one state for each different set of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(found.arrays["final"]) == len(endings)


def test_transducer_without_words_or_with_the_empty_one(tmp_path):
    for entries in ({}, {b"": [7]}):
        path = tmp_path / str(len(entries))
        path.write_bytes(transducer.as_file(transducer.compile_words(entries)))
        got = transducer.Transducer.mapped(str(path)).outputs([b"", b"x"])
        assert [x and numbers(x) for x in got] == [entries.get(b""), None]
        assert transducer.Transducer.mapped(str(path)).outputs([]) == []


@pytest.mark.parametrize("lexicon", [0, 50, 100_000])
def test_a_lexicon_changes_no_ids(spark, lexicon):
    docs = odd_rows.frame(spark)
    name = byte_bpe.lexicon(docs, JSON, lexicon)
    library = Tokenizer.from_str(JSON)
    encoded = byte_bpe.decode(byte_bpe.encode(docs, JSON, name), JSON).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in odd_rows.rows()]
    assert sorted(map(tuple, encoded), key=repr) == sorted(want, key=repr)


def test_lexicon_has_the_words_above_the_limit(spark):
    docs = spark.createDataFrame([("to be or not to be",), ("to be, to",), (None,)], "text string")
    assert byte_bpe.frequent_words(docs, JSON, 2) == [" to"]
    assert byte_bpe.frequent_words(docs, JSON, 3) == [" be", " to"]


def test_encoding_empty_tables_and_null_ids(spark):
    empty = odd_rows.empty(spark)
    assert byte_bpe.decode(byte_bpe.encode(empty, JSON, byte_bpe.lexicon(empty, JSON)), JSON).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [50256, 0])], "doc_id long, ids array<int>")
    assert [r.text for r in byte_bpe.decode(rows, JSON).orderBy("doc_id").collect()] == [None, "", "<|endoftext|>!"]


def test_merge_path_of_any_piece_size():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 40)
        a, b = (sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) + [n] for _ in range(2))
        want, shared, i, j = [], [], 0, 0
        while i < len(a):
            want.append((i, j))
            if a[i] == b[j]:
                shared.append(len(want) - 1)
            i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
        for work in (1, 2, 3, 7, 100):
            found = merge_path.overlaps(np.array(a), np.array(b), work)
            assert list(zip(found.a.tolist(), found.b.tolist())) == want
            assert found.shared.tolist() == shared
    nothing = np.empty(0, np.int64)
    assert [len(x) for x in merge_path.overlaps(nothing, nothing, 5)] == [0, 0, 0]


def test_pieces_take_equal_work():
    a, b = np.arange(1, 10_001) * 3, np.arange(1, 30_001)
    borders = np.arange(0, 40_001, 1000)
    assert (np.diff(merge_path.crossings(a, b, borders)) <= 1000).all()
    piece = merge_path.merge_piece(a, b, *merge_path.crossings(a, b, np.array([4000, 5000])), 3000, 3750)
    assert len(piece.a) <= 1000


@pytest.fixture(scope="module")
def libraries():
    library = Tokenizer.from_str(JSON)
    library.encode_special_tokens = True
    return library, SentencePieceProcessor(model_proto=MODEL), byte_bpe.Merges(JSON).token_bytes


def plainly_aligned(text, libraries):
    """Ids, links and groups (lists of ids) of one text."""
    library, pieces, token_bytes = libraries
    if not text:
        return [], [], [], []
    a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    sizes_a = [len(token_bytes[i]) for i in a]
    names = [pieces.id_to_piece(i) for i in b]
    of_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
    if b"".join(of_b) != (" " + text).encode():
        return [], [], [], []
    end_a, end_b = np.cumsum(sizes_a).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    links, groups, i, j, first = [], [], 0, 0, (0, 0)
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = end_a[i], end_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append((a[first[0] : i], b[first[1] : j]))
            first = (i, j)
    return a, b, links, groups


def test_alignment_of_texts_and_its_counts(spark, monkeypatch, libraries):
    monkeypatch.setattr(alignment, "WORK", 5)
    texts = random_texts(5, 60) + ["the one and the other", "the one", None, "", "▁x", "<|endoftext|> in a text", "a\x00b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = {k: plainly_aligned(t, libraries) for k, t in enumerate(texts)}
    for row in alignment.aligned(docs, JSON, MODEL).collect():
        a, b, _, groups = plain[row.doc_id]
        assert (row.a_ids, row.b_ids) == (a, b)
        assert [tuple(g) for g in row.groups] == [(len(x), len(y)) for x, y in groups]
    counts = Counter(pair for _, _, links, _ in plain.values() for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = []
    for k, (a, b, links, groups) in plain.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(counts[x] == most[x[0]] for x in links)
        want.append((k, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    assert any(w[1] == 0 for w in want) and any(w[5] < w[4] for w in want)
    for slab in (20, 10**9):
        monkeypatch.setattr(alignment, "SLAB", slab)
        monkeypatch.setattr(alignment, "TOKENIZED", slab)
        assert sorted(map(tuple, alignment.link_statistics(docs, JSON, MODEL).collect())) == want


def test_alignment_of_odd_rows(spark):
    found = alignment.link_statistics(odd_rows.frame(spark), JSON, MODEL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in odd_rows.rows())
    assert all((r.n_a == 0) == (r.groups_sha256 == "") for r in found)
    same = [r for r in found if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1] and same[0].n_links > 0
    empty = odd_rows.empty(spark)
    assert alignment.link_statistics(empty, JSON, MODEL).collect() == []
    assert alignment.aligned(empty, JSON, MODEL).collect() == []


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if distance_one(w, x)]
        form = min(near, key=lambda x: (-counts[x], x), default=None)
        form = form if form and counts[form] >= 10 * n else None
        out[w] = (n, len(near), form, counts.get(form))
    for w in list(out):
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def test_groups_of_random_words(spark):
    rng = random.Random(6)
    letters = "abeÀß÷"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(500)}
    for w in list(words)[:200]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :] if len(w) > 3 else w, w[:k] + "e" + w[k:], w[:k] + "a" + w[k + 1 :]}
    counts = {w: rng.choice([1, 2, 10, 20, 100, 150, 1000, 20_000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variant_groups(table).collect()
    want = plain_groups(counts)
    assert len(found) == len(want)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == want
    assert any(want[w[2]][2] for w in want.values() if w[2])  # chains


def test_words_of_odd_rows(spark):
    import re

    counts = Counter()
    for i, text, *_ in odd_rows.rows():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    found = spelling.occurring_words(odd_rows.frame(spark)).collect()
    assert {r.word: r.n for r in found} == {w: n for w, n in counts.items() if n}
    assert spelling.spelling_groups(odd_rows.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([("abcdefg", 1)], "word string, n long"), times=2)


def test_letters_are_dealt_evenly(spark):
    words = spark.createDataFrame([("aaaabbcc",), ("aabbccd",)], "word string")
    parts = spelling.letter_parts(words, 3)
    assert sorted("".join(parts)) == list("abcd") and parts[0] == "a"
    found = spelling.signatures(words.withColumn("n", F.lit(1)), F.length("word"), parts)
    assert found.count() == 2 * 9
