"""Byte-level BPE: texts to ids and back, with a transducer for frequent words.

A text's words, as the tokenizer cuts them, never share an id. The frequent ones
are compiled once with their ids; all others are merged, pair by pair, in the
order of the tokenizer's merges. Both give the same ids, so what is in the
lexicon changes the speed alone.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmark.llm.transducer import Transducer, as_file, compile_words
from siftmark.llm.word_ids import SIGNS
from siftmark.operators.threshold import top_n_threshold
from siftmark.session import materialize, shared_folder

#: How tokenizers of this kind cut texts into words (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of which all versions of Unicode in use say the same; texts with others are
#: cut by the tokenizers library, whose version may be another than that of ``regex``.
AGREED = r"[\x00-\u052F\u2000-\u2064\u20A0-\u20BF\u2190-\u23CF\u2500-\u27BF\u3000-\u3096\u30A0-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3\uFE30-\uFE4F\uFF01-\uFF9D\U0001F300-\U0001F64F]*"
#: Documents are encoded together up to about so many characters.
SLAB = 2_000_000
#: The lexicon holds so many words at most, and none over so many bytes.
LEXICON, LONGEST = 131_072, 64
#: So many different words are counted in a task before they are sent on.
COUNTED = 200_000
#: Words of more bytes are merged with a heap.
SHORT = 48
#: Stands for the rank of a pair that is not merged.
NEVER = 1 << 40


class Merges:
    """The vocabulary and merges of a byte-level BPE tokenizer file, and merging by them."""

    def __init__(self, tokenizer_json: str):
        content = json.loads(tokenizer_json)
        model, cut = content["model"], content.get("pre_tokenizer") or {}
        plain = (
            content.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
            and not any(a[k] for a in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are understood")
        vocabulary = model["vocab"]
        sign = [chr(SIGNS.get(b, b)) for b in range(256)]
        self.bytes = [vocabulary[s] for s in sign]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        self.width = max(vocabulary.values()) + 1
        keys = np.array([a * self.width + b for a, b in self.pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.pairs.values()] or [NEVER], np.int64)[order]
        self.results = np.zeros(len(model["merges"]), np.int64)
        for rank, new in self.pairs.values():
            self.results[rank] = new
        self.marks = {a["content"]: a["id"] for a in content["added_tokens"]}
        of_sign = {s: bytes([b]) for b, s in enumerate(sign)}
        self.token_bytes = {i: b"".join(map(of_sign.__getitem__, t)) for t, i in vocabulary.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.marks.items()}

    def merged(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers: of all adjacent pairs the one
        merged first, and of equal ones the leftmost, becomes one id, until none can be merged.

        Each round makes the next merge of all words that have one.
        """
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        for k, word in enumerate(words):
            if len(word) > SHORT:
                out[k] = np.array(self._merged_long([self.bytes[b] for b in word]), "<u4").tobytes()
        lengths = np.array([len(words[k]) for k in short], np.int64)
        content = np.frombuffer(b"".join([words[k] for k in short]), np.uint8)
        ids, word = np.array(self.bytes, np.int64)[content], np.repeat(np.arange(len(short)), lengths)
        ranks = self._ranks(ids[:-1], ids[1:], word[:-1] == word[1:])
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(first, append=len(ids))
            best = np.minimum.reduceat(ranks, first)
            done = best == NEVER
            if done.any():
                values = ids.astype("<u4").tobytes()
                for k, at, n in zip(word[first[done]].tolist(), first[done].tolist(), sizes[done].tolist()):
                    out[short[k]] = values[4 * at : 4 * (at + n)]
                keep = np.repeat(~done, sizes)
                ids, word, ranks = ids[keep], word[keep], ranks[keep]
                best, sizes = best[~done], sizes[~done]
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            ids[at] = self.results[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            at -= np.arange(len(at))
            for one in (at, at[at > 0] - 1):
                then = np.minimum(one + 1, len(ids) - 1)
                ranks[one] = self._ranks(ids[one], ids[then], (word[one] == word[then]) & (then > one))[:-1]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """When each pair is merged, or ``NEVER``; one more place stands for what has no right neighbour."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.append(np.where(joined & (self.keys[at] == wanted), self.key_ranks[at], NEVER), NEVER)

    def _merged_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            if found := pairs.get((ids[at], ids[at + 1])):
                heap.append((found[0], at, ids[at], ids[at + 1], found[1]))
        heapify(heap)
        while heap:
            _, at, left, right, new = heappop(heap)
            then = after[at]
            if ids[at] != left or then >= n or ids[then] != right:
                continue  # one of them has been merged since
            ids[at], ids[then] = new, -1
            after[at] = after[then]
            if after[at] < n:
                before[after[at]] = at
            for one in (before[at], at):
                if one >= 0 and after[one] < n and (found := pairs.get((ids[one], ids[after[one]]))):
                    heappush(heap, (found[0], one, ids[one], ids[after[one]], found[1]))
        return [i for i in ids if i >= 0]


class Cutter:
    """Cuts texts into words as the tokenizer does; its marks are words of their own."""

    def __init__(self, tokenizer_json: str, marks: set[str]):
        self.json, self.library = tokenizer_json, None
        self.find = regex.compile(PATTERN).findall
        self.agreed = regex.compile(AGREED).fullmatch
        names = sorted(marks, key=len, reverse=True)
        self.marks = marks
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or self.agreed(text):
            return self.find(text)
        if self.library is None:
            self.library = Tokenizer.from_str(self.json).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if not self.split or not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.split(text)
        return list(chain.from_iterable([p] if p in self.marks else self._plain(p) for p in parts if p))


def frequent_words(docs: DataFrame, tokenizer_json: str, most: int = LEXICON, text: str = "text") -> list[str]:
    """The words of all texts, as the tokenizer cuts them, that are more frequent than the
    ``most``-th one: fewer than ``most``, which is what comes to the driver.

    Stretches between white space are counted first, each then cut once as behind a space.
    Words over ``LONGEST`` bytes are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update((value.as_py() or "").split())
                if len(counts) > COUNTED:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    def sent(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(tokenizer_json, set())
        for batch in batches:
            counts: Counter[str] = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in cutter.words(" " + word):
                    if len(part.encode()) <= LONGEST:
                        counts[part] += n
            yield sent(counts)

    whole = docs.select(F.col(text).cast("string")).mapInArrow(counted, "word string, n long")
    whole = whole.groupBy("word").agg(F.sum("n").alias("n"))
    parts = whole.mapInArrow(cut, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    parts = materialize(parts, "words")
    limit = top_n_threshold(parts, "n", most)  # found by counting; no task sends its own best words
    rows = parts.where(F.col("n") > limit) if limit is not None else parts.limit(0)
    return sorted(r.word for r in rows.select("word").collect())


def share_file(spark: SparkSession, content: bytes) -> str:
    """Writes ``content`` to the shared folder and has Spark send it to every executor,
    also to those that come later; the name to ask ``SparkFiles`` for."""
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def lexicon(docs: DataFrame, tokenizer_json: str, most: int = LEXICON, text: str = "text") -> str:
    """The transducer of the texts' frequent words, compiled and shared; its name."""
    merges = Merges(tokenizer_json)
    words = [w.encode() for w in frequent_words(docs, tokenizer_json, most, text)]
    ids = [np.frombuffer(x, "<u4").tolist() for x in merges.merged(words)]
    return share_file(docs.sparkSession, as_file(compile_words(dict(zip(words, ids)))))


class Coder:
    """Encodes with the lexicon file of this executor, if ``name`` is given, and decodes.
    Without ``with_marks`` the tokenizer's marks are plain text."""

    def __init__(self, tokenizer_json: str, name: str | None = None, with_marks: bool = True):
        self.merges = Merges(tokenizer_json)
        self.transducer = Transducer.mapped(SparkFiles.get(name)) if name else None
        self.marks = {m: np.array([i], "<u4").tobytes() for m, i in self.merges.marks.items() if with_marks}
        self.cutter = Cutter(tokenizer_json, set(self.marks))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers; each different word is looked up once."""
        cut = [self.cutter.words(t) for t in texts]
        words = list(dict.fromkeys(chain.from_iterable(cut)))
        plain = [w.encode() for w in words]
        found = self.transducer.outputs(plain) if self.transducer else [None] * len(words)
        rest = [k for k, f in enumerate(found) if f is None]
        for k, merged in zip(rest, self.merges.merged([plain[k] for k in rest])):
            found[k] = merged
        ids = dict(zip(words, found))
        ids |= self.marks
        return [b"".join(map(ids.__getitem__, own)) for own in cut]

    def decoded(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.token_bytes.__getitem__, ids)).decode(errors="replace")


def _kept(holder: dict) -> Coder:
    """A worker process holds on to a broadcast's value, and so to the coder made for it."""
    if "coder" not in holder:
        holder["coder"] = Coder(holder["json"], holder["name"])
    return holder["coder"]


def encode(docs: DataFrame, tokenizer_json: str, name: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, as the tokenizers library gives them
    without special tokens; the tokenizer's own marks inside texts are their ids.

    ``name`` is a shared lexicon. Null and empty texts have no ids. Rows that repeat
    an id get a row each, a null id is kept, other columns are ignored, and an empty
    table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json, "name": name})  # a vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, size = [], [], 0
            for row, value in enumerate(batch.column(1)):
                rows.append(row)
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size > SLAB:
                    yield made(batch, rows, texts)
                    rows, texts, size = [], [], 0
            if rows:
                yield made(batch, rows, texts)

    def made(batch: pa.RecordBatch, rows: list[int], texts: list[str]) -> pa.RecordBatch:
        parts = _kept(shared.value).encoded(texts)
        values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0], len(rows)), lists], names=[id_col, "ids"])

    named = docs.select(F.col(id_col), F.col(text).cast("string"))
    return named.mapInArrow(run, f"`{id_col}` {named.schema[0].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, tokenizer_json: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, text): the text of every row's ids, marks included. Null ids give a null
    text; bytes that are no UTF-8 become U+FFFD; ids that the tokenizer lacks stop the job."""
    shared = rows.sparkSession.sparkContext.broadcast({"json": tokenizer_json, "name": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists, decoded = part.column(1), _kept(shared.value).decoded
                ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                texts = [
                    decoded(ids[end - n : end].tolist()) if n is not None else None
                    for n, end in zip(lists.value_lengths().to_pylist(), ends.tolist())
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    named = rows.select(F.col(id_col), "ids")
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")
