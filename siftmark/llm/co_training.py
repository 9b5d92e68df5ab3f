"""Quality by co-training: one classifier reads the text, one the page's metadata.

Both learn from the same labelled documents. In each round each of them labels
the unlabelled documents it is surest of, and hands these to the other. All
unlabelled documents are scored in each round, where the features are stored; the
share handed over is cut by counting, and learners see a bounded draw of it. Their
scores are then calibrated on labelled documents that neither has learned from,
and added up with the weights that fit these best.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import text_bytes
from siftmark.llm.ftrl import Ftrl, bounded_sample, sigmoid, sparse
from siftmark.session import materialize

TEXT_BITS, PAGE_BITS = 18, 14
#: Labelled documents that the views learn from, and unlabelled ones that are handed
#: over to learn from in all rounds together, at most. The latter are drawn from the
#: handed share of the whole table.
LABELLED, UNLABELLED = 8_000, 12_000
#: Rounds, and the share of the unlabelled documents that a view hands over in each.
ROUNDS, SHARE = 4, 0.05
#: A view is sure of a document beyond these probabilities.
SURE_BAD, SURE_GOOD = 0.05, 0.95
#: A document is kept unless its score is under this, or less where more than
#: ``LOST`` of the good calibration documents would be.
KEEP, LOST = 0.5, 0.005
#: Unlabelled documents are counted by how sure a view is, in cells of this width of the logit.
CELL, CELLS = 1 / 256, 40 * 256
#: Shares of rows by hash are multiples of 1 / 2**20.
PARTS = 1 << 20
SYMBOLS = b"#*$%&|<>{}[]=~^\\"


def _step(value: float, width: float) -> int:
    return int(value / width)


def text_features(content: bytes) -> np.ndarray:
    """Distinct hashed features of the words: endings and shapes, and how the text is made up."""
    words = content.split()
    n = max(1, len(words))
    stripped = len(content) - len(content.translate(None, SYMBOLS))
    digits = len(content) - len(content.translate(None, b"0123456789"))
    chars = max(1, len(content))
    names = {b"e" + w[-4:] for w in set(words)}
    names |= {
        b"#n%d" % len(words).bit_length(),
        b"#s%d" % _step(stripped / chars, 0.01),
        b"#d%d" % _step(digits / chars, 0.02),
        b"#l%d" % _step(chars / n, 0.5),
        b"#u%d" % _step(len(set(words)) / n, 0.1),
        b"#c%d" % _step(sum(map(bytes.isupper, words)) / n, 0.1),
    }
    return _hashed(names, TEXT_BITS)


def page_features(lang: str, source: str, lines: int, longest: int, chars: int) -> np.ndarray:
    """Distinct hashed features of a page without its words."""
    names = {f"lang {lang}", f"source {source}", f"both {lang} {source}"}
    names |= {f"lines {lines.bit_length()}", f"longest {longest.bit_length()}"}
    names |= {f"chars {chars.bit_length()}", f"line {(chars // max(1, lines)).bit_length()}"}
    return _hashed({x.encode() for x in names}, PAGE_BITS)


def _hashed(names: set[bytes], bits: int) -> np.ndarray:
    """The constant, 0, and the others from 1 on."""
    places = [0, *(crc32(x) % ((1 << bits) - 1) + 1 for x in names)]
    return np.unique(np.array(places, np.int32))


def _columns(id_col: str) -> list[Column]:
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    longest = F.array_max(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.length))
    return [
        F.col(id_col),
        F.col("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        lines.alias("_lines"),
        longest.alias("_longest"),
        F.length(F.coalesce("text", F.lit(""))).alias("_chars"),
    ]


def _views(batch: pa.RecordBatch, first: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    texts = [text_features(x) for x in text_bytes(batch.column(first))]
    pages = [page_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(first + 1, first + 6)))]
    return texts, pages


def _logits(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights at each row's features, which are int32 as bytes and never none."""
    if not len(column):
        return np.zeros(0)
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    at = np.frombuffer(column.buffers()[2], np.int32, count=int(ends[-1]))[ends[0] :]
    return np.add.reduceat(weights[at], ends[:-1] - ends[0])


def _dense(views: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    made = [np.zeros(1 << b) for b in (TEXT_BITS, PAGE_BITS)]
    for weights, (at, values) in zip(made, views):
        weights[at] = values
    return made


def _cells(logits: np.ndarray) -> np.ndarray:
    """How sure a view is, -1 where it is not."""
    p = sigmoid(logits)
    cells = np.minimum(np.abs(logits) / CELL, CELLS - 1).astype(np.int64)
    return np.where((p <= SURE_BAD) | (p >= SURE_GOOD), cells, -1)


def _part(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> shift) & (PARTS - 1)


def _cut(counts: dict[int, int], most: int) -> tuple[int, int, int]:
    """(cell, parts, rows): the cells above ``cell`` and so many parts of it by hash hold ``most`` rows."""
    above = 0
    for cell in sorted(counts, reverse=True):
        if above + counts[cell] > most:
            return cell, (most - above) * PARTS // counts[cell], most
        above += counts[cell]
    return -1, 0, above


def _handed(cells: np.ndarray, keys: np.ndarray, cut: tuple) -> np.ndarray:
    return (cells >= 0) & ((cells > cut[0]) | ((cells == cut[0]) & (_part(keys, 1) < cut[1])))


def _fit_view(bits: int, rows: list[np.ndarray], labels: list[int], epochs: int = 3) -> np.ndarray:
    model = Ftrl(1 << bits, alpha=0.5, l1=2.0)
    for _ in range(epochs):
        for at, y in zip(rows, labels):
            model.learn(at, float(y))
    return model.weights()


def _line(x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Logistic regression on few columns and a constant, by Newton's method; slopes are not negative."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * w)
        w = w - move
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(move).max() < 1e-8:
            break
    return w


def stored_features(docs: DataFrame, some: DataFrame, id_col: str) -> DataFrame:
    """(id, _label, texts, pages, _key) of every document, stored: features are int32 as bytes."""
    # `some` is a bounded sample of narrow rows
    rows = docs.select(*_columns(id_col)).join(F.broadcast(some), id_col, "left")
    rows = rows.select(id_col, "text", "_lang", "_source", "_lines", "_longest", "_chars", "_label")
    key = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array([x.tobytes() for x in v], pa.binary()) for v in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(7), *made], names=[id_col, "_label", "texts", "pages"])

    found = rows.mapInArrow(run, f"`{id_col}` {key}, _label int, texts binary, pages binary")
    whole = F.xxhash64(F.col(id_col).cast("string"), "texts", "pages")
    return materialize(found.withColumn("_key", whole), "co-training-features")


def _learn(examples: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both views' weights from (view, _key, _label, features), a bounded number of rows."""

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = sorted(zip(frame["_key"], frame["_label"], frame["features"]), key=lambda r: (crc32(b"%d" % r[0]), r))
        rows = [np.frombuffer(r[2], np.int32) for r in order]
        at, weights = sparse(_fit_view((TEXT_BITS, PAGE_BITS)[key[0]], rows, [r[1] for r in order]))
        return pd.DataFrame({"view": [key[0]], "at": [at.tolist()], "weights": [weights.tolist()]})

    found = examples.groupBy("view").applyInPandas(learn, "view int, at array<int>, weights array<double>").collect()
    return [(np.array(r.at, np.int32), np.array(r.weights)) for r in sorted(found, key=lambda r: r.view)]


def _pool_cells(batch: pa.RecordBatch, rounds: list[tuple]) -> tuple:
    """Which rows of (_key, texts, pages) are still in the pool, how sure the last
    round's views are of them, and the logits."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    inside = np.ones(len(keys), bool)
    for views, cuts in rounds:
        logits = [_logits(batch.column(1 + k), w) for k, w in enumerate(views)]
        cells = [_cells(x) for x in logits]
        if views is not rounds[-1][0]:
            for c, cut in zip(cells, cuts):
                inside &= ~_handed(c, keys, cut)
    return keys, inside, cells, logits


def _count(pool: DataFrame, rounds: list[tuple]) -> tuple[int, list[dict[int, int]]]:
    """Rows left in the pool, and for each view how many there are by cell."""
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = [(_dense(views), cuts) for views, cuts in shared.value]
        left, sums = 0, np.zeros((2, CELLS), np.int64)
        for batch in batches:
            _, inside, cells, _ = _pool_cells(batch, past)
            left += int(inside.sum())
            for k in range(2):
                sums[k] += np.bincount(cells[k][inside & (cells[k] >= 0)], minlength=CELLS)
        view, cell = np.nonzero(sums)
        columns = [np.append(view, 2), np.append(cell, 0), np.append(sums[view, cell], left)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["view", "cell", "n"])

    made = pool.mapInArrow(run, "view long, cell long, n long").groupBy("view", "cell").agg(F.sum("n").alias("n"))
    found = made.collect()  # at most 2 * CELLS + 1 rows
    return sum(r.n for r in found if r.view == 2), [{r.cell: r.n for r in found if r.view == k} for k in range(2)]


def _hand_over(pool: DataFrame, rounds: list[tuple], most: int, turn: int) -> DataFrame:
    """(view, _key, _label, features): what the views learn from each other in this round,
    at most ``most`` rows a view, drawn by hash from all that are handed over."""
    shared = pool.sparkSession.sparkContext.broadcast(rounds)
    # a fifth more than needed, and then some
    rates = [int(PARTS * min(1.0, (1.2 * most + 100) / max(1, cut[2]))) for cut in rounds[-1][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = [(_dense(views), cuts) for views, cuts in shared.value]
        for batch in batches:
            keys, inside, cells, logits = _pool_cells(batch, past)
            for giver in range(2):
                taken = inside & _handed(cells[giver], keys, past[-1][1][giver]) & (_part(keys, 24) < rates[giver])
                at = np.flatnonzero(taken)
                made = [
                    pa.array(np.full(len(at), 1 - giver), pa.int32()),
                    pa.array(keys[at], pa.int64()),
                    pa.array((logits[giver][at] >= 0).astype(np.int32)),
                    batch.column(2 - giver).take(pa.array(at)).cast(pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["view", "_key", "_label", "features"])

    found = pool.mapInArrow(run, "view int, _key long, _label int, features binary").dropDuplicates(["view", "_key"])
    found = materialize(found, "co-training-handed")
    first, second = (bounded_sample(found.where(F.col("view") == k), "_key", most, turn) for k in range(2))
    return first.unionByName(second)


def _calibrated(views: list, check: list) -> dict:
    """The model from its views and (id, label, text logit, page logit) of rows kept for calibration."""
    y = np.array([r[1] for r in check], float)
    logits = np.array([r[2:] for r in check], float).reshape(-1, 2)
    own = [_line(logits[:, k : k + 1], y) for k in range(2)]
    calibrated = np.column_stack([logits[:, k] * own[k][0] + own[k][1] for k in range(2)])
    both = _line(calibrated, y)
    score = sigmoid(calibrated @ both[:2] + both[2])
    good = np.sort(score[y == 1])
    cutoff = min(KEEP, float(good[int(len(good) * LOST)])) if len(good) else 0.0
    return {"views": views, "own": [o.tolist() for o in own], "both": both.tolist(), "cutoff": cutoff}


def label_sample(labels: DataFrame, id_col: str, labelled: int) -> DataFrame:
    """(id, _label): a bounded sample of the labelled ids, stored."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min("quality").alias("_label"))
    some = bounded_sample(known, id_col, labelled, 7)
    return materialize(some.select(id_col, F.col("_label").cast("int")), "co-training-labels")


def fit(stored: DataFrame, id_col: str = "doc_id", unlabelled: int = UNLABELLED) -> dict | None:
    """The model from :func:`stored_features`; None without a labelled row to learn from.

    All rows without a label in the sample are the pool, those of null ids too.
    ``handed`` of the model has the rows handed over, by round and view, and
    ``pool`` the rows there were.
    """
    least = F.min(F.struct("_key", "texts", "pages", (F.col("_label") >= 1).cast("int").alias("_label"))).alias("_row")
    known = stored.where("_label IS NOT NULL").groupBy(F.col(id_col).cast("string").alias("_id")).agg(least)
    spare = F.floor(F.crc32(F.col("_id").cast("binary")) / 5) % 4 == 0
    known = materialize(known.select("_id", "_row.*", spare.alias("_spare")), "co-training-known")
    own = known.where("NOT _spare")
    if own.isEmpty():
        return None
    examples = own.select(F.lit(0).alias("view"), "_key", "_label", F.col("texts").alias("features")).unionByName(
        own.select(F.lit(1).alias("view"), "_key", "_label", F.col("pages").alias("features"))
    )
    pool = stored.where("_label IS NULL").select("_key", "texts", "pages")
    rounds, handed, size = [], [], 0
    for turn in range(ROUNDS + 1):
        views = _learn(examples)
        if turn == ROUNDS:
            break
        left, counts = _count(pool, [*rounds, (views, None)])
        size = size or left
        rounds.append((views, [_cut(c, int(size * SHARE)) for c in counts]))
        handed.append([cut[2] for cut in rounds[-1][1]])
        if any(handed[-1]):
            examples = examples.unionByName(_hand_over(pool, rounds, unlabelled // (2 * ROUNDS), turn))
    shared = stored.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(shared.value)
        for batch in batches:
            made = [pa.array(_logits(batch.column(2 + k), w)) for k, w in enumerate(dense)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "label", "a", "b"])

    check = known.where("_spare").select("_id", "_label", "texts", "pages")
    check = check.mapInArrow(run, "id string, label int, a double, b double").collect()  # of the sample
    return _calibrated(views, sorted(map(tuple, check))) | {"handed": handed, "pool": size}


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """(id, text_score, page_score, score, kept) of every document, from whole texts.

    ``docs`` has (id, text, lang, source). Of several labels of an id the lowest
    counts; null labels and ids do not. Null texts are empty, null metadata is a
    value of its own. Without any label all scores are null and every document
    is kept. Rows that repeat an id get a row each. Other columns are ignored;
    an empty table gives none.
    """
    some = label_sample(labels, id_col, labelled)
    model = None
    if not some.isEmpty():
        stored = stored_features(docs, some, id_col)
        model = fit(stored, id_col, unlabelled)
    key = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {key}, text_score double, page_score double, score double, kept boolean"
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(id_col, nothing.alias("text_score"), nothing.alias("page_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** TEXT_BITS + 2 ** PAGE_BITS weights
    names = [id_col, "text_score", "page_score", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense, both = _dense(model["views"]), np.array(model["both"])
        for batch in batches:
            logits = [_logits(batch.column(1 + k), w) for k, w in enumerate(dense)]
            own = [x * slope + constant for x, (slope, constant) in zip(logits, model["own"])]
            score = sigmoid(own[0] * both[0] + own[1] * both[1] + both[2])
            made = [pa.array(sigmoid(own[0])), pa.array(sigmoid(own[1])), pa.array(score), pa.array(score >= model["cutoff"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return stored.select(id_col, "texts", "pages").mapInArrow(run, schema)
