"""Near duplicates by SimHash, found through one-wildcard variants of half fingerprints.

Fingerprints of 64 bits that differ in at most two bits have a half, of 32 bits,
in which they differ in at most one. So each half is indexed 32 times, each time
with another bit left out; equal variants meet in an equality join and are
verified. A variant that more than ``LARGE`` fingerprints share is not paired:
its fingerprints are indexed with every two of the 64 bits left out instead.
Whoever shares such a variant differs in two bits at most, so a star to the
smallest member holds the same component without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import dealt, growing, join_spread, text_bytes
from siftmark.llm.components import components
from siftmark.session import materialize

#: Up to so many fingerprints of one variant are paired; beyond, two-bit variants cost less.
LARGE = 128
BLOCK = 65_536


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit is 1 where it is set in over half of the shingles' XXH64."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for a in range(0, last, BLOCK):
        b = min(a + BLOCK, last)
        hashes = np.array(
            [xxhash.xxh64_intdigest(joined[x:y], 42) for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist())],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint): whole texts, ASCII letters lowered; a text with fewer
    words than ``shingle`` is one shingle, one without words (or null) gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.lower().split(), shingle) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=names)

    named = docs.select(F.col(id_col), F.col(text))
    names = [id_col, "fingerprint"]
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, fingerprint long")


def one_wildcard(prints: DataFrame) -> DataFrame:
    """(variant, fingerprint): 64 rows for each fingerprint."""
    bit = F.expr("shiftleft(1L, _at % 32)")
    half = F.when(F.col("_at") < 32, F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fingerprint", 32)
    )
    number = F.expr("shiftleft(CAST(_at AS BIGINT), 32)")
    return prints.select("fingerprint", F.explode(F.expr("sequence(0, 63)")).alias("_at")).select(
        half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(number).alias("variant"), "fingerprint"
    )


def two_wildcards(prints: DataFrame) -> DataFrame:
    """(first, second, rest, fingerprint): 2,016 rows for each fingerprint."""
    two = F.expr("shiftleft(1L, _i) | shiftleft(1L, _j)")
    return (
        prints.select("fingerprint", F.explode(F.expr("sequence(0, 62)")).alias("_i"))
        .select("fingerprint", "_i", F.explode(F.expr("sequence(_i + 1, 63)")).alias("_j"))
        .select("_i", "_j", F.col("fingerprint").bitwiseAND(F.bitwise_not(two)).alias("_rest"), "fingerprint")
    )


def links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints: all that share a cold
    variant and differ in at most two bits, and stars for those in hot variants."""
    index = one_wildcard(dealt(prints, "fingerprint"))
    sizes = index.groupBy("variant").agg(F.count("*").alias("_n")).where("_n > 1")
    # few of all variants are shared: rebalanced, they are not a small file from every task
    shared = materialize(join_spread(index, growing(sizes), ["variant"]).hint("rebalance"), "shared-variants")
    cold = shared.where(F.col("_n") <= large).select("variant", "fingerprint")
    left, right = cold.withColumnRenamed("fingerprint", "a"), cold.withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = left.join(growing(right), "variant").where((F.col("a") < F.col("b")) & near).select("a", "b")
    hot = shared.where(F.col("_n") > large).select("fingerprint").distinct()
    spread = two_wildcards(dealt(hot, "fingerprint"))
    centres = (
        spread.groupBy("_i", "_j", "_rest")
        .agg(F.min("fingerprint").alias("a"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    stars = (
        join_spread(spread, growing(centres), ["_i", "_j", "_rest"])
        .where("a < fingerprint")
        .select("a", F.col("fingerprint").alias("b"))
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, large: int = LARGE
) -> DataFrame:
    """(id, fingerprint long, component_id): the smallest id reachable over links
    of at most two differing bits.

    Documents without words (null, empty, white space) all have fingerprint zero
    and link like others. Copies share a fingerprint and are linked through it,
    never in pairs. Rows that repeat an id get a row each; null ids take part and
    are named only by ids that are not null. An empty table gives none. Other
    columns are ignored.
    """
    made = materialize(fingerprints(docs, id_col, text, shingle), "fingerprints")
    prints = made.groupBy("fingerprint").agg(F.min(id_col).alias("_first"))
    edges = links(prints.select("fingerprint"), large)
    roots = components(edges).withColumnRenamed("node", "fingerprint")
    named = prints.join(growing(roots), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = materialize(named, "roots")
    smallest = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    table = join_spread(named, growing(smallest), ["root"]).select("fingerprint", "component_id")
    return join_spread(made, growing(table), ["fingerprint"]).select(id_col, "fingerprint", "component_id")
