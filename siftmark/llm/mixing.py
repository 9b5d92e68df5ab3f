"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The mix is a row of slots. Slot k has the point k * golden ratio mod 1, and the
source in whose share of [0, 1) the point falls. Shares are dealt by whole blocks
of the targets and some to spare; however long a stretch of slots one looks at,
each source has close to its share of it. The r-th slot of a source
takes the r-th block of the source's words: its documents in shuffled order, end
to end, twice over, cut into blocks of equally many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import bucket_count, growing, join_spread
from siftmark.session import materialize

#: Points are multiples of 1 / 2**31; the factor is the odd number nearest 2**31 * 0.618034.
POINTS, GOLDEN = 2**31, 1_327_217_885
#: The line of points is cut into so many cells to look up the source of a point.
CELLS = 4096
#: Slots are counted, and documents lined up, in stretches of about so many.
STRETCH = 1024
#: Slots beyond the exact number, so that each source reaches its target: 2%, or so many if more.
SPARE, LEAST_SPARE = 1.02, 8


def source_key(name: str) -> Column:
    """The source as a text that is never null and sorts by code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("t")).alias("source")


def all_differ(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from documents' (source, size).

    ``source`` is a text and never null; the sources in order of code points have
    ``weights`` in turn.
    Targets are shares of ``share`` times all words, stop at ``most`` times the
    source's size, and what is cut off goes to the others by weight: sources are
    capped in order of most * size / weight as long as the level at which the
    others would stand is above it. One row for each source, in one small window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("source")
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cap = F.lit(most) * F.col("source_size")
    rows = totals.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_ratio", cap / F.col("_w"))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy("_ratio", "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(
        rising.rowsBetween(0, Window.unboundedFollowing)
    )
    rows = rows.withColumn("_level", level).withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    last = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)  # that of the first
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(last * F.col("_w"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _line(needs: DataFrame, spare: int) -> DataFrame:
    """(slot, source, _stretch): the line of slots, with ``spare`` slots a source beyond its need, or 2% if more."""
    share = F.when(F.col("_need") > 0, F.greatest(F.ceil(F.col("_need") * SPARE), F.col("_need") + spare)).otherwise(0)
    dealt = needs.select("source", share.cast("long").alias("_share"))
    slots = dealt.agg(F.sum("_share")).first()[0] or 0
    before = Window.partitionBy(F.lit(0)).orderBy("source")
    upper = F.sum("_share").over(before.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(slots or 1))
    bounds = dealt.withColumn("_hi", F.round(upper * POINTS).cast("long")).select(
        "source", "_hi", F.coalesce(F.lag("_hi").over(before), F.lit(0)).alias("_lo")
    )
    width = POINTS // CELLS
    cells = F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))
    cells = bounds.where("_hi > _lo").withColumn("_cell", F.explode(cells))
    point = F.col("slot") % POINTS * GOLDEN % POINTS
    line = needs.sparkSession.range(0, slots).select(F.col("id").alias("slot"), point.alias("_point"))
    line = line.withColumn("_cell", F.floor(F.col("_point") / width)).join(cells, "_cell")
    return line.where("_point >= _lo AND _point < _hi").select(
        "slot", "source", F.floor(F.col("slot") / STRETCH).alias("_stretch")
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the source of each slot and its rank among the source's slots.

    Every source has a slot for each block of its target, the last begun one
    included, however small its share: slots are counted, and dealt again with
    more to spare should a source lack one.
    """
    needs = targets.select("source", F.ceil(F.floor("target") / block).alias("_need"))
    spare = LEAST_SPARE
    while True:
        line = _line(needs, spare)
        counts = materialize(line.groupBy("source", "_stretch").agg(F.count("*").alias("_n")), "slot-counts")
        found = counts.groupBy("source").agg(F.sum("_n").alias("_found"))
        if needs.join(found, "source", "left").where("_need > coalesce(_found, 0)").isEmpty():
            break
        spare *= 2
    earlier = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "source", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("source", "_stretch").orderBy("slot")) - 1
    joined = line.withColumn("_in", inside).join(growing(starts), ["source", "_stretch"])
    return joined.select("slot", "source", (F.col("_start") + F.col("_in")).alias("rank"))


def _shuffle_key(seed: int) -> Column:
    """Fixed by the seed and the document's id; MD5, so that any engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def lined_up(sizes: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, start): each source's documents end to end, in shuffled order.

    ``start`` counts the words of earlier documents of the source. Documents are
    sorted in stretches of the shuffle key, and the stretches' totals summed, so
    a source may hold most documents.
    """
    stretches = bucket_count(sizes.count(), STRETCH)
    rows = sizes.withColumn("_key", _shuffle_key(seed)).withColumn(
        "_stretch", F.floor(F.col("_key") / (2**48 // stretches))
    )
    totals = rows.groupBy("source", "_stretch").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "source",
        "_stretch",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    nearer = (
        Window.partitionBy("source", "_stretch")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(nearer), F.lit(0)))
    joined = rows.join(growing(starts), ["source", "_stretch"])
    return joined.select("doc_id", "source", "size", (F.col("_start") + F.col("_in")).alias("start"))


def mixture(
    sizes: DataFrame,
    targets: DataFrame,
    block: int = 128,
    seed: int = 17,
    passes: int = 2,
) -> DataFrame:
    """(slot, source, rank, doc_id, pass, from_word, words): what each slot takes, by document.

    ``sizes`` has (doc_id, source, size). A source's last block is cut at its
    target; slots after it stay empty, and so do a document's passes after
    ``passes``. Documents without words are taken nowhere.
    """
    table = targets.select("source", "source_size", F.floor("target").alias("_quota"))
    placed = join_spread(lined_up(sizes.where("size > 0"), seed), table, ["source"])
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    placed = placed.withColumn("_from", F.col("start") + F.col("pass") * F.col("source_size"))
    placed = placed.withColumn("_to", F.least(F.col("_from") + F.col("size"), "_quota")).where("_from < _to")
    ranks = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))
    pieces = placed.withColumn("rank", F.explode(ranks)).withColumn(
        "_begin", F.greatest("_from", F.col("rank") * block)
    )
    pieces = pieces.select(
        "source",
        "rank",
        "doc_id",
        "size",
        "pass",
        (F.col("_begin") - F.col("_from")).alias("from_word"),
        (F.least("_to", (F.col("rank") + 1) * block) - F.col("_begin")).alias("words"),
    )
    placed = schedule(targets, block).join(growing(pieces), ["source", "rank"])
    return placed.select("slot", "source", "rank", "doc_id", "size", "pass", "from_word", "words")


def taken_words(docs: DataFrame, block: int = 128, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, n_pieces): one row per document.

    ``docs`` has (doc_id, source, size). ``taken`` sums what the slots take, at
    most twice the size. A null source is a source of its own, the last. Rows
    that repeat (doc_id, source, size) share out what is taken among themselves
    evenly; a null id is an id. ``first_slot`` is the document's place in the
    mix, the first slot that takes some of it (null where none does), and
    ``n_pieces`` the pieces it is taken in, one for each slot and pass; rows that
    repeat share both. Documents without words, and all documents of an
    empty mix, take none.
    """
    sizes = materialize(docs.select("doc_id", source_key("source"), "size"), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    mixed = mixture(sizes, targets, block, seed)
    key = F.struct("doc_id", "source", "size")
    sums = mixed.groupBy(key.alias("_key")).agg(
        F.sum("words").alias("_taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces")
    )
    copies = sizes.groupBy(key.alias("_key")).agg(F.count("*").alias("_copies"))
    table = copies.join(sums, "_key", "left").select(
        "_key.*", F.posexplode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth", "_one"),
        "_copies", F.coalesce("_taken", F.lit(0)).alias("_taken"),
        "first_slot", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"),
    )
    share = F.floor((F.col("_taken") + F.col("_nth")) / F.col("_copies")).cast("long")
    table = table.withColumn("taken", share)
    name = F.when(F.col("source") != "t", F.expr("substring(source, 2)"))
    return join_spread(table, targets, ["source"]).select(
        "doc_id", name.alias("source"), "size", "source_size", "target", "taken", "first_slot", "n_pieces"
    )
