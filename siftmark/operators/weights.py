"""Agent weights: influence losses folded into category and family weights."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed
from siftmark.operators.ordering import running_total

FAMILIES = ("quality", "domain", "topic")


@dataclass(frozen=True)
class UpdateRule:
    """Constants of one weight update."""

    eta: float = fixed.ETA
    loss_scale: float = fixed.LOSS_SCALE
    s_scale: float = fixed.S_SCALE
    s_divisor: float = fixed.S_DIVISOR
    beta: float = fixed.COLLABORATION_BETA


def _start(keys):
    return {key: fixed.INITIAL_WEIGHT for key in keys}


@dataclass
class AgentWeights:
    """The 25 category weights and the three collaboration weights.

    Key order matters: it decides which quality bucket matches first and
    which values move the collaboration weights.
    """

    quality: dict[str, float] = field(default_factory=lambda: _start(fixed.QUALITY_KEYS))
    domain: dict[str, float] = field(default_factory=lambda: _start(fixed.DOMAIN_KEYS))
    topic: dict[str, float] = field(default_factory=lambda: _start(fixed.TOPIC_KEYS))
    collaboration: list[float] = field(default_factory=lambda: [1.0 / 3] * 3)

    def family(self, name: str) -> dict[str, float]:
        return getattr(self, name)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(family, key, ord, weight): one row per category, in merge order."""
        entries = [(f, k, w) for f in FAMILIES for k, w in self.family(f).items()]
        table = pa.table(
            {
                "family": [f for f, _, _ in entries],
                "key": [k for _, k, _ in entries],
                "ord": pa.array(range(len(entries)), pa.int32()),
                "weight": [float(w) for _, _, w in entries],
            }
        )
        return spark.createDataFrame(table)

    def agent_json(self) -> str:
        return json.dumps(
            {
                "topic_weights": self.topic,
                "domain_weights": self.domain,
                "quality_weights": self.quality,
            }
        )

    def collaboration_json(self) -> str:
        return json.dumps(self.collaboration)

    @classmethod
    def from_json(cls, agent: str, collaboration: str) -> AgentWeights:
        families = json.loads(agent)
        return cls(
            quality=families.get("quality_weights", {}),
            domain=families.get("domain_weights", {}),
            topic=families.get("topic_weights", {}),
            collaboration=json.loads(collaboration),
        )


def flatten_influence(lines: DataFrame) -> DataFrame:
    """One row per loss: (family, key, position, loss).

    ``lines`` holds (family, key, line_no, influence). Rows whose influence is
    missing are skipped; ``position`` counts losses in line, then list order.
    """
    kept = lines.where(F.col("influence").isNotNull()).select(
        "family", "key", "line_no", "influence"
    )
    # only lengths are ordered and totalled; the lists move once, to meet their starts
    lengths = kept.select("family", "key", "line_no", F.size("influence").alias("_n"))
    starts = running_total(lengths, "line_no", F.col("_n"), groups=("family", "key"), out="start").drop("_n")
    return kept.join(starts, ["family", "key", "line_no"]).select(
        "family", "key", "start", F.posexplode("influence").alias("at", "loss")
    ).select("family", "key", (F.col("start") + F.col("at")).alias("position"), "loss")


def influence_stats(losses: DataFrame) -> DataFrame:
    """Mean and population deviation of the losses of each category."""
    return losses.groupBy("family", "key").agg(
        F.count("*").alias("n"),
        F.avg("loss").alias("mean_loss"),
        F.stddev_pop("loss").alias("std_loss"),
    )


def fold_losses(
    lines: DataFrame, weights: AgentWeights, rule: UpdateRule = UpdateRule(), block_bits: int = 16
) -> DataFrame:
    """Per category: folded weight, loss count and last loss.

    The step ``w <- (1-eta) w + eta exp(c loss)`` is linear in ``w``, so each
    block of 65,536 line numbers is folded from zero on its own, and a block's
    result counts ``(1-eta)`` to the power of the losses after it. A category
    holding most of the losses is spread over its blocks; what is ordered per
    category is one row per block.
    """
    start = weights.to_frame(lines.sparkSession)
    numbers = F.broadcast(start.select("family", "key", "ord"))  # one row per category
    # each line is folded where it is read; its list and names are not shuffled
    known = lines.where(F.size("influence") > 0).join(numbers, ["family", "key"])
    folded_lines = known.select(
        "ord",
        F.shiftright("line_no", block_bits).alias("block"),
        "line_no",
        *line_fold(rule),
    )
    return fold_blocks(start, folded_lines, rule)


def line_fold(rule: UpdateRule) -> list[Column]:
    """(n, gained, last_loss) of one line: its losses folded from zero."""
    step = F.aggregate(
        "influence",
        F.lit(0.0),
        lambda w, loss: F.lit(1 - rule.eta) * w + F.lit(rule.eta) * F.exp(loss * rule.loss_scale),
    )
    return [
        F.size("influence").cast("long").alias("n"),
        step.alias("gained"),
        F.element_at("influence", -1).alias("last_loss"),
    ]


def fold_blocks(start: DataFrame, folded_lines: DataFrame, rule: UpdateRule) -> DataFrame:
    """Folded categories from parts (ord, block, line_no, n, gained, last_loss) that do not overlap.

    A part is a line, or lines next to each other under the number of one of them.
    """
    keep = F.lit(1 - rule.eta)

    def later(order: str, *within: str) -> Column:
        frame = (
            Window.partitionBy("ord", *within)
            .orderBy(F.desc(order))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum("n").over(frame), F.lit(0).cast("long"))

    def total(rows: DataFrame, order: str, *within: str) -> DataFrame:
        aged = rows.withColumn("after", later(order, *within))
        return aged.groupBy("ord", *within).agg(
            F.sum("n").alias("n"),
            F.sum(F.pow(keep, "after") * F.col("gained")).alias("gained"),
            F.max_by("last_loss", order).alias("last_loss"),
        )

    folded = total(total(folded_lines, "line_no", "block"), "block")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return start.join(folded, "ord", "left").select(
        "family",
        "key",
        "ord",
        (F.pow(keep, n) * F.col("weight") + F.coalesce("gained", F.lit(0.0))).alias("weight"),
        n.alias("n"),
        "last_loss",
    )


def normalize_families(folded: DataFrame) -> DataFrame:
    """Divide each weight by its family's sum."""
    share = F.try_divide("weight", F.sum("weight").over(Window.partitionBy("family")))
    return folded.withColumn("weight", share)


def s_values(normalized: DataFrame, rule: UpdateRule = UpdateRule()) -> DataFrame:
    """Add ``s``: the updated weight times the last scaled loss over the count.

    A category without losses has no ``s``.
    """
    scaled = F.exp(F.col("last_loss") * rule.s_scale) / rule.s_divisor - 1
    return normalized.withColumn("s", F.try_divide(F.col("weight") * scaled, F.col("n")))


def with_collaboration(
    s_frame: DataFrame, previous: list[float], rule: UpdateRule = UpdateRule()
) -> DataFrame:
    """Add ``agent`` and ``agent_weight`` to the rows that move an agent.

    Agent i moves with the i-th value of S in merge order, against the mean
    over all categories. There is one row per category to order here.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("s").isNull(), "ord")) - 1
    agent = F.when(F.col("s").isNotNull() & (place < len(previous)), place)
    diff = F.col("s") - F.avg("s").over(everything)
    before = F.get(F.array(*[F.lit(float(w)) for w in previous]), F.col("agent"))
    moved = before + F.signum(diff) * F.pow(F.abs(diff), F.lit(rule.beta))
    total = F.sum("moved").over(everything)
    return (
        s_frame.withColumn("agent", agent)
        .withColumn("moved", moved)
        .withColumn("total", total)
        .withColumn(
            "agent_weight",
            F.when(F.col("total") != 0, F.try_divide("moved", "total")).otherwise(F.col("moved")),
        )
        .drop("moved", "total")
    )


def collaborate(
    s_frame: DataFrame, previous: list[float], rule: UpdateRule = UpdateRule()
) -> DataFrame:
    """(agent, weight): the collaboration weights after the move."""
    moved = with_collaboration(s_frame, previous, rule).where(F.col("agent").isNotNull())
    return moved.select("agent", F.col("agent_weight").alias("weight"))


def update_weights(
    lines: DataFrame, weights: AgentWeights, rule: UpdateRule = UpdateRule()
) -> AgentWeights:
    """One whole update in one job; one row per category comes back to the driver."""
    categories = s_values(normalize_families(fold_losses(lines, weights, rule)), rule)
    rows = with_collaboration(categories, weights.collaboration, rule).collect()
    rows.sort(key=lambda r: r.ord)
    collaboration = [r.agent_weight for r in rows if r.agent is not None]
    if len(collaboration) < len(weights.collaboration):
        raise ValueError("too few categories have losses to move the collaboration weights")
    return AgentWeights(
        **{f: {r.key: r.weight for r in rows if r.family == f} for f in FAMILIES},
        collaboration=collaboration,
    )
