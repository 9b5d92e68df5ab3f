"""What one training step on a row does to the loss on held-out token shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed


def first_step_loss(
    rows: DataFrame,
    id_col: str,
    tokens: str,
    held_out: DataFrame,
    vocabulary: int,
    rate: float = fixed.PEAK_LR,
    clip: float = 1.0,
    eps: float = 1e-8,
) -> DataFrame:
    """(id, influence): held-out loss of token odds after each row's own first step from even odds.

    ``held_out`` has (token, share), its shares adding to one; it is broadcast,
    being at most ``vocabulary`` rows. Token ids are below ``vocabulary``. The
    step is the sign-like first one of an adaptive method: gradient over its
    absolute value plus ``eps``, after clipping to length ``clip``. Tokens that
    a row lacks all have the same gradient, so only those it has are kept: at
    most ``vocabulary`` a row. Null or empty ``tokens`` are a row without any.
    """
    even = F.lit(1.0 / vocabulary)
    counts = rows.select(id_col, F.explode_outer(tokens).alias("token")).groupBy(id_col, "token").agg(
        F.count("token").alias("n")
    )
    shared = counts.join(F.broadcast(held_out), "token", "left")
    entry = F.when(F.col("n") > 0, F.struct(F.col("n"), F.coalesce("share", F.lit(0.0)).alias("share")))
    held = shared.groupBy(id_col).agg(F.sum("n").alias("total"), F.collect_list(entry).alias("had"))

    gradients = F.transform("had", lambda e: F.struct((even - e["n"] / F.col("total")).alias("g"), e["share"].alias("share")))
    absent = F.lit(vocabulary) - F.size("had")
    return _loss_after_step(held.withColumn("_absent", absent).withColumn("had", gradients), id_col, even, rate, clip, eps)


def first_step_loss_of_shares(
    rows: DataFrame,
    id_col: str,
    shares: str,
    held_out: list[float],
    rate: float = fixed.PEAK_LR,
    clip: float = 1.0,
    eps: float = 1e-8,
) -> DataFrame:
    """:func:`first_step_loss` of rows that have the ``shares`` of all tokens, as stored answers do.

    ``held_out`` and ``shares`` have an entry for each token of the vocabulary.
    """
    even = F.lit(1.0 / len(held_out))
    entries = F.zip_with(
        shares,
        F.array(*[F.lit(float(v)) for v in held_out]),
        lambda own, share: F.struct((even - own).alias("g"), share.alias("share")),
    )
    ready = rows.select(id_col, F.lit(0).alias("_absent"), entries.alias("had"))
    return _loss_after_step(ready, id_col, even, rate, clip, eps)


def _loss_after_step(ready: DataFrame, id_col: str, even: Column, rate: float, clip: float, eps: float) -> DataFrame:
    """(id, influence) of rows with ``had``, the (g, share) of tokens, and ``_absent``, the count of the others."""
    absent = F.col("_absent")

    def added(of) -> Column:
        return F.aggregate("had", F.lit(0.0), lambda a, e: a + of(e))

    length = F.sqrt(added(lambda e: e["g"] * e["g"]) + absent * even * even)
    cut = F.least(F.lit(1.0), F.lit(clip) / F.greatest(length, F.lit(1e-12)))

    def stepped(gradient: Column) -> Column:
        return -F.lit(rate) * gradient * F.col("cut") / (F.abs(gradient * F.col("cut")) + eps)

    ready = ready.withColumn("cut", cut)
    normal = F.ln(added(lambda e: F.exp(stepped(e["g"]))) + absent * F.exp(stepped(even)))
    gained = added(lambda e: e["share"] * stepped(e["g"])) + (1 - added(lambda e: e["share"])) * stepped(even)
    return ready.select(id_col, (normal - gained).alias("influence"))
