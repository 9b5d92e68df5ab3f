"""Array expressions over vectors, logits and gradients."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column, eps: float = fixed.NORM_EPS) -> Column:
    """Each element over the norm; a vector shorter than ``eps`` is divided by ``eps``."""
    parts = F.struct(vector.alias("v"), F.greatest(l2_norm(vector), F.lit(eps)).alias("n"))
    # the one-element array binds the norm once instead of once per element
    return F.transform(
        F.array(parts), lambda p: F.transform(p["v"], lambda x: x.cast("double") / p["n"])
    )[0]


def sign_gradient(gradient: Column) -> Column:
    return F.transform(gradient, lambda x: F.signum(x.cast("double")))


def adam_gradient(gradient: Column, average: Column, average_sq: Column) -> Column:
    """Adam's direction from the stored moments; epsilon is under the root."""
    b1, b2, eps = fixed.ADAM_BETA1, fixed.ADAM_BETA2, fixed.ADAM_EPS
    first = F.zip_with(average, gradient, lambda m, g: b1 * m + (1 - b1) * g)
    second = F.zip_with(average_sq, gradient, lambda v, g: b2 * v + (1 - b2) * g * g)
    return F.zip_with(first, second, lambda m, v: m / F.sqrt(v + eps))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row: a lambda's body is otherwise computed for each element."""
    return F.transform(F.array(value), use)[0]


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x.cast("double") / temperature)
    peak = _bound(
        scaled, lambda v: _bound(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most)))
    )
    return _bound(peak, lambda e: _bound(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def softmax_kept(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax over the logits that are not null; the null ones get probability 0."""
    cold = F.transform(logits, lambda x: F.coalesce(x.cast("double"), F.lit(float("-inf"))))
    return softmax(cold, temperature)


def log_softmax_at(logits: Column, target: Column) -> Column:
    """Log probability of the zero-based ``target``."""
    values = doubles(logits)
    peak = F.array_max(values)
    spread = F.transform(
        F.array(F.struct(values.alias("v"), peak.alias("m"))),
        lambda p: _sum(F.transform(p["v"], lambda x: F.exp(x - p["m"]))),
    )[0]
    return F.get(values, target) - peak - F.log(spread)


def cross_entropy(logits: Column, target: Column, ignore: int = fixed.PAD_TARGET) -> Column:
    """Loss of one position; null where the target is ignored."""
    return F.when(target != ignore, -log_softmax_at(logits, target))


def last_state(states: Column, mask: Column) -> Column:
    """The hidden state at the last token that the attention mask keeps."""
    kept = F.aggregate(mask, F.lit(0), lambda total, x: total + x.cast("int"))
    return F.get(states, kept - 1)


def argmax(values: Column) -> Column:
    """Zero-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rank_of(values: Column, target: Column) -> Column:
    """How many classes come before ``target``: larger first, ties to the higher class."""
    own = F.get(values, target)
    ahead = F.filter(
        F.zip_with(
            values,
            F.sequence(F.lit(0), F.size(values) - 1),
            lambda v, i: (v > own) | ((v == own) & (i > target)),
        ),
        lambda before: before,
    )
    return F.size(ahead)


def crop_to_top(logits: Column, k: int) -> Column:
    """Keep the ``k`` largest logits, earlier places first on ties; null the rest."""

    def cropped(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(values) - 1)
        marked = F.zip_with(values, places, lambda v, i: F.struct((-v).alias("neg"), i.alias("at")))
        kept = F.transform(F.slice(F.sort_array(marked), 1, k), lambda s: s["at"])
        return _bound(kept, lambda top: F.zip_with(values, places, lambda v, i: F.when(F.array_contains(top, i), v)))

    return _bound(logits, cropped)


def draw_from(probabilities: Column, chance: Column) -> Column:
    """Zero-based place at which the running probability passes ``chance``."""

    def drawn(pair: Column) -> Column:
        passed = F.aggregate(
            pair["p"],
            F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("at")),
            lambda acc, p: F.struct(
                (acc["seen"] + F.coalesce(p, F.lit(0.0))).alias("seen"),
                (acc["at"] + F.when(acc["seen"] + F.coalesce(p, F.lit(0.0)) <= pair["u"], 1).otherwise(0)).alias("at"),
            ),
        )
        return F.least(passed["at"], F.size(pair["p"]) - 1)

    return _bound(F.struct(probabilities.alias("p"), chance.alias("u")), drawn)
