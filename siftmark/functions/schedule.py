"""Learning-rate and cost formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed


def wsd_lr(
    step: Column,
    peak: float = fixed.PEAK_LR,
    warmup: float = fixed.WARMUP_ITERS,
    stable: int = fixed.STABLE_ITERS,
) -> Column:
    """Linear warm-up, a flat stretch, then halving every 400 steps."""
    return (
        F.when(step < warmup, peak * step / F.lit(warmup))
        .when(step < stable, F.lit(peak))
        .otherwise(peak * F.pow(F.lit(0.5), (step - stable) / F.lit(float(fixed.DECAY_HALF_LIFE))))
    )


def sequence_flops(length: Column, layers: int, width: int, parameters: int) -> Column:
    """Floating-point operations of one forward pass over a sequence."""
    size = length.cast("double")
    return 2.0 * parameters * size + layers * 4.0 * width * size * size


def step_flops(
    length: Column, layers: int, width: int, trained: int, frozen: int = 0, training: bool = True
) -> Column:
    """Forward and, when training, backward cost; frozen weights skip their update."""
    own = sequence_flops(length, layers, width, trained) * (3.0 if training else 1.0)
    rest = sequence_flops(length, layers, width, frozen) * (2.0 if training else 1.0)
    return own + rest


def round_up(value: Column, multiple: int) -> Column:
    """The next multiple at or above ``value``."""
    return value + F.pmod(-value, F.lit(multiple))
