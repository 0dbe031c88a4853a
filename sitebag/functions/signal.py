"""Raw-signal functions: move tables, normalisation, logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, sorted_quantile

# Quantile normalisation and the clipping range of normalised signals.
QUANTILE_A, QUANTILE_B = 0.2, 0.9
SHIFT_FACTOR, SCALE_FACTOR = 0.51, 0.53
MIN_SHIFT, MIN_SCALE = 10.0, 1.0
CLIP = 5.0
EPS = 1e-6


def decode_overflow(values: Column) -> Column:
    """Sum runs of saturated int8 values (-128, 127) with the value that ends each run; NULL if the last run is open.

    Each run is summed over its own slice, so the work is linear; a table without saturated values passes through.
    """
    def saturated(x: Column) -> Column:
        return (x == -128) | (x == 127)

    def sum_runs(v: Column) -> Column:
        ends = F.filter(F.transform(v, lambda x, i: F.when(~saturated(x), i)), lambda i: i.isNotNull())

        def run(e: Column, last: Column) -> Column:
            whole = F.aggregate(F.slice(v, last + 2, e - last), F.lit(0), lambda a, x: a + x)
            return F.when(e - last == 1, F.get(v, e)).otherwise(whole)

        return let(ends, lambda es: F.transform(es, lambda e, i: run(e, F.coalesce(F.get(es, i - 1), F.lit(-1)))))

    def decode(v: Column) -> Column:
        is_open = F.coalesce(saturated(F.get(v, F.size(v) - 1)), F.lit(True))
        return F.when(is_open, F.lit(None)).when(F.exists(v, saturated), sum_runs(v)).otherwise(v)

    return let(values.cast("array<int>"), decode)


def decode_moves(mv: Column) -> Column:
    """Struct (stride, emitted): base i of the read was emitted at signal position ``emitted[i]``.

    NULL for a missing or malformed table, a stride <= 0 or a negative move.
    """
    def expand(decoded: Column) -> Column:
        stride = F.get(decoded, 0)
        moves = F.slice(decoded, 2, F.greatest(F.size(decoded) - 1, F.lit(0)))
        emitted = F.flatten(
            F.transform(moves, lambda m, i: F.array_repeat((i * stride + F.floor(stride / 2)).cast("int"), m))
        )
        valid = decoded.isNotNull() & (stride > 0) & ~F.exists(moves, lambda m: m < 0)
        return F.when(valid, F.struct(stride.alias("stride"), emitted.alias("emitted")))

    return let(decode_overflow(mv), expand)


def calibrate(raw: Column, offset: Column, scale: Column) -> Column:
    return F.transform(raw, lambda x: (x + offset) * scale)


def quantile_norm(
    sig: Column,
    qa: float = QUANTILE_A,
    qb: float = QUANTILE_B,
    shift_factor: float = SHIFT_FACTOR,
    scale_factor: float = SCALE_FACTOR,
) -> Column:
    """Struct (shift, scale) from two quantiles of the signal."""
    def fit(ordered: Column) -> Column:
        a, b = sorted_quantile(ordered, qa), sorted_quantile(ordered, qb)
        return F.struct(
            F.greatest(F.lit(MIN_SHIFT), F.lit(shift_factor) * (a + b)).alias("shift"),
            F.greatest(F.lit(MIN_SCALE), F.lit(scale_factor) * (b - a)).alias("scale"),
        )

    return let(F.array_sort(sig), fit)


def normalize_signal(
    sig: Column, strategy: str = "quantile", shift: Column | None = None, scale: Column | None = None, **quantile
) -> Column:
    """``(sig - shift) / scale`` clipped to +-5; NULL when the scale is close to zero.

    ``from-tags`` and ``constant`` take ``shift``/``scale``; ``quantile`` derives them from the signal.
    """
    if strategy == "quantile":
        params = quantile_norm(sig, **quantile)
    elif strategy in ("from-tags", "constant"):
        if shift is None or scale is None:
            raise ValueError(f"strategy {strategy!r} needs shift and scale")
        params = F.struct(shift.cast("double").alias("shift"), scale.cast("double").alias("scale"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")

    def apply(p: Column) -> Column:
        scaled = F.transform(
            sig, lambda x: F.least(F.greatest((x - p["shift"]) / p["scale"], F.lit(-CLIP)), F.lit(CLIP))
        )
        return F.when(F.abs(p["scale"]) >= EPS, scaled)

    return let(params, apply)


def softmax(logits: Column) -> Column:
    def normed(weights: Column) -> Column:
        norm = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        return let(norm, lambda t: F.transform(weights, lambda w: w / t))

    return let(
        F.array_max(logits), lambda top: let(F.transform(logits, lambda x: F.exp(x - top)), normed)
    )


def logits_to_calls(logits: Column, threshold: float = 0.5) -> Column:
    """Struct (pred, conf, probs): one class -> 0, two classes -> threshold on the second, else arg max."""
    n = F.size(logits)

    def decide(probs: Column) -> Column:
        pred = (
            F.when(n == 1, F.lit(0))
            .when(n == 2, (F.get(probs, 1) >= threshold).cast("int"))
            .otherwise(F.array_position(probs, F.array_max(probs)).cast("int") - 1)
        )
        return F.struct(pred.alias("pred"), F.get(probs, pred).alias("conf"), probs.alias("probs"))

    return let(softmax(logits), decide)


__all__ = [
    "calibrate",
    "decode_moves",
    "decode_overflow",
    "logits_to_calls",
    "normalize_signal",
    "quantile_norm",
    "softmax",
]
