"""Ratios, money text, discount tiers and status bands as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Discount cut points and the two label sets.
DISCOUNT_CUTS = (0, 0.2, 0.5)
TIER_LABELS = ("Sin desc.", "≤20%", "≤50%", ">50%")
TIER_LABELS_LONG = ("Sin descuento", "Bajo (<=20%)", "Medio (<=50%)", "Alto (>50%)")


def real(value: Column) -> Column:
    return value.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null for a zero denominator."""
    return F.try_divide(real(part), real(whole))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage, null for a zero denominator (half-even)."""
    return F.bround(ratio(part, whole) * 100, digits)


def pct_or_zero(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage, 0 for a zero or missing denominator."""
    return F.coalesce(pct(part, whole, digits), F.lit(0.0))


def change_pct(current: Column, previous: Column, digits: int = 1) -> Column:
    """Rounded relative change, null when there is nothing to compare with."""
    gap = real(current) - real(previous)
    return F.bround(F.try_divide(gap, real(previous)) * 100, digits)


def total(value: Column) -> Column:
    """Sum that is 0 rather than null over no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def clip(value: Column, low=None, high=None) -> Column:
    """Keep ``value`` in [low, high]; null stays null."""
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(value.isNotNull(), bounded)


def _plain(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def money_short(value: Column) -> Column:
    """``$1.2M``, ``$3K`` or ``$45``."""
    x = real(value)
    return (
        F.when(F.abs(x) >= 1_000_000, F.concat(F.lit("$"), _plain(x / 1_000_000, 1), F.lit("M")))
        .when(F.abs(x) >= 1_000, F.concat(F.lit("$"), _plain(x / 1_000, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), _plain(x, 0)))
    )


def money(value: Column, digits: int = 0) -> Column:
    """``$1,234`` or ``$1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(real(value), digits))


def pct_text(value: Column, digits: int = 1) -> Column:
    return F.concat(_plain(real(value), digits), F.lit("%"))


def days_text(value: Column) -> Column:
    return F.concat(_plain(real(value), 1), F.lit("d"))


def discount_tier(
    discount: Column,
    cuts: Sequence[float] = DISCOUNT_CUTS,
    labels: Sequence[str] = TIER_LABELS,
) -> Column:
    """Label of the tier: equal to the first cut, up to each further cut, above the last."""
    first, *rest = cuts
    chosen = F.when(discount == F.lit(first), labels[0])
    for cut, label in zip(rest, labels[1:]):
        chosen = chosen.when(discount <= F.lit(cut), label)
    return chosen.otherwise(labels[-1])


# ---- status bands ----------------------------------------------------------


def margin_band(margin: Column) -> Column:
    return F.when(margin <= 0, "red").when(margin < 20, "amber").when(margin.isNotNull(), "green")


def region_margin_band(margin: Column) -> Column:
    return F.when(margin < 8, "amber").when(margin.isNotNull(), "green")


def on_time_band(share: Column) -> Column:
    return F.when(share >= 70, "green").when(share >= 50, "amber").when(share.isNotNull(), "red")


def segment_margin_band(margin: Column) -> Column:
    return F.when(margin >= 12, "green").when(margin.isNotNull(), "amber")


def lift_band(lift: Column) -> Column:
    return F.when(lift >= 1.5, "green").when(lift.isNotNull(), "plain")


def fit_band(r2: Column) -> Column:
    return F.when(r2 < 0.3, "bajo").when(r2 < 0.6, "moderado").when(r2.isNotNull(), "bueno")


def trend_sign(delta: Column) -> Column:
    return F.when(delta.isNull(), "neutral").when(delta >= 0, "pos").otherwise("neg")
