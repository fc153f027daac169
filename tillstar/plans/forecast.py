"""Monthly forecast of sales and profit by linear regression on lag features.

Everything is column arithmetic: any number of series is fitted side by side
from the sums of products of their features, and predicted by folding the
future months into an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators import months as m
from tillstar.operators.metric import metric
from tillstar.plans.timeline import with_features

FEATURES = ("t", "month", "lag_1", "lag_12", "ma_3")
TARGETS = ("sales", "profit")
# a feature that the ones before it explain up to this share has no weight
DEPENDENT = 1e-10


def long_series(series: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Feature rows of every target, named by the column ``series``."""
    parts = [with_features(series, t, partition_by).withColumn("series", F.lit(t)) for t in TARGETS]
    return parts[0].unionByName(parts[1])


def fitted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: coef_<feature>, intercept and the fit's quality.

    Centred sums of products give the normal equations, which elimination
    solves in order of the features; a feature that depends on earlier ones
    gets no weight.
    """
    train = rows.filter(F.col("value").isNotNull() & F.col("lag_12").isNotNull())
    whole = Window.partitionBy(*keys)
    names = (*FEATURES, "value")
    centred = train.withColumns({f"mean_{c}": F.avg(c).over(whole) for c in names})
    products = {(a, b): F.sum((F.col(a) - F.col(f"mean_{a}")) * (F.col(b) - F.col(f"mean_{b}"))) for i, a in enumerate(names) for b in names[i:]}
    sums = centred.groupBy(*keys).agg(
        *[F.first(f"mean_{c}").alias(f"mean_{c}") for c in names], *[e.alias(f"{a}*{b}") for (a, b), e in products.items()]
    )
    solved = _eliminated(sums)
    level = F.col("mean_value")
    for f in FEATURES:
        level = level - F.col(f"coef_{f}") * F.col(f"mean_{f}")
    models = solved.withColumn("intercept", level).select(*keys, *[f"coef_{f}" for f in FEATURES], "intercept", F.col("value*value").alias("_spread"))
    missed = train.join(models, list(keys)).withColumn("_miss", F.col("value") - prediction({f: F.col(f) for f in FEATURES}))
    # values of less than a cent would make the relative error meaningless
    base = F.when(F.abs("value") > 0.01, F.abs("value")).otherwise(1.0)
    quality = missed.groupBy(*keys).agg(
        F.avg(F.abs("_miss")).alias("mae"),
        F.sqrt(F.avg(F.col("_miss") * F.col("_miss"))).alias("rmse"),
        (F.avg(F.abs("_miss") / base) * 100).alias("mape"),
        F.coalesce(1 - F.try_divide(F.sum(F.col("_miss") * F.col("_miss")), F.first("_spread")), F.lit(1.0)).alias("r2"),
    )
    return models.drop("_spread").join(quality, list(keys))


def _eliminated(sums: DataFrame) -> DataFrame:
    """Add coef_<feature>, the solution of the normal equations in ``sums``."""

    def product(a: str, b: str) -> Column:
        i, j = sorted((([*FEATURES, "value"]).index(a), ([*FEATURES, "value"]).index(b)))
        names = (*FEATURES, "value")
        return F.col(f"{names[i]}*{names[j]}")

    frame = sums
    for j, b in enumerate(FEATURES):
        left, toward = product(b, b), product(b, "value")
        for k in FEATURES[:j]:
            factor = F.col(f"_{b}/{k}")
            left = left - factor * factor * F.col(f"_{k}")
            toward = toward - factor * F.col(f"_{k}:value")
        frame = frame.withColumns({f"_{b}": left, f"_{b}:value": toward})
        frame = frame.withColumn(f"_{b}", F.when(F.col(f"_{b}") > DEPENDENT * product(b, b), F.col(f"_{b}")).otherwise(0.0))
        below = {}
        for i in FEATURES[j + 1 :]:
            rest = product(b, i)
            for k in FEATURES[:j]:
                rest = rest - F.col(f"_{i}/{k}") * F.col(f"_{b}/{k}") * F.col(f"_{k}")
            below[f"_{i}/{b}"] = F.coalesce(F.try_divide(rest, F.col(f"_{b}")), F.lit(0.0))
        frame = frame.withColumns(below)
    for j in reversed(range(len(FEATURES))):
        b = FEATURES[j]
        weight = F.try_divide(F.col(f"_{b}:value"), F.col(f"_{b}"))
        for i in FEATURES[j + 1 :]:
            weight = weight - F.col(f"_{i}/{b}") * F.col(f"coef_{i}")
        frame = frame.withColumn(f"coef_{b}", F.coalesce(weight, F.lit(0.0)))
    return frame


def prediction(features: dict[str, Column]) -> Column:
    value = F.col("intercept")
    for name, feature in features.items():
        value = value + F.col(f"coef_{name}") * feature
    return value


def points(series: DataFrame, ahead: int, clamp_at_zero: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per series and future month, with coefficients and fit quality.

    A month's features come from the months before it, predicted ones
    included: ``lag_1`` from the last of all, ``ma_3`` from up to three
    predictions (from history before the first), ``lag_12`` from history only,
    its mean standing in where history has ended.
    """
    if ahead < 1:
        raise ValueError("at least one month ahead must be asked for")
    keys = (*partition_by, "series")
    rows = long_series(series, partition_by)
    past = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_past"), F.max(m.MONTH).alias("_last"), F.count(F.lit(1)).alias("months")
    )
    too_short = F.raise_error(F.concat(F.lit("series "), F.col("series"), F.lit(" has "), F.col("months").cast("string"), F.lit(" months; more than 12 are needed")))
    known = (
        past.join(fitted(rows, keys), list(keys), "left")
        .withColumn("intercept", F.coalesce("intercept", too_short.cast("double")))
        .withColumn("_past", F.col("_past.value"))
        .withColumn("_mean", F.expr("aggregate(_past, 0D, (sum, v) -> sum + v, sum -> sum / size(_past))"))
    )

    def step(done: Column, i: Column) -> Column:
        latest = F.when(F.size(done) > 0, done).otherwise(F.col("_past"))
        recent = F.slice(latest, F.greatest(F.size(latest) - 2, F.lit(1)), 3)
        value = prediction(
            {
                "t": F.col("months") - 1 + i,
                "month": F.month(F.add_months("_last", i)),
                "lag_1": F.element_at(latest, -1),
                "lag_12": F.coalesce(F.get("_past", F.col("months").cast("int") - 13 + i), F.col("_mean")),
                "ma_3": F.aggregate(recent, F.lit(0.0), lambda total, v: total + v) / F.size(recent),
            }
        )
        return F.concat(done, F.array(F.bround(F.greatest(value, F.lit(0.0)) if clamp_at_zero else value, 2)))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(ahead)), F.array().cast("array<double>"), step)
    each = known.withColumn("_future", folded).select("*", F.posexplode("_future").alias("_i", "value"))
    return each.withColumn(m.MONTH, F.last_day(F.add_months("_last", F.col("_i") + 1))).drop("_past", "_last", "_mean", "_future", "_i")


def _history(series: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    values = [n.real(F.col(t)).alias(t) for t in TARGETS]
    return series.select(*partition_by, m.MONTH, *values, F.lit(False).alias("is_forecast"))


@metric("order_date", "sales", "profit", summed=True)
def forecast(df: DataFrame, ahead: int = 6, clamp_at_zero: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """History and forecast of both targets in one frame, flagged by ``is_forecast``."""
    series = m.monthly_totals(df, TARGETS, partition_by=partition_by)
    future = (
        points(series, ahead, clamp_at_zero, partition_by)
        .groupBy(*partition_by, m.MONTH)
        .agg(*[F.max(F.when(F.col("series") == t, F.col("value"))).alias(t) for t in TARGETS])
        .withColumn("is_forecast", F.lit(True))
    )
    both = _history(series, partition_by).unionByName(future)
    return both.select(
        *partition_by,
        F.date_format(m.MONTH, "yyyy-MM-dd").alias("date"),
        F.date_format(m.MONTH, "MMM yyyy").alias("date_label"),
        F.bround("sales", 2).alias("sales"),
        n.money(F.col("sales")).alias("sales_fmt"),
        F.bround("profit", 2).alias("profit"),
        n.money(F.col("profit")).alias("profit_fmt"),
        "is_forecast",
    )


@metric("order_date", "sales", "profit", summed=True)
def forecast_metrics(df: DataFrame, ahead: int = 6, partition_by: Sequence[str] = ()) -> DataFrame:
    """Fit quality and coefficients per target."""
    rows = long_series(m.monthly_totals(df, TARGETS, partition_by=partition_by), partition_by)
    keys = (*partition_by, "series")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_months"))
    return counted.join(fitted(rows, keys), list(keys)).select(
        *keys,
        "total_months",
        F.lit(ahead).alias("forecast_months"),
        F.bround("mae", 2).alias("mae"),
        n.money(F.col("mae")).alias("mae_fmt"),
        F.bround("rmse", 2).alias("rmse"),
        n.money(F.col("rmse")).alias("rmse_fmt"),
        F.bround("mape", 1).alias("mape"),
        n.pct_text(F.col("mape")).alias("mape_pct"),
        F.bround("r2", 3).alias("r2"),
        n.pct_text(F.col("r2") * 100).alias("r2_pct"),
        F.bround("coef_t", 2).alias("coef_t"),
        F.bround("coef_month", 2).alias("coef_month"),
        *[F.bround(f"coef_{f}", 4).alias(f"coef_{f}") for f in ("lag_1", "lag_12", "ma_3")],
    )


@metric("order_date", "sales", "profit", summed=True)
def forecast_check(df: DataFrame, ahead: int = 6) -> DataFrame:
    """Per target: whether the residuals are orthogonal to every feature, and
    how many future months there are.

    Orthogonality is what makes a fit a least-squares one; sums of products
    are compared with the sums of their absolute values.
    """
    rows = long_series(m.monthly_totals(df, TARGETS))
    train = rows.filter(F.col("lag_12").isNotNull()).join(fitted(rows, ["series"]), "series")
    missed = train.withColumn("_miss", F.col("value") - prediction({f: F.col(f) for f in FEATURES}))
    orthogonal = F.lit(True)
    for f in (None, *FEATURES):
        term = F.col("_miss") if f is None else F.col("_miss") * F.col(f)
        orthogonal = orthogonal & (F.abs(F.sum(term)) <= 1e-6 * F.sum(F.abs(term)))
    checked = missed.groupBy("series").agg(orthogonal.alias("orthogonal"), F.count(F.lit(1)).alias("months_used"))
    future = points(m.monthly_totals(df, TARGETS), ahead).groupBy("series").agg(
        F.count("value").alias("months_ahead"), F.min(m.MONTH).alias("first_month"), F.max(m.MONTH).alias("last_month")
    )
    return checked.join(future, "series")
