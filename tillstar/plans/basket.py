"""Association rules between the item kinds bought in one order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import metric
from tillstar.session import settle

MIN_SUPPORT, MIN_LIFT, TOP = 0.008, 1.0, 20
NO_RULES = "No se encontraron reglas con los parámetros actuales."  # fixed value


def baskets(df: DataFrame, item: str = "sub_category") -> DataFrame:
    """The distinct items of each order.

    ``collect_set`` keeps distinct items only, already on the map side: even an
    order with a large part of all lines stays as small as the item list.
    """
    bought = df.filter(F.col("order_id").isNotNull() & F.col(item).isNotNull())
    return bought.groupBy("order_id").agg(F.array_sort(F.collect_set(item)).alias("items"))


@metric("order_id", "sub_category")
def basket_items(df: DataFrame, item: str = "sub_category") -> DataFrame:
    return baskets(df, item).select(
        "order_id", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ", ").alias("items")
    )


@dataclass(frozen=True)
class Rules:
    rules: DataFrame
    orders: int
    message: str | None


def association_rules(
    df: DataFrame,
    item: str = "sub_category",
    min_support: float = MIN_SUPPORT,
    min_lift: float = MIN_LIFT,
    top: int | None = TOP,
) -> Rules:
    """Rules with any split of a frequent set, best lift first.

    ``FPGrowth`` finds the frequent sets; its own rules have one item on the
    right only, so the splits are formed here and joined with the supports.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must lie in (0, 1]")
    orders = settle(baskets(df, item), "baskets")
    count = orders.count()
    if count == 0:
        return Rules(_empty(df, top), 0, NO_RULES)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(orders)
    sets = settle(
        model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint").alias("freq")),
        "itemsets",
    )
    if sets.isEmpty():
        return Rules(_empty(df, top), count, NO_RULES)
    rules = _split(sets, count).filter(F.col("lift") >= min_lift)
    order = [F.desc("lift"), F.desc("support"), "antecedents", "consequents"]
    if top is not None:
        rules = settle(rules, "rules")
        total = rules.count()
        rules = rules.orderBy(*order).limit(top).withColumn("total_rules", F.lit(total).cast("bigint"))
        rules = rules.withColumn("shown_rules", F.lit(min(top, total)).cast("bigint"))
    return Rules(rules.withColumn("lift_band", n.lift_band(F.col("lift"))), count, None)


def _split(sets: DataFrame, count: int) -> DataFrame:
    """Every proper non-empty split of each set, with support, confidence and lift.

    Every subset of a frequent set is frequent, so a set's left sides are the
    frequent sets within it. They are reached by taking out one item at a time:
    no row lists more than the items of its set.
    """
    left = sets.select("items", "freq", F.col("items").alias("left"))
    largest = sets.agg(F.max(F.size("items"))).first()[0]
    split = None
    for _ in range(largest - 1):
        left = (
            left.withColumn("out", F.explode("left"))
            .withColumn("left", F.array_except("left", F.array("out")))
            .filter(F.size("left") > 0)
            .drop("out")
            .distinct()
        )
        split = left if split is None else split.unionByName(left)
    if split is None:
        split = left.limit(0)
    split = split.select("freq", "left", F.array_except("items", "left").alias("right"))
    left = sets.select(F.col("items").alias("left"), F.col("freq").alias("left_freq"))
    right = sets.select(F.col("items").alias("right"), F.col("freq").alias("right_freq"))
    both = split.join(left, "left").join(right, "right")
    total = F.lit(float(count))
    freq, a, c = (F.col(x).cast("double") for x in ("freq", "left_freq", "right_freq"))
    return both.select(
        F.array_join("left", ", ").alias("antecedents"),
        F.array_join("right", ", ").alias("consequents"),
        (freq / total).alias("support"),
        (freq / a).alias("confidence"),
        ((freq / total) / ((a / total) * (c / total))).alias("lift"),
    )


def _empty(df: DataFrame, top: int | None) -> DataFrame:
    schema = "antecedents string, consequents string, support double, confidence double, lift double"
    counts = "" if top is None else ", total_rules bigint, shown_rules bigint"
    return df.sparkSession.createDataFrame([], f"{schema}{counts}, lift_band string")
