"""K-means segments of customers, products and profit cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import known, metric
from tillstar.session import settle

CLUSTERS = 4
SEEDS = tuple(range(42, 52))
# steps of a fit at most, and the sum of squared shifts of its centres at which it has settled
MOST_STEPS, SETTLED = 50, 1e-4
# places of points are whole numbers of these parts of a deviation
POINT_UNITS = 1_000_000

# Segment names from best to worst.
CUSTOMER_LABELS = ("VIP", "Frecuentes", "Ocasionales", "Perdidos")
PRODUCT_LABELS = ("Estrella", "Volumen", "Potencial", "Lastre")
PROFIT_LABELS = ("Alta Rentabilidad", "Rentabilidad Media", "Baja Rentabilidad", "Pérdida")


# ---- base frames --------------------------------------------------------------


@metric("customer_id", "customer_name", "segment", "order_date", "order_id", "sales", "profit", summed=True)
def rfm_base(df: DataFrame) -> DataFrame:
    """Recency, frequency and money per customer, with the first name and segment known.

    Recency counts from the day after the last order of anyone. The customers
    are written out, so that the lines are read once for this day and the sums.
    """
    # lines to orders first: a hash aggregate with a map-side combine
    orders = known(df, "customer_id").groupBy("customer_id", "customer_name", "segment", "order_id").agg(
        F.min("order_date").alias("_from"),
        F.max("order_date").alias("_to"),
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
    )
    grouped = orders.groupBy("customer_id").agg(
        *[_first_known(c, "_from", "order_id", c) for c in ("customer_name", "segment")],
        F.max("_to").alias("_last"),
        F.count_distinct("order_id").alias("frequency"),
        n.total(F.col("sales")).alias("monetary"),
        n.total(F.col("profit")).alias("profit"),
    )
    sums = settle(grouped, "customer-sums")
    newest = sums.agg(F.max("_last").alias("_newest")).withColumn("_one", F.lit(1))
    # one row, whatever the input
    people = sums.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one")
    return people.select(
        "customer_id",
        "customer_name",
        "segment",
        F.datediff(F.date_add("_newest", 1), "_last").alias("recency"),
        "frequency",
        n.real(F.col("monetary")).alias("monetary"),
        n.real(F.col("profit")).alias("profit"),
    )


@metric("product_name", "order_id", "category", "sub_category", "sales", "profit", "discount", "quantity")
def product_profile(df: DataFrame) -> DataFrame:
    sums = known(df, "product_name").groupBy("product_name").agg(
        *[_first_known(c, "order_id", c) for c in ("category", "sub_category")],
        n.total(F.col("sales")).alias("s"),
        n.total(F.col("profit")).alias("p"),
        n.ratio(F.sum("discount"), F.count("discount")).alias("discount_avg"),
        F.count_distinct("order_id").alias("order_count"),
        n.total(F.col("quantity")).alias("quantity"),
    )
    return sums.select(
        "product_name",
        "category",
        "sub_category",
        n.clip(n.real(F.col("s")), low=0.01).alias("sales"),
        n.real(F.col("p")).alias("profit"),
        "discount_avg",
        "order_count",
        "quantity",
        _margin().alias("margin"),
    )


def _first_known(column: str, *order: str):
    """The earliest value that is not null; ties fall to the smallest."""
    arrival = F.when(F.col(column).isNotNull(), F.struct(*order))
    return F.min_by(column, arrival).alias(column)


def _margin():
    return n.clip(F.coalesce(n.ratio(F.col("p"), F.col("s")) * 100, F.lit(0.0)), low=-200.0, high=200.0)


@metric("region", "category", "segment", "sales", "profit", "discount", "order_id", "quantity")
def profit_grid(df: DataFrame) -> DataFrame:
    sums = known(df, "region", "category", "segment").groupBy("region", "category", "segment").agg(
        n.total(F.col("sales")).alias("s"),
        n.total(F.col("profit")).alias("p"),
        n.ratio(F.sum("discount"), F.count("discount")).alias("discount_avg"),
        F.count_distinct("order_id").alias("order_count"),
        n.total(F.col("quantity")).alias("quantity"),
    )
    return sums.orderBy(F.desc("p"), "region", "category", "segment").select(
        "region",
        "category",
        "segment",
        n.clip(n.real(F.col("s")), low=0.01).alias("sales"),
        n.real(F.col("p")).alias("profit"),
        "discount_avg",
        "order_count",
        "quantity",
        _margin().alias("margin"),
    )


# ---- features -------------------------------------------------------------------


@dataclass(frozen=True)
class Feature:
    """A model input: clipped from below on request, ``log1p`` on request."""

    column: str
    low: float | None = None
    logged: bool = False

    def expression(self):
        value = F.coalesce(n.real(F.col(self.column)), F.lit(0.0))
        if self.low is not None:
            value = n.clip(value, low=float(self.low))
        return F.log1p(value) if self.logged else value


CUSTOMER_FEATURES = (
    Feature("recency", 1, True),
    Feature("frequency", None, True),
    Feature("monetary", 0, True),
)
PRODUCT_FEATURES = (
    Feature("sales", 0, True),
    Feature("profit", 0, True),
    Feature("discount_avg"),
    Feature("order_count", 0, True),
    Feature("margin"),
)
PROFIT_FEATURES = (Feature("profit"), Feature("margin"), Feature("discount_avg"), Feature("order_count"))


@dataclass(frozen=True)
class Scaled:
    frame: DataFrame
    names: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]


def scale(base: DataFrame, features: Sequence[Feature]) -> Scaled:
    """Add ``z_<column>``: the feature minus its mean over its population deviation.

    A constant feature is only centred. The statistics are one row of scalars.
    """
    raw = base.withColumns({f"x_{f.column}": f.expression() for f in features})
    stats = raw.agg(
        *[F.avg(f"x_{f.column}").alias(f"m_{f.column}") for f in features],
        *[F.stddev_pop(f"x_{f.column}").alias(f"s_{f.column}") for f in features],
    ).first()
    means = tuple(stats[f"m_{f.column}"] or 0.0 for f in features)
    spreads = tuple(stats[f"s_{f.column}"] or 1.0 for f in features)
    frame = raw.withColumns(
        {
            f"z_{f.column}": (F.col(f"x_{f.column}") - F.lit(m)) / F.lit(s)
            for f, m, s in zip(features, means, spreads)
        }
    ).drop(*[f"x_{f.column}" for f in features])
    return Scaled(frame, tuple(f"z_{f.column}" for f in features), means, spreads)


def rfm_features(base: DataFrame) -> DataFrame:
    return scale(base, CUSTOMER_FEATURES).frame.select(
        "customer_id",
        *[F.round(f"z_{f.column}", 6).alias(f"z_{f.column}") for f in CUSTOMER_FEATURES],
    )


# ---- clustering ------------------------------------------------------------------


@dataclass(frozen=True)
class Clustering:
    members: DataFrame  # base columns + cluster
    placed: DataFrame  # scaled columns + cluster
    centers: list[list[float]]  # in scaled space
    cost: float
    costs: list[float]  # per seed


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's columns as a matrix of whole numbers."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _gaps(places: np.ndarray, centers: list[list[list[float]]]) -> np.ndarray:
    """Squared distances, by start, row and centre.

    Added up one dimension after the other: a short last axis is slow to sum.
    """
    at = np.array(centers)  # start, centre, dimension
    gaps = np.zeros((len(at), len(places), at.shape[1]))
    for i, column in enumerate(places.T):
        apart = np.ascontiguousarray(column, dtype=float)[None, :, None] - at[:, None, :, i]
        gaps += np.square(apart, out=apart)
    return gaps


def _points(scaled: Scaled) -> DataFrame:
    """The scaled rows with ``_p<i>``, their place in whole millionths."""
    return scaled.frame.withColumns({f"_p{i}": F.rint(F.col(c) * POINT_UNITS) for i, c in enumerate(scaled.names)})


def _first_centers(points: DataFrame, size: int, k: int, seeds: Sequence[int]) -> list[list[list[float]]]:
    """``k`` rows per seed, each far from those before: chosen with a chance in
    proportion to the squared distance, by a race of seeded hashes."""
    columns = [f"_p{i}" for i in range(size)]
    centers: list[list[list[float]]] = [[] for _ in seeds]
    for nth in range(k):

        def race(batches, centers=centers, nth=nth):
            best: dict[int, tuple] = {}
            for batch in batches:
                places = _places(batch.select(columns))
                gaps = _gaps(places, centers).min(axis=2) if nth else np.ones((len(seeds), len(batch)))
                for i in range(len(seeds)):
                    chance = (batch.column(size + i).to_numpy() % (1 << 53) + 1) / float((1 << 53) + 1)
                    with np.errstate(divide="ignore"):
                        runs = -np.log(chance) / gaps[i]
                    for row in np.flatnonzero(runs == runs.min()).tolist() if len(batch) else []:
                        found = (float(runs[row]), *places[row].tolist())
                        best[i] = min(best.get(i, found), found)
            rows = [(i, r, p) for i, (r, *p) in best.items()]
            yield pa.RecordBatch.from_pylist([{"seed": i, "race": r, "place": p} for i, r, p in rows], pa.schema([("seed", pa.int32()), ("race", pa.float64()), ("place", pa.list_(pa.float64()))]))

        marks = [F.xxhash64(*columns, F.lit(int(seed)), F.lit(nth)).alias(f"_u{i}") for i, seed in enumerate(seeds)]
        runs = points.select(*columns, *marks).mapInArrow(race, "seed int, race double, place array<double>")
        won = runs.groupBy("seed").agg(F.min(F.struct("race", "place")).alias("won")).collect()
        if not won:
            raise ValueError("there are no rows to cluster")
        for row in won:  # one row per seed
            centers[row["seed"]].append(list(row["won"]["place"]))
    return centers


def _assigned(points: DataFrame, centers: list[list[list[float]]], size: int) -> DataFrame:
    """Per start and cluster: rows, exact sums of their places and of squared distances.

    A task adds up its rows in whole numbers and reports one row per centre.
    """
    columns = [f"_p{i}" for i in range(size)]
    starts, k = len(centers), len(centers[0])
    names = ["start", "cluster", "rows", "cost", *[f"s{i}" for i in range(size)]]

    def add_up(batches):
        sums = np.zeros((starts, k, 2 + size), dtype=np.int64)
        for batch in batches:
            places = _places(batch)
            whole = places.astype(np.int64)
            for i, gaps in enumerate(_gaps(places, centers)):
                nearest = gaps.argmin(axis=1)
                costs = np.rint(gaps.min(axis=1) / POINT_UNITS).astype(np.int64)
                for c in range(k):
                    own = nearest == c
                    sums[i, c] += [int(own.sum()), int(costs[own].sum()), *whole[own].sum(axis=0).tolist()]
        start, own = np.divmod(np.arange(starts * k), k)
        table = np.column_stack([start, own, sums.reshape(starts * k, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in table.T], names)

    added = points.select(*columns).mapInArrow(add_up, ", ".join(f"{name} bigint" for name in names))
    return added.filter("rows > 0").groupBy("start", "cluster").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names[2:]])


def cluster(scaled: Scaled, k: int = CLUSTERS, seeds: Sequence[int] = SEEDS) -> Clustering:
    """K-means from several seeds, keeping the one of lowest cost.

    The centres of all seeds move in one aggregation per step, so a step reads
    the rows once. Places are whole millionths and sums exact: the result does
    not depend on how the rows are partitioned. The driver holds the centres.
    """
    points = settle(_points(scaled), "points")
    size, moving = len(scaled.names), list(range(len(seeds)))
    centers = _first_centers(points, size, k, seeds)
    for _ in range(MOST_STEPS):
        moved = {i: [list(c) for c in centers[i]] for i in moving}
        for row in _assigned(points, [centers[i] for i in moving], size).collect():  # k rows per seed
            moved[moving[row["start"]]][row["cluster"]] = [float(Fraction(row[f"s{i}"]) / Fraction(row["rows"])) for i in range(size)]
        shifts = {i: sum(math.dist(a, b) ** 2 for a, b in zip(centers[i], moved[i])) / POINT_UNITS**2 for i in moving}
        for i in moving:
            centers[i] = moved[i]
        moving = [i for i in moving if shifts[i] > SETTLED]
        if not moving:
            break
    costs = [0.0] * len(seeds)
    for row in _assigned(points, centers, size).collect():
        costs[row["start"]] += float(row["cost"]) / POINT_UNITS
    best = costs.index(min(costs))
    gaps = [sum(((F.col(f"_p{i}") - F.lit(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0)) for c in centers[best]]
    least = F.least(*gaps) if k > 1 else gaps[0]
    number = F.coalesce(*[F.when(gap == least, F.lit(i)) for i, gap in enumerate(gaps)])
    placed = points.withColumn("cluster", number).drop(*[f"_p{i}" for i in range(size)])
    natural = [[v / POINT_UNITS for v in c] for c in centers[best]]
    return Clustering(placed.drop(*scaled.names), placed.select("cluster", *scaled.names), natural, costs[best], costs)


def natural_centers(
    result: Clustering, scaled: Scaled, features: Sequence[Feature], ranking: str = "default"
) -> list[list[float]]:
    """Centres in the units of the base frame.

    ``default`` undoes the scaling and then the logarithm, where one was taken;
    ``reference`` applies expm1 to every scaled value first and unscales after.
    """

    def one(value: float, mean: float, spread: float, feature: Feature) -> float:
        if ranking == "reference":
            return math.expm1(value) * spread + mean
        unscaled = value * spread + mean
        return math.expm1(unscaled) if feature.logged else unscaled

    return [
        [one(v, m, s, f) for v, m, s, f in zip(center, scaled.means, scaled.spreads, features)]
        for center in result.centers
    ]


def _labelled(profile: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rank the k clusters of a profile by descending score and name them."""
    best_first = Window.orderBy(F.desc("score"), "cluster")
    ranked = profile.withColumn("rank", F.row_number().over(best_first))
    names = F.array(*[F.lit(label) for label in labels])
    fallback = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return ranked.withColumn("label", F.coalesce(F.try_element_at(names, F.col("rank")), fallback))


def _score_by_center(values: Sequence[float]):
    score = F.lit(None).cast("double")
    for i, value in enumerate(values):
        score = F.when(F.col("cluster") == i, F.lit(float(value))).otherwise(score)
    return score


@dataclass(frozen=True)
class Segments:
    members: DataFrame
    profile: DataFrame
    clustering: Clustering


def _segments(
    base: DataFrame,  # read several times: pass a frame that is written out
    features: Sequence[Feature],
    labels: Sequence[str],
    profile_columns: Sequence,
    score: Callable[[list[float]], float] | None,
    ranking: str,
    seeds: Sequence[int],
) -> Segments:
    scaled = scale(base, features)
    result = cluster(scaled, len(labels), seeds)
    members = result.members
    profile = members.groupBy("cluster").agg(*profile_columns)
    if score is None:
        profile = profile.withColumn("score", F.col("avg_profit"))
    else:
        centers = natural_centers(result, scaled, features, ranking)
        profile = profile.withColumn("score", _score_by_center([score(c) for c in centers]))
    profile = _labelled(profile, labels)
    names = profile.select("cluster", F.col("label").alias("cluster_label"), F.col("rank").alias("cluster_rank"))
    # k rows
    return Segments(members.join(F.broadcast(names), "cluster"), profile, result)


def check(found: Segments) -> DataFrame:
    """One row: members and labels, and whether each member is nearest to its
    own centre, ranks follow scores and the fit is the best of its seeds."""
    result = found.clustering
    names = [c for c in result.placed.columns if c != "cluster"]
    distances = [sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(names, center)), F.lit(0.0)) for center in result.centers]
    own = F.element_at(F.array(*distances), F.col("cluster") + 1)
    near = result.placed.agg(F.count(F.lit(1)).alias("members"), F.bool_and(own <= F.array_min(F.array(*distances)) + 1e-4).alias("all_nearest"))
    # k rows
    falling = F.col("score") <= F.coalesce(F.lag("score").over(Window.orderBy("rank")), F.lit(math.inf))
    order = found.profile.withColumn("_falling", falling).agg(
        F.bool_and("_falling").alias("rank_follows_score"), F.count_distinct("label").alias("labels")
    )
    one = F.lit(1)
    return (
        near.withColumn("_one", one)
        .join(order.withColumn("_one", one), "_one")
        .drop("_one")
        .withColumn("cost_is_least", F.lit(result.cost <= min(result.costs)))
    )


def _mean(column: str, digits: int, name: str):
    return F.bround(F.avg(column), digits).alias(name)


def segment_customers(base: DataFrame, ranking: str = "default", seeds: Sequence[int] = SEEDS) -> Segments:
    """Customers by recency, frequency and money; best is frequent, large and recent."""
    return _segments(
        settle(base, "customers"),
        CUSTOMER_FEATURES,
        CUSTOMER_LABELS,
        [
            F.count(F.lit(1)).alias("customers"),
            F.bround(F.avg("recency"), 0).cast("int").alias("avg_recency_days"),
            _mean("frequency", 1, "avg_frequency"),
            _mean("monetary", 2, "avg_monetary"),
            n.money(F.avg("monetary")).alias("avg_monetary_fmt"),
            F.bround(F.sum("profit"), 2).alias("total_profit"),
            n.money(F.sum("profit")).alias("total_profit_fmt"),
        ],
        lambda c: c[1] * c[2] / (c[0] + 1),
        ranking,
        seeds,
    )


def segment_products(base: DataFrame, ranking: str = "default", seeds: Sequence[int] = SEEDS) -> Segments:
    """Products by volume and profitability."""
    return _segments(
        settle(base, "products"),
        PRODUCT_FEATURES,
        PRODUCT_LABELS,
        [
            F.count(F.lit(1)).alias("products"),
            _mean("sales", 2, "avg_sales"),
            n.money(F.avg("sales")).alias("avg_sales_fmt"),
            _mean("profit", 2, "avg_profit"),
            n.money(F.avg("profit")).alias("avg_profit_fmt"),
            _mean("margin", 1, "avg_margin_pct"),
            F.bround(F.avg("discount_avg") * 100, 1).alias("avg_discount_pct"),
        ],
        lambda c: c[0] * (c[1] + 100),
        ranking,
        seeds,
    )


def segment_profitability(base: DataFrame, seeds: Sequence[int] = SEEDS) -> Segments:
    """Region × category × segment cells, ranked by their mean profit."""
    return _segments(
        settle(base, "grid"),
        PROFIT_FEATURES,
        PROFIT_LABELS,
        [
            F.count(F.lit(1)).alias("cells"),
            F.avg("profit").alias("avg_profit"),
            n.money(F.avg("profit")).alias("avg_profit_fmt"),
            _mean("margin", 1, "avg_margin_pct"),
            F.bround(F.avg("discount_avg") * 100, 1).alias("avg_discount_pct"),
        ],
        None,
        "default",
        seeds,
    )
