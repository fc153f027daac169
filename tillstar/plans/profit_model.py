"""Linear model of line profit on price, discount, quantity and five categories.

One pass over the lines adds up the products of every two terms, exactly, into
a sparse Gram matrix of (term, term, sum) rows; conjugate gradients on these
rows give the least-squares weights, to the same bits however the lines are
partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import metric
from tillstar.session import discard, settle

CATEGORIES = ("category", "region", "segment", "ship_mode", "month")
NUMBERS = ("sales", "discount", "quantity")
# rows of the Gram matrix up to which the driver holds it; beyond, it stays a frame
DRIVER_ENTRIES = 1_000_000
# bits of a product that are added up together, of half a factor, and the units of the sums
PART_BITS, LOW_HALF, UNITS = 30, (1 << 20) - 1, 10**8
# combinations of levels that a task holds, and lines that it adds up at a time
MOST_COMBINATIONS = 100_000
LINES_AT_A_TIME = 1 << 18
# levels of a category up to which their weights are broadcast
BROADCAST_LEVELS = 100_000
# relative residual at which the solver stops, and how often it starts anew from it
TOLERANCE, REFINEMENTS = 1e-15, 3


@dataclass(frozen=True)
class ProfitModel:
    """Coefficients with every level of every category, centred per category."""

    intercept: float
    numbers: Mapping[str, float]
    levels: Mapping[str, Mapping[str, float]]
    r2: float

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """Add the prediction; an unknown level contributes nothing."""
        value = F.lit(self.intercept)
        for column, weight in self.numbers.items():
            value = value + n.real(F.col(column)) * F.lit(weight)
        frame = rows
        for column, weights in self.levels.items():
            table = rows.sparkSession.createDataFrame(list(weights.items()), f"_{column} string, _w_{column} double")
            # a local list has no size that Spark knows: without the hint every line is shuffled by a few levels
            table = F.broadcast(table) if len(weights) <= BROADCAST_LEVELS else table
            frame = frame.join(table, F.col(column).cast("string") == F.col(f"_{column}"), "left")
            value = value + F.coalesce(f"_w_{column}", F.lit(0.0))
        helpers = [f"{p}{column}" for column in self.levels for p in ("_", "_w_")]
        return frame.withColumn(name, value).drop(*helpers)

    def score(self, scenarios: DataFrame) -> DataFrame:
        value = F.col("_value")
        return self.predict(scenarios, "_value").select(
            *scenarios.columns,
            F.bround(value, 2).alias("predicted_profit"),
            n.money(value, 2).alias("predicted_profit_fmt"),
            (value > 0).alias("is_profitable"),
            F.lit(round(self.r2, 3)).alias("model_r2"),
        )

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """All features and their coefficients, largest magnitude first."""
        rows = [(c, None, float(w)) for c, w in self.numbers.items()]
        rows += [(c, level, float(w)) for c, levels in self.levels.items() for level, w in levels.items()]
        frame = spark.createDataFrame(rows, "feature string, level string, coefficient double")
        return frame.orderBy(F.desc(F.abs("coefficient")), "feature", "level")

    def importance(self, spark: SparkSession, k: int = 10) -> DataFrame:
        named = self.coefficients(spark).limit(k)
        return named.select(
            F.concat_ws("_", "feature", "level").alias("feature"),
            F.bround("coefficient", 4).alias("coefficient"),
        )

    def info(self, spark: SparkSession) -> DataFrame:
        """R² with its verdict and the known values of every category."""
        known = {c: sorted(levels, key=int if c == "month" else str) for c, levels in self.levels.items()}
        row = (round(self.r2, 3), self.r2, *[known[c] for c in CATEGORIES])
        schema = "r2 double, _exact double, " + ", ".join(f"{c} array<string>" for c in CATEGORIES)
        frame = spark.createDataFrame([row], schema)
        return frame.select(
            "r2",
            n.pct_text(F.col("_exact") * 100).alias("r2_pct"),
            n.fit_band(F.col("_exact")).alias("fit"),
            *CATEGORIES,
        )

    def save(self, spark: SparkSession, path: str) -> None:
        extra = spark.createDataFrame(
            [("(intercept)", None, self.intercept), ("(r2)", None, self.r2)],
            "feature string, level string, coefficient double",
        )
        self.coefficients(spark).unionByName(extra).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProfitModel:
        numbers: dict[str, float] = {}
        levels: dict[str, dict[str, float]] = {c: {} for c in CATEGORIES}
        for row in spark.read.parquet(path).collect():  # one row per coefficient
            if row["level"] is None:
                numbers[row["feature"]] = row["coefficient"]
            else:
                levels[row["feature"]][row["level"]] = row["coefficient"]
        return cls(numbers.pop("(intercept)"), {c: numbers[c] for c in NUMBERS}, levels, numbers.pop("(r2)"))


def training_rows(df: DataFrame) -> DataFrame:
    return df.select(
        *[n.real(F.col(c)).alias(c) for c in NUMBERS],
        *[F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in CATEGORIES if c != "month"],
        F.month("order_date").cast("string").alias("month"),
        n.real(F.col("profit")).alias("profit"),
    )


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``LINES_AT_A_TIME`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= LINES_AT_A_TIME:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _add_up(n_keys: int, products: Sequence[tuple[str, str]], numbers: Sequence[str], parts: Sequence[str]):
    """Sums of products per combination of the first ``n_keys`` columns, exactly.

    A product has up to 80 bits. It is formed from halves of its factors and
    kept in three parts of ``PART_BITS`` bits, whose sums over a task fit 64
    bits. A task reports one row per combination, or several if it meets very
    many combinations.
    """
    half = 20

    def split(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        # x = x1 * 2^20 + x0; the low halves are never negative
        x1, x0, y1, y0 = x >> half, x & LOW_HALF, y >> half, y & LOW_HALF
        low, middle, high = x0 * y0, x1 * y0 + x0 * y1, x1 * y1
        middle += low >> half
        high += middle >> half
        low = (low & LOW_HALF) | ((middle & LOW_HALF) << half)  # 40 bits
        # 80 bits from the top: high, then low
        mask = (1 << PART_BITS) - 1
        second = (low >> PART_BITS) | ((high & ((1 << (2 * PART_BITS - 2 * half)) - 1)) << (2 * half - PART_BITS))
        return [low & mask, second, high >> (2 * PART_BITS - 2 * half)]

    def run(batches):
        index: dict[tuple, int] = {}
        totals = np.zeros((0, len(parts)), dtype=np.int64)

        def report():
            keys = [pa.array(column, pa.string()) for column in zip(*index)]
            return pa.RecordBatch.from_arrays([*keys, *[pa.array(c) for c in totals[: len(index)].T]], [*CATEGORIES, *parts])

        for batch in _gathered(batches):
            coded = [c.dictionary_encode() for c in batch.columns[:n_keys]]
            number, codes = np.zeros(len(batch), dtype=np.int64), 1
            for c in coded:
                levels = max(len(c.dictionary), 1)
                if codes * levels >= 1 << 62:  # numbered anew, or the codes would run over
                    number, codes = np.unique(number, return_inverse=True)[1].astype(np.int64), len(batch)
                number, codes = number * levels + c.indices.to_numpy(), codes * levels
            _, first, group = np.unique(number, return_index=True, return_inverse=True)
            names = zip(*(c.dictionary.take(c.indices.take(pa.array(first))).to_pylist() for c in coded))
            place = np.array([index.setdefault(key, len(index)) for key in names], dtype=np.int64)
            if len(index) > len(totals):
                totals = np.concatenate([totals, np.zeros((max(len(index), 2 * len(totals)) - len(totals), len(parts)), dtype=np.int64)])
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(len(place)))
            values = {name: batch.column(n_keys + i).to_numpy()[order] for i, name in enumerate(numbers)}
            for i, (a, b) in enumerate(products):
                for part, piece in enumerate(split(values[a], values[b])):
                    if len(piece):
                        totals[place, part * len(products) + i] += np.add.reduceat(piece, starts)
            if len(index) > MOST_COMBINATIONS:
                yield report()
                index, totals = {}, np.zeros((0, len(parts)), dtype=np.int64)
        if index:
            yield report()

    return run


def gram_matrix(df: DataFrame) -> DataFrame:
    """f, l, g, m, total: the exact sum over all lines of the product of term
    (f, l) and term (g, m), in units of 1e-8.

    Terms are the constant ("one"), the numbers, the profit and the levels of
    the categories; only pairs that occur together have a row. Lines without a
    number or a profit are left out. Lines are first added up per combination
    of levels, on the map side as well, so products are formed for these only.
    """
    numbers = ("one", *NUMBERS, "profit")
    rows = df.dropna(subset=[*NUMBERS, "profit"]).select(
        F.lit(10_000).cast("bigint").alias("one"),
        # four decimals as whole numbers; a double holds them exactly
        *[F.rint(n.real(F.col(c)) * 10_000).cast("bigint").alias(c) for c in (*NUMBERS, "profit")],
        *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in CATEGORIES if c != "month"],
        F.month("order_date").cast("string").alias("month"),
    )
    products = list(combinations_with_replacement(numbers, 2))
    parts = [f"{part}{a}*{b}" for part in range(3) for a, b in products]
    schema = ", ".join([*[f"{c} string" for c in CATEGORIES], *[f"`{c}` bigint" for c in parts]])
    added = rows.select(*CATEGORIES, *numbers).mapInArrow(_add_up(len(CATEGORIES), products, numbers, parts), schema)
    cells = added.groupBy(*CATEGORIES).agg(*[F.sum(F.col(f"`{c}`").cast("decimal(24,0)")).alias(c) for c in parts])

    def entry(f: str, l, g: str, m, product: str):  # noqa: E741
        none = F.lit(None).cast("string")
        level = lambda c: none if c is None else F.col(c)
        whole = [F.col(f"`{i}{product}`").cast("decimal(24,0)") for i in range(3)]
        total = sum((x * F.lit(1 << (PART_BITS * i)).cast("decimal(19,0)") for i, x in enumerate(whole) if i), whole[0].cast("decimal(37,0)"))
        return F.struct(F.lit(f).alias("f"), level(l).alias("l"), F.lit(g).alias("g"), level(m).alias("m"), total.alias("total"))

    entries = [entry(a, None, b, None, f"{a}*{b}") for a, b in products]
    entries += [entry(a, None, c, c, f"one*{a}") for c in CATEGORIES for a in numbers]
    entries += [entry(c, c, d, d, "one*one") for c, d in combinations(CATEGORIES, 2)]
    # one row per combination of levels: written out, so that it is made once for all entries
    made = settle(cells, "gram-cells")
    return made.select(F.inline(F.array(*entries))).groupBy("f", "l", "g", "m").agg(F.sum("total").alias("total"))


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray) -> np.ndarray:
    """The solution of smallest norm of ``times(x) = b`` for a semi-definite map."""
    x, residual = np.zeros_like(b), b.copy()
    for _ in range(REFINEMENTS):  # rounding builds up in the residual: start anew from the true one
        step, r, p = np.zeros_like(b), residual.copy(), residual.copy()
        norm = r @ r
        for _ in range(4 * len(b) + 10):
            if norm <= (TOLERANCE**2) * (b @ b):
                break
            image = times(p)
            curvature = p @ image
            if curvature <= 0:
                break
            step += (norm / curvature) * p
            r -= (norm / curvature) * image
            norm, before = r @ r, norm
            p = r + (norm / before) * p
        x = x + step
        residual = b - times(x)
    return x


@metric("sales", "discount", "quantity", "category", "region", "segment", "ship_mode", "order_date", "profit")
def fit(df: DataFrame) -> ProfitModel:
    """Least squares with every level of every category, in minimum-norm form.

    The driver holds one number per term, and the matrix while that is of a
    checked size. Terms are centred, so the constant drops out, and numbers are
    scaled to the spread of a level; weights of a category have a mean of zero.
    """
    gram = settle(gram_matrix(df), "gram")
    sums = {(r.f, r.l): r.total for r in gram.filter("f = 'one'").select(F.col("g").alias("f"), F.col("m").alias("l"), "total").collect()}
    sums = {t: Fraction(total) / UNITS for t, total in sums.items()}
    lines = sums.get(("one", None), Fraction(0))
    if not lines:
        raise ValueError("no line has all numbers and a profit")
    names = {c: sorted(level for f, level in sums if f == c) for c in CATEGORIES}
    terms = [(c, None) for c in NUMBERS] + [(c, level) for c in CATEGORIES for level in names[c]]
    index = {t: i for i, t in enumerate(terms)}
    mean = np.array([float(sums[t] / lines) for t in terms])

    def centred(f, l, g, m, total) -> float:  # noqa: E741
        return float(Fraction(total) / UNITS - sums[f, l] * sums[g, m] / lines)

    profit_mean = float(sums["profit", None] / lines)
    of_profit, variance, spread = np.zeros(len(terms)), 0.0, np.ones(len(terms))
    # rows with a number: a few per term; their centring cancels, so it is exact
    numeric = np.zeros((len(NUMBERS), len(terms)))
    for row in gram.filter(F.col("f").isin(*NUMBERS, "profit")).collect():
        value, (f, g) = centred(*row), ((row.f, row.l), (row.g, row.m))
        if f == g == ("profit", None):
            variance = value
        elif ("profit", None) in (f, g):
            of_profit[index[g if f == ("profit", None) else f]] = value
        else:
            numeric[index[f], index[g]] = value
            if g in index and index[g] < len(NUMBERS):
                numeric[index[g], index[f]] = value
    k = len(NUMBERS)
    level_counts = np.array([float(sums[t]) for t in terms])
    for i in range(k):  # numbers spread like an average level
        spread[i] = (float(level_counts[k:].mean()) / (numeric[i, i] or 1.0)) ** 0.5
    numeric = numeric * spread[:k, None] * spread
    pairs = gram.filter(F.col("l").isNotNull() & F.col("m").isNotNull())
    among_levels = _on_driver(pairs, index) if gram.count() <= DRIVER_ENTRIES else _as_frame(pairs, index)

    def times(x: np.ndarray) -> np.ndarray:
        y, levels = np.zeros(len(terms)), x.copy()
        levels[:k] = 0
        y[k:] = (among_levels(levels) + level_counts * levels - level_counts * ((level_counts @ levels) / float(lines)))[k:]
        y[:k] = numeric @ x
        y[k:] += numeric[:, k:].T @ x[:k]
        return y

    scaled = conjugate_gradients(times, of_profit * spread)
    explained = 2 * scaled @ (of_profit * spread) - scaled @ times(scaled)
    weights = scaled * spread
    intercept = profit_mean - float(mean @ weights)
    numbers = {c: float(weights[i]) for i, c in enumerate(NUMBERS)}
    levels = {}
    for column in CATEGORIES:
        own = {name: float(weights[index[column, name]]) for name in names[column]}
        middle = sum(own.values()) / len(own)
        intercept += middle
        levels[column] = {name: w - middle for name, w in own.items()}
    discard(gram)
    return ProfitModel(intercept, numbers, levels, float(explained / variance) if variance else 1.0)


def _on_driver(pairs: DataFrame, index: Mapping[tuple, int]) -> Callable[[np.ndarray], np.ndarray]:
    """Product with the counts of pairs of levels of two categories; rows in one order."""
    rows = sorted((index[r.f, r.l], index[r.g, r.m], float(Fraction(r.total) / UNITS)) for r in pairs.collect())
    i, j, v = (np.array([r[x] for r in rows], dtype=kind) for x, kind in ((0, int), (1, int), (2, float)))
    size = len(index)
    return lambda x: np.bincount(i, v * x[j], size) + np.bincount(j, v * x[i], size)


def _as_frame(pairs: DataFrame, index: Mapping[tuple, int]) -> Callable[[np.ndarray], np.ndarray]:
    """The same over a matrix of any size; only vectors come to the driver."""
    spark = pairs.sparkSession
    terms = list(index)

    def times(x: np.ndarray) -> np.ndarray:
        scale = float(np.abs(x).max()) or 1.0
        vector = spark.createDataFrame([(f, level, float(v / scale)) for (f, level), v in zip(terms, x)], "f string, l string, x double")
        both = pairs.select("f", "l", "g", "m", "total").unionByName(pairs.select(F.col("g").alias("f"), F.col("m").alias("l"), F.col("f").alias("g"), F.col("l").alias("m"), "total"))
        seen = both.join(vector.select(F.col("f").alias("g"), F.col("l").alias("m"), "x"), ["g", "m"])
        # decimals, so that the sum does not depend on the order of rows
        product = (F.col("total").cast("double") / UNITS * F.col("x")).cast("decimal(38,18)")
        y = np.zeros(len(terms))
        for r in seen.groupBy("f", "l").agg(F.sum(product).cast("double").alias("y")).collect():
            y[index[r.f, r.l]] = r.y * scale
        return y

    return times


def check(model: ProfitModel, rows: DataFrame) -> DataFrame:
    """Per term of the model whether its residuals are orthogonal to it, which
    makes the fit one of least squares, with its number of lines.

    Sums of products are compared with the sums of their absolute values. Lines
    are added up per combination of levels first; only sums are split by term.
    """
    missed = model.predict(rows, "_value").withColumn("_miss", F.col("profit") - F.col("_value"))
    products = {"_miss": F.col("_miss"), **{c: F.col("_miss") * F.col(c) for c in NUMBERS}}
    sums = missed.groupBy(*CATEGORIES).agg(
        F.count(F.lit(1)).alias("_lines"),
        *[F.sum(product).alias(f"_sum_{c}") for c, product in products.items()],
        *[F.sum(F.abs(product)).alias(f"_size_{c}") for c, product in products.items()],
    )

    def term(feature: str, level, product: str):
        values = {"feature": F.lit(feature), "level": level, "total": F.col(f"_sum_{product}"), "size": F.col(f"_size_{product}"), "lines": F.col("_lines")}
        return F.struct(*[value.alias(name) for name, value in values.items()])

    terms = [*[term(c, F.lit(None).cast("string"), c) for c in NUMBERS], *[term(c, F.col(c), "_miss") for c in CATEGORIES]]
    return sums.select(F.inline(F.array(*terms))).groupBy("feature", "level").agg(
        (F.abs(F.sum("total")) <= 1e-9 * F.sum("size")).alias("orthogonal"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    )


def scenario_grid(spark: SparkSession, **choices: Sequence) -> DataFrame:
    """Every combination of the given values, one column per argument."""
    frame = spark.range(1).drop("id")
    for column, values in choices.items():
        frame = frame.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return frame
