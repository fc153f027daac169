from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from lines import Flat, lines, random_lines
from pyspark.sql import functions as F

from tillstar.operators.metric import compute
from tillstar.plans import basket, forecast, profit_model, segments
from tillstar.session import settle


# ---- association rules -----------------------------------------------------------


def brute_force(orders, min_support, min_lift):
    total = len(orders)
    items = sorted(set().union(*orders))
    support = {}
    for size in range(1, len(items) + 1):
        for group in itertools.combinations(items, size):
            hits = sum(set(group) <= o for o in orders)
            if hits / total >= min_support and hits:
                support[group] = hits / total
    rules = {}
    for group, s in support.items():
        for size in range(1, len(group)):
            for left in itertools.combinations(group, size):
                right = tuple(i for i in group if i not in left)
                lift = s / (support[left] * support[right])
                if lift >= min_lift:
                    rules[(", ".join(left), ", ".join(right))] = (s, s / support[left], lift)
    return rules


def test_rules_match_brute_force(spark):
    orders = [{"a", "b", "c"}, {"a", "b"}, {"a", "c"}, {"b", "c", "d"}, {"a", "b", "c", "d"}, {"d"}]
    frame = lines(
        spark,
        *[{"order_id": f"o{i}", "sub_category": item} for i, o in enumerate(orders) for item in sorted(o) * 2],
    )
    found = basket.association_rules(frame, min_support=0.3, top=None)
    expected = brute_force(orders, 0.3, 1.0)
    got = {(r["antecedents"], r["consequents"]): (r["support"], r["confidence"], r["lift"]) for r in found.rules.collect()}
    assert got.keys() == expected.keys() and len(got) > 4
    for key, values in got.items():
        assert values == pytest.approx(expected[key])
    top = basket.association_rules(frame, min_support=0.3, top=2).rules.collect()
    assert len(top) == 2 and top[0]["total_rules"] == len(expected) and top[0]["lift"] >= top[1]["lift"]


def test_rules_without_result(spark):
    empty = basket.association_rules(lines(spark, {}).limit(0))
    assert empty.message == basket.NO_RULES and empty.rules.count() == 0
    assert empty.rules.columns[-3:] == ["total_rules", "shown_rules", "lift_band"]
    with pytest.raises(ValueError, match="min_support"):
        basket.association_rules(lines(spark, {}), min_support=1.5)


# ---- forecast -----------------------------------------------------------------------


def series_frame(count, seed=5):
    rng = random.Random(seed)
    ends = pd.date_range("2014-01-31", periods=count, freq="ME")
    return ends, [1000 + 10 * i + 100 * math.sin(i) + rng.uniform(-50, 50) for i in range(count)]


def stepwise(ends, values, ahead):
    """The same rules written with plain loops."""
    n = len(values)
    x = [
        [i, ends[i].month, values[max(i - 1, 0)], values[i - 12] if i >= 12 else values[0], np.mean(values[max(0, i - 2) : i + 1])]
        for i in range(n)
    ]
    design = np.column_stack([np.array(x, float), np.ones(n)])
    weights = np.linalg.lstsq(design, np.array(values), rcond=None)[0]
    out = []
    for step in range(ahead):
        month = (ends[-1].month + step) % 12 + 1
        back = n - 12 + step
        lag_12 = values[back] if back < n else np.mean(values)
        recent = out[-3:] or values[-3:]
        out.append(round(float(np.array([n + step, month, out[-1] if out else values[-1], lag_12, np.mean(recent), 1]) @ weights), 2))
    return out, weights, design @ weights


def test_forecast_follows_the_stepwise_rules(spark):
    ends, values = series_frame(30)
    frame = lines(
        spark,
        *[{"order_date": e.date().replace(day=3), "sales": round(v, 4), "profit": round(v / 7, 4)} for e, v in zip(ends, values)],
    )
    rounded = [round(v, 4) for v in values]
    expected, weights, fitted = stepwise(ends, rounded, 15)
    got = forecast.forecast(frame, ahead=15).orderBy("date").collect()
    assert [r["is_forecast"] for r in got] == [False] * 30 + [True] * 15
    assert [r["sales"] for r in got[30:]] == pytest.approx(expected, abs=0.05)
    assert got[30]["date"] == "2016-07-31" and got[30]["date_label"] == "Jul 2016"
    metrics = {r["series"]: r for r in forecast.forecast_metrics(frame).collect()}
    miss = np.array(rounded) - fitted
    assert metrics["sales"]["mae"] == pytest.approx(np.abs(miss).mean(), abs=0.01)
    assert metrics["sales"]["rmse"] == pytest.approx(np.sqrt((miss**2).mean()), abs=0.01)
    assert metrics["sales"]["mape"] == pytest.approx(np.abs(miss / np.array(rounded)).mean() * 100, abs=0.051)
    assert metrics["sales"]["r2"] == pytest.approx(1 - (miss**2).sum() / ((rounded - np.mean(rounded)) ** 2).sum(), abs=0.001)
    assert metrics["sales"]["coef_lag_12"] == pytest.approx(weights[3], abs=1e-3)
    assert metrics["profit"]["total_months"] == 30


def test_forecast_limits(spark):
    ends, values = series_frame(12)
    frame = lines(spark, *[{"order_date": e.date(), "sales": round(v, 2)} for e, v in zip(ends, values)])
    with pytest.raises(Exception, match="more than 12 are needed"):
        forecast.forecast(frame).collect()
    with pytest.raises(ValueError, match="month ahead"):
        forecast.forecast(frame, ahead=0)


def test_clamped_forecast_of_many_series(spark):
    ends = pd.date_range("2014-01-31", periods=20, freq="ME")
    rows = [
        {"region": region, "order_date": e.date(), "sales": round(slope * i + 2000, 2), "profit": 1.0}
        for region, slope in (("falling", -120.0), ("rising", 50.0))
        for i, e in enumerate(ends)
    ]
    frame = lines(spark, *rows)
    series = forecast.m.monthly_totals(frame, forecast.TARGETS, partition_by=["region"])

    def lowest(clamp):
        found = forecast.points(series, 30, clamp, ["region"]).filter("series = 'sales'")
        return {r["region"]: r["v"] for r in found.groupBy("region").agg(F.min("value").alias("v")).collect()}

    free, clamped = lowest(False), lowest(True)
    assert free["falling"] < 0 and clamped["falling"] == 0 and free["rising"] == clamped["rising"] > 2900


# ---- profit model -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark):
    book = random_lines(spark).persist()
    return book, compute(profit_model.fit, Flat(book))


def test_profit_model_is_the_minimum_norm_solution(spark, fitted):
    book, model = fitted
    rows = profit_model.training_rows(book).toPandas()
    hot = pd.get_dummies(rows[list(profit_model.CATEGORIES)], prefix_sep="=").astype(float)
    x = pd.concat([rows[list(profit_model.NUMBERS)].astype(float), hot], axis=1)
    y = rows["profit"].to_numpy()
    centred = x - x.mean()
    weights = dict(zip(x.columns, np.linalg.lstsq(centred.to_numpy(), y - y.mean(), rcond=None)[0]))
    for column in profit_model.NUMBERS:
        assert model.numbers[column] == pytest.approx(weights[column], abs=1e-4)
    for column, levels in model.levels.items():
        assert sum(levels.values()) == pytest.approx(0, abs=1e-9)
        for level, weight in levels.items():
            assert weight == pytest.approx(weights[f"{column}={level}"], abs=1e-4)
    predicted = centred.to_numpy() @ np.array(list(weights.values())) + y.mean()
    assert model.r2 == pytest.approx(1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    scored = model.predict(profit_model.training_rows(book), "p").toPandas()["p"].to_numpy()
    assert np.abs(np.sort(scored) - np.sort(predicted)).max() < 1e-4
    assert all(r["orthogonal"] for r in profit_model.check(model, profit_model.training_rows(book)).collect())


def test_profit_scores_and_unseen_levels(spark, fitted):
    _, model = fitted
    grid = profit_model.scenario_grid(
        spark, sales=[500.0], discount=[0.1], quantity=[2], category=["Technology", "Unseen"], region=["West"],
        segment=["Consumer"], ship_mode=["First"], month=[7],
    )
    scores = {r["category"]: r for r in model.score(grid).collect()}
    gap = scores["Technology"]["predicted_profit"] - scores["Unseen"]["predicted_profit"]
    assert gap == pytest.approx(model.levels["category"]["Technology"], abs=0.011)
    assert all(r["is_profitable"] == (r["predicted_profit"] > 0) for r in scores.values())


def test_profit_model_info_and_storage(spark, fitted, tmp_path):
    _, model = fitted
    info = model.info(spark).first()
    assert info["month"] == [str(m) for m in range(1, 13)] and info["fit"] in ("bajo", "moderado", "bueno")
    assert model.importance(spark).count() == 10
    model.save(spark, str(tmp_path / "model"))
    assert profit_model.ProfitModel.load(spark, str(tmp_path / "model")) == model


# ---- segments ---------------------------------------------------------------------------------


def blobs(spark):
    rng = random.Random(2)
    kinds = {"VIP": (2, 60, 9000), "Frecuentes": (30, 25, 2500), "Ocasionales": (120, 6, 500), "Perdidos": (900, 1, 40)}
    rows = []
    for label, (recency, frequency, monetary) in kinds.items():
        for i in range(25):
            rows.append((f"{label}{i}", label, "x", recency + rng.randrange(2), frequency, monetary * rng.uniform(0.95, 1.05), 1.0))
    schema = "customer_id string, customer_name string, segment string, recency int, frequency bigint, monetary double, profit double"
    return settle(spark.createDataFrame(rows, schema), "blobs")


def test_customer_segments_find_the_blobs(spark):
    found = segments.segment_customers(blobs(spark), seeds=(42, 43, 44))
    rows = found.members.collect()
    assert len(rows) == 100 and all(r["customer_name"] == r["cluster_label"] for r in rows)
    profile = found.profile.orderBy("rank").collect()
    assert [r["label"] for r in profile] == list(segments.CUSTOMER_LABELS)
    assert [r["customers"] for r in profile] == [25] * 4
    scores = [r["score"] for r in profile]
    assert scores == sorted(scores, reverse=True)
    assert found.clustering.cost == min(found.clustering.costs)


def test_members_sit_at_their_nearest_centre(spark):
    base = blobs(spark)
    scaled = segments.scale(base, segments.CUSTOMER_FEATURES)
    result = segments.cluster(scaled, 4, (42,))
    inside = {r["customer_id"]: r["cluster"] for r in result.members.collect()}
    for row in scaled.frame.collect():
        point = [row[c] for c in scaled.names]
        distances = [math.dist(point, c) for c in result.centers]
        assert inside[row["customer_id"]] == distances.index(min(distances))


def test_reference_ranking_uses_its_own_centres(spark):
    base = blobs(spark)
    scaled = segments.scale(base, segments.CUSTOMER_FEATURES)
    result = segments.cluster(scaled, 4, (42,))
    for center, odd in zip(result.centers, segments.natural_centers(result, scaled, segments.CUSTOMER_FEATURES, "reference")):
        assert odd == pytest.approx([math.expm1(v) * s + m for v, s, m in zip(center, scaled.spreads, scaled.means)])
    recency = [c[0] for c in segments.natural_centers(result, scaled, segments.CUSTOMER_FEATURES)]
    assert min(recency) == pytest.approx(2.5, abs=0.6) and max(recency) == pytest.approx(900.5, abs=1)


def test_constant_feature_is_only_centred(spark):
    base = blobs(spark).withColumn("frequency", F.lit(3).cast("bigint"))
    scaled = segments.scale(base, segments.CUSTOMER_FEATURES)
    assert scaled.spreads[1] == 1.0
    assert {round(r["z_frequency"], 9) for r in scaled.frame.select("z_frequency").collect()} == {0.0}


def test_rfm_takes_the_first_name_and_counts_from_the_last_day(spark):
    frame = lines(
        spark,
        {"order_id": "2", "order_date": dt.date(2016, 2, 1), "customer_name": "New Name"},
        {"order_id": "1", "order_date": dt.date(2016, 1, 1), "customer_name": "Old Name"},
        {"order_id": "1", "order_date": dt.date(2016, 1, 1), "customer_name": "Old Name"},
        {"customer_id": "c2", "order_id": "3", "order_date": dt.date(2016, 2, 9)},
    )
    got = {r["customer_id"]: r for r in segments.rfm_base(frame).collect()}
    assert got["c1"]["customer_name"] == "Old Name"
    assert (got["c1"]["recency"], got["c1"]["frequency"], got["c1"]["monetary"]) == (9, 2, 300.0)
    assert got["c2"]["recency"] == 1


def test_rfm_skips_unknown_names_and_customers(spark):
    frame = lines(
        spark,
        {"order_id": "1", "order_date": dt.date(2016, 1, 1), "customer_name": None},
        {"order_id": "2", "order_date": dt.date(2016, 2, 1), "customer_name": "Known"},
        {"customer_id": None},
    )
    rows = segments.rfm_base(frame).collect()
    assert [(r["customer_id"], r["customer_name"]) for r in rows] == [("c1", "Known")]


def test_product_and_profit_segments(spark):
    book = random_lines(spark)
    products = segments.segment_products(segments.product_profile(book), seeds=(42, 43))
    assert products.members.count() == 25
    assert {r["label"] for r in products.profile.collect()} <= set(segments.PRODUCT_LABELS)
    cells = segments.segment_profitability(segments.profit_grid(book), seeds=(42, 43))
    ranked = cells.profile.orderBy("rank").collect()
    profits = [r["avg_profit"] for r in ranked]
    assert profits == sorted(profits, reverse=True)
    assert cells.members.count() == segments.profit_grid(book).count()
