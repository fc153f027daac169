"""Small order-line frames for tests."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

SCHEMA = (
    "order_id string, order_date date, ship_date date, sales double, quantity int, discount double, profit double, "
    "customer_id string, customer_name string, segment string, product_id string, product_name string, "
    "category string, sub_category string, country string, region string, state string, city string, ship_mode string"
)

DEFAULTS = {
    "order_id": "o1", "order_date": dt.date(2016, 1, 1), "ship_date": dt.date(2016, 1, 3), "sales": 100.0,
    "quantity": 1, "discount": 0.0, "profit": 10.0, "customer_id": "c1", "customer_name": "Ann",
    "segment": "Consumer", "product_id": "p1", "product_name": "Pen", "category": "Office",
    "sub_category": "Art", "country": "US", "region": "South", "state": "Texas", "city": "Austin",
    "ship_mode": "First",
}


def lines(spark, *changes: dict):
    floats = {k for k, v in DEFAULTS.items() if isinstance(v, float)}
    rows = [tuple(float(v) if k in floats else v for k, v in {**DEFAULTS, **c}.items()) for c in changes]
    return counted_lines(typed(spark.createDataFrame(rows, SCHEMA)))


def typed(df):
    return df.withColumns(
        {
            "sales": F.col("sales").cast("decimal(12,4)"),
            "profit": F.col("profit").cast("decimal(12,4)"),
            "discount": F.col("discount").cast("decimal(5,4)"),
        }
    )


def counted_lines(df):
    rated = F.when(F.col("discount").isNull(), 0).otherwise(1)
    return df.withColumns({"lines": F.lit(1), "rated_lines": rated})


def random_lines(spark, count: int = 600, seed: int = 3):
    rng = random.Random(seed)
    changes = []
    for _ in range(count):
        customer = rng.randrange(40)
        product = rng.randrange(25)
        order = rng.randrange(count // 3)
        day = dt.date(2014, 1, 1) + dt.timedelta(days=order * 7 % 1460)
        sales = round(rng.uniform(5, 900), 2)
        changes.append(
            {
                "order_id": f"o{order}", "order_date": day, "ship_date": day + dt.timedelta(days=rng.randrange(9)),
                "sales": sales, "quantity": rng.randrange(1, 7), "discount": rng.choice([0, 0.1, 0.2, 0.3, 0.6]),
                "profit": round(sales * rng.uniform(-0.4, 0.5), 2), "customer_id": f"c{customer}",
                "customer_name": f"Name {customer}", "segment": ["Consumer", "Corporate", "Home Office"][customer % 3],
                "product_id": f"p{product}", "product_name": f"Product {product}",
                "category": ["Furniture", "Office Supplies", "Technology"][product % 3],
                "sub_category": f"Sub {product % 8}", "region": ["Central", "East", "South", "West"][customer % 4],
                "state": ["Texas", "Ohio", "Nowhere", "Maine"][customer % 4], "city": f"City {customer % 7}",
                "ship_mode": ["First", "Second"][order % 2],
            }
        )
    return lines(spark, *changes)


class Flat:
    """A frame as a source of views."""

    def __init__(self, df):
        self.df = df

    def view(self, *columns, summed=False):
        counted = counted_lines(self.df)
        return counted.select(*columns) if columns else self.df
