"""Declared schemas of the star, the audit log and the monthly aggregate."""

from pyspark.sql import types as T


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


MONEY = T.DecimalType(12, 4)
RATE = T.DecimalType(5, 4)

D_DATE = _struct(
    ("date_sk", T.LongType(), False),
    ("date", T.DateType(), False),
    ("day", T.IntegerType(), False),
    ("month", T.IntegerType(), False),
    ("month_name", T.StringType(), True),
    ("quarter", T.IntegerType(), False),
    ("year", T.IntegerType(), False),
    ("week_day", T.StringType(), True),
    ("is_weekend", T.BooleanType(), True),
)

D_CUSTOMER = _struct(
    ("customer_sk", T.LongType(), False),
    ("customer_id", T.StringType(), True),
    ("customer_name", T.StringType(), True),
    ("segment", T.StringType(), True),
    ("effective_date", T.DateType(), False),
    ("expiration_date", T.DateType(), True),
    ("current_flag", T.StringType(), True),
    ("bucket", T.IntegerType(), True),
)

D_PRODUCT = _struct(
    ("product_sk", T.LongType(), False),
    ("product_id", T.StringType(), True),
    ("product_name", T.StringType(), True),
    ("category", T.StringType(), True),
    ("sub_category", T.StringType(), True),
    ("effective_date", T.DateType(), False),
    ("expiration_date", T.DateType(), True),
    ("current_flag", T.StringType(), True),
    ("bucket", T.IntegerType(), True),
)

D_LOCATION = _struct(
    ("location_sk", T.LongType(), False),
    ("country", T.StringType(), True),
    ("region", T.StringType(), True),
    ("state", T.StringType(), True),
    ("city", T.StringType(), True),
    ("postal_code", T.StringType(), True),
)

D_ORDER = _struct(
    ("order_id", T.StringType(), False),
    ("ship_mode", T.StringType(), True),
    ("order_number", T.LongType(), True),
)

D_SEGMENT = _struct(
    ("segment_sk", T.LongType(), False),
    ("segment_name", T.StringType(), True),
)

F_SALES = _struct(
    ("order_date_sk", T.LongType(), False),
    ("ship_date_sk", T.LongType(), False),
    ("customer_sk", T.LongType(), False),
    ("product_sk", T.LongType(), False),
    ("location_sk", T.LongType(), False),
    ("order_id", T.StringType(), True),
    ("ship_mode", T.StringType(), True),
    ("sales", MONEY, True),
    ("quantity", T.IntegerType(), True),
    ("discount", RATE, True),
    ("profit", MONEY, True),
    ("order_year", T.IntegerType(), True),
)

ETL_LOG = _struct(
    ("log_id", T.LongType(), False),
    ("run_date", T.TimestampType(), True),
    ("step", T.StringType(), True),
    ("rows_affected", T.LongType(), True),
    ("status", T.StringType(), True),
    ("message", T.StringType(), True),
    ("duration_sec", T.DecimalType(8, 2), True),
)

AGG_SALES_MONTHLY = _struct(
    ("year", T.IntegerType(), False),
    ("month", T.IntegerType(), False),
    ("month_name", T.StringType(), True),
    ("quarter", T.IntegerType(), True),
    ("region", T.StringType(), True),
    ("category", T.StringType(), True),
    ("total_orders", T.LongType(), True),
    ("total_sales", T.DecimalType(22, 4), True),
    ("total_profit", T.DecimalType(22, 4), True),
    ("total_quantity", T.LongType(), True),
    ("transaction_count", T.LongType(), True),
    ("avg_discount", T.DoubleType(), True),
)

# which orders a cell holds: bitmaps of order numbers, one per bucket of them
AGG_ORDER_CELLS = _struct(
    ("month", T.IntegerType(), False),
    ("region", T.StringType(), True),
    ("segment", T.StringType(), True),
    ("category", T.StringType(), True),
    ("bucket", T.LongType(), True),
    ("orders", T.BinaryType(), True),
    ("year", T.IntegerType(), False),
)

# complete steps of loads, by run and input
LOAD_LEDGER = _struct(
    ("run", T.StringType(), False),
    ("inputs", T.StringType(), False),
    ("step", T.StringType(), False),
    ("rows", T.LongType(), False),
    ("finished", T.TimestampType(), True),
)

# lines that could not be read whole
REJECTED = _struct(
    ("step", T.StringType(), False),
    ("file", T.StringType(), True),
    ("source_row", T.LongType(), True),
    ("reason", T.StringType(), False),
    ("record", T.StringType(), True),
)

STAR = {
    "d_date": D_DATE,
    "d_customer": D_CUSTOMER,
    "d_product": D_PRODUCT,
    "d_location": D_LOCATION,
    "d_order": D_ORDER,
    "d_segment": D_SEGMENT,
    "f_sales": F_SALES,
    "agg_sales_monthly": AGG_SALES_MONTHLY,
    "agg_order_cells": AGG_ORDER_CELLS,
    "etl_log": ETL_LOG,
    "load_ledger": LOAD_LEDGER,
}

# columns whose values are folders of their own, so that a load may replace a part
PARTITIONS = {
    "d_customer": ["bucket"],
    "d_product": ["bucket"],
    "f_sales": ["order_year"],
    "agg_sales_monthly": ["year"],
    "agg_order_cells": ["year"],
}

# types of the raw order lines by normalised header name; other columns stay text
RAW_TYPES = {
    "sales": MONEY,
    "quantity": T.IntegerType(),
    "discount": RATE,
    "profit": MONEY,
}

VIEW_COLUMNS = (
    "order_id", "order_date", "ship_date", "sales", "quantity", "discount", "profit",
    "customer_name", "segment", "product_name", "category", "sub_category",
    "country", "region", "state", "city", "ship_mode",
)
