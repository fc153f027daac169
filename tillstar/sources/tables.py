"""The flat sales view, from TPC-H-like Parquet tables or from the star.

Both sources build the view on demand: a caller names the columns it reads and
only the dimensions that supply them are joined. That is exact under
referential integrity, which the star guarantees by construction (unknown keys
are mapped to a real member) and which ``operators.quality`` reports on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.schemas import VIEW_COLUMNS


# Read with declared schemas: no footer is opened just to infer them.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


# The view over these tables, as SQL. Prices and rates are whole cents: they are
# rounded to integers first, since a direct double-to-decimal cast goes through
# text for every row. Sums stay exact decimals, so they do not depend on the
# order in which tasks finish.
_CENTS = "cast(rint(l_extendedprice * 100) as bigint) * (100 - cast(rint(l_discount * 100) as bigint))"
_COST = "cast(rint(p_retailprice * 100) as bigint) * cast(l_quantity as bigint) * 100"
LINE = {
    "ship_date": "cast(l_shipdate as date)",
    "sales": f"cast(cast({_CENTS} as decimal(12,0)) * 0.0001BD as decimal(12,4))",
    "quantity": "cast(l_quantity as int)",
    "discount": "cast(l_discount as decimal(5,4))",
}
ORDER = {
    "order_date": "cast(o_orderdate as date)",
    "ship_mode": "o_orderpriority",
    "customer_id": "o_custkey",
}
GEOGRAPHY = {
    "state": "n_name",
    "city": "concat(n_name, '_C', cast(c_custkey % 10 as string))",
    "country": "r_name",
    "region": "r_name",
}
CUSTOMER = {
    "customer_name": "c_name",
    "segment": "c_mktsegment",
    "postal_code": "lpad(cast(c_custkey % 100 as string), 5, '0')",
    **GEOGRAPHY,
}
PART = {
    "product_name": "p_name",
    "category": "p_type",
    "sub_category": "p_brand",
    "profit": f"cast(cast({_CENTS} - {_COST} as decimal(12,0)) * 0.0001BD as decimal(12,4))",
}
# Columns that callers of summed views only ever add up; a line counts as one.
MEASURES = {
    "sales": LINE["sales"],
    "quantity": LINE["quantity"],
    "profit": PART["profit"],
    "discount": LINE["discount"],
    "lines": "1",
    "rated_lines": "if(l_discount is null, 0, 1)",
}
EVERY = {"order_id": "l_orderkey", "order_number": "l_orderkey", "product_id": "l_partkey", **LINE, **ORDER, **CUSTOMER, **PART, **MEASURES}
PRODUCT = {*PART, "product_id"} - {"profit"}

# Largest Parquet input, in bytes on disk, of a side that is broadcast.
BROADCAST_BYTES = 10 * 2**20


def _named(expressions: Mapping[str, str], columns: Iterable[str]) -> list[str]:
    return [f"{expressions[c]} AS {c}" for c in columns]


def _summed(columns: Iterable[str]) -> list[str]:
    return [f"{f'_{c}' if c in MEASURES else EVERY[c]} AS {c}" for c in columns]


def _add_up(rows: DataFrame, keys: list[str], measures: Mapping[str, str]) -> DataFrame:
    """Sums ``_<measure>`` per key; the distinct keys where nothing is summed."""
    sums = [F.expr(f"sum({e}) AS _{m}") for m, e in measures.items()]
    return rows.groupBy(*keys).agg(*sums) if sums else rows.select(*keys).distinct()


class ParquetTables:
    """Order lines, orders, customers and parts as one sales view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._sizes: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        return self.table("lineitem")

    def bytes(self, name: str) -> int:
        """Size of a table on disk."""
        if name not in self._sizes:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
            system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            self._sizes[name] = system.getContentSummary(path).getLength()
        return self._sizes[name]

    def _broadcast_if_small(self, joined: DataFrame, *tables: str) -> DataFrame:
        """Broadcast a side made of key joins of ``tables`` while they are small.

        Spark estimates a join as the product of its inputs and would pick the
        order lines to broadcast instead. Beyond the limit there is no hint: the
        join shuffles, and adaptive execution splits hot keys.
        """
        small = sum(self.bytes(t) for t in tables) <= BROADCAST_BYTES
        return F.broadcast(joined) if small else joined

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        """The named columns, joining only the tables that supply them.

        ``summed`` is for callers that only ever add up the measures: where the
        other columns allow it they get one row per product, order or customer.
        """
        columns = columns or VIEW_COLUMNS
        wanted = set(columns)
        if summed and "ship_date" not in wanted:
            if not wanted & PRODUCT:
                return self._per_order(wanted).selectExpr(*_summed(columns))
            if not wanted & {"order_id", *ORDER, *CUSTOMER}:
                return self._per_product(wanted).selectExpr(*_summed(columns))

        joined = self.lines()
        if wanted & {*ORDER, *CUSTOMER}:
            joined = joined.join(self._orders(wanted), F.col("l_orderkey") == F.col("o_orderkey"))
        if wanted & set(PART):
            joined = self._with_part(joined)
        return joined.selectExpr(*_named(EVERY, columns))

    def _with_part(self, lines: DataFrame) -> DataFrame:
        return lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def _per_product(self, wanted: set[str]) -> DataFrame:
        """One row per product: a hot product is combined on the map side and
        meets its part row once. Its price is one value, so profit needs only
        the summed sales and quantity."""
        parts = {m: e for m, e in MEASURES.items() if m in wanted and m != "profit"}
        if "profit" in wanted:
            parts |= {"sales": MEASURES["sales"], "quantity": MEASURES["quantity"]}
        sums = self._with_part(_add_up(self.lines(), ["l_partkey"], parts))
        price = "cast(p_retailprice as decimal(12,2))"
        profit = F.expr(f"cast(_sales - {price} * _quantity as decimal(24,4))")
        return sums.withColumn("_profit", profit) if "profit" in wanted else sums

    def _per_order(self, wanted: set[str]) -> DataFrame:
        """One row per order, or per customer where no order column is read.

        Lines shrink to orders before they meet the orders, and orders to
        customers before they meet the customers: the exchange the join needs
        moves sums instead of lines, a distinct count of orders finds its rows
        already in place, and neither a hot order nor a hot customer skews them.
        """
        lines = self.lines()
        if "profit" in wanted:
            lines = self._with_part(lines)
        measures = {m: e for m, e in MEASURES.items() if m in wanted}
        if not wanted & {"order_id", *ORDER, *CUSTOMER}:
            return _add_up(lines, [], measures)
        sums = _add_up(lines, ["l_orderkey"], measures)
        if not wanted & {*ORDER, *CUSTOMER}:
            return sums
        sums = sums.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        if not wanted & set(CUSTOMER):
            return sums
        if not wanted & {"order_id", "order_date", "ship_mode"}:
            sums = _add_up(sums, ["o_custkey"], {m: f"_{m}" for m in measures})
        return sums.join(self._people(wanted), F.col("o_custkey") == F.col("c_custkey"))

    def _orders(self, wanted: set[str]) -> DataFrame:
        """Orders with what is needed of their customer, so order lines join once."""
        orders = self.table("orders")
        if not wanted & set(CUSTOMER):
            return orders
        joined = orders.join(self._people(wanted), F.col("o_custkey") == F.col("c_custkey"))
        return self._broadcast_if_small(joined, "orders", "customer")

    def _people(self, wanted: set[str]) -> DataFrame:
        people = self.table("customer")
        if not wanted & set(GEOGRAPHY):
            return people
        people = people.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        if wanted & {"country", "region"}:
            people = people.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self._broadcast_if_small(people, "customer", "nation", "region")


class StarTables:
    """The same view over the star: fact ⋈ the dimensions a caller needs."""

    FACT = ("order_id", "sales", "quantity", "discount", "profit")
    CUSTOMER = ("customer_id", "customer_name", "segment")
    PRODUCT = ("product_id", "product_name", "category", "sub_category")
    LOCATION = ("country", "region", "state", "city")

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> StarTables:
        names = ("d_date", "d_customer", "d_product", "d_location", "d_order", "d_segment", "f_sales")
        return cls({name: spark.table(f"{database}.{name}") for name in names})

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        """The named columns, joining only the dimensions that supply them.

        ``summed``: callers only add up the measures. The fact is added up
        before the joins where one key alone is read, or none; several keys
        together come near the grain of the lines, so there the measures are
        added up once, after the joins.
        """
        columns = columns or VIEW_COLUMNS
        wanted = set(columns)
        dimensions = [
            (table, key, [a for a in attributes if a in wanted])
            for table, key, attributes in (
                ("d_customer", "customer_sk", self.CUSTOMER),
                ("d_product", "product_sk", self.PRODUCT),
                ("d_location", "location_sk", self.LOCATION),
            )
            if wanted & set(attributes)
        ]
        dates = [name for name in ("order_date", "ship_date") if name in wanted]
        rows = self.tables["f_sales"].drop("ship_mode")
        keys = [key for _, key, _ in dimensions] + [f"{name}_sk" for name in dates]
        if "order_date" in wanted:
            keys.append("order_year")
        if wanted & {"order_id", "order_number", "ship_mode"}:
            keys.append("order_id")
        rows = rows.withColumns(
            {"lines": F.lit(1), "rated_lines": F.when(F.col("discount").isNull(), 0).otherwise(1)}
        )
        if summed and len(keys) == 1:
            sums = [F.sum(c).alias(c) for c in MEASURES if c in wanted]
            rows = rows.groupBy(*keys).agg(*sums) if sums else rows.select(*keys).distinct()
        if wanted & {"ship_mode", "order_number"}:
            # first: stored in the same buckets as the fact, orders join without an exchange
            rows = rows.join(self.tables["d_order"], "order_id")
        for name in dates:
            rows = self._join_date(rows, f"{name}_sk", name)
        for table, key, read in dimensions:
            rows = rows.join(self.tables[table].select(key, *read), key)
        return rows.select(*columns)

    def _join_date(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        on = [key]
        dates = self.tables["d_date"].select(F.col("date_sk").alias(key), F.col("date").alias(name), "year")
        if name == "order_date":
            # also on the partition column: a date filter then prunes fact partitions
            dates = dates.withColumnRenamed("year", "order_year")
            on.append("order_year")
        return rows.join(dates.drop("year"), on)


def as_reported(view: DataFrame) -> DataFrame:
    """Exact decimals to double, the types consumers of the view read."""
    return view.withColumns(
        {c: F.col(c).cast("double") for c in ("sales", "discount", "profit") if c in view.columns}
    )
