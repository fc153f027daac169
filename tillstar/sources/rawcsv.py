"""Raw order-line CSV: latin-1 text with a header row."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions.text import raw_date, snake
from tillstar.schemas import RAW_TYPES

CSV_OPTIONS = {"header": True, "encoding": "ISO-8859-1", "quote": '"', "escape": '"'}
# columns of a scan beside those of the file
CORRUPT, FILE, ROW, REASON = "_corrupt", "_file", "source_row", "_reason"


def _place(uri: str) -> str:
    """A file's path as readers take it; local ones are written with one slash or three."""
    path = unquote(uri)
    return "file:/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def files_with_breaks(spark: SparkSession, path: str) -> list[str]:
    """Files in which a quoted field goes on in the next line.

    A quote within quotes is doubled, so a line of whole fields has an even
    number of quotes. One row per such file comes to the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return sorted(_place(r.file) for r in lines.filter(quotes % 2 == 1).select("file").distinct().collect())


def _typed(name: str, kind: T.DataType) -> Column:
    """The value of a text, null where it is empty or no such number."""
    text = F.trim(F.col(f"`{name}`"))
    number = F.when(text != "", text)
    if isinstance(kind, T.IntegerType):  # whole numbers, also with a decimal point
        exact = number.try_cast("decimal(18,4)")
        return F.when(exact == F.floor(exact), exact.try_cast("int"))
    return number.try_cast(kind)


def scan_order_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines as text, with their file, a row number and why they cannot be read, if so.

    Files are split among tasks, but for those with line breaks in quoted
    fields, which are read whole. A line has a reason if its number of fields
    is not that of the header or an amount is no number.
    """
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    broken = files_with_breaks(spark, path)
    if broken:
        plain = [f for f in map(_place, spark.read.text(path).inputFiles()) if f not in set(broken)]
        parts = [spark.read.schema(schema).options(**options, multiLine=True).csv(broken)]
        parts += [spark.read.schema(schema).options(**options).csv(plain)] if plain else []
    else:
        parts = [spark.read.schema(schema).options(**options).csv(path)]
    lines = None
    for part in parts:
        named = part.withColumn(FILE, F.col("_metadata.file_path"))
        lines = named if lines is None else lines.unionByName(named)
    wrong = [
        F.when((F.trim(F.col(f"`{n}`")) != "") & _typed(n, RAW_TYPES[snake(n)]).isNull(), F.lit(snake(n)))
        for n in names
        if snake(n) in RAW_TYPES
    ]
    unreadable = F.concat_ws(", ", *wrong) if wrong else F.lit("")
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("number of fields")).when(
        unreadable != "", F.concat(F.lit("unreadable "), unreadable)
    )
    return lines.withColumns({REASON: reason, ROW: F.monotonically_increasing_id()})


def readable_lines(scanned: DataFrame) -> DataFrame:
    """The lines of a scan without a reason, amounts typed."""
    names = [c for c in scanned.columns if c not in (CORRUPT, FILE, ROW, REASON)]
    kinds = {n: RAW_TYPES.get(snake(n)) for n in names}
    columns = [_typed(n, kind).alias(n) if kind else F.col(f"`{n}`") for n, kind in kinds.items()]
    return scanned.filter(F.col(REASON).isNull()).select(*columns, ROW, FILE)


def rejected_lines(scanned: DataFrame) -> DataFrame:
    """Lines of a scan with a reason, as rows of ``schemas.REJECTED``."""
    names = [c for c in scanned.columns if c not in (CORRUPT, FILE, ROW, REASON)]
    fields = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    return scanned.filter(F.col(REASON).isNotNull()).select(
        F.lit("extract").alias("step"), F.col(FILE).alias("file"), F.col(ROW), F.col(REASON).alias("reason"),
        F.coalesce(F.col(CORRUPT), fields).alias("record"),
    )


def read_order_lines(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """All readable lines under their header names; measures typed, the rest text.

    Only the header line is read to learn the names; there is no inference pass
    over the data. ``positions`` adds ``source_row``, which is unique, grows in
    line order within a file and stays the same when a task is retried.
    """
    lines = readable_lines(scan_order_lines(spark, path)).drop(FILE)
    return lines if positions else lines.drop(ROW)


def read_dated_lines(spark: SparkSession, path: str) -> DataFrame:
    """Order lines with both dates parsed strictly: a bad date fails the job."""
    lines = read_order_lines(spark, path)
    return lines.withColumns(
        {
            c: raw_date(F.col(c), strict=True)
            for c in lines.columns
            if snake(c) in ("order_date", "ship_date")
        }
    )
