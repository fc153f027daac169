"""The same results in DuckDB SQL, per query name, for the correctness check."""

from __future__ import annotations

VIEW_SQL = """
base AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, o_custkey AS customer_id,
    CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(12,4)) AS sales,
    CAST(l_quantity AS INTEGER) AS quantity, CAST(l_discount AS DECIMAL(5,4)) AS discount,
    CAST(p_retailprice AS DECIMAL(12,2)) AS price,
    c_name AS customer_name, c_mktsegment AS segment,
    p_name AS product_name, p_type AS category, p_brand AS sub_category,
    r_name AS country, r_name AS region, n_name AS state,
    n_name || '_C' || CAST(c_custkey % 10 AS VARCHAR) AS city,
    lpad(CAST(c_custkey % 100 AS VARCHAR), 5, '0') AS postal_code,
    o_orderpriority AS ship_mode
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
sv AS (SELECT * EXCLUDE (price), CAST(sales - price * quantity AS DECIMAL(12,4)) AS profit,
  CAST(year(order_date) AS INTEGER) AS yr, CAST(ship_date - order_date AS INTEGER) AS days FROM base)
"""

REPORTED = """order_id, order_date, ship_date, CAST(sales AS DOUBLE) AS sales, quantity,
  CAST(discount AS DOUBLE) AS discount, CAST(profit AS DOUBLE) AS profit, customer_name, segment, product_name,
  category, sub_category, country, region, state, city, ship_mode"""

SLICE = "region = 'EUROPE' AND yr = 1997 AND segment = 'BUILDING'"
RUN = "DATE '2021-06-01'"
LOADED = "DATE '1995-01-01'"


def over_view(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([VIEW_SQL.strip(), *ctes]) + "\n" + select


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"({dbl(a)} / NULLIF({dbl(b)}, 0))"


def pct(a: str, b: str, digits: int = 1) -> str:
    return f"round_even({ratio(a, b)} * 100, {digits})"


def pct0(a: str, b: str) -> str:
    return f"coalesce({pct(a, b)}, 0.0)"


def change(now: str, before: str) -> str:
    return f"round_even((({dbl(now)} - {dbl(before)}) / NULLIF({dbl(before)}, 0)) * 100, 1)"


def short(x: str) -> str:
    v = dbl(x)
    return (
        f"(CASE WHEN abs({v}) >= 1000000 THEN '$' || format('{{:.1f}}', {v} / 1000000) || 'M' "
        f"WHEN abs({v}) >= 1000 THEN '$' || format('{{:.0f}}', {v} / 1000) || 'K' "
        f"ELSE '$' || format('{{:.0f}}', {v}) END)"
    )


def money(x: str, digits: int = 0) -> str:
    return f"('$' || format('{{:,.{digits}f}}', {dbl(x)}))"


def cents(x: str) -> str:
    """A sum of four decimals to two, half to even, in whole numbers."""
    n = f"CAST(CAST({x} AS DECIMAL(24,4)) * 10000 AS HUGEINT)"
    half = f"CASE WHEN abs({n} % 100) <> 50 THEN round({dbl(n)} / 100) ELSE {dbl(n + ' // 100')} + ({n} // 100 % 2) END"
    return f"(({half}) / 100)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def margin_band(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 'red' WHEN {x} < 20 THEN 'amber' WHEN {x} IS NOT NULL THEN 'green' END"


def sign(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'neutral' WHEN {x} >= 0 THEN 'pos' ELSE 'neg' END"


SQL: dict[str, str] = {}

# ---- view, filters, cleaning --------------------------------------------------

SQL["sales_view"] = over_view(f"SELECT {REPORTED} FROM sv")
SQL["star_join"] = SQL["sales_view"]
SQL["export_rows"] = over_view(f"SELECT {REPORTED} FROM sv WHERE {SLICE}")
SQL["ship_not_null"] = over_view(
    "SELECT order_id, order_date, ship_date FROM sv WHERE order_date IS NOT NULL AND ship_date IS NOT NULL"
)


def _kpis(where: str = "TRUE") -> str:
    return over_view(
        f"""SELECT {dbl('s')} AS total_sales, {short('s')} AS total_sales_fmt, {dbl('p')} AS total_profit,
  {short('p')} AS total_profit_fmt, total_orders, total_customers, total_fact_rows, {pct0('p', 's')} AS margin,
  total_units, round_even({ratio('total_units', 'total_orders')}, 1) AS avg_qty_per_order
FROM k""",
        f"""k AS (SELECT coalesce(sum(sales), 0) AS s, coalesce(sum(profit), 0) AS p,
  count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_name) AS total_customers,
  (SELECT count(order_id) FROM sv) AS total_fact_rows, {big('coalesce(sum(quantity), 0)')} AS total_units FROM sv WHERE {where})""",
    )


SQL["kpis"] = _kpis()
SQL["filter_region_year_segment"] = _kpis(SLICE)
SQL["filter_coverage"] = over_view(
    f"SELECT *, {pct0('filtered_orders', 'total_fact_rows')} AS coverage_pct FROM c",
    f"""c AS (SELECT count(DISTINCT CASE WHEN {SLICE} THEN order_id END) AS filtered_orders,
  count(order_id) AS total_fact_rows FROM sv)""",
)
SQL["filter_values"] = over_view(
    """SELECT 'region' AS filter_name, 0 AS ordinal, 'Todas' AS value, count(*) AS fact_rows FROM sv
UNION ALL SELECT 'year', 0, 'Todos', count(*) FROM sv
UNION ALL SELECT 'segment', 0, 'Todos', count(*) FROM sv
UNION ALL SELECT 'region', 1, region, count(*) FROM sv GROUP BY region
UNION ALL SELECT 'year', 1, CAST(yr AS VARCHAR), count(*) FROM sv GROUP BY yr
UNION ALL SELECT 'segment', 1, segment, count(*) FROM sv GROUP BY segment"""
)
SQL["clean_strings"] = r"""
SELECT c_custkey AS customer_id,
  trim(regexp_replace('  ' || replace(c_name, '#', ' ' || chr(9) || chr(160) || ' ') || chr(160) || ' ',
    '[\s\x{00A0}]+', ' ', 'g')) AS customer_name
FROM customer"""
SQL["clean_dates"] = """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) AS ship_date
FROM orders WHERE o_orderstatus <> 'P'"""
SQL["profile_outliers"] = over_view(
    f"""SELECT count(*) FILTER (WHERE profit < 0) AS loss_lines,
  {pct0('count(*) FILTER (WHERE profit < 0)', 'count(*)')} AS loss_pct, {dbl('max(discount)')} AS max_discount,
  format('{{:.0f}}', {dbl('max(discount) * 100')}) || '%' AS max_discount_text,
  {dbl('min(profit)')} AS min_profit, {money('min(profit)', 2)} AS min_profit_text FROM sv"""
)
SQL["fmt_money"] = over_view(
    f"""SELECT customer_id, {short('sum(sales)')} AS sales_short, {short('sum(profit)')} AS profit_short,
  {money('sum(sales)')} AS sales_text, {money('sum(profit)', 2)} AS profit_text FROM sv GROUP BY customer_id"""
)
_on_time = "count(*) FILTER (WHERE days <= 5)"
SQL["status_bands"] = over_view(
    f"""SELECT 'product_margin' AS measure, member, value, {margin_band('value')} AS band FROM m WHERE kind = 'product'
UNION ALL SELECT 'region_margin', member, value, CASE WHEN value < 8 THEN 'amber' ELSE 'green' END FROM m
  WHERE kind = 'region'
UNION ALL SELECT 'segment_margin', member, value, CASE WHEN value >= 12 THEN 'green' ELSE 'amber' END FROM m
  WHERE kind = 'segment'
UNION ALL SELECT 'region_on_time', member, value,
  CASE WHEN value >= 70 THEN 'green' WHEN value >= 50 THEN 'amber' ELSE 'red' END FROM t""",
    f"""m AS (SELECT 'product' AS kind, product_name AS member, {pct0('sum(profit)', 'sum(sales)')} AS value FROM sv GROUP BY 2
  UNION ALL SELECT 'region', region, {pct0('sum(profit)', 'sum(sales)')} FROM sv GROUP BY 2
  UNION ALL SELECT 'segment', segment, {pct0('sum(profit)', 'sum(sales)')} FROM sv GROUP BY 2),
t AS (SELECT region AS member, {pct0(_on_time, 'count(days)')} AS value FROM sv GROUP BY 1)""",
)

# ---- headline figures ------------------------------------------------------------


def _yoy(now: str, before: str, where: str = "TRUE") -> str:
    names = ("sales", "profit", "orders")
    return over_view(
        f"""SELECT {dbl('sales')} AS sales, {dbl('prev_sales')} AS prev_sales, yoy_sales, {sign('yoy_sales')} AS sales_trend,
  {dbl('profit')} AS profit, {dbl('prev_profit')} AS prev_profit, yoy_profit, {sign('yoy_profit')} AS profit_trend,
  orders, prev_orders, yoy_orders, {sign('yoy_orders')} AS orders_trend, margin, prev_margin,
  round_even(margin - prev_margin, 1) AS yoy_margin, {sign('round_even(margin - prev_margin, 1)')} AS margin_trend
FROM r""",
        "years AS (SELECT max(yr) AS y1, (SELECT max(yr) FROM sv WHERE yr < (SELECT max(yr) FROM sv)) AS y2 FROM sv)",
        f"""p AS (SELECT coalesce(sum(sales) FILTER (WHERE {now}), 0) AS sales,
  coalesce(sum(sales) FILTER (WHERE {before}), 0) AS prev_sales,
  coalesce(sum(profit) FILTER (WHERE {now}), 0) AS profit,
  coalesce(sum(profit) FILTER (WHERE {before}), 0) AS prev_profit,
  count(DISTINCT order_id) FILTER (WHERE {now}) AS orders,
  count(DISTINCT order_id) FILTER (WHERE {before}) AS prev_orders
  FROM sv, years WHERE {where})""",
        f"""r AS (SELECT *, {pct0('profit', 'sales')} AS margin, {pct0('prev_profit', 'prev_sales')} AS prev_margin,
  {', '.join(f"{change(k, 'prev_' + k)} AS yoy_{k}" for k in names)} FROM p)""",
    )


SQL["kpi_yoy"] = _yoy("yr = y1", "yr = y2")
SQL["kpi_yoy_reference"] = _yoy("TRUE", "yr = y2")
SQL["kpi_yoy_slice"] = _yoy("yr = 1997", "yr = 1996", "region = 'EUROPE' AND segment = 'BUILDING'")
_asia = "region = 'ASIA' AND yr = 1997 AND segment = 'BUILDING'"
_promo = "region = 'EUROPE' AND yr = 1997 AND category = 'PROMO'"
SQL["alerts"] = over_view(
    f"""SELECT {dbl('loss')} AS discount_loss, {short('loss')} AS discount_loss_fmt,
  CASE WHEN loss < 0 THEN 'red' ELSE 'green' END AS discount_band, region_margin,
  CASE WHEN region_margin < 8 THEN 'amber' ELSE 'green' END AS region_band, category_margin FROM a""",
    f"""a AS (SELECT coalesce(sum(profit) FILTER (WHERE {SLICE} AND discount > 0.05), 0) AS loss,
  {pct0(f'sum(profit) FILTER (WHERE {_asia})', f'sum(sales) FILTER (WHERE {_asia})')} AS region_margin,
  {pct0(f'sum(profit) FILTER (WHERE {_promo})', f'sum(sales) FILTER (WHERE {_promo})')} AS category_margin FROM sv)""",
)
SQL["quantity_stats"] = over_view(
    f"SELECT {big('sum(u)')} AS total_units, round_even({dbl('sum(u)')} / count(*), 1) AS avg_per_order FROM o",
    "o AS (SELECT order_id, sum(quantity) AS u FROM sv GROUP BY order_id)",
)
SQL["units_by_category"] = over_view(f"SELECT category, {big('sum(quantity)')} AS units FROM sv GROUP BY category")
SQL["top5_products"] = over_view(
    f"""SELECT product_name AS name, category, {dbl('sum(sales)')} AS revenue, {short('sum(sales)')} AS revenue_fmt,
  {dbl('sum(profit)')} AS profit, {pct0('sum(profit)', 'sum(sales)')} AS margin FROM sv GROUP BY 1, 2
ORDER BY sum(sales) DESC, 1, 2 LIMIT 5"""
)

# ---- sales ----------------------------------------------------------------------

SQL["q1_region_category"] = over_view(
    f"""SELECT region, category, {dbl('sum(sales)')} AS total_sales, {dbl('sum(profit)')} AS total_profit,
  count(DISTINCT order_id) AS order_count FROM sv GROUP BY region, category ORDER BY sum(sales) DESC"""
)
SQL["q2_top_products"] = over_view(
    f"""SELECT product_name, sub_category, {dbl('sum(sales)')} AS total_sales, {dbl('sum(profit)')} AS total_profit,
  {ratio('sum(profit)', 'sum(sales)')} * 100 AS margin_pct FROM sv GROUP BY 1, 2
ORDER BY sum(profit) DESC, 1, 2 LIMIT 10"""
)
SQL["q5_discount_impact"] = over_view(
    f"""SELECT CASE WHEN discount = 0 THEN 'Sin descuento' WHEN discount <= 0.02 THEN 'Bajo (<=20%)'
  WHEN discount <= 0.05 THEN 'Medio (<=50%)' ELSE 'Alto (>50%)' END AS discount_tier, count(*) AS transactions,
  {dbl('sum(sales)')} AS total_sales, {dbl('sum(profit)')} AS total_profit,
  {ratio('sum(discount)', 'count(discount)')} AS avg_discount FROM sv GROUP BY 1 ORDER BY 5"""
)


def _sales_by(*keys: str, k: int | None = None, extra: str = "") -> str:
    names = ", ".join(keys)
    limit = f" LIMIT {k}" if k else ""
    return over_view(
        f"""SELECT {names}, {dbl('sum(sales)')} AS sales, {short('sum(sales)')} AS sales_fmt{extra} FROM sv
GROUP BY {names} ORDER BY sum(sales) DESC, {names}{limit}"""
    )


SQL["sales_by_category"] = _sales_by("category")
SQL["sales_by_region"] = _sales_by("region")
SQL["sales_by_segment"] = _sales_by("segment")
SQL["sales_by_subcategory"] = _sales_by("sub_category", k=15)
SQL["sales_by_city"] = _sales_by("state", "city", k=15, extra=", city || ', ' || state AS location")
SQL["sales_by_state"] = over_view(
    f"""SELECT state, 'N' || CAST(n_nationkey AS VARCHAR) AS abbr, {dbl('sum(sales)')} AS sales,
  {dbl('sum(profit)')} AS profit FROM sv JOIN nation ON n_name = state
WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA') GROUP BY state, n_nationkey"""
)
SQL["top_products_sales"] = over_view(
    f"""SELECT product_name, category, sub_category, {dbl('sum(sales)')} AS sales, {short('sum(sales)')} AS sales_fmt,
  {dbl('sum(profit)')} AS profit, {short('sum(profit)')} AS profit_fmt, {pct('sum(profit)', 'sum(sales)')} AS margin,
  {margin_band(pct('sum(profit)', 'sum(sales)'))} AS band
FROM sv GROUP BY 1, 2, 3 ORDER BY sum(sales) DESC, 1, 2, 3 LIMIT 10"""
)

# ---- profitability -----------------------------------------------------------------

SQL["discount_tiers"] = over_view(
    f"""SELECT ordinal, tier, count(sales) AS transactions, {dbl('coalesce(sum(profit), 0)')} AS profit,
  {short('coalesce(sum(profit), 0)')} AS profit_fmt, {sign('coalesce(sum(profit), 0)')} AS profit_sign
FROM (VALUES (1, 'Sin desc.'), (2, '≤2%'), (3, '≤5%'), (4, '>5%')) AS t(ordinal, tier)
LEFT JOIN sv ON ordinal = CASE WHEN discount = 0 THEN 1 WHEN discount <= 0.02 THEN 2 WHEN discount <= 0.05 THEN 3 ELSE 4 END
GROUP BY ordinal, tier"""
)
SQL["discount_loss"] = over_view(
    f"""SELECT {dbl('coalesce(sum(profit) FILTER (WHERE discount > 0.05), 0)')} AS discount_loss,
  {short('coalesce(sum(profit) FILTER (WHERE discount > 0.05), 0)')} AS discount_loss_fmt,
  count(*) FILTER (WHERE discount > 0.05) AS transactions,
  {pct0('count(*) FILTER (WHERE discount > 0.05)', 'count(*)')} AS discount_pct FROM sv"""
)
SQL["profit_region_category"] = over_view(
    f"SELECT region, category, {dbl('sum(profit)')} AS profit FROM sv GROUP BY 1, 2 ORDER BY sum(profit) DESC"
)
SQL["profit_winner"] = over_view(
    f"""SELECT region, category, {dbl('sum(profit)')} AS profit, {short('sum(profit)')} AS profit_fmt FROM sv
GROUP BY 1, 2 ORDER BY sum(profit) DESC, 1, 2 LIMIT 1"""
)
SQL["profit_heatmap"] = over_view(f"SELECT region, category, {dbl('sum(profit)')} AS profit FROM sv GROUP BY 1, 2")

# ---- customers ------------------------------------------------------------------------

SQL["segment_cards"] = over_view(
    f"""SELECT segment, customers, {dbl('r')} AS revenue, {short('r')} AS revenue_fmt, orders,
  {ratio('r', 'orders')} AS avg_order, {short(ratio('r', 'orders'))} AS avg_order_fmt, {pct0('p', 'r')} AS margin,
  CASE WHEN {pct0('p', 'r')} >= 12 THEN 'green' ELSE 'amber' END AS band, {pct('d', 'dn')} AS avg_discount_pct FROM s""",
    """s AS (SELECT segment, count(DISTINCT customer_name) AS customers, count(DISTINCT order_id) AS orders,
  sum(sales) AS r, sum(profit) AS p, sum(discount) AS d, count(discount) AS dn FROM sv GROUP BY segment)""",
)
SQL["segment_margin"] = over_view(
    f"""SELECT segment, margin, format('{{:.1f}}', margin) || '%' AS margin_text, avg_discount,
  format('{{:.1f}}', avg_discount) || '%' AS avg_discount_text FROM s""",
    f"""s AS (SELECT segment, {pct('sum(profit)', 'sum(sales)')} AS margin,
  {pct('sum(discount)', 'count(discount)')} AS avg_discount FROM sv GROUP BY segment)""",
)
_customers = """cust AS (SELECT customer_name, segment, sum(sales) AS r, count(DISTINCT order_id) AS orders,
  sum(profit) AS p FROM sv GROUP BY 1, 2)"""
SQL["top_customers"] = over_view(
    f"""SELECT row_number() OVER (ORDER BY r DESC, customer_name, segment) AS rank, customer_name AS name, segment,
  {dbl('r')} AS revenue, {short('r')} AS revenue_fmt, orders, {ratio('r', 'orders')} AS ticket,
  {short(ratio('r', 'orders'))} AS ticket_fmt, {pct('p', 'r')} AS margin, {margin_band(pct('p', 'r'))} AS band
FROM cust ORDER BY r DESC, customer_name, segment LIMIT 10""",
    _customers,
)
SQL["customer_insight"] = over_view(
    f"""SELECT (SELECT segment FROM sv GROUP BY segment ORDER BY sum(sales) DESC, segment LIMIT 1) AS top_segment,
  (SELECT {short('sum(sales)')} FROM sv GROUP BY segment ORDER BY sum(sales) DESC, segment LIMIT 1) AS top_revenue,
  (SELECT {short(ratio('sum(sales)', 'count(DISTINCT order_id)'))} FROM sv) AS avg_ticket,
  (SELECT count(DISTINCT customer_name) FROM sv) AS total_customers,
  (SELECT {pct0('count(*) FILTER (WHERE orders > 1)', 'count(*)')} FROM cust) AS repeat_rate""",
    _customers,
)


def _frequency(top: int) -> str:
    return over_view(
        """SELECT ordinal, orders_range, count(n) AS customers
FROM bins LEFT JOIN c ON n BETWEEN low AND high GROUP BY ordinal, orders_range""",
        "c AS (SELECT customer_name, count(DISTINCT order_id) AS n FROM sv GROUP BY 1)",
        f"""bins AS (SELECT * FROM (VALUES (1, 1, 1, '1'), (2, 2, 3, '2-3'), (3, 4, 5, '4-5'), (4, 6, 10, '6-10'),
  (5, 11, {top}, '11+')) AS b(ordinal, low, high, orders_range))""",
    )


SQL["customer_frequency"] = _frequency(2_000_000_000)

# ---- shipping ---------------------------------------------------------------------------

_share = f"round_even({ratio('count(*) FILTER (WHERE days <= 5)', 'count(days)')} * 100, 1)"
_mean_days = ratio("sum(days)", "count(days)")
SQL["shipping_stats"] = over_view(
    f"""SELECT round_even({_mean_days}, 1) AS avg_delivery_days, {_share} AS on_time_pct,
  count(days) AS total_orders FROM sv"""
)
SQL["shipping_by_mode"] = over_view(
    "SELECT *, CAST(trunc(avg_days) AS INTEGER) AS avg_whole_days FROM m",
    f"""m AS (SELECT ship_mode, round_even({_mean_days}, 1) AS avg_days, count(days) AS orders,
  round_even(stddev_samp(days), 1) AS std_days FROM sv GROUP BY 1)""",
)
SQL["shipping_by_region"] = over_view(
    """SELECT *, CASE WHEN on_time_pct >= 70 THEN 'green' WHEN on_time_pct >= 50 THEN 'amber' ELSE 'red' END AS band
FROM m""",
    f"""m AS (SELECT region, round_even({_mean_days}, 1) AS avg_days, {_share} AS on_time_pct,
  count(days) AS orders FROM sv GROUP BY 1)""",
)
SQL["delivery_days_region"] = over_view(
    f"""SELECT region, {_mean_days} AS avg_days, format('{{:.1f}}', {_mean_days}) || 'd' AS avg_days_text
FROM sv GROUP BY 1"""
)
SQL["delivery_histogram"] = over_view(
    "SELECT days AS delivery_days, ship_mode, count(*) AS orders FROM sv GROUP BY 1, 2"
)
SQL["ship_mode_impact"] = over_view(
    f"""SELECT ship_mode, count(DISTINCT order_id) AS orders, {dbl('sum(sales)')} AS revenue,
  {short('sum(sales)')} AS revenue_fmt, {dbl('sum(profit)')} AS profit, {short('sum(profit)')} AS profit_fmt,
  {pct('sum(profit)', 'sum(sales)')} AS margin FROM sv GROUP BY 1"""
)
SQL["orders_per_month"] = over_view(
    "SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders FROM sv GROUP BY 1"
)

# ---- time and concentration -----------------------------------------------------------------

_months = """spine AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(order_date)),
  date_trunc('month', max(order_date)), INTERVAL 1 MONTH)) AS DATE) AS m FROM sv),
mon AS (SELECT last_day(m) AS month_end, coalesce(sum(sales), 0) AS sales
  FROM spine LEFT JOIN sv ON date_trunc('month', order_date) = m GROUP BY m)"""
_ma3 = "CAST(sum(sales) OVER w3 AS DOUBLE) / count(*) OVER w3"
_w3 = "WINDOW w3 AS (ORDER BY month_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
SQL["monthly_sales"] = over_view(f"SELECT month_end, {dbl('sales')} AS sales FROM mon", _months)
SQL["monthly_trend"] = over_view(f"SELECT month_end, {dbl('sales')} AS sales, {_ma3} AS ma FROM mon {_w3}", _months)
_lagged = f"""lagged AS (SELECT *, lag(sales) OVER (ORDER BY month_end) AS prev,
  lag(month_end) OVER (ORDER BY month_end) AS prev_end FROM mon),
chg AS (SELECT *, ({dbl('sales')} - {dbl('prev')}) / NULLIF({dbl('prev')}, 0) * 100 AS mom FROM lagged)"""
SQL["mom_change"] = over_view(
    f"""SELECT strftime(month_end, '%Y-%m') AS month, strftime(month_end, '%b %Y') AS label, {dbl('sales')} AS sales,
  mom AS mom_pct FROM chg""",
    _months,
    _lagged,
)
SQL["mom_last"] = over_view(
    f"""SELECT strftime(month_end, '%b %Y') AS current_month, {dbl('sales')} AS current_sales,
  {short('sales')} AS current_fmt, strftime(prev_end, '%b %Y') AS prev_month, {dbl('prev')} AS prev_sales,
  {short('prev')} AS prev_fmt, round_even(mom, 1) AS mom_pct, {sign('round_even(mom, 1)')} AS mom_trend
FROM chg WHERE prev_end IS NOT NULL ORDER BY month_end DESC LIMIT 1""",
    _months,
    _lagged,
)
SQL["month_spine"] = over_view(
    "SELECT last_day(m) AS month_end, m > hi AS is_future FROM s",
    """s AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(order_date)),
  date_trunc('month', max(order_date)) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) AS m,
  CAST(date_trunc('month', max(order_date)) AS DATE) AS hi FROM sv)""",
)
SQL["forecast_features"] = over_view(
    f"""SELECT month_end, {dbl('sales')} AS value, CAST(row_number() OVER (ORDER BY month_end) - 1 AS INTEGER) AS t,
  CAST(month(month_end) AS INTEGER) AS month,
  {dbl('coalesce(lag(sales, 1) OVER (ORDER BY month_end), first_value(sales) OVER (ORDER BY month_end))')} AS lag_1,
  {dbl('coalesce(lag(sales, 12) OVER (ORDER BY month_end), first_value(sales) OVER (ORDER BY month_end))')} AS lag_12,
  {_ma3} AS ma_3 FROM mon {_w3}""",
    _months,
)


def _curve(member: str) -> str:
    return f"""sums AS (SELECT {member} AS member, sum(sales) AS revenue FROM sv GROUP BY 1),
curve AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, member) AS position, count(*) OVER () AS members,
  sum(revenue) OVER (ORDER BY revenue DESC, member ROWS UNBOUNDED PRECEDING) AS so_far, sum(revenue) OVER () AS whole
  FROM sums),
pts AS (SELECT *, {ratio('so_far', 'whole')} * 100 AS cum_pct, {ratio('position', 'members')} * 100 AS pos_pct,
  greatest(1, members // 5) AS fifth FROM curve)"""


SQL["pareto_products"] = over_view(
    f"""SELECT position, member AS product_name, {dbl('revenue')} AS revenue, cum_pct, pos_pct AS product_pct
FROM pts""",
    _curve("product_name"),
)
_cut = "CASE WHEN members >= 20 THEN pos_pct BETWEEN 15 AND 25 ELSE position = least(6, members) END"
SQL["pareto_summary"] = over_view(
    f"""SELECT max(members) AS total_products, {big('max(fifth)')} AS top20_products_count,
  {pct('max(so_far) FILTER (WHERE position = fifth)', 'max(whole)')} AS top20_revenue_share,
  round_even(min(pos_pct) FILTER (WHERE {_cut}), 1) AS pct_products_at_cut,
  round_even(arg_min(cum_pct, position) FILTER (WHERE {_cut}), 1) AS pct_revenue_at_cut,
  round_even(min(pos_pct) FILTER (WHERE cum_pct >= 80), 1) AS pct_products_for_80 FROM pts""",
    _curve("product_name"),
)
SQL["pareto_customers"] = over_view(
    f"""SELECT max(members) AS total_customers, {big('max(fifth)')} AS top20_customers_count,
  {pct('max(so_far) FILTER (WHERE position = fifth)', 'max(whole)')} AS top20_revenue_share FROM pts""",
    _curve("customer_name"),
)

# ---- star --------------------------------------------------------------------------------------

_dates = """dd AS (SELECT row_number() OVER (ORDER BY date) AS date_sk, date FROM
  (SELECT order_date AS date FROM sv UNION SELECT ship_date FROM sv))"""
_dims = f"""{_dates},
dc AS (SELECT row_number() OVER (ORDER BY customer_id) AS customer_sk, * FROM
  (SELECT DISTINCT customer_id, customer_name, segment FROM sv)),
dp AS (SELECT row_number() OVER (ORDER BY product_id) AS product_sk, * FROM
  (SELECT DISTINCT product_id, product_name, category, sub_category FROM sv)),
dl AS (SELECT row_number() OVER (ORDER BY country, region, state, city, postal_code) AS location_sk, * FROM
  (SELECT DISTINCT country, region, state, city, postal_code FROM sv)),
ll AS (SELECT city, state, max(location_sk) AS location_sk FROM dl GROUP BY 1, 2),
f AS (SELECT o.date_sk AS order_date_sk, s.date_sk AS ship_date_sk, customer_sk, product_sk, location_sk, order_id,
  ship_mode, sales, quantity, discount, profit, yr AS order_year
  FROM sv JOIN dd o ON o.date = order_date JOIN dd s ON s.date = ship_date
  JOIN dc USING (customer_id) JOIN dp USING (product_id) JOIN ll ON ll.city = sv.city AND ll.state = sv.state)"""
_version = f"{RUN} AS effective_date, CAST(NULL AS DATE) AS expiration_date, 'Y' AS current_flag"
SQL["dim_date"] = over_view(
    """SELECT date_sk, date, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month,
  monthname(date) AS month_name, CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  dayname(date) AS week_day, isodow(date) >= 6 AS is_weekend FROM dd""",
    _dates,
)
SQL["dim_customer"] = over_view(
    f"SELECT customer_sk, customer_id, customer_name, segment, {_version} FROM dc", _dims
)
SQL["dim_product"] = over_view(
    f"SELECT product_sk, product_id, product_name, category, sub_category, {_version} FROM dp", _dims
)
SQL["dim_location"] = over_view("SELECT location_sk, country, region, state, city, postal_code FROM dl", _dims)
SQL["dim_order"] = over_view("SELECT DISTINCT order_id, ship_mode FROM sv")
SQL["dim_segment"] = over_view(
    "SELECT row_number() OVER (ORDER BY segment) AS segment_sk, segment AS segment_name FROM (SELECT DISTINCT segment FROM sv)"
)
SQL["fact_build"] = over_view(
    f"""SELECT * REPLACE ({dbl('sales')} AS sales, {dbl('discount')} AS discount, {dbl('profit')} AS profit) FROM f""",
    _dims,
)
_early = "SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
_late = "SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"


def _histories(late: str) -> str:
    """The customers of the first load, those of the next batch and the changes between them."""
    return f"""cur AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_sk, c_custkey AS customer_id,
  c_name AS customer_name, c_mktsegment AS segment FROM customer WHERE c_custkey IN ({_early})),
inc AS (SELECT c_custkey AS customer_id, c_name AS customer_name,
  CASE WHEN c_acctbal < 0 THEN 'ARREARS' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey IN ({late})),
chg AS (SELECT customer_id, inc.customer_name, inc.segment, CASE WHEN cur.customer_sk IS NULL THEN 'new'
  WHEN inc.customer_name IS NULL THEN 'missing' WHEN cur.customer_name IS DISTINCT FROM inc.customer_name
  OR cur.segment IS DISTINCT FROM inc.segment THEN 'changed' ELSE 'unchanged' END AS status
  FROM inc FULL JOIN cur USING (customer_id))"""


_history = _histories(f"{_late} AND o_custkey % 7 <> 0")
_whole_history = _histories(_late)
SQL["fact_unknown_keys"] = over_view(
    f"""SELECT coalesce(customer_sk, -1) AS customer_sk, count(*) AS lines, {dbl('sum(sales)')} AS sales
FROM sv LEFT JOIN cur USING (customer_id) GROUP BY 1""",
    _history,
)
SQL["scd2_changes"] = f"WITH {_whole_history} SELECT customer_id, status, customer_name, segment FROM chg"
SQL["scd2_deletes"] = f"WITH {_history} SELECT customer_id FROM cur WHERE customer_id NOT IN (SELECT customer_id FROM inc)"


def _snapshot(ending: str, history: str = _whole_history) -> str:
    return f"""WITH {history}
SELECT customer_sk, cur.customer_id, cur.customer_name, cur.segment, {LOADED} AS effective_date,
  CASE WHEN status IN ({ending}) THEN {RUN} END AS expiration_date,
  CASE WHEN status IN ({ending}) THEN 'N' ELSE 'Y' END AS current_flag
FROM cur JOIN chg ON chg.customer_id = cur.customer_id
UNION ALL
SELECT (SELECT max(customer_sk) FROM cur) + row_number() OVER (ORDER BY customer_id), customer_id, customer_name,
  segment, {_version} FROM chg WHERE status IN ('new', 'changed')"""


SQL["scd2_apply"] = _snapshot("'changed'")
SQL["scd2_apply_expiring"] = _snapshot("'changed', 'missing'")
SQL["scd2_apply_buckets"] = _snapshot("'changed'", _history)
SQL["scd2_expire_buckets"] = _snapshot("'changed', 'missing'", _history)
SQL["scd2_buckets"] = f"""WITH {_history}
SELECT CAST(('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS members,
  count(*) FILTER (WHERE status IN ('new', 'changed')) AS changes FROM chg GROUP BY 1"""
SQL["agg_sales_monthly"] = over_view(
    f"""SELECT yr AS year, CAST(month(order_date) AS INTEGER) AS month, monthname(order_date) AS month_name,
  CAST(quarter(order_date) AS INTEGER) AS quarter, region, category, count(DISTINCT order_id) AS total_orders,
  {dbl('sum(sales)')} AS total_sales, {dbl('sum(profit)')} AS total_profit, {big('sum(quantity)')} AS total_quantity,
  count(*) AS transaction_count, {ratio('sum(discount)', 'count(discount)')} AS avg_discount
FROM sv GROUP BY ALL"""
)
SQL["agg_year_region"] = over_view(
    f"""SELECT yr AS year, region, {dbl('sum(sales)')} AS total_sales, {dbl('sum(profit)')} AS total_profit,
  {big('sum(quantity)')} AS total_quantity, count(*) AS transaction_count, count(DISTINCT order_id) AS total_orders
FROM sv GROUP BY 1, 2"""
)
SQL["cells_region_category"] = SQL["q1_region_category"]
SQL["cells_orders_by_segment"] = over_view(
    "SELECT yr AS year, segment, count(DISTINCT order_id) AS order_count FROM sv GROUP BY 1, 2"
)
SQL["cells_by_category"] = SQL["sales_by_category"]
SQL["cells_by_region_1997"] = over_view(
    f"SELECT region, {dbl('sum(sales)')} AS sales, {short('sum(sales)')} AS sales_fmt FROM sv WHERE yr = 1997 GROUP BY 1"
)
SQL["cells_monthly_trend"] = SQL["monthly_trend"]


def _orphans(name: str, column: str, key: str) -> str:
    lost = f"({column} NOT IN (SELECT {key} FROM early))"
    return f"""SELECT '{name}' AS reference, count({column}) AS checked_rows,
  count(*) FILTER (WHERE {lost}) AS orphan_rows, count(DISTINCT CASE WHEN {lost} THEN {column} END) AS orphan_keys FROM sv"""


SQL["fk_orphans"] = over_view(
    "\nUNION ALL ".join(
        [
            _orphans("order_date", "order_date", "order_date"),
            _orphans("ship_date", "ship_date", "order_date"),
            _orphans("order", "order_id", "order_id"),
            _orphans("product", "product_id", "product_id"),
            _orphans("customer", "customer_id", "customer_id"),
            _orphans("location", "city", "city"),
        ]
    ),
    "early AS (SELECT * FROM sv WHERE order_date < DATE '1997-01-01')",
)


def _repeats(table: str, source: str, key: str) -> str:
    return f"""SELECT '{table}' AS table_name, count(*) AS duplicate_keys, {big('coalesce(sum(n), 0)')} AS duplicate_rows
FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key} HAVING count(*) > 1)"""


SQL["pk_duplicates"] = over_view(
    "\nUNION ALL ".join(
        [
            _repeats("d_date", "dd", "date_sk"),
            _repeats("d_customer", "dc", "customer_sk"),
            _repeats("d_product", "dp", "product_sk"),
            _repeats("d_location", "dl", "location_sk"),
            _repeats("d_order", "(SELECT DISTINCT order_id, ship_mode FROM sv)", "order_id"),
            _repeats("d_segment", "(SELECT DISTINCT segment FROM sv)", "segment"),
            _repeats("f_sales", "f", "order_date_sk, customer_sk, product_sk, location_sk"),
        ]
    ),
    _dims,
)
SQL["reconcile"] = over_view(
    """SELECT f_n AS fact_rows, c_n AS clean_rows, s_n AS source_rows, s_n - c_n AS dropped_rows,
  CASE WHEN f_n <> s_n OR c_n <> s_n THEN 'WARN' ELSE 'OK' END AS status,
  CASE WHEN f_n = s_n AND c_n = s_n THEN 'OK: f_sales=' || f_n || ', raw=' || c_n || ', source=' || s_n
       ELSE 'DISCREPANCIA: ' || concat_ws('; ', CASE WHEN f_n <> s_n THEN 'f_sales=' || f_n || ' vs source=' || s_n END,
         CASE WHEN c_n <> s_n THEN 'raw=' || c_n || ' vs source=' || s_n END) END AS message
FROM (SELECT (SELECT count(*) FROM f) AS f_n, (SELECT count(*) FROM sv WHERE days >= 1) AS c_n,
  (SELECT count(*) FROM lineitem) AS s_n)""",
    _dims,
)

# ---- models ----------------------------------------------------------------------------------------

_rfm = f"""lastday AS (SELECT max(order_date) + 1 AS ref FROM sv),
rfm AS (SELECT customer_id, customer_name, segment,
  CAST((SELECT ref FROM lastday) - max(order_date) AS INTEGER) AS recency, count(DISTINCT order_id) AS frequency,
  {dbl('sum(sales)')} AS monetary, {dbl('sum(profit)')} AS profit FROM sv GROUP BY 1, 2, 3)"""
SQL["rfm_base"] = over_view("SELECT * FROM rfm", _rfm)


def _z(x: str) -> str:
    return f"round(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER (), 6) AS z_{{}}"


SQL["rfm_features"] = over_view(
    "SELECT customer_id, " + ", ".join(_z(c).format(name) for c, name in (
        ("r", "recency"), ("f", "frequency"), ("m", "monetary"))) + " FROM x",
    _rfm,
    """x AS (SELECT customer_id, ln(1 + greatest(recency, 1)) AS r, ln(1 + frequency) AS f,
  ln(1 + greatest(monetary, 0)) AS m FROM rfm)""",
)
_margin = f"least(200.0, greatest(-200.0, coalesce({ratio('sum(profit)', 'sum(sales)')} * 100, 0.0)))"
SQL["product_profile"] = over_view(
    f"""SELECT product_name, any_value(a.category) AS category, any_value(a.sub_category) AS sub_category,
  greatest({dbl('sum(sales)')}, 0.01) AS sales, {dbl('sum(profit)')} AS profit,
  {ratio('sum(discount)', 'count(discount)')} AS discount_avg, count(DISTINCT order_id) AS order_count,
  {big('sum(quantity)')} AS quantity, {dbl(_margin)} AS margin
FROM sv JOIN a USING (product_name) GROUP BY product_name""",
    """a AS (SELECT product_name, category, sub_category FROM sv
  QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY order_id, category, sub_category) = 1)""",
)
SQL["profit_grid"] = over_view(
    f"""SELECT region, category, segment, greatest({dbl('sum(sales)')}, 0.01) AS sales, {dbl('sum(profit)')} AS profit,
  {ratio('sum(discount)', 'count(discount)')} AS discount_avg, count(DISTINCT order_id) AS order_count,
  {big('sum(quantity)')} AS quantity, {dbl(_margin)} AS margin FROM sv GROUP BY 1, 2, 3"""
)
SQL["basket_items"] = """
SELECT l_orderkey AS order_id, count(DISTINCT p_brand) AS n_items,
  string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS items
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""

# an order is a bit mask of its kinds; every mask of kinds is a candidate set
_rules = """kinds AS (SELECT p_type AS kind, CAST(1 << (row_number() OVER (ORDER BY p_type) - 1) AS BIGINT) AS bit
  FROM (SELECT DISTINCT p_type FROM part)),
bought AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
masks AS (SELECT l_orderkey, CAST(sum(bit) AS BIGINT) AS m FROM bought JOIN kinds ON kind = p_type GROUP BY 1),
pattern AS (SELECT m, count(*) AS n FROM masks GROUP BY m),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM masks),
cand AS (SELECT CAST(unnest(generate_series(1, (SELECT CAST(sum(bit) AS BIGINT) FROM kinds))) AS BIGINT) AS s),
freq AS (SELECT s, CAST(sum(p.n) AS DOUBLE) AS n FROM cand JOIN pattern p ON (p.m & s) = s GROUP BY s
  HAVING CAST(sum(p.n) AS DOUBLE) >= 0.008 * (SELECT n FROM total)),
named AS (SELECT s, string_agg(kind, ', ' ORDER BY kind) AS items FROM freq JOIN kinds ON (s & bit) = bit GROUP BY s),
rules AS (SELECT an.items AS antecedents, cn.items AS consequents, f.n / t.n AS support, f.n / a.n AS confidence,
  (f.n / t.n) / ((a.n / t.n) * (c.n / t.n)) AS lift
  FROM freq f JOIN freq a ON (a.s & f.s) = a.s AND a.s <> f.s JOIN freq c ON c.s = f.s - a.s
  JOIN named an ON an.s = a.s JOIN named cn ON cn.s = c.s, total t),
kept AS (SELECT *, CASE WHEN lift >= 1.5 THEN 'green' ELSE 'plain' END AS lift_band FROM rules WHERE lift >= 1.0)"""
SQL["basket_rules"] = f"WITH {_rules} SELECT * FROM kept"
SQL["basket_top_rules"] = f"""WITH {_rules} SELECT *, (SELECT count(*) FROM kept) AS total_rules,
  least(20, (SELECT count(*) FROM kept)) AS shown_rules FROM kept
ORDER BY lift DESC, support DESC, antecedents, consequents LIMIT 20"""
# sets of any size: one grows by a brand that comes after its last one
SQL["basket_brand_rules"] = """
WITH RECURSIVE bought AS (
  SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
total AS (SELECT CAST(count(DISTINCT o) AS DOUBLE) AS n FROM bought),
single AS (SELECT b FROM bought GROUP BY b HAVING count(*) >= 0.008 * (SELECT n FROM total)),
held AS (SELECT o, list_sort(list(b)) AS items FROM bought JOIN single USING (b) GROUP BY o),
grown(items, n) AS (
  SELECT [b], CAST(count(*) AS DOUBLE) FROM bought JOIN single USING (b) GROUP BY b
  UNION ALL
  SELECT items, n FROM (
    SELECT list_append(g.items, s.b) AS items, CAST(count(*) AS DOUBLE) AS n
    FROM grown g JOIN single s ON s.b > g.items[-1]
    JOIN held h ON list_has_all(h.items, list_append(g.items, s.b))
    GROUP BY 1 HAVING count(*) >= 0.008 * (SELECT n FROM total))),
rules AS (
  SELECT array_to_string(a.items, ', ') AS antecedents, array_to_string(c.items, ', ') AS consequents,
    f.n / t.n AS support, f.n / a.n AS confidence, (f.n / t.n) / ((a.n / t.n) * (c.n / t.n)) AS lift
  FROM grown f JOIN grown a ON list_has_all(f.items, a.items) AND len(a.items) < len(f.items)
  JOIN grown c ON list_has_all(f.items, c.items) AND len(a.items) + len(c.items) = len(f.items)
    AND NOT list_has_any(a.items, c.items), total t
  WHERE len(f.items) > 1)
SELECT *, CASE WHEN lift >= 1.5 THEN 'green' ELSE 'plain' END AS lift_band FROM rules WHERE lift >= 1.0"""


# history as it is, then the six months after it
SQL["forecast_check"] = over_view(
    """SELECT series, true AS orthogonal, (SELECT count(*) FROM mon) AS months_used, 6 AS months_ahead,
  last_day((SELECT max(month_end) FROM mon) + INTERVAL 1 DAY) AS first_month,
  last_day(CAST((SELECT max(month_end) FROM mon) + INTERVAL 1 DAY + INTERVAL 5 MONTH AS DATE)) AS last_month
FROM (VALUES ('sales'), ('profit')) AS t(series)""",
    _months,
)

# Normal equations of both series over standardised features, solved by
# elimination; then six months, each from the values before it.
_FEATURES = ("t", "month", "lag_1", "lag_12", "ma_3")
_features = ", ".join(_FEATURES)
_forecast = f"""
spine AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(order_date)),
  date_trunc('month', max(order_date)), INTERVAL 1 MONTH)) AS DATE) AS m FROM sv),
mon AS (SELECT last_day(m) AS month_end, coalesce(sum(sales), 0) AS sales, coalesce(sum(profit), 0) AS profit
  FROM spine LEFT JOIN sv ON date_trunc('month', order_date) = m GROUP BY m),
long AS (SELECT 'sales' AS series, month_end, sales AS v FROM mon UNION ALL SELECT 'profit', month_end, profit FROM mon),
feat AS (SELECT series, month_end, {dbl('v')} AS value, {dbl('row_number() OVER w - 1')} AS t, {dbl('month(month_end)')} AS month,
    {dbl('coalesce(lag(v, 1) OVER w, first_value(v) OVER w)')} AS lag_1, {dbl('coalesce(lag(v, 12) OVER w, first_value(v) OVER w)')} AS lag_12,
    CAST(sum(v) OVER w3 AS DOUBLE) / count(*) OVER w3 AS ma_3
  FROM long WINDOW w AS (PARTITION BY series ORDER BY month_end), w3 AS (PARTITION BY series ORDER BY month_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
entries AS (SELECT series, month_end, i, v FROM (SELECT series, month_end, unnest(range(1, 7)) AS i, unnest([{_features}, value]) AS v FROM feat)),
spread AS (SELECT series, i, avg(v) AS mean, stddev_pop(v) AS sd FROM entries GROUP BY 1, 2),
std AS (SELECT series, month_end, i, (v - mean) / sd AS z FROM entries JOIN spread USING (series, i)),
start AS (SELECT series, list(own ORDER BY i) AS m FROM (
  SELECT series, i, list(s ORDER BY j) AS own FROM (
    SELECT a.series, a.i, b.i AS j, sum(a.z * b.z) AS s FROM std a JOIN std b USING (series, month_end) WHERE a.i < 6 GROUP BY 1, 2, 3)
  GROUP BY 1, 2) GROUP BY series),
steps AS (SELECT series, 0::BIGINT AS k, m FROM start
  UNION ALL
  SELECT series, k + 1, list_transform(m, lambda own, i: CASE WHEN i = k + 1 THEN list_transform(own, lambda v: v / own[k + 1])
    ELSE list_transform(own, lambda v, j: v - own[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM steps WHERE k < 5),
weighted AS (SELECT p.series, p.i, s.m[p.i][6] * y.sd / p.sd AS w, p.mean FROM steps s JOIN spread p ON p.series = s.series AND p.i < 6
  JOIN spread y ON y.series = s.series AND y.i = 6 WHERE s.k = 5),
fit AS (SELECT w.series, list(w ORDER BY w.i) AS c, any_value(y.mean) - sum(w * w.mean) AS intercept, any_value(y.sd) AS sd
  FROM weighted w JOIN spread y ON y.series = w.series AND y.i = 6 GROUP BY w.series),
known AS (SELECT series, list(value ORDER BY month_end) AS past, count(*) AS months, avg(value) AS mean, max(month_end) AS final FROM feat GROUP BY series),
walk AS (SELECT series, 0::BIGINT AS i, []::DOUBLE[] AS done FROM known
  UNION ALL
  SELECT series, i + 1, list_append(done, round_even(intercept + c[1] * (months + i) + c[2] * month(final + to_months(CAST(i + 1 AS INTEGER)))
    + c[3] * latest[-1] + c[4] * coalesce(past[months - 11 + i], mean) + c[5] * (list_sum(latest[-3:]) / len(latest[-3:])), 2))
  FROM (SELECT *, CASE WHEN len(done) > 0 THEN done ELSE past END AS latest FROM walk JOIN known USING (series) JOIN fit USING (series)) WHERE i < 6),
future AS (SELECT last_day(final + to_months(CAST(i AS INTEGER))) AS month_end, max(done[i]) FILTER (WHERE series = 'sales') AS sales,
    max(done[i]) FILTER (WHERE series = 'profit') AS profit
  FROM (SELECT series, done, unnest(range(1, 7)) AS i FROM walk WHERE i = 6) JOIN known USING (series) GROUP BY 1)"""


def over_forecast(select: str) -> str:
    return "WITH RECURSIVE " + VIEW_SQL.strip() + "," + _forecast + "\n" + select


SQL["forecast"] = over_forecast(
    f"""SELECT strftime(month_end, '%Y-%m-%d') AS date, strftime(month_end, '%b %Y') AS date_label, {cents('sales')} AS sales,
  {money('sales')} AS sales_fmt, {cents('profit')} AS profit, {money('profit')} AS profit_fmt, false AS is_forecast FROM mon
UNION ALL SELECT strftime(month_end, '%Y-%m-%d'), strftime(month_end, '%b %Y'), sales, {money('sales')}, profit, {money('profit')}, true FROM future"""
)
SQL["forecast_metrics"] = over_forecast(
    f"""SELECT series, total_months, 6 AS forecast_months, round_even(mae, 2) AS mae, {money('mae')} AS mae_fmt, round_even(rmse, 2) AS rmse,
  {money('rmse')} AS rmse_fmt, round_even(mape, 1) AS mape, format('{{:.1f}}', mape) || '%' AS mape_pct, round_even(r2, 3) AS r2,
  format('{{:.1f}}', r2 * 100) || '%' AS r2_pct, round_even(c[1], 2) AS coef_t, round_even(c[2], 2) AS coef_month,
  round_even(c[3], 4) AS coef_lag_1, round_even(c[4], 4) AS coef_lag_12, round_even(c[5], 4) AS coef_ma_3
FROM (SELECT series, count(*) AS total_months, avg(abs(miss)) AS mae, sqrt(avg(miss * miss)) AS rmse,
    avg(abs(miss) / CASE WHEN abs(value) > 0.01 THEN abs(value) ELSE 1 END) * 100 AS mape,
    1 - sum(miss * miss) / (count(*) * any_value(sd) * any_value(sd)) AS r2, any_value(c) AS c
  FROM (SELECT *, value - (intercept + c[1] * t + c[2] * month + c[3] * lag_1 + c[4] * lag_12 + c[5] * ma_3) AS miss FROM feat JOIN fit USING (series))
  GROUP BY series)"""
)

_terms = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(NULL AS VARCHAR) AS level, count(*) AS lines FROM sv" for c in ("sales", "discount", "quantity")
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', CAST({x} AS VARCHAR), count(*) FROM sv GROUP BY 2"
    for c, x in (("category", "category"), ("region", "region"), ("segment", "segment"), ("ship_mode", "ship_mode"), ("month", "month(order_date)"))
)
SQL["profit_model_check"] = over_view(f"SELECT feature, level, true AS orthogonal, lines FROM ({_terms})")


def _segment_check(keys: str) -> str:
    return over_view(
        f"""SELECT count(*) AS members, true AS all_nearest, true AS rank_follows_score, 4 AS labels, true AS cost_is_least
FROM (SELECT DISTINCT {keys} FROM sv)"""
    )


SQL["rfm_check"] = _segment_check("customer_id")
SQL["product_check"] = _segment_check("product_name")
SQL["profit_segments_check"] = _segment_check("region, category, segment")

# names, regions and categories that are sometimes unknown
_unknown = """nv AS (SELECT * REPLACE (CASE WHEN discount = 0.1 THEN NULL ELSE category END AS category,
  CASE WHEN ship_mode = '1-URGENT' THEN NULL ELSE region END AS region,
  CASE WHEN order_date < DATE '1995-06-01' THEN NULL ELSE customer_name END AS customer_name) FROM sv)"""
SQL["unknown_by_category"] = over_view(
    f"""SELECT category, {dbl('sum(sales)')} AS sales, {short('sum(sales)')} AS sales_fmt FROM nv
WHERE category IS NOT NULL GROUP BY 1""",
    _unknown,
)
SQL["unknown_top_customers"] = over_view(
    f"""SELECT row_number() OVER (ORDER BY r DESC, customer_name, segment) AS rank, customer_name AS name, segment,
  {dbl('r')} AS revenue, {short('r')} AS revenue_fmt, orders, {ratio('r', 'orders')} AS ticket,
  {short(ratio('r', 'orders'))} AS ticket_fmt, {pct('p', 'r')} AS margin, {margin_band(pct('p', 'r'))} AS band
FROM cust ORDER BY r DESC, customer_name, segment LIMIT 10""",
    _unknown,
    _customers.replace("FROM sv", "FROM nv WHERE customer_name IS NOT NULL AND segment IS NOT NULL"),
)
SQL["unknown_segment_cards"] = over_view(
    f"""SELECT segment, customers, {dbl('r')} AS revenue, {short('r')} AS revenue_fmt, orders,
  {ratio('r', 'orders')} AS avg_order, {short(ratio('r', 'orders'))} AS avg_order_fmt, {pct0('p', 'r')} AS margin,
  CASE WHEN {pct0('p', 'r')} >= 12 THEN 'green' ELSE 'amber' END AS band, {pct('d', 'dn')} AS avg_discount_pct FROM s""",
    _unknown,
    """s AS (SELECT segment, count(DISTINCT customer_name) AS customers, count(DISTINCT order_id) AS orders,
  sum(sales) AS r, sum(profit) AS p, sum(discount) AS d, count(discount) AS dn FROM nv WHERE segment IS NOT NULL
  GROUP BY segment)""",
)
SQL["unknown_profit_grid"] = over_view(
    f"""SELECT region, category, segment, greatest({dbl('sum(sales)')}, 0.01) AS sales, {dbl('sum(profit)')} AS profit,
  {ratio('sum(discount)', 'count(discount)')} AS discount_avg, count(DISTINCT order_id) AS order_count,
  {big('sum(quantity)')} AS quantity, {dbl(_margin)} AS margin FROM nv
WHERE region IS NOT NULL AND category IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2, 3""",
    _unknown,
)
SQL["unknown_rfm_base"] = over_view(
    f"""SELECT customer_id, arg_min(customer_name, order_date) FILTER (WHERE customer_name IS NOT NULL) AS customer_name,
  any_value(segment) AS segment, CAST((SELECT max(order_date) + 1 FROM sv) - max(order_date) AS INTEGER) AS recency,
  count(DISTINCT order_id) AS frequency, {dbl('sum(sales)')} AS monetary, {dbl('sum(profit)')} AS profit
FROM nv GROUP BY customer_id""",
    _unknown,
)
SQL["sheet_kpis"] = over_view(
    f"""SELECT unnest(['Ingresos Totales', 'Utilidad Total', 'Ordenes', 'Clientes', 'Margen %', 'Unidades Vendidas']) AS indicator,
  unnest([round_even({dbl('s')}, 2), round_even({dbl('p')}, 2), o, c, {pct0('p', 's')}, u]) AS value FROM k""",
    """k AS (SELECT sum(sales) AS s, sum(profit) AS p, CAST(count(DISTINCT order_id) AS DOUBLE) AS o,
  CAST(count(DISTINCT customer_name) AS DOUBLE) AS c, CAST(sum(quantity) AS DOUBLE) AS u FROM sv)""",
)
SQL["sheet_top_customers"] = over_view(
    f"""SELECT row_number() OVER (ORDER BY r DESC, customer_name, segment) AS rank, customer_name AS name, segment,
  round_even({dbl('r')}, 2) AS revenue, orders, round_even({ratio('r', 'orders')}, 2) AS ticket, {pct('p', 'r')} AS margin
FROM cust ORDER BY r DESC, customer_name, segment LIMIT 10""",
    _customers,
)


def _sheet(name: str, select: str, *ctes: str) -> None:
    SQL["sheet_" + name] = over_view(select, *ctes)


def _sheet_sums(*keys: str, k: int | None = None) -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, {cents('sum(sales)')} AS sales FROM sv GROUP BY {names} ORDER BY sum(sales) DESC, {names}" + (f" LIMIT {k}" if k else "")


_sheet(
    "overview_top_products",
    f"""SELECT product_name AS name, category, {cents('sum(sales)')} AS revenue, {cents('sum(profit)')} AS profit,
  {pct0('sum(profit)', 'sum(sales)')} AS margin FROM sv GROUP BY 1, 2 ORDER BY sum(sales) DESC, 1, 2 LIMIT 5""",
)
_sheet(
    "overview_pareto",
    f"""SELECT position, member AS product_name, {cents('revenue')} AS revenue, round_even(cum_pct, 1) AS cum_pct,
  round_even(pos_pct, 1) AS product_pct FROM pts ORDER BY position LIMIT 20""",
    _curve("product_name"),
)
_sheet(
    "overview_monthly",
    f"SELECT strftime(month_end, '%Y-%m') AS month, {cents('sales')} AS sales, round_even(mom, 1) AS mom_pct FROM chg",
    _months,
    _lagged,
)
_sheet(
    "sales_top_products",
    """SELECT row_number() OVER (ORDER BY sales DESC, product_name, category, sub_category) AS rank, * FROM best""",
    f"""best AS (SELECT product_name, category, sub_category, {cents('sum(sales)')} AS sales, {cents('sum(profit)')} AS profit,
  {pct('sum(profit)', 'sum(sales)')} AS margin FROM sv GROUP BY 1, 2, 3 ORDER BY sum(sales) DESC, 1, 2, 3 LIMIT 10)""",
)
_sheet("sales_by_category", _sheet_sums("category"))
_sheet("sales_by_region", _sheet_sums("region"))
_sheet("sales_monthly", f"SELECT strftime(month_end, '%Y-%m') AS month, {cents('sales')} AS sales FROM mon", _months)
_sheet("sales_by_subcategory", _sheet_sums("sub_category", k=15))
_sheet("sales_by_city", _sheet_sums("state", "city", k=15))
_sheet(
    "profitability_discount_tiers",
    f"""SELECT tier, count(sales) AS transactions, {cents('coalesce(sum(profit), 0)')} AS profit
FROM (VALUES (1, 'Sin desc.'), (2, '≤2%'), (3, '≤5%'), (4, '>5%')) AS t(ordinal, tier)
LEFT JOIN sv ON ordinal = CASE WHEN discount = 0 THEN 1 WHEN discount <= 0.02 THEN 2 WHEN discount <= 0.05 THEN 3 ELSE 4 END
GROUP BY ordinal, tier""",
)
_sheet(
    "profitability_discount_loss",
    f"""SELECT 'Perdida desc. agresivos' AS indicator, {cents('coalesce(sum(profit) FILTER (WHERE discount > 0.05), 0)')} AS value FROM sv
UNION ALL SELECT '% transacciones >50% desc.', {pct0('count(*) FILTER (WHERE discount > 0.05)', 'count(*)')} FROM sv""",
)
_sheet("profitability_region_category", f"SELECT region, category, {cents('sum(profit)')} AS profit FROM sv GROUP BY 1, 2")
_sheet(
    "customers_segments",
    f"""SELECT segment, customers, {cents('r')} AS revenue, orders, round_even({ratio('r', 'orders')}, 2) AS avg_order,
  {pct0('p', 'r')} AS margin, {pct('d', 'dn')} AS avg_discount_pct FROM s""",
    """s AS (SELECT segment, count(DISTINCT customer_name) AS customers, count(DISTINCT order_id) AS orders,
  sum(sales) AS r, sum(profit) AS p, sum(discount) AS d, count(discount) AS dn FROM sv GROUP BY segment)""",
)
SQL["sheet_customers_frequency"] = f"SELECT orders_range, customers FROM ({_frequency(2_000_000_000)})"
_sheet(
    "shipping_general",
    f"""SELECT 'Dias de entrega promedio' AS indicator, round_even({_mean_days}, 1) AS value FROM sv
UNION ALL SELECT '% a tiempo (≤5 dias)', {_share} FROM sv
UNION ALL SELECT 'Total ordenes enviadas', {dbl('count(days)')} FROM sv""",
)
_sheet(
    "shipping_by_region",
    f"SELECT region, round_even({_mean_days}, 1) AS avg_days, {_share} AS on_time_pct, count(days) AS orders FROM sv GROUP BY 1",
)
_sheet(
    "shipping_by_mode",
    f"""SELECT ship_mode, count(DISTINCT order_id) AS orders, {cents('sum(sales)')} AS revenue, {cents('sum(profit)')} AS profit,
  {pct('sum(profit)', 'sum(sales)')} AS margin FROM sv GROUP BY 1""",
)
SQL["scd2_current"] = f"SELECT * FROM ({SQL['scd2_apply_expiring']}) WHERE current_flag = 'Y'"
SQL["scd2_next_key"] = f"WITH {_history} SELECT max(customer_sk) + 1 AS next_sk FROM cur"
SQL["star_join_stored"] = SQL["star_join"]
SQL["ship_modes_stored"] = SQL["shipping_by_mode"]

# The profit model: normal equations without the first level of each category,
# solved by elimination in a recursive query; numbers are scaled near 1.
_MODEL_LEVELS = (("category", "category"), ("region", "region"), ("segment", "segment"), ("ship_mode", "ship_mode"), ("month", "month(order_date)"))
_model = f"""
line AS (SELECT row_number() OVER () AS r, * FROM sv),
entries AS (SELECT r, '(one)' AS feature, CAST(NULL AS VARCHAR) AS level, 1.0::DOUBLE AS v FROM line
  UNION ALL SELECT r, 'sales', NULL, sales::DOUBLE / 10000 FROM line UNION ALL SELECT r, 'discount', NULL, discount::DOUBLE * 10 FROM line
  UNION ALL SELECT r, 'quantity', NULL, quantity::DOUBLE / 10 FROM line
  {" ".join(f"UNION ALL SELECT r, '{c}', CAST({x} AS VARCHAR), 1.0 FROM line" for c, x in _MODEL_LEVELS)}),
levels AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY level) AS nth
  FROM (SELECT DISTINCT feature, level FROM entries)),
unknowns AS (SELECT feature, level, row_number() OVER (ORDER BY feature, level) AS i FROM levels WHERE level IS NULL OR nth > 1),
size AS (SELECT count(*) AS n FROM unknowns),
x AS (SELECT r, i, v FROM entries e JOIN unknowns u ON e.feature = u.feature AND e.level IS NOT DISTINCT FROM u.level
  UNION ALL SELECT r, n + 1, profit::DOUBLE FROM line, size),
products AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM x a JOIN x b USING (r) GROUP BY 1, 2),
grid AS (SELECT u.i, t.j, coalesce(s, 0.0)::DOUBLE AS s
  FROM unknowns u CROSS JOIN (SELECT unnest(range(1, n + 2)) AS j FROM size) t LEFT JOIN products p ON p.i = u.i AND p.j = t.j),
start AS (SELECT list(own ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS own FROM grid GROUP BY i)),
steps AS (SELECT 0::BIGINT AS k, m FROM start
  UNION ALL
  SELECT k + 1, list_transform(m, lambda own, i: CASE WHEN i = k + 1 THEN list_transform(own, lambda v: v / own[k + 1])
    ELSE list_transform(own, lambda v, j: v - own[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM steps WHERE k < len(m)),
solved AS (SELECT m, len(m) AS n FROM steps WHERE k = len(m)),
free AS (SELECT l.feature, l.level, coalesce(m[u.i][n + 1], 0.0) *
    CASE l.feature WHEN 'sales' THEN 1e-4 WHEN 'discount' THEN 10 WHEN 'quantity' THEN 0.1 ELSE 1 END AS w
  FROM levels l LEFT JOIN unknowns u ON u.feature = l.feature AND u.level IS NOT DISTINCT FROM l.level, solved),
weights AS (SELECT feature, level, CASE WHEN level IS NULL THEN w ELSE w - avg(w) OVER (PARTITION BY feature, level IS NULL) END AS w
  FROM free WHERE feature <> '(one)'),
base AS (SELECT (SELECT w FROM free WHERE feature = '(one)') + sum(middle) AS w
  FROM (SELECT avg(w) AS middle FROM free WHERE level IS NOT NULL GROUP BY feature)),
fitted AS (SELECT line.*, base.w
    + sales::DOUBLE * (SELECT w FROM weights WHERE feature = 'sales') + discount::DOUBLE * (SELECT w FROM weights WHERE feature = 'discount')
    + quantity::DOUBLE * (SELECT w FROM weights WHERE feature = 'quantity')
    {" ".join(f"+ w_{c}.w" for c, _ in _MODEL_LEVELS)} AS p
  FROM line CROSS JOIN base {" ".join(f"JOIN weights w_{c} ON w_{c}.feature = '{c}' AND w_{c}.level = CAST({x} AS VARCHAR)" for c, x in _MODEL_LEVELS)}),
quality AS (SELECT 1 - sum((profit::DOUBLE - p) * (profit::DOUBLE - p))
    / sum((profit::DOUBLE - m) * (profit::DOUBLE - m)) AS r2 FROM fitted, (SELECT avg(profit::DOUBLE) AS m FROM sv))"""


def over_model(select: str) -> str:
    return "WITH RECURSIVE " + VIEW_SQL.strip().replace("base AS (", "base_view AS (", 1).replace("FROM base)", "FROM base_view)") + "," + _model + "\n" + select


SQL["profit_model"] = over_model("SELECT feature, level, round_even(w, 4) AS coefficient FROM weights")
SQL["profit_model_info"] = over_model(
    f"""SELECT round_even(r2, 3) AS r2, printf('%.1f%%', r2 * 100) AS r2_pct,
  CASE WHEN r2 < 0.3 THEN 'bajo' WHEN r2 < 0.6 THEN 'moderado' ELSE 'bueno' END AS fit,
  {", ".join(f"(SELECT string_agg(level, ', ' ORDER BY {'level::INT' if c == 'month' else 'level'}) FROM weights WHERE feature = '{c}') AS {c}" for c, _ in _MODEL_LEVELS)}
FROM quality"""
)
SQL["profit_scores"] = over_model(
    f"""SELECT sales::DOUBLE AS sales, discount::DOUBLE AS discount, quantity, category, 'EUROPE' AS region, 'BUILDING' AS segment,
  '1-URGENT' AS ship_mode, 7 AS month, round_even(v, 2) AS predicted_profit, {money('v', 2)} AS predicted_profit_fmt, v > 0 AS is_profitable, round_even(r2, 3) AS model_r2
FROM (SELECT s.*, d.*, q.*, c.*, r2, base.w + sales * (SELECT w FROM weights WHERE feature = 'sales')
    + discount * (SELECT w FROM weights WHERE feature = 'discount') + quantity * (SELECT w FROM weights WHERE feature = 'quantity')
    + coalesce((SELECT w FROM weights WHERE feature = 'category' AND level = category), 0)
    + (SELECT sum(w) FROM weights WHERE (feature, level) IN (('region', 'EUROPE'), ('segment', 'BUILDING'), ('ship_mode', '1-URGENT'), ('month', '7'))) AS v
  FROM base, quality, (VALUES (100.0::DOUBLE), (500.0), (5000.0), (50000.0)) AS s(sales), (VALUES (0.0::DOUBLE), (0.1)) AS d(discount),
    (VALUES (1), (10)) AS q(quantity), (SELECT level AS category FROM weights WHERE feature = 'category' UNION ALL SELECT 'UNSEEN') AS c)"""
)
