"""One SQL text per registered query."""

from .shop import SHOP, big, dbl, div, pct, r, sig

LATE = "COUNT(*) FILTER (WHERE late)"
LATE_RATE = pct(LATE, "COUNT(late)")
DAY = "86400000000.0::DOUBLE"


def days(total: str, n: str) -> str:
    return f"({dbl(total)} / 1000000.0::DOUBLE / 86400.0::DOUBLE / {n})"


def text(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


_STATE_PERFORMANCE = f"""
  SELECT state AS customer_state, {big('COUNT(*)')} AS delivered_orders,
         {r(LATE_RATE)} AS late_rate_pct,
         {r(days('SUM(micros)', 'COUNT(*)'))} AS avg_delivery_days,
         {r(div('SUM(score)', 'COUNT(score)'))} AS avg_review_score
  FROM scored JOIN shoppers USING (ck) GROUP BY state HAVING COUNT(*) >= 100
"""

_BUFFER = f"""
  SELECT mon, {div('SUM(buffer)', 'COUNT(buffer)')} AS buffer, {LATE_RATE} AS late_rate
  FROM windowed GROUP BY mon
"""

_PURCHASE_QUARTER = f"""
  SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter,
         {big('COUNT(*)')} AS all_orders, {dbl('SUM(gmv)')} AS all_orders_gmv,
         {big("COUNT(*) FILTER (WHERE st = 'delivered')")} AS delivered_orders,
         {dbl("SUM(gmv) FILTER (WHERE st = 'delivered')")} AS delivered_gmv
  FROM shop_orders LEFT JOIN order_value USING (k)
  WHERE ts >= DATE '2000-10-01' AND ts < DATE '2001-04-01' GROUP BY 1
"""

_DELIVERY_QUARTER = f"""
  SELECT CAST(date_trunc('quarter', arrived) AS DATE) AS quarter,
         {big('COUNT(*)')} AS delivered_orders, {dbl('SUM(gmv)')} AS delivered_gmv
  FROM done JOIN order_value USING (k)
  WHERE arrived >= DATE '2000-10-01' AND arrived < DATE '2001-04-01' GROUP BY 1
"""

_CATEGORY = f"""
  SELECT category, {big('orders')} AS orders, {r(pct('late_orders', 'orders'))} AS late_rate_pct,
         (SELECT {r(div('SUM(p.weight)', 'COUNT(p.weight)'))}
          FROM products p WHERE p.english = c.category) AS avg_weight_g,
         total_gmv
  FROM (
    SELECT category, COUNT(*) AS orders, {LATE} AS late_orders, {dbl('SUM(gmv)')} AS total_gmv
    FROM (
      SELECT p.english AS category, i.k, SUM(i.price + i.freight) AS gmv
      FROM items i JOIN products p USING (pk) GROUP BY p.english, i.k
    ) JOIN done USING (k)
    GROUP BY category
  ) c
  WHERE orders >= 30
"""


def _period_counts(extra: str = "") -> str:
    return f"""
  SELECT half{extra}, COUNT(*) AS orders, COUNT(score) AS reviewed,
         COUNT(*) FILTER (WHERE score <= 2) AS low, {LATE} AS late_orders
  FROM halves GROUP BY half{extra}
"""


_TWO_PERIODS = f"""
  SELECT MAX(low) FILTER (WHERE half = 2000) AS x0, MAX(reviewed) FILTER (WHERE half = 2000) AS n0,
         MAX(low) FILTER (WHERE half = 2001) AS x1, MAX(reviewed) FILTER (WHERE half = 2001) AS n1
  FROM ({_period_counts()})
"""


def _null_counts(table: str, source: str, columns: dict[str, str]) -> str:
    """Null counts of several columns in one pass, as one row per column."""
    counts = ", ".join(
        f"COUNT(*) FILTER (WHERE {expr} IS NULL) AS c{i}" for i, expr in enumerate(columns.values())
    )
    rows = ", ".join(f"('{name}', c{i})" for i, name in enumerate(columns))
    return f"""
  SELECT '{table}' AS table_name, v.column_name, {big('total')} AS row_count,
         {big('v.nulls')} AS null_count
  FROM (SELECT COUNT(*) AS total, {counts} FROM {source}) s,
       LATERAL (VALUES {rows}) v(column_name, nulls)
"""


def _null_groups(table: str, source: str, columns: dict[str, str]) -> str:
    """Columns with the same list of NULL patterns."""
    pattern = " || ".join(f"CASE WHEN {expr} IS NULL THEN '1' ELSE '0' END" for expr in columns.values())
    names = ", ".join(f"'{name}'" for name in columns)
    return f"""
  SELECT '{table}' AS table_name, string_agg(column_name, ', ' ORDER BY i) AS column_names,
         {big('any_value(nulls)')} AS null_count
  FROM (SELECT i, [{names}][i] AS column_name, SUM(n) AS nulls, list(pattern ORDER BY pattern) AS patterns
        FROM (SELECT {pattern} AS pattern, COUNT(*) AS n FROM {source} GROUP BY 1),
             range(1, {len(columns) + 1}) places(i)
        WHERE pattern[i] = '1' GROUP BY i)
  GROUP BY patterns HAVING COUNT(*) > 1
"""


def _determines(table: str, one: str, other: str) -> str:
    """Whether each value of a column stands with one value of another, and the other way round."""
    source, columns = _COLUMNS[table]
    a, b = columns[one], columns[other]
    known = f"FROM (SELECT {a} AS a, {b} AS b FROM {source}) WHERE a IS NOT NULL AND b IS NOT NULL"
    return f"""
  SELECT '{table}' AS table_name, '{one}' AS determinant, '{other}' AS dependent,
         {big('n')} AS distinct_values, other_way AS both_ways
  FROM (SELECT COUNT(DISTINCT a) AS n, COUNT(DISTINCT a) = COUNT(DISTINCT (a, b)) AS this_way,
               COUNT(DISTINCT b) = COUNT(DISTINCT (a, b)) AS other_way {known})
  WHERE this_way AND n > 0
"""


# Shop columns by table: name in the result and the SQL expression behind it.
_COLUMNS = {
    "customers": ("shoppers", {
        "customer_id": "ck", "customer_unique_id": "ck - ck % 2", "customer_zip_code_prefix": "zip",
        "customer_city": "city", "customer_state": "state",
    }),
    "sellers": ("shops", {
        "seller_id": "sk", "seller_zip_code_prefix": "zip", "seller_city": "city",
        "seller_state": "state",
    }),
    "products": ("raw_products", {
        "product_id": "pk", "product_category_name": "category",
        "product_name_lenght": "name_length", "product_description_lenght": "description_length",
        "product_photos_qty": "photos", "product_weight_g": "weight", "product_length_cm": "len",
        "product_height_cm": "height", "product_width_cm": "width",
    }),
    "category_translation": ("translation", {
        "product_category_name": "category", "product_category_name_english": "english",
    }),
    "orders": ("shop_orders", {
        "order_id": "k", "customer_id": "ck", "order_status": "st",
        "order_purchase_timestamp": "ts", "order_approved_at": "approved",
        "order_delivered_carrier_date": "carrier", "order_delivered_customer_date": "arrived",
        "order_estimated_delivery_date": "promised",
    }),
    "order_items": ("items", {
        "order_id": "k", "order_item_id": "line", "product_id": "pk", "seller_id": "sk",
        "shipping_limit_date": "ship_limit", "price": "price", "freight_value": "freight",
    }),
    "order_payments": ("payments", {
        "order_id": "k", "payment_sequential": "n", "payment_type": "kind",
        "payment_installments": "installments", "payment_value": "paid",
    }),
    "order_reviews": ("all_reviews", {
        "review_id": "review_id", "order_id": "k", "review_score": "score",
        "review_comment_title": "title", "review_comment_message": "message",
        "review_creation_date": "created", "review_answer_timestamp": "answered",
    }),
    "geolocation": ("shoppers", {
        "geolocation_zip_code_prefix": "zip", "geolocation_lat": "ck", "geolocation_lng": "ck",
        "geolocation_city": "city", "geolocation_state": "state",
    }),
}

_REQUIRED = {
    "customers": ["customer_id", "customer_unique_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "category_translation": ["product_category_name"],
    "orders": ["order_id", "customer_id", "order_status"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price",
                    "freight_value"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["order_id", "review_score"],
}

_KEYS = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "category_translation": ["product_category_name"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["order_id"],
}

_REFERENCES = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _key_check(table: str) -> str:
    source, columns = _COLUMNS[table]
    key = _KEYS[table]
    exprs = ", ".join(columns[c] for c in key)
    return f"""
  SELECT '{table}' AS table_name, '{', '.join(key)}' AS key_columns,
         {big('COUNT(*) FILTER (WHERE n > 1)')} AS repeated_keys,
         {big('COALESCE(SUM(n), 0) - COUNT(*)')} AS extra_rows
  FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {exprs})
"""


def _reference_check(table: str, column: str, target: str, key: str) -> str:
    source, columns = _COLUMNS[table]
    target_source, target_columns = _COLUMNS[target]
    return f"""
  SELECT '{table}' AS table_name, '{column}' AS column_name, '{target}' AS referenced_table,
         {big(f'COUNT(DISTINCT {columns[column]})')} AS orphan_keys,
         {big('COUNT(*)')} AS orphan_rows
  FROM {source} child
  WHERE NOT EXISTS (SELECT 1 FROM {target_source} parent
                    WHERE parent.{target_columns[key]} = child.{columns[column]})
    AND {columns[column]} IS NOT NULL
"""


# Numeric integration stands in for the distribution functions SQL lacks: Simpson's
# rule over 4,000 intervals, on the tail mapped to (0, 1].
def _integral(density: str, lower: str) -> str:
    """Integral of ``density`` in ``x`` from ``lower`` to infinity, with x = lower + u/(1-u)."""
    return f"""(
      SELECT SUM(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * f) / 12000
      FROM (SELECT i, CASE WHEN i = 4000 THEN 0 ELSE
                   ({density}) / pow(1 - i / 4000.0::DOUBLE, 2) END AS f
            FROM (SELECT i, {lower} + (i / 4000.0::DOUBLE) / NULLIF(1 - i / 4000.0::DOUBLE, 0) AS x
                  FROM range(0, 4001) steps(i))))"""


_BODIES = {
    "delivered_orders": f"""
      SELECT k AS order_id, ck AS customer_id, {text('ts')} AS order_purchase_timestamp,
             {text('arrived')} AS order_delivered_customer_date,
             {text('promised')} AS order_estimated_delivery_date,
             late AS is_late, {dbl('micros')} / {DAY} AS delivery_days
      FROM done""",
    "baseline_kpis": f"""
      SELECT {big('COUNT(*)')} AS total_orders, {dbl('SUM(gmv)')} AS total_revenue,
             {r(div('SUM(gmv)', 'COUNT(*)'))} AS aov
      FROM order_value JOIN shop_orders USING (k) WHERE st = 'delivered'""",
    "late_delivery_rate": f"""
      SELECT {big('COUNT(*)')} AS delivered_orders, {big(LATE)} AS late_orders,
             {r(LATE_RATE)} AS late_rate_pct,
             {r(days('SUM(micros)', 'COUNT(*)'))} AS avg_delivery_days,
             {r(f'quantile_cont(micros / {DAY}, 0.5)')} AS median_delivery_days
      FROM done""",
    "state_performance": _STATE_PERFORMANCE,
    "delay_vs_review": f"""
      SELECT CASE WHEN late THEN 'late' ELSE 'on_time' END AS delivery_status,
             {big('COUNT(*)')} AS delivered_orders, {big('COUNT(score)')} AS reviewed_orders,
             {r(div('SUM(score)', 'COUNT(score)'))} AS avg_review_score,
             {r(pct('COUNT(*) FILTER (WHERE score <= 2)', 'COUNT(score)'))} AS low_score_pct
      FROM scored GROUP BY late""",
    "state_confounding": f"""
      SELECT customer_state, late_orders, {r('punctual')} AS on_time_avg_score,
             {r('tardy')} AS late_avg_score, {r('punctual - tardy')} AS score_gap
      FROM (
        SELECT state AS customer_state, {big(LATE)} AS late_orders,
               COUNT(score) FILTER (WHERE late) AS late_reviewed,
               AVG(score) FILTER (WHERE NOT late) AS punctual,
               AVG(score) FILTER (WHERE late) AS tardy
        FROM scored JOIN shoppers USING (ck) GROUP BY state
      ) WHERE late_reviewed >= 30""",
    "monthly_trend": f"""
      SELECT {text('mon')} AS month, {big('n')} AS delivered_orders, gmv,
             {r('100.0::DOUBLE * (gmv - before) / NULLIF(before, 0)')} AS gmv_mom_growth_pct,
             {r('late_rate')} AS late_rate_pct
      FROM (
        SELECT *, LAG(gmv) OVER (ORDER BY mon) AS before
        FROM (SELECT mon, COUNT(*) AS n, {dbl('SUM(gmv)')} AS gmv, {LATE_RATE} AS late_rate
              FROM windowed JOIN order_value USING (k) GROUP BY mon)
      )""",
    "seller_vs_carrier": f"""
      SELECT {text('mon')} AS month, {r('seller')} AS avg_seller_days,
             {r('carrier')} AS avg_carrier_days, {r('late_rate')} AS late_rate_pct,
             CASE WHEN row_number() OVER (ORDER BY mon) >= 3 THEN {r(
                 'AVG(late_rate) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
             )} END AS late_rate_3m_avg
      FROM (
        SELECT mon, {LATE_RATE} AS late_rate,
               {days('SUM(seller_micros) FILTER (WHERE ok)', 'COUNT(*) FILTER (WHERE ok)')}
                 AS seller,
               {days('SUM(carrier_micros) FILTER (WHERE ok)', 'COUNT(*) FILTER (WHERE ok)')}
                 AS carrier
        FROM (SELECT *, seller_micros >= 0 AND carrier_micros >= 0 AS ok FROM windowed)
        GROUP BY mon
      )""",
    "promised_vs_actual": f"""
      SELECT {text('month')} AS month, avg_promised_days, avg_actual_days, avg_buffer_days,
             late_rate_pct, {r(pct('delivered', 'everything'))} AS delivered_share_pct
      FROM (
        SELECT mon AS month, COUNT(*) AS delivered,
               {r('AVG(CAST(promised AS DATE) - CAST(ts AS DATE))')} AS avg_promised_days,
               {r('AVG(CAST(arrived AS DATE) - CAST(ts AS DATE))')} AS avg_actual_days,
               {r('AVG(buffer)')} AS avg_buffer_days, {r(LATE_RATE)} AS late_rate_pct
        FROM windowed GROUP BY mon
      ) JOIN (
        SELECT CAST(date_trunc('month', ts) AS DATE) AS month, COUNT(*) AS everything
        FROM shop_orders WHERE ts >= DATE '2000-01-01' AND ts < DATE '2001-09-01' GROUP BY 1
      ) USING (month)""",
    "seller_late_rate": f"""
      SELECT sk AS seller_id, state AS seller_state, orders, late_rate_pct, total_gmv
      FROM (
        SELECT sk, {big('COUNT(DISTINCT k)')} AS orders,
               {r(pct('COUNT(DISTINCT k) FILTER (WHERE late)', 'COUNT(DISTINCT k)'))}
                 AS late_rate_pct,
               {dbl('SUM(price + freight)')} AS total_gmv
        FROM items JOIN done USING (k) GROUP BY sk
      ) JOIN shops USING (sk)
      WHERE orders >= 20""",
    "category_analysis": _CATEGORY,
    "gmv_by_purchase_quarter": f"""
      SELECT * REPLACE ({text('quarter')} AS quarter),
             {r(div('delivered_gmv', 'delivered_orders'))} AS aov
      FROM ({_PURCHASE_QUARTER})""",
    "gmv_by_delivery_quarter": f"""
      SELECT * REPLACE ({text('quarter')} AS quarter),
             {r(div('delivered_gmv', 'delivered_orders'))} AS aov
      FROM ({_DELIVERY_QUARTER})""",
    "review_coverage": f"""
      SELECT {text('mon')} AS month, {big('COUNT(*)')} AS delivered_orders,
             {big('COUNT(score)')} AS reviewed_orders,
             {r(pct('COUNT(score)', 'COUNT(*)'))} AS review_coverage_pct
      FROM scored WHERE ts >= DATE '2000-01-01' AND ts < DATE '2001-07-01' GROUP BY mon""",
    "low_score_by_period": f"""
      SELECT 'Jan-Jun ' || half AS period, {big('orders')} AS delivered_orders,
             {big('reviewed')} AS reviewed_orders, {big('low')} AS low_score_orders,
             {r(pct('low', 'reviewed'))} AS low_score_rate_pct
      FROM ({_period_counts()})""",
    "late_by_period": f"""
      SELECT 'Jan-Jun ' || half AS period, {big('orders')} AS delivered_orders,
             {big('late_orders')} AS late_orders,
             {r(pct('late_orders', 'orders'))} AS late_rate_pct
      FROM ({_period_counts()})""",
    "low_score_period_x_status": f"""
      SELECT {text('half')} AS period, CASE WHEN late THEN 'late' ELSE 'on_time' END
               AS delivery_status,
             {big('orders')} AS orders, {big('reviewed')} AS reviewed_orders,
             {r(pct('low', 'reviewed'))} AS low_score_rate_pct
      FROM ({_period_counts(', late')})""",
    "monthly_late_rate": f"""
      SELECT {text('mon')} AS month, {LATE_RATE} AS late_rate_pct FROM windowed GROUP BY mon""",
    "review_score_distribution": f"""
      SELECT CASE WHEN late THEN 'Late' ELSE 'On-time' END AS "group",
             {big('score')} AS review_score,
             {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY late)')} AS percentage
      FROM scored WHERE score IS NOT NULL AND late IS NOT NULL GROUP BY late, score""",
    "monthly_buffer_vs_late": f"""
      SELECT {text('mon')} AS month, buffer AS avg_buffer_days, late_rate AS late_rate_pct
      FROM ({_BUFFER})""",
    "late_rate_by_definition": f"""
      SELECT {r(LATE_RATE)} AS late_rate_by_date_pct,
             {r(pct('COUNT(*) FILTER (WHERE arrived > promised)', 'COUNT(promised)'))}
               AS late_rate_by_time_pct
      FROM done""",
    "repeat_purchase_rate": f"""
      SELECT {big('COUNT(*)')} AS customers,
             {big('COUNT(*) FILTER (WHERE n >= 2)')} AS repeat_customers,
             {r(pct('COUNT(*) FILTER (WHERE n >= 2)', 'COUNT(*)'))} AS repeat_purchase_pct
      FROM (SELECT ck - ck % 2, COUNT(*) AS n FROM shop_orders JOIN shoppers USING (ck) GROUP BY 1)""",
    "carrier_share": f"""
      SELECT {big('COUNT(*)')} AS orders,
             {r(days('SUM(seller_micros)', 'COUNT(*)'))} AS avg_seller_days,
             {r(days('SUM(carrier_micros)', 'COUNT(*)'))} AS avg_carrier_days,
             {r(pct('SUM(carrier_micros)', 'SUM(seller_micros + carrier_micros)'))}
               AS carrier_share_pct
      FROM done WHERE seller_micros >= 0 AND carrier_micros >= 0""",
    "buffer_threshold": f"""
      SELECT {text('mon')} AS month, {r('buffer')} AS avg_buffer_days,
             {r('late_rate')} AS late_rate_pct, buffer < 11 AS below_threshold,
             late_rate >= 10 AS double_digit_late_rate
      FROM ({_BUFFER})""",
    "category_weight_correlation": f"""
      SELECT {big('COUNT(*)')} AS categories, {r('corr(avg_weight_g, late_rate_pct)', 6)} AS r
      FROM ({_CATEGORY})""",
    "period_growth": f"""
      SELECT basis, {text('quarter')} AS quarter, delivered_gmv,
             {r('100.0::DOUBLE * (delivered_gmv - before) / NULLIF(before, 0)')} AS gmv_growth_pct
      FROM (
        SELECT *, LAG(delivered_gmv) OVER (PARTITION BY basis ORDER BY quarter) AS before
        FROM (
          SELECT 'purchase' AS basis, quarter, delivered_gmv FROM ({_PURCHASE_QUARTER})
          UNION ALL
          SELECT 'delivery', quarter, delivered_gmv FROM ({_DELIVERY_QUARTER})
        )
      )""",
    "buffer_late_correlation": f"""
      SELECT {big('COUNT(*)')} AS months, {r('corr(buffer, late_rate)', 6)} AS r
      FROM ({_BUFFER})""",
    "buffer_late_significance": f"""
      SELECT {big('n')} AS months, {r('r', 6)} AS r,
             {sig('2 * ' + _integral(
                 "exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi())"
                 " * pow(1 + x * x / nu, -(nu + 1) / 2)", 't'))} AS p_value
      FROM (
        SELECT *, abs(r) * sqrt(nu / (1 - r * r)) AS t
        FROM (SELECT COUNT(*) AS n, {dbl('COUNT(*) - 2')} AS nu, corr(buffer, late_rate) AS r
              FROM ({_BUFFER}))
      )""",
    "buffer_late_line": f"""
      SELECT {r('regr_slope(late_rate, buffer)', 6)} AS slope,
             {r('regr_intercept(late_rate, buffer)', 6)} AS intercept
      FROM ({_BUFFER})""",
    "state_late_rate_interval": f"""
      SELECT customer_state, delivered_orders, late_rate_pct,
             {r('late_rate_pct - margin')} AS ci_low_pct,
             {r('late_rate_pct + margin')} AS ci_high_pct
      FROM (SELECT *, 1.96 * sqrt(late_rate_pct * (100 - late_rate_pct) / delivered_orders)
                     AS margin
            FROM ({_STATE_PERFORMANCE}))""",
    "low_score_z_test": f"""
      SELECT {r(pct('x0', 'n0'))} AS base_rate_pct, {r(pct('x1', 'n1'))} AS next_rate_pct,
             {r('z', 6)} AS z,
             {sig('2 * ' + _integral('exp(-x * x / 2) / sqrt(2 * pi())', 'abs(z)'))} AS p_value
      FROM (
        SELECT *, (x1 / n1 - x0 / n0)
                  / sqrt((x0 + x1) / (n0 + n1) * (1 - (x0 + x1) / (n0 + n1))
                         * (1 / n0 + 1 / n1)) AS z
        FROM (SELECT {dbl('x0')} AS x0, {dbl('n0')} AS n0, {dbl('x1')} AS x1, {dbl('n1')} AS n1
              FROM ({_TWO_PERIODS}))
      )""",
    "low_score_decomposition": f"""
      SELECT {r('100 * change', 4)} AS change_pp, {r('100 * mix', 4)} AS mix_pp,
             {r('100 * (change - mix)', 4)} AS within_pp,
             {r('100 * mix / change')} AS mix_share_pct,
             {r('100 * (change - mix) / change')} AS within_share_pct
      FROM (
        SELECT l1 / r1 - l0 / r0 AS change,
               (late_r1 / r1 - late_r0 / r0)
               * (late_l0 / late_r0 - (l0 - late_l0) / (r0 - late_r0)) AS mix
        FROM (
          SELECT {dbl('SUM(low) FILTER (WHERE half = 2000)')} AS l0,
                 {dbl('SUM(low) FILTER (WHERE half = 2001)')} AS l1,
                 {dbl('SUM(reviewed) FILTER (WHERE half = 2000)')} AS r0,
                 {dbl('SUM(reviewed) FILTER (WHERE half = 2001)')} AS r1,
                 {dbl('SUM(low) FILTER (WHERE half = 2000 AND late)')} AS late_l0,
                 {dbl('SUM(reviewed) FILTER (WHERE half = 2000 AND late)')} AS late_r0,
                 {dbl('SUM(reviewed) FILTER (WHERE half = 2001 AND late)')} AS late_r1
          FROM ({_period_counts(', late')})
        )
      )""",
    "clean_reviews": f"""
      SELECT review_id, k AS order_id, {big('score')} AS review_score,
             title AS review_comment_title, message AS review_comment_message,
             {text('created')} AS review_creation_date,
             {text('answered')} AS review_answer_timestamp
      FROM reviews""",
    "clean_products": f"""
      SELECT pk AS product_id, category AS product_category_name,
             {dbl('name_length')} AS product_name_lenght,
             {dbl('description_length')} AS product_description_lenght,
             {dbl('photos')} AS product_photos_qty, {dbl('weight')} AS product_weight_g,
             {dbl('len')} AS product_length_cm, {dbl('height')} AS product_height_cm,
             {dbl('width')} AS product_width_cm, english AS product_category_name_english
      FROM products""",
    "clean_products_by_category": f"""
      SELECT p.pk AS product_id, p.category AS product_category_name,
             {', '.join(
                 f'{dbl(f"coalesce(p.{c}, m.{c})")} AS product_{name}'
                 for c, name in (('weight', 'weight_g'), ('len', 'length_cm'),
                                 ('height', 'height_cm'), ('width', 'width_cm')))}
      FROM named_products p JOIN (
        SELECT category, {', '.join(
            f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}'
            for c in ('weight', 'len', 'height', 'width'))}
        FROM named_products GROUP BY category
      ) m ON m.category = p.category""",
    "audit_row_counts": _union([
        f"SELECT '{name}' AS table_name, {big('COUNT(*)')} AS row_count,"
        f" {big(str(len(columns)))} AS column_count FROM {source}"
        for name, (source, columns) in _COLUMNS.items()
    ]),
    "audit_row_floors": _union([
        f"""SELECT '{name}' AS table_name, {big('COUNT(*)')} AS row_count,
               {big('90000')} AS expected_rows,
               CASE WHEN COUNT(*) < 90000 THEN 'below expected' ELSE 'passed' END AS status
            FROM {_COLUMNS[name][0]}"""
        for name in ("orders", "customers")
    ]),
    "audit_duplicate_reviews": f"""
      SELECT {big('COUNT(*) FILTER (WHERE n > 1)')} AS repeated_keys,
             {big('SUM(n) - COUNT(*)')} AS extra_rows
      FROM (SELECT COUNT(*) AS n FROM all_reviews GROUP BY k)""",
    "audit_primary_keys": _union([_key_check(t) for t in _KEYS]),
    "audit_required_columns": _union([
        _null_counts(t, _COLUMNS[t][0], {c: _COLUMNS[t][1][c] for c in required})
        for t, required in _REQUIRED.items()
    ]),
    "audit_foreign_keys": _union([_reference_check(*ref) for ref in _REFERENCES]),
    "audit_null_profile": f"""
      SELECT *, {r(pct('null_count', 'row_count'))} AS null_pct FROM ({_union([
          _null_counts(t, source, columns) for t, (source, columns) in _COLUMNS.items()
      ])})""",
    "audit_missing_together": f"""
      SELECT v.column_name, {big('v.n')} AS null_count, {big('everything')} AS all_null,
             {big('anything')} AS any_null
      FROM (
        SELECT COUNT(*) FILTER (WHERE category IS NULL) AS a,
               COUNT(*) FILTER (WHERE name_length IS NULL) AS b,
               COUNT(*) FILTER (WHERE description_length IS NULL) AS c,
               COUNT(*) FILTER (WHERE photos IS NULL) AS d,
               COUNT(*) FILTER (WHERE COALESCE(category, CAST(name_length AS VARCHAR),
                 CAST(description_length AS VARCHAR), CAST(photos AS VARCHAR)) IS NULL)
                 AS everything,
               COUNT(*) FILTER (WHERE category IS NULL OR name_length IS NULL
                 OR description_length IS NULL OR photos IS NULL) AS anything
        FROM raw_products
      ), LATERAL (VALUES ('product_category_name', a), ('product_name_lenght', b),
                         ('product_description_lenght', c), ('product_photos_qty', d))
                 v(column_name, n)""",
    "audit_missing_groups": _union([_null_groups(t, source, columns) for t, (source, columns) in _COLUMNS.items()]),
    "audit_unreviewed_orders": f"""
      SELECT 'all orders' AS population, {big('COUNT(*)')} AS orders FROM shop_orders
      UNION ALL
      SELECT 'without review', {big('COUNT(*)')} FROM shop_orders
      WHERE k NOT IN (SELECT k FROM all_reviews)""",
    "audit_itemless_orders": f"""
      SELECT st AS order_status, {big('COUNT(*)')} AS orders FROM shop_orders
      WHERE k NOT IN (SELECT k FROM items) GROUP BY st""",
    "audit_undated_deliveries": f"""
      SELECT {big('COUNT(*)')} AS delivered_orders,
             {big('COUNT(*) - COUNT(arrived)')} AS undated_orders
      FROM shop_orders WHERE st = 'delivered'""",
    "audit_impossible_durations": f"""
      SELECT {big('COUNT(*)')} AS delivered_orders,
             {big('COUNT(*) FILTER (WHERE seller_micros < 0)')} AS carrier_before_purchase,
             {big('COUNT(*) FILTER (WHERE carrier_micros < 0)')} AS delivered_before_carrier,
             {big('COUNT(*) FILTER (WHERE carrier IS NULL)')} AS carrier_missing
      FROM done""",
    "audit_batch_deliveries": f"""
      SELECT {text('delivery_date')} AS delivery_date, late_orders,
             {text('a')} AS first_purchase_date, {text('z')} AS last_purchase_date,
             {big('z - a')} AS purchase_spread_days, max_days_late,
             late_orders >= 2 AND z - a >= 14 AND max_days_late >= 10 AS is_batch
      FROM (
        SELECT CAST(arrived AS DATE) AS delivery_date, {big('COUNT(*)')} AS late_orders,
               MIN(CAST(ts AS DATE)) AS a, MAX(CAST(ts AS DATE)) AS z,
               {big('MAX(-buffer)')} AS max_days_late
        FROM done WHERE late GROUP BY 1
      )""",
    "audit_customer_identity": _union([
        f"""SELECT '{c}' AS id_column, {big('COUNT(*)')} AS distinct_ids,
                   {big('MAX(n)')} AS max_rows_per_id
            FROM (SELECT COUNT(*) AS n FROM shoppers GROUP BY {expr})"""
        for c, expr in (("customer_id", "ck"), ("customer_unique_id", "ck - ck % 2"))
    ]),
    "audit_key_relations": _union([
        _determines(table, one, other)
        for table, (_, columns) in _COLUMNS.items()
        for one in columns for other in columns
        if one != other and one.endswith("_id") and other.endswith("_id")
        and "order_item_id" not in (one, other)
    ]),
    "audit_window_coverage": f"""
      SELECT {text('MIN(CAST(ts AS DATE))')} AS first_purchase_date,
             {text('MAX(CAST(ts AS DATE))')} AS last_purchase_date,
             (SELECT {big('COUNT(*)')} FROM done) AS delivered_orders,
             (SELECT {big('COUNT(*)')} FROM windowed) AS delivered_in_window,
             (SELECT {r(pct("COUNT(*) FILTER (WHERE ts >= DATE '2000-01-01' AND ts < DATE '2001-09-01')", 'COUNT(*)'))} FROM done)
               AS in_window_pct
      FROM shop_orders""",
}

ORACLES: dict[str, str] = {name: SHOP + body for name, body in _BODIES.items()}
