"""Benchmark tables as shop tables, in SQL: common table expressions put before every query.

Money is DECIMAL(12,2), durations are microseconds, results are rounded
through DECIMAL(38,8), dates are rendered as text.
"""


def r(value: str, places: int = 2) -> str:
    """Rounded value."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,8)), {places}) AS DOUBLE)"


def sig(value: str) -> str:
    """Six significant digits, through text."""
    return f"CAST(printf('%.5e', {value}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    """Double division, NULL on a zero divisor."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"(100.0::DOUBLE * {div(a, b)})"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


SHOP = """
WITH bought AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS total,
         CASE WHEN o_orderstatus <> 'P' THEN 'delivered'
              WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'shipped' END AS st,
         o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS ts
  FROM orders
),
handed AS (
  SELECT *, ts + to_hours(k * 37 % 240 - 4) AS handover FROM bought
),
shop_orders AS (
  SELECT k, ck, st, ts, handover,
         CASE WHEN k % 613 <> 0 THEN ts + to_hours(k % 48) END AS approved,
         CASE WHEN k % 997 <> 1 THEN handover END AS carrier,
         CASE WHEN st = 'delivered' AND k % 499 <> 0 THEN handover + to_hours(
                k * 101 % 480 + 12 * (ck % 7)
                + CASE WHEN month(ts) IN (2, 3, 11) THEN 72 ELSE 0 END
                - CASE WHEN k % 331 = 0 THEN 600 ELSE 0 END) END AS arrived,
         CAST(CAST(ts AS DATE) + CAST(18 + k * 13 % 24 AS INTEGER) AS TIMESTAMP) AS promised
  FROM handed
),
done AS (
  SELECT k, ck, ts, carrier, arrived, promised,
         CAST(arrived AS DATE) > CAST(promised AS DATE) AS late,
         epoch_us(arrived) - epoch_us(ts) AS micros,
         epoch_us(carrier) - epoch_us(ts) AS seller_micros,
         epoch_us(arrived) - epoch_us(carrier) AS carrier_micros,
         CAST(promised AS DATE) - CAST(arrived AS DATE) AS buffer,
         CAST(date_trunc('month', ts) AS DATE) AS mon
  FROM shop_orders WHERE st = 'delivered' AND arrived IS NOT NULL
),
all_reviews AS (
  SELECT k * 10 + n AS review_id, k,
         CASE WHEN late THEN 1 + (17 * k + n) % 4
              WHEN 13 * k % 100 < 9 THEN 1 + (17 * k + n) % 2
              ELSE 3 + (17 * k + n) % 3 END AS score,
         CASE WHEN k % 8 = 0 THEN 'title ' || k END AS title,
         CASE WHEN k % 5 < 2 THEN 'message ' || k END AS message,
         CAST(CAST(arrived AS DATE) AS TIMESTAMP) AS created,
         CASE WHEN n = 1 OR k % 360 <> 0 THEN arrived + to_hours(k % 72 + 24 * n) END AS answered
  FROM done, (VALUES (0), (1)) copies(n)
  WHERE (n = 0 AND k % 130 <> 0) OR (n = 1 AND k % 180 = 0)
),
reviews AS (
  SELECT * FROM all_reviews
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY answered DESC NULLS FIRST, review_id DESC) = 1
),
items AS (
  SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS pk, 
         CASE WHEN l_suppkey = 1 AND l_orderkey % 97 <> 0 THEN 2 ELSE l_suppkey END AS sk,
         l_shipdate AS ship_limit,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(l_quantity AS DECIMAL(12,2)) AS freight
  FROM lineitem
),
order_value AS (
  SELECT k, SUM(price + freight) AS gmv FROM items GROUP BY k
),
payments AS (
  SELECT k, n, ['credit_card', 'boleto', 'voucher', 'debit_card'][k % 4 + 1] AS kind,
         1 + k % 10 AS installments,
         CAST(CASE WHEN n = 1 THEN total ELSE 10 END AS DECIMAL(12,2)) AS paid
  FROM bought, (VALUES (1), (2)) parts(n)
  WHERE n = 1 OR k % 20 = 0
),
raw_products AS (
  SELECT p_partkey AS pk,
         CASE WHEN p_partkey % 53 <> 0 THEN p_brand END AS category,
         CASE WHEN p_partkey % 53 <> 0 THEN length(p_name) END AS name_length,
         CASE WHEN p_partkey % 53 <> 0 THEN length(p_type) END AS description_length,
         CASE WHEN p_partkey % 53 <> 0 THEN p_partkey % 5 + 1 END AS photos,
         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_size * 100 AS DECIMAL(12,2)) END AS weight,
         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_partkey % 50 + 10 AS DECIMAL(12,2)) END AS len,
         CASE WHEN p_partkey % 89 <> 0 THEN CAST(p_partkey % 30 + 5 AS DECIMAL(12,2)) END AS height,
         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_partkey % 40 + 8 AS DECIMAL(12,2)) END AS width
  FROM part
),
translation AS (
  SELECT DISTINCT p_brand AS category, upper(p_brand) AS english
  FROM part WHERE p_brand <> 'Brand#7'
),
named_products AS (
  SELECT p.* REPLACE (coalesce(p.category, 'unknown') AS category),
         coalesce(t.english, 'unknown') AS english
  FROM raw_products p LEFT JOIN translation t ON t.category = p.category
),
products AS (
  SELECT * REPLACE (
           CAST(coalesce(weight, (SELECT quantile_cont(CAST(weight AS DOUBLE), 0.5)
                                  FROM raw_products)) AS DECIMAL(13,3)) AS weight,
           CAST(coalesce(len, (SELECT quantile_cont(CAST(len AS DOUBLE), 0.5)
                               FROM raw_products)) AS DECIMAL(13,3)) AS len,
           CAST(coalesce(height, (SELECT quantile_cont(CAST(height AS DOUBLE), 0.5)
                                  FROM raw_products)) AS DECIMAL(13,3)) AS height,
           CAST(coalesce(width, (SELECT quantile_cont(CAST(width AS DOUBLE), 0.5)
                                 FROM raw_products)) AS DECIMAL(13,3)) AS width)
  FROM named_products
),
shoppers AS (
  SELECT c_custkey AS ck, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
         lower(c_mktsegment) AS city, n_name AS state
  FROM customer JOIN nation ON n_nationkey = c_nationkey
),
shops AS (
  SELECT s_suppkey AS sk, lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS zip,
         lower(s_name) AS city, n_name AS state
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
windowed AS (
  SELECT * FROM done WHERE ts >= DATE '2000-01-01' AND ts < DATE '2001-09-01'
),
scored AS (
  SELECT d.*, v.score FROM done d LEFT JOIN reviews v USING (k)
),
halves AS (
  SELECT *, year(ts) AS half FROM scored WHERE year(ts) IN (2000, 2001) AND month(ts) <= 6
)
"""
