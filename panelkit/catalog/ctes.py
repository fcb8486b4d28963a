"""DuckDB twins of the test panels (FIXTURES.md part B), as CTE text."""

PANEL = """
WITH base AS (
  SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS t,
         avg(l_extendedprice) AS px, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
nxt AS (SELECT *, lead(px) OVER (PARTITION BY series_id ORDER BY t) AS px1 FROM base),
panel AS (
  SELECT series_id, t, px, qty, disc, tax,
         0.02 * (px1 - px) / (px1 + px) AS forward_returns,
         tax / 252 AS risk_free_rate,
         0.02 * (px1 - px) / (px1 + px) - tax / 252 AS market_forward_excess_returns
  FROM nxt WHERE px1 IS NOT NULL)"""

MARKET = """
WITH mbase AS (
  SELECT CAST(0 AS BIGINT) AS series_id, CAST(l_shipdate AS DATE) AS t,
         avg(l_extendedprice) AS px, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
mnxt AS (SELECT *, lead(px) OVER (PARTITION BY series_id ORDER BY t) AS px1 FROM mbase),
market AS (
  SELECT series_id, t, px, qty, disc, tax,
         0.02 * (px1 - px) / (px1 + px) AS forward_returns,
         tax / 252 AS risk_free_rate,
         0.02 * (px1 - px) / (px1 + px) - tax / 252 AS market_forward_excess_returns
  FROM mnxt WHERE px1 IS NOT NULL)"""

# appended to PANEL (starts with a comma)
GAPS = """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn FROM panel),
panel_gaps AS (
  SELECT series_id, t, rn,
         CASE WHEN rn <= 40 + 10 * (series_id % 5) THEN NULL ELSE px END AS P1,
         CASE WHEN (rn + series_id) % 17 = 0 THEN NULL ELSE qty END AS E1,
         disc AS V1,
         CASE WHEN series_id % 10 = 3 THEN NULL ELSE tax END AS M1,
         1.0e0 AS D1,
         forward_returns, risk_free_rate, market_forward_excess_returns
  FROM numbered)"""

# appended to PANEL (starts with a comma)
SCORES = """,
scores AS (
  SELECT *, least(greatest(40 * coalesce(avg(forward_returns) OVER (PARTITION BY series_id ORDER BY t
                    ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), 0) + 1, 0), 2) AS prediction
  FROM panel)"""

ORDERS = """
WITH opanel AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS t,
         avg(o_totalprice) AS px, count(*) AS n
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""

EVENTS = """
WITH hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS t, avg(value) AS px, count(*) AS n
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""
