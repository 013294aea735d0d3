"""DuckDB SQL for the order-feature view and the binary-evaluation queries (oracle side).

These strings restate the operators' semantics in plain SQL over the driver tables so the
driver can check the Spark plans against an independent engine.
"""
from __future__ import annotations

from kestrel.functions import rules as R
from kestrel.functions.hashing import uniform_sql


def _case(expr: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {arms} END"


def z_sql() -> str:
    """The closed-form score's linear term over columns named like the order table."""
    return (
        f"{R.Z_INTERCEPT} + {R.Z_PREV_RETURN_RATIO} * prev_return_ratio"
        f" + {R.Z_FIT_RISK} * (CASE WHEN product_category IN ('Apparel','Footwear') THEN 1.0 ELSE 0.0 END)"
        f" + {R.Z_DISCOUNT} * (discount_pct - 20) / 10"
        f" + {R.Z_COD} * (CASE WHEN payment_method = 'COD' THEN 1.0 ELSE 0.0 END)"
        f" + {R.Z_DELIVERY_DAYS} * (CAST(delivery_days AS DOUBLE) - 4.5) / 2"
        f" + {R.Z_PRICE} * (price_inr / {R.PRICE_SCALE})"
        f" + {R.Z_WEEKEND} * is_weekend_order"
        f" + ({R.Z_TENURE}) * tanh(customer_tenure_days / {R.TENURE_SCALE})"
    )


def order_features_cte() -> str:
    u = lambda tag: uniform_sql("o.o_orderkey", tag)
    pay = _case("substr(o.o_orderpriority, 1, 1)", R.PAYMENT_BY_PRIORITY)
    z = z_sql()
    return f"""
lines AS (
  SELECT l_orderkey,
         max({{'p': l_extendedprice, 'k': l_partkey}}) AS top,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_sum,
         count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
         min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS order_day,
         CASE WHEN l.n_lines IS NULL THEN '{R.NO_LINES_CATEGORY}' ELSE {_case("split_part(p.p_type, ' ', 1)", R.CATEGORY_BY_PART_TYPE)} END AS product_category,
         CASE WHEN l.n_lines IS NULL THEN {R.NO_LINES_PRICE} ELSE round(l.top.p, 0) END AS price_inr,
         CASE WHEN l.n_lines IS NULL THEN {R.NO_LINES_DISCOUNT}
              ELSE round(least(greatest(CAST(l.disc_sum AS DOUBLE) / l.n_lines, {R.DISCOUNT_MIN}), {R.DISCOUNT_MAX}), 1) END AS discount_pct,
         {pay} AS payment_method,
         CASE WHEN l.n_r * 2 > l.n_lines THEN 1 ELSE 0 END AS lr,
         CASE WHEN l.n_lines IS NULL THEN {R.NO_LINES_DAYS}
              ELSE CAST((((datediff('day', CAST(o.o_orderdate AS DATE), CAST(l.first_ship AS DATE)) % 21) + 21) % 21) + 1 AS INTEGER) END AS delivery_days,
         round(least({R.DISTANCE_MIN} + {R.DISTANCE_SPAN} * {u('dist')}, {R.DISTANCE_MAX}), 1) AS delivery_distance_km,
         CASE WHEN isodow(o.o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend_order,
         CASE WHEN {u('miss')} < (CASE WHEN {pay} = 'COD' THEN {R.MISSING_RATE_COD} ELSE {R.MISSING_RATE_OTHER} END)
              THEN NULL ELSE CAST(floor(5 * {u('rate')}) + 1 AS DOUBLE) END AS rating_given,
         {u('ret')} AS u_ret
  FROM orders o LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey
  LEFT JOIN part p ON l.top.k = p.p_partkey),
hist AS (
  SELECT *,
         CAST(count(*) OVER (PARTITION BY customer_id ORDER BY order_day, order_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS num_previous_orders,
         CAST(coalesce(sum(lr) OVER (PARTITION BY customer_id ORDER BY order_day, order_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS num_previous_returns,
         CAST(least(greatest(datediff('day', min(order_day) OVER (PARTITION BY customer_id), order_day), {R.TENURE_MIN}), {R.TENURE_MAX}) AS INTEGER) AS customer_tenure_days
  FROM base),
feat AS (
  SELECT *, CASE WHEN num_previous_orders > 0 THEN CAST(num_previous_returns AS DOUBLE) / num_previous_orders ELSE 0.0 END AS prev_return_ratio
  FROM hist),
scored AS (SELECT *, 1.0 / (1.0 + exp(-({z}))) AS prob_return FROM feat),
order_features AS (
  SELECT order_id, product_category, price_inr, discount_pct, payment_method, customer_tenure_days,
         num_previous_orders, num_previous_returns, delivery_distance_km, delivery_days, is_weekend_order,
         rating_given, CASE WHEN u_ret < prob_return THEN 1 ELSE 0 END AS returned,
         prob_return, prev_return_ratio, customer_id
  FROM scored),
scored_orders AS (
  SELECT order_id AS id, returned AS label, prob_return AS score, product_category, payment_method FROM order_features)"""


def with_orders(body: str) -> str:
    return f"WITH {order_features_cte()},\n{body}"


def sweep_cte(scores: str = "scored_orders") -> str:
    return f"""grid AS (SELECT CAST({R.SWEEP_LO} + {R.SWEEP_STEP} * i AS DOUBLE) / 100 AS t FROM range(0, {(R.SWEEP_HI - R.SWEEP_LO) // R.SWEEP_STEP + 1}) r(i)),
sweep_counts AS (
  SELECT g.t,
         sum(CASE WHEN s.score >= g.t AND s.label = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN s.score >= g.t THEN 1 ELSE 0 END) AS pp,
         sum(CASE WHEN s.label = 1 THEN 1 ELSE 0 END) AS p
  FROM grid g, {scores} s GROUP BY g.t),
sweep AS (
  SELECT round(t, 2) AS threshold,
         CASE WHEN pp + p = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (pp + p) END AS f1,
         CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END AS recall,
         CASE WHEN pp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pp END AS precision
  FROM sweep_counts),
t_star AS (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1)"""
