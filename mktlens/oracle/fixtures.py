"""DuckDB SQL for the fixture adapters (the oracle side of ``sources.fixtures``).

Each entry is a CTE body over the driver's pre-registered views. ``with_ctes``
assembles a ``WITH RECURSIVE`` prefix holding exactly the CTEs a query names,
plus their dependencies. The oracle computes from raw snapshot rows (median
over raw prices, plain windows) -- it does not share the Spark side's
histogram or two-level running sums, so it is an independent check.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {
    "snap_events": ("""
        SELECT ts, CAST(ts AS DATE) AS date, user_id AS product_id, user_id * 10 + event_id % 3 AS sku_id,
               'product ' || CAST(user_id AS VARCHAR) AS title,
               CAST(1 + event_id % 5 AS DECIMAL(9,2)) AS rating,
               2000 + user_id % 25 AS category_id,
               CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS reviews_amount,
               CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total_orders_amount,
               3 * ((event_id * 7919) % 50) AS total_available_amount,
               (event_id * 7919) % 50 AS available_amount,
               'ph' || CAST(user_id * 10 + event_id % 3 AS VARCHAR) AS photo_key,
               user_id % 10 AS seller_id, (user_id % 10) % 5 AS seller_account_id,
               'shop ' || CAST(user_id % 10 AS VARCHAR) AS seller_title,
               'seller-' || CAST(user_id % 10 AS VARCHAR) AS seller_link,
               CASE WHEN event_id % 4 <> 0 THEN CAST(ROUND(value * 100) AS BIGINT) + 100 END AS full_price,
               CAST(ROUND(value * 100) AS BIGINT) AS purchase_price
        FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """, []),
    "snap_lineitem": ("""
        SELECT l_shipdate AS ts, CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id,
               l_partkey * 100000 + l_suppkey AS sku_id,
               'part ' || CAST(l_partkey AS VARCHAR) AS title,
               CAST(1 + l_linenumber % 5 AS DECIMAL(9,2)) AS rating,
               3000 + l_partkey % 40 AS category_id,
               CAST(l_linenumber AS BIGINT) AS reviews_amount,
               CAST(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_orders_amount,
               (l_orderkey % 97) * 2 AS total_available_amount,
               l_orderkey % 97 AS available_amount,
               'ph' || CAST(l_partkey * 100000 + l_suppkey AS VARCHAR) AS photo_key,
               l_suppkey AS seller_id, l_suppkey % 7 AS seller_account_id,
               'shop ' || CAST(l_suppkey AS VARCHAR) AS seller_title,
               'seller-' || CAST(l_suppkey AS VARCHAR) AS seller_link,
               CASE WHEN l_linenumber <> 1 THEN CAST(ROUND(l_extendedprice * 100 / l_quantity) AS BIGINT) + 500 END
                   AS full_price,
               CAST(ROUND(l_extendedprice * 100 / l_quantity) AS BIGINT) AS purchase_price
        FROM lineitem
    """, []),
    "categories": ("""
        SELECT CAST(1000 + r_regionkey AS BIGINT) AS category_id, CAST(0 AS BIGINT) AS parent_category_id,
               r_name AS title FROM region
        UNION ALL
        SELECT CAST(2000 + n_nationkey AS BIGINT), CAST(1000 + n_regionkey AS BIGINT), n_name FROM nation
    """, []),
    "deep_leaves": ("SELECT DISTINCT p_partkey % 40 AS l FROM part", []),
    "categories_deep": ("""
        SELECT CAST(3000 + l AS BIGINT) AS category_id, CAST(4000 + l % 8 AS BIGINT) AS parent_category_id,
               'leaf ' || CAST(l AS VARCHAR) AS title FROM deep_leaves
        UNION ALL
        SELECT DISTINCT CAST(4000 + l % 8 AS BIGINT), CAST(5000 + (l % 8) % 2 AS BIGINT),
               'mid ' || CAST(l % 8 AS VARCHAR) FROM deep_leaves
        UNION ALL
        SELECT DISTINCT CAST(5000 + l % 2 AS BIGINT), CAST(0 AS BIGINT), 'root ' || CAST(l % 2 AS VARCHAR)
        FROM deep_leaves
    """, ["deep_leaves"]),
    "positions": ("""
        SELECT ts, user_id AS product_id, user_id * 10 + event_id % 3 AS sku_id,
               2000 + user_id % 25 AS category_id, (event_id * 31) % 100 + 1 AS position
        FROM events WHERE event_type = 'view'
    """, []),
    "sellers": ("""
        SELECT s_suppkey AS seller_id, CAST(s_nationkey AS BIGINT) AS account_id,
               'seller-' || CAST(s_suppkey AS VARCHAR) AS link, s_name AS title FROM supplier
    """, []),
    "users": ("""
        SELECT c_custkey AS user_id,
               CASE c_custkey % 4 WHEN 0 THEN 'demo' WHEN 1 THEN 'default' WHEN 2 THEN 'advanced' ELSE 'pro' END
                   AS subscription_type,
               CAST(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE) AS subscription_end_at
        FROM customer
    """, []),
    "payments": ("""
        SELECT o_orderkey AS payment_id, o_custkey AS user_id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
               o_orderstatus = 'F' AS paid, o_totalprice AS amount,
               CASE o_orderkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'advanced' ELSE 'pro' END AS subscription_type,
               1 + o_orderkey % 3 AS multiply
        FROM orders
    """, []),
    "report_requests": ("""
        SELECT event_id AS report_id, user_id, ts AS created_at,
               CASE WHEN event_id % 2 = 0 THEN 'seller' ELSE 'category' END AS report_type,
               CASE WHEN event_id % 2 = 0 THEN 'seller-' || CAST(user_id % 10 AS VARCHAR)
                    ELSE CAST(1000 + user_id % 5 AS VARCHAR) END AS key,
               7 * (1 + event_id % 4) AS interval_days, 'completed' AS status,
               'report-' || CAST(event_id AS VARCHAR) AS content
        FROM events
    """, []),
    "access_log": ("""
        SELECT user_id AS api_key, event_id % 9 AS ip, event_id % 5 AS browser, ts FROM events
    """, []),
    "access_requests": ("""
        SELECT event_id AS request_id, user_id, CAST(event_id % 130 AS INTEGER) AS days,
               CAST(DATE '2024-01-31' - CAST(event_id % 130 AS INTEGER) AS DATE) AS from_date FROM events
    """, []),
    "plans": ("""
        SELECT * FROM (VALUES ('demo', 1, 30, 10, 10), ('default', 1, 30, 100, 0), ('advanced', 1, 90, 100, 100),
                              ('pro', 1, 120, 100, 100))
               t(subscription_type, min_days, max_days, shop_reports, category_reports)
    """, []),
    "payment_created": ("""
        SELECT o_orderkey + k AS payment_id, o_custkey AS user_id, o_orderdate AS created_at,
               CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_minor, 1 + o_orderkey % 3 AS plan_code,
               1 + o_orderkey % 2 AS multiply,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'held' END AS status
        FROM orders CROSS JOIN (VALUES (0), (1000000000)) t(k)
    """, []),
    "payment_status": ("""
        SELECT l_orderkey + k AS payment_id,
               CASE WHEN l_returnflag = 'R' THEN 'canceled' WHEN l_returnflag = 'A' THEN 'refunded'
                    WHEN l_linestatus = 'F' THEN 'success' ELSE 'pending' END AS status,
               l_shipdate AS event_ts, l_linenumber AS event_seq
        FROM lineitem JOIN (VALUES (0), (1000000000)) t(k) ON k = 0 OR l_linenumber % 2 = 1
    """, []),
}


def closure_cte(cat: str) -> str:
    return f"""
        SELECT ancestor, descendant, depth FROM (
            WITH RECURSIVE walk(ancestor, descendant, depth) AS (
                SELECT parent_category_id, category_id, 1 FROM {cat} WHERE parent_category_id <> 0
                UNION ALL
                SELECT c.parent_category_id, w.descendant, w.depth + 1
                FROM walk w JOIN {cat} c ON c.category_id = w.ancestor
                WHERE c.parent_category_id <> 0)
            SELECT CAST(ancestor AS BIGINT) AS ancestor, CAST(descendant AS BIGINT) AS descendant,
                   CAST(depth AS INTEGER) AS depth FROM walk)
    """


def scope_cte(cat: str, closure: str) -> str:
    return f"""
        SELECT ancestor AS scope_id, descendant AS category_id FROM {closure}
        UNION ALL
        SELECT category_id AS scope_id, category_id FROM {cat}
        WHERE category_id NOT IN (SELECT ancestor FROM {closure})
    """


CTES["closure"] = (closure_cte("categories"), ["categories"])
CTES["scope"] = (scope_cte("categories", "closure"), ["categories", "closure"])
CTES["closure_deep"] = (closure_cte("categories_deep"), ["categories_deep"])
CTES["scope_deep"] = (scope_cte("categories_deep", "closure_deep"), ["categories_deep", "closure_deep"])


def with_ctes(names: list[str], extra: list[tuple[str, str]], final: str) -> str:
    """``WITH`` prefix with ``names`` (and dependencies, in order) then ``extra`` CTEs, then ``final``."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][1]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in ordered] + [f"{n} AS ({body})" for n, body in extra]
    return "WITH " + ",\n".join(parts) + "\n" + final
