"""Oracle SQL (DuckDB) for every registered query.

Written independently of the Spark code path: medians over raw prices instead
of histograms, the original four-branch order rule instead of its closed form,
plain windows instead of two-level running sums.
"""

from __future__ import annotations

from .fixtures import with_ctes

EV_FROM, EV_TO = "2024-01-02", "2024-01-30"

# The four-branch gap rule exactly as specified (mn, mx, pv columns in scope).
ORDERS_4 = """GREATEST(CASE WHEN mn < pv THEN (mx - mn) - (pv - mn)
                     WHEN pv - mx >= 0 THEN (mx - mn) + (pv - mx)
                     WHEN pv > 0 AND mn > pv THEN (mx - mn) + (mn - pv)
                     ELSE mx - mn END, 0)"""


def pd_cte(src: str, keys: str, where: str, extra: str = "") -> str:
    """Product-day block from raw snapshot rows: mn, mx, stock, med (+ extra aggregates)."""
    k = f"{keys}, " if keys else ""
    return f"""
        SELECT {k}product_id, date, min(total_orders_amount) AS mn, max(total_orders_amount) AS mx,
               min(available_amount) AS stock, median(purchase_price) AS med {extra}
        FROM {src} WHERE {where}
        GROUP BY {k}product_id, date"""


def orders_cte(pd: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
        SELECT *, {ORDERS_4} AS orders FROM (
            SELECT *, coalesce(lag(mx) OVER (PARTITION BY {k}product_id ORDER BY date), 0) AS pv FROM {pd})"""


def category_daily() -> str:
    return with_ctes(
        ["snap_events", "scope"],
        [("src", f"""SELECT s.scope_id, r.* FROM snap_events r JOIN scope s ON r.category_id = s.category_id
                     WHERE r.date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}'"""),
         ("pd", pd_cte("src", "scope_id", "TRUE")),
         ("po", orders_cte("pd", "scope_id")),
         ("agg", """SELECT scope_id, date, CAST(sum(orders) AS BIGINT) AS order_amount,
                           sum(orders * med) AS rev, CAST(sum(stock) AS BIGINT) AS available_amount
                    FROM po GROUP BY scope_id, date""")],
        """SELECT scope_id AS category_id, date, order_amount,
                  (CASE WHEN rev <= 0 THEN 0.0 ELSE rev END) / 100 AS revenue,
                  CASE WHEN order_amount <= 0 THEN 0.0
                       ELSE ((CASE WHEN rev <= 0 THEN 0.0 ELSE rev END) / 100) / order_amount END AS average_bill,
                  available_amount
           FROM agg""")


EV_TS = "TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59.999999'"
EV_D = f"DATE '{EV_FROM}' AND DATE '{EV_TO}'"



def half_up(num: str, den: str, scale: int) -> str:
    """round(num / den, scale) half away from zero in integer arithmetic; NULL when den <= 0."""
    f = 10 ** scale
    return (f"CASE WHEN {den} > 0 THEN sign({num}) * ((abs({num}) * {2 * f} + {den}) // (2 * ({den}))) / {f} END")


def scoped_src(src: str = "snap_events", where: str = f"r.date BETWEEN {EV_D}") -> str:
    return f"SELECT s.scope_id, r.* FROM {src} r JOIN scope s ON r.category_id = s.category_id WHERE {where}"


def category_adhoc() -> str:
    return with_ctes(
        ["snap_events", "scope"],
        [("src", scoped_src()), ("pd", pd_cte("src", "scope_id", "TRUE")), ("po", orders_cte("pd", "scope_id")),
         ("agg", """SELECT scope_id, CAST(sum(orders) AS BIGINT) AS order_amount,
                           CAST(sum(stock) AS BIGINT) AS available_amount, sum(orders * med) AS revenue,
                           median(med) AS med_all FROM po GROUP BY scope_id"""),
         ("dist", """SELECT scope_id, count(DISTINCT seller_id) AS seller_count,
                            count(DISTINCT product_id) AS product_count FROM src GROUP BY scope_id""")],
        """SELECT scope_id AS category_id, order_amount, available_amount, revenue,
                  CASE WHEN order_amount > 0 THEN med_all ELSE 0.0 END AS median_price,
                  CASE WHEN order_amount > 0 THEN revenue / order_amount ELSE 0.0 END AS avg_bill,
                  seller_count, product_count,
                  order_amount / NULLIF(product_count, 0) AS order_per_product,
                  order_amount / NULLIF(seller_count, 0) AS order_per_seller,
                  CASE WHEN order_amount > 0 THEN revenue / product_count ELSE 0.0 END AS revenue_per_product
           FROM agg JOIN dist USING (scope_id)""")


def category_overall() -> str:
    return with_ctes(
        ["snap_events", "scope"],
        [("src", scoped_src(where=f"r.ts BETWEEN {EV_TS}")),
         ("pp", """SELECT scope_id, product_id, max(total_orders_amount) - min(total_orders_amount) AS o,
                          median(purchase_price) AS p, max(seller_id) AS s FROM src GROUP BY scope_id, product_id"""),
         ("prod", """SELECT scope_id, CAST(sum(CASE WHEN o > 0 THEN p * 2 END) AS BIGINT) AS p2,
                            count(*) FILTER (WHERE o > 0) AS n,
                            sum(CASE WHEN o > 0 THEN o * p END) / 100 AS revenue,
                            CAST(sum(CASE WHEN o > 0 THEN o END) AS BIGINT) AS order_count,
                            count(*) FILTER (WHERE o <= 0) AS product_zero_sales_count
                     FROM pp GROUP BY scope_id"""),
         ("sell", """SELECT scope_id, count(*) FILTER (WHERE so <= 0) AS seller_with_zero_sales_count
                     FROM (SELECT scope_id, s, sum(o) AS so FROM pp GROUP BY scope_id, s) GROUP BY scope_id"""),
         ("dist", """SELECT scope_id, count(DISTINCT seller_id) AS seller_counts,
                            count(DISTINCT product_id) AS product_counts FROM src GROUP BY scope_id""")],
        f"""SELECT scope_id AS category_id, {half_up('p2', 'n * 200', 2)} AS avg_price, revenue, order_count,
                   seller_counts, product_counts, {half_up('order_count', 'seller_counts', 3)} AS sales_per_seller,
                   seller_with_zero_sales_count, product_zero_sales_count
            FROM prod JOIN sell USING (scope_id) JOIN dist USING (scope_id)""")


def _report_pd(key_src: str, key: str) -> str:
    return f"""
        SELECT {key}, product_id, date, min(total_orders_amount) AS mn, max(total_orders_amount) AS mx,
               min(available_amount) AS stock, median(purchase_price) AS med, max(seller_title) AS seller_title,
               max(seller_id) AS seller_id, arg_max(category_id, ts) AS cat, arg_max(title, ts) AS title
        FROM {key_src} GROUP BY {key}, product_id, date"""


def _report_rows(key: str) -> list[tuple[str, str]]:
    return [
        ("rows", f"""SELECT {key}, product_id, arg_max(seller_title, date) AS seller_title,
                            arg_max(seller_id, date) AS seller_id, arg_max(cat, date) AS latest_category_id,
                            arg_max(stock, date) AS available_amounts, arg_max(med / 100, date) AS purchase_price,
                            arg_max(title, date) AS name, list(orders ORDER BY date) AS order_graph,
                            list(stock ORDER BY date) AS available_amount_graph,
                            list(med / 100 ORDER BY date) AS price_graph, sum(orders * med) / 100 AS sales
                     FROM po GROUP BY {key}, product_id"""),
        ("ranked", f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY product_id) AS rn,
                              count(*) OVER (PARTITION BY {key}) AS total FROM rows"""),
    ]


REPORT_COLS = """product_id, seller_title, seller_id, latest_category_id, available_amounts, purchase_price, name,
                 order_graph, available_amount_graph, price_graph, sales, total, c.title AS category_name"""


def category_report() -> str:
    return with_ctes(
        ["snap_events", "scope"],
        [("src", scoped_src()), ("pd", _report_pd("src", "scope_id")), ("po", orders_cte("pd", "scope_id")),
         *_report_rows("scope_id")],
        f"""SELECT scope_id AS category_id, {REPORT_COLS}
            FROM ranked r LEFT JOIN categories c ON c.category_id = r.latest_category_id
""")


def seller_report() -> str:
    return with_ctes(
        ["snap_events", "categories"],
        [("src", f"SELECT * FROM snap_events WHERE date BETWEEN {EV_D}"), ("pd", _report_pd("src", "seller_link")),
         ("po", orders_cte("pd", "seller_link")), *_report_rows("seller_link")],
        f"""SELECT seller_link, {REPORT_COLS}
            FROM ranked r LEFT JOIN categories c ON c.category_id = r.latest_category_id
""")


def category_closure() -> str:
    return with_ctes(["closure_deep"], [], "SELECT ancestor, descendant, depth FROM closure_deep")


def category_info() -> str:
    return with_ctes(
        ["categories"],
        [("ch", """SELECT parent_category_id AS category_id, list(category_id ORDER BY category_id) AS children_ids
                   FROM categories WHERE parent_category_id <> 0 GROUP BY parent_category_id""")],
        """SELECT c.category_id, c.title AS name, c.parent_category_id AS parent_id,
                  coalesce(ch.children_ids, CAST([] AS BIGINT[])) AS children_ids
           FROM categories c LEFT JOIN ch USING (category_id)""")


def daily_state() -> str:
    return with_ctes(["snap_events"], [], """
        SELECT product_id, sku_id, date, max(category_id) AS category_id,
               min(total_orders_amount) AS min_total_order_amount, max(total_orders_amount) AS max_total_order_amount,
               min(available_amount) AS min_available_amount, max(available_amount) AS max_available_amount,
               max(seller_id) AS seller_id, max(seller_account_id) AS seller_account_id,
               max(seller_title) AS seller_title, max(seller_link) AS seller_link, max(rating) AS rating,
               median(purchase_price) AS median_price, median(full_price) AS median_full_price,
               arg_max(title, ts) AS title, arg_max(photo_key, ts) AS photo_key,
               arg_max(reviews_amount, ts) AS reviews_amount
        FROM snap_events GROUP BY product_id, sku_id, date""")


def first_discovered() -> str:
    return with_ctes(["snap_events"], [], """
        SELECT product_id, sku_id, min(ts) AS first_discovered FROM snap_events GROUP BY product_id, sku_id""")


def sku_history() -> str:
    return with_ctes(
        ["snap_events"],
        [("day", f"""
            SELECT product_id, sku_id, date, arg_min(title, ts) AS title, min(available_amount) AS amin,
                   max(available_amount) AS amax, arg_max(available_amount, ts) AS alast,
                   max(total_orders_amount) - min(total_orders_amount) AS toa_diff,
                   max(total_available_amount) AS total_available_amount,
                   max(reviews_amount) - min(reviews_amount) AS review_amount,
                   median(purchase_price) AS med,
                   arg_min(full_price, ts) FILTER (WHERE full_price IS NOT NULL) AS full_price_any,
                   arg_min(photo_key, ts) AS photo_key
            FROM snap_events WHERE ts BETWEEN {EV_TS} GROUP BY product_id, sku_id, date"""),
         ("w", """SELECT *, coalesce(lag(alast) OVER (PARTITION BY product_id, sku_id ORDER BY date), 0) AS prev_last,
                  FROM day"""),
         ("o", """SELECT *, CASE WHEN amax > prev_last THEN 0 ELSE amax - amin END AS diff FROM w"""),
         ("f", """SELECT *, CASE WHEN diff < 0 OR (diff > 0 AND toa_diff = 0) THEN 0 ELSE diff END AS oa FROM o""")],
        """SELECT date, product_id, sku_id, title, oa AS order_amount, review_amount, full_price_any / 100 AS full_price,
                  med / 100 AS purchase_price, photo_key, oa * (med / 100) AS sales_amount,
                  alast AS available_amount, total_available_amount FROM f""")


def products_sales() -> str:
    return with_ctes(
        ["snap_events"],
        [("src", f"SELECT * FROM snap_events WHERE ts BETWEEN {EV_TS}"),
         ("pd", pd_cte("src", "", "TRUE", """, max(seller_title) AS seller_title, max(seller_link) AS seller_link,
                max(seller_account_id) AS seller_account_id, arg_max(title, ts) AS title""")),
         ("po", orders_cte("pd", ""))],
        f"""SELECT product_id, arg_min(title, date) AS title, CAST(sum(orders) AS BIGINT) AS order_amount,
                   sum(orders * med) / 100 AS sales_amount, arg_min(seller_title, date) AS seller_title,
                   arg_min(seller_link, date) AS seller_link, arg_min(seller_account_id, date) AS seller_account_id,
                   CAST(sum(orders) AS BIGINT) / (DATE '{EV_TO}' - DATE '{EV_FROM}') AS daily_order_amount
            FROM po GROUP BY product_id""")


def products_order_chart() -> str:
    return with_ctes(
        ["snap_events"],
        [("d", f"""SELECT product_id, date, max(total_orders_amount) - min(total_orders_amount) AS order_amount
                   FROM snap_events WHERE date BETWEEN {EV_D} GROUP BY product_id, date""")],
        "SELECT product_id, list(order_amount ORDER BY date) AS order_amount_chart FROM d GROUP BY product_id")


def product_daily_card() -> str:
    return with_ctes(
        ["snap_events", "categories"],
        [("src", f"SELECT * FROM snap_events WHERE date BETWEEN {EV_D}"),
         ("pd", pd_cte("src", "", "TRUE", """, median(full_price) AS full_med, max(seller_link) AS seller_link,
                max(seller_title) AS seller_title, max(rating) AS rating, arg_max(title, ts) AS title,
                arg_max(category_id, ts) AS category_id, arg_max(reviews_amount, ts) AS review_amount,
                arg_max(photo_key, ts) AS photo_key""")),
         ("po", orders_cte("pd", "")),
         ("st", """SELECT product_id, date, CAST(sum(m) AS BIGINT) AS stock_sum FROM (
                       SELECT product_id, sku_id, date, min(available_amount) AS m FROM src
                       GROUP BY product_id, sku_id, date) GROUP BY product_id, date"""),
         ("bounds", "SELECT product_id, min(date) AS lo, max(date) AS last_obs FROM po GROUP BY product_id"),
         ("cal", f"""SELECT product_id, CAST(unnest(generate_series(lo,
                            CASE WHEN last_obs >= DATE '{EV_TO}' THEN DATE '{EV_TO}' ELSE DATE '{EV_TO}' - 1 END,
                            INTERVAL 1 DAY)) AS DATE) AS date FROM bounds"""),
         ("charts", """SELECT c.product_id, list(coalesce(po.med / 100, 0.0) ORDER BY c.date) AS price_chart,
                              list(coalesce(po.orders * po.med / 100, 0.0) ORDER BY c.date) AS revenue_chart,
                              list(coalesce(po.orders, 0) ORDER BY c.date) AS order_chart
                       FROM cal c LEFT JOIN po USING (product_id, date) GROUP BY c.product_id"""),
         ("scal", """SELECT po.product_id, arg_max(title, po.date) AS title, arg_max(category_id, po.date) AS category_id,
                            arg_max(seller_link, po.date) AS seller_link, arg_max(seller_title, po.date) AS seller_title,
                            arg_max(med / 100, po.date) AS price, arg_max_null(full_med / 100, po.date) AS full_price,
                            arg_max(review_amount, po.date) AS review_amount, arg_max(photo_key, po.date) AS photo_key,
                            arg_max(rating, po.date) AS rating, sum(orders * med) / 100 AS revenue_sum,
                            list(st.stock_sum ORDER BY po.date) AS available_chart
                     FROM po JOIN st USING (product_id, date) GROUP BY po.product_id"""),
         ("fd", "SELECT product_id, min(date) AS first_discovered FROM snap_events GROUP BY product_id")],
        """SELECT s.*, ch.price_chart, ch.revenue_chart, ch.order_chart, fd.first_discovered,
                  coalesce(c.title, 'unknown') AS category_name
           FROM scal s JOIN charts ch USING (product_id) JOIN fd USING (product_id)
           LEFT JOIN categories c ON c.category_id = s.category_id""")


def _seller_po() -> list[tuple[str, str]]:
    return [("src", f"SELECT * FROM snap_events WHERE date BETWEEN {EV_D}"),
            ("pd", pd_cte("src", "seller_link", "TRUE")), ("po", orders_cte("pd", "seller_link"))]


SELLER_OVERALL = """SELECT seller_link, CAST(sum(o) AS BIGINT) AS order_amount, sum(r) / 100 AS revenue,
                           count(*) AS product_count, count(*) FILTER (WHERE o > 0) AS product_with_sales,
                           count(*) FILTER (WHERE o <= 0) AS product_without_sales,
                           round(sum(p) / NULLIF(count(*) FILTER (WHERE o > 0), 0)) AS avg_price
                    FROM (SELECT seller_link, product_id, sum(orders) AS o, sum(orders * med) AS r, avg(med / 100) AS p
                          FROM po GROUP BY seller_link, product_id) GROUP BY seller_link"""


def seller_overall() -> str:
    return with_ctes(["snap_events"], _seller_po(), SELLER_OVERALL)


def seller_order_dynamic() -> str:
    return with_ctes(["snap_events"], _seller_po(), """
        SELECT seller_link, date, CAST(sum(orders) AS BIGINT) AS order_amount FROM po GROUP BY seller_link, date""")


def seller_card() -> str:
    return with_ctes(
        ["snap_events"],
        [*_seller_po(), ("ov", SELLER_OVERALL),
         ("dyn", """SELECT seller_link, date, CAST(sum(orders) AS BIGINT) AS order_amount FROM po
                    GROUP BY seller_link, date"""),
         ("dl", """SELECT seller_link, list({'date': date, 'order_amount': order_amount} ORDER BY date) AS sales_dynamic
                   FROM dyn GROUP BY seller_link""")],
        "SELECT ov.*, dl.sales_dynamic FROM ov LEFT JOIN dl USING (seller_link)")


def seller_shops() -> str:
    return with_ctes(
        ["report_requests", "sellers"],
        [("links", "SELECT DISTINCT key AS request_link FROM report_requests WHERE report_type = 'seller'"),
         ("owners", """SELECT l.request_link, s.account_id FROM links l JOIN sellers s ON s.link = l.request_link""")],
        """SELECT o.request_link, s.title, s.link AS shop_link, o.account_id
           FROM owners o JOIN sellers s USING (account_id)""")


def position_history() -> str:
    return with_ctes(
        ["positions"],
        [("p", f"""SELECT category_id, product_id, sku_id, CAST(ts AS DATE) AS date, arg_max(position, ts) AS position
                   FROM positions
                   WHERE ts BETWEEN TIMESTAMP '{EV_FROM} 00:00:00' AND TIMESTAMP '{EV_TO} 00:00:00'
                   GROUP BY category_id, product_id, sku_id, CAST(ts AS DATE)"""),
         ("k", "SELECT DISTINCT category_id, product_id, sku_id FROM p"),
         ("days", f"""SELECT CAST(unnest(generate_series(DATE '{EV_FROM}', DATE '{EV_TO}' - 1, INTERVAL 1 DAY)) AS DATE)
                      AS date"""),
         ("cal", "SELECT k.*, days.date FROM k CROSS JOIN days")],
        """SELECT category_id, product_id, sku_id, date, coalesce(p.position, 0) AS position
           FROM cal FULL OUTER JOIN p USING (category_id, product_id, sku_id, date)""")


ORACLE = {
    "category_daily": category_daily,
    "category_adhoc": category_adhoc,
    "category_overall": category_overall,
    "category_report": category_report,
    "category_closure": category_closure,
    "category_info": category_info,
    "daily_state": daily_state,
    "product_first_discovered": first_discovered,
    "product_sku_history": sku_history,
    "products_sales": products_sales,
    "products_order_chart": products_order_chart,
    "product_daily_card": product_daily_card,
    "seller_overall": seller_overall,
    "seller_order_dynamic": seller_order_dynamic,
    "seller_report": seller_report,
    "seller_card": seller_card,
    "seller_shops": seller_shops,
    "position_history": position_history,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}


# ------------------------------------------------------------------ rollups

from ..plans.rollups import period_bounds  # noqa: E402

EV_AS_OF, LI_AS_OF = "2024-01-31", "2000-06-30"
EV_PERIODS = ["WEEK", "TWO_WEEK", "MONTH", "TWO_MONTH"]
Q13_PERIODS = LI_PERIODS = EV_PERIODS

ORDERS_4_RAW = ORDERS_4.replace("GREATEST(", "(").replace(", 0)", ")")


def win_values(as_of: str, periods: list[str], with_prev: bool) -> str:
    rows = []
    for p in periods:
        for kind in (["cur", "prev"] if with_prev else ["cur"]):
            lo, hi = period_bounds(as_of, p, kind == "prev")
            rows.append(f"('{p}', '{kind}', DATE '{lo}', DATE '{hi}')")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(period, kind, lo, hi)"


def _roots(scope: str, cats: str) -> str:
    return f"""SELECT s.scope_id, s.category_id FROM {scope} s JOIN {cats} c ON c.category_id = s.scope_id
               WHERE c.parent_category_id = 0"""


def _j3_ctes() -> list[tuple[str, str]]:
    return [
        ("win3", win_values(LI_AS_OF, LI_PERIODS, True)),
        ("rs3", _roots("scope_deep", "categories_deep")),
        ("raw3", """SELECT w.period, w.kind, rs3.scope_id, r.* FROM snap_lineitem r JOIN rs3 USING (category_id)
                    JOIN win3 w ON r.ts BETWEEN CAST(w.lo AS TIMESTAMP) AND CAST(w.hi AS TIMESTAMP)"""),
        ("pd3", """SELECT period, kind, scope_id, product_id, date, min(total_orders_amount) AS mn,
                          max(total_orders_amount) AS mx, min(total_available_amount) AS stock,
                          median(purchase_price) AS med, max({'ts': ts, 'sku_id': sku_id, 'c': category_id}).c AS cat
                   FROM raw3 GROUP BY period, kind, scope_id, product_id, date"""),
        ("po3", orders_cte("pd3", "period, kind, scope_id")),
        ("pc3", """SELECT period, kind, scope_id, cat AS category_id, CAST(sum(orders) AS BIGINT) AS order_amount,
                          CAST(sum(stock) AS BIGINT) AS available_amount, sum(orders * med) AS revenue,
                          median(med) AS med_all
                   FROM po3 GROUP BY period, kind, scope_id, cat"""),
        ("dist3", """SELECT w.period, w.kind, rs3.scope_id, count(DISTINCT seller_id) AS seller_count,
                            count(DISTINCT product_id) AS product_count
                     FROM snap_lineitem r JOIN rs3 USING (category_id) JOIN win3 w ON r.date BETWEEN w.lo AND w.hi
                     GROUP BY w.period, w.kind, rs3.scope_id"""),
        ("m3", """SELECT pc3.*, d.seller_count, d.product_count,
                         CASE WHEN order_amount > 0 THEN med_all ELSE 0.0 END AS median_price,
                         CASE WHEN order_amount > 0 THEN revenue / order_amount ELSE 0.0 END AS avg_bill,
                         order_amount / NULLIF(product_count, 0) AS order_per_product,
                         order_amount / NULLIF(seller_count, 0) AS order_per_seller,
                         CASE WHEN order_amount > 0 THEN revenue / product_count ELSE 0.0 END AS revenue_per_product
                  FROM pc3 JOIN dist3 d USING (period, kind, scope_id)"""),
        ("j3", f"""SELECT c.period, c.category_id, {', '.join('c.' + x for x in J3_COLS)},
                          {', '.join(f'p.{x} AS prev_{x}' for x in J3_COLS)}, DATE '{LI_AS_OF}' AS as_of
                   FROM m3 c JOIN m3 p ON c.period = p.period AND c.scope_id = p.scope_id
                        AND c.category_id = p.category_id AND c.kind = 'cur' AND p.kind = 'prev'"""),
    ]


J3_COLS = ["order_amount", "available_amount", "revenue", "median_price", "avg_bill", "seller_count",
           "product_count", "order_per_product", "order_per_seller", "revenue_per_product"]
Q10_COLS = ["order_amount", "available_amount", "revenue", "avg_bill", "seller_count", "product_count",
            "order_per_product", "order_per_seller", "revenue_per_product"]


def category_rollup_prev() -> str:
    return with_ctes(["snap_lineitem", "scope_deep"], _j3_ctes(), "SELECT * FROM j3")


def _q10_ctes() -> list[tuple[str, str]]:
    ratios = []
    for p in ("", "prev_"):
        ratios += [f"CASE WHEN {p}order_amount > 0 THEN {p}revenue / {p}order_amount ELSE 0.0 END AS {p}avg_bill",
                   f"CASE WHEN {p}order_amount > 0 THEN {p}order_amount / {p}product_count ELSE 0.0 END "
                   f"AS {p}order_per_product",
                   f"CASE WHEN {p}order_amount > 0 THEN {p}order_amount / {p}seller_count ELSE 0.0 END "
                   f"AS {p}order_per_seller",
                   f"CASE WHEN {p}order_amount > 0 THEN {p}revenue / {p}product_count ELSE 0.0 END "
                   f"AS {p}revenue_per_product"]
    return [
        *_j3_ctes(),
        ("s10", """SELECT j.period, sc.scope_id, CAST(sum(order_amount) AS BIGINT) AS order_amount,
                          CAST(sum(available_amount) AS BIGINT) AS available_amount,
                          CAST(sum(prev_order_amount) AS BIGINT) AS prev_order_amount,
                          CAST(sum(prev_available_amount) AS BIGINT) AS prev_available_amount,
                          sum(revenue) / 100 AS revenue, sum(prev_revenue) / 100 AS prev_revenue
                   FROM j3 j JOIN scope_deep sc USING (category_id) GROUP BY j.period, sc.scope_id"""),
        ("d10", """SELECT w.period, sc.scope_id,
                          count(DISTINCT CASE WHEN w.kind = 'cur' THEN seller_id END) AS seller_count,
                          count(DISTINCT CASE WHEN w.kind = 'cur' THEN product_id END) AS product_count,
                          count(DISTINCT CASE WHEN w.kind = 'prev' THEN seller_id END) AS prev_seller_count,
                          count(DISTINCT CASE WHEN w.kind = 'prev' THEN product_id END) AS prev_product_count
                   FROM snap_lineitem r JOIN scope_deep sc USING (category_id)
                   JOIN win3 w ON r.date BETWEEN w.lo AND w.hi GROUP BY w.period, sc.scope_id"""),
        ("q10", f"""SELECT period, scope_id AS category_id, order_amount, available_amount, revenue,
                           prev_order_amount, prev_available_amount, prev_revenue,
                           seller_count, product_count, prev_seller_count, prev_product_count, {', '.join(ratios)}
                    FROM s10 LEFT JOIN d10 USING (period, scope_id)"""),
    ]


def category_with_prev() -> str:
    cols = ", ".join(Q10_COLS + [f"prev_{c}" for c in Q10_COLS])
    return with_ctes(["snap_lineitem", "scope_deep"], _q10_ctes(), f"SELECT period, category_id, {cols} FROM q10")


DIFF_METRICS = ["revenue", "revenue_per_product", "order_amount", "product_count", "seller_count", "avg_bill",
                "order_per_seller", "order_per_product"]


def category_cards() -> str:
    cols = []
    for p in ("", "prev_"):
        rev2 = f"CAST(round({p}revenue * 200) AS BIGINT)"
        oa, pc, sc = f"{p}order_amount", f"{p}product_count", f"{p}seller_count"
        cols += [oa, f"{half_up(rev2, '200', 2)} AS {p}revenue",
                 f"CASE WHEN {oa} > 0 THEN {half_up(rev2, f'{oa} * 200', 2)} ELSE 0.0 END AS {p}average_bill",
                 sc, pc,
                 f"CASE WHEN {oa} > 0 THEN {half_up(oa, pc, 2)} ELSE 0.0 END AS {p}order_per_product",
                 f"CASE WHEN {oa} > 0 THEN {half_up(oa, sc, 2)} ELSE 0.0 END AS {p}order_per_seller",
                 f"CASE WHEN {oa} > 0 THEN {half_up(rev2, f'{pc} * 200', 2)} ELSE 0.0 END AS {p}revenue_per_product"]
    diffs = [f"""CASE WHEN CAST(prev_{m} AS DOUBLE) = 0 THEN 0.0
                 ELSE trunc(100.0 * (CAST({m} AS DOUBLE) - CAST(prev_{m} AS DOUBLE)) / abs(CAST(prev_{m} AS DOUBLE))
                            * 10) / 10 END AS {m}_diff""" for m in DIFF_METRICS]
    return with_ctes(
        ["snap_lineitem", "scope_deep", "categories_deep"],
        [*_q10_ctes(),
         ("ch", """SELECT parent_category_id AS category_id, list(category_id ORDER BY category_id) AS children_ids
                   FROM categories_deep WHERE parent_category_id <> 0 GROUP BY parent_category_id""")],
        f"""SELECT q.period, q.category_id, {', '.join(cols)}, {', '.join(diffs)},
                   c.title AS name, c.parent_category_id AS parent_id,
                   coalesce(ch.children_ids, CAST([] AS BIGINT[])) AS children_ids
            FROM q10 q JOIN categories_deep c ON c.category_id = q.category_id
            LEFT JOIN ch ON ch.category_id = q.category_id""")


def _j2_ctes(periods: list[str]) -> list[tuple[str, str]]:
    return [
        ("win2", win_values(EV_AS_OF, periods, False)),
        ("rs2", _roots("scope", "categories")),
        ("sd", """SELECT product_id, sku_id, date, max(category_id) AS category_id, max(total_orders_amount) AS toa,
                         CAST(trunc(median(purchase_price)) AS BIGINT) AS price, max(rating) AS rating,
                         min(available_amount) AS amin, arg_max(title, ts) AS title, arg_max(photo_key, ts) AS photo_key,
                         arg_max(reviews_amount, ts) AS reviews_amount
                  FROM snap_events WHERE category_id IN (SELECT category_id FROM rs2)
                  GROUP BY product_id, sku_id, date"""),
        ("sd2", """SELECT sd.*, CAST(sum(amin) OVER (PARTITION BY rs2.scope_id, product_id, date) AS BIGINT) AS stock_day
                   FROM sd JOIN rs2 USING (category_id)"""),
        ("sdw", """SELECT w.period, sd2.* FROM sd2 JOIN win2 w ON sd2.date BETWEEN w.lo AND w.hi"""),
    ]


LAST2 = """max({'date': date, 'sku_id': sku_id, 'title': title, 'photo_key': photo_key,
               'reviews_amount': reviews_amount, 'rating': rating, 'available_amount': stock_day})"""


def category_product_rollup() -> str:
    return with_ctes(
        ["snap_events", "scope"], _j2_ctes(EV_PERIODS),
        f"""SELECT period, DATE '{EV_AS_OF}' AS as_of, category_id, product_id, l.title AS title,
                   max_total_order_amount, min_total_order_amount, median_price, l.reviews_amount AS reviews_amount,
                   l.photo_key AS photo_key, l.rating AS rating, l.available_amount AS available_amount
            FROM (SELECT period, category_id, product_id, max(toa) AS max_total_order_amount,
                         min(toa) AS min_total_order_amount, median(price) AS median_price, {LAST2} AS l
                  FROM sdw GROUP BY period, category_id, product_id)""")


def _q13_ctes() -> list[tuple[str, str]]:
    return [
        *_j2_ctes(Q13_PERIODS),
        ("q", f"""SELECT period, sc.scope_id, product_id, max(toa) - min(toa) AS order_amount, median(price) AS med,
                         {LAST2} AS l
                  FROM sdw JOIN scope sc USING (category_id) GROUP BY period, sc.scope_id, product_id"""),
        ("qr", """SELECT period, scope_id AS category_id, product_id, l.title AS title, order_amount,
                         med / 100 AS price, med / 100 * order_amount AS revenue,
                         l.available_amount AS available_amount, l.reviews_amount AS reviews_amount,
                         l.photo_key AS photo_key, l.rating AS rating
                  FROM q WHERE order_amount >= 1"""),
        ("q13", f"""SELECT * EXCLUDE (rn) FROM (
                       SELECT *, count(*) OVER (PARTITION BY period, category_id) AS total_row_count,
                              row_number() OVER (PARTITION BY period, category_id ORDER BY revenue DESC, product_id)
                                  AS rn
                       FROM qr)"""),
    ]


def category_products() -> str:
    return with_ctes(["snap_events", "scope"], _q13_ctes(), "SELECT * FROM q13")


def category_products_chart() -> str:
    return with_ctes(
        ["snap_events", "scope"],
        [*_q13_ctes(),
         ("chart", f"""SELECT period, product_id, list(o ORDER BY date) AS order_amount_chart FROM (
                          SELECT w.period, product_id, date, max(total_orders_amount) - min(total_orders_amount) AS o
                          FROM snap_events r JOIN ({win_values(EV_AS_OF, Q13_PERIODS, False)}) w
                               ON r.date BETWEEN w.lo AND w.hi
                          WHERE product_id IN (SELECT product_id FROM q13)
                          GROUP BY w.period, product_id, date) GROUP BY period, product_id""")],
        """SELECT q13.* REPLACE (CAST(round(rating, 1) AS DOUBLE) AS rating), chart.order_amount_chart
           FROM q13 LEFT JOIN chart USING (period, product_id)""")


def category_daily_stats() -> str:
    return with_ctes(
        ["snap_events"],
        [("pd", """SELECT product_id, date, min(total_orders_amount) AS mn, max(total_orders_amount) AS mx,
                          min(total_available_amount) AS stock, median(purchase_price) AS med,
                          max({'ts': ts, 'sku_id': sku_id, 'c': category_id, 's': seller_id}) AS l
                   FROM snap_events GROUP BY product_id, date"""),
         ("po", f"""SELECT *, {ORDERS_4_RAW} AS o FROM (
                       SELECT *, coalesce(lag(mx) OVER (PARTITION BY product_id ORDER BY date), 0) AS pv FROM pd)""")],
        """SELECT l.c AS category_id, date,
                  coalesce(CAST(sum(o) FILTER (WHERE o > 0) AS BIGINT), 0) AS orders,
                  CAST(sum(stock) AS BIGINT) AS available_amount,
                  median(med) AS median_price_all, median(med) FILTER (WHERE o > 0) AS median_price_with_sales,
                  sum(med * o) AS revenue, count(DISTINCT l.s) AS seller_count, count(DISTINCT product_id) AS product_count,
                  count(DISTINCT l.s) FILTER (WHERE o > 0) AS seller_with_sales,
                  count(DISTINCT product_id) FILTER (WHERE o > 0) AS product_with_sales
           FROM po GROUP BY l.c, date""")


ORACLE.update({
    "category_product_rollup": category_product_rollup,
    "category_rollup_prev": category_rollup_prev,
    "category_daily_stats": category_daily_stats,
    "category_with_prev": category_with_prev,
    "category_cards": category_cards,
    "category_products": category_products,
    "category_products_chart": category_products_chart,
})


# ------------------------------------------------------------------ reports and accounts

def _report_row_ctes(base_ctes: list[tuple[str, str]], key: str, page_src: str) -> list[tuple[str, str]]:
    return [
        *base_ctes,
        ("pg", "SELECT * FROM ranked"),
        ("rr", f"""SELECT {key}, r.seller_title, r.product_id, r.name, c.title AS category_name, r.available_amounts,
                          CAST(len(list_filter(r.available_amount_graph, lambda x: x > 0)) AS INTEGER) AS days_in_stock,
                          r.purchase_price, CAST(list_sum(r.order_graph) AS BIGINT) AS orders,
                          sign(CAST(round(r.sales * 200) AS BIGINT))
                              * ((abs(CAST(round(r.sales * 200) AS BIGINT)) + 1) // 2) AS revenue_cents
                   FROM pg r LEFT JOIN categories c ON c.category_id = r.latest_category_id"""),
        ("abc", f"""SELECT rr.*,
                      (SELECT CASE WHEN sum(o.orders) = 0 THEN NULL
                                   WHEN 100 * (coalesce(sum(o.orders) FILTER (WHERE o.orders > rr.orders), 0)
                                               + rr.orders) < 81 * sum(o.orders) THEN 'A'
                                   WHEN 100 * (coalesce(sum(o.orders) FILTER (WHERE o.orders > rr.orders), 0)
                                               + rr.orders) < 96 * sum(o.orders) THEN 'B' ELSE 'C' END
                       FROM rr o WHERE o.{key} = rr.{key}) AS abc_orders,
                      (SELECT CASE WHEN sum(o.revenue_cents) = 0 THEN NULL
                                   WHEN 100 * (coalesce(sum(o.revenue_cents) FILTER (WHERE o.revenue_cents > rr.revenue_cents), 0)
                                               + rr.revenue_cents) < 81 * sum(o.revenue_cents) THEN 'A'
                                   WHEN 100 * (coalesce(sum(o.revenue_cents) FILTER (WHERE o.revenue_cents > rr.revenue_cents), 0)
                                               + rr.revenue_cents) < 96 * sum(o.revenue_cents) THEN 'B' ELSE 'C' END
                       FROM rr o WHERE o.{key} = rr.{key}) AS abc_revenue
                   FROM rr"""),
        ("rows_final", "SELECT * EXCLUDE (revenue_cents), revenue_cents / 100 AS revenue FROM abc"),
    ]


def _seller_rows_ctes():
    base = [("src", f"SELECT * FROM snap_events WHERE date BETWEEN {EV_D}"), ("pd", _report_pd("src", "seller_link")),
            ("po", orders_cte("pd", "seller_link")), *_report_rows("seller_link")]
    return _report_row_ctes(base, "seller_link", "ranked")


def seller_report_rows() -> str:
    return with_ctes(["snap_events", "categories"], _seller_rows_ctes(), "SELECT * FROM rows_final")


def abc_orders() -> str:
    return with_ctes(["snap_events", "categories"], _seller_rows_ctes(),
                     "SELECT seller_link, product_id, orders, abc_orders FROM rows_final")


def days_in_stock() -> str:
    return with_ctes(["snap_events", "categories"], _seller_rows_ctes(),
                     "SELECT seller_link, product_id, days_in_stock, available_amounts FROM rows_final")


def abc_revenue() -> str:
    base = [("src", scoped_src()), ("pd", _report_pd("src", "scope_id")), ("po", orders_cte("pd", "scope_id")),
            *_report_rows("scope_id")]
    ctes = _report_row_ctes(base, "scope_id", "ranked")
    return with_ctes(["snap_events", "scope"], ctes,
                     "SELECT scope_id AS category_id, product_id, revenue, abc_revenue FROM rows_final")


def reports_per_user_day() -> str:
    return with_ctes(["report_requests"], [], """
        SELECT user_id, report_type, CAST(created_at AS DATE) AS date, count(*) AS report_count
        FROM report_requests GROUP BY user_id, report_type, CAST(created_at AS DATE)""")


def report_quota() -> str:
    return with_ctes(["report_requests", "users", "plans"], [], f"""
        SELECT report_id, user_id, report_type, date,
               CASE WHEN subscription_type IS NOT NULL AND subscription_end_at >= DATE '{EV_AS_OF}'
                         AND before < CASE WHEN report_type = 'seller' THEN shop_reports ELSE category_reports END
                    THEN 'PERMIT' ELSE 'PROHIBIT' END AS decision
        FROM (SELECT r.*, CAST(r.created_at AS DATE) AS date,
                     row_number() OVER (PARTITION BY r.user_id, r.report_type, CAST(r.created_at AS DATE)
                                        ORDER BY r.created_at, r.report_id) - 1 AS before
              FROM report_requests r) q
        LEFT JOIN users USING (user_id) LEFT JOIN plans USING (subscription_type)""")


def access_check() -> str:
    return with_ctes(["access_requests", "users", "plans"], [], f"""
        SELECT request_id, user_id, days, from_date,
               CASE WHEN days <= 0 OR (subscription_type IS NOT NULL AND subscription_end_at >= DATE '{EV_AS_OF}'
                                       AND days BETWEEN min_days AND max_days) THEN 'PERMIT' ELSE 'PROHIBIT' END
                   AS days_access,
               CASE WHEN subscription_type IS NOT NULL AND subscription_end_at >= DATE '{EV_AS_OF}'
                         AND (subscription_type = 'pro'
                              OR from_date >= CAST(DATE '{EV_AS_OF}' - (max_days + 1) AS DATE))
                    THEN 'PERMIT' ELSE 'PROHIBIT' END AS history_access
        FROM access_requests LEFT JOIN users USING (user_id) LEFT JOIN plans USING (subscription_type)""")


def shared_keys() -> str:
    return with_ctes(["access_log"], [], """
        SELECT api_key, window_start, CAST(sum(browsers) AS BIGINT) AS pairs, count(*) AS ips,
               max(browsers) AS max_browsers_per_ip,
               sum(browsers) > 2 AND (count(*) > 6 OR max(browsers) > 3) AS flagged
        FROM (SELECT api_key, time_bucket(INTERVAL '3 hours', ts) AS window_start, ip,
                     count(DISTINCT browser) AS browsers
              FROM access_log GROUP BY api_key, time_bucket(INTERVAL '3 hours', ts), ip)
        GROUP BY api_key, window_start""")


def subscription_ledger() -> str:
    return with_ctes(
        ["payments"],
        [("p", """SELECT user_id, payment_id, CAST(created_at AS DATE) AS paid_on,
                         CAST(30 * greatest(coalesce(multiply, 1), 1) AS BIGINT) AS days,
                         row_number() OVER (PARTITION BY user_id ORDER BY CAST(created_at AS DATE), payment_id) AS rn
                  FROM payments WHERE status = 'success'"""),
         ("fold", """SELECT * FROM (
                        WITH RECURSIVE f(user_id, rn, payment_id, paid_on, days, e) AS (
                            SELECT user_id, rn, payment_id, paid_on, days, CAST(paid_on + CAST(days AS INTEGER) AS DATE)
                            FROM p WHERE rn = 1
                            UNION ALL
                            SELECT p.user_id, p.rn, p.payment_id, p.paid_on, p.days,
                                   CAST(greatest(f.e, p.paid_on) + CAST(p.days AS INTEGER) AS DATE)
                            FROM f JOIN p ON p.user_id = f.user_id AND p.rn = f.rn + 1)
                        SELECT * FROM f)""")],
        "SELECT user_id, payment_id, paid_on, days, e AS subscription_end FROM fold")


def subscription_status() -> str:
    return with_ctes(["users"], [], f"""
        SELECT user_id, subscription_type, subscription_end_at, subscription_end_at > DATE '{EV_AS_OF}' AS active
        FROM users""")


def _created_rows(where: str) -> str:
    return f"""SELECT payment_id, user_id, CAST(created_at AS TIMESTAMP) AS created_at,
                      CASE WHEN status IN ('pending', 'canceled', 'failed', 'success') THEN status ELSE 'unknown' END AS status,
                      status = 'success' AS paid, amount_minor / 100 AS amount,
                      CASE plan_code WHEN 1 THEN 'default' WHEN 2 THEN 'advanced' WHEN 3 THEN 'pro' END AS subscription_type,
                      CAST(multiply AS BIGINT) AS multiply
               FROM payment_created WHERE {where}"""


#: Known status events, each once; the last of a payment; the changes of a table ``tbl`` (with ``fresh``) into success.
KNOWN = """SELECT DISTINCT payment_id, status, CAST(event_ts AS TIMESTAMP) AS event_ts, event_seq FROM payment_status
           WHERE status IN ('pending', 'canceled', 'failed', 'success')"""
LATEST = "SELECT payment_id, arg_max(status, {'t': event_ts, 's': event_seq, 'x': status}) AS new_status FROM known GROUP BY payment_id"
FIRED = """SELECT payment_id, row_number() OVER (PARTITION BY payment_id ORDER BY o, event_ts, event_seq, status) AS extension FROM (
             SELECT *, lag(status) OVER (PARTITION BY payment_id ORDER BY o, event_ts, event_seq, status) AS before FROM (
               SELECT payment_id, 0 AS o, NULL AS event_ts, NULL AS event_seq, status, fresh FROM tbl
               UNION ALL SELECT payment_id, 1, event_ts, event_seq, status, true FROM known
                 WHERE payment_id IN (SELECT payment_id FROM tbl)))
           WHERE status = 'success' AND fresh AND before IS DISTINCT FROM 'success'"""
STORED = """SELECT payment_id, user_id, CAST(created_at AS TIMESTAMP) AS created_at, status, paid, amount, subscription_type,
                   CAST(multiply AS BIGINT) AS multiply, false AS fresh FROM payments
            UNION ALL SELECT *, true FROM new"""
UNSEEN = "payment_id NOT IN (SELECT payment_id FROM payments)"


def payments_applied() -> str:
    return with_ctes(
        ["payments", "payment_created", "payment_status"],
        [("new", _created_rows(UNSEEN)), ("tbl", STORED), ("known", KNOWN), ("latest", LATEST)],
        """SELECT t.payment_id, t.user_id, t.created_at, coalesce(l.new_status, t.status) AS status,
                  coalesce(l.new_status = 'success', t.paid) AS paid, t.amount, t.subscription_type, t.multiply
           FROM tbl t LEFT JOIN latest l USING (payment_id)""")


def payment_extensions() -> str:
    return with_ctes(
        ["payments", "payment_created", "payment_status"],
        [("new", _created_rows(UNSEEN)), ("tbl", STORED), ("known", KNOWN), ("fired", FIRED)],
        """SELECT payment_id, extension, user_id, CAST(created_at AS DATE) AS paid_on, subscription_type,
                  CAST(30 * greatest(coalesce(multiply, 1), 1) AS BIGINT) AS days
           FROM fired JOIN tbl USING (payment_id)""")


def payments_streamed() -> str:
    return with_ctes(
        ["payment_created", "payment_status"],
        [("tbl", _created_rows("true").replace("SELECT payment_id", "SELECT true AS fresh, payment_id", 1)), ("known", KNOWN),
         ("latest", LATEST), ("fired", FIRED), ("n", "SELECT payment_id, count(*) AS extensions FROM fired GROUP BY payment_id")],
        """SELECT t.payment_id, t.user_id, t.created_at, coalesce(l.new_status, t.status) AS status,
                  coalesce(l.new_status = 'success', t.paid) AS paid, t.amount, t.subscription_type, t.multiply,
                  coalesce(n.extensions, 0) AS extensions
           FROM tbl t LEFT JOIN latest l USING (payment_id) LEFT JOIN n USING (payment_id)""")


ORACLE.update({
    "seller_report_rows": seller_report_rows,
    "abc_orders": abc_orders,
    "abc_revenue": abc_revenue,
    "days_in_stock": days_in_stock,
    "reports_per_user_day": reports_per_user_day,
    "report_quota": report_quota,
    "access_check": access_check,
    "shared_keys": shared_keys,
    "subscription_ledger": subscription_ledger,
    "subscription_status": subscription_status,
    "payments_applied": payments_applied,
    "payment_extensions": payment_extensions,
    "payments_streamed": payments_streamed,
})


# ------------------------------------------------------------------ ingest, storage, streaming

def _minor(s: str) -> str:
    return f"CAST(trunc(CAST({s} AS DECIMAL(20,6)) * 100) AS BIGINT)"


def flatten_products() -> str:
    sid = "(user_id % 10)"
    return f"""
        SELECT date_trunc('hour', ts) AS ts, user_id AS product_id, user_id * 10 + event_id % 3 AS sku_id,
               'product ' || CAST(user_id AS VARCHAR) AS title,
               CAST(CAST(user_id % 5 AS VARCHAR) || '.5' AS DECIMAL(9,2)) AS rating,
               2000 + user_id % 25 AS category_id,
               count(*) FILTER (WHERE event_type = 'view') OVER w AS reviews_amount,
               count(*) FILTER (WHERE event_type = 'purchase') OVER w AS total_orders_amount,
               CAST(sum((event_id * 7919) % 50) OVER w AS BIGINT) AS total_available_amount,
               (event_id * 7919) % 50 AS available_amount,
               ['a' || CAST(user_id % 3 AS VARCHAR)] AS attributes, ['t'] AS tags,
               'ph' || CAST(user_id * 10 + event_id % 3 AS VARCHAR) AS photo_key,
               MAP {{'color': 'color c' || CAST(event_id % 7 AS VARCHAR), 'size': 'size s' || CAST(event_id % 3 AS VARCHAR)}}
                   AS characteristics,
               {sid} AS seller_id, {sid} % 5 AS seller_account_id, 'shop ' || CAST({sid} AS VARCHAR) AS seller_title,
               'seller-' || CAST({sid} AS VARCHAR) AS seller_link,
               TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1600000000 + {sid} * 86400) AS seller_registration_date,
               CAST(CAST({sid} % 5 AS VARCHAR) || '.5' AS DECIMAL(9,2)) AS seller_rating,
               {sid} * 10 AS seller_reviews_count, {sid} * 100 AS seller_orders,
               MAP {{'phone': '+7' || CAST({sid} AS VARCHAR), 'email': 's' || CAST({sid} AS VARCHAR) || '@shop'}}
                   AS seller_contacts,
               user_id % 2 = 0 AS is_eco, false AS is_adult,
               CASE WHEN event_id % 4 <> 0 THEN {_minor("printf('%.3f', value + 1)")} END AS full_price,
               {_minor("printf('%.3f', value)")} AS purchase_price
        FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts))"""


def flatten_categories() -> str:
    return with_ctes(["categories_deep"], [], "SELECT category_id, parent_category_id, title FROM categories_deep")


def event_routing() -> str:
    return """
        SELECT 'product' AS route, user_id AS id FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT 'position', user_id FROM events WHERE event_type = 'view'
        UNION ALL SELECT 'category', 2000 + user_id % 25 FROM events WHERE event_type = 'signup'"""


def retention() -> str:
    return with_ctes(["snap_lineitem"], [], f"""
        SELECT category_id, count(*) AS rows_kept, min(ts) AS oldest FROM snap_lineitem
        WHERE ts > CAST(DATE '{LI_AS_OF}' - INTERVAL 4 MONTH AS TIMESTAMP) GROUP BY category_id""")


def seller_upsert() -> str:
    return with_ctes(
        ["snap_lineitem", "sellers"],
        [("u", """SELECT DISTINCT seller_id, seller_account_id AS account_id, seller_link AS link,
                         seller_title AS title FROM snap_lineitem""")],
        """SELECT * FROM u UNION ALL
           SELECT s.* FROM sellers s
           WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.seller_id = s.seller_id AND u.account_id = s.account_id)""")


ORACLE.update({
    "flatten_products": flatten_products,
    "flatten_categories": flatten_categories,
    "event_routing": event_routing,
    "streaming_daily_state": daily_state,
    "retention": retention,
    "seller_upsert": seller_upsert,
})


def report_batch() -> str:
    return with_ctes(
        ["snap_events", "scope", "report_requests"],
        [("wanted", "SELECT DISTINCT report_type, key, interval_days FROM report_requests"),
         ("rrows", """SELECT 'seller' AS report_type, seller_link AS key, r.* FROM snap_events r
                      UNION ALL
                      SELECT 'category', CAST(s.scope_id AS VARCHAR), r.* FROM snap_events r
                      JOIN scope s ON s.category_id = r.category_id"""),
         ("t", f"""SELECT w.interval_days, x.* FROM rrows x JOIN wanted w USING (report_type, key)
                   WHERE x.date BETWEEN CAST(DATE '{EV_AS_OF}' - CAST(w.interval_days AS INTEGER) AS DATE)
                                    AND DATE '{EV_AS_OF}'"""),
         ("pd", pd_cte("t", "report_type, key, interval_days", "TRUE")),
         ("po", orders_cte("pd", "report_type, key, interval_days")),
         ("summary", """SELECT report_type, key, interval_days, count(*) AS product_rows,
                               CAST(sum(o) AS BIGINT) AS total_orders, sum(r) / 100 AS total_revenue
                        FROM (SELECT report_type, key, interval_days, product_id, sum(orders) AS o,
                                     sum(orders * med) AS r
                              FROM po GROUP BY report_type, key, interval_days, product_id)
                        GROUP BY report_type, key, interval_days""")],
        """SELECT q.report_id, q.report_type, q.key, q.interval_days,
                  CASE WHEN s.product_rows > 0 THEN 'completed' ELSE 'failed' END AS status,
                  coalesce(s.product_rows, 0) AS product_rows, coalesce(s.total_orders, 0) AS total_orders,
                  coalesce(s.total_revenue, 0.0) AS total_revenue
           FROM report_requests q LEFT JOIN summary s USING (report_type, key, interval_days)""")


def report_rows_stored() -> str:
    base = [("wanted", """SELECT report_type, key, interval_days, count(*) AS requests,
                                 report_type || ':' || key || ':' || CAST(interval_days AS VARCHAR) AS report
                          FROM report_requests GROUP BY report_type, key, interval_days"""),
            ("rrows", """SELECT 'seller' AS report_type, seller_link AS key, r.* FROM snap_events r
                         UNION ALL
                         SELECT 'category', CAST(s.scope_id AS VARCHAR), r.* FROM snap_events r
                         JOIN scope s ON s.category_id = r.category_id"""),
            ("src", f"""SELECT w.report, x.* FROM rrows x JOIN wanted w USING (report_type, key)
                        WHERE x.date BETWEEN CAST(DATE '{EV_AS_OF}' - CAST(w.interval_days AS INTEGER) AS DATE)
                                         AND DATE '{EV_AS_OF}'"""),
            ("pd", _report_pd("src", "report")), ("po", orders_cte("pd", "report")), *_report_rows("report")]
    return with_ctes(["snap_events", "scope", "report_requests"], _report_row_ctes(base, "report", "ranked"),
                     "SELECT f.*, w.requests FROM rows_final f JOIN wanted w ON w.report = f.report")


def category_products_page() -> str:
    return with_ctes(["snap_events", "scope"], _q13_ctes(), """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, count(*) OVER (PARTITION BY period, category_id) AS total_row_count,
                   row_number() OVER (PARTITION BY period, category_id ORDER BY order_amount DESC, price, product_id) AS rn
            FROM qr WHERE title ILIKE '%t 1%' AND price >= 1.0) WHERE rn > 2 AND rn <= 22""")


def report_expiry() -> str:
    return with_ctes(["report_requests"], [], """
        SELECT report_id,
               CASE WHEN created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 18 HOUR THEN 'deleted'
                    ELSE status END AS status,
               CASE WHEN created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 18 HOUR THEN NULL
                    ELSE content END AS content
        FROM report_requests""")


def snapshot_store() -> str:
    return with_ctes(["snap_events"], [], """
        SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS yyyymm, category_id, count(*) AS rows,
               CAST(sum(purchase_price) AS BIGINT) AS price_sum, min(ts) AS first_ts, max(ts) AS last_ts
        FROM snap_events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
        GROUP BY 1, 2""")


def rollup_store() -> str:
    return with_ctes(
        ["snap_events", "scope"], _j2_ctes(["WEEK"]),
        f"""SELECT period, DATE '{EV_AS_OF}' AS as_of, category_id, product_id, l.title AS title,
                   max_total_order_amount, min_total_order_amount, median_price, l.reviews_amount AS reviews_amount,
                   l.photo_key AS photo_key, l.rating AS rating, l.available_amount AS available_amount
            FROM (SELECT period, category_id, product_id, max(toa) AS max_total_order_amount,
                         min(toa) AS min_total_order_amount, median(price) AS median_price, {LAST2} AS l
                  FROM sdw GROUP BY period, category_id, product_id)""")


ORACLE.update({
    "report_batch": report_batch,
    "report_rows_stored": report_rows_stored,
    "category_products_page": category_products_page,
    "snapshot_rows_stored": flatten_products,
    "report_expiry": report_expiry,
    "snapshot_store": snapshot_store,
    "rollup_store": rollup_store,
})


ORACLE["streaming_subscription_ledger"] = subscription_ledger


def subscription_grants() -> str:
    return with_ctes(
        ["users"],
        [("g", """SELECT CASE WHEN c_nationkey % 2 = 1 THEN c_custkey + 1000000 ELSE c_custkey END AS user_id,
                         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'set' ELSE 'demo' END AS kind,
                         CASE c_nationkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'advanced' ELSE 'pro' END AS plan,
                         CAST(7 + c_custkey % 30 AS INTEGER) AS days,
                         CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS DATE) AS granted_on
                  FROM customer"""),
         ("sets", """SELECT g.user_id, g.plan,
                            CAST(greatest(coalesce(u.subscription_end_at, g.granted_on), g.granted_on) + g.days AS DATE)
                                AS end_at
                     FROM g LEFT JOIN users u ON u.user_id = g.user_id WHERE g.kind = 'set'"""),
         ("demo", """SELECT user_id, CAST(granted_on + days AS DATE) AS end_at FROM g
                     WHERE kind = 'demo'
                       AND user_id NOT IN (SELECT user_id FROM users WHERE subscription_type IS NOT NULL)
                       AND user_id NOT IN (SELECT user_id FROM sets)""")],
        """SELECT coalesce(u.user_id, s.user_id, d.user_id) AS user_id,
                  coalesce(s.plan, CASE WHEN d.end_at IS NOT NULL THEN 'demo' END, u.subscription_type)
                      AS subscription_type,
                  coalesce(s.end_at, d.end_at, u.subscription_end_at) AS subscription_end_at
           FROM users u FULL OUTER JOIN sets s ON s.user_id = u.user_id
           FULL OUTER JOIN demo d ON d.user_id = coalesce(u.user_id, s.user_id)""")


ORACLE["subscription_grants"] = subscription_grants


def approx_within() -> str:
    return with_ctes(["snap_events", "scope"], [("src", scoped_src())], """
        SELECT scope_id AS category_id, date, count(DISTINCT seller_id) AS seller_count,
               count(DISTINCT product_id) AS product_count, TRUE AS sellers_within, TRUE AS products_within
        FROM src GROUP BY scope_id, date""")


def payment_money() -> str:
    return with_ctes(["payments"], [("m", "SELECT payment_id, CAST(round(amount * 100) AS BIGINT) AS cents FROM payments")], """
        SELECT payment_id, cents // 100 AS units, CAST((cents % 100) * 10000000 AS INTEGER) AS nanos,
               CAST(643 AS INTEGER) AS currency_code FROM m""")


def product_links() -> str:
    return f"SELECT f.*, 'https://example.com/product/' || CAST(product_id AS VARCHAR) AS url FROM ({first_discovered()}) f"


def seller_list() -> str:
    return f"SELECT s.*, count(*) OVER () AS total_row_count FROM ({seller_overall()}) s"


def requested_sellers_dynamic() -> str:
    asked = with_ctes(["report_requests"], [], "SELECT key FROM report_requests WHERE report_type = 'seller' AND interval_days = 21")
    return f"SELECT * FROM ({seller_order_dynamic()}) d WHERE seller_link IN ({asked})"


def category_cards_top() -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
                   SELECT c.*, row_number() OVER (PARTITION BY period ORDER BY revenue DESC, category_id) AS rn
                   FROM ({category_cards()}) c) WHERE rn <= 10"""


ORACLE.update({
    "approx_within": approx_within,
    "position_store": position_history,
    "payment_money": payment_money,
    "product_links": product_links,
    "seller_list": seller_list,
    "requested_sellers_dynamic": requested_sellers_dynamic,
    "category_cards_top": category_cards_top,
})


def daily_state_of_events() -> str:
    return f"""
        SELECT product_id, sku_id, CAST(ts AS DATE) AS date, max(category_id) AS category_id,
               min(total_orders_amount) AS min_total_order_amount, max(total_orders_amount) AS max_total_order_amount,
               min(available_amount) AS min_available_amount, max(available_amount) AS max_available_amount,
               max(seller_id) AS seller_id, max(seller_account_id) AS seller_account_id,
               max(seller_title) AS seller_title, max(seller_link) AS seller_link, max(rating) AS rating,
               max(seller_registration_date) AS seller_registration_date, bool_or(is_eco) AS is_eco, bool_or(is_adult) AS is_adult,
               median(purchase_price) AS median_price, median(full_price) AS median_full_price,
               arg_max(title, ts) AS title, arg_max(photo_key, ts) AS photo_key,
               arg_max(reviews_amount, ts) AS reviews_amount
        FROM ({flatten_products()}) GROUP BY ALL"""


ORACLE["daily_state_of_events"] = daily_state_of_events


def approx_median_within() -> str:
    return with_ctes(["snap_events", "scope"], [("src", scoped_src())], """
        SELECT scope_id AS category_id, date, count(purchase_price) AS prices, TRUE AS median_within
        FROM src WHERE purchase_price IS NOT NULL GROUP BY scope_id, date""")


def product_price_filled() -> str:
    return with_ctes(
        ["snap_events"],
        [("src", f"SELECT * FROM snap_events WHERE date BETWEEN {EV_D}"), ("pd", pd_cte("src", "", "TRUE")),
         ("cal", f"""SELECT product_id, CAST(unnest(generate_series(DATE '{EV_FROM}', DATE '{EV_TO}' - 1, INTERVAL 1 DAY)) AS DATE) AS date
                     FROM (SELECT DISTINCT product_id FROM pd)""")],
        """SELECT product_id, date, last_value(med / 100 IGNORE NULLS) OVER w AS price, last_value(stock IGNORE NULLS) OVER w AS stock
           FROM cal FULL OUTER JOIN pd USING (product_id, date)
           WINDOW w AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


def seller_overall_requested() -> str:
    counts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("order_amount", "product_count", "product_with_sales", "product_without_sales"))
    asked = with_ctes(["sellers"], [], "SELECT DISTINCT link AS seller_link FROM sellers")
    return f"""SELECT seller_link, {counts}, coalesce(revenue, 0.0) AS revenue, avg_price
               FROM ({asked}) a LEFT JOIN ({seller_overall()}) s USING (seller_link)"""


def category_descendants() -> str:
    return with_ctes(["closure_deep"], [], """
        SELECT ancestor, descendant AS category_id, depth FROM closure_deep WHERE ancestor >= 4000""")


def category_grandchildren() -> str:
    return with_ctes(["closure_deep"], [], """
        SELECT ancestor AS category_id, descendant AS grandchild_id FROM closure_deep WHERE depth = 2""")


def daily_store() -> str:
    return f"SELECT * FROM ({daily_state_of_events()}) WHERE date BETWEEN {EV_D}"


def sellers_ingested() -> str:
    return with_ctes(
        ["sellers"],
        [("u", """SELECT DISTINCT user_id % 10 AS seller_id, (user_id % 10) % 5 AS account_id,
                         'seller-' || CAST(user_id % 10 AS VARCHAR) AS link, 'shop ' || CAST(user_id % 10 AS VARCHAR) AS title FROM events""")],
        """SELECT * FROM u UNION ALL
           SELECT s.* FROM sellers s
           WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.seller_id = s.seller_id AND u.account_id = s.account_id)""")


def categories_ingested() -> str:
    return with_ctes(["categories", "categories_deep"], [], """
        SELECT category_id, parent_category_id, title FROM categories
        UNION ALL SELECT category_id, parent_category_id, title FROM categories_deep""")


ORACLE.update({
    "category_with_prev_newest": category_with_prev,
    "approx_median_within": approx_median_within,
    "product_price_filled": product_price_filled,
    "seller_overall_requested": seller_overall_requested,
    "category_descendants": category_descendants,
    "category_grandchildren": category_grandchildren,
    "seller_layout": seller_order_dynamic,
    "daily_store": daily_store,
    "snapshots_retained": retention,
    "sellers_ingested": sellers_ingested,
    "categories_ingested": categories_ingested,
})
